"""Queries on texts, conversations, sources, batches and instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import media, text
from vectorloom.functions.tables import ordinals, prefix
from vectorloom.operators import batching, epochs, evaluation, instructions, mining, mixing, reports
from vectorloom.plans.catalogue import register
from vectorloom.plans.fixtures import load
from vectorloom.sources import readers
from vectorloom.streaming.ingest import window_counts

HOLE = text.PLACEHOLDER


def _strip(x: str) -> str:
    r"""SQL of a strip of all white space."""
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def corpus_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = mining.dedup_corpus(load(spark, d, "documents"), "text", None, "doc_id")
    return found.select("corpus_id", F.md5("key").alias("key_md5"), "first")


register(
    "corpus_dedup",
    corpus_dedup,
    f"""WITH k AS (SELECT 'TXT::' || {_strip("coalesce(text, '')")} AS key, min(doc_id) AS first FROM documents GROUP BY 1)
        SELECT row_number() OVER (ORDER BY first) - 1 AS corpus_id, md5(key) AS key_md5, first FROM k""",
)


def label_vocab(spark: SparkSession, d: str) -> DataFrame:
    name = text.strip(F.concat_ws(" ", "lang", "source"))
    return load(spark, d, "documents").select(name.alias("label")).where("label <> ''").distinct()


register("label_vocab", label_vocab, "SELECT DISTINCT trim(concat_ws(' ', lang, source)) AS label FROM documents WHERE trim(concat_ws(' ', lang, source)) <> ''")


def clean_placeholder(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(f" {HOLE}\n"), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), F.col("text"))).otherwise(F.col("text"))
    docs = load(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return docs.select("doc_id", F.md5(text.clean_placeholder(F.col("raw"))).alias("marked"), F.md5(text.clean_always(F.col("raw"))).alias("always"), F.md5(text.clean_with_newline(F.col("raw"))).alias("newline"))


register(
    "clean_placeholder",
    clean_placeholder,
    f"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' {HOLE}' || chr(10) || text WHEN 1 THEN '  ' || text ELSE text END AS raw FROM documents)
        SELECT doc_id, md5(CASE WHEN contains(raw, '{HOLE}') THEN {_strip(f"replace(raw, '{HOLE}', '')")} ELSE raw END) AS marked,
               md5({_strip(f"replace(coalesce(raw, ''), '{HOLE}', '')")}) AS always, md5({_strip(f"replace(replace(coalesce(raw, ''), '{HOLE}' || chr(10), ''), '{HOLE}', '')")}) AS newline FROM r""",
)


def instruction_punct(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).otherwise(F.col("text")).alias("i"))
    return docs.select("doc_id", text.punctuate(F.col("i")).alias("instruction"), text.colon_to_stop(F.concat("i", F.lit(":"))).alias("stopped"))


register(
    "instruction_punct",
    instruction_punct,
    rf"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END AS i FROM documents), s AS (SELECT doc_id, i, {_strip('i')} AS b FROM r)
        SELECT doc_id, CASE WHEN b = '' THEN '{text.DEFAULT_INSTRUCTION.replace("'", "''")}' WHEN regexp_matches(b, '\p{{P}}$') THEN b ELSE b || '.' END AS instruction, i || '.' AS stopped FROM s""",
)


def short_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("url"), F.lit(".png"))
    return load(spark, d, "pages").select("page_id", text.short_name(name).alias("short"), text.safe_id(name).alias("safe"), media.is_image_path(name).alias("is_image"))


register(
    "short_name",
    short_name,
    "SELECT page_id, substring(url, 1, 50) || '_' || substring(md5(url || '.png'), 1, 8) || '.png' AS short, replace(url, '/', '_') AS safe, NOT contains(url, '?') AND NOT contains(url, '#') AND NOT suffix(url, '/') AS is_image FROM pages",
)


def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    brands = load(spark, d, "part").select("p_brand").distinct().withColumn("_key", text.natural_key(F.col("p_brand")))
    return ordinals(brands, ["_key", "p_brand"], name="place").select("p_brand", "place")


register(
    "natural_sort",
    natural_sort,
    r"SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^\D*'), regexp_extract(p_brand, '(\d+)', 1)::INT, p_brand) - 1 AS place FROM (SELECT DISTINCT p_brand FROM part)",
)


def _turn_lists(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("frames"))


def frame_sample(spark: SparkSession, d: str) -> DataFrame:
    both = _turn_lists(spark, d).select("conv_id", media.sample_frames(F.col("frames"), 3).alias("padded"), media.sample_frames(F.col("frames"), 3, pad=False).alias("plain"), F.size("frames").alias("n"))
    return both.select("conv_id", F.array_join(F.col("padded").cast("array<string>"), ",").alias("padded"), F.array_join(F.col("plain").cast("array<string>"), ",").alias("plain"), F.array_join(media.stride_frames(F.col("n"), 3).cast("array<string>"), ",").alias("strides"))


register(
    "frame_sample",
    frame_sample,
    """WITH f AS (SELECT conv_id, list(turn ORDER BY turn) AS a, count(*) AS n FROM conversations GROUP BY conv_id)
        SELECT conv_id, array_to_string(CASE WHEN n > 3 THEN [a[1], a[(floor((n - 1) / 2) + 1)::INT], a[n]] WHEN n = 2 THEN a || [a[2]] WHEN n = 1 THEN [a[1], a[1], a[1]] ELSE a END, ',') AS padded,
               array_to_string(CASE WHEN n > 3 THEN [a[1], a[(floor((n - 1) / 2) + 1)::INT], a[n]] ELSE a END, ',') AS plain,
               array_to_string(list_filter([0, greatest(1, n // 3), 2 * greatest(1, n // 3)], lambda i: i < n), ',') AS strides FROM f""",
)


def _options(spark: SparkSession, d: str) -> DataFrame:
    turns = load(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("o"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "o"))), lambda x: x["o"]).alias("options"))


def qa_template(spark: SparkSession, d: str) -> DataFrame:
    o = _options(spark, d).withColumn("options", F.concat("options", F.array(F.get("options", F.lit(0)))))
    answer = F.get("options", F.lit(0))
    index = text.last_match(F.col("options"), answer)
    return o.select("conv_id", F.md5(text.qa_prompt(F.lit("Which?"), F.col("options"))).alias("prompt_md5"), index.alias("answer_index"), F.get(text.lettered(F.col("options")), index).alias("answer"))


SQL_OPTIONS = "o AS (SELECT conv_id, list(text ORDER BY turn) AS a FROM conversations GROUP BY conv_id)"
register(
    "qa_template",
    qa_template,
    f"""WITH {SQL_OPTIONS}, p AS (SELECT conv_id, a || [a[1]] AS a FROM o), l AS (SELECT conv_id, a, list_transform(a, lambda x, i: '(' || chr((64 + i)::INT) || ') ' || x) AS l FROM p)
        SELECT conv_id, md5('Which?' || chr(10) || array_to_string(l, chr(10))) AS prompt_md5, (len(a) - 1)::INT AS answer_index, l[len(a)] AS answer FROM l""",
)


def option_clean(spark: SparkSession, d: str) -> DataFrame:
    each = _options(spark, d).select("conv_id", F.posexplode("options").alias("i", "o"))
    return each.select("conv_id", "i", text.option_clean(F.col("o")).alias("cleaned"), text.letter_index(F.char(F.col("i") % 26 + 65)).alias("letter"), text.yes_no_index(F.when(F.col("i") % 2 == 0, "Yes").otherwise("no")).alias("yes_no"))


register(
    "option_clean",
    option_clean,
    f"""WITH {SQL_OPTIONS}, x AS (SELECT conv_id, unnest(a) AS o, unnest(range(len(a))) AS i FROM o)
        SELECT conv_id, i::INT AS i, trim(CASE WHEN contains(o, '. ') THEN substring(o, strpos(o, '. ') + 2) ELSE o END, '. ') AS cleaned, (i % 26)::INT AS letter, (i % 2)::INT AS yes_no FROM x""",
)


def build_item(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("t"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("i")
    )
    side = text.item(F.col("t"), text.image_path("/data", F.col("i")))
    return docs.select("doc_id", side["text"].alias("text"), side["image_path"].alias("image_path"), text.positive_key(F.col("t"), F.col("i")).alias("key"), F.size(media.content(F.lit(None).cast("string"), side["image_path"], side["text"])).alias("parts"))


register(
    "build_item",
    build_item,
    f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS t, CASE WHEN doc_id % 3 = 0 THEN doc_id || '.jpg' END AS i FROM documents)
        SELECT doc_id, CASE WHEN t <> '' THEN t WHEN i IS NULL THEN 'NULL' END AS text, '/data/' || i AS image_path, CASE WHEN i IS NOT NULL THEN 'IMG::images/' || i ELSE 'TXT::' || {_strip('t')} END AS key,
               ((t <> '' OR i IS NULL)::INT + (i IS NOT NULL)::INT)::INT AS parts FROM x""",
)


def conversation_pair(spark: SparkSession, d: str) -> DataFrame:
    return readers.conversation_pairs(load(spark, d, "conversations"))


register(
    "conversation_pair",
    conversation_pair,
    """SELECT * FROM (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS question, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id)
        WHERE question <> '' AND answer <> ''""",
)

_SUBSETS = ("MSCOCO", "OK-VQA", "ImageNet_1K", "MSCOCO_t2i", "MSCOCO_i2t", "CIRR", "other")


def _event_subsets(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _SUBSETS])
    return load(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % len(_SUBSETS)).cast("int")).alias("subset"), "event_type")


SQL_SUBSETS = f"x AS (SELECT event_id, {list(_SUBSETS)}[event_id % {len(_SUBSETS)} + 1] AS subset, event_type FROM events)"


def task_type_dim(spark: SparkSession, d: str) -> DataFrame:
    x = _event_subsets(spark, d)
    return x.groupBy("subset", instructions.task_type(F.col("subset")).alias("task_type"), instructions.document_category(F.concat(F.lit("ViDoRe_"), "event_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


register(
    "task_type_dim",
    task_type_dim,
    f"""WITH {SQL_SUBSETS}, t AS (SELECT * FROM (VALUES ('MSCOCO', 'grounding'), ('OK-VQA', 'vqa'), ('ImageNet_1K', 'classification'), ('MSCOCO_t2i', 'retrieval'), ('MSCOCO_i2t', 'retrieval'), ('CIRR', 'retrieval')) v(subset, task_type))
        SELECT x.subset, coalesce(task_type, 'retrieval') AS task_type, CASE WHEN contains(event_type, 'v2') THEN 'vidore_v2' ELSE 'vidore_v1' END AS category, count(*) AS n FROM x LEFT JOIN t ON t.subset = x.subset GROUP BY ALL""",
)


def instruction_rules(spark: SparkSession, d: str) -> DataFrame:
    x = ordinals(_event_subsets(spark, d), ["event_id"], by="subset", name="row_index")
    q = F.when(F.col("event_id") % 2 == 0, F.lit("q.jpg"))
    p = F.when(F.col("event_id") % 3 == 0, F.lit("p.jpg"))
    rule = instructions.benchmark_instruction(F.col("subset"), F.col("row_index"), q, p)
    mined = instructions.mined_instruction(F.lit("retrieval"), F.concat(F.lit("mmeb_"), "subset"), F.col("row_index"))
    fallback = instructions.fallback_instruction(F.col("event_type"), F.col("subset"), F.col("row_index"))
    return x.select("event_id", rule.alias("rule"), mined.alias("mined"), fallback.alias("fallback"), instructions.side_instruction(F.lit("document"), rule).alias("document"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ALTERNATE = f"CASE WHEN r % 2 = 0 THEN {_sql_text(instructions.CLASSIFICATION[0])} ELSE {_sql_text(instructions.CLASSIFICATION[1])} END"
_KNOWN = f"""WHEN 'ImageNet_1K' THEN {_ALTERNATE} WHEN 'OK-VQA' THEN {_sql_text(instructions.VQA)} WHEN 'MSCOCO_t2i' THEN {_sql_text(instructions.TEXT_TO_IMAGE)}
    WHEN 'MSCOCO_i2t' THEN {_sql_text(instructions.IMAGE_TO_TEXT)} WHEN 'MSCOCO' THEN {_sql_text(instructions.GROUNDING)}"""
register(
    "instruction_rules",
    instruction_rules,
    f"""WITH {SQL_SUBSETS}, o AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY event_id) - 1 AS r, event_id % 2 = 0 AS q, event_id % 3 = 0 AS p, event_id % 5 > 0 AS t FROM x)
        SELECT event_id,
               CASE subset {_KNOWN} ELSE CASE WHEN q AND p THEN {_sql_text(instructions.IMAGE_PAIR)} WHEN q THEN {_sql_text(instructions.IMAGE_TO_TEXT)} ELSE {_sql_text(instructions.TEXT_TO_IMAGE)} END END AS rule,
               CASE subset {_KNOWN} WHEN 'other' THEN {_sql_text(instructions.TEXT_RETRIEVAL)} ELSE {_sql_text(instructions.TEXT_TO_IMAGE)} END AS mined,
               CASE subset {_KNOWN} WHEN 'other' THEN {_sql_text(text.DEFAULT_INSTRUCTION)} ELSE {_sql_text(instructions.TEXT_TO_IMAGE)} END AS fallback,
               {_sql_text(text.DEFAULT_INSTRUCTION)} AS document FROM o""",
)


def prompt_resolution(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("Retrieval", "STS", "BitextMining", "Classification", "InstructionRetrieval")])
    e = load(spark, d, "events")
    tasks = e.select(
        "event_id", F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string")).alias("task"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("type"),
        F.when(F.col("event_id") % 2 == 0, "query").otherwise("passage").alias("side"), F.when(F.col("event_id") % 3 == 0, F.lit(" own ")).alias("metadata_prompt"),
    )
    prompts = spark.createDataFrame([("t1", "one", "one", False), ("t2", "ask", "answer", True)], "task string, query_prompt string, passage_prompt string, symmetric boolean")
    return instructions.resolve_prompts(tasks, prompts).select("event_id", "instruction")


register(
    "prompt_resolution",
    prompt_resolution,
    """WITH x AS (SELECT event_id, 't' || event_id % 7 AS task, ['Retrieval', 'STS', 'BitextMining', 'Classification', 'InstructionRetrieval'][event_id % 5 + 1] AS type, event_id % 2 = 0 AS q, CASE WHEN event_id % 3 = 0 THEN 'own' END AS m FROM events),
        y AS (SELECT *, contains(type, 'Retrieval') AS ret, CASE WHEN task = 't1' THEN 'one' WHEN task = 't2' THEN CASE WHEN q THEN 'ask' ELSE 'answer' END ELSE m END AS i FROM x)
        SELECT event_id, CASE WHEN ret AND task <> 't2' AND NOT q THEN '' WHEN type = 'STS' THEN 'Retrieve semantically similar text' WHEN type = 'BitextMining' THEN 'Retrieve parallel sentences'
               WHEN ret AND q AND i IS NULL THEN 'Retrieval relevant passage for the given query.' ELSE coalesce(i, '') END AS instruction FROM y""",
)


def triplet_negatives(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 4 == 0, F.lit('["a", " ", "b"]')).when(F.col("doc_id") % 4 == 1, F.col("lang")).when(F.col("doc_id") % 4 == 2, F.lit("  "))
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("?")).alias("query"), F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("positive"), raw.alias("negative"), F.lit("spare").alias("hard_negative"))
    found = readers.text_triplets(docs, "msmarco")
    return found.select(F.col("query.text").alias("query"), F.col("positive.text").alias("positive"), F.array_join("negatives", "|").alias("negatives"), "task_type", "subset_name")


register(
    "triplet_negatives",
    triplet_negatives,
    """SELECT doc_id || '?' AS query, source AS positive, CASE doc_id % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN coalesce(lang, 'spare') WHEN 2 THEN '' ELSE 'spare' END AS negatives, 'retrieval' AS task_type, 'msmarco' AS subset_name
        FROM documents WHERE doc_id % 9 > 0 AND source <> ''""",
)


def cap_prefix(spark: SparkSession, d: str) -> DataFrame:
    return prefix(load(spark, d, "documents"), ["doc_id"], 100).select("doc_id", "source")


register("cap_prefix", cap_prefix, "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")


def source_mix(spark: SparkSession, d: str) -> DataFrame:
    """Three languages share a budget of 200 rows, the fourth has a cap of 50; rows of other languages stay out."""
    docs = load(spark, d, "documents").select("doc_id", F.col("lang").alias("name"))
    shared = mixing.budgets(docs.where("name IN ('de', 'es', 'fr')"), 200)
    caps = shared.unionByName(spark.createDataFrame([("en", 50)], "name string, cap long"))
    return mixing.cap_rows(docs, "name", "doc_id", caps).select("doc_id", F.col("name").alias("lang"))


register(
    "source_mix",
    source_mix,
    "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es', 'fr', 'en') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 66 ELSE 67 END",
)


def budget_split(spark: SparkSession, d: str) -> DataFrame:
    return mixing.budgets(load(spark, d, "documents").select(F.col("source").alias("name")), 1003)


register(
    "budget_split",
    budget_split,
    "WITH n AS (SELECT DISTINCT source AS name FROM documents) SELECT name, (1003 // count(*) OVER () + (row_number() OVER (ORDER BY name) - 1 < 1003 % count(*) OVER ())::INT)::BIGINT AS cap FROM n",
)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return reports.manifest(load(spark, d, "documents"), "source")


register("manifest", manifest, "SELECT source AS name, count(*) AS count FROM documents GROUP BY source")


def shard_ceil(spark: SparkSession, d: str) -> DataFrame:
    return batching.shard_ranges(load(spark, d, "documents").select("doc_id"), "doc_id", 7)


register("shard_ceil", shard_ceil, "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // ((count(*) OVER () + 6) // 7))::INT AS shard FROM documents")


def stratified_batches(spark: SparkSession, d: str) -> DataFrame:
    found = batching.stratified_batches(load(spark, d, "events"), "event_type", "event_id", 32, ranks=2)
    return found.select("event_id", "event_type", "rank", "batch", "slot", "batch_order")


register(
    "stratified_batches",
    stratified_batches,
    """WITH o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '_42'), event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) // 2 AS each FROM events),
        p AS (SELECT event_id, event_type, (k // each)::INT AS rank, k % each AS place, each FROM o WHERE k < 2 * each)
        SELECT event_id, event_type, rank, (place // 32)::INT AS batch, (place % 32)::INT AS slot, md5(event_type || '_' || rank || '_' || place // 32 || '_42') AS batch_order FROM p WHERE place < each // 32 * 32""",
)


#: SQL of the permutation of ``epochs.place``, by rounds: w(g, i, n, x, k, e) until x is one of the n rows after whole turns of eight.
SQL_EPOCHS = """
    keys AS (SELECT e, k, ('0x' || substr(md5('42_' || e || '_' || k), 1, 7))::BIGINT | 1 AS m, ('0x' || substr(md5('42_' || e || '_' || k), 8, 7))::BIGINT AS c FROM range(3) a(e), range(8) b(k)),
    grid AS (SELECT *, greatest(ceil(sqrt(n))::BIGINT, 1) AS a FROM numbered),
    w(g, i, n, a, b, e, x, k) AS (
        SELECT g, i, n, a, (n + a - 1) // a, e, i, 0 FROM grid, range(3) t(e)
        UNION ALL
        SELECT g, i, n, a, b, w.e, CASE WHEN w.k % 2 = 0
                   THEN (x // b + xor(hc, hc >> 23) % a) % a * b + x % b ELSE x // b * b + (x % b + xor(hr, hr >> 23) % b) % b END, w.k + 1
        FROM (SELECT w.*, xor((x % b) * m + c, ((x % b) * m + c) >> 17) % 2147483647 * m + c AS hc, xor((x // b) * m + c, ((x // b) * m + c) >> 17) % 2147483647 * m + c AS hr
              FROM w JOIN keys ON keys.e = w.e AND keys.k = w.k % 8) w
        WHERE NOT (w.k > 0 AND w.k % 8 = 0 AND x < n)),
    placed AS (SELECT g, i, n, e, x AS place FROM w WHERE k > 0 AND k % 8 = 0 AND x < n)
"""


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """Three epochs of all events without a sort but the one that numbers them; the last one is resumed at its fifth batch."""
    numbered = ordinals(load(spark, d, "events").select("event_id"), ["event_id"])
    n = numbered.count()
    parts = [epochs.epoch_batches(numbered, n, 32, ranks=2, epoch=e, first=4 if e == 2 else 0).withColumn("epoch", F.lit(e)) for e in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("epoch", "event_id", "rank", "batch", "slot")


register(
    "epoch_order",
    epoch_order,
    f"""WITH RECURSIVE numbered AS (SELECT 0 AS g, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n, event_id FROM events), {SQL_EPOCHS}
        SELECT e::INT AS epoch, event_id, (place % 2)::INT AS rank, (place // 2 // 32)::INT AS batch, (place // 2 % 32)::INT AS slot
        FROM placed JOIN numbered USING (i) WHERE place < placed.n // 64 * 64 AND (e < 2 OR place // 2 // 32 >= 4)""",
)


def epoch_groups(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of batches of one type of event each, over one numbering of the events of each type."""
    numbered = ordinals(load(spark, d, "events").select("event_id", "event_type"), ["event_id"], by="event_type")
    sizes = numbered.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    parts = [epochs.group_epoch(numbered, sizes, "event_type", 32, ranks=2, epoch=e).withColumn("epoch", F.lit(e)) for e in range(2)]
    return parts[0].unionByName(parts[1]).select("epoch", "event_id", "event_type", "rank", "batch", "slot", "batch_order")


register(
    "epoch_groups",
    epoch_groups,
    f"""WITH RECURSIVE numbered AS (SELECT event_type AS g, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, event_id FROM events), {SQL_EPOCHS},
        r AS (SELECT g, i, e, place // (n // 2) AS rank, place % (n // 2) AS inside, n // 2 AS each FROM placed WHERE place < n // 2 * 2)
        SELECT e::INT AS epoch, event_id, g AS event_type, rank::INT AS rank, (inside // 32)::INT AS batch, (inside % 32)::INT AS slot, md5(g || '_' || rank || '_' || inside // 32 || '_' || (42 + e)) AS batch_order
        FROM r JOIN numbered USING (g, i) WHERE e < 2 AND inside < each // 32 * 32""",
)


def epoch_batch_rows(spark: SparkSession, d: str) -> DataFrame:
    """Batches of all documents in an epoch, found from the places of the batches by the inverse of the order."""
    numbered = ordinals(load(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5")), ["doc_id"])
    n = numbered.count()
    return epochs.batch_rows(numbered, n, 16, range(0, n // 16), epoch=1).select("batch", "slot", "doc_id", "text_md5")


register(
    "epoch_batch_rows",
    epoch_batch_rows,
    f"""WITH RECURSIVE numbered AS (SELECT 0 AS g, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, doc_id, text FROM documents), {SQL_EPOCHS}
        SELECT (place // 16)::INT AS batch, (place % 16)::INT AS slot, doc_id, md5(text) AS text_md5 FROM placed JOIN numbered USING (i) WHERE e = 1 AND place < placed.n // 16 * 16""",
)


def pad_negatives(spark: SparkSession, d: str) -> DataFrame:
    listed = F.when(F.col("vec_id") % 5 > 0, F.transform(F.sequence(F.lit(1), (F.col("vec_id") % 5).cast("int")), lambda k: (F.col("vec_id") + k).cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = load(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 3).alias("batch"), listed.alias("negatives"))
    return batching.pad_negatives(rows, "batch", "negatives", F.lit(text.EMPTY_ITEM)).select("vec_id", "batch", F.array_join("padded", ",").alias("padded"))


register(
    "pad_negatives",
    pad_negatives,
    """WITH r AS (SELECT vec_id, vec_id // 3 AS batch, vec_id % 5 AS n, max(vec_id % 5) OVER (PARTITION BY vec_id // 3) AS w FROM embeddings)
        SELECT vec_id, batch, array_to_string([CASE WHEN n = 0 THEN 'NULL' ELSE (vec_id + least(k, n))::VARCHAR END for k in range(1, w + 1)], ',') AS padded FROM r""",
)


def belebele_link(spark: SparkSession, d: str) -> DataFrame:
    """Questions (labels) linked to the first context (document) of their link; different questions are numbered as first seen."""
    docs = load(spark, d, "documents").select("doc_id", F.concat_ws("_", "lang", "source").alias("link"))
    asked = load(spark, d, "labels").join(docs, "doc_id").select("doc_id", "link", F.concat_ws("_", "link", "quality", "toxic").alias("question"))
    return evaluation.link_questions(asked, docs, "question", "link", "doc_id").select("question_id", "question", "context_id")


register(
    "belebele_link",
    belebele_link,
    """WITH x AS (SELECT doc_id, lang || '_' || source AS link FROM documents), c AS (SELECT link, min(doc_id) AS context_id FROM x GROUP BY link),
        q AS (SELECT link || '_' || quality || '_' || toxic AS question, link, min(doc_id) AS first FROM labels JOIN x USING (doc_id) GROUP BY ALL)
        SELECT row_number() OVER (ORDER BY first) - 1 AS question_id, question, context_id FROM q JOIN c USING (link)""",
)


def collate(spark: SparkSession, d: str) -> DataFrame:
    """Batches of eight documents as parallel lists."""
    rows = load(spark, d, "documents").select(F.floor(F.col("doc_id") / 8).alias("batch"), (F.col("doc_id") % 8).alias("slot"), "lang", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("double")).alias("score"))
    found = batching.collate(rows, "batch", "slot", ["lang", "score"])
    return found.select("batch", "size", F.array_join("lang", ",").alias("langs"), F.aggregate("score", F.lit(0.0), lambda s, x: s + x).alias("total"))


register(
    "collate",
    collate,
    "SELECT doc_id // 8 AS batch, count(*)::INT AS size, string_agg(lang, ',' ORDER BY doc_id) AS langs, sum(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 0 END)::DOUBLE AS total FROM documents GROUP BY 1",
)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return window_counts(load(spark, d, "events"), "ts", "event_type", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


register("event_windows", event_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
