"""Queries of the operators in this subpackage, and the DuckDB SQL that some are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import ann, audit, bpe, chat, compaction, langid, lines, minhash, packing, quality, quality_sql, spelling, suffix, tokenfiles
from vectorloom.llm.common import materialise, new_path, table


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.removed(suffix.spans(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Rules(words=3, percent=85, bands=30, rows=5))


#: Both rows of conversation -1 say this.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    messages = materialise(chat.messages_of(turns.unionByName(added)), "messages")
    return chat.digests(chat.format_paths(messages))


def reply_tree_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best branches of trees that branch: message n of a conversation answers message n / 2, and has a score by its length."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tree = chat.messages_of(turns).withColumns(
        {
            "parent": F.when(F.col("node") > 1, F.floor(F.col("node") / 2)),
            "score": (F.length(F.coalesce("text", F.lit(""))) % 7).cast("double"),
        }
    )
    found = chat.format_paths(materialise(tree, "messages"), best=2)
    read = F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(F.col("tree").cast("long").alias("conv_id"), "leaf", "rank", F.round("score", 9).alias("score"), "n_turns", F.sha2(F.array_join(read, ""), 256).alias("turns_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the last version finds after four arrivals and the merges that they cause."""
    store = compaction.Store(spark, new_path(spark, "store"))
    found = compaction.ingest(table(spark, sf_dir, "documents"), store, "doc_id", arrivals=4, tiers=compaction.Tiers())
    return found.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def compaction_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests say after four arrivals of a table that is small enough for one tier: each version's runs, files and rows."""
    store = compaction.Store(spark, new_path(spark, "store"))
    docs = table(spark, sf_dir, "documents")
    for k in range(4):
        store.append(docs.where(F.col("doc_id") % 4 == k))
    store.compact(compaction.Tiers(least_bytes=1 << 40, target_bytes=1 << 40))
    rows = [(v, len(runs), sum(len(r.files) for r in runs), sum(r.rows for r in runs)) for v, runs in map(store.manifest, store.versions())]
    return spark.createDataFrame([(v, n, f if v == 5 else None, r) for v, n, f, r in rows], "version long, n_runs long, n_files long, n_rows long")


def op9_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, tokenizer_file("piece_bpe_32k.model")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads back what it has written; the files stay until a ``scratch`` around it ends."""
    to = new_path(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), to, tokenizer_file("byte_bpe_50k.json"))
    return tokenfiles.digests(tokenfiles.read(spark, to))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_super_minhash": op4_super_minhash,
    "op5_reply_trees": op5_reply_trees,
    "reply_tree_branches": reply_tree_branches,
    "op6_line_dedup": op6_line_dedup,
    "op7_anisotropic_search": op7_anisotropic_search,
    "op8_size_tiered_compaction": op8_size_tiered_compaction,
    "compaction_manifest": compaction_manifest,
    "op9_bpe_segment_tree": op9_bpe_segment_tree,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_orc_token_files": op12_orc_token_files,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op2_quality_rules": quality_sql.sql(),
    "op5_reply_trees": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, length(role || text) AS n,
                   length(role || text) - length(replace(role || text, '&', '')) AS amps,
                   length(role || text) - length(replace(role || text, '<', '')) AS lts,
                   length(role || text) - length(replace(replace(role || text, '[', ''), ']', '')) AS brackets
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(n + 4 * amps + 3 * lts + 4 * brackets + 11)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op6_line_dedup": """
        WITH l AS (
            SELECT doc_id, i, x,
                   translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
        f AS (
            SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 20
            GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE owner IS NOT NULL AND doc_id <> owner) AS n_dropped,
               sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE owner IS NULL OR doc_id = owner), '')) AS kept_sha256
        FROM l LEFT JOIN f ON l.k = f.k
        GROUP BY doc_id
    """,
    "reply_tree_branches": """
        WITH m AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS node, count(*) OVER (PARTITION BY conv_id) AS n
            FROM conversations),
        leaves AS (SELECT conv_id, node AS leaf FROM m WHERE 2 * node > n),
        p AS (SELECT conv_id, leaf, unnest(list_transform(range(0, floor(log2(leaf))::BIGINT + 1), lambda k: leaf >> k)) AS node FROM leaves),
        b AS (
            SELECT conv_id, leaf, round(avg(length(text) % 7), 9) AS score, round(avg(length(text) % 7), 12) AS s, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY node)) AS turns_sha256
            FROM p JOIN m USING (conv_id, node) GROUP BY conv_id, leaf)
        SELECT conv_id, leaf, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, leaf)::INT AS rank, score, n_turns, turns_sha256
        FROM b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, leaf) <= 2
    """,
    "compaction_manifest": """
        SELECT v AS version, CASE WHEN v = 5 THEN 1 ELSE v END AS n_runs, CASE WHEN v = 5 THEN 1 END AS n_files,
               (SELECT count(*) FROM documents WHERE v = 5 OR doc_id % 4 < v) AS n_rows FROM range(1, 6) r(v)
    """,
    "op8_size_tiered_compaction": """
        SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents
    """,
    # CRC by its definition, a bit at a time for the table of bytes; near words by shared rests of one place, no candidates
    "op11_spelling_variants": """
        WITH RECURSIVE t AS (
            SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc_of
            FROM range(256) r(b)),
        occ AS (
            SELECT doc_id, r, count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents)
            GROUP BY ALL),
        h AS (
            SELECT r, times,
                   xor(4294967295, list_reduce(
                       list_transform(regexp_extract_all(hex(encode(concat(doc_id, ':', r))), '..'), lambda x: ('0x' || x)::BIGINT),
                       lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1]), 4294967295)) AS h
            FROM occ, t),
        w AS (
            SELECT CASE WHEN h % 199 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, sum(times)::BIGINT AS n
            FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5),
        cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
        pairs AS (
            SELECT a.word, a.n, b.word AS near, b.n AS m FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT a.word, a.n, w.word, w.n FROM cut a JOIN w ON a.rest = w.word
            UNION SELECT w.word, w.n, a.word, a.n FROM cut a JOIN w ON a.rest = w.word),
        f AS (
            SELECT word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
            FROM w LEFT JOIN (
                SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
                QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1) USING (word)),
        up AS (
            SELECT word, word AS root, form AS next FROM f
            UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
        SELECT f.*, root FROM f JOIN (SELECT word, root FROM up WHERE next IS NULL) USING (word)
    """,
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT coalesce(source, '') AS part, quality, toxic, coalesce(text, '') AS t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again
            FROM documents LEFT JOIN labels USING (doc_id)),
        m AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
            FROM (SELECT *, list_filter([
                      CASE WHEN len(words) < 50 THEN 'A' END,
                      CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
                      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END,
                      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                      CASE WHEN again THEN 'E' END], lambda k: k IS NOT NULL) AS fails FROM d)
            GROUP BY part, fails),
        letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
            FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM orders),
        r AS (
            SELECT part, filter_order, step, own,
                   sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
                   sum(n) FILTER (hit AND len(fails) = 1) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
            FROM (SELECT *, list_contains(fails, own) AS hit, len(list_filter(fails, lambda k: contains(before, k))) > 0 AS gone FROM m, steps)
            GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
        FROM r
    """,
}
