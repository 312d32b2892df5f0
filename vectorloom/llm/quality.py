"""Quality rules by distribution divergence, in DataFrame functions only.

A text is described by two histograms: the classes of its characters, and the common words of a language with one
bin for each word and one for all others. Both are held against references of each language, which are learned from
the documents themselves: of the documents that say a language and pass the base rules the histograms of characters
are averaged, so that no long text outweighs many, and the words counted, of which the commonest become the bins. A text is rejected if the Jensen-Shannon
distance (square root of the divergence to base 2, from 0 to 1) of either histogram to its nearest reference is
above a threshold. Short texts have histograms of few counts, so each test has a minimum length under which it
passes.

A language with few words has no reference, nor has a document that says none. Such texts can't be told from junk by
their words, so only their characters are judged, by the average over all documents; the classes of
characters are those of any alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.llm.common import BLANKS, let, materialise

#: Character classes, each taken from what the ones before leave; the rest is the last class.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"[\p{L}\p{M}]+", r"\p{N}+", r"[.,;:?!'\"()\-]+")
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: What the words of the histogram are cut at.
TERM_CUT = r"[\x20\x09-\x0D.,;:!?]+"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Distances above which a text is rejected, and the counts from which each distance is taken.
    max_char_distance: float = 0.30
    min_chars: int = 200
    max_word_distance: float = 0.42
    min_terms: int = 60
    #: Common words of a language, and the words of its documents from which it has a reference.
    common_words: int = 40
    min_reference_terms: int = 2000


def _repeated(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Sorting (hash, position) puts equal windows side by side; the words
    that the repeated windows cover are counted from the gaps between their sorted positions. Texts without an
    equal pair of windows are told by the number of different hashes.
    """

    def marked(keys: Column) -> Column:
        def at(i: Column) -> Column:
            return F.get(keys, i)["h"]

        hits = F.filter(keys, lambda x, i: F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False)))
        return F.sort_array(F.transform(hits, lambda x: x["p"]))

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda s, x: s + x,
        )

    def counted(hashes: Column) -> Column:
        keys = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(keys, marked), covered))

    hashes = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(F.lit(0), F.size(words) - 2))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def _duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0),
        lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    )


def _class_counts(solid: Column) -> Column:
    """Characters of each class of a text without blanks."""

    def step(text: Column, classes: tuple[str, ...]) -> Column:
        if not classes:
            return F.array(F.length(text).cast("long"))
        return let(F.regexp_replace(text, classes[0], ""), lambda rest: F.concat(F.array((F.length(text) - F.length(rest)).cast("long")), step(rest, classes[1:])))

    return step(solid, CLASSES)


def text_of() -> Column:
    """The text of a row that is kept as the struct ``_doc``; a null one is empty."""
    return F.coalesce(F.col("_doc")["text"], F.lit(""))


def features(docs: DataFrame) -> DataFrame:
    """_doc (the row), lang and the base counts of each row of ``docs``; a null text counts as an empty one."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    lang = F.col("`lang`") if "lang" in docs.columns else F.lit(None).cast("string")
    named = docs.select(row, lang.alias("lang"))

    def counted(w: Column) -> Column:
        solid = let(F.array_join(w, ""), lambda s: F.struct(F.length(s).cast("long").alias("n"), _class_counts(s).alias("kinds")))
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"), solid.alias("solid"))

    words = F.array_remove(F.split(text_of(), BLANK_RUN, -1), "")
    counts = named.select(
        "_doc",
        "lang",
        F.regexp_count(text_of(), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _duplicate_lines(text_of()).alias("n_dup_lines"),
        let(words, counted).alias("w"),
    )
    return counts.select("_doc", "lang", "w.n_words", F.col("w.solid.n").alias("word_chars"), "n_symbols", "n_dup_lines", "w.n_repeat_words", F.col("w.solid.kinds").alias("char_counts"))


def terms(text: Column) -> Column:
    """The words of the histogram: in lower case, without sentence punctuation."""
    return F.array_remove(F.split(F.lower(text), TERM_CUT, -1), "")


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


@dataclass(frozen=True)
class References:
    """Shares of the character classes by language and of all documents, and of the common words by language."""

    chars: dict[str, list[float]]
    all_chars: list[float] | None
    words: dict[str, dict[str, float]]


def references(feats: DataFrame, rules: QualityRules = QualityRules()) -> References:
    """Learned from all documents that pass the base rules.

    Words are counted partly before they are shuffled, and ranked partly before that too, so what reaches the driver is
    ``common_words`` rows and one histogram for each language.
    """
    good = feats.where(~base_failed(rules))
    bins = len(CLASSES) + 1
    sums = good.groupBy("lang").agg(*[F.sum(F.get("char_counts", F.lit(i)) / F.col("word_chars")).alias(f"c{i}") for i in range(bins)]).collect()
    counts = materialise(good.where(F.col("lang").isNotNull()).select("lang", F.explode(terms(text_of())).alias("term")).groupBy("lang", "term").count(), "terms", compression="zstd")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("count").alias("n")).where(F.col("n") >= rules.min_reference_terms).collect()}
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "term"))
    top = counts.withColumn("_at", at).where(F.col("_at") <= rules.common_words).collect()
    words: dict[str, dict[str, float]] = {x: {} for x in sorted(totals)}
    for r in top:
        if r["lang"] in words:
            words[r["lang"]][r["term"]] = r["count"] / totals[r["lang"]]

    def shares(rows: list) -> list[float] | None:
        found = [sum(r[f"c{i}"] for r in rows) for i in range(bins)]
        return [x / sum(found) for x in found] if sum(found) else None

    chars = {x: s for x in words if (s := shares([r for r in sums if r["lang"] == x]))}
    return References(chars, shares(sums), words)


def _term(p: Column, q: Column) -> Column:
    """What a bin with the shares p and q adds to the divergence."""
    side = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    return (side(p, q) + side(q, p)) / 2


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), divergence)))


def js_distance(counts: Column, share: Column) -> Column:
    """Jensen-Shannon distance of counts and a reference's shares; null if there is no count."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    both = let(total, lambda n: F.zip_with(counts, share, lambda x, q: _term(x / n, q)))
    return F.when(F.exists(counts, lambda x: x > 0), _distance(F.aggregate(both, F.lit(0.0), lambda s, x: s + x)))


def word_distance(words: Column, known: dict[str, dict[str, float]]) -> Column:
    """The least Jensen-Shannon distance of a list of words to the common words of any language.

    Bins that the text doesn't reach add half their share, so only words that are in the text are looked up: the
    common ones are sorted, and runs of equal ones are counted.
    """
    every = sorted({w for shares in known.values() for w in shares})

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return let(starts, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("c"))))

    def to(shares: dict[str, float], found: Column, n: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"))

        def add(s: Column, x: Column) -> Column:
            q, p = F.try_element_at(table, x["w"]), x["c"] / n
            return F.struct((s["d"] + F.coalesce(_term(p, q) - q / 2, F.lit(0.0))).alias("d"), (s["p"] + F.when(q.isNotNull(), p).otherwise(F.lit(0.0))).alias("p"))

        total = sum(shares.values())
        rest = F.lit(max(0.0, 1.0 - total))
        return let(F.aggregate(found, zero, add), lambda s: _distance(s["d"] + F.lit(total / 2) + _term(F.greatest(F.lit(0.0), 1 - s["p"]), rest)))

    def nearest(w: Column) -> Column:
        common = F.sort_array(F.filter(w, lambda x: x.isin(every)))
        pairs = let(common, lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<w:string,c:int>>")))
        return let(pairs, lambda found: F.array_min(F.array(*[to(shares, found, F.size(w)) for shares in known.values()])))

    return let(words, nearest) if every else F.lit(None).cast("double")


def other_script(text: Column, known: dict[str, dict[str, float]]) -> Column:
    """Most letters of the text are in none of the common words of any language."""
    inventory = "".join(sorted({c for shares in known.values() for w in shares for c in w}))
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")
    return let(letters, lambda x: 2 * F.length(F.translate(x, inventory, "")) > F.length(x))


def judged(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """``features`` with base_failed, both distances and kept."""
    feats = materialise(features(docs), "quality", compression="zstd")
    refs = references(feats, rules)
    # a text that names no language is held against all of them, unless it is in another script than theirs
    own = F.when(F.col("lang").isNull(), ~other_script(text_of(), refs.words)).otherwise(F.col("lang").isin(list(refs.words))) if refs.words else F.lit(False)

    def nearest(shares: list[list[float]]) -> Column:
        found = [js_distance(F.col("char_counts"), F.array(*map(F.lit, s))) for s in shares]
        return F.array_min(F.array(*found)) if found else F.lit(None).cast("double")

    chars = F.when(own, nearest(list(refs.chars.values()))).otherwise(nearest([refs.all_chars] if refs.all_chars else []))
    passed = feats.withColumn("base_failed", base_failed(rules))
    words = F.when(own & ~F.col("base_failed"), let(terms(text_of()), lambda t: F.when(F.size(t) >= rules.min_terms, word_distance(t, refs.words))))
    measured = passed.withColumn("char_distance", F.when(~F.col("base_failed") & (F.col("word_chars") >= rules.min_chars), chars)).withColumn("word_distance", words)
    return measured.withColumn(
        "kept",
        ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= rules.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= rules.max_word_distance),
    )


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base counts, base_failed, both distances, kept.

    A null or empty text has no words, so it fails the base rules; distances are taken of texts that pass them. Rows
    are judged one by one: repeated rows and null doc_ids get a row each. A text that names no language is held against the
    references of all and must be like one of them. One in another script than theirs, and one that names a language
    without a reference, can't be: it is judged by its characters alone, against the average of all documents. Without any document that passes the base rules
    there are no references, and the base rules alone decide. A text's distance is the least over all languages, so
    a text in another of them than its lang says is not rejected. Extra columns are ignored; without a column lang no
    document says a language.
    """
    found = judged(docs.select(*[F.col(f"`{c}`") for c in ("doc_id", "text", "lang") if c in docs.columns]), rules)
    return found.select(F.col("_doc")["doc_id"].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, which go through the one table that is written."""
    return judged(docs, rules).where("kept").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
