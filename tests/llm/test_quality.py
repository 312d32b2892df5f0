import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, prose
from vectorloom.llm import quality

BLANKS = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 2000 else COUNTS(grams)[g] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed)


def COUNTS(grams, memo={}):  # noqa: B006
    from collections import Counter

    key = id(grams)
    if key not in memo:
        memo.clear()
        memo[key] = Counter(grams)
    return memo[key]


def test_base_counts(spark):
    found = quality.judge(documents(spark)).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found]
    expected = [(i, *brute(t)) for i, t in documents(spark, plain=True)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert not [r for r in found if r.base_failed and r.kept]
    assert quality.judge(empty(spark)).count() == 0


SCHEMA = "doc_id long, text string, lang string"
RUSSIAN = "и в не на что он как это по но они из за то все так его для мы от вы".split()


def russian(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(RUSSIAN) if r.random() < 0.5 else "".join(r.choice("абвгдежзиклмнопрстуя") for _ in range(r.randint(3, 9))) + r.choice(["", "", ".", ","]) for _ in range(n))


def test_junk_goes_and_prose_stays(spark):
    good = [(i, prose(100 + i, 200)) for i in range(40)]
    junk = [(100, prose(1, 200).upper().replace(" ", "!! ")), (101, " | ".join(f"zx{i}q" for i in range(200))), (102, " ".join(f"{w}$$$" for w in prose(9, 200).split()))]
    rows = quality.judge(spark.createDataFrame([(i, t, "en") for i, t in good + junk], SCHEMA))
    kept = {r.doc_id for r in rows.where("kept").collect()}
    assert kept == {i for i, _ in good}


def test_languages_without_a_reference(spark):
    """Few Russian texts among English ones, with and without a language, and English ones that say another: all stay. Junk of no language goes."""
    english = [(i, prose(100 + i, 200), "en") for i in range(40)]
    few = [(100, russian(1, 300), "ru"), (101, russian(2, 300), None), (102, prose(7, 200), "ru"), (103, prose(8, 200), None)]
    junk = [(200, " | ".join(f"{i}##" for i in range(200)), None), (201, " | ".join(f"{i}##" for i in range(200)), "ru"), (202, " ".join(f"zx{i}q" for i in range(200)), "en"), (203, " ".join(f"zx{i}q" for i in range(200)), None)]
    rows = quality.judge(spark.createDataFrame(english + few + junk, SCHEMA)).collect()
    assert {r.doc_id for r in rows if r.kept} == {i for i, _, _ in english + few}
    assert {r.doc_id for r in rows if r.word_distance is None} == {100, 101, 102, 201}
    many = [(300 + i, russian(i, 200), "ru") for i in range(20)]
    rows = quality.judge(spark.createDataFrame(english + many + [(999, russian(99, 300), "en")], SCHEMA)).collect()
    assert all(r.kept and r.word_distance is not None for r in rows)


def test_small_tables(spark):
    """Where no language has enough words the sum over all documents stands for all of them."""
    numbers = " ".join(f"{i}#{i}" for i in range(100, 300))
    rows = quality.judge(spark.createDataFrame([(i, prose(i, 100), "en") for i in range(15)] + [(99, numbers, "en")], SCHEMA)).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(15))
    assert all(r.char_distance is not None and r.word_distance is None for r in rows)
    alone = quality.judge(spark.createDataFrame([(1, prose(1, 100), None), (None, None, None), (2, "", "en")], SCHEMA)).collect()
    assert {r.doc_id for r in alone if r.kept} == {1}


def plain_distance(words, shares):
    """To one language, bin by bin."""
    n, total = len(words), sum(shares.values())
    p = [words.count(w) / n for w in shares]
    bins = [*zip(p, shares.values(), strict=True), (1 - sum(p), 1 - total)]
    half = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(sum(half(a, b) + half(b, a) for a, b in bins) / 2)


def test_word_distance_by_brute_force(spark):
    known = {"en": {"the": 0.1, "of": 0.05, "a": 0.02}, "fr": {"le": 0.2, "a": 0.1}}
    texts = [["the", "of", "x", "the"], ["le", "a", "a", "y", "z"], ["q"], ["the", "le", "a", "of"] * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, w array<string>")
    found = {r.i: r.d for r in df.select("i", quality.word_distance(F.col("w"), known).alias("d")).collect()}
    assert found == pytest.approx({i: min(plain_distance(t, s) for s in known.values()) for i, t in enumerate(texts)}, abs=1e-12)


def test_rows_keep_their_columns(spark):
    docs = documents(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    verdicts = quality.judge(docs)
    assert sorted((r.doc_id or 0 for r in kept.collect())) == sorted(r.doc_id or 0 for r in verdicts.where("kept").collect())
    bare = docs.select("doc_id", "text")
    assert quality.keep_good(bare).columns == bare.columns and quality.judge(bare).count() == docs.count()
    assert quality.keep_good(empty(spark)).count() == 0


def test_distance_is_a_distance(spark):
    x = quality.js_distance(F.array(F.lit(1), F.lit(3)).cast("array<long>"), F.array(F.lit(0.25), F.lit(0.75)))
    y = quality.js_distance(F.array(F.lit(1), F.lit(0)).cast("array<long>"), F.array(F.lit(0.0), F.lit(1.0)))
    z = quality.js_distance(F.array(F.lit(0), F.lit(0)).cast("array<long>"), F.array(F.lit(0.0), F.lit(1.0)))
    assert tuple(spark.range(1).select(x, y, z).first()) == (0.0, 1.0, None)


def test_filter_keeps_rows_and_columns(spark):
    docs = documents(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.judge(docs).where("kept").count()
