import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import test_lines, test_minhash, test_quality
from tests.llm.fixtures import documents, prose
from tests.oracle import spark_rows, sql_rows
from vectorloom.llm import quality, queries


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).cache()
        if k < 4:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_queries_with_sql(spark):
    for name, sql in queries.ORACLES.items():
        assert spark_rows(queries.QUERIES[name](spark, DATA)) == sql_rows(DATA, sql), name


CLASSES = (r"\p{Ll}", r"\p{Lu}", r"[\p{L}\p{M}]", r"\p{N}", r"[.,;:?!'\"()\-]")


def classes(text):
    """Shares of the characters that aren't blank, by the first class that holds each."""
    counts, bare = Counter(), "".join(regex.findall(r"[^\x20\x09-\x0D]+", text))
    for c in bare:
        counts[next((k for k, p in enumerate(CLASSES) if regex.match(p, c)), len(CLASSES))] += 1
    return [counts[k] / len(bare) for k in range(len(CLASSES) + 1)], len(bare)


def js(p, q):
    half = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q, strict=True)) / 2))


def good_documents(rows, rules=quality.QualityRules()):
    """Of doc_id, text, lang: the rows that pass the quality rules."""
    passed = [(i, t, lang) for i, t, lang in rows if not test_quality.brute(t)[-1]]
    terms = lambda t: [w for w in regex.split(r"[\x20\x09-\x0D.,;:!?]+", t.lower()) if w]
    counts, chars = defaultdict(Counter), defaultdict(list)
    for _, t, lang in passed:
        chars[lang].append(classes(t)[0])
        if lang is not None:
            counts[lang].update(terms(t))
    words = {}
    for lang, c in counts.items():
        if sum(c.values()) >= rules.min_reference_terms:
            top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: rules.common_words]
            words[lang] = {w: n / sum(c.values()) for w, n in top}
    every = np.mean([x for own in chars.values() for x in own], 0).tolist()
    means = [np.mean(chars[lang], 0).tolist() for lang in words]
    seen, out = {c for own in words.values() for w in own for c in w}, []
    for i, t, lang in passed:
        share, n = classes(t)
        letters = [c for c in t.lower() if regex.match(r"\p{L}", c)]
        own = lang in words or lang is None and bool(words) and 2 * sum(c not in seen for c in letters) <= len(letters)
        if n >= rules.min_chars and min(js(share, m) for m in (means if own else [every])) > rules.max_char_distance:
            continue
        w = terms(t)
        if own and len(w) >= rules.min_terms and min(test_quality.plain_distance(w, s) for s in words.values()) > rules.max_word_distance:
            continue
        out.append((i, t, lang))
    return out


def without_passages(rows, length=50):
    """Texts without the characters of which a byte is covered by a string that starts in an earlier document."""
    none = 1 << 63
    first = {}
    for i, t in rows:
        data = t.encode()
        for s in range(len(data) - length + 1):
            first[data[s : s + length]] = min(first.get(data[s : s + length], none), none if i is None else i)
    out = []
    for i, t in rows:
        data = t.encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (none if i is None else i):
                gone[s : s + length] = [True] * length
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, "".join(kept)))
    return out


def test_run_by_brute_force(spark, tmp_path):
    shared = " ".join(f"passage{i}" for i in range(30))
    more = [(100 + i, f"{prose(500 + i, 90)}\n{shared if i % 4 == 0 else ''}\n{prose(600 + i, 60)}", "en") for i in range(24)]
    more += [(200, prose(1, 200).upper().replace(" ", "!! "), "en"), (201, " | ".join(f"zx{i}q" for i in range(200)), "en"), ((1 << 60) + 1, prose(77, 120), None)]
    plain = [(i, t, "en" if i and i % 2 else None) for i, t in documents(spark, plain=True)] + more
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in plain], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    rows = good_documents(plain)
    rows = [(i, t) for i, _, _, t in test_lines.brute([(i, t) for i, t, _ in rows])]
    firsts = {i for i, _, _, kept in test_minhash.brute(rows, 5, 80) if kept}
    rows = without_passages([(i, t) for i, t in rows if i in firsts])
    tokenizer = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    expected = []
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected.append((i, k // 4096, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    found = corpus_pipeline.run(spark, str(tmp_path))
    got = [(r.doc_id, r.piece, r.length, r.ids_crc32) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {200, 201} & {x[0] for x in got} == set() and len({x[0] for x in got}) > 20
    assert found.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
