"""Language identification against brute force over all segmentations."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents
from vectorloom.llm import langid

PIECES = ["▁a", "▁ab", "a", "b", "ab", "ba", "bab", "abba", "é", "▁abbaab"]


def model(pieces=PIECES, languages=2, seed=0):
    table = np.random.default_rng(seed).dirichlet(np.ones(len(pieces)), languages).T
    return langid.Model(pieces, [f"l{i}" for i in range(languages)], table, langid.Fit())


def segmentations(word):
    """All ways to cut a word into pieces, or single letters that are none."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES or k == 1:
            for rest in segmentations(word[k:]):
                yield [word[:k], *rest]


def probability(m, cut, lang):
    return np.prod([m.table[PIECES.index(x) if x in PIECES else m.none, lang] for x in cut])


def test_all_segmentations_are_summed():
    m = model()
    words = ["▁" + "".join(w) for n in range(1, 7) for w in product("abé", repeat=n)] + ["▁zz", "▁azab"]
    found = m.word_scores(words)
    for w, got in zip(words, found, strict=True):
        whole = [sum(probability(m, cut, k) for cut in segmentations(w)) for k in range(2)]
        assert got == pytest.approx(np.log(whole), abs=1e-9), w


def test_expected_counts_by_brute_force():
    m, words = model(), ["▁abba", "▁ab", "▁abbaab", "▁bzb"]
    counts = np.array([[3, 1], [2, 0], [1, 5], [0, 2]], float)
    expected = np.zeros_like(m.table)
    for w, c in zip(words, counts, strict=True):
        for k in range(2):
            cuts = list(segmentations(w))
            p = np.array([probability(m, cut, k) for cut in cuts])
            for cut, share in zip(cuts, p / p.sum(), strict=True):
                for x in cut:
                    expected[PIECES.index(x) if x in PIECES else m.none, k] += share * c[k]
    assert m.expect(words, counts) == pytest.approx(expected, abs=1e-9)


def plain_log(m, word):
    """The forward sum with whole numbers' logarithms, place by place."""
    logs = [np.zeros(len(m.languages))]
    for j in range(1, len(word) + 1):
        terms = [logs[a] + np.log(m.table[PIECES.index(word[a:j]) if word[a:j] in PIECES else m.none]) for a in range(j) if word[a:j] in PIECES or j - a == 1]
        logs.append(np.logaddexp.reduce(terms, axis=0))
    return logs[-1]


@pytest.mark.parametrize("n", [15, 16, 17, 47, 48, 49, 1000])
def test_long_runs_are_not_cut(n):
    m, r = model(), np.random.default_rng(n)
    words = ["▁" + "".join(r.choice(list("abéz"), n)) for _ in range(3)] + ["▁" + "z" * n, "▁ab"]
    for w, got in zip(words, m.word_scores(words), strict=True):
        assert got == pytest.approx(plain_log(m, w), rel=1e-9)
    total = m.expect(words, np.ones((len(words), 2)))
    assert np.isfinite(total).all() and (total.sum(0) >= n - 1e-6).all()


def test_trie_finds_what_a_dict_finds():
    r = np.random.default_rng(1)
    pieces = sorted({"".join(r.choice(list("abcdeéß漢"), r.integers(1, 9))) for _ in range(4000)})
    trie = langid.Trie(pieces)
    for text in pieces[::7] + ["zzz", "abcdeabcde"]:
        node = np.zeros(1, np.int64)
        for k, c in enumerate(text, 1):
            node = trie.step(node, np.array([ord(c)]))
            if node[0] < 0:
                assert not [p for p in pieces if p.startswith(text[:k])]
                break
            assert (pieces[trie.piece[node[0]]] if trie.piece[node[0]] >= 0 else None) == (text[:k] if text[:k] in set(pieces) else None)


def test_many_languages_and_odd_rows(spark):
    """More languages than two hundred, each with words of its own; ids beside a null stay what they are."""
    names = [f"l{i:03d}" for i in range(230)]
    words = {n: [f"{'abcdefghijklmnop'[i % 16]}{'qrstuvwxyz'[i // 16 % 10]}{'aeiou'[i // 160]}"] for i, n in enumerate(names)}
    big = 1 << 60
    rows = [(big + 3 * i + k, n, " ".join(words[n] * 30)) for i, n in enumerate(names) for k in range(3)]
    df = spark.createDataFrame([*rows, (None, None, "one"), (big + 9999, "l000", None), (big + 9999, "l000", " 12 ?! ")], "doc_id long, lang string, text string").coalesce(1)
    from vectorloom.llm.queries import tokenizer_file

    found = langid.predict(df.withColumn("score", F.lit("x")), langid.train(df, tokenizer_file("piece_bpe_32k.model"))).collect()
    assert sorted([r.doc_id for r in found], key=repr) == sorted([r.doc_id for r in df.collect()], key=repr)
    learned = {r.lang for r in df.where(~langid.held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("lang").distinct().collect()}
    by = {r.doc_id: r.lang_pred for r in found}
    right = [by[i] == n for i, n, _ in rows if n in learned]
    assert len(learned) > 200 and sum(right) >= 0.95 * len(right)
    assert [r.lang_pred for r in found if r.doc_id == big + 9999] == ["und", "und"]
    docs = documents(spark)
    assert langid.predict(docs, langid.train(docs.limit(0), tokenizer_file("piece_bpe_32k.model"))).where("lang_pred <> 'und'").count() == 0
