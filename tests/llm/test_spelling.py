"""Spelling variants by brute force: every pair of words is compared."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import documents, empty
from vectorloom.llm import spelling
from vectorloom.llm.spelling import Rules


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    """Exactly one inserted, deleted or replaced letter apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, rules=Rules()):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if rules.damage and h % rules.damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= rules.min_length and k >= rules.min_count}
    out, form = [], {}
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = others[0] if others and n[others[0]] >= rules.ratio * n[w] else None
        out.append((w, n[w], len(others)))
    for k, (w, c, others) in enumerate(out):
        root = w
        while form[root]:
            root = form[root]
        out[k] = (w, c, others, form[w], n.get(form[w]), root)
    return sorted(out)


def rows_of(found):
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])


def misspelt(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(5, 8))) for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = r.choice(base[: 1 + r.randint(0, 11)])
            if r.random() < 0.15:
                at, c = r.randrange(len(w)), r.choice("abcéÀ×")
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:], w + c])
            words.append(w.capitalize() if r.random() < 0.1 else w)
        rows.append((None if i == 7 else 1 << 60 | i, r.choice([" ", ", ", "1"]).join(words)))
    return rows + rows[:3] + [(1, None), (2, ""), (None, None)]


@pytest.mark.parametrize(("seed", "rules"), [(1, Rules(min_length=5, min_count=2, ratio=2, damage=7)), (2, Rules(min_length=4, min_count=1, ratio=1, damage=0, broadcast_rows=0, most_bits=64))])
def test_groups_by_brute_force(spark, seed, rules):
    rows = misspelt(seed)
    if rules.ratio == 1:  # equally common words that are near would be each other's form
        rules = Rules(min_length=4, min_count=1, ratio=2, damage=0, broadcast_rows=0, most_bits=64)
    found = rows_of(spelling.group(spark.createDataFrame(rows, "doc_id long, text string"), rules))
    assert found == brute(rows, rules)
    assert sum(r[3] is not None for r in found) > 5 and any(r[5] not in (r[0], r[3]) for r in found)


def test_odd_documents(spark):
    rules = Rules(min_length=1, min_count=1)
    found = rows_of(spelling.group(documents(spark), rules))
    assert found == brute(documents(spark, plain=True), rules)
    assert max(len(r[0]) for r in found) == 30_000
    assert spelling.group(empty(spark)).count() == 0


def test_neighbourhood_is_whole_and_distinct():
    everything = spelling.Filter(np.full(64, 0xFFFFFFFFFFFFFFFF, np.uint64))
    letters = "abcé"
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)
    words = ["aabca", "ééééé", "abcéa", "bbbbb"]
    rows = np.array([list(map(ord, w)) for w in words], "<u4")
    found = {w: [] for w in words}
    for row, out in spelling.neighbourhood(rows, alphabet, everything):
        for k, points in zip(row, out, strict=True):
            found[words[k]].append("".join(map(chr, points)))
    for w in words:
        expected = {w[:i] + w[i + 1 :] for i in range(5)} | {w[:i] + c + w[i + 1 :] for i in range(5) for c in letters} | {w[:i] + c + w[i:] for i in range(6) for c in letters}
        assert sorted(found[w]) == sorted(expected - {w})


def test_blocks_and_hashes(spark, monkeypatch):
    """Words over several blocks of letters give the same; the hash of a candidate is that of its text."""
    rows = misspelt(3)
    rules = Rules(min_length=5, min_count=2, ratio=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = rows_of(spelling.group(docs, rules))
    words = [r[0] for r in whole]
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
    known = spelling.build_filter(spark.createDataFrame([(w,) for w in words], "word string"), 32 * len(words))
    monkeypatch.setattr(spelling, "BLOCK", 16)
    for w in words:
        got = []
        for _, out in spelling.neighbourhood(np.array([list(map(ord, w))], "<u4"), alphabet, known):
            got += ["".join(map(chr, points)) for points in out]
        assert len(got) == len(set(got)) and {x for x in words if near(w, x)} <= set(got)


def test_a_common_word_is_no_hot_key(spark):
    docs = spark.createDataFrame([(i, "common " * 2000 + "comon rarely") for i in range(30)], "doc_id long, text string")
    found = rows_of(spelling.group(docs, Rules(min_length=5, damage=0)))
    assert found == [("common", 60_000, 1, None, None, "common"), ("comon", 30, 1, "common", 60_000, "common"), ("rarely", 30, 0, None, None, "rarely")]
