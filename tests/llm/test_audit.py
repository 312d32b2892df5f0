"""The audit of filters by brute force: every order is applied to every document."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tests.llm.fixtures import documents, empty, prose
from vectorloom.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The filters that each row of doc_id, text, source fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        bad["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    bad, out, shapley = fails(rows), {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, bad, strict=True) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                all_failing = [x for x in own if f in x[1]]
                shapley[part, f] += len(removed)
                out[part, order, k + 1] = (len(left), len(removed), len(all_failing) - len(removed), sum(x[1] == {f} for x in own), sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed))
    return sorted((p, o, k, *v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items())


def rows_of(found):
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in found.collect())


def odd_rows():
    r = random.Random(3)
    texts = [prose(1, 60), prose(2, 70).upper(), prose(3, 55) + " #", "short", "", None, " \n", " ".join(f"w{i}" for i in range(80)), "É" * 80 + " " + " ".join(f"x{i}" for i in range(60)) + " ABCDEF", "A&B"]
    rows = [(r.choice([None, *range(40), 1 << 60]), r.choice(texts), r.choice([None, "", "a", "b"])) for _ in range(150)]
    return rows + rows[:5]


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_audit_by_brute_force(spark, parts):
    rows = odd_rows()
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, None), (4, None, None), (None, 1, 1), (999, 1, 1), (1 << 60, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS fp", "3 AS least", "4 AS part", "5 AS n")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = rows_of(audit.interactions(docs, spark.createDataFrame(labels, LABELS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == brute(rows, labels)


def test_a_text_over_many_parts(spark):
    """One text that most rows hold is spread over all parts, and only its least doc_id stays."""
    rows = [(i, "the same text", "s") for i in range(400)] + [(1000 + i, f"text {i % 70}", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        masks = audit.failures(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(masks) == 600
    assert sorted(r.doc_id for r in masks if not r["mask"] & audit.DUPLICATE) == [0, *range(1000, 1070)]


def test_texts_that_share_a_fingerprint(spark):
    """Runs are told apart by their texts: with one fingerprint for all, edges carry each text that reaches them."""
    import pyarrow as pa

    rows = [("a", 1), ("a", 5), ("b", None), ("b", 2), ("b", 2), ("b", 3), ("c", None), ("d", 9)]
    frames = [pa.record_batch({"doc_id": pa.array([i for _, i in part], pa.int64()), "part": ["s"] * len(part), "text": [t for t, _ in part], "fp": pa.array([7] * len(part), pa.int64())}) for part in (rows[:3], rows[3:6], rows[6:])]
    *batches, edges = audit._compared(0, iter(frames))
    got = [(r["doc_id"], bool(r["mask"] & audit.DUPLICATE)) for b in batches for r in b.to_pylist()]
    assert got == [(1, False), (5, True), (None, False), (2, False), (2, False), (3, True), (None, False), (9, False)]
    assert [(r["edge_text"], r["least"]) for r in edges.to_pylist()] == [("a", 1), ("b", 2), ("c", None), ("d", 9)]


def test_fixture_and_empty(spark):
    rows = [(i, t, "s") for i, t in documents(spark, plain=True)]
    assert rows_of(audit.interactions(documents(spark), spark.createDataFrame([], LABELS))) == brute(rows, [])
    assert audit.interactions(empty(spark), spark.createDataFrame([], LABELS)).count() == 0
