"""Reply trees, search and compaction."""

import hashlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import ann, chat, compaction


def test_paths_of_a_tree(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b </s> [x] & &lt;", 5.0), ("t", 4, 3, "user", None, 2.0), ("t", 5, 2, "user", "z", 0.0), ("u", 1, 9, None, "lost parent", None)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    found = {(r.tree, r.leaf): r for r in chat.format_paths(m, best=2).collect()}
    assert {k: (r["rank"], r.n_turns) for k, r in found.items()} == {("t", 4): (1, 3), ("t", 5): (2, 3), ("u", 1): (1, 1)}
    best = chat.format_paths(m, best=1)
    assert {(r.tree, r.leaf) for r in best.collect()} == {("t", 4), ("u", 1)}
    read = best.select("tree", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {r.tree: r for r in read}
    assert [tuple(t) for t in by["t"].turns] == [("user", "q"), ("assistant", "b </s> [x] & &lt;"), ("user", "")]
    assert by["t"].loss == "b </s> [x] & &lt;" and by["u"].loss == "" and [tuple(t) for t in by["u"].turns] == [("", "lost parent")]


SCHEMA = "tree string, node long, parent long, role string, text string, score double"


def test_repeated_messages_and_cycles(spark):
    once = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 2, "user", "z", 0.0)]
    ring = [("c", i, (i + 1) % 5, "user", "x", 1.0) for i in range(5)] + [("c", 10, 3, "user", "below the ring", 9.0), ("c", 11, 10, "user", "leaf", 9.0), ("c", 20, None, "user", "alone", 0.0)]
    pair = [("p", 1, 2, "user", "x", 1.0), ("p", 2, 1, "user", "y", 1.0), ("s", 1, 1, "user", "itself", 0.0)]
    deep = [("d", i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", "w " * (5000 if i == 7 else 1), 0.0) for i in range(70)]
    m = spark.createDataFrame(once * 3 + ring + pair + deep, SCHEMA).withColumn("leaf", F.lit(0)).withColumn("up", F.lit(0))
    found = {(r.tree, r.leaf): r for r in chat.format_paths(m, best=5).collect()}
    assert {k: r.n_turns for k, r in found.items()} == {("t", 3): 3, ("c", 20): 1, ("d", 69): 70}
    paths = sorted((r.leaf, r.up, r.node) for r in chat.ancestors(m.where("tree = 'd'").select("tree", "node", "parent")).collect())
    assert paths == [(69, k, 69 - k) for k in range(70)]
    assert "w " * 5000 in found["d", 69].formatted
    differing = spark.createDataFrame([("t", 1, None, "user", "b", 2.0), ("t", 1, None, "user", "a", 3.0)], SCHEMA)
    assert [(r.n_turns, r.score, "a</s>" in r.formatted) for r in chat.format_paths(differing).collect()] == [(1, 2.0, True)]

    # a turn is one that somebody wrote, and no text of a branch that isn't chosen is grouped
    mixed = spark.createDataFrame([("t", 1, None, "assistant", "zzz", 0.0), ("t", 1, None, "user", "zz", 0.0), ("u", 1, None, None, "b", 0.0), ("u", 1, None, "user", "a", 0.0)], SCHEMA)
    read = chat.format_paths(mixed).select("tree", chat.parse(F.col("formatted")).alias("turns")).collect()
    assert {r.tree: [tuple(t) for t in r.turns] for r in read} == {"t": [("assistant", "zzz")], "u": [("", "b")]}
    plan = chat.format_paths(mixed)._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("min(named_struct") if "min(named_struct" in plan else plan.index("min(struct") :]
    assert "LeftSemi" in grouped


def test_conversations_by_turn(spark):
    rows = [(1, 0, "user", "a\n</s>\n<s>[x] "), (1, 1, "assistant", "b" * 9), (1, 1, "assistant", "b" * 9), (2, 0, None, None), (None, 5, "assistant", "é")] + [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("tree", F.lit("x"))
    found = {r.conv_id: r for r in chat.digests(chat.format_paths(chat.messages_of(turns))).collect()}
    for c in (1, 2, None, 3):
        own = [(r, t) for i, _, r, t in rows if i == c]
        whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in own)
        loss = "".join(t or "" for r, t in own if r == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_paths(chat.messages_of(turns.limit(0))).count() == 0


def test_search(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 24)) * r.uniform(0.5, 2, (1500, 1))
    x[700:1100] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0, 2.0]), (5080, [None] * 24), (None, x[0].tolist()), (20, x[20].tolist())] + [(40, x[40].tolist())] * 50
    v = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit(1)), "vec_id", "embedding")
    with pytest.warns(UserWarning, match="1 vectors of another length"):
        found = ann.search(v, v.where(F.col("vec_id") % 20 == 0), k=20, plan=ann.Plan(block=300, small_task=400, query_bytes=40 * 24 * 8)).collect()
    by = {}
    for f in sorted(found, key=lambda f: f["rank"]):
        by.setdefault(f.query_id, []).append((f.vec_id, f.score))
    assert set(by) == set(range(0, 1500, 20))
    hit = 0
    for q, got in by.items():
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        hit += len({i for i, _ in got} & set(order))
        assert all(score == s[i] for i, score in got) and len(got) == 20
    assert hit / (20 * len(by)) >= 0.97
    assert ann.search(v.limit(0), v.limit(0)).count() == 0
    assert ann.search(v.where("vec_id < 3"), v.where("vec_id = 0")).count() == 2
    big = 1 << 60
    ids = [(big + i, [float(i), 1.0]) for i in range(5)]
    names = ann.valid(spark.createDataFrame([*ids, (None, [1.0, 1.0])], "vec_id long, v array<double>"), "vec_id", "v")
    assert [(r.query_id, r.vec_id) for r in ann.search(names, names.where(F.col("vec_id") == big), k=2).orderBy("rank").collect()] == [(big, big + 1), (big, big + 2)]


def test_recall_where_few_rows_are_ranked_exactly():
    """One block of 8,000 rows: under a twentieth of all pairs is ranked exactly, and still 0.9 of the nearest are found."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 64))
    x = centres[r.integers(0, 40, 8000)] + 0.7 * r.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, ids = x[::40], np.arange(8000)
    quantiser = ann.fit(x[:4000], ann.Plan())
    scan = ann.Scan(quantiser, ids[::40], q, 20, ann.Plan())
    scan.rows(ids, x, ann.packed(quantiser.assign(x)))
    assert scan.ranked < 0.05 * scan.pairs
    hit = sum(len(set(scan.ids[i].tolist()) & {j for j in np.argsort(-(x @ v))[:21] if j != 40 * i}) for i, v in enumerate(q))
    assert hit >= 0.9 * 20 * len(q)


def test_compaction(spark, tmp_path):
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "x").alias("text"))
    for k in range(9):
        store.append(rows.where(F.col("doc_id") % 9 == k))
    before = store.manifest()
    assert before[0] == 9 and len(before[1]) == 9
    last = store.compact(compaction.Tiers(merge_runs=4))
    assert len(store.manifest()[1]) < 4
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(store.read()) == key(rows) == key(store.read(9))
    with pytest.raises(compaction.CommitConflict):
        store.commit(last - 1, [])
    assert store.vacuum() > 0 and key(store.read()) == key(rows)
    assert store.versions() == [last]


def test_two_writers(spark, tmp_path):
    """Of writers that commit the same version at the same time one succeeds, and its manifest is the one that is read."""
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    store.append(spark.range(3).select(F.col("id").alias("doc_id")))

    def commit(k, version):
        try:
            return k, compaction.Store(spark, store.path).commit(version, [compaction.Run(f"r{k}", k, k)])
        except compaction.CommitConflict:
            return k, None

    for version in range(1, 6):
        with ThreadPoolExecutor(8) as pool:
            got = list(pool.map(commit, range(8), [version] * 8))
        won = [k for k, v in got if v is not None]
        assert len(won) == 1 and store.manifest()[1][0].name == f"r{won[0]}"
    assert not [f for f in (tmp_path / "store" / "manifest").iterdir() if not f.name.endswith((".json", ".crc"))]


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")
    for _ in range(4):
        store.append(rows)
    store.compact(compaction.Tiers(merge_runs=4))
    store.vacuum(keep_versions=2)
    assert [store.read(v).count() for v in store.versions()] == [12, 12]


def test_files_of_a_target_size(spark, tmp_path):
    store = compaction.Store(spark, f"file://{tmp_path}/s")
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"))
    got = compaction.ingest(rows, store, "id", 4, compaction.Tiers(target_bytes=100_000, least_bytes=1 << 20))
    runs = store.manifest()[1]
    assert len(runs) == 1 and 3 <= len(runs[0].files) <= 8 and got.count() == 4000
    nothing = compaction.ingest(rows.limit(0), compaction.Store(spark, f"file://{tmp_path}/e"), "id", 2, compaction.Tiers())
    assert nothing.count() == 0


def test_odd_rows_of_a_store(spark, tmp_path):
    """Null keys, repeated rows, columns in another order, and columns that the table doesn't have."""
    rows = spark.createDataFrame([(None, "a" * 100_000), (None, None), (1, ""), (1, ""), (1 << 60, "b")], "doc_id long, text string").withColumn("name", F.lit("x"))
    store = compaction.Store(spark, f"file://{tmp_path}/s")
    got = compaction.ingest(rows, store, "doc_id", 3, compaction.Tiers(merge_runs=2))
    key = lambda df: sorted((r.doc_id, r.text, r.name) for r in df.fillna(-1, ["doc_id"]).fillna("", ["text"]).collect())
    assert key(got) == key(rows)
    store.append(rows.select("name", "text", "doc_id"))
    assert key(store.read()) == sorted(key(rows) * 2)
    for other in (rows.drop("name"), rows.withColumn("more", F.lit(1)), rows.withColumn("doc_id", F.col("doc_id").cast("string"))):
        with pytest.raises(ValueError):
            store.append(other)
    assert store.read().count() == 10
