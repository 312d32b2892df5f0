import numpy as np
import pytest

from tests.llm.fixtures import WORDS, documents, empty
from vectorloom.llm import minhash


def sets_of(rows, n):
    out = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out.append((i, frozenset([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else []))))
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                parent[root(a)] = root(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if root(j) == root(k) and sets[j][0] is not None]
        least = (min(ids) if ids else None) if s else i
        out.append((i, len(s), least, least == i))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("words", "percent", "bands", "rows"), [(3, 85, 30, 5), (5, 80, 40, 4)])
def test_components_by_brute_force(spark, words, percent, bands, rows):
    found = minhash.near_duplicates(documents(spark), minhash.Rules(words=words, percent=percent, bands=bands, rows=rows))
    assert got(found) == sorted(brute(documents(spark, plain=True), words, percent), key=repr)


def test_groups_of_near_copies(spark):
    r = np.random.default_rng(5)
    rows, at = [], 0
    for size in (40, 12, 3):
        base = [WORDS[i] + str(r.integers(50)) for i in r.integers(0, len(WORDS), 120)]
        for _ in range(size):
            copy = list(base)
            for k in r.choice(120, r.integers(0, 7), replace=False):
                copy[k] = f"w{r.integers(10**6)}"
            rows.append((at, " ".join(copy)))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hubs in ((1, 8), (1, 32), (1,)):
        found = minhash.near_duplicates(df, minhash.Rules(words=3, percent=85, bands=30, rows=5, hubs=hubs, broadcast_rows=0 if hubs == (1,) else 200_000))
        assert got(found) == sorted(brute(rows, 3, 85), key=repr)


def template_pages(n, seed=0, pool=20, slots=14):
    """Pages that share a template and fill its slots from a small pool of values, pairwise under the threshold but for a few."""
    r = np.random.default_rng(seed)
    words = [f"fixed{i}" for i in range(100)]
    rows = []
    for i in range(n):
        page = list(words)
        for k in range(slots):
            page[7 * k] = f"value{k}x{r.integers(pool)}"
        rows.append((i, " ".join(page)))
        if i % 25 == 24:  # a near copy of another page
            page[7 * (i % slots)] = "another"
            rows.append((1000 + i, " ".join(page)))
    return rows


def test_template_pages_are_not_compared_with_all_others(spark, monkeypatch):
    """Far fewer comparisons than pairs, fewer for each pair as the pages grow, and components are those of brute force."""
    counts, compare = [], minhash.compare

    def counted(pairs, *more, **names):
        counts[-1] += pairs.count()
        return compare(pairs, *more, **names)

    monkeypatch.setattr(minhash, "compare", counted)
    for n in (100, 200, 400):
        rows = template_pages(n)
        counts.append(0)
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Rules(words=3, percent=85, bands=30, rows=5))
        got_rows = got(found)
        if n < 400:
            assert got_rows == sorted(brute(rows, 3, 85), key=repr)
    pairs = [n * (n - 1) / 2 for n in (104, 208, 416)]
    share = [c / p for c, p in zip(counts, pairs, strict=True)]
    assert share[2] < 0.25 and share[2] < share[1], counts


def test_a_class_has_one_rest_for_its_family(spark, monkeypatch):
    """Buckets of one template have one top, so rests are as many as classes and not as classes times buckets."""
    counts, bands = [], minhash.rest_bands

    def counted(rests, rules):
        counts.append((rests.count(), rests.select("node").distinct().count()))
        return bands(rests, rules)

    monkeypatch.setattr(minhash, "rest_bands", counted)
    rows = template_pages(200, pool=200, slots=11)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Rules(words=3, percent=85, bands=30, rows=5))
    assert got(found) == sorted(brute(rows, 3, 85), key=repr)
    ((rests, classes),) = counts
    assert classes > 20 and rests <= 1.1 * classes, counts


def test_ids_beside_a_null(spark):
    big = 1 << 60
    rows = [(big + 1, "a b c d e f"), (big + 2, "a b c d e f"), (None, "x y z"), (None, None), (big + 3, "")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), minhash.Rules(words=3, percent=85))
    assert got(found) == sorted(brute(rows, 3, 85), key=repr)


def test_empty_tables(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.keep_first(empty(spark)).count() == 0
    docs = documents(spark)
    assert minhash.keep_first(docs).columns == docs.columns


def test_signatures_do_not_depend_on_the_early_stop():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 2, 7, 60, 400, 3000)]
    m = 40
    for s, fast in zip(sets, minhash.signatures(sets, m), strict=True):
        slow = np.full((1, m), np.inf)
        order = np.tile(np.arange(m, dtype=np.int16), (len(s), 1))
        for level in range(m):
            minhash._swap(order, s, level, m)
            minhash._level(slow, np.zeros(len(s), int), s, level, m, order[:, level])
        assert (slow[0] == fast).all()


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    common, a, b = (r.integers(0, 1 << 62, n).astype(np.uint64) for n in (600, 200, 200))
    x, y = minhash.signatures([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))], 2000)
    assert abs((x == y).mean() - 0.6) < 0.05


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long").repartition(7)
    for rows in (200_000, 0):
        found = {r.node: r.component for r in minhash.components(edges, rows).collect()}
        assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_mixed_buckets_are_looked_up_again_only_after_links(spark, monkeypatch):
    nodes = 12
    sets = spark.createDataFrame([(i, [100 * i + k for k in range(50)] + list(range(-50, 0))) for i in range(nodes)], "node long, shingles array<long>")
    active = spark.createDataFrame([(7, nodes, i, 100, 100, nodes) for i in range(nodes)], "key long, size long, node long, n long, m long, w long")
    linker, calls, mixed = minhash.Linker(sets, minhash.Rules()), [], minhash.Linker.mixed
    monkeypatch.setattr(minhash.Linker, "mixed", lambda self, *a: calls.append(1) or mixed(self, *a))
    assert sorted(r.node for r in linker.resolve(active).collect()) == list(range(nodes))
    assert len(calls) == 2  # at first, and when there are components; no link is found
    near = active.withColumn("far", active["node"] != 3)
    assert mixed(linker, near, ~near["far"]).count() == nodes
    assert mixed(linker, near.where("far"), ~near["far"]).isEmpty()
