from collections import defaultdict

from tests.llm.fixtures import documents, empty
from vectorloom.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].add(i)
    owner = {k: max(h, key=lambda i: (i is not None, i or 0)) for k, h in holders.items() if len(h) >= 3}
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in owner or owner[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def test_lines_by_brute_force(spark):
    for most in (200_000, 0):  # broadcast, and not
        found = lines.drop_lines(documents(spark), broadcast_rows=most)
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()]
        expected = brute(documents(spark, plain=True))
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(x[2] for x in expected) > 3
    assert found.columns[: len(documents(spark).columns)] == documents(spark).columns
    assert lines.drop_lines(empty(spark)).count() == 0


def test_columns_stay(spark):
    docs = documents(spark)
    kept = lines.without_frequent_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in kept.collect())


def test_rows_of_a_document_count_once(spark):
    line = "this line is in some of the documents"
    two = [(1, line), (1, f"{line}\nmore"), (2, line), (None, "x")]
    three = [(1, line), (1, line), (2, f"a\n{line.upper()} "), (1 << 60, line), (None, line), (None, f"{line}\n{line}")]
    for rows in (two, three):
        found = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()]
        assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert sum(x[2] for x in brute(two)) == 0 and sum(x[2] for x in brute(three)) == 6
