"""Queries of the losses' values, per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.tables import materialise
from vectorloom.operators import losses as L
from vectorloom.plans.catalogue import register
from vectorloom.plans.fixtures import SQL_BATCHES, SQL_PAIRS, SQL_SCORES, SQL_VECTORS, batches, vectors

BASE = f"{SQL_VECTORS}, {SQL_SCORES}, {SQL_PAIRS}, {SQL_BATCHES}"
T = 0.02


def rows(spark: SparkSession, d: str) -> DataFrame:
    return materialise(batches(vectors(spark, d)), "batches")


def own_negatives(b: DataFrame, k: int = 3) -> DataFrame:
    """batch, slot, n: the queries of the next ``k`` slots stand for a row's own negatives."""
    other = b.select("batch", F.col("slot").alias("_s"), F.col("q").alias("n"))
    steps = b.select("batch", "slot", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_k")).select("batch", "slot", ((F.col("slot") + F.col("_k")) % 32).alias("_s"))
    return steps.join(other, ["batch", "_s"]).select("batch", "slot", "n")


SQL_OWN = "own AS (SELECT a.batch, a.slot, c.q AS n FROM b a, range(1, 4) t(k) JOIN b c ON c.batch = a.batch AND c.slot = (a.slot + k) % 32)"


def _infonce(stage: int, hard: bool = False, alpha: float | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        b = rows(spark, d)
        return L.mean_by_batch(L.infonce_rows(b.select("batch", "slot", "q", "d"), stage, own_negatives(b) if hard else None, alpha=alpha))

    return run


def _sql_loss(stage: int, hard: bool = False, alpha: float | None = None, source: str = "b", own: str = "own") -> str:
    """A table of row losses in SQL."""

    def term(x: str) -> str:
        return f"exp({x} / {T} + {alpha} * {x})" if alpha is not None else f"CASE WHEN {x} <= p.pos + 0.1 THEN exp({x} / {T}) ELSE 0 END"

    more = f" + {term('list_inner_product(i.q, j.q)')} + {term('list_inner_product(i.d, j.d)')}" if stage == 1 else ""
    own_sum = f"+ coalesce((SELECT sum({term('list_inner_product(p.q, o.n)')}) FROM {own} o WHERE o.batch = p.batch AND o.slot = p.slot), 0)" if hard else ""
    return f"""(
        WITH p AS (SELECT batch, slot, q, list_inner_product(q, d) AS pos FROM {source}),
        z AS (SELECT i.batch, i.slot, sum({term('list_inner_product(i.q, j.d)')}{more}) AS z FROM {source} i JOIN {source} j ON i.batch = j.batch AND i.slot <> j.slot
              JOIN p ON p.batch = i.batch AND p.slot = i.slot GROUP BY ALL)
        SELECT p.batch, p.slot, -ln(exp(pos / {T}) / (exp(pos / {T}) + z.z {own_sum} + 1e-12)) AS loss FROM p JOIN z ON z.batch = p.batch AND z.slot = p.slot)"""


def _by_batch(loss: str) -> str:
    return f"SELECT batch, round(avg(loss), 6) AS loss FROM {loss} GROUP BY batch"


register("infonce_stage1", _infonce(1), f"WITH {BASE} {_by_batch(_sql_loss(1))}")
register("infonce_stage2", _infonce(2), f"WITH {BASE} {_by_batch(_sql_loss(2))}")
register("infonce_hn", _infonce(2, hard=True), f"WITH {BASE}, {SQL_OWN} {_by_batch(_sql_loss(2, hard=True))}")
register("infonce_hardness", _infonce(1, alpha=9.0), f"WITH {BASE} {_by_batch(_sql_loss(1, alpha=9.0))}")

DIMS = (64, 32, 16)


def mrl_infonce(spark: SparkSession, d: str) -> DataFrame:
    b = rows(spark, d).select("batch", "slot", "q", "d")
    one = lambda r, _: L.infonce_rows(r, 1).groupBy("batch").agg(F.avg("loss").alias("loss"))
    return L.over_dims(b, one, list(DIMS), ["q", "d"]).select("batch", F.round("loss", 6).alias("loss"))


def _unit(v: str, k: int) -> str:
    return f"list_transform({v}[1:{k}], lambda x: x / greatest(sqrt(list_inner_product({v}[1:{k}], {v}[1:{k}])), 1e-12))"


_PREFIXES = ", ".join(f"b{k} AS (SELECT batch, slot, {_unit('q', k)} AS q, {_unit('d', k)} AS d FROM b)" for k in DIMS)
register(
    "mrl_infonce",
    mrl_infonce,
    f"WITH {BASE}, {_PREFIXES}, m AS ({' UNION ALL '.join(f'SELECT batch, avg(loss) AS loss FROM {_sql_loss(1, source=f"b{k}")} GROUP BY batch' for k in DIMS)}) SELECT batch, round(avg(loss), 6) AS loss FROM m GROUP BY batch",
)


def _scored(b: DataFrame) -> DataFrame:
    return b.withColumn("score", ((F.col("batch") * 32 + F.col("slot")) * 7) % 11 / 2.0)


def cosent(spark: SparkSession, d: str) -> DataFrame:
    b = _scored(rows(spark, d)).select("batch", "slot", F.col("q").alias("a"), F.col("d").alias("b"), "score")
    return L.cosent(b).select("batch", F.round("loss", 6).alias("loss"))


SQL_COSENT = f"""(WITH c AS (SELECT batch, ((batch * 32 + slot) * 7) % 11 / 2.0 AS score, list_inner_product(q, d) / {T} AS c FROM {{source}})
    SELECT x.batch, ln(1 + sum(exp(x.c - y.c))) AS loss FROM c x JOIN c y ON x.batch = y.batch AND y.score > x.score GROUP BY x.batch)"""
register("cosent", cosent, f"WITH {BASE} SELECT batch, round(loss, 6) AS loss FROM {SQL_COSENT.format(source='b')}")


def wrong_labels(b: DataFrame) -> DataFrame:
    """batch, slot, n: prototypes (the first vector of a label in a batch) of other labels; slots 0 mod 8 have none."""
    proto = b.groupBy("batch", "label").agg(F.min_by("q", "slot").alias("n")).withColumnRenamed("label", "_l")
    return b.select("batch", "slot", "label").where("slot % 8 <> 0").join(proto, "batch").where("_l <> label").select("batch", "slot", "n")


SQL_WRONG = "proto AS (SELECT batch, label, arg_min(q, slot) AS n FROM b GROUP BY batch, label), wrong AS (SELECT b.batch, b.slot, n FROM b JOIN proto ON proto.batch = b.batch AND proto.label <> b.label WHERE slot % 8 <> 0)"


def classification_ce(spark: SparkSession, d: str) -> DataFrame:
    b = rows(spark, d)
    return L.mean_by_batch(L.classification_rows(b, wrong_labels(b)))


def _sql_class(where: str = "true") -> str:
    return f"""(SELECT b.batch, b.slot, CASE WHEN count(n) = 0 THEN -ln(1 / (1 + exp(-any_value(pos))) + 1e-12)
            ELSE -ln(exp(any_value(pos)) / (exp(any_value(pos)) + sum(exp(list_inner_product(q, n) / {T})))) END AS loss
        FROM (SELECT *, list_inner_product(q, d) / {T} AS pos FROM b WHERE {where}) b LEFT JOIN wrong ON wrong.batch = b.batch AND wrong.slot = b.slot GROUP BY b.batch, b.slot)"""


register("classification_ce", classification_ce, f"WITH {BASE}, {SQL_WRONG} {_by_batch(_sql_class())}")


def _taught(b: DataFrame) -> DataFrame:
    return b.select("batch", "slot", "q", "d", F.reverse("q").alias("tq"), F.reverse("d").alias("td"))


SQL_KL = f"""(WITH k AS (SELECT i.batch, i.slot AS i, list_inner_product(i.q, j.d) / {T} AS s, list_inner_product(i.q, list_concat(j.d[2:], j.d[:1])) / {T} AS t FROM tb i JOIN tb j ON i.batch = j.batch),
    x AS (SELECT *, ln(sum(exp(s)) OVER w) AS ls, ln(sum(exp(t)) OVER w) AS lt FROM k WINDOW w AS (PARTITION BY batch, i))
    SELECT batch, sum(exp(t - lt) * ((t - lt) - (s - ls))) / count(DISTINCT i) AS loss FROM x GROUP BY batch)"""
def _rotated(b: DataFrame) -> DataFrame:
    """The teacher's documents are the student's, moved by one component."""
    return b.select("batch", "slot", "q", "d", F.col("q").alias("tq"), F.concat(F.slice("d", 2, 1 << 20), F.slice("d", 1, 1)).alias("td"))


def distill_kl(spark: SparkSession, d: str) -> DataFrame:
    return L.distill_kl(_rotated(rows(spark, d))).select("batch", F.round("loss", 6).alias("loss"))


register("distill_kl", distill_kl, f"WITH {BASE}, tb AS (SELECT * FROM b) SELECT batch, round(loss, 6) AS loss FROM {SQL_KL}")


def vector_mse(spark: SparkSession, d: str) -> DataFrame:
    return L.vector_mse(_taught(rows(spark, d)), "q", "tq").select("batch", F.round("loss", 9).alias("loss"))


_SQUARES = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
register("vector_mse", vector_mse, f"WITH {BASE} SELECT batch, round(sum({_SQUARES.format(a='q', b='list_reverse(q)')}) / (count(*) * 64), 9) AS loss FROM b GROUP BY batch")


def stage3_loss(spark: SparkSession, d: str) -> DataFrame:
    return L.stage3(_rotated(rows(spark, d))).select("batch", F.round("loss", 6).alias("loss"))


register(
    "stage3_loss",
    stage3_loss,
    f"""WITH {BASE}, tb AS (SELECT * FROM b), k AS {SQL_KL}, c AS (SELECT batch, avg(loss) AS loss FROM {_sql_loss(1)} GROUP BY batch),
        m AS (SELECT batch, sum({_SQUARES.format(a='d', b='list_concat(d[2:], d[:1])')}) / (count(*) * 64) AS loss FROM b GROUP BY batch)
        SELECT c.batch, round(0.3 * c.loss + 0.5 * k.loss + 0.2 * m.loss, 6) AS loss FROM c JOIN k ON k.batch = c.batch JOIN m ON m.batch = c.batch""",
)


def _kinds(b: DataFrame) -> DataFrame:
    kind = F.when(F.col("slot") % 4 == 0, "sts").when(F.col("slot") % 4 == 1, "classification").otherwise("retrieval")
    return _scored(b).withColumn("task_type", kind)


def loss_routing(spark: SparkSession, d: str) -> DataFrame:
    b = rows(spark, d)
    return L.routed(_kinds(b), own_negatives(b), wrong_labels(b)).select("batch", F.round("loss", 6).alias("loss"), "n_terms")


register(
    "loss_routing",
    loss_routing,
    f"""WITH {BASE}, {SQL_OWN}, {SQL_WRONG}, r AS (SELECT * FROM b WHERE slot % 4 > 1), st AS (SELECT * FROM b WHERE slot % 4 = 0),
        t AS (SELECT batch, avg(loss) AS loss FROM {_sql_class('slot % 4 = 1')} GROUP BY batch
              UNION ALL SELECT batch, avg(loss) FROM {_sql_loss(2, hard=True, source='r')} GROUP BY batch
              UNION ALL SELECT batch, loss FROM {SQL_COSENT.format(source='st')})
        SELECT batch, round(avg(loss), 6) AS loss, count(*) AS n_terms FROM t GROUP BY batch""",
)


def symmetric_infonce(spark: SparkSession, d: str) -> DataFrame:
    return L.symmetric_infonce(rows(spark, d)).select("batch", F.round("loss", 6).alias("loss"))


register(
    "symmetric_infonce",
    symmetric_infonce,
    f"""WITH {BASE}, k AS (SELECT i.batch, i.slot AS i, j.slot AS j, exp(list_inner_product(i.q, j.d) / {T}) AS x FROM b i JOIN b j ON i.batch = j.batch),
        f AS (SELECT batch, i, -ln(max(x) FILTER (WHERE i = j) / (sum(x) + 1e-12)) AS loss FROM k GROUP BY batch, i), g AS (SELECT batch, j, -ln(max(x) FILTER (WHERE i = j) / (sum(x) + 1e-12)) AS loss FROM k GROUP BY batch, j)
        SELECT batch, round(avg(loss), 6) AS loss FROM (SELECT batch, loss FROM f UNION ALL SELECT batch, loss FROM g) GROUP BY batch""",
)


def _long_vectors(b: DataFrame) -> DataFrame:
    """Vectors of length 7, so that scores reach 49 and their exponents 2,450, over what a double can hold."""
    return b.withColumns({c: F.transform(c, lambda x: x * 7) for c in ("q", "d")})


SQL_LONG = "long AS (SELECT batch, slot, label, list_transform(q, lambda x: x * 7) AS q, list_transform(d, lambda x: x * 7) AS d FROM b)"


def infonce_large_scores(spark: SparkSession, d: str) -> DataFrame:
    """Losses of long vectors: all negatives count, with weights and without, or those under the margin."""
    b = materialise(_long_vectors(rows(spark, d)).select("batch", "slot", "q", "d"), "long")
    scores = materialise(L.pair_scores(b), "scores")  # the products once for all three
    found = {"all": L.infonce_rows(b, 1, margin=float("inf"), scores=scores), "weighted": L.infonce_rows(b, 2, alpha=L.ALPHA, scores=scores), "masked": L.infonce_rows(b, 1, scores=scores)}
    out = None
    for kind, loss in found.items():
        one = L.mean_by_batch(loss, 5).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def _sql_exponents(kind: str, term: str, stage: int) -> str:
    scores = ["list_inner_product(i.q, j.d)"] + ["list_inner_product(i.q, j.q)", "list_inner_product(i.d, j.d)"] * (stage == 1)
    pairs = " UNION ALL ".join(f"SELECT i.batch, i.slot, list_inner_product(i.q, i.d) AS pos, {s} AS s FROM long i JOIN long j ON i.batch = j.batch AND i.slot <> j.slot" for s in scores)
    return f"SELECT '{kind}' AS kind, batch, slot, pos, {term} AS x FROM ({pairs})"


register(
    "infonce_large_scores",
    infonce_large_scores,
    f"""WITH {BASE}, {SQL_LONG},
        x AS ({_sql_exponents('all', f's / {T}', 1)} UNION ALL {_sql_exponents('weighted', f's / {T} + 9 * s', 2)} UNION ALL {_sql_exponents('masked', f'CASE WHEN s <= pos + 0.1 THEN s / {T} END', 1)}),
        own AS (SELECT DISTINCT kind, batch, slot, pos FROM x),
        y AS (SELECT kind, batch, slot, x FROM x UNION ALL SELECT kind, batch, slot, pos / {T} FROM own UNION ALL SELECT kind, batch, slot, ln(1e-12) FROM own),
        m AS (SELECT kind, batch, slot, max(x) AS top FROM y GROUP BY ALL),
        l AS (SELECT kind, batch, slot, any_value(top) + ln(sum(exp(x - top))) AS z FROM y JOIN m USING (kind, batch, slot) GROUP BY ALL)
        SELECT kind, batch, round(avg(z - pos / {T}), 5) AS loss FROM l JOIN own USING (kind, batch, slot) GROUP BY kind, batch""",
)


def cosent_large_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ordinal loss of long vectors, with the label as the score."""
    b = _long_vectors(rows(spark, d)).select("batch", "slot", F.col("q").alias("a"), F.col("d").alias("b"), F.col("label").cast("double").alias("score"))
    return L.cosent(b).select("batch", F.round("loss", 5).alias("loss"))


register(
    "cosent_large_scores",
    cosent_large_scores,
    f"""WITH {BASE}, {SQL_LONG},
        c AS (SELECT batch, label, list_inner_product(q, d) / {T} AS c FROM long),
        x AS (SELECT i.batch, i.c - j.c AS x FROM c i JOIN c j ON i.batch = j.batch AND j.label > i.label UNION ALL SELECT DISTINCT batch, 0 FROM c),
        m AS (SELECT batch, max(x) AS top FROM x GROUP BY batch)
        SELECT batch, round(any_value(top) + ln(sum(exp(x - top))), 5) AS loss FROM x JOIN m USING (batch) GROUP BY batch""",
)
