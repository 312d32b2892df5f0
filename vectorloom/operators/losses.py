"""Values of contrastive, ordinal, classification and distillation losses, as aggregates over batches.

Rows are joined within their batch only, so the work is the sum of the squares of the batches' sizes. Vectors
are taken as they are: normalise them first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.vectors import dot, prefix

TEMPERATURE, MARGIN, ALPHA, TINY = 0.02, 0.1, 9.0, 1e-12
#: Exponents that one state of ``log_sum_exp`` spans; far under 709, where doubles end.
SPAN = 256.0


def _pairs(rows: DataFrame) -> DataFrame:
    """Each row of a batch with every other one: batch, i, pos, and the other's vectors."""
    left = rows.select("batch", F.col("slot").alias("i"), F.col("q").alias("qi"), F.col("d").alias("di"), dot(F.col("q"), F.col("d")).alias("pos"))
    right = rows.select("batch", F.col("slot").alias("j"), F.col("q").alias("qj"), F.col("d").alias("dj"))
    return left.join(right, "batch").where("i <> j")


def pair_scores(rows: DataFrame) -> DataFrame:
    """batch, slot, pos and the inner products qd, qq, dd of each row (batch, slot, q, d) with every other one of its batch.

    Several losses of the same rows can share it, written as a table.
    """
    products = [dot(F.col(f"{a}i"), F.col(f"{b}j")).alias(a + b) for a, b in ("qd", "qq", "dd")]
    return _pairs(rows).select("batch", F.col("i").alias("slot"), "pos", *products)


def log_add(*logs: Column) -> Column:
    """Logarithm of the sum of numbers that are given by their logarithms; null stands for 0, and one must not be null."""
    top = F.greatest(*logs)
    return top + F.ln(reduce(lambda x, y: x + y, [F.coalesce(F.exp(x - top), F.lit(0.0)) for x in logs]))


def log_sum_exp(rows: DataFrame, keys: list[str], terms: list[Column], name: str) -> DataFrame:
    """``keys`` and the logarithm of the sum of exp(term) over a key's rows; null terms don't count, keys without any are left out.

    A row's state is the multiple of ``SPAN`` under its largest term and the sum of exponentials scaled by it. States with the
    same multiple are sums, so they merge before the shuffle and in any order; a key has as many as its terms span
    multiples, and those are put together at the end. So no exponential overflows, whatever the temperature.
    """
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    floor = F.floor(top / SPAN).cast("double")
    scaled = reduce(lambda x, y: x + y, [F.coalesce(F.exp(t - floor * SPAN), F.lit(0.0)) for t in terms])
    states = rows.where(top.isNotNull()).groupBy(*keys, floor.alias("_f")).agg(F.sum(scaled).alias("_s"))
    merged = states.groupBy(*keys).agg(F.max("_f").alias("_top"), F.collect_list(F.struct("_f", "_s")).alias("_x"))
    total = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x["_s"] * F.exp((x["_f"] - F.col("_top")) * SPAN))
    return merged.select(*keys, (F.col("_top") * SPAN + F.ln(total)).alias(name))


def infonce_rows(rows: DataFrame, stage: int = 1, negatives: DataFrame | None = None, temperature: float = TEMPERATURE, margin: float = MARGIN, alpha: float | None = None, scores: DataFrame | None = None) -> DataFrame:
    """batch, slot, loss of each row (batch, slot, q, d); ``scores`` are its ``pair_scores``, if they are there already.

    A negative counts unless its score is over the row's positive score plus ``margin``; with ``alpha`` all count,
    and each is weighted by exp(alpha * score). Stage 1 takes other queries and documents of the batch against
    both sides, stage 2 only its documents against the query. ``negatives`` (batch, slot, n) are the row's own;
    a negative given twice counts twice.
    """

    at_most = margin / temperature if alpha is None else float("inf")
    pos = F.col("pos") / temperature

    def term(score: Column) -> Column:
        """The exponent of a negative, null if it doesn't count."""
        if alpha is not None:
            return score / temperature + alpha * score
        return F.when(score <= F.col("pos") + margin, score / temperature)

    def summed(scored: DataFrame, terms: list[Column]) -> DataFrame:
        """batch, slot, lse: the logarithm of the sum of the terms' exponentials."""
        keys = ["batch", "slot"]
        if at_most > SPAN:
            return log_sum_exp(scored, keys, terms, "lse")
        # no term is over the row's own score by more than that, so one sum shifted by it is enough
        shifted = reduce(lambda x, y: x + y, [F.coalesce(F.exp(t - pos), F.lit(0.0)) for t in terms])
        return scored.groupBy(*keys).agg(F.sum(shifted).alias("_s"), F.first("pos").alias("_p")).select(*keys, F.when(F.col("_s") > 0, F.ln("_s") + F.col("_p") / temperature).alias("lse"))

    both = pair_scores(rows) if scores is None else scores
    terms = [term(F.col(c)) for c in (("qd", "qq", "dd") if stage == 1 else ("qd",))]
    own = rows.select("batch", "slot", dot(F.col("q"), F.col("d")).alias("pos"), "q")
    whole = own.join(summed(both, terms).withColumnRenamed("lse", "_in"), ["batch", "slot"], "left")
    parts = [pos, F.col("_in"), F.lit(math.log(TINY))]
    if negatives is not None:
        hard = own.join(negatives.select("batch", "slot", "n"), ["batch", "slot"])
        whole = whole.join(summed(hard, [term(dot(F.col("q"), F.col("n")))]).withColumnRenamed("lse", "_hard"), ["batch", "slot"], "left")
        parts.append(F.col("_hard"))
    return whole.select("batch", "slot", (log_add(*parts) - pos).alias("loss"))


def mean_by_batch(losses: DataFrame, digits: int = 6) -> DataFrame:
    return losses.groupBy("batch").agg(F.round(F.avg("loss"), digits).alias("loss"))


def cosent(rows: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """batch, loss of rows (batch, slot, a, b, score): 0 for a batch in which no two scores differ."""
    own = rows.select("batch", "slot", "score", (dot(F.col("a"), F.col("b")) / temperature).alias("c"))
    other = own.select("batch", F.col("score").alias("score2"), F.col("c").alias("c2"))
    sums = log_sum_exp(own.join(other, "batch").where("score2 > score"), ["batch"], [F.col("c") - F.col("c2")], "_s")
    return rows.select("batch").distinct().join(sums, "batch", "left").select("batch", log_add(F.lit(0.0), F.col("_s")).alias("loss"))


def classification_rows(rows: DataFrame, negatives: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """batch, slot, loss: cross-entropy of the positive label against the row's own wrong labels (batch, slot, n).

    A row without negatives has -ln(sigmoid(positive)). Exponents are shifted by the largest score.
    """
    own = rows.select("batch", "slot", "q", (dot(F.col("q"), F.col("d")) / temperature).alias("pos"))
    wrong = own.join(negatives.select("batch", "slot", "n"), ["batch", "slot"]).select("batch", "slot", (dot(F.col("q"), F.col("n")) / temperature).alias("s"))
    listed = wrong.groupBy("batch", "slot").agg(F.collect_list("s").alias("_s"))
    whole = own.join(listed, ["batch", "slot"], "left")
    top = F.greatest(F.col("pos"), F.array_max("_s"))
    total = F.exp(F.col("pos") - top) + F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    alone = -F.ln(1 / (1 + F.exp(-F.col("pos"))) + TINY)
    return whole.select("batch", "slot", F.when(F.col("_s").isNull(), alone).otherwise(top + F.ln(total) - F.col("pos")).alias("loss"))


def distill_kl(rows: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """batch, loss of rows (batch, slot, q, d, tq, td): KL of the student's row-wise softmax from the teacher's, a row's mean."""
    left = rows.select("batch", F.col("slot").alias("i"), F.col("q"), F.col("tq"))
    right = rows.select("batch", F.col("d"), F.col("td"))
    s = left.join(right, "batch").select("batch", "i", (dot(F.col("q"), F.col("d")) / temperature).alias("s"), (dot(F.col("tq"), F.col("td")) / temperature).alias("t"))
    listed = s.groupBy("batch", "i").agg(F.collect_list(F.struct("s", "t")).alias("x"), F.max("s").alias("ms"), F.max("t").alias("mt"))
    add = lambda name, top: F.aggregate("x", F.lit(0.0), lambda a, y: a + F.exp(y[name] - top))
    logs = listed.select("batch", "i", "x", (F.col("ms") + F.ln(add("s", F.col("ms")))).alias("ls"), (F.col("mt") + F.ln(add("t", F.col("mt")))).alias("lt"))
    each = F.aggregate("x", F.lit(0.0), lambda a, y: a + F.exp(y["t"] - F.col("lt")) * ((y["t"] - F.col("lt")) - (y["s"] - F.col("ls"))))
    return logs.select("batch", each.alias("k")).groupBy("batch").agg(F.avg("k").alias("loss"))


def vector_mse(rows: DataFrame, a: str, b: str) -> DataFrame:
    """batch, loss: mean squared difference over all components of the batch."""
    squares = F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy("batch").agg((F.sum(squares) / F.sum(F.size(a))).alias("loss"))


def over_dims(rows: DataFrame, loss, dims: list[int], vectors: list[str], negatives: DataFrame | None = None) -> DataFrame:
    """batch, loss: mean over ``dims`` of ``loss(rows, negatives)`` on prefixes of the vectors, normalised again."""
    parts = []
    for d in dims:
        cut = rows.select(*[prefix(F.col(c), d).alias(c) if c in vectors else F.col(c) for c in rows.columns])
        own = negatives.withColumn("n", prefix(F.col("n"), d)) if negatives is not None else None
        parts.append(loss(cut, own).select("batch", "loss"))
    return reduce(DataFrame.unionByName, parts).groupBy("batch").agg((F.sum("loss") / len(dims)).alias("loss"))


def distillation(rows: DataFrame, kl: float = 0.5, mse: float = 0.2, temperature: float = TEMPERATURE) -> DataFrame:
    """batch, loss: kl * KL + mse * (MSE of queries + MSE of documents)."""
    a = distill_kl(rows, temperature).withColumnRenamed("loss", "_kl")
    b = vector_mse(rows, "q", "tq").withColumnRenamed("loss", "_mq")
    c = vector_mse(rows, "d", "td").withColumnRenamed("loss", "_md")
    return a.join(b, "batch").join(c, "batch").select("batch", (kl * F.col("_kl") + mse * (F.col("_mq") + F.col("_md"))).alias("loss"))


def stage3(rows: DataFrame, contrastive: float = 0.3, kl: float = 0.5, mse: float = 0.2, temperature: float = TEMPERATURE) -> DataFrame:
    """batch, loss: contrastive * masked loss of stage 1 + distillation."""
    a = infonce_rows(rows.select("batch", "slot", "q", "d"), 1, temperature=temperature).groupBy("batch").agg(F.avg("loss").alias("_c"))
    b = distillation(rows, kl, mse, temperature)
    return a.join(b, "batch").select("batch", (contrastive * F.col("_c") + F.col("loss")).alias("loss"))


def routed(rows: DataFrame, negatives: DataFrame, wrong_labels: DataFrame, stage: int = 2, temperature: float = TEMPERATURE) -> DataFrame:
    """batch, loss, n_terms: rows (batch, slot, q, d, task_type, score) go to the loss of their task; the mean of the terms.

    sts rows go to ``cosent``. In stage 1 all others go to the masked loss; in stage 2 classification rows go to
    their wrong labels, and the rest to the masked loss of stage 2 with its hard negatives.
    """
    sts = cosent(rows.where("task_type = 'sts'").select("batch", "slot", F.col("q").alias("a"), F.col("d").alias("b"), "score"), temperature)
    if stage == 1:
        terms = [infonce_rows(rows.where("task_type <> 'sts'"), 1, temperature=temperature)]
    else:
        terms = [
            classification_rows(rows.where("task_type = 'classification'"), wrong_labels, temperature),
            infonce_rows(rows.where("task_type NOT IN ('sts', 'classification')"), 2, negatives, temperature),
        ]
    means = [t.groupBy("batch").agg(F.avg("loss").alias("loss")) for t in terms]
    return reduce(DataFrame.unionByName, [*means, sts]).groupBy("batch").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_terms"))


def symmetric_infonce(rows: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """batch, loss: mean of the plain in-batch losses of queries against documents and the other way round."""
    turned = rows.select("batch", "slot", F.col("d").alias("q"), F.col("q").alias("d"))
    parts = [infonce_rows(x, 2, temperature=temperature, margin=float("inf")) for x in (rows.select("batch", "slot", "q", "d"), turned)]
    return parts[0].unionByName(parts[1]).groupBy("batch").agg(F.avg("loss").alias("loss"))


def weighted_sum(contrastive: DataFrame, language: DataFrame, weight: float) -> DataFrame:
    """batch, loss: a contrastive loss and ``weight`` times a language model's."""
    return contrastive.join(language.select("batch", F.col("loss").alias("_l")), "batch").select("batch", (F.col("loss") + weight * F.col("_l")).alias("loss"))


def _log_yes(yes: Column, no: Column) -> Column:
    """Logarithm of the probability of yes of two logits, without overflow."""
    z = yes - no
    return F.when(z < 0, z - F.log1p(F.exp(z))).otherwise(-F.log1p(F.exp(-z)))


def reranker_ce(rows: DataFrame) -> DataFrame:
    """batch, loss: mean cross entropy of the logits yes and no against label (1 or 0)."""
    yes, no = _log_yes(F.col("yes"), F.col("no")), _log_yes(F.col("no"), F.col("yes"))
    return rows.groupBy("batch").agg(F.avg(-F.when(F.col("label") == 1, yes).otherwise(no)).alias("loss"))


def reranker_distill(rows: DataFrame) -> DataFrame:
    """batch, loss: mean cross entropy of the logits yes and no against a teacher's probability of yes."""
    yes, no = _log_yes(F.col("yes"), F.col("no")), _log_yes(F.col("no"), F.col("yes"))
    return rows.groupBy("batch").agg(F.avg(-(F.col("teacher") * yes + (1 - F.col("teacher")) * no)).alias("loss"))
