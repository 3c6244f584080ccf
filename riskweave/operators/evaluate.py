"""Scores against human labels: confusion counts, metrics, threshold sweep, squared error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import number, strip
from ..schema import FALSE, LABELLED, NEUTRAL, SWEEP, THRESHOLD, TRUE


def eligible(messages: DataFrame) -> DataFrame:
    """Rows with a score and a human label: the row's columns, nature stripped, prob (null if the score is no number)."""
    score = strip(F.col("fake_probability"))
    return messages.withColumn("nature", strip(F.col("nature"))).where((score != "") & F.col("nature").isin(*LABELLED)).withColumn("prob", number(score))


def samples(messages: DataFrame) -> DataFrame:
    return eligible(messages).where("prob IS NOT NULL").select("prob", "nature")


def _positive(threshold: Column) -> Column:
    return ~F.isnan("prob") & (F.col("prob") >= threshold)


def confusion(samples_: DataFrame, thresholds: tuple[float, ...] = (THRESHOLD,)) -> DataFrame:
    """(threshold, tp, fp, tn, fn), one pass over the samples for all thresholds."""
    false, true = F.col("nature") == FALSE, F.col("nature") == TRUE
    counts = []
    for k, t in enumerate(thresholds):
        over = _positive(F.lit(float(t)))
        counts += [F.count_if(c).alias(f"{n}{k}") for n, c in (("tp", false & over), ("fp", true & over), ("tn", true & ~over), ("fn", false & ~over))]
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "tn", "fn"))) for k, t in enumerate(thresholds)))
    return samples_.agg(*counts).select(F.inline(rows))


def metrics(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"total": tp + fp + tn + fn, "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sweep(samples_: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    return metrics(confusion(samples_, thresholds))


def squared_error(samples_: DataFrame) -> DataFrame:
    """One row: mse over all labelled samples (neutral is one half), count."""
    truth = F.when(F.col("nature") == FALSE, 1.0).when(F.col("nature") == TRUE, 0.0).when(F.col("nature") == NEUTRAL, 0.5)
    return samples_.agg(F.coalesce(F.avg(F.pow(F.col("prob") / 100.0 - truth, 2)), F.lit(0.0)).alias("mse"), F.count(truth).alias("count"))


def label_counts(messages: DataFrame) -> DataFrame:
    ok = F.col("prob").isNotNull()
    return eligible(messages).agg(*(F.count_if(ok & (F.col("nature") == n)).alias(c) for n, c in ((FALSE, "positive"), (TRUE, "negative"), (NEUTRAL, "neutral"))), F.count_if(~ok).alias("invalid"))
