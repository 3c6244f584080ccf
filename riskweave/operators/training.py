"""Training sets of labelled messages, and an optional linear classifier."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FALSE, LABEL_MEANING, TRUE, VALIDATION_SHARE


def dataset(messages: DataFrame) -> DataFrame:
    """(content, nature, label): the first message of each content in (_file, _row) order, false or true ones only; label 1 is false.

    The first row is a minimum, not a window: equal contents combine before the shuffle.
    """
    chosen = messages.where(F.col("nature").isin(FALSE, TRUE)).groupBy("content").agg(F.min(F.struct("_file", "_row", "nature")).alias("first"))
    return chosen.select("content", F.col("first.nature").alias("nature"), (F.col("first.nature") == FALSE).cast("int").alias("label"))


def split(data: DataFrame, share: float = VALIDATION_SHARE) -> DataFrame:
    """Add part: `validation` for max(1, floor(n x share)) rows, `train` for the others, in the order of the contents' hashes.

    A hash bucket's count tells which buckets are wholly on one side; only the rows of the
    bucket at the border are ranked.
    """
    hashed = data.withColumn("_hash", F.sha1(F.col("content").cast("binary"))).withColumn("_bucket", F.substring("_hash", 1, 3))
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("n"))  # at most 4096 rows
    upto = sizes.select("_bucket", F.coalesce(F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "n", F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    want = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    sides = upto.select("_bucket", "before", want.alias("want"), F.when(F.col("before") + F.col("n") <= want, "validation").when(F.col("before") >= want, "train").alias("side"))
    joined = hashed.join(F.broadcast(sides), "_bucket")
    border = joined.where("side IS NULL").withColumn("_at", F.col("before") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", "content"))).withColumn("part", F.when(F.col("_at") <= F.col("want"), "validation").otherwise("train"))
    whole = joined.where("side IS NOT NULL").withColumn("part", F.col("side"))
    columns = [*data.columns, "part"]
    return whole.select(*columns).unionByName(border.select(*columns))


def label_counts(data: DataFrame) -> DataFrame:
    return data.agg(F.count("*").alias("total"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """(correct, total, accuracy) of columns label and prediction."""
    correct = F.count_if(F.col("label") == F.col("prediction"))
    return predictions.agg(correct.alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.col("correct") / F.greatest("total", F.lit(1)))


def best_so_far(epochs: DataFrame) -> DataFrame:
    """Add to (epoch, accuracy, ...) best, the best accuracy up to the epoch, and saved, whether the epoch reaches it. A row for each epoch."""
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return epochs.withColumn("best", F.greatest(F.lit(0.0), F.max("accuracy").over(before))).withColumn("saved", F.col("accuracy") >= F.col("best"))


def save(model, folder: str, samples: int, val_accuracy: float, trained_at: str, base_model: str = "logistic_regression") -> None:
    """Write a fitted model to folder/model and what it was trained on to folder/train_meta, one JSON record."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{folder}/model")
    meaning = F.create_map(F.lit("0"), F.lit(LABEL_MEANING[0]), F.lit("1"), F.lit(LABEL_MEANING[1]))
    meta = spark.range(1).select(F.lit(base_model).alias("base_model"), F.lit(samples).alias("samples"), F.round(F.lit(val_accuracy), 4).alias("val_accuracy"), meaning.alias("label_meaning"), F.lit(trained_at).alias("trained_at"))
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/train_meta")


def load(folder: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{folder}/model")


def fit_classifier(data: DataFrame, features: int = 1 << 16, iterations: int = 20):
    """A logistic regression over hashed words; its probability of label 1, times 100, is a risk score."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [RegexTokenizer(inputCol="content", outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="features"), LogisticRegression(maxIter=iterations)]
    return Pipeline(stages=stages).fit(data)


def classifier_scores(model, messages: DataFrame) -> DataFrame:
    """Add score (0 to 100) and reason."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    out = model.transform(messages).withColumn("score", p * 100).withColumn("reason", F.concat(F.lit("probability of a rumour "), F.format_number(p * 100, 2), F.lit("%, of none "), F.format_number((1 - p) * 100, 2), F.lit("%")))
    return out.select(*messages.columns, "score", "reason")


# ------------------------------------------------------------------ training by epochs

#: Hashed features; gradients and losses are added up as whole multiples of 1 / UNIT, so that their sums are the same in any order.
FEATURES, UNIT = 1 << 16, float(1 << 32)
_LOSS, _ROWS, _RIGHT = -1, -2, -3


class Epochs(NamedTuple):
    #: (epoch, loss, accuracy, best, saved) of each epoch.
    history: DataFrame
    weights: np.ndarray


def encoded(data: DataFrame, features: int = FEATURES) -> DataFrame:
    """(content, label, part, places): the hashed places of each content's distinct words; the last place is the bias."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    places = F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int")))
    return data.select("content", F.col("label").cast("int").alias("label"), "part", F.concat(places, F.array(F.lit(features))).alias("places"))


def _forward(batch, weights: np.ndarray):
    """For each row of a batch: where its places begin, the places, the label and the probability of label 1."""
    column = batch.column("places")
    ends = np.asarray(column.offsets)
    places, ends = column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]
    z = np.add.reduceat(weights[places], ends[:-1]) if len(places) else np.zeros(0)
    return ends, places, batch["label"].to_numpy(), 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(batches, weights: np.ndarray, gradients: bool):
    """Partial sums of a task: the gradient by place, loss, rows, right answers, in units."""
    total, loss, rows, right = np.zeros(len(weights), np.int64), 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, places, labels, p = _forward(batch, weights)
        if gradients:
            of_row = np.rint((p - labels) * UNIT).astype(np.int64)
            np.add.at(total, places, np.repeat(of_row, np.diff(ends)))
        loss += int(np.rint(-np.log(np.where(labels == 1, p, 1 - p)) * UNIT).astype(np.int64).sum())
        rows, right = rows + batch.num_rows, right + int(((p >= 0.5) == (labels == 1)).sum())
    at = np.flatnonzero(total)
    schema = pa.schema([("place", pa.int32()), ("sum", pa.int64())])
    yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), _LOSS, _ROWS, _RIGHT], pa.int32()), pa.array([*total[at].tolist(), loss, rows, right], pa.int64())], schema=schema)


def _summed(rows: DataFrame, weights: np.ndarray, gradients: bool) -> dict[int, int]:
    """The sums of all tasks: at most a row for each feature comes to the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    found = rows.select("label", "places").mapInArrow(lambda it: _sums(it, sent.value, gradients), "place int, sum long")
    return {r["place"]: r["sum"] for r in found.groupBy("place").agg(F.sum("sum").alias("sum")).where("sum <> 0").collect()}


def train_epochs(data: DataFrame, epochs: int = 3, batches: int = 4, rate: float = 4.0, features: int = FEATURES, folder: str | None = None) -> Epochs:
    """Logistic regression by mini-batch gradient steps over (content, label, part).

    Each epoch deals the training rows anew into `batches`, by hashes of epoch and content. A
    step broadcasts the weights, one number a feature, and adds up the tasks' partial gradients.
    An epoch's loss is the running mean over its steps; then the validation rows (the training
    rows, if there are none) give the accuracy. Weights that reach the best accuracy so far are
    the result, and saved to `folder`, if given. Sums are of whole units: the same data give the same
    weights, whatever the partitions. `data` should be stored or cheap, it is read once a step.
    """
    spark = data.sparkSession
    rows = encoded(data, features)
    train, held = rows.where("part = 'train'"), rows.where("part = 'validation'")
    held = train if held.isEmpty() else held
    weights, best, kept, out = np.zeros(features + 1), 0.0, np.zeros(features + 1), []
    for epoch in range(1, epochs + 1):
        loss = n = 0
        for b in range(batches):
            dealt = train.where(F.pmod(F.xxhash64(F.lit(epoch), "content"), F.lit(batches)) == b)
            sums = _summed(dealt, weights, True)
            if not (size := sums.get(_ROWS, 0)):
                continue
            step = np.zeros(features + 1)
            for place, total in sums.items():
                if place >= 0:
                    step[place] = total / UNIT / size
            weights = weights - rate * step
            loss, n = loss + sums.get(_LOSS, 0), n + size
        sums = _summed(held, weights, False)
        accuracy_ = sums.get(_RIGHT, 0) / max(1, sums.get(_ROWS, 0))
        if accuracy_ >= best:
            best, kept = accuracy_, weights
            if folder:
                table = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights) if w], "place int, weight double")  # a row for each feature
                table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/weights")
        out.append((epoch, loss / UNIT / max(1, n), accuracy_))
    return Epochs(best_so_far(spark.createDataFrame(out, "epoch int, loss double, accuracy double")), kept)
