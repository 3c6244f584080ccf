"""Several models' scores combined by equal votes, with the mean as fallback.

Members of one message are an array column, so votes need no shuffle; `tally` does the same
counts over a long table, where members come as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import label, level, valid_score
from ..functions.values import strip
from ..schema import MESSAGE_LIMIT, RUN_FAILED, RUN_INVALID

#: Sentences that users see.
UNAVAILABLE, BAD_SCORE, BAD_REASON = "该模型当前不可用，请检查本地服务和模型权重", "模型返回了无效的风险分数", "模型未返回有效的风险说明"
FAILED = "模型检测失败，请稍后重试"
CLOSING = "语言风险不代表事实真假，模型一致也不等于事实已被核实。"


def request_error(message: Column, models: Column, known: list[str] | None = None) -> Column:
    """Why a request is refused, null if it isn't: blank, too_long, no_list, duplicate, unknown_model, empty."""
    text = strip(F.coalesce(message, F.lit("")))
    unknown = F.exists(models, lambda m: ~m.isin(known)) if known else F.lit(False)
    return (
        F.when(text == "", "blank").when(F.length(text) > MESSAGE_LIMIT, "too_long").when(models.isNull(), "no_list")
        .when(F.size(F.array_distinct(models)) < F.size(models), "duplicate").when(F.size(models) == 0, "empty").when(unknown, "unknown_model")
    )


def member(output: Column, told: Column | None = None) -> Column:
    """A member record of a model output (ordinal, model_id, available, score, reason); `told` is the text of an error at run time, if there was one."""
    score, reason = valid_score(output["score"]), strip(F.coalesce(output["reason"], F.lit("")))
    told = F.lit(None).cast("string") if told is None else told
    ok = output["available"] & told.isNull() & score.isNotNull() & (reason != "")
    kept = F.when(ok, score)
    said = F.when(strip(told).isin("", RUN_FAILED), FAILED).when(told == RUN_INVALID, BAD_SCORE).otherwise(strip(told))
    error = F.when(~output["available"], UNAVAILABLE).when(told.isNotNull(), said).when(score.isNull(), BAD_SCORE).when(reason == "", BAD_REASON)
    status = F.when(~output["available"], "unavailable").when(ok, "ok").otherwise("error")
    shown = F.when(~output["available"], "模型不可用").when(ok, label(level(kept))).otherwise("检测失败")
    return F.struct(output["ordinal"].alias("ordinal"), output["model_id"].alias("model_id"), status.alias("status"), kept.alias("score"), level(kept).alias("level"), shown.alias("label"), F.when(ok, reason).otherwise("").alias("reason"), error.alias("error"))


def members(outputs: DataFrame, column: str = "outputs") -> DataFrame:
    """Replace the outputs by an array of member records; outputs may have a further field `error`, as `models.run` gives it."""
    fields = outputs.schema[column].dataType.elementType.names
    one = lambda o: member(o, o["error"] if "error" in fields else None)
    return outputs.withColumn("members", F.transform(column, one)).drop(column)


def selected(requests: DataFrame, registry: DataFrame, models: str = "models") -> DataFrame:
    """Requests with the models they select, in order: `selected`, an array of (ordinal, model_id, display_name, available).

    The registry (model_id, display_name, available) is a short table and is joined once;
    an id that it hasn't is unavailable and shown by its id.
    """
    known = registry.agg(F.map_from_entries(F.collect_list(F.struct("model_id", F.struct("display_name", "available")))).alias("_known"))  # one row
    one = lambda m, k: F.struct(k.alias("ordinal"), m.alias("model_id"), F.coalesce(F.col("_known")[m]["display_name"], m).alias("display_name"), F.coalesce(F.col("_known")[m]["available"], F.lit(False)).alias("available"))
    return requests.crossJoin(F.broadcast(known)).withColumn("selected", F.transform(models, one)).drop("_known")


def available_count(registry: DataFrame) -> DataFrame:
    """One row: models and how many of them are available."""
    return registry.agg(F.count("*").alias("models"), F.count_if("available").alias("available"))


def elapsed(started: Column, ended: Column) -> Column:
    """Seconds between two timestamps, to three places."""
    return F.round((F.unix_micros(ended) - F.unix_micros(started)) / 1_000_000, 3)


def _decide(df: DataFrame) -> DataFrame:
    """From low, medium, high, selected and mean to the decision; counts are per message."""
    low, medium, high, n, ok = (F.col(c) for c in ("low", "medium", "high", "selected_count", "success_count"))
    df = df.withColumn("agreement_count", F.greatest(low, medium, high)).withColumn("majority_required", F.when(n == 1, F.lit(1).cast("long")).otherwise(F.floor(n / 2) + 1))
    need, agree = F.col("majority_required"), F.col("agreement_count")
    method = F.when((n == 1) & (ok > 0), "single").when((n > 1) & (agree >= need) & (ok >= need), "majority").when(ok > 0, "mean_fallback").otherwise("unavailable")
    winner = F.when((low >= medium) & (low >= high), "low").when(medium >= high, "medium").otherwise("high")
    df = df.withColumn("decision_method", method).withColumn("mode", F.when(n == 1, "single").otherwise("vote"))
    mean = F.when(F.col("decision_method") == "mean_fallback", F.col("mean"))
    df = df.withColumn("level", F.when(F.col("decision_method").isin("single", "majority"), winner).when(F.col("decision_method") == "mean_fallback", level(mean)).otherwise("uncertain")).withColumn("mean_score", mean)
    return df.withColumn("label", label(F.col("level"))).withColumn("has_failures", ok < n).drop("mean")


def vote(df: DataFrame, column: str = "members") -> DataFrame:
    """Add the decision to rows with an array of members."""
    ok = F.filter(column, lambda m: m["status"] == "ok")
    count = lambda name: F.size(F.filter(F.col("_ok"), lambda m: m["level"] == name)).cast("long")
    total = F.aggregate("_ok", F.lit(0).cast("decimal(38,18)"), lambda a, m: (a + m["score"].cast("decimal(38,18)")).cast("decimal(38,18)"))
    counted = df.withColumn("_ok", ok).withColumns({"low": count("low"), "medium": count("medium"), "high": count("high"), "success_count": F.size("_ok").cast("long"), "selected_count": F.size(column).cast("long"), "mean": total.cast("double") / F.nullif(F.size("_ok"), F.lit(0))})
    return _decide(counted.drop("_ok"))


def tally(members_: DataFrame, key: str) -> DataFrame:
    """The decision for each `key` of a long table of members (status, score, level)."""
    ok = F.col("status") == "ok"
    counts = members_.groupBy(key).agg(
        *(F.count_if(ok & (F.col("level") == n)).alias(n) for n in ("low", "medium", "high")), F.count_if(ok).alias("success_count"), F.count("*").alias("selected_count"),
        F.count_if(~ok).alias("failed_count"), F.avg(F.when(ok, F.col("score").cast("decimal(30,15)"))).cast("double").alias("mean"),
    )
    return _decide(counts)


def texts(decided: DataFrame) -> DataFrame:
    """Add fallback_reason and warning."""
    ok, n, need = (F.col(c).cast("string") for c in ("success_count", "selected_count", "majority_required"))
    fallback = F.col("decision_method") == "mean_fallback"
    reason = F.when(fallback & (F.col("success_count") < F.col("majority_required")), F.concat(F.lit("有效票不足（"), ok, F.lit("/"), n, F.lit("），未达到 "), need, F.lit(" 票的多数门槛"))).when(fallback, "票数分歧，未形成多数风险等级").otherwise("")
    df = decided.withColumn("fallback_reason", reason)
    warning = (
        F.when(F.col("decision_method") == "unavailable", "本次检测没有获得有效风险分数，无法判断。")
        .when(fallback, F.concat("fallback_reason", F.lit("；已降级采用 "), ok, F.lit(" 个有效模型风险分的算术平均值，结果为"), "label", F.lit("。")))
        .otherwise(F.concat(F.when(F.col("decision_method") == "majority", "多数投票").otherwise("单模型检测"), F.lit("结果为"), "label", F.lit("。")))
    )
    return df.withColumn("warning", F.concat(warning, F.lit(CLOSING)))
