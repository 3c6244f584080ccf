"""Model replies: strip reasoning, find the JSON object, check it strictly."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import strip
from ..schema import REASON_LIMIT

#: Fixed value: the mark some servers leave at the end of a reasoning block.
END_OF_THINKING = "<｜end▁of▁thinking｜>"


def cleaned(reply: Column) -> Column:
    """Without reasoning blocks, and only what follows the last end mark."""
    return F.element_at(F.split(F.regexp_replace(reply, r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", ""), F.lit(END_OF_THINKING.replace("|", "\\|"))), -1)


def json_object(text: Column) -> Column:
    """From the first brace to the last one, or the whole text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text)


def chat_content(response: Column) -> Column:
    return F.coalesce(F.get_json_object(response, "$.message.content"), F.lit(""))


def prompt(template: str, message: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{message}"), message)


def acceptable(reply: str) -> bool:
    """The rules of `checked` for one reply, for a client that is to be asked again at once."""
    text = re.sub(r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", "", reply).split(END_OF_THINKING)[-1]
    found = re.search(r"(?s)\{.*\}", text)
    try:
        pairs = json.loads(found[0] if found else text, object_pairs_hook=list, parse_constant=lambda _: None)
        (_, reason), (_, score) = sorted(pairs) if sorted(k for k, _ in pairs) == ["reason", "risk_score"] else ()
    except (ValueError, TypeError):
        return False
    number = isinstance(score, int | float) and not isinstance(score, bool) and 0 <= score <= 100
    return number and isinstance(reason, str) and reason.strip() != "" and len(reason) <= REASON_LIMIT


def checked(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Add score, reason and ok: an object of exactly risk_score (a number from 0 to 100) and reason (text that isn't blank, at most 2000 characters)."""
    text = json_object(cleaned(F.col(column)))
    v = replies.withColumn("_v", F.try_parse_json(text)).withColumn("_kind", F.schema_of_variant("_v")).withColumn("_object", F.col("_kind").startswith("OBJECT"))
    v = v.withColumn("_keys", F.when(F.col("_object"), F.array_sort(F.json_object_keys(text))))
    exact = F.col("_keys") == F.array(F.lit("reason"), F.lit("risk_score"))
    v = v.withColumn("_score", F.when(exact, F.try_variant_get("_v", "$.risk_score", "variant"))).withColumn("_reason", F.when(exact, F.try_variant_get("_v", "$.reason", "variant")))
    number = F.schema_of_variant("_score").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    score = F.when(number, F.try_variant_get("_score", "$", "double"))
    raw = F.when(F.schema_of_variant("_reason") == "STRING", F.try_variant_get("_reason", "$", "string"))
    good = F.coalesce(score.between(0, 100) & (strip(raw) != "") & (F.length(raw) <= REASON_LIMIT), F.lit(False))
    return v.withColumn("ok", good).withColumn("score", F.when(F.col("ok"), score)).withColumn("reason", F.when(F.col("ok"), strip(raw))).drop("_v", "_kind", "_object", "_keys", "_score", "_reason")
