"""Hot terms: document frequency times idf, filtered and ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, words
from ..schema import HOT_LIMIT, HOT_MAX_DF_RATIO, HOT_MIN_DF, HOT_MIN_LENGTH, HOT_POS
from .index import idf, term_df


def heat(df: Column, idf_: Column) -> Column:
    return F.when(df > 0, idf_ * df).otherwise(0.0)


def hot_terms(
    docs: DataFrame, limit: int = HOT_LIMIT, min_df: int = HOT_MIN_DF, max_df_ratio: float = HOT_MAX_DF_RATIO, min_length: int = HOT_MIN_LENGTH, stop: DataFrame | None = None,
    pos: Callable[[Column], Column] | None = None, score: Callable[[Column, Column], Column] = heat, tokenizer: Tokenizer = words,
) -> DataFrame:
    """(term, df, idf, score), ties by term. `stop` has a column term; `pos` gives a term's part of speech."""
    meta = docs.agg(F.count("*").alias("doc_count"))
    found = term_df(docs, tokenizer).where((F.length("term") >= min_length) & (F.col("df") >= min_df)).crossJoin(F.broadcast(meta)).where(F.col("df") < max_df_ratio * F.col("doc_count"))
    if stop is not None:
        found = found.join(stop.select("term"), "term", "left_anti")
    if pos is not None:
        found = found.where(pos(F.col("term")).isin(*HOT_POS))
    scored = found.withColumn("idf", F.round(idf(F.col("doc_count"), F.col("df")), 6)).withColumn("score", F.round(score(F.col("df"), idf(F.col("doc_count"), F.col("df"))), 6))
    return scored.where("score > 0").select("term", "df", "idf", "score").orderBy(F.desc("score"), "term").limit(max(0, limit))


def weighted(hot: DataFrame) -> DataFrame:
    """Add weight 5 to 1: the score's share of the best score, in fifths. `hot` is a short list."""
    ratio = F.col("score") / F.nullif(F.max("score").over(Window.partitionBy(F.lit(1))), F.lit(0.0))
    step = F.when(ratio >= 0.8, 5).when(ratio >= 0.6, 4).when(ratio >= 0.4, 3).when(ratio >= 0.2, 2).otherwise(1)
    return hot.withColumn("weight", step)
