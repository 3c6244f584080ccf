"""BM25 search over documents or over a written index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, words
from ..schema import B, K1, SEARCH_LIMIT
from .index import KEY, idf, stored_meta, tokenized, with_mean
from .segments import Index

#: Blocks that are scored before others, wave by wave; longest list of hits that is searched for in waves; by how much rounding can raise a score.
WAVES, MOST_BY_WAVES, SLACK = (64, 1024), 1000, 2e-6


def query_terms(spark: SparkSession, query: str, tokenizer: Tokenizer = words) -> list[str]:
    """The distinct terms of a query, by the index's own tokenizer; repeats don't weigh more."""
    return spark.range(1).select(F.array_distinct(tokenizer(F.lit(query))).alias("t")).first()["t"]


def weight(idf_: Column, tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """A term's part of a document's score; null where the denominator is 0."""
    return idf_ * tf * (k1 + 1) / F.nullif(tf + k1 * (1 - b + b * length / avgdl), F.lit(0.0))


def scores(docs: DataFrame, terms: list[str], key: tuple[str, ...] = KEY, tokenizer: Tokenizer = words) -> DataFrame:
    """(key, score) of every document with a query term; a row is a document.

    One pass over the texts gives the statistics of all documents and the number of
    documents with each term, another the counts of the terms in each row, in place. Scores
    are sums within a row, so only a row for each document that matches leaves its task.
    A collection that is searched more than once should have an index.
    """
    tokens = tokenized(docs, key, tokenizer)
    has = [F.count_if(F.array_contains("tokens", F.lit(t))).alias(f"_{k}") for k, t in enumerate(terms)]
    stats = tokens.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("total_length"), *has)
    stats = with_mean(stats).where("avgdl > 0").drop("total_length")
    count = lambda t: F.size(F.filter("tokens", lambda x: x == t)).cast("long")
    found = tokens.where(F.arrays_overlap("tokens", F.array(*map(F.lit, terms)).cast("array<string>"))).select(*key, F.size("tokens").cast("long").alias("length"), F.array(*map(count, terms)).cast("array<bigint>").alias("tfs"))
    both = found.crossJoin(F.broadcast(stats))  # one row
    part = [F.when(F.col("tfs")[k] > 0, weight(idf(F.col("doc_count"), F.col(f"_{k}")), F.col("tfs")[k], F.col("length"), F.col("avgdl"))).otherwise(0.0) for k in range(len(terms))]
    score = part[0] if part else F.lit(0.0)
    for p in part[1:]:
        score = score + p
    return both.select(*key, score.alias("score"))


def _statistics(index: Index, terms: list[str]) -> tuple[dict[str, int], int, float]:
    """Document frequencies of the terms that occur, number of documents, mean length: a row for each term of the query."""
    df = {r["term"]: r["df"] for r in index.terms(F.col("term").isin(terms)).collect()} if terms else {}
    meta = stored_meta(index.stats()).first()
    return df, meta["doc_count"], meta["avgdl"]


def _part(df: dict[str, int], doc_count: int, avgdl: float, tf: Column, length: Column) -> Column:
    """The weight of column term for a count and a length."""
    of_term = F.coalesce(*(F.when(F.col("term") == t, idf(F.lit(doc_count), F.lit(n))) for t, n in df.items()))
    return weight(of_term, tf, length, F.lit(avgdl))


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "_file string, _row long, score double")


def _of_blocks(index: Index, blocks: DataFrame, df: dict[str, int], doc_count: int, avgdl: float) -> DataFrame:
    rows = index.postings(blocks)
    return rows.groupBy(*KEY).agg(F.sum(_part(df, doc_count, avgdl, F.col("tf"), F.col("length"))).alias("score"))


def indexed_scores(index: Index, terms: list[str]) -> DataFrame:
    """As `scores`, over a stored index: every posting of the terms. No text is read, nothing is joined but tombstones."""
    df, doc_count, avgdl = _statistics(index, terms)
    if not df or not avgdl:
        return _nothing(index.spark)
    return _of_blocks(index, index.blocks(list(df)), df, doc_count, avgdl)


class Top(NamedTuple):
    """The best messages, and how many blocks of rows have a term of the query and how many of them were scored."""

    hits: DataFrame
    blocks: int
    scored: int


def best_of_index(index: Index, terms: list[str], limit: int = SEARCH_LIMIT, waves: tuple[int, ...] = WAVES) -> Top:
    """The `limit` best messages by upper bounds of blocks.

    The greatest count and the least length of a term in a block bound its weight there, so
    the bounds of all terms bound the score of every row of the block. The blocks with the
    highest bounds are scored first, in waves; a block whose bound is below the last of the
    best scores found is skipped, and its postings are not read into a score. What is left then is scored in
    one go. The waves' blocks, a bounded number, and `limit` rows go through the driver.
    """
    spark, nothing = index.spark, _nothing(index.spark)
    df, doc_count, avgdl = _statistics(index, terms)
    if limit < 1 or not df or not avgdl:
        return Top(nothing, 0, 0)
    blocks, place = index.blocks(list(df)), ["_part", "_file", "_block"]
    bounds = blocks.groupBy(*place).agg(F.sum(_part(df, doc_count, avgdl, F.col("max_tf"), F.col("min_length"))).alias("bound"))
    total = bounds.count()
    if limit > MOST_BY_WAVES or total <= waves[0]:
        return Top(top(_of_blocks(index, blocks, df, doc_count, avgdl), limit), total, total)
    found, done, least = nothing, [], float("-inf")
    for size in waves:
        left = bounds.where(F.col("bound") >= least)
        if done:
            left = left.join(F.broadcast(spark.createDataFrame(done, "_part int, _file string, _block long")), place, "left_anti")  # the waves' blocks
        wave = [tuple(r)[:3] for r in left.orderBy(F.desc("bound"), *place).limit(size).collect()]
        if not wave:
            return Top(found, total, len(done))
        chosen = F.broadcast(spark.createDataFrame(wave, "_part int, _file string, _block long"))
        rows = top(found.unionByName(_of_blocks(index, blocks.join(chosen, place, "left_semi"), df, doc_count, avgdl)), limit).collect()
        done += wave
        found = spark.createDataFrame([tuple(r) for r in rows], nothing.schema)
        if len(rows) == limit:
            least = rows[-1]["score"] - SLACK
    left = bounds.where(F.col("bound") >= least).join(F.broadcast(spark.createDataFrame(done, "_part int, _file string, _block long")), place, "left_anti").select(*place)
    more = left.count()
    if not more:
        return Top(top(found, limit), total, len(done))
    rest = _of_blocks(index, blocks.join(left, place, "left_semi"), df, doc_count, avgdl)
    return Top(top(found.unionByName(top(rest, limit)), limit), total, len(done) + more)


def search_index(index: Index, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The keys and scores of the best messages of an index; none of an empty one."""
    return best_of_index(index, query_terms(index.spark, query, index.tokenizer), limit).hits


def top(scored: DataFrame, limit: int = SEARCH_LIMIT, key: tuple[str, ...] = KEY) -> DataFrame:
    """The best documents, ties by key; rounded first, so that the order doesn't hang on the order of additions."""
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), *key).limit(max(0, limit))


def search(messages: DataFrame, query: str, limit: int = SEARCH_LIMIT, tokenizer: Tokenizer = words) -> DataFrame:
    """The best messages with their scores; rows are fetched after the limit."""
    hits = top(scores(messages, query_terms(messages.sparkSession, query, tokenizer), tokenizer=tokenizer), limit)
    return messages.join(F.broadcast(hits), list(KEY))
