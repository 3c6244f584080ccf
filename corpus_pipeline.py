"""The corpus pipeline: language ID, near duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import langid, near_dup, packing, substring
from riskweave.llm.common import cut, new_folder, parted, written
from riskweave.llm.queries import CAPACITY, END_ID

#: Margin under which a language is uncertain: the best dictionary saves less than this share of the second best's bytes.
LEAST_MARGIN = 0.002
#: Similarity, in percent of five-word shingles, from which documents are near duplicates.
SIMILAR = 80


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, changed where `docs` has a column of the same name, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, null texts among them, and those whose language is uncertain. Learns from the stage's own labelled rows.

    Rows count one by one, whatever their doc_id; repeated rows stay or go together. Texts
    of any length are read whole; further columns, whatever their names, stay with their rows.
    An empty table, like one without labelled rows, gives an empty one.
    """
    return langid.accepted(docs, langid.fit(docs), LEAST_MARGIN)


def keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """`docs` with a key column, the key's name, and whether the key tells rows apart: doc_id, if every row has its own; or a number of each doc_id and text, in order of doc_id, none last."""
    key, id_, digest, n = fresh(docs, "_document", "_id", "_digest", "_n")
    number = F.col("doc_id").cast("long")
    if docs.select(number.alias(id_)).groupBy(id_).agg(F.count("*").alias(n)).where((F.col(n) > 1) | F.col(id_).isNull()).isEmpty():
        return docs.withColumn(key, number), key, True
    of_text = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    ids = docs.select(F.col("doc_id").alias(id_), of_text.alias(digest)).distinct()
    order = [F.col(id_).cast("long").asc_nulls_last(), F.col(id_).asc_nulls_last(), F.col(digest)]
    ids = cut(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (of_text == F.col(digest))
    return docs.join(ids, same).drop(id_, digest), key, False


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each near-duplicate group, one without doc_id only if the group has none.

    Rows with the same doc_id are documents of their own; of those with the same text
    too, the least row stays. Rows without doc_id are compared like all others. Null and empty
    texts are like nothing else and stay, each once for its doc_id. Texts of any length are
    compared whole. Further columns, whatever their names and types, stay with their rows; of
    rows that differ only in maps, any one stays. An empty table stays empty.
    """
    rows, key, unique = keyed(docs)
    kept = near_dup.near_duplicates(rows, doc_id=key, percent=SIMILAR).where("kept").select(F.col("doc_id").alias(key))
    columns = [column(c) for c in docs.columns]
    if unique:
        return rows.join(kept, key, "left_semi").select(*columns)
    ordered = F.struct(*(column(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    return rows.join(kept.distinct(), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), ordered).alias("row")).select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages. Texts that lose nothing stay as they are; a text that loses every word goes.

    Rows with the same doc_id are cut each by its own text; rows with the same text too
    stay as often as they are. Rows without doc_id are cut like all others, after them. Null
    and empty texts lose nothing and stay. Texts of any length are read whole. Further columns,
    whatever their names, stay with their rows. An empty table stays empty.
    """
    rows, key, unique = keyed(docs)
    rest = fresh(rows, "_rest")[0]
    cuts = substring.remove_repeats(rows, doc_id=key, losing=True).select(F.col("doc_id").alias(key), F.col("text").alias(rest))
    cuts, _ = written(cuts, "cuts", "zstd")
    some, others = parted(rows, key, cuts)
    joined = some.join(cuts if unique else cuts.dropDuplicates([key]), key, "left").where(F.col(rest).isNull() | (F.col(rest) != ""))
    text = F.coalesce(F.col(rest), F.col("text"))
    length = lambda c: F.when(F.col(rest).isNull(), column(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType)
    joined = joined.select(*(text.alias(c) if c == "text" else length(c).alias(c) if c == "n_chars" else column(c) for c in docs.columns))
    return joined.union(others.select(*(column(c) for c in docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack into sequences; the last stage, one row for each piece.

    Rows are documents of their own, whatever their doc_id; null and empty texts are one
    piece of the end id. Texts longer than a sequence are cut into pieces; further columns,
    whatever their names, are not read. An empty table gives an empty one.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("pack", pack)]

#: No stage but the repeats can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(folder := new_folder(spark, name))
            docs = spark.read.parquet(folder)
    return docs
