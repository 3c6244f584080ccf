"""The inverted index as tables: postings, document lengths, term statistics, manifest.

`docs` is any table with key columns and `content`; the key defaults to (_file, _row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, words
from ..schema import INDEX_VERSION

KEY = ("_file", "_row")
#: Rows or nodes whose digests are joined together, and levels of nodes above the rows' ranges.
DIGESTED, LEVELS = 64, 4


def tokenized(docs: DataFrame, key: tuple[str, ...] = KEY, tokenizer: Tokenizer = words) -> DataFrame:
    """(key, tokens). The tokens pass through a generator, so that no later use of them tokenizes the text again."""
    return docs.select(*key, F.explode(F.array(tokenizer(F.col("content")))).alias("tokens"))


def doc_lengths(docs: DataFrame, key: tuple[str, ...] = KEY, tokenizer: Tokenizer = words) -> DataFrame:
    """Tokens of each document, repeats included; 0 for an empty one. Needs no shuffle."""
    return tokenized(docs, key, tokenizer).select(*key, F.size("tokens").cast("long").alias("length"))


def runs(rows: DataFrame, tokens: str, *more: str) -> DataFrame:
    """(more, _sorted, _runs): the sorted tokens of each row, and from and to where each distinct one stands in them. Nothing is shuffled."""
    rows = rows.select(*more, F.sort_array(tokens).alias("_sorted"))
    begins = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", F.greatest(i - 1, F.lit(0)))))
    rows = rows.withColumn("_begins", F.when(F.size("_sorted") > 0, begins).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("_begins", 2, F.size("_begins")), F.array(F.size("_sorted")))
    return rows.select(*more, "_sorted", F.when(F.size("_sorted") > 0, F.arrays_zip(F.col("_begins").alias("a"), ends.alias("b"))).alias("_runs"))


def postings(docs: DataFrame, key: tuple[str, ...] = KEY, tokenizer: Tokenizer = words) -> DataFrame:
    """(key, term, tf). A row is a document, so its terms are counted in place, as runs of its sorted tokens; nothing is shuffled."""
    # An outer generator: of an inner one Spark infers a filter on all that its input is made of.
    rows = runs(tokenized(docs, key, tokenizer), "tokens", *key).select(*key, "_sorted", F.explode_outer("_runs").alias("_run")).where("_run IS NOT NULL")
    return rows.select(*key, F.get("_sorted", F.col("_run.a")).alias("term"), (F.col("_run.b") - F.col("_run.a")).cast("long").alias("tf"))


def file_stats(lengths: DataFrame) -> DataFrame:
    """(_file, doc_count, total_length)."""
    return lengths.groupBy("_file").agg(F.count("*").alias("doc_count"), F.sum("length").alias("total_length"))


def file_df(postings_: DataFrame) -> DataFrame:
    """Documents of each file that have the term."""
    return postings_.groupBy("_file", "term").agg(F.count("*").alias("df"))


def term_df(docs: DataFrame, tokenizer: Tokenizer = words) -> DataFrame:
    """Documents that have the term. The tokens of one document are made distinct in place, so only one aggregation shuffles."""
    return docs.select(F.explode(F.array_distinct(tokenizer(F.col("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def with_mean(counts: DataFrame) -> DataFrame:
    """Add avgdl, total_length over doc_count rounded to six places; 0 of no documents."""
    return counts.withColumn("avgdl", F.round(F.when(F.col("doc_count") > 0, F.col("total_length") / F.nullif(F.col("doc_count"), F.lit(0))).otherwise(0.0), 6))


def global_meta(lengths: DataFrame) -> DataFrame:
    """One row: doc_count, total_length, avgdl rounded to six places."""
    return with_mean(lengths.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_length")))


def stored_meta(stats: DataFrame) -> DataFrame:
    """As `global_meta`, from the counts of each file."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return with_mean(stats.agg(total("doc_count"), total("total_length")))


def idf(doc_count: Column, df: Column) -> Column:
    return F.when(doc_count > 0, F.log1p((doc_count - df + 0.5) / (df + 0.5))).otherwise(0.0)


def terms(docs: DataFrame, tokenizer: Tokenizer = words) -> DataFrame:
    """(term, df, idf) over all documents."""
    meta = docs.agg(F.count("*").alias("doc_count"))
    return term_df(docs, tokenizer).crossJoin(F.broadcast(meta)).select("term", "df", idf(F.col("doc_count"), F.col("df")).alias("idf"))


def digest_ranges(messages: DataFrame) -> DataFrame:
    """(_file, _range, n, digest): rows and SHA-1 of the joined row digests of each DIGESTED rows of a file, in row order."""
    rows = messages.select("_file", F.floor(F.col("_row") / DIGESTED).alias("_range"), F.struct("_row", F.sha1(F.coalesce(F.col("content"), F.lit("")).cast("binary")).alias("h")).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"])
    return rows.groupBy("_file", "_range").agg(F.count("*").alias("n"), F.sha1(F.array_join(ordered, "\x1f").cast("binary")).alias("digest"))


def parents(nodes: DataFrame, top: bool = False) -> DataFrame:
    """The level above: a node over each DIGESTED neighbours, or, at the top, over all of a file."""
    above = F.lit(0).cast("long") if top else F.floor(F.col("_range") / DIGESTED)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_range", "digest"))), lambda r: r["digest"])
    return nodes.select("_file", above.alias("_up"), "_range", "n", "digest").groupBy("_file", F.col("_up").alias("_range")).agg(F.sum("n").alias("n"), F.sha1(F.array_join(ordered, "\x1f").cast("binary")).alias("digest"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    out = [nodes]
    for level in range(1, LEVELS + 1):
        out.append(parents(out[-1], level == LEVELS))
    return out


def _table(levels: list[DataFrame]) -> DataFrame:
    out = None
    for k, nodes in enumerate(levels):
        rows = nodes.select(F.lit(k).alias("level"), "_file", "_range", "n", "digest")
        out = rows if out is None else out.unionByName(rows)
    return out


def digest_tree(messages: DataFrame) -> DataFrame:
    """(level, _file, _range, n, digest): all nodes of the tree of digests of each file.

    A node at level 0 is over DIGESTED rows, one above over DIGESTED nodes, the one at the
    top over what is left of its file, one for 16.8 million rows. So no file goes through one
    task, and a changed row changes one node of each level. Store it to compare versions.
    """
    return _table(_levels(digest_ranges(messages)))


def fingerprints(messages: DataFrame) -> DataFrame:
    """(_file, doc_count, fingerprint): the top of each file's tree of digests."""
    return _levels(digest_ranges(messages))[-1].select("_file", F.col("n").alias("doc_count"), F.col("digest").alias("fingerprint"))


def _of_level(tree: DataFrame, level: int) -> DataFrame:
    return tree.where(F.col("level") == level).drop("level")


def _above(level: int) -> Column:
    """A node's number at the next level."""
    return F.lit(0).cast("long") if level + 1 == LEVELS else F.floor(F.col("_range") / DIGESTED)


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_file, _range, status added, removed or changed) of the ranges of rows that differ between two trees, found by descent: below equal nodes nothing is compared."""
    nodes = old.select("level", "_file", "_range", F.col("digest").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(new.select("level", "_file", "_range", F.lit(None).cast("string").alias("a"), F.col("digest").alias("b")))
    found = None
    for level in range(LEVELS, -1, -1):
        here = _of_level(nodes, level)
        if found is not None:
            here = here.withColumn("_up", _above(level)).join(found.select("_file", F.col("_range").alias("_up")), ["_file", "_up"], "left_semi")
        found = here.groupBy("_file", "_range").agg(F.max("a").alias("a"), F.max("b").alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    return found.select("_file", "_range", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("status"))


def update_tree(tree: DataFrame, messages: DataFrame, ranges: DataFrame, path: str) -> DataFrame:
    """Write the tree of `messages` to `path`, of which only rows in `ranges` (_file, _range) differ from those of `tree`; only these ranges and the nodes above them are computed anew."""
    spark = tree.sparkSession
    ranges.select("_file", "_range").distinct().write.parquet(f"{path}/ranges")
    touched, nodes = spark.read.parquet(f"{path}/ranges"), None
    for level in range(LEVELS + 1):
        if nodes is None:
            rows = messages.withColumn("_range", F.floor(F.col("_row") / DIGESTED))
            fresh = digest_ranges(rows.join(touched, ["_file", "_range"], "left_semi"))
        else:
            touched = touched.select("_file", _above(level - 1).alias("_range")).distinct()
            below = nodes.withColumn("_up", _above(level - 1)).join(touched.withColumnRenamed("_range", "_up"), ["_file", "_up"], "left_semi").drop("_up")
            fresh = parents(below, level == LEVELS)
        part = f"{path}/tree/level={level}"
        _of_level(tree, level).join(touched, ["_file", "_range"], "left_anti").unionByName(fresh).write.parquet(part)
        nodes = spark.read.parquet(part)
    return spark.read.parquet(f"{path}/tree").select("level", "_file", "_range", "n", "digest")


def manifest(messages: DataFrame) -> DataFrame:
    return fingerprints(messages).withColumn("version", F.lit(INDEX_VERSION))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_file, status): added, removed, rebuilt (another version or content) or unchanged. Content decides, not times or sizes."""
    o = old.select("_file", F.col("fingerprint").alias("old"), F.col("version").alias("old_version"))
    n = new.select("_file", F.col("fingerprint").alias("new"), F.col("version").alias("new_version"))
    status = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when((F.col("old") != F.col("new")) | (F.col("old_version") != F.col("new_version")), "rebuilt").otherwise("unchanged")
    )
    return o.join(n, "_file", "full_outer").select("_file", status.alias("status"))


def stale(index_files: DataFrame, files: DataFrame) -> DataFrame:
    """Index parts whose file is gone."""
    return index_files.select("_file").join(files.select("_file"), "_file", "left_anti").distinct()
