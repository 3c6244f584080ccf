"""The engine's queries over the driver's tables, each with its DuckDB statement if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk, segment, text, values
from ..operators import batch, display, evaluate, hot_terms, index, reply, search, segments, sessions, training, verify, vote
from ..schema import HOT_MIN_DF
from ..session import shared_folder
from ..sources import messages as files
from ..sources import testdata as td
from . import oracle as sql

QUERY = "the licence of released under the MIT licence license"
STOP = ("the", "of", "and", "de", "la", "und", "der", "en", "le", "un")
NOW = "2024-01-16 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
DOC = ("_file", "doc_id")

_found: dict[str, tuple[Query, str | None]] = {}


def query(statement: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, statement)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}


# ------------------------------------------------------------------ index and search


def _scores(spark: SparkSession, d: str, q: str) -> DataFrame:
    return search.scores(td.contents(spark, d), search.query_terms(spark, q), DOC)


@query(sql.bm25(QUERY, "SELECT h._file, h.doc_id, h.score, m.source, m.text AS content FROM (SELECT * FROM scores ORDER BY score DESC, _file, doc_id LIMIT 3) h JOIN documents m USING (doc_id)"))
def bm25_search(spark, d):
    hits = search.top(_scores(spark, d, QUERY), key=DOC)
    docs = td.table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("content"))
    return docs.join(F.broadcast(hits), "doc_id").select("_file", "doc_id", "score", "source", "content")  # three hits


@query(sql.bm25(QUERY, "SELECT * FROM scores"))
def bm25_scores_all(spark, d):
    return _scores(spark, d, QUERY).withColumn("score", F.round("score", 6))


@query(sql.bm25("license license", "SELECT * FROM scores"))
def bm25_query_dedupe(spark, d):
    return _scores(spark, d, "license License license").withColumn("score", F.round("score", 6))


@query(sql.bm25("mit license", "SELECT m._file, m._row, m._signature, h.score FROM (SELECT * FROM scores ORDER BY score DESC, _file, doc_id LIMIT 3) h JOIN signed m USING (doc_id)"))
def bm25_topk_materialized(spark, d):
    hits = search.top(_scores(spark, d, "MIT license"), key=DOC)
    return td.messages(spark, d).join(F.broadcast(hits.select("doc_id", "score")), "doc_id").select("_file", "_row", "_signature", "score")


@query(sql.tokens("SELECT _file, doc_id, len(tokens)::BIGINT AS length FROM tokens"))
def tokens_doc_length(spark, d):
    return index.doc_lengths(td.contents(spark, d), DOC)


@query(sql.tokens("SELECT _file, doc_id, term, count(*) AS tf FROM (SELECT _file, doc_id, unnest(tokens) AS term FROM tokens) GROUP BY ALL"))
def postings_tf(spark, d):
    return index.postings(td.contents(spark, d), DOC)


@query(sql.tokens("SELECT _file, term, count(*) AS df FROM (SELECT DISTINCT _file, doc_id, unnest(tokens) AS term FROM tokens) GROUP BY ALL"))
def term_df_file(spark, d):
    docs = td.contents(spark, d)
    return docs.select("_file", F.explode(F.array_distinct(text.words(F.col("content")))).alias("term")).groupBy("_file", "term").agg(F.count("*").alias("df"))


@query(sql.tokens("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tokens) GROUP BY ALL"))
def term_df_global(spark, d):
    return index.term_df(td.contents(spark, d))


@query(sql.tokens("SELECT count(*) AS doc_count, sum(len(tokens))::BIGINT AS total_length, round(sum(len(tokens)) / count(*), 6) AS avgdl FROM tokens"))
def index_global_meta(spark, d):
    return index.global_meta(index.doc_lengths(td.contents(spark, d), DOC))


@query(sql.tokens("SELECT term, count(*) AS df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tokens), (SELECT count(*) AS n FROM documents) GROUP BY term, n"))
def idf_terms(spark, d):
    return index.terms(td.contents(spark, d)).withColumn("idf", F.round("idf", 6))


@query(sql.hot("", 20, "SELECT * FROM hot"))
def hot_terms_ranked(spark, d):
    return hot_terms.hot_terms(td.contents(spark, d))


@query(sql.hot("", 20, "SELECT *, CASE WHEN score / max(score) OVER () >= 0.8 THEN 5 WHEN score / max(score) OVER () >= 0.6 THEN 4 WHEN score / max(score) OVER () >= 0.4 THEN 3 WHEN score / max(score) OVER () >= 0.2 THEN 2 ELSE 1 END AS weight FROM hot"))
def hot_terms_weighted(spark, d):
    return hot_terms.weighted(hot_terms.hot_terms(td.contents(spark, d)))


@query(sql.hot(f"AND term NOT IN ({', '.join(repr(w) for w in STOP)})", 30, "SELECT * FROM hot"))
def hot_terms_stopwords(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOP], "term string")
    return hot_terms.hot_terms(td.contents(spark, d), limit=30, min_df=HOT_MIN_DF, stop=stop)


@query(sql.hot("AND substring(term, 1, 1) < 'n'", 20, "SELECT * FROM hot"))
def hot_terms_pos(spark, d):
    """With a tagger that takes terms from a to m for nouns and others for particles."""
    tag = lambda term: F.when(F.substring(term, 1, 1) < "n", "n").otherwise("u")
    return hot_terms.hot_terms(td.contents(spark, d), pos=tag)


@query(sql.hot("", 20, "SELECT * FROM hot").replace("round(df * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS score", "round(df * pow(ln(1 + (n - df + 0.5) / (df + 0.5)), 2), 6) AS score"))
def hot_terms_own_score(spark, d):
    """Ranked by another score, frequency times the square of idf."""
    return hot_terms.hot_terms(td.contents(spark, d), score=lambda df, idf: df * idf * idf)


@query(sql.hot("AND false", 20, "SELECT * FROM hot"))
def hot_terms_limit_zero(spark, d):
    return hot_terms.hot_terms(td.contents(spark, d), limit=0)


# ------------------------------------------------------------------ a stored index

_indexes: dict[tuple[str, str], segments.Index] = {}
_DF = "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tokens) GROUP BY ALL"


def _stored(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """Messages as several updates or slices read them: numbered and signed once."""
    path = f"{shared_folder(spark, 'messages')}/messages"
    messages.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _new_index(spark: SparkSession, messages: DataFrame) -> segments.Index:
    made = segments.Index(spark, shared_folder(spark, "index"))
    made.update(messages)
    return made


def _index(spark: SparkSession, d: str) -> segments.Index:
    """An index of the messages, written once for each application and table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = _new_index(spark, td.messages(spark, d))
    return _indexes[key]


@query(sql.tokens(_DF))
def index_build(spark, d):
    """An index is written anew; its document frequencies."""
    return _new_index(spark, td.messages(spark, d)).terms()


@query(sql.bm25(QUERY, "SELECT m._file, m._row, h.score FROM scores h JOIN signed m USING (doc_id)"))
def bm25_indexed(spark, d):
    """Postings, lengths, document frequencies and statistics come from the index; no text is read."""
    found = search.indexed_scores(_index(spark, d), search.query_terms(spark, QUERY))
    return found.select("_file", "_row", F.round("score", 6).alias("score"))


@query(sql.bm25("mit license", "SELECT m._file, m._row, h.score, m.content FROM (SELECT s.score, m.* FROM scores s JOIN signed m USING (doc_id) ORDER BY s.score DESC, m._file, m._row LIMIT 3) h JOIN signed m USING (doc_id)"))
def bm25_indexed_topk(spark, d):
    hits = search.search_index(_index(spark, d), "MIT license")
    return td.messages(spark, d).select("_file", "_row", "content").join(F.broadcast(hits), ["_file", "_row"])  # three hits


@query(sql.bm25("qqqqzzzz", "SELECT m._file, m._row, h.score FROM scores h JOIN signed m USING (doc_id)"))
def bm25_indexed_no_hit(spark, d):
    found = search.indexed_scores(_index(spark, d), search.query_terms(spark, "qqqqzzzz"))
    return found.select("_file", "_row", F.round("score", 6).alias("score"))


#: Searches of one, two and more terms, rare and common ones, and one that nothing matches.
SEARCHES = ("the", "mit license", "der die das", "released under the", "qqqqzzzz")


@query(sql.bm25_many(SEARCHES, 7))
def bm25_bounded(spark, d):
    """The best messages of several searches, by bounds of blocks."""
    index_ = _index(spark, d)
    out = None
    for text_ in SEARCHES:
        found = search.best_of_index(index_, search.query_terms(spark, text_), 7, (4, 16)).hits.withColumn("query", F.lit(text_))
        out = found if out is None else out.unionByName(found)
    return out


@query(sql.messages("SELECT term, _file, _row // 128 AS _block, count(*) AS n, max(tf) AS max_tf, min(length) AS min_length FROM (SELECT _file, _row, term, count(*) AS tf, any_value(length) AS length FROM (SELECT _file, _row, len(tokens) AS length, unnest(tokens) AS term FROM (SELECT *, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS tokens FROM messages)) GROUP BY _file, _row, term) GROUP BY ALL"))
def index_blocks(spark, d):
    return _index(spark, d).blocks().select("term", "_file", "_block", "n", "max_tf", "min_length")


@query(sql.tokens("SELECT _file, count(*) AS doc_count, sum(len(tokens))::BIGINT AS total_length FROM tokens GROUP BY _file"))
def index_file_stats(spark, d):
    return _index(spark, d).stats()


@query(sql.tokens("SELECT count(*) AS doc_count, sum(len(tokens))::BIGINT AS total_length, round(sum(len(tokens)) / count(*), 6) AS avgdl FROM tokens"))
def index_stored_meta(spark, d):
    return index.stored_meta(_index(spark, d).stats())


@query(sql.tokens(_DF))
def index_stored_terms(spark, d):
    return _index(spark, d).terms()


@query(sql.messages("SELECT _file, _row, _signature, len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS length FROM signed"))
def index_docs(spark, d):
    return _index(spark, d).docs()


def _blanked(messages: DataFrame) -> DataFrame:
    """A later version: texts of every third document are blank."""
    return messages.withColumn("content", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("content"))).withColumn("_signature", text.signature())


_BLANK = "documents AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS text) FROM main.documents)"


@query(sql.over(_BLANK, sql.bm25("license", "SELECT m._file, m._row, h.score FROM scores h JOIN signed m USING (doc_id)")))
def index_refresh_blank(spark, d):
    """After an update, no posting of a text that became blank is left, and counts are those of the new texts."""
    m = td.messages(spark, d)
    index_ = _new_index(spark, m)
    index_.update(_blanked(m))
    return search.indexed_scores(index_, ["license"]).select("_file", "_row", F.round("score", 6).alias("score"))


@query("SELECT 0::BIGINT AS hits_of_none, 0::BIGINT AS hits_of_blank, count(*) AS doc_count FROM documents")
def index_empty_search(spark, d):
    """An index that was never written, and one of blank texts only, give no hits."""
    m, none = td.messages(spark, d), segments.Index(spark, shared_folder(spark, "index"))
    blank = _new_index(spark, m.withColumn("content", F.lit(" ")))
    hits = lambda i, name: search.search_index(i, "license").agg(F.count("*").alias(name))
    return hits(none, "hits_of_none").crossJoin(hits(blank, "hits_of_blank")).crossJoin(index.stored_meta(blank.stats()).select("doc_count"))


def _changed_index(spark, d, compact: bool) -> segments.Index:
    """An index that documents came to in two batches, of which some then changed, moved up or went; compacted at last, or between."""
    m = _stored(spark, td.messages(spark, d))
    index_ = _new_index(spark, m.where(F.col("doc_id") % 4 != 1))
    index_.update(m)
    if not compact:
        index_.compact()
    blank = _blanked(m)
    index_.update(blank)
    later = verify.delete(blank, m.where(F.col("doc_id") % 7 == 2).select("_file", "_row", F.lit("").alias("signature"))).withColumn("_signature", text.signature())
    index_.update(later)
    if compact:
        index_.compact()
        index_.vacuum()
    return index_


_LATER = "documents AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS text) FROM main.documents WHERE doc_id % 7 <> 2)"


@query(sql.over(_LATER, sql.tokens(_DF)))
def index_changed_terms(spark, d):
    return _changed_index(spark, d, False).terms()


@query(sql.over(_LATER, sql.bm25(QUERY, "SELECT m._file, m._row, h.score FROM scores h JOIN signed m USING (doc_id)")))
def index_compacted_scores(spark, d):
    found = search.indexed_scores(_changed_index(spark, d, True), search.query_terms(spark, QUERY))
    return found.select("_file", "_row", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ messages


_HEAD = "sha1(content) AS content_sha1, nature, fake_probability, source, publish_time, process_time"


@query(sql.messages(f"SELECT _file, _row, _signature, {_HEAD} FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY _file ORDER BY doc_id) - 1 AS _row) FROM signed)"))
def load_all_csv(spark, d):
    """Messages written as CSV files, one for each source, and read back as one table in one scan."""
    folder, messages = shared_folder(spark, "csv"), td.messages(spark, d)
    files.write_tables(messages, folder)
    m = files.load_all(spark, folder)
    return m.select("_file", "_row", "_signature", F.sha1(F.col("content").cast("binary")).alias("content_sha1"), "nature", "fake_probability", "source", "publish_time", "process_time")


@query(sql.messages(f"SELECT _file, _row, _signature, {_HEAD} FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY _file ORDER BY doc_id) - 1 AS _row) FROM signed)"))
def load_all_csv_blocks(spark, d):
    """As `load_all_csv`, every file read in blocks of 64 KB by tasks of their own."""
    folder, messages = shared_folder(spark, "csv"), td.messages(spark, d)
    files.write_tables(messages, folder)
    m = files.load_all(spark, folder, large=0, block=1 << 16)
    return m.select("_file", "_row", "_signature", F.sha1(F.col("content").cast("binary")).alias("content_sha1"), "nature", "fake_probability", "source", "publish_time", "process_time")


@query(sql.training("SELECT content, nature, label FROM data"))
def train_scan_csv(spark, d):
    """The training set from CSV files; one without the columns is skipped."""
    folder = shared_folder(spark, "csv")
    files.write_tables(td.messages(spark, d), folder)
    spark.range(3).selectExpr("'x' AS other", "'真实' AS nature").coalesce(1).write.option("header", True).csv(f"{folder}/.more")
    files.move_part(spark, f"{folder}/.more", folder, "zz-other.csv")
    return training.dataset(files.training_rows(spark, folder))


def _stored_counts(spark, d) -> DataFrame:
    path = f"{shared_folder(spark, 'counts')}/counts"
    display.range_counts(td.messages(spark, d)).write.parquet(path)
    return spark.read.parquet(path)


@query(sql.messages("SELECT * FROM (SELECT 'first' AS asked, * FROM (SELECT _file, _row FROM messages ORDER BY _file, _row LIMIT 20) UNION ALL SELECT 'last', * FROM (SELECT _file, _row FROM messages ORDER BY _file, _row LIMIT 20 OFFSET (SELECT ((greatest(count(*), 1) - 1) // 20) * 20 FROM messages)))"))
def page_clamps(spark, d):
    """A page before the first is the first, one after the last is the last."""
    rows = td.messages(spark, d).select("_file", "_row")
    return display.page(rows, -5).drop("place").withColumn("asked", F.lit("first")).unionByName(display.page(rows, 10**9).drop("place").withColumn("asked", F.lit("last")))


@query(sql.messages("SELECT _file, _row, _signature, content, nature, fake_probability, source, publish_time, process_time FROM signed"))
def messages_union(spark, d):
    return td.messages(spark, d).select("_file", "_row", "_signature", "content", "nature", "fake_probability", "source", "publish_time", "process_time")


@query(sql.messages("SELECT doc_id, _signature FROM signed"))
def row_signature(spark, d):
    return td.unplaced(spark, d).select("doc_id", text.signature().alias("_signature"))


@query(sql.tree("SELECT _file, n AS doc_count, digest AS fingerprint FROM tree WHERE level = 4"))
def content_fingerprint(spark, d):
    return index.fingerprints(td.messages(spark, d))


@query(sql.tree("SELECT _file, n AS doc_count, digest AS fingerprint, 1 AS version FROM tree WHERE level = 4"))
def index_manifest(spark, d):
    """The manifest as stored and read back."""
    path = f"{shared_folder(spark, 'manifest')}/manifest"
    index.manifest(td.messages(spark, d)).write.parquet(path)
    return spark.read.parquet(path)


@query(sql.tree("SELECT * FROM tree"))
def fingerprint_tree(spark, d):
    return index.digest_tree(td.messages(spark, d))


def _stored_tree(spark, messages: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark, 'tree')}/tree"
    index.digest_tree(messages).write.parquet(path)
    return spark.read.parquet(path)


_FILE_NUMBER = "regexp_extract(_file, '([0-9]+)', 1)"
_ADDED, _CHANGED = f"CAST({_FILE_NUMBER} AS INT) % 5 = 1", f"CAST({_FILE_NUMBER} AS INT) % 2 = 1 AND _row % 50 = 7"


def _earlier(messages: DataFrame) -> DataFrame:
    """An earlier version: without some files, and with other texts in some rows of others."""
    return messages.where(f"NOT ({_ADDED})").withColumn("content", F.when(F.expr(_CHANGED), "earlier").otherwise(F.col("content")))


@query(sql.messages(f"SELECT DISTINCT _file, _row // 64 AS _range, CASE WHEN {_ADDED} THEN 'added' ELSE 'changed' END AS status FROM messages WHERE {_ADDED} OR {_CHANGED}"))
def fingerprint_changed_ranges(spark, d):
    """The ranges of rows in which two stored versions differ."""
    m = td.messages(spark, d)
    return index.changed_ranges(_stored_tree(spark, _earlier(m)), _stored_tree(spark, m))


@query(sql.tree("SELECT * FROM tree"))
def fingerprint_updated(spark, d):
    """The tree of a later version from the stored tree of an earlier one, computing only what changed."""
    m = td.messages(spark, d)
    ranges = m.where(f"{_ADDED} OR {_CHANGED}").select("_file", F.floor(F.col("_row") / index.DIGESTED).alias("_range"))
    return index.update_tree(_stored_tree(spark, _earlier(m)), m, ranges, shared_folder(spark, "tree"))


@query(sql.messages("SELECT _file, _row, nature, (row_number() OVER (ORDER BY _file, _row) + 40)::BIGINT AS place FROM (SELECT * FROM messages ORDER BY _file, _row LIMIT 20 OFFSET 40)"))
def page_view(spark, d):
    rows = td.messages(spark, d).select("_file", "_row", "nature")
    return display.page(rows, 3, counts=_stored_counts(spark, d))


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM documents")
def page_count(spark, d):
    return display.page_count(td.table(spark, d, "documents"))


@query(sql.messages("""SELECT _file, _row, CASE WHEN length(content) <= 145 THEN content ELSE regexp_replace(left(content, 137), ' [^ ]*$', '') || '...' END AS summary, source, publish_time, nature,
 CASE WHEN fake_probability = '' THEN '待检测' WHEN fake_probability::DOUBLE < 40 THEN 'low' WHEN fake_probability::DOUBLE < 70 THEN 'medium' ELSE 'high' END AS level FROM messages"""))
def display_view(spark, d):
    return display.display(td.messages(spark, d))


# ------------------------------------------------------------------ normal forms


def _docs(spark, d, *columns):
    return td.table(spark, d, "documents").select("doc_id", *columns)


_ODD = "CASE doc_id % 8 WHEN 0 THEN ' 12.345 ' WHEN 1 THEN '1_000' WHEN 2 THEN '-3' WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN '1e1' WHEN 6 THEN '2.675' ELSE concat(doc_id % 101, '.5') END"


@query(f"SELECT doc_id, v, CASE WHEN v = '' THEN '' WHEN try_cast(replace(trim(v), '_', '') AS DOUBLE) IS NOT NULL THEN printf('%.2f', greatest(0, least(100, try_cast(replace(trim(v), '_', '') AS DOUBLE)))) END AS probability FROM (SELECT doc_id, {_ODD} AS v FROM documents)")
def normalize_probability(spark, d):
    return _docs(spark, d, F.expr(_ODD).alias("v")).withColumn("probability", values.probability(F.col("v")))


@query(f"SELECT doc_id, v, coalesce(trunc(try_cast(replace(trim(v), '_', '') AS DOUBLE))::BIGINT, 0) AS n FROM (SELECT doc_id, {_ODD} AS v FROM documents)")
def as_int_coerce(spark, d):
    return _docs(spark, d, F.expr(_ODD).alias("v")).withColumn("n", values.as_int(F.col("v")))


_TIMES = "CASE doc_id % 8 WHEN 0 THEN '2024-03-05 07:08:09' WHEN 1 THEN '2024-3-5T7:8:9' WHEN 2 THEN '2024-03-05T07:08' WHEN 3 THEN '2024-3-5' WHEN 4 THEN '2024-02-30' WHEN 5 THEN '2024-03-05 later' WHEN 6 THEN '' ELSE concat('  2023-01-', 1 + doc_id % 28, ' 1:2:3 ') END"


@query(f"SELECT doc_id, v, CASE WHEN trim(v) = '' THEN '' ELSE strftime(try_strptime(trim(v), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%d']), '%Y-%m-%d %H:%M:%S') END AS time FROM (SELECT doc_id, {_TIMES} AS v FROM documents)")
def normalize_time(spark, d):
    return _docs(spark, d, F.expr(_TIMES).alias("v")).withColumn("time", values.time(F.col("v")))


_NATURES = "CASE doc_id % 5 WHEN 0 THEN ' 虚假 ' WHEN 1 THEN '真实' WHEN 2 THEN 'other' WHEN 3 THEN '' ELSE '中立' END"


@query(f"SELECT doc_id, CASE WHEN trim(v) IN ('虚假', '真实', '中立', '未校验') THEN trim(v) ELSE '未校验' END AS nature FROM (SELECT doc_id, {_NATURES} AS v FROM documents)")
def normalize_nature(spark, d):
    return _docs(spark, d, values.nature(F.expr(_NATURES)).alias("nature"))


_NAMES = "CASE doc_id % 5 WHEN 0 THEN concat(source, '.csv') WHEN 1 THEN concat('../', source, '.CSV') WHEN 2 THEN source WHEN 3 THEN concat(source, '.CSV') ELSE concat('a\\\\', source, '.csv') END"


@query(f"SELECT doc_id, lower(v) LIKE '%.csv' AND NOT contains(v, '/') AND NOT contains(v, chr(92)) AS ok FROM (SELECT doc_id, {_NAMES} AS v FROM documents)")
def file_name_guard(spark, d):
    return td.table(spark, d, "documents").select("doc_id", values.csv_name(F.expr(_NAMES)).alias("ok"))


@query("SELECT doc_id, CASE WHEN length(text) <= 145 THEN text ELSE regexp_replace(left(text, 137), ' [^ ]*$', '') || '...' END AS summary FROM documents")
def truncate_display(spark, d):
    return _docs(spark, d, text.truncated(F.col("text")).alias("summary"))


@query("SELECT doc_id, greatest(coalesce(try_cast(CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'x' WHEN 2 THEN '-4' ELSE '' END AS INTEGER), 1), 1) AS page FROM documents")
def page_argument(spark, d):
    return _docs(spark, d, values.page_number(F.expr("CASE doc_id % 4 WHEN 0 THEN cast(doc_id AS STRING) WHEN 1 THEN 'x' WHEN 2 THEN '-4' ELSE '' END")).alias("page"))


# ------------------------------------------------------------------ evaluation

_METRICS = "threshold, tp, fp, tn, fn, total, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def _samples(spark, d):
    return evaluate.samples(td.unplaced(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(sql.samples("SELECT prob, nature FROM samples"))
def eval_samples(spark, d):
    return _samples(spark, d)


@query(sql.samples("SELECT threshold, tp, fp, tn, fn FROM metrics WHERE threshold = 50"))
def eval_confusion(spark, d):
    return evaluate.confusion(_samples(spark, d))


@query(sql.samples(f"SELECT {_METRICS} FROM metrics WHERE threshold = 50"))
def eval_metrics(spark, d):
    return _rounded(evaluate.metrics(evaluate.confusion(_samples(spark, d))))


@query(sql.samples(f"SELECT {_METRICS} FROM metrics"))
def eval_sweep(spark, d):
    return _rounded(evaluate.sweep(_samples(spark, d)))


@query(sql.samples("SELECT round(avg(pow(prob / 100.0 - CASE nature WHEN '虚假' THEN 1.0 WHEN '真实' THEN 0.0 ELSE 0.5 END, 2)), 6) AS mse, count(*) AS count FROM samples"))
def eval_mse(spark, d):
    return evaluate.squared_error(_samples(spark, d)).withColumn("mse", F.round("mse", 6))


@query(sql.samples("SELECT count(*) FILTER (nature = '虚假') AS positive, count(*) FILTER (nature = '真实') AS negative, count(*) FILTER (nature = '中立') AS neutral, 0::BIGINT AS invalid FROM samples"))
def eval_label_counts(spark, d):
    return evaluate.label_counts(td.unplaced(spark, d))


# ------------------------------------------------------------------ vote


def _members(spark, d):
    return vote.members(td.outputs(spark, d))


_DECISION = ("doc_id", "mode", "level", "label", "decision_method", "mean_score", "low", "medium", "high", "majority_required", "selected_count", "success_count", "agreement_count", "has_failures")


@query(sql.vote("SELECT doc_id, ordinal, model_id, status, score, level, label, reason, error FROM members"))
def vote_members(spark, d):
    return _members(spark, d).select("doc_id", F.inline("members"))


@query("""SELECT doc_id, ordinal, CASE WHEN ordinal = 0 THEN CASE doc_id % 3 WHEN 0 THEN '模型检测失败，请稍后重试' WHEN 1 THEN concat('told ', doc_id) END END AS error, CASE WHEN ordinal = 0 AND doc_id % 3 < 2 THEN 'error' ELSE 'ok' END AS status, CASE WHEN ordinal = 1 OR doc_id % 3 = 2 THEN 50.0::DOUBLE END AS score
 FROM documents, (SELECT unnest([0, 1]) AS ordinal)""")
def vote_run_errors(spark, d):
    """Errors of a run reach the member: its own text, or a general one where there are no details."""
    told = F.when(F.col("doc_id") % 3 == 0, "failed").when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" told "), F.col("doc_id").cast("string")))
    one = lambda k, error: F.struct(F.lit(k).alias("ordinal"), F.lit(f"m{k}").alias("model_id"), F.lit(True).alias("available"), F.when(error.isNull(), 50.0).alias("score"), F.when(error.isNull(), "why").alias("reason"), error.alias("error"))
    outputs = _docs(spark, d, F.array(one(0, told), one(1, F.lit(None).cast("string"))).alias("outputs"))
    return vote.members(outputs).select("doc_id", F.inline("members")).select("doc_id", "ordinal", "error", "status", "score")


def _registry(spark) -> DataFrame:
    rows = [("alpha", "Alpha", True), ("beta", "Beta", False), ("gamma", "Gamma", True)]
    return spark.createDataFrame(rows, "model_id string, display_name string, available boolean")


@query("""SELECT doc_id, s.k - 1 AS ordinal, s.m AS model_id, CASE s.m WHEN 'alpha' THEN 'Alpha' WHEN 'beta' THEN 'Beta' ELSE s.m END AS display_name, s.m = 'alpha' AS available
 FROM (SELECT doc_id, unnest([{'k': 1, 'm': 'beta'}, {'k': 2, 'm': CASE doc_id % 2 WHEN 0 THEN 'alpha' ELSE 'omega' END}]) AS s FROM documents)""")
def selected_models(spark, d):
    requests = _docs(spark, d, F.array(F.lit("beta"), F.when(F.col("doc_id") % 2 == 0, "alpha").otherwise("omega")).alias("models"))
    return vote.selected(requests, _registry(spark)).select("doc_id", F.inline("selected"))


@query("SELECT count(*) AS models, count(*) FILTER (ok) AS available FROM (SELECT s_suppkey, s_suppkey % 3 <> 0 AS ok FROM supplier)")
def available_models(spark, d):
    """Suppliers taken for models, of which every third is unavailable."""
    registry = td.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("model_id"), F.col("s_name").alias("display_name"), (F.col("s_suppkey") % 3 != 0).alias("available"))
    return vote.available_count(registry)


@query("SELECT doc_id, replace(printf('%.1f', ((doc_id * 7919) % 10001) / 100.0), ',', '') AS shown FROM documents")
def one_decimal_display(spark, d):
    return _docs(spark, d, values.one_decimal((F.col("doc_id") * 7919 % 10001) / 100.0).alias("shown"))


@query("SELECT event_id, round((event_id % 100003) / 1000000.0, 3) AS elapsed FROM events")
def elapsed_times(spark, d):
    e = td.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    ended = F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 100_003)
    return e.select("event_id", vote.elapsed(F.col("ts"), ended).alias("elapsed"))


@query(sql.vote(f"SELECT {', '.join(_DECISION)} FROM decided"))
def risk_vote(spark, d):
    return vote.vote(_members(spark, d)).withColumn("mean_score", F.round("mean_score", 6)).select(*_DECISION)


@query(sql.vote("SELECT doc_id, low, medium, high, success_count, selected_count, selected_count - success_count AS failed_count, agreement_count, level FROM decided"))
def vote_tally(spark, d):
    long = _members(spark, d).select("doc_id", F.inline("members"))
    return vote.tally(long, "doc_id").select("doc_id", "low", "medium", "high", "success_count", "selected_count", "failed_count", "agreement_count", "level")


@query(sql.vote("SELECT doc_id, fallback_reason, warning FROM worded"))
def vote_fallback_text(spark, d):
    return vote.texts(vote.vote(_members(spark, d))).select("doc_id", "fallback_reason", "warning")


_REQUEST = "CASE doc_id % 7 WHEN 0 THEN '  ' ELSE text END"


@query("""SELECT doc_id, CASE WHEN trim(m) = '' THEN 'blank' WHEN length(trim(m, ' ' || chr(9) || chr(10) || chr(13))) > 6000 THEN 'too_long' WHEN len(list_distinct(ids)) < len(ids) THEN 'duplicate' WHEN len(ids) = 0 THEN 'empty' WHEN list_contains(ids, 'omega') THEN 'unknown_model' END AS error_code
 FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '  ' ELSE text END AS m, CASE doc_id % 4 WHEN 0 THEN ['alpha', 'beta'] WHEN 1 THEN ['alpha', 'alpha'] WHEN 2 THEN []::VARCHAR[] ELSE ['omega'] END AS ids FROM documents)""")
def request_validation(spark, d):
    ids = F.expr("CASE doc_id % 4 WHEN 0 THEN array('alpha', 'beta') WHEN 1 THEN array('alpha', 'alpha') WHEN 2 THEN cast(array() AS array<string>) ELSE array('omega') END")
    return td.table(spark, d, "documents").select("doc_id", vote.request_error(F.expr(_REQUEST), ids, [m for m, _ in td.MODELS]).alias("error_code"))


# ------------------------------------------------------------------ replies


@query(sql.replies("SELECT doc_id, cleaned FROM cleaned"))
def reply_clean(spark, d):
    return td.replies(spark, d).select("doc_id", reply.cleaned(F.col("reply")).alias("cleaned"))


@query(sql.replies("SELECT doc_id, object FROM objects"))
def reply_extract(spark, d):
    wrapped = F.to_json(F.struct(F.struct(F.col("reply").alias("content")).alias("message")))
    return td.replies(spark, d).select("doc_id", reply.json_object(reply.cleaned(reply.chat_content(wrapped))).alias("object"))


@query(sql.replies("SELECT doc_id, ok, CASE WHEN ok THEN score END AS score, CASE WHEN ok THEN reason END AS reason FROM checked"))
def reply_validate(spark, d):
    return reply.checked(td.replies(spark, d)).select("doc_id", "ok", "score", "reason")


@query("SELECT doc_id, replace('Rate this message: {message}', '{message}', text) AS prompt FROM documents")
def prompt_text(spark, d):
    return _docs(spark, d, reply.prompt("Rate this message: {message}", F.col("text")).alias("prompt"))


@query("SELECT doc_id, round(100 * exp(b) / (exp(a) + exp(b)), 6) AS score, CASE WHEN b > a THEN 1 ELSE 0 END AS class FROM (SELECT doc_id, (doc_id % 17) / 4.0 AS a, (doc_id % 23) / 5.0 AS b FROM documents)")
def softmax_score(spark, d):
    logits = F.array((F.col("doc_id") % 17) / 4.0, (F.col("doc_id") % 23) / 5.0)
    return td.table(spark, d, "documents").select("doc_id", F.round(risk.softmax(logits)[1] * 100, 6).alias("score"), risk.argmax(logits).alias("class"))


# ------------------------------------------------------------------ batch scoring


def _scored(spark, d, override: bool):
    return batch.scored(td.messages(spark, d), td.raw_score(57), override)


@query(sql.batch("fake_probability = ''", "SELECT _file, _row, fake_probability, outcome FROM scored"))
def batch_score_pending(spark, d):
    return _scored(spark, d, False).select("_file", "_row", "fake_probability", "outcome")


@query(sql.batch("true", "SELECT _file, _row, fake_probability, outcome FROM scored"))
def batch_score_override(spark, d):
    return _scored(spark, d, True).select("_file", "_row", "fake_probability", "outcome")


@query(sql.batch("true", "SELECT _file, count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'failed') AS failed FROM scored GROUP BY _file"))
def batch_counts(spark, d):
    return batch.counts(_scored(spark, d, True))


@query(sql.batch("true", "SELECT _file, _row, done FROM (SELECT _file, _row, row_number() OVER (PARTITION BY _file ORDER BY _row) AS done FROM scored WHERE outcome = 'done') WHERE done % 20 = 0"))
def batch_checkpoints(spark, d):
    return batch.checkpoints(_scored(spark, d, True))


class _Stopped(Exception):
    pass


def _stopped_and_resumed(spark, d) -> tuple[DataFrame, batch.Journal]:
    """Score every message in five slices; the first run stops in its third slice, the second goes on."""
    m, journal = _stored(spark, td.messages(spark, d)), batch.Journal(spark, shared_folder(spark, "journal"))
    size = -(-m.agg(F.max("_row") + 1).first()[0] // 5)  # five slices
    slices = iter(range(2))

    def stopping(rows: DataFrame) -> DataFrame:
        if next(slices, None) is None:
            raise _Stopped
        return rows.withColumn("score", td.raw_score(57))

    try:
        batch.run_slices(m, stopping, journal, True, size)
    except _Stopped:
        pass
    batch.run_slices(m, lambda rows: rows.withColumn("score", td.raw_score(57)), journal, True, size)
    return m, journal


@query(sql.batch("true", "SELECT _file, _row, fake_probability, outcome FROM scored"))
def batch_resumed(spark, d):
    """A run that was stopped between slices and taken up again gives what an undisturbed one gives."""
    return batch.resumed(*_stopped_and_resumed(spark, d), override=True).select("_file", "_row", "fake_probability", "outcome")


@query(sql.messages("SELECT _file, _row, 1::BIGINT AS times FROM messages"))
def batch_journal(spark, d):
    """No message is scored twice."""
    return _stopped_and_resumed(spark, d)[1].entries().groupBy("_file", "_row").agg(F.count("*").alias("times"))


# ------------------------------------------------------------------ verification


def _skips(messages: DataFrame) -> DataFrame:
    keys = verify.unverified(messages).where(F.col("doc_id") % 3 == 0).select("key")
    return keys.unionByName(messages.where(F.col("doc_id") % 3 == 0).select(F.concat("_file", F.lit(":gone")).alias("key")))


@query(sql.verify("SELECT _file, _row, key FROM queue ORDER BY _file, _row LIMIT 1"))
def verify_next(spark, d):
    m = td.messages(spark, d)
    return verify.next_message(m, _skips(m)).select("_file", "_row", "key")


@query(sql.verify("SELECT DISTINCT key FROM skips WHERE key IN (SELECT key FROM unverified)"))
def verify_skip_live(spark, d):
    m = td.messages(spark, d)
    return verify.live_skips(m, _skips(m))


@query(sql.verify("SELECT (SELECT count(*) FROM unverified) AS unverified, (SELECT count(*) FROM queue) AS waiting, CASE WHEN (SELECT count(*) FROM unverified) = 0 THEN 'all_verified' WHEN (SELECT count(*) FROM queue) > 0 THEN 'ready' ELSE 'all_skipped' END AS state"))
def verify_state(spark, d):
    m = td.messages(spark, d)
    return verify.state(m, _skips(m))


@query("SELECT doc_id, list_sort(list_distinct(list_append(['a', 'b'], k))) AS added, list_filter(['a', 'b'], lambda x: x <> k) AS removed FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS k FROM documents)")
def skip_list(spark, d):
    k, have = F.expr("CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"), F.array(F.lit("a"), F.lit("b"))
    return td.table(spark, d, "documents").select("doc_id", F.array_sort(verify.add_skip(have, k)).alias("added"), verify.remove_skip(have, k).alias("removed"))


@query(sql.edits("SELECT doc_id, CASE WHEN applies THEN '真实' ELSE nature END AS nature, CASE WHEN applies THEN '2024-02-01 00:00:00' ELSE process_time END AS process_time FROM joined"))
def verify_label(spark, d):
    m = td.messages(spark, d)
    return verify.label(m, td.edits(m), "2024-02-01 00:00:00").select("doc_id", "nature", "process_time")


@query(sql.edits("SELECT doc_id, nature, substring(sha1(concat_ws(chr(31), content, nature, fake_probability, source, publish_time, process_time)), 1, 16) AS _signature FROM (SELECT * REPLACE (CASE WHEN applies THEN '真实' ELSE nature END AS nature) FROM joined)"))
def edits_update(spark, d):
    m = td.messages(spark, d)
    return verify.update(m, td.edits(m)).select("doc_id", "nature", "_signature")


@query(sql.edits("SELECT doc_id, CASE WHEN applies THEN '中立' ELSE nature END AS nature FROM joined"))
def edits_update_twice(spark, d):
    """Two edits of each row: one applies, and no row comes twice."""
    m = td.messages(spark, d)
    edits = td.edits(m)
    return verify.update(m, edits.unionByName(edits.withColumn("nature", F.lit("中立")))).select("doc_id", "nature")


@query(sql.edits("SELECT doc_id, _file, row_number() OVER (PARTITION BY _file ORDER BY _row) - 1 AS _row FROM joined WHERE NOT applies"))
def edits_delete(spark, d):
    m = td.messages(spark, d)
    return verify.delete(m, td.edits(m)).select("doc_id", "_file", "_row")


@query(sql.edits("SELECT e._file, e._row, CASE WHEN m.doc_id IS NULL THEN 'not_found' WHEN e.signature = '' OR e.signature = m._signature THEN 'ok' ELSE 'conflict' END AS status FROM edits e LEFT JOIN signed m USING (_file, _row)"))
def edits_conflict(spark, d):
    m = td.messages(spark, d)
    return verify.statuses(m, td.edits(m)).select("_file", "_row", "status")


@query(sql.messages("SELECT _file, _row, content, nature, fake_probability, publish_time FROM messages UNION ALL SELECT 'manual.csv', 0, 'a new message', '未校验', '7.50', '2024-02-01 00:00:00'"))
def append_manual(spark, d):
    m = verify.append(td.messages(spark, d), {"content": " a new message ", "fake_probability": "7.5"}, at="2024-02-01 00:00:00")
    return m.select("_file", "_row", "content", "nature", "fake_probability", "publish_time")


def _written_back(spark, d) -> tuple[str, DataFrame]:
    """Two batches of edits made from one version and written one after the other: the path, and the statuses of the second."""
    m, path = td.messages(spark, d), shared_folder(spark, "messages")
    files.write_messages(m, path)
    edits = td.edits(m)
    verify.write_back(spark, path, edits)
    return path, verify.write_back(spark, path, edits.withColumn("nature", F.lit("中立")))


@query(sql.edits("SELECT doc_id, CASE WHEN applies THEN CASE WHEN doc_id % 20 = 3 AND nature <> '真实' THEN '真实' ELSE '中立' END ELSE nature END AS nature FROM joined"))
def edits_written_back(spark, d):
    """Edits with a signature apply once: the second batch, made from the same version, meets changed rows. Those without one apply again."""
    path, _ = _written_back(spark, d)
    return spark.read.parquet(path).select("doc_id", "nature")


@query(sql.edits("SELECT e._file, e._row, CASE WHEN m.doc_id IS NULL THEN 'not_found' WHEN e.signature = '' OR e.signature = m._signature AND m.nature = '真实' THEN 'ok' ELSE 'conflict' END AS status FROM edits e LEFT JOIN signed m USING (_file, _row)"))
def edits_written_back_conflicts(spark, d):
    return _written_back(spark, d)[1].select("_file", "_row", "status")


# ------------------------------------------------------------------ index maintenance


def _manifests(spark, d) -> tuple[DataFrame, DataFrame]:
    new = index.manifest(td.messages(spark, d))
    n = F.regexp_extract("_file", r"(\d+)", 1).cast("int")
    old = new.where(n % 5 != 1).withColumn("fingerprint", F.when(n % 5 == 2, F.lit("old")).otherwise(F.col("fingerprint"))).withColumn("version", F.when(n % 5 == 3, 0).otherwise(F.col("version")))
    return old, new.where(n % 5 != 4)


@query("SELECT concat(source, '.csv') AS _file, CASE n % 5 WHEN 1 THEN 'added' WHEN 4 THEN 'removed' WHEN 0 THEN 'unchanged' ELSE 'rebuilt' END AS status FROM (SELECT DISTINCT source, regexp_extract(source, '(\\d+)')::INT AS n FROM documents)")
def index_diff(spark, d):
    return index.manifest_diff(*_manifests(spark, d))


@query("SELECT DISTINCT concat(source, '.csv') AS _file FROM documents WHERE regexp_extract(source, '(\\d+)')::INT % 5 = 4")
def index_prune(spark, d):
    return index.stale(*_manifests(spark, d))


# ------------------------------------------------------------------ users and sessions


@query("SELECT c_custkey::VARCHAR AS username, c_mktsegment AS role FROM customer WHERE c_custkey = 42")
def user_lookup(spark, d):
    return sessions.find(td.users(spark, d), "username", "42")


@query(sql.sessions(NOW, "SELECT session_id, username, created_at FROM active"))
def session_active(spark, d):
    return sessions.active(td.sessions(spark, d), NOW)


@query(sql.sessions(NOW, "SELECT session_id, username, created_at FROM sessions WHERE session_id <> '7'"))
def session_remove(spark, d):
    return sessions.remove(td.sessions(spark, d), "7")


@query(sql.sessions(NOW, "SELECT session_id, username, role FROM active JOIN (SELECT c_custkey::VARCHAR AS username, c_mktsegment AS role FROM customer) USING (username)"))
def session_user(spark, d):
    return sessions.with_users(td.sessions(spark, d), td.users(spark, d), NOW).select("session_id", "username", "role")


# ------------------------------------------------------------------ training set


@query(sql.training("SELECT content, nature, label FROM data"))
def train_dataset(spark, d):
    return training.dataset(td.messages(spark, d))


@query(sql.training("SELECT content, label, CASE WHEN row_number() OVER (ORDER BY sha1(content), content) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'validation' ELSE 'train' END AS part FROM data"))
def train_split(spark, d):
    return training.split(training.dataset(td.messages(spark, d))).select("content", "label", "part")


@query(sql.training("SELECT count(*) AS total, sum(label)::BIGINT AS positive, count(*) FILTER (label = 0) AS negative FROM data"))
def train_label_counts(spark, d):
    return training.label_counts(training.dataset(td.messages(spark, d)))


@query("SELECT epoch, accuracy, max(accuracy) OVER (ORDER BY epoch) AS best, accuracy >= max(accuracy) OVER (ORDER BY epoch) AS saved FROM (SELECT r_regionkey AS epoch, ((r_regionkey * 7) % 5) / 10.0::DOUBLE AS accuracy FROM region)")
def train_best_so_far(spark, d):
    epochs = td.table(spark, d, "region").select(F.col("r_regionkey").alias("epoch"), ((F.col("r_regionkey") * 7 % 5) / 10.0).cast("double").alias("accuracy"))
    return training.best_so_far(epochs)


@query(None)
def train_epochs(spark, d):
    """Loss, accuracy and what is saved, epoch by epoch."""
    path = f"{shared_folder(spark, 'training')}/data"
    training.split(training.dataset(td.messages(spark, d))).select("content", "label", "part").write.parquet(path)
    history = training.train_epochs(spark.read.parquet(path)).history
    return history.select("epoch", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"), F.round("best", 6).alias("best"), "saved")


#: Han characters that stand for Latin letters in a query.
_HAN = "一二三四五六七八九十百千万人口日月水火木金土山石田禾"


def _as_han(column: str) -> Column:
    """Letters as Han characters, without the spaces between words: a text that has to be segmented."""
    return F.translate(F.regexp_replace(F.lower(column), " +", ""), "abcdefghijklmnopqrstuvwxyz", _HAN)


def _han_tokenizer(spark, d):
    """Words of two to five letters that occur in the table, with their counts."""
    found = td.table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])([a-z]{2,5})(?![a-z])"), F.lit(1))).alias("w"))
    counts = found.groupBy("w").count().where("count >= 5").select(F.translate("w", "abcdefghijklmnopqrstuvwxyz", _HAN).alias("word"), "count")
    return segment.dictionary_tokenizer(counts)


@query(None)
def han_tokens(spark, d):
    """Tokens of every document, its letters written as Han characters without spaces, by the most probable path."""
    tokens = _han_tokenizer(spark, d)(_as_han("text"))
    return td.table(spark, d, "documents").select("doc_id", tokens.alias("tokens")).select("doc_id", F.size("tokens").alias("n_tokens"), F.sha1(F.array_join("tokens", "/").cast("binary")).alias("tokens_sha1"))


@query(None)
def classifier_scores(spark, d):
    """Fit on the training part, score every message."""
    m, path = td.messages(spark, d), shared_folder(spark, "training")
    training.dataset(m).write.parquet(f"{path}/data")  # a split reads its data three times, a fit its rows in each pass
    training.split(spark.read.parquet(f"{path}/data")).where("part = 'train'").select("content", "label").write.parquet(f"{path}/train")
    model = training.fit_classifier(spark.read.parquet(f"{path}/train"))
    return training.classifier_scores(model, m).select("_file", "_row", F.round("score", 6).alias("score"), "reason")
