"""Document fingerprints: the digest of a canonical form, with byte comparison inside buckets.

The canonical form is NFKC, case folding, NFKC again, and white space folded to single
spaces; its fingerprint is a 128-bit xxhash. Documents with one fingerprint form a bucket.
In buckets of several documents the canonical bytes themselves are compared: Spark groups
by fingerprint and bytes, partially aggregated, so a bucket with a third of all rows is as
good as any; documents of a bucket that differ get groups of their own. Likeness of two
fingerprints is 1 if bucket and bytes agree, else 0.

Null and empty texts have the canonical form "" and are one group. A null doc_id sorts
first, and a group's id is the least doc_id that isn't null; rows with equal doc_id follow
one another in no fixed order, repeated rows each get a result; an empty table gives an
empty one; a single document is its own next one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, batch_of, cut, slices, source, width

#: Bits of the map of shared fingerprints, at most.
MOST_BITS = 1 << 27


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def fingerprint(form: bytes) -> bytes:
    return xxhash.xxh3_128_digest(form)


def _form(form: bytes) -> bytes:
    """Tells forms of one fingerprint apart once their bytes are compared."""
    return hashlib.sha256(form).digest()[:16]


def _bits(prints: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """Which places the last four bytes of these fingerprints (fingerprint) name, of a power of two; at most `most`."""
    size = min(most, 1 << max(16, (16 * prints.count()).bit_length()))
    at = F.conv(F.hex(F.substring("fingerprint", 13, 4)), 16, 10).cast("long") % size
    words = prints.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")).toPandas()  # size / 64 rows
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _forms(batches, bits: np.ndarray):
    """Canonical bytes of the documents whose fingerprint has its bit set."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.binary()), ("canonical", pa.binary())])
    for part in slices(batches, "text"):
        forms = [canonical(t) for t in part["text"].to_pylist()]
        prints = [fingerprint(f) for f in forms]
        at = np.frombuffer(b"".join(p[-4:] for p in prints), ">u4").astype(np.int64) % (64 * len(bits))
        on = np.flatnonzero(bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).tolist()
        yield batch_of(schema, {"doc_id": part["doc_id"].take(pa.array(on, pa.int64())), "fingerprint": [prints[i] for i in on], "canonical": [forms[i] for i in on]})


def equal_groups(docs: DataFrame, printed: DataFrame) -> DataFrame:
    """Add group_id, the least doc_id with the same canonical bytes, to `printed` (doc_id, fingerprint, form, ...) of the same `docs` (doc_id, text).

    Only bytes of documents that may share a fingerprint are shuffled: a bit map of the
    shared ones, of bounded size, leaves out most others where the texts are read.
    """
    shared = cut(printed.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    bits = docs.sparkSession.sparkContext.broadcast(_bits(shared))
    forms = docs.mapInArrow(lambda it: _forms(it, bits.value), "doc_id long, fingerprint binary, canonical binary")
    own = forms.groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n"))
    own = cut(own.where("n > 1").select("fingerprint", F.substring(F.unhex(F.sha2("canonical", 256)), 1, 16).alias("form"), "group_id", "n"))
    total, key = own.agg(F.sum("n")).first()[0] or 0, ["fingerprint", "form"]
    hot, rest = F.broadcast(own.where(F.col("n") * HEAVY > total).drop("n")), own.where(F.col("n") * HEAVY <= total).drop("n")
    cold = printed.join(hot.select(*key), key, "left_anti").join(rest, key, "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    columns = [*printed.columns, "group_id"]
    return cold.select(*columns).unionByName(printed.join(hot, key).select(*columns))


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.bool_()), ("near_next", pa.bool_()), ("form", pa.binary())]
_DDL = "doc_id long, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited boolean, near_next boolean, form binary"


def _edited(doc, text: str, form: bytes, after: str, after_form: bytes) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    forms = form, canonical(edited), after_form
    prints = [fingerprint(f) for f in forms]
    near = [prints[0] == p and form == f for p, f in zip(prints[1:], forms[1:])]
    return doc, n, hashlib.sha256(edited.encode()).digest(), *prints[:2], *near, _form(form)


def _in_order(batches):
    """Results for all documents of a sorted partition but the last; the first and the last come with their texts."""
    schema = pa.schema([*_RESULT, ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])
    empty, held, begun, part_no = (None,) * (len(_RESULT) - 1), None, False, TaskContext.get().partitionId()
    for part in slices(batches, "text"):
        out = []
        for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
            text = text or ""
            form = canonical(text)
            if begun:
                out.append((*_edited(*held, text, form), 0, part_no, None))
            else:
                out.append((doc, *empty, 1, part_no, text))
            held, begun = (doc, text, form), True
        yield batch_of(schema, dict(zip(schema.names, zip(*out))))
    if begun:
        yield batch_of(schema, dict(zip(schema.names, zip((held[0], *empty, 2, part_no, held[1])))))


def _tails(batches):
    schema = pa.schema(_RESULT)
    for batch in batches:
        out = [_edited(doc, text, canonical(text), after, canonical(after)) for doc, text, after in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "after")))]
        yield batch_of(schema, dict(zip(schema.names, zip(*out)))) if out else batch_of(schema, {n: [] for n in schema.names})


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: its fingerprint, that of its text edited with the next document's beginning, their likenesses, and its group_id.

    Texts are shuffled once, into ranges of doc_id. Only the first and the last text of
    each range are matched across ranges, by joins on the ranges' numbers.
    """
    docs = source(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = docs.repartitionByRange(width(docs), "doc_id").sortWithinPartitions("doc_id")
    rows = cut(ordered.mapInArrow(_in_order, f"{_DDL}, kind int, part int, text string"))
    heads = rows.where("kind = 1").select("part", "text")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1))))
    order = heads.select("part").withColumn("next", following)  # a number for each range
    after = heads.select(F.col("part").alias("next"), F.col("text").alias("after"))
    tails = rows.where("kind = 2").select("part", "doc_id", "text").join(order, "part").join(after, "next").select("doc_id", "text", "after").mapInArrow(_tails, _DDL)
    printed = rows.where("kind = 0").drop("kind", "part", "text").unionByName(tails)
    hexed = lambda c: F.lower(F.hex(c))
    return equal_groups(docs, printed).select(
        "doc_id", "n_chars", hexed("edited").alias("edited_sha256"), hexed("fingerprint").alias("fingerprint"), hexed("edited_fingerprint").alias("edited_fingerprint"),
        F.col("near_edited").cast("double").alias("near_edited"), F.col("near_next").cast("double").alias("near_next"), "group_id",
    )
