"""Language identification by compression.

Each language has a zstandard raw-content dictionary: a bounded sample of its labelled
texts. A text is compressed with every dictionary, in blocks, so that all of a long text
counts and not only its beginning; the language whose dictionary gives the fewest bytes
wins. Dictionaries and texts are in lower case. The margin is the saving over the second
best; a narrow one is taken again at a higher compression level. Sizes that still tie, or
nearly, are taken a third time with each dictionary in several parts and in smaller blocks:
the bytes over all parts are a finer measure, which long texts that compress mostly by
themselves and short ones of few bytes need. What is then still narrow can be rejected.

Null texts and texts without a letter are `und` with score 0. Equal sizes go to the language
first in order, that is, with the most labelled rows. Without any labelled text everything is `und`.
Rows with a null or repeated doc_id are documents of their own, and repeated rows have equal
results; an empty table gives an empty one. Long texts count whole, in blocks. Only the
columns named are read; `accepted` passes all others on.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, slices, source

#: The sample: most documents and bytes of a language, most characters of one document, so that no long one fills a dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_CHARS = 200, 1 << 16, 1024
#: Documents and bytes of all languages together; of more languages than these hold in full each has an equal share, and every one has a dictionary.
ALL_DOCS, ALL_BYTES = 128 * SAMPLE_DOCS, 128 * SAMPLE_BYTES
#: Bytes of a block, compression levels of all texts and of those with a margin below NARROW.
BLOCK, LEVELS, NARROW = 2048, (9, 12), 0.02
#: The third measure: for margins below TIE, with PARTS of each dictionary, in blocks of FINE bytes, at the last level.
TIE, PARTS, FINE = 0.002, 4, 512
_LETTER = re.compile(r"[^\W\d_]")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, sample_chars: int = SAMPLE_CHARS, all_docs: int = ALL_DOCS, all_bytes: int = ALL_BYTES) -> list[tuple[str, bytes]]:
    """The dictionaries: (language, content), those with the most labelled rows first, one for every language.

    A language's comes from at most sample_chars characters each of sample_docs rows, those with the least hashes of doc_id.
    """
    labelled = source(labelled, doc_id=doc_id, text=text, lang=lang).where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    names = [r["lang"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]  # a row for each language
    docs, size = (max(1, min(most, total // max(1, len(names)))) for most, total in ((sample_docs, all_docs), (sample_bytes, all_bytes)))
    ranked = lambda df, *order: df.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= docs).drop("k")
    ids = ranked(labelled.select("lang", "h"), "h").distinct()  # at most all_docs
    some = labelled.join(F.broadcast(ids), ["lang", "h"], "left_semi").select("lang", "h", F.substring("text", 1, sample_chars).alias("text"))
    content: dict[str, bytes] = {}
    for r in sorted(ranked(some, "h", "text").collect(), key=lambda r: (r["h"], r["text"])):  # at most all_docs
        have = content.get(r["lang"], b"")
        if len(have) < size:
            content[r["lang"]] = have + (r["text"].lower() + "\n").encode()[: size - len(have)]
    return [(name, content[name]) for name in names if name in content]


def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], block: int = BLOCK, levels: tuple[int, ...] = LEVELS, narrow: float = NARROW, tie: float = TIE, parts: int = PARTS, fine: int = FINE):
        self.languages, contents = [name for name, _ in dictionaries], [content for _, content in dictionaries]
        whole = [([[_coder(c, level)] for c in contents], block, narrow) for level in levels]
        cuts = [[c[len(c) * k // parts : len(c) * (k + 1) // parts] for k in range(parts)] for c in contents]
        #: Measures in order: the coders of each language, bytes of a block, the margin below which the next one is asked.
        self.measures = [*whole[:-1], (whole[-1][0], block, tie), ([[_coder(x or c, levels[-1]) for x in few] for c, few in zip(contents, cuts)], fine, 0.0)]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        data = text.lower().encode()
        for coders, block, enough in self.measures:
            blocks = [data[i : i + block] for i in range(0, len(data), block)]
            sizes = [sum(len(c.compress(b)) for c in few for b in blocks) for few in coders]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min(s for i, s in enumerate(sizes) if i != best)
            margin = (second - sizes[best]) / second
            if margin >= enough:
                break
        return self.languages[best], margin


def _identified(batches, dictionaries):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    classify = Classifier(dictionaries)
    for part in slices(batches, "text"):
        names, scores = zip(*map(classify, part["text"].to_pylist()))
        yield batch_of(schema, {"doc_id": part["doc_id"], "lang_pred": names, "score": scores})


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, lang_pred, score (the margin). Needs no shuffle; the dictionaries, at most ALL_BYTES or a byte a language, go with the tasks."""
    docs = source(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    return docs.mapInArrow(lambda it: _identified(it, sent.value), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, dictionaries: list[tuple[str, bytes]], least: float, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose language is certain by a margin of `least` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    inner, at = docs.toDF(*(f"_{k}" for k in range(len(docs.columns)))), docs.columns.index(text)  # names of any kind

    def keep(batches):
        classify = Classifier(sent.value)
        for part in slices(batches, f"_{at}"):
            sure = [name != "und" and score >= least for name, score in map(classify, part[f"_{at}"].to_pylist())]
            yield part.filter(pa.array(sure, pa.bool_()))

    return inner.mapInArrow(keep, inner.schema).toDF(*docs.columns)
