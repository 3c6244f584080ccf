"""Near-duplicate groups: circulant MinHash, banding, exact Jaccard, connected components.

Two permutations of a universe of 2**20 cells make all signature coordinates:
the first (a mixing hash) places a shingle, the second is read from that place
on, so coordinate k is the minimum of the second permutation shifted by k. The
coordinates of one shingle lie side by side in memory and a signature costs one
gather and one running minimum.

Documents with equal word sequences are one document from the start. Bands of the
signatures give buckets. First each member is verified against its bucket's first
document. Members of buckets that are then in more than one component are searched
again, with prefix filtering: in one order of all shingles, common ones last, a document's
link to a larger one shows in its first shingles, as many as the similarity leaves room
for. Documents that share such a shingle are swept in blocks of bounded size, the largest
component's against the others' only; what comes out is a spanning forest, never the pairs. So no link between documents that share a band
is lost, and a pair at the threshold shares one with a probability over 1 - 3e-7.

Hashes only name candidates. A link is made where the shingles themselves, as bytes, are
similar enough; equal word sequences are known by a BLAKE2 digest.

Defined results: a text without words or a null text has an empty set, is linked
with nothing and is its own component; fewer words than the shingle width make
one shingle; rows with the same doc_id are documents of their own with that id; a row
without doc_id comes after all others, its component_id is null unless it is linked with
a document that has one, and it is kept if so; repeated rows each get the same result;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST, batch_of, cut, grouped, slices, source, versioned
from .words import Words, mix

CELLS, BANDS, ROWS = 1 << 20, 32, 6
#: Documents and bytes of a block of the second search.
BLOCK, BLOCK_BYTES = 256, 1 << 23
#: Documents that are compared with one text in one task.
PART = 10_000
#: The second search ranks shingles by how common they are in at most SAMPLED documents; the RANKED most common are told apart. Only its speed hangs on these.
SAMPLED, RANKED = 20_000, 1 << 16
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


@lru_cache(maxsize=2)
def _circulant(coordinates: int) -> np.ndarray:
    """Row v: the second permutation from cell v on, as long as the signature."""
    cells = np.random.default_rng(20240229).permutation(CELLS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((cells, cells[:coordinates])), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of one set of 64-bit hashes."""
    table, least = _circulant(coordinates), np.full(coordinates, CELLS, np.uint32)
    cells = (shingles & np.uint64(CELLS - 1)).astype(np.int64)
    for i in range(0, len(cells), 4096):
        np.minimum(least, table[cells[i : i + 4096]].min(axis=0), out=least)
    return least


def band_keys(signature_: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, the band's number included."""
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in signature_.reshape(bands, rows).T:
            key = mix(key ^ column.astype(np.uint64)) + np.uint64(1)
    return key


def _signed(batches, width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("version", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.binary())])
    for part in slices(batches, "text"):
        words = Words(part["text"], lower=True)
        hashes, at = words.shingles(width)
        sets = [np.unique(hashes[a:b]) for a, b in zip(at, at[1:])]
        yield batch_of(schema, {
            "doc_id": part["doc_id"], "doc": part["doc"], "version": part["version"], "n_shingles": [len(s) for s in sets],
            "digest": [blake2b(words.plain_text(i), digest_size=32).digest() if len(s) else None for i, s in enumerate(sets)],
            "keys": [band_keys(signature(s, bands * rows), bands, rows).tobytes() if len(s) else None for s in sets],
        })


def shingles(text: bytes, width: int) -> set[bytes]:
    """The shingles themselves; a space parts their words."""
    words = text.translate(_LOWER).split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(one: set, other: set, percent: int) -> bool:
    small, large = sorted((len(one), len(other)))
    return _linked(small, small, large, percent) and _linked(len(one & other), small, large, percent)


def _linked(common, one, other, percent: int):
    return 100 * common >= percent * (one + other - common)


def _verified(batches, width: int, percent: int):
    """The pairs whose texts are similar; a text that comes again and again is taken apart once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    last, known = None, set()
    for batch in batches:
        keep = []
        for a, x, y in zip(batch["a"].to_pylist(), batch["x"], batch["y"]):
            if a != last:
                last, known = a, shingles(x.as_buffer().to_pybytes(), width)
            keep.append(similar(known, shingles(y.as_buffer().to_pybytes(), width), percent))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], schema=schema).filter(pa.array(keep, pa.bool_()))


def ordered(hashes: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A set's shingles in the order of all: those not in `common` first, then as `place` says."""
    if not len(common):
        return np.sort(hashes)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    rank = np.where(common[at] == hashes, place[at] + 1, 0)
    return hashes[np.lexsort((hashes, rank))]


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """How many of its first shingles a set of n needs to meet any larger similar set, and any smaller one."""
    with_larger = -(-2 * percent * n // (100 + percent))  # the least number in common with a set of n or more
    with_smaller = -(-percent * n // 100)
    return n - with_larger + 1, n - with_smaller + 1


def _prefixes(batches, width: int, percent: int, common: np.ndarray, place: np.ndarray):
    """(token, row, component, bytes, smaller): whether the row meets larger sets by this token, too, or only smaller ones."""
    schema = pa.schema([("token", pa.int64()), ("row", pa.int64()), ("component", pa.int64()), ("bytes", pa.int64()), ("smaller", pa.bool_())])
    for part in slices(batches, "text"):
        hashes, at = Words(part["text"], lower=True).shingles(width)
        out = []
        for a, b, row, component, size in zip(at, at[1:], part["row"].to_pylist(), part["component"].to_pylist(), part["bytes"].to_pylist()):
            tokens = np.unique(hashes[a:b])
            few, more = prefix_sizes(len(tokens), percent)
            out += [(t, row, component, size, k < few) for k, t in enumerate(ordered(tokens, common, place)[:more].view(np.int64).tolist())]
        if out:
            yield batch_of(schema, dict(zip(schema.names, zip(*out))))


def spanning_links(rows: np.ndarray, components: np.ndarray, sets: list[np.ndarray], texts: list[bytes], width: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of one block as all its links would; at most one less than the rows."""
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    posts, at = owner[order], np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(values)))))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    label, links = components.copy(), []
    exact = lru_cache(maxsize=64)(lambda i: shingles(texts[i], width))
    for i in range(len(sets)):
        mine = flat[begins[i] : begins[i + 1]]
        common = np.bincount(np.concatenate([posts[a:b] for a, b in zip(at[mine], at[mine + 1])]), minlength=len(sets))
        for j in np.flatnonzero(_linked(common, sizes[i], sizes, percent) & (label != label[i])):
            if label[j] != label[i] and similar(exact(i), exact(int(j)), percent):
                links.append((int(rows[i]), int(rows[j])))
                label[label == label[j]] = label[i]
    return links


def _swept(batches, width: int, percent: int):
    """Rows come sorted by block; a block's rows are together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[pa.RecordBatch] = []

    def links():
        t = pa.Table.from_batches(held)
        rows, labels = t["row"].to_numpy(), t["component"].to_numpy()
        if labels.min() == labels.max():
            return []
        hashes, at = Words(t["text"], lower=True).shingles(width)
        return spanning_links(rows, labels, [np.unique(hashes[a:b]) for a, b in zip(at, at[1:])], [x.as_buffer().to_pybytes() for x in t["text"]], width, percent)

    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("token", "one", "other")])
        for a, b in zip(edges := np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows])), edges[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[0][c][0] != part[c][0] for c in ("token", "one", "other")):
                found = links()
                held.clear()
                if found:
                    yield batch_of(schema, dict(zip("ab", zip(*found))))
            held.append(part)
    if held and (found := links()):
        yield batch_of(schema, dict(zip("ab", zip(*found))))


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingle hashes of a sample, sorted, and the place of each in order of how common it is."""
    share = max(1, -(-texts.count() // SAMPLED))

    def tokens(batches):
        schema = pa.schema([("token", pa.int64())])
        for part in slices(batches, "text"):
            hashes, at = Words(part["text"], lower=True).shingles(width)
            yield batch_of(schema, {"token": np.concatenate([np.unique(hashes[a:b]) for a, b in zip(at, at[1:])]).view(np.int64)})

    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("text").mapInArrow(tokens, "token long")
    counts = cut(some.groupBy("token").count().where("count > 1"))
    least, n = 2, 0  # the least count that at most RANKED tokens reach
    for r in sorted(counts.groupBy("count").agg(F.count("*").alias("n")).collect(), reverse=True):  # at most a row for each sampled document
        n += r["n"]
        if n > RANKED:
            least = r["count"] + 1
            break
    best = counts.where(F.col("count") >= least).toPandas().sort_values(["count", "token"], ascending=[False, True])  # at most RANKED rows
    hashes = best["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(hashes) - order


def components(links: DataFrame) -> DataFrame:
    """(row, component): the smallest row reachable over `links` (a, b), for every row in a link.

    Alternates the large-star and small-star operations until nothing changes; every
    round is cut, so that neither the plan nor a lost executor repeats earlier rounds.
    The links of one row with a great many others are joined, not gathered.
    """
    pairs = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct()
        pairs = cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("row"), "component").unionByName(stars.select(F.col("component").alias("row"), "component").distinct())


def _blocks(n: Column, bytes_: Column, block: int) -> Column:
    return F.greatest(F.ceil(n / block), F.ceil(bytes_ / BLOCK_BYTES)).cast("int")


def in_blocks(tokens: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(token, row, component, one, other): the documents of each group (token, n, blocks) in the pairs of blocks they meet in.

    In a group of several blocks the component with most documents has blocks of its own,
    which meet those of the others but not one another, for its documents are linked already.
    So m documents beside n near copies of one another come to m x n / block rows, and the
    copies themselves to one row each for every block of the others.
    """
    columns = ["token", "row", "component", "one", "other"]
    zero = F.lit(0).alias
    whole = grouped(tokens, groups.where("blocks = 1"), "token").select("token", "row", "component", zero("one"), zero("other"))
    large = groups.where("blocks > 1").select("token", "n")
    sizes = grouped(tokens, large, "token").groupBy("token", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sums = sizes.groupBy("token").agg(F.max(F.struct("n", "bytes", "component")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    rest = _blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"), block)
    parts = cut(sums.select("token", "n", F.col("main.component").alias("main"), _blocks(F.col("main.n"), F.col("main.bytes"), block).alias("mains"), rest.alias("rest")))
    of_main, hashed = F.col("component") == F.col("main"), F.xxhash64("row")
    mine = F.when(of_main, F.col("rest") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("rest"))).cast("int")
    last = F.when(of_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1
    met = grouped(tokens, parts, "token").select("token", "row", "component", mine.alias("mine"), F.explode(F.sequence(F.lit(0), last)).alias("with"))
    return whole.unionByName(met.withColumns({"one": F.least("mine", "with"), "other": F.greatest("mine", "with")}).select(*columns))


def second_search(buckets: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) between different components of the same bucket, and others like them, as a spanning forest."""
    labelled = buckets.join(labels, "row", "left").select("key", "row", F.coalesce("component", "row").alias("component"))
    mixed = cut(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("lo", "hi"))
    open_ = cut(grouped(labelled, mixed, "key").select("row", "component").distinct().join(texts, "row").withColumn("bytes", F.octet_length("text").cast("long")))
    common, place = _common(open_, width)
    tokens = cut(open_.mapInArrow(lambda it: _prefixes(it, width, percent, common, place), "token long, row long, component long, bytes long, smaller boolean"))
    # Tokens with the same documents are one: those documents meet once.
    who = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"who{k}") for k in (1, 2)]
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("smaller").alias("smaller"), *who).where("lo < hi AND smaller")
    shared = shared.groupBy("who1", "who2", "n", "bytes").agg(F.min("token").alias("token"))
    met = in_blocks(tokens, cut(shared.select("token", "n", _blocks(F.col("n"), F.col("bytes"), block).alias("blocks"))), block)
    swept = met.join(texts, "row")
    return swept.repartition("token", "one", "other").sortWithinPartitions("token", "one", "other").mapInArrow(lambda it: _swept(it, width, percent), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = versioned(source(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")))
    signed = cut(docs.mapInArrow(lambda it: _signed(it, width, bands, rows), "doc_id long, doc long, version binary, n_shingles long, digest binary, keys binary").withColumn("row", F.monotonically_increasing_id()))
    worded = signed.where("digest IS NOT NULL")
    first = cut(worded.groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("first"), F.count("*").alias("n")))
    unique = grouped(worded, first, "digest").where("row = first.row")
    keyed = unique.select("row", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), i -> substring(keys, i * 8 + 1, 8))")).alias("key"))
    keyed = keyed.select("row", F.conv(F.hex("key"), 16, -10).cast("long").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1"))
    buckets = cut(grouped(keyed, shared, "key"))
    wanted = worded.select("row", "doc", "version").join(buckets.select("row").distinct(), "row")
    texts = cut(docs.join(wanted, ["doc", "version"]).dropDuplicates(["doc", "version"]).select("row", "text"))
    pairs = cut(buckets.where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct())
    # A text that many others are compared with is copied, once for each PART of them.
    parts = cut(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    one = parts.join(texts.withColumnRenamed("row", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("x"))
    other = grouped(pairs, parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part").join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    links = cut(other.join(one, ["a", "part"]).mapInArrow(lambda it: _verified(it, width, percent), "a long, b long"))
    labels = cut(components(links))
    more = cut(second_search(buckets, labels, texts, width, percent, block))
    # Components of the first round stand for their members in the second.
    named = lambda c: F.coalesce(F.col(f"{c}_component"), F.col(c)).alias(c)
    over = more
    for c in "ab":
        over = over.join(labels.select(F.col("row").alias(c), F.col("component").alias(f"{c}_component")), c, "left")
    merged = components(over.select(named("a"), named("b"))).select(F.col("row").alias("component"), F.col("component").alias("merged"))
    final = labels.join(merged, "component", "left").select("row", F.coalesce("merged", "component").alias("component"))
    loose = merged.join(labels.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("row"), F.col("merged").alias("component"))
    members = cut(final.unionByName(loose).join(first.select(F.col("first.row").alias("row"), F.col("first.doc").alias("doc")), "row"))
    named = grouped(members, cut(members.groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("n"))), "component").select("row", "least")
    rooted = cut(first.join(named, first["first.row"] == named["row"], "left").select("digest", "n", F.coalesce("least", "first.doc").alias("least")))
    component = F.when(F.col("least") != LAST, F.col("least"))
    result = grouped(worded.select("digest", "doc_id", "n_shingles"), rooted, "digest").select("doc_id", "n_shingles", component.alias("component_id"))
    empty = signed.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
