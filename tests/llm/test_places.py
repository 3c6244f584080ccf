"""Shards against the ring itself, forced cuts on the table, and rows whose ids repeat or lack."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import xxhash
from cases import frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import bpe, packing, sharding, token_files
from riskweave.llm.common import new_folder

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [(None, "first text"), (None, "first text"), (None, None), (3, "a b c"), (3, "a b c"), (3, "other words"), (2, "")]


def odd(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, _kind string").repartition(3)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def test_rows_overflow_clockwise_past_full_shards(spark):
    """A row is at the first place clockwise from its hash whose shard isn't full, or was passed by others before it was."""
    shards, n = 16, 5000
    df = spark.range(n).selectExpr("id AS doc_id", "'x' AS text")
    at = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    found = {r["doc_id"]: r["shard"] for r in sharding.shard(df, shards).collect()}
    places = sorted((signed(xxhash.xxh64_intdigest(f"{s}/{v}")), s) for s in range(shards) for v in range(sharding.VIRTUAL))
    load, room = Counter(found.values()), {s: n // shards + (s < n % shards) for s in range(shards)}
    assert load == room
    home = 0
    for doc, shard in found.items():
        k = bisect_left(places, (at[doc], -1))
        passed = []
        while places[k % len(places)][1] != shard:
            passed.append(places[k % len(places)][1])
            k += 1
        home += not passed
        assert all(load[s] == room[s] for s in passed)
    assert home > 0.8 * n
    natural = Counter(places[bisect_left(places, (h, -1)) % len(places)][1] for h in at.values())
    assert home >= sum(min(natural[s], room[s]) for s in room) * 0.9  # what a full shard turns away is all that moves on


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    one, two = ({r["doc_id"]: r["shard"] for r in sharding.shard(df, n).collect()} for n in (16, 17))
    assert sum(one[d] != two[d] for d in one) < 0.2 * len(one)


def test_every_pre_token_is_cut_at_its_forced_pairs(documents):
    """Counted over the whole table; and the pieces encode to the library's ids."""
    codec, library = bpe.word_codec(WORDS), Tokenizer.from_file(WORDS)
    library.no_truncation()
    cuts = pre_tokens = 0
    for _, text in documents:
        for word in codec._words(text or ""):
            for pre in codec._pre_tokens(word):
                marked = pre + b"\xff"
                pieces = codec.fragments(marked)
                forced = sum(bool(codec.never[a, b]) for a, b in zip(marked, marked[1:]))
                assert b"".join(pieces) == marked and len(pieces) == forced + 1
                cuts, pre_tokens = cuts + forced, pre_tokens + 1
    assert pre_tokens > 10_000
    rare = "qж中x zqþЖ \U0001f600xαб ßกq"
    assert sum(len(codec.fragments(p + b"\xff")) - 1 for w in codec._words(rare) for p in codec._pre_tokens(w)) > 0
    assert codec.encode(rare)[0] == b"".join(i.to_bytes(4, "little") for i in library.encode(rare, add_special_tokens=False).ids)


def test_packing_where_ids_repeat_or_lack(spark):
    found = packing.pack_documents(odd(spark), BYTE).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in ODD)
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(ODD)


def test_codec_where_ids_repeat_or_lack(spark):
    found = Counter((r["doc_id"], r["decoded"]) for r in bpe.encode_words(odd(spark), WORDS).collect())
    assert {d: sum(n for (x, _), n in found.items() if x == d) for d in (None, 2, 3)} == {None: 3, 2: 1, 3: 3}
    assert max(found.values()) == 2


def test_token_files_where_ids_repeat_or_lack(spark):
    files = token_files.write_token_files(odd(spark), BYTE, new_folder(spark, "t"), 2)
    found = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_files.read_token_files(files).collect())
    assert Counter(d for *_, d in found) == Counter(d for d, _ in ODD)
    at = 0
    for start, n, _ in found:
        assert start == at
        at += n
    assert [d for *_, d in found] == sorted((d for d, _ in ODD), key=lambda d: -1 if d is None else d)


def test_shards_where_ids_repeat_or_lack(spark):
    found = sharding.shard(odd(spark), 4).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in found) == Counter((d, zlib.crc32((t or "").encode())) for d, t in ODD)
    assert len({(r["shard"], r["slot"]) for r in found}) == len(ODD)
    assert sharding.shard(frame(spark).limit(0), 4).collect() == []
