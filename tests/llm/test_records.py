"""HTML extraction, shards, media and language ID."""

from __future__ import annotations

import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from cases import TEXTS, frame, rows

from riskweave.llm import html_text, langid, media, queries, sharding
from riskweave.llm.common import new_folder

BODY = "This paragraph has more than enough words to be the text of an article. "
PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("<p>x</p", "x"),
    (f"<html><head><title>T</title><script>var a = '<p>no</p>';</script><style>p {{}}</style></head><body><header>Site</header><nav><a href='/'>Home</a></nav><article><h1>Head &amp; line</h1><p>{BODY}\n\t more</p><p>Short.</p></article><aside>See also</aside><footer>(c)</footer></body></html>", f"Head & line {BODY.strip()} more Short."),
    (f"<div id='menu'><ul><li>One</li></ul></div><div class='content'><p>{BODY}</p><p>{BODY}<b>bo</b>ld &eacute;&#x41;</p></div><div class='comments'><p>{BODY}</p></div><form><p>Name</p></form>", f"{BODY.strip()} {BODY}bold éA"),
    (f"<p>{BODY}<!-- <p>gone</p> --> kept</p><noscript>no</noscript>", f"{BODY} kept".replace("  ", " ")),
]


def test_html_cases(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert found == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract(df.limit(0)).collect() == []


def test_html_surge_and_dive():
    assert html_text.between([0, 0, 0, 9, 0, 5, 7, 0, 0, 0, 0, 2, 0, 0]) == (1, 7)
    assert html_text.between([]) == (0, 0)


def test_html_table(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.op2_html_extraction(spark, sf).collect()
    assert {r["page_id"] for r in found} == set(pages) and len(found) == len(pages)
    for r in found:
        assert r["n_chars"] == len(r["text"]) and "<p>" not in r["text"] and r["text"] == " ".join(r["text"].split())


def shards_hold(found, docs, shards: int):
    sizes = {d: len((t or "").encode()) + 1 for d, t in docs}
    assert sorted(r["doc_id"] for r in found) == sorted(sizes)
    slots: dict[int, list[int]] = {}
    for r in found:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["shard"] < shards
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    crc = {d: zlib.crc32((t or "").encode()) for d, t in docs}
    assert all(r["text_crc32"] == crc[r["doc_id"]] for r in found)


def test_shards(spark, sf, documents):
    shards_hold(sharding.shard(frame(spark), 16).collect(), [r[:2] for r in rows()], 16)
    shards_hold(queries.op6_sharding(spark, sf).collect(), documents, 16)
    assert sharding.shard(frame(spark).limit(0)).collect() == []
    same = spark.range(1000).selectExpr("7L AS doc_id", "'x' AS text")
    assert set(Counter(r["shard"] for r in sharding.shard(same).collect()).values()) <= {62, 63}


def test_shards_move_little(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    one, two = ({r["doc_id"]: r["shard"] for r in sharding.shard(df, n).collect()} for n in (16, 17))
    assert sum(one[d] != two[d] for d in one) < 4000 * 0.45
    assert one == {r["doc_id"]: r["shard"] for r in sharding.shard(df.repartition(7), 16).collect()}


def media_hold(found, docs):
    want = {}
    for doc, text in docs:
        raw = (text or "").encode()
        want[doc] = (len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))
    assert sorted(r["doc_id"] for r in found) == sorted(want)
    same: dict[bytes, set] = {}
    for r in found:
        n, payload = want[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (n, len(payload), sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["feature"] == media.features(payload)
        same.setdefault(payload, set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in same.values())


def test_media_table(spark, sf, documents):
    media_hold(queries.op9_media_columns(spark, sf).collect(), documents)


def test_media_odd_cases(spark):
    back = media.read(media.store(frame(spark).drop("payload"), new_folder(spark, "m"), "text", "doc_id")).collect()
    found = {r["id"]: bytes(r["payload"]) for r in back}
    for doc, text, *_ in rows():
        raw = (text or "").encode()
        assert found[doc] == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    assert media.read(media.store(frame(spark).limit(0), new_folder(spark, "m"), "text", "doc_id")).collect() == []


def test_gear_hash_rolls_and_cuts_recur():
    data = np.random.default_rng(3).integers(0, 256, 60_000, np.uint8)
    h = media.gear(data)
    for i in (0, 5, 31, 32, 777):
        assert h[i] == sum(int(media._GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) % (1 << 32)
    moved = np.concatenate((np.zeros(137, np.uint8), data))
    one, two = (set(media.boundaries(media.gear(x))) for x in (data, moved))
    assert len({e + 137 for e in one} & two) > 0.7 * len(one)
    assert all(b - a <= media.MOST for a, b in zip([0, *sorted(one)], sorted(one)))


def test_equal_chunks_have_one_place(spark):
    """Copies of a long text in many files: every reference to a digest has the same place, and neighbours are read at once."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(20_000))
    docs = frame(spark, [long, f"x {long}", long, f"{long} y"], parts=4)
    lists = [r["chunks"] for r in media.store(docs.drop("payload"), new_folder(spark, "m"), "text", "doc_id").collect()]
    places: dict[bytes, set] = {}
    for chunks in lists:
        for c in chunks:
            places.setdefault(bytes(c["digest"]), set()).add((c["path"], c["at"], c["stored"]))
    assert all(len(p) == 1 for p in places.values()) and sum(map(len, lists)) > 2 * len(places)
    runs = [media.joined_places([c.asDict() for c in chunks]) for chunks in lists]
    assert all([c for run in r for c in run] == [c.asDict() for c in chunks] for r, chunks in zip(runs, lists))
    assert min(len(r) for r in runs) < min(len(c) for c in lists) / 4


def test_media_where_ids_repeat_or_lack(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (3, "a"), (3, "a"), (3, None)], "doc_id long, text string")
    found = media.read(media.store(docs, new_folder(spark, "m"), "text", "doc_id")).collect()
    assert Counter((r["id"], bytes(r["payload"]).rstrip(b"\0")) for r in found) == Counter([(None, b"a"), (None, b"b"), (3, b"a"), (3, b"a"), (3, b"")])


def test_damaged_chunk_is_refused(spark):
    stored = media.store(frame(spark, ["some text"]), new_folder(spark, "m"), "text", "doc_id").toPandas()
    chunk = stored["chunks"][0][0].asDict()
    chunk["digest"] = b"0" * 16
    bad = spark.createDataFrame([(1, 9, "p", 0, [tuple(chunk.values())])], f"id long, n_bytes long, path string, row long, chunks {media.CHUNKS}")
    with pytest.raises(Exception, match="damaged"):
        media.read(bad).collect()


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op10_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    both = found.join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(both) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in both) / len(both) > 0.97
    for r in found.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1


def test_language_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = langid.accepted(docs, langid.fit(docs), langid.TIE).select("doc_id")
    gone = [r["text"] for r in docs.join(kept, "doc_id", "left_anti").collect()]
    assert not [t for t in gone if len((t or "").split()) > 10 and any(c.isalpha() for c in t)]


def test_language_learns_every_one(spark):
    """More languages than a round number of them, each with words of its own, and one doc_id for many rows."""
    rows = [(7 if k % 2 else 1000 * n + k, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}{w}" for w in ("sun", "moon", "tree", "river", "stone")), f"l{n:03}") for n in range(150) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, all_docs=150 * 2)
    assert sorted(name for name, _ in model) == [f"l{n:03}" for n in range(150)]
    classify = langid.Classifier(model)
    assert sum(classify(t)[0] == lang for _, t, lang in rows) > 0.95 * len(rows)


def test_language_where_ids_repeat_or_lack(spark):
    docs = spark.createDataFrame([(None, "the cat sat on the mat", "en"), (None, "the cat sat on the mat", "en"), (1, "die Katze sitzt", "de"), (1, "the dog", "en"), (2, None, None)], "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in found) == Counter([(None, "en"), (None, "en"), (1, "de"), (1, "en"), (2, "und")])
    assert langid.accepted(docs, langid.fit(docs), 0.0).count() == 4


def test_language_ties_go_to_the_commonest():
    model = [("xx", b"the same words in both\n"), ("aa", b"the same words in both\n")]
    assert langid.Classifier(model)("The same words in both, and more.") == ("xx", 0.0)
    assert langid.Classifier([("xx", b"\n"), ("aa", b"the same words in both\n")])("the same words in both")[0] == "aa"


def test_language_odd_cases(spark):
    labelled = spark.createDataFrame([(1, "the cat and the dog were in the house", "en"), (2, "der Hund und die Katze waren in dem Haus", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert [name for name, _ in model] == ["de", "en"]
    found = {r["doc_id"]: r for r in langid.identify(frame(spark), model).collect()}
    for doc, text, *_ in rows():
        assert (found[doc]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")), text and text[:40]
    assert langid.identify(frame(spark).limit(0), model).collect() == []
    assert langid.fit(labelled.limit(0)) == []
    assert {r["lang_pred"] for r in langid.identify(frame(spark), []).collect()} == {"und"}
    assert langid.accepted(frame(spark), model, 2.0).count() == 0
    assert len(TEXTS) == frame(spark).count()
