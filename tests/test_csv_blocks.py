"""A CSV file read in blocks has the rows that it has in one piece."""

from __future__ import annotations

import csv
import io
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.sources import csv_blocks
from riskweave.sources import messages as src

PIECES = st.lists(st.sampled_from(['"', '""', ",", "\n", "\r\n", "a", "é", ' "', '",', '\n"', "x" * 9, '"a\nb",', "\r"]), max_size=60).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_blocks_find_every_record(text, size):
    """The walk over the blocks tells the begins of records that a reader of the whole text finds, stray quotes included."""
    data = np.frombuffer(("h,i\n" + text).encode(), np.uint8)
    records = list(csv.reader(io.StringIO("h,i\n" + text, newline="")))
    blocks = [data[a : a + size] for a in range(0, len(data), size)]
    quoted, found, rows = False, 0, 0
    for k, block in enumerate(blocks):
        r = csv_blocks.report(block, int(blocks[k - 1][-1]) if k else -1, quoted)
        quoted, found, rows = r.state, found + r.records, rows + r.rows
    stray = any(q and f not in b',\n\r"' for q, f in zip(data[1:] == 0x22, data[:-1].tolist()))
    if not stray:
        assert found == len(records) and rows == sum(map(bool, records)) - 1


def content(r: random.Random) -> str:
    return "".join(r.choice(["word", " ", '"', '""', ",", "\n", "\r\n", "消息", "NA", "é", "\n\n"]) for _ in range(r.choice([0, 1, 5, 40])))


@pytest.mark.parametrize(("end", "last"), [("\n", True), ("\r\n", True), ("\n", False), ("\r\n", False)])
def test_equals_the_whole_file(spark, tmp_path, end, last):
    r = random.Random(7)
    rows = [[content(r), r.choice(["真实", "", "NA"]), "extra", str(k)] for k in range(400)]
    rows[200][0] = "long \n" * 3000  # longer than blocks
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["content", "nature", "other", "source"])
    for k, row in enumerate(rows):
        writer.writerow(row if k % 50 else row[:2])
        if k % 33 == 0:
            out.write(end)
    text = out.getvalue()
    (tmp_path / "a b.csv").write_bytes(("﻿" + (text if last else text.rstrip("\r\n"))).encode())
    (tmp_path / "small.csv").write_text("content\nx\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("content,nature")
    got = lambda df: sorted(map(tuple, df.select("_file", "_row", "_signature", "content", "nature", "source").collect()))
    whole, size = got(src.load_all(spark, str(tmp_path))), 2048
    assert len(whole) == 401
    df = src.load_all(spark, str(tmp_path), large=0, block=size)
    assert len(csv_blocks.blocks_of(spark, [csv_blocks.File("f", path := str(tmp_path / "a b.csv"), os.path.getsize(path), [], False)], size)) >= 8
    assert got(df) == whole
    if end == "\r\n" and not last:
        assert got(src.load_all(spark, str(tmp_path), large=0, block=301)) == whole


def test_stray_quotes_are_characters(spark, tmp_path):
    text = 'content,source\n5" disk,a\n"x""y","b"\nsay "hi",c\n""" ""\n",d\n'
    (tmp_path / "f.csv").write_text(text)
    for size in (3, 7, 1000):
        rows = csv_blocks.read_blocks(spark, [csv_blocks.File("f.csv", str(tmp_path / "f.csv"), len(text), ["content", "source"], False)], ("content", "source"), size).orderBy("_row").collect()
        assert [(r["content"], r["source"], r["_row"]) for r in rows] == [('5" disk', "a", 0), ('x"y', "b", 1), ('say "hi"', "c", 2), ('" "\n', "d", 3)]


def test_small_blocks_share_tasks(spark, tmp_path):
    """Tasks grow with the bytes, not with the number of blocks."""
    assert csv_blocks.tasks(spark, 100_000, 1 << 16) == 196 and csv_blocks.tasks(spark, 3, 5) == 3
    (tmp_path / "f.csv").write_text("content\n" + "some words\n" * 300)
    size = (tmp_path / "f.csv").stat().st_size
    df = csv_blocks.read_blocks(spark, [csv_blocks.File("f.csv", str(tmp_path / "f.csv"), size, ["content"], False)], ("content",), 16)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < size // 16
    assert sorted(r["_row"] for r in df.collect()) == list(range(300))
