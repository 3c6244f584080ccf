"""Rows that may have one of some keys, by a bit map; texts that lose nothing stay out of shuffles."""

from __future__ import annotations

import random
import time

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from riskweave.llm import substring
from riskweave.llm.common import parted


@pytest.mark.parametrize("most", [64, 1 << 10, 1 << 26])
@pytest.mark.parametrize("n", [0, 1, 500])
def test_rows_with_a_key_are_all_among_the_first(spark, most, n):
    df = spark.range(2000).select((F.col("id") - 1000).alias("k"), F.lit(1).alias("at"), F.lit(2).alias("bits"), F.lit(3).alias("a.b"))
    keys = spark.range(n).select((F.col("id") * 3 - 700).alias("k"))
    some, others = parted(df.union(df.limit(3)), "k", keys, most)
    assert some.columns == others.columns == df.columns
    one, two = [r["k"] for r in some.collect()], [r["k"] for r in others.collect()]
    assert sorted(one + two) == sorted([*range(-1000, 1000), *(r["k"] for r in df.limit(3).collect())])
    found = {r["k"] for r in keys.collect()}
    assert not found & set(two) and found & set(range(-1000, 1000)) <= set(one)
    assert most < 1 << 26 or len(one) <= 1.2 * n + 4


def shuffled(spark) -> int:
    time.sleep(1)  # for the listener
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


@pytest.mark.parametrize("stage", ["pipeline", "op4"])
def test_texts_that_lose_nothing_are_not_shuffled(spark, tmp_path, stage):
    r = random.Random(3)
    passage = " ".join(f"{r.getrandbits(240):060x}" for _ in range(60))
    texts = [" ".join(f"{r.getrandbits(240):060x}" for _ in range(400)) for _ in range(200)]
    texts[7], texts[90] = f"a {passage} b", f"c {passage} d"
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/in")
    docs, before = spark.read.parquet(f"{tmp_path}/in"), shuffled(spark)
    found = {x["doc_id"]: x["text"] for x in (pipeline.repeats(spark, docs, "") if stage == "pipeline" else substring.remove_repeats(docs)).collect()}
    assert found == {i: "c d" if i == 90 else t for i, t in enumerate(texts)}
    assert shuffled(spark) - before < sum(map(len, texts)) / 4
