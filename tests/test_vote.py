"""Vote cases, reply payloads, models and sessions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from riskweave import models
from riskweave.operators import batch, evaluate, reply, segments, sessions, training, vote
from riskweave.streaming import index_feed

OUT = "id int, outputs array<struct<ordinal:int,model_id:string,available:boolean,score:double,reason:string>>"
#: scores (None: failed, "-": unavailable), level, method, mean, success, required
CASES = [
    ([99, 70, 0], "high", "majority", None, 3, 2), ([10, 50, 90], "medium", "mean_fallback", 50, 3, 2), ([None] * 3, "uncertain", "unavailable", None, 0, 2),
    ([80, 90, None], "high", "majority", None, 2, 2), ([90, None, "-"], "high", "mean_fallback", 90, 1, 2), ([90, 10], "medium", "mean_fallback", 50, 2, 2),
    ([50, 90, None], "high", "mean_fallback", 70, 2, 2), ([10, 69.998], "low", "mean_fallback", 39.999, 2, 2), ([10, 70], "medium", "mean_fallback", 40, 2, 2),
    ([50, 89.998], "medium", "mean_fallback", 69.999, 2, 2), ([50, 90, float("nan")], "high", "mean_fallback", 70, 2, 2), ([45, 69, 80], "medium", "majority", None, 3, 2),
    ([25, 80], "medium", "mean_fallback", 52.5, 2, 2), ([90], "high", "single", None, 1, 1), ([None], "uncertain", "unavailable", None, 0, 1),
]


def test_vote_cases(spark):
    rows = [(i, [(k, f"m{k}", s != "-", None if s in (None, "-") else float(s), "because") for k, s in enumerate(c[0])]) for i, c in enumerate(CASES)]
    members = vote.members(spark.createDataFrame(rows, OUT))
    got = vote.texts(vote.vote(members)).orderBy("id").collect()
    long = {r["id"]: r for r in vote.tally(members.select("id", F.inline("members")), "id").collect()}
    for r, (scores, level, method, mean, success, required) in zip(got, CASES):
        assert (r["level"], r["decision_method"], r["success_count"], r["majority_required"], r["selected_count"]) == (level, method, success, required, len(scores))
        assert r["mean_score"] == pytest.approx(mean, abs=1e-9) if mean is not None else r["mean_score"] is None
        assert r["warning"].endswith("核实。") and r["has_failures"] == (success < len(scores))
        assert (long[r["id"]]["level"], long[r["id"]]["decision_method"]) == (level, method)


def test_bad_reasons_fail(spark):
    rows = [(i, [(0, "m", True, 50.0, r)]) for i, r in enumerate(["", "  ", None, " ok "])]
    got = vote.members(spark.createDataFrame(rows, OUT)).select("id", F.inline("members")).orderBy("id").collect()
    assert [(r["status"], r["reason"]) for r in got] == [("error", "")] * 3 + [("ok", "ok")]


def test_requests(spark):
    rows = [("", ["a"]), ("  ", ["a"]), ("x" * 6001, ["a"]), (" " + "x" * 6000 + " ", ["a"]), ("x", []), ("x", ["a", "a"]), ("x", None), ("x", ["b"])]
    df = spark.createDataFrame(rows, "m string, ids array<string>").coalesce(1)
    assert [r[0] for r in df.select(vote.request_error(F.col("m"), F.col("ids"), ["a"])).collect()] == ["blank", "blank", "too_long", None, "empty", "duplicate", "no_list", "unknown_model"]


def test_replies(spark):
    good = [{"risk_score": s, "reason": "r"} for s in (0, 39.99, 40, 69.99, 70, 100)]
    bad = [{"probability": 1, "reason": "r"}, {"risk_score": True, "reason": "r"}, {"risk_score": "5", "reason": "r"}, {"risk_score": -1, "reason": "r"}, {"risk_score": 101, "reason": "r"}, {"risk_score": None, "reason": "r"}]
    bad += [{"risk_score": 1, "reason": " "}, {"risk_score": 1, "reason": ["r"]}, {"risk_score": 1, "reason": "r" * 2001}, {"risk_score": 1, "reason": "r", "x": 1}, [1]]
    wrapped = ["<think>{no}</think>```json\n" + json.dumps({"risk_score": 61, "reason": " r "}) + "\n```", "a<｜end▁of▁thinking｜>" + json.dumps({"risk_score": 61, "reason": "r"})]
    texts = [(i, t) for i, t in enumerate([*map(json.dumps, good), *wrapped, *map(json.dumps, bad), '{"risk_score": NaN, "reason": "r"}', "", "{"])]
    got = reply.checked(spark.createDataFrame(texts, "i int, reply string")).orderBy("i").collect()
    n = len(good) + len(wrapped)
    assert all(r["ok"] and r["reason"] == "r" for r in got[:n]) and not any(r["ok"] for r in got[n:])


class _Flaky(models.Chat):
    def __init__(self):
        self.calls = 0
        super().__init__(self._reply, "rate {message}")

    def _reply(self, messages, options):
        self.calls += 1
        if self.calls == 1:
            raise OSError("secret")
        return json.dumps({"risk_score": 61, "reason": messages[-1]["content"]})


class _Length:
    detected = 0

    def detect(self):
        _Length.detected += 1
        return True

    def check(self, message):
        if not message:
            raise models.CheckError("empty")
        if message == "boom":
            raise RuntimeError("secret detail")
        return float(len(message)), "length"


def test_models(spark):
    df = spark.createDataFrame([("abc",), ("",), ("x" * 101,), ("boom",)], "content string").coalesce(1)
    got = models.run(df, _Length, key=1).collect()
    assert [(r["score"], r["error"]) for r in got] == [(3.0, None), (None, "empty"), (None, "invalid score"), (None, "failed")]
    assert {r["available"] for r in models.run(df, models.Template, key=2).collect()} == {False}
    asked = models.run_chat(df.limit(1), _Flaky).first()
    assert asked["ok"] and asked["score"] == 61 and asked["reason"] == "rate abc"
    registry = models.Registry()
    _Length.detected = 0
    registry.register("length", _Length)
    registry.register("template", models.Template)
    assert [r["model_id"] for r in registry.available(spark).collect()] == ["length"]
    with pytest.raises(KeyError):
        registry.get("template")
    assert registry.get("length").check("abc") == (3.0, "length") and _Length.detected == 1
    assert models.chat("deepseek", None).options == {"temperature": 0.6, "timeout": 120}


class _Late(models.Chat):
    """Bad replies first, then a good one, each message anew."""

    BAD = ("null", '{"risk_score": true, "reason": "x"}', '{"risk_score": 101, "reason": "x"}', '{"risk_score": 1, "reason": " "}', '{"risk_score": 1}', '{"risk_score": 1, "reason": "x", "reason": "y"}', "[]", "")

    def __init__(self):
        self.asked = {}
        super().__init__(self._reply)

    def _reply(self, messages, options):
        text = messages[-1]["content"]
        self.asked[text] = self.asked.get(text, 0) + 1
        return self.BAD[int(text)] if self.asked[text] < 2 else '<think>{}</think>{"risk_score": 7.5, "reason": "late"}'


def test_bad_replies_are_asked_again(spark):
    df = spark.createDataFrame([(str(k),) for k in range(len(_Late.BAD))], "content string").coalesce(1)
    assert {(r["ok"], r["score"], r["reason"]) for r in models.run_chat(df, _Late).collect()} == {(True, 7.5, "late")}
    assert {r["ok"] for r in models.run_chat(df, _Late, attempts=1).collect()} == {False}


@pytest.mark.parametrize("text", [*_Late.BAD, '{"risk_score": 0, "reason": "x"}', 'so {"risk_score": 100.0, "reason": " x "} end', '{"risk_score": "5", "reason": "x"}', '{"risk_score": NaN, "reason": "x"}', '{"risk_score": -1, "reason": "x"}', '{"risk_score": 5, "reason": "x", "z": 1}', '{"risk_score": 5, "reason": 1}'])
def test_acceptable_is_what_is_checked(spark, text):
    from riskweave.operators import reply

    assert reply.acceptable(text) == reply.checked(spark.createDataFrame([(text,)], "reply string")).first()["ok"]


def test_model_and_its_record(spark, tmp_path):
    rows = [(f"{w} {k}", label) for k in range(30) for w, label in (("rumour spread", 1), ("report checked", 0))]
    data = spark.createDataFrame(rows, "content string, label int")
    training.save(training.fit_classifier(data, iterations=5), str(tmp_path), 60, 0.98765, "2024-01-01 00:00:00")
    meta = spark.read.json(f"{tmp_path}/train_meta").first()
    assert (meta["samples"], meta["val_accuracy"], meta["label_meaning"]["1"]) == (60, 0.9877, "谣言")
    scores = {r["content"]: r["score"] for r in training.classifier_scores(training.load(str(tmp_path)), data.limit(2)).collect()}
    assert scores["rumour spread 0"] > 50 > scores["report checked 0"]


def test_batch_keeps_stored_scores(spark):
    m = spark.createDataFrame([("f", 0, "12", 82.0), ("f", 1, "", float("nan")), ("f", 2, "", 82.0), ("f", 3, " ", 82.0)], "_file string, _row long, fake_probability string, s double")
    one = batch.scored(m, F.col("s")).orderBy("_row").collect()
    assert [(r["fake_probability"], r["outcome"]) for r in one] == [("12", "skipped"), ("", "failed"), ("82.00", "done"), (" ", "skipped")]
    two = batch.scored(m, F.col("s"), override=True)
    assert [(r["done"], r["failed"]) for r in batch.counts(two).collect()] == [(3, 1)]
    assert [tuple(r) for r in batch.checkpoints(two, every=2).collect()] == [("f", 2, 2)]


def test_evaluation_guards(spark):
    m = spark.createDataFrame([(" nan ", "虚假"), ("inf", "真实"), ("x", "中立"), ("", "虚假"), ("50", "虚假"), ("NAN", "真实")], "fake_probability string, nature string")
    assert tuple(evaluate.confusion(evaluate.samples(m)).first()) == (50.0, 1, 1, 1, 1)
    assert evaluate.label_counts(m).first()["invalid"] == 1
    empty = evaluate.metrics(evaluate.confusion(evaluate.samples(m.limit(0)))).first()
    assert empty["f1"] == 0 and evaluate.squared_error(evaluate.samples(m.limit(0))).first()["mse"] == 0


def test_sessions(spark):
    s = spark.createDataFrame([("1", "u", "2024-01-01 00:00:00"), ("2", "u", "2024-01-01 00:00:01"), ("3", "u", "never")], "session_id string, username string, created_at string")
    assert [r["session_id"] for r in sessions.active(s, "2024-01-04 00:00:00").collect()] == ["2"]
    assert len(sessions.login(s, "v", "2024-01-01 00:00:00").where("username = 'v'").first()["session_id"]) == 32
    assert sessions.find(s, "username", "").count() == 0


def test_training_split_sizes(spark):
    rows = [(f"f{i % 3}", i, f"c{i % 25}", "虚假" if i % 2 else "真实") for i in range(60)]
    data = training.dataset(spark.createDataFrame(rows, "_file string, _row long, content string, nature string"))
    parts = {r["part"]: r["count"] for r in training.split(data).groupBy("part").count().collect()}
    assert parts == {"validation": 2, "train": 23}


def test_index_stream(spark, tmp_path):
    rows = [("f", "one two", "", "", "", "", "", 0), ("g", "two", "", "", "", "", "", 0)]
    spark.createDataFrame(rows, index_feed.SCHEMA).write.parquet(str(tmp_path / "in"))
    index_feed.feed_index(index_feed.message_stream(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    assert {r["term"]: r["df"] for r in segments.Index(spark, str(tmp_path / "index")).terms().collect()} == {"one": 1, "two": 2}
