"""Reply trees and chat texts against brute force and round trips."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import chat, queries

CLASH = ("tree", "id", "up", "at", "place", "path", "part", "kind", "total")
CONTROLS = st.lists(st.sampled_from(["\\", "###", "### ", "#", "</turn>", "</turn>\n", "\n", ": ", ":", "user", "é", "𝄞", "### user: ", "ok"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(CONTROLS, CONTROLS), max_size=5))
def test_turns_round_trip(said):
    parts = [chat.formatted(role, text) for role, text in said]
    assert list(chat.turns("".join(p[0] for p in parts))) == said
    for (_, text), (turn, at, length) in zip(said, parts):
        assert chat.unescaped(turn[at : at + length]) == text


def test_a_text_that_is_no_conversation_is_an_error():
    with pytest.raises(ValueError, match="no turn"):
        list(chat.turns("### user: a</turn>"))


def tree(seed: int, name, n: int) -> list[tuple]:
    """A tree with a hub, a long trunk and random replies."""
    r, rows = random.Random(seed), []
    for k in range(n):
        parent = None if k == 0 else k - 1 if k < n // 3 else 0 if k < n // 2 else r.randrange(k)
        rows.append((name, k, parent, r.choice(["user", "assistant"]), f"{name} says {k}", r.choice([0.0, 0.5, 1.0, 2.0, -1.0])))
    return rows


def best(rows, paths: int) -> dict:
    """The turns of the best branches of every tree, from all root-to-leaf paths."""
    out = {}
    trees = defaultdict(dict)
    for t, i, p, role, text, score in rows:
        trees[t][i] = (p, role, text, score)
    for t, nodes in trees.items():
        parents = {v[0] for v in nodes.values()}
        found = []
        for leaf in (i for i in nodes if i not in parents):
            way, at = [], leaf
            while at is not None and at in nodes:
                way.append(at)
                at = nodes[at][0]
            found.append((-sum(nodes[i][3] for i in way) / len(way), -len(way), leaf, way[::-1]))
        for path, (_, _, _, way) in enumerate(sorted(found)[:paths]):
            out[t, path] = [nodes[i][1:3] for i in way]
    return out


def read(segments) -> dict:
    out = defaultdict(list)
    for r in sorted(segments.collect(), key=lambda r: (str(r["tree"]), r["path"], r["first"])):
        said = list(chat.turns(r["text"]))
        assert len(out[r["tree"], r["path"]]) == r["first"] and len(said) == r["turns"]
        masked = [chat.unescaped(r["text"][s["start"] : s["start"] + s["length"]]) for s in r["loss"]]
        assert masked == [text for role, text in said if role == "assistant"]
        out[r["tree"], r["path"]] += said
    return dict(out)


SCHEMA = "tree long, id long, parent long, role string, text string, score double"


@pytest.mark.parametrize("paths", [1, 3])
def test_best_branches_brute_force(spark, paths):
    rows = [x for k, n in enumerate([1, 2, 3, 40, 300]) for x in tree(k, k, n)]
    got = read(chat.conversations(chat.branches(*chat.trees(spark.createDataFrame(rows, SCHEMA).repartition(3)), paths), segment=200))
    assert got == best(rows, paths)


def test_odd_trees(spark):
    rows = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "yes", 1.0), (1, 2, 1, "assistant", "yes", 1.0), (1, 3, 99, "user", "orphan", 0.2), (1, 4, 5, "user", "cycle", 9.0), (1, 5, 4, "user", "cycle", 9.0), (1, 6, 5, "user", "below", 9.0),
            (None, 1, None, None, None, None), (2, None, None, "user", "no id", 0.0), (3, 7, 7, "user", "itself", 5.0)]
    got = read(chat.conversations(chat.branches(*chat.trees(spark.createDataFrame(rows, SCHEMA)), 5)))
    assert got == {(1, 0): [("user", "root"), ("assistant", "yes")], (1, 1): [("user", "orphan")], (None, 0): [("", "")]}
    assert chat.digests(chat.conversations(chat.branches(*chat.trees(spark.createDataFrame([], SCHEMA))))).collect() == []


def digest(rows) -> tuple:
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()


def digested(segments) -> dict:
    return {r["tree"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(segments).collect()}


def test_chains_of_odd_rows(spark):
    r = random.Random(3)
    said = [(c, t, r.choice(["user", "assistant", "system"]), r.choice([None, "", "\\### Assistant: </turn> ok", "x" * 300, "𝄞é"])) for c in (1, 2, None) for t in [None, 0, 1, 2, 3, 3, 3]]
    said += [(5, k, "assistant" if k % 2 else "user", f"turn {k} ### </turn>\\" * 3) for k in range(700)] + [(6, 0, None, "long " * 100_000), (6, 1, "assistant", None), (7, 1, "user", "a"), (7, 1, "user", "a")]
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CLASH)
    df = spark.createDataFrame([(*x, *["clash"] * len(CLASH)) for x in said], schema).repartition(7)
    groups = defaultdict(list)
    for c, t, role, text in sorted(said, key=lambda x: (str(x[0]), x[1] is None, x[1] or 0, x[2] or "", sha256((x[3] or "").encode()).digest())):
        groups[c].append((role, text))
    want = {c: digest(rows) for c, rows in groups.items()}
    turns = chat.branches(*chat.chain(df)[:2], unique=True).cache()
    assert digested(chat.conversations(turns)) == want
    split = chat.conversations(turns, segment=500)
    assert Counter(r["tree"] for r in split.collect())[5] > 20
    assert digested(split) == want
    assert chat.branches(*chat.chain(df.limit(0))[:2]).collect() == []


def test_table(spark, sf):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        groups[r["conv_id"]].append((r["role"], r["text"]))
    planted = "\\### Assistant: </turn> ok"
    groups[-7] = [("user", planted), ("assistant", planted)]
    got = queries.op13_chat_formatting(spark, sf).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: digest(rows) for c, rows in groups.items()}
    assert all(r["formatted_chars"] > 0 for r in got)
