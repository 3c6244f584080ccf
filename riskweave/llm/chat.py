"""Chat training texts from reply trees.

A message names the message it replies to. Self-joins double the reach of every message's
link (its ancestor 1, 2, 4, ... steps up) until none reaches further, so a branch of any
length takes as many joins as its length has binary digits. By these links each leaf finds its
root and the sum of the scores on its way; a tree's branches rank by mean score, the longer
one and then the leaf that comes first among equals. The messages of each chosen branch are
enumerated by the same links, from the leaf up, and every branch is formatted as one
conversation.

A turn is `### role: text</turn>` and a line end. A backslash stands before every backslash,
`###` and `</turn>` inside a text, in a role before a colon, too; so control strings in texts
are no marks, and reading back gives the same turns. The loss mask has the places of the
assistant's texts, in code points.

Turns are range-sorted by branch and place; a task writes a conversation as one row, or, if
it is longer than SEGMENT or crosses the border of a range, as segments in order. Joined, the
segments are the conversation. So no conversation, however long, is gathered in one task. Only
`digests`, which needs a running hash, streams the conversations of several segments through
the tasks that hold them, one segment at a time.

Defined results: null texts and roles are empty; a message whose parent is missing starts a
tree; messages in a cycle of replies are on no branch and left out; so are rows without id;
rows with the same id in a tree are one message, with the least parent and score and the least
role and text of them; a null tree id is one tree. `chain` orders rows by turn, rows without
turn last, equal turns by role and the digest of the text, repeated rows each a turn. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, LAST, batch_of, cut, discard, slices, written

#: Characters after which a conversation goes on in another segment.
SEGMENT = 1 << 20
#: Compression of stored tables.
CODEC = "zstd"
ASSISTANT = "assistant"
_CONTROL, _ROLE_CONTROL = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: One turn: marks count only where no backslash takes them for text.
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): ((?:\\(?:\\|###|</turn>)|(?!</turn>)[^\\])*)</turn>\n", re.S)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the place and length of its text in it."""
    head = f"### {_ROLE_CONTROL.sub(lambda m: chr(92) + m[0], role)}: "
    body = _CONTROL.sub(lambda m: chr(92) + m[0], text)
    return f"{head}{body}</turn>\n", len(head), len(body)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def turns(conversation: str):
    """(role, text) of each turn of a formatted conversation."""
    at = 0
    while at < len(conversation):
        turn = _TURN.match(conversation, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        yield unescaped(turn[1]), unescaped(turn[2])
        at = turn.end()


# ------------------------------------------------------------------ reply trees


def chain(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """The rows of each conversation as a tree, each a reply to the one before: nodes (tree, id, parent, score 0), texts (tree, id, role, text), and the folder these are stored in."""
    plain = rows.select(F.col(conv_id).cast("long").alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    stored, folder = written(plain.withColumn("id", F.monotonically_increasing_id()), "turns", CODEC)
    narrow = stored.select("tree", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "id")
    order = [F.col("tree"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("digest")]
    linked = cut(narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "id").mapInArrow(_links, "tree long, id long, parent long, part int, kind int"))
    # A partition's first row follows the last one of the partition before, if that is of its conversation.
    edge = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("tree", "id")))
    edges = linked.where("kind > 0").groupBy("part").agg(edge(1).alias("first"), edge(2).alias("last"))  # a row for each partition
    last = F.lag("last").over(Window.orderBy("part"))
    before = edges.select("first", last.alias("last")).where("last IS NOT NULL AND first.tree <=> last.tree").select(F.col("first.id").alias("id"), F.col("last.id").alias("before"))
    nodes = linked.where("kind < 2").join(F.broadcast(before), "id", "left").select("tree", "id", F.coalesce("parent", "before").alias("parent"), F.lit(0.0).alias("score"))
    return nodes, stored.select("tree", "id", "role", "text"), folder


def trees(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and texts of messages (tree, id, parent, role, text, score)."""
    return messages.select("tree", "id", "parent", "score"), messages.select("tree", "id", "role", "text")


def _links(batches):
    """The row before each row of a sorted partition, if it is of the same tree; kind 1 marks the partition's first and last rows."""
    schema = pa.schema([("tree", pa.int64()), ("id", pa.int64()), ("parent", pa.int64()), ("part", pa.int32()), ("kind", pa.int32())])
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        trees, ids = batch["tree"].to_pylist(), batch["id"].to_pylist()
        parents, kinds = [], [0] * len(ids)
        for k, (tree, id_) in enumerate(zip(trees, ids)):
            if last is None:
                kinds[k] = 1
            parents.append(last[1] if last is not None and last[0] == tree else None)
            last = tree, id_
        yield batch_of(schema, {"tree": trees, "id": ids, "parent": parents, "part": [part] * len(ids), "kind": kinds})
    if last is not None:  # once more, as an edge
        yield batch_of(schema, {"tree": [last[0]], "id": [last[1]], "parent": [None], "part": [part], "kind": [2]})


def jumps(links: DataFrame, weights: DataFrame, kept: Callable[[DataFrame], DataFrame] = cut) -> list[DataFrame]:
    """Tables (tree, id, up, total): the ancestor 1, 2, 4, ... steps up, and the sum of the weights from `id` to below it.

    Links of a message that very many reply to join by broadcast, fewer than HEAVY of them;
    so no task has all of one. Messages in cycles go on for ever: tables end when the reach is
    beyond the number of messages.
    """
    first = kept(links.join(weights, ["tree", "id"]).select("tree", "id", "up", F.col("weight").alias("total")))
    n = first.count()
    fans = first.groupBy("tree", "up").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    out = [first] if n else []
    while out and 1 << len(out) <= n:
        reach = out[-1]
        above = reach.select("tree", F.col("id").alias("up"), F.col("up").alias("over"), F.col("total").alias("more"))
        longer = kept(_joined(reach, above, fans, kept).select("tree", "id", F.col("over").alias("up"), (F.col("total") + F.col("more")).alias("total")))
        if longer.isEmpty():
            break
        out.append(longer)
    return out


def _joined(left: DataFrame, above: DataFrame, plain: bool, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Join on (tree, up), unique in `above`; hot ones of `left` are broadcast, unless every message has one reply at most."""
    key = ["tree", "up"]
    if plain:
        return left.join(above, key)
    counts = kept(left.groupBy(*key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = kept(above.join(counts.where(F.col("_n") * HEAVY > total), key).drop("_n"))  # fewer than HEAVY rows
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(above, key))


def branches(nodes: DataFrame, texts: DataFrame, paths: int = 1, unique: bool = False, kept: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(tree, path, place, n_turns, role, text): the turns of the `paths` best branches of each tree, path from 0, place from 0.

    Texts are moved once, to their places. `unique` says that no id repeats, as in `chain`;
    `kept` stores the tables between the steps.
    """
    key = ["tree", "id"]
    keyed = lambda df, *more: df.select(F.coalesce(F.col("tree").cast("long"), F.lit(LAST)).alias("tree"), F.col("id").cast("long").alias("id"), *more).where("id IS NOT NULL")
    nodes = keyed(nodes, F.col("parent").cast("long").alias("parent"), F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    texts = keyed(texts, "role", "text")
    if not unique:
        nodes = nodes.groupBy(*key).agg(F.min(F.struct("parent", "score")).alias("row")).select(*key, "row.*")
        texts = texts.groupBy(*key).agg(F.min(F.struct("role", "text")).alias("said")).select(*key, "said.*")
    nodes = kept(nodes)
    links = nodes.where("parent IS NOT NULL").select(*key, F.col("parent").alias("up")).join(nodes.select("tree", F.col("id").alias("up")), ["tree", "up"], "left_semi")
    ups = jumps(links, nodes.select(*key, F.col("score").alias("weight")), kept)
    answered = ups[0].select("tree", F.col("up").alias("id")).distinct() if ups else None
    leaves = nodes.select(*key, "score")
    if answered is not None:
        leaves = leaves.join(answered, key, "left_anti")
    # From each leaf by the longest links first, to its root: how far it is, and the scores on the way.
    climbed = leaves.select("tree", F.col("id").alias("leaf"), F.col("id").alias("at"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("sum"))
    for k in reversed(range(len(ups))):
        up = ups[k].select("tree", F.col("id").alias("at"), F.col("up"), "total")
        climbed = climbed.join(up, ["tree", "at"], "left").select("tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("steps") + F.when(F.col("up").isNull(), 0).otherwise(1 << k)).alias("steps"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"))
    if ups:  # what still has a parent goes round in a cycle
        climbed = climbed.join(ups[0].select("tree", F.col("id").alias("at")), ["tree", "at"], "left_anti")
    rooted = climbed.join(nodes.select("tree", F.col("id").alias("at"), "parent", "score"), ["tree", "at"])
    mean = (F.col("sum") + F.col("score")) / (F.col("steps") + 1)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(mean.desc(), F.desc("steps"), "leaf"))
    chosen = kept(rooted.withColumn("rank", rank).where(F.col("rank") <= paths).select("tree", (F.col("rank") - 1).cast("int").alias("path"), F.col("leaf").alias("id"), "steps"))
    # The messages on each chosen branch: a leaf's ancestor at the longest link, then of both the ones at the next, down to links of one step; so only the last rounds have many rows.
    on_path = chosen.select("tree", "path", "id", F.col("steps").alias("place"), (F.col("steps") + 1).alias("n_turns"))
    for k in reversed(range(len(ups))):
        further = on_path.join(ups[k].select(*key, "up"), key).select("tree", "path", F.col("up").alias("id"), (F.col("place") - (1 << k)).alias("place"), "n_turns")
        on_path = kept(on_path.unionByName(further))
    tree = F.when(F.col("tree") != LAST, F.col("tree")).alias("tree")
    return on_path.join(texts, key).select(tree, "path", "place", "n_turns", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


# ------------------------------------------------------------------ texts

_SEGMENT = "tree long, path int, first long, turns long, n_turns long, text string, loss array<struct<start: long, length: long>>"
_SEGMENTS = pa.schema([("tree", pa.int64()), ("path", pa.int32()), ("first", pa.int64()), ("turns", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def _segments(batches, most: int):
    key, first, count, n_turns, size, parts, loss = None, 0, 0, 0, 0, [], []

    def row():
        return {"tree": [key[0]], "path": [key[1]], "first": [first], "turns": [count], "n_turns": [n_turns], "text": ["".join(parts)], "loss": [loss]}

    for part in (s for s in slices(batches, "text")):
        for tree, path, place, n, role, text in zip(*(part[c].to_pylist() for c in ("tree", "path", "place", "n_turns", "role", "text"))):
            if count and ((tree, path) != key or size >= most):
                yield batch_of(_SEGMENTS, row())
                count, size, parts, loss = 0, 0, [], []
            if not count:
                key, first, n_turns = (tree, path), place, n
            turn, at, length = formatted(role, text)
            if role == ASSISTANT:
                loss.append({"start": size + at, "length": length})
            parts.append(turn)
            size += len(turn)
            count += 1
    if count:
        yield batch_of(_SEGMENTS, row())


def conversations(turns_: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(tree, path, first, turns, n_turns, text, loss): formatted segments of the branches' turns; most conversations are one."""
    order = ["tree", "path", "place"]
    rows = turns_.select(*order, "n_turns", "role", "text")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _batched(_segments(it, segment)), _SEGMENT)


def _batched(rows, most: int = 1 << 20):
    """Small batches together, up to `most` bytes."""
    held, size = [], 0
    for batch in rows:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _Digest:
    def __init__(self, tree, path, n_turns):
        self.tree, self.path, self.n_turns = tree, path, n_turns
        self.seen = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, said in turns(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.seen += 1
        for span in loss:
            said = unescaped(text[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.tree, self.path, self.seen, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = "tree long, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("tree", pa.int64()), ("path", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digested(batches):
    """One row for each conversation; its segments come one after another."""
    now = None
    for part in slices(batches, "text"):
        out = []
        for tree, path, n, text, loss in zip(*(part[c].to_pylist() for c in ("tree", "path", "n_turns", "text", "loss"))):
            if now is None or (now.tree, now.path) != (tree, path):
                if now is not None:
                    out.append(now.row())
                now = _Digest(tree, path, n)
            now.add(text, loss)
        if out:
            yield batch_of(_DIGESTS, dict(zip(_DIGESTS.names, zip(*out))))
    if now is not None:
        yield batch_of(_DIGESTS, dict(zip(_DIGESTS.names, zip(now.row()))))


def digests(segments: DataFrame) -> DataFrame:
    """(tree, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts."""
    columns = ["tree", "path", "first", "n_turns", "text", "loss"]
    whole = segments.where("turns = n_turns").select(*columns)
    split = segments.where("turns < n_turns").select(*columns).repartition("tree", "path").sortWithinPartitions("tree", "path", "first")
    return whole.mapInArrow(_digested, _DIGEST).unionByName(split.mapInArrow(_digested, _DIGEST))


def write_conversations(nodes: DataFrame, texts: DataFrame, paths: int = 1, segment: int = SEGMENT, unique: bool = False) -> tuple[DataFrame, str]:
    """Format the best branches of all reply trees and write them as Parquet; the table read from there, and its folder."""
    steps = []

    def kept(df: DataFrame) -> DataFrame:
        table, folder = written(df, "links", CODEC)
        steps.append(folder)
        return table

    result = written(conversations(branches(nodes, texts, paths, unique, kept), segment), "conversations", CODEC)
    discard(nodes.sparkSession, *steps)
    return result
