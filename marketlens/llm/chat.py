"""Chat formatting: conversations that share initial turns as a prefix tree.

Every turn is formatted, escaped and tokenised; conversations are sorted by the hashes of their
prefixes, so that those with common turns are neighbours, in one order over all partitions. In
that order a conversation owns the turns that the one before does not have: emitting owned turns
one after another walks the tree depth-first and emits shared tokens once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.packing import encoding, text_ids
from marketlens.session import stored

OPEN, CLOSE = "<turn>", "</turn>\n"
LEARNED_ROLE = "assistant"
MARK = 8  # bytes of a prefix's hash; prefixes that differ collide with chance 2^-64 a pair


def escaped(text: str) -> str:
    """A text without ``<``, so that it holds no control string."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "n": "\n"}.get(m[1], m[1]), text, flags=re.DOTALL)


CONVERSATION = "conv_id long, key binary, lengths binary, ids binary"


def _formatted(batches, path: str):
    """Turns sorted by conversation to a row per conversation: the hashes of its prefixes, for
    each turn the numbers of ids of its head, text and end, and all ids."""
    ids_of = functools.lru_cache(10_000)(functools.partial(text_ids, path))
    now, key, lengths, ids, chain, out = None, [], [], [], b"", []

    def row():
        return (now[0], b"".join(key), np.array(lengths, "<i8").tobytes(), b"".join(ids))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["conv_id", "key", "lengths", "ids"])

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if now is None or now[0] != conv_id:
                if now is not None:
                    out.append(row())
                now, key, lengths, ids, chain = (conv_id,), [], [], [], b""
            parts = [ids_of(OPEN + escaped_role(role) + "\n"), text_ids(path, escaped(text)), ids_of(CLOSE)]
            chain = hashlib.blake2b(chain + f"{len(role.encode())} ".encode() + role.encode() + text.encode(), digest_size=16).digest()
            key.append(chain[:MARK])
            lengths += [len(p) // 4 for p in parts]
            ids += parts
        if out:
            yield batch_of(out)
            out = []
    if now is not None:
        yield batch_of([row()])


def _shared(a: bytes, b: bytes) -> int:
    """How many leading prefixes two keys have in common."""
    n = min(len(a), len(b)) // MARK
    same = np.frombuffer(a[: n * MARK], "<u8") != np.frombuffer(b[: n * MARK], "<u8")
    return int(np.argmax(same)) if same.any() else n


PLACED = "part long, seq long, conv_id long, lengths binary, own_ids binary, own_from long, like_first long, places binary, first_key binary, last_key binary"


def _placed(batches):
    """Conversations in order, with what each owns and where its turns begin.

    Places are counted from the task's start, as if its first conversation owned all its turns;
    ``like_first`` turns are those of that first one, which an earlier task may own. The first
    row has the task's first key and the last row, which only repeats its last, the last key."""
    from pyspark import TaskContext

    part, seq, at, before, places, like = TaskContext.get().partitionId(), 0, 0, None, [], 0
    first = None
    for batch in batches:
        out = []
        for conv_id, key, lengths, ids in zip(*(c.to_pylist() for c in batch.columns)):
            n = np.frombuffer(lengths, "<i8").reshape(-1, 3).sum(axis=1)
            own = 0 if before is None else _shared(before, key)
            like = len(n) if before is None else min(like, own)
            begin = at + np.cumsum(n[own:]) - n[own:]
            places = [*places[:own], *begin.tolist()]
            at += int(n[own:].sum())
            skip = 4 * int(n[:own].sum())
            first = key if before is None else first
            before = key
            out.append((part, seq, conv_id, lengths, ids if seq == 0 else ids[skip:], own, like, np.array(places, "<i8").tobytes(), key if seq == 0 else None, None))
            seq += 1
        if out:
            yield _rows(out)
    if before is not None:
        yield _rows([(part, seq, None, np.array([at], "<i8").tobytes(), None, len(places), like, np.array(places, "<i8").tobytes(), None, before)])


def _rows(rows):
    kinds = (*[pa.int64()] * 3, *[pa.binary()] * 2, *[pa.int64()] * 2, *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PLACED.split(", ")])


@dataclass
class Start:
    """Of a task: where its tokens begin, how many turns of its first conversation earlier tasks
    own and where those begin, and the number of their tokens."""

    base: int
    shared: int
    places: list[int]
    tokens: int


def _starts(ends: list) -> dict[int, Start]:
    """Starts of all tasks from the first and last conversation of each, task by task."""
    starts, base, key, places = {}, 0, b"", []
    for r in sorted(ends, key=lambda r: r["part"]):
        n = np.frombuffer(r["first_lengths"], "<i8").reshape(-1, 3).sum(axis=1)
        shared = _shared(key, r["first_key"])
        start = Start(base, shared, places[:shared], int(n[:shared].sum()))
        starts[r["part"]] = start
        places = _absolute(np.frombuffer(r["last_places"], "<i8"), int(r["last_like"]), start)
        base += int(np.frombuffer(r["total"], "<i8")[0]) - start.tokens
        key = r["last_key"]
    return starts


def _absolute(places: np.ndarray, like: int, start: Start) -> list[int]:
    known = min(like, start.shared)
    return [*start.places[:known], *(int(p) + start.base - start.tokens for p in places[known:])]


TREE = (
    "conv_id long, nodes array<long>, owned array<struct<node:long,length:long,position:long,ids:binary,loss_begin:long,loss_end:long,"
    "ancestors:array<struct<begin:long,end:long>>>>"
)


def _tree(batches, starts: dict[int, Start], learned: bytes):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            start = starts[r["part"]]
            lengths = np.frombuffer(r["lengths"], "<i8").reshape(-1, 3)
            n = lengths.sum(axis=1)
            places = _absolute(np.frombuffer(r["places"], "<i8"), r["like_first"], start)
            own = start.shared if r["seq"] == 0 else r["own_from"]
            position = np.cumsum(n) - n
            ids, skip = r["own_ids"], 4 * int(position[own]) if own < len(n) else 0
            skip = skip if r["seq"] == 0 else 0
            spans, owned = [], []
            for i, place in enumerate(places):
                size = int(n[i])
                if i >= own:
                    head, body, _ = (int(x) for x in lengths[i])
                    piece = ids[skip : skip + 4 * size]
                    skip += 4 * size
                    loss = (head, head + body) if piece[: 4 * head] == learned else (0, 0)
                    owned.append({"node": place, "length": size, "position": int(position[i]), "ids": piece, "loss_begin": loss[0], "loss_end": loss[1], "ancestors": [dict(s) for s in spans]})
                if spans and spans[-1]["end"] == place:
                    spans[-1]["end"] = place + size
                else:
                    spans.append({"begin": place, "end": place + size})
            out.append({"conv_id": r["conv_id"], "nodes": places, "owned": owned})
        yield pa.RecordBatch.from_pylist(out, SCHEMA)


SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
OWNED = pa.struct([("node", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("ids", pa.binary()), ("loss_begin", pa.int64()), ("loss_end", pa.int64()), ("ancestors", pa.list_(SPAN))])
SCHEMA = pa.schema([("conv_id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("owned", pa.list_(OWNED))])


def prefix_tree(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """``conversations(conv_id, turn, role, text)``, a row per turn, as one row per conversation:

    * ``nodes``: the tree's node of each turn. A node's number is the place of its first token
      in the depth-first line of all tokens.
    * ``owned``: the nodes emitted with this conversation. Their ids, the position of the first
      (positions go on from the parent), the part under the loss mask (texts of the assistant,
      counted from the node's first id), and the intervals of the line that tokens of the node
      may attend to beside its own earlier tokens: its ancestors.

    Null roles and texts are empty. Turns go by ``turn`` (null first), then role, then text;
    equal rows are turns of their own. Rows without ``conv_id`` are one conversation. A
    conversation is one row and so held in a task; any number of them may share turns."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = turns.mapInArrow(lambda batches: _formatted(batches, tokenizer), CONVERSATION)
    ordered = rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    placed = stored(ordered.mapInArrow(_placed, PLACED), "placed")
    first = placed.filter("first_key IS NOT NULL").select("part", "first_key", F.col("lengths").alias("first_lengths"))
    last = placed.filter("last_key IS NOT NULL").select("part", "last_key", F.col("places").alias("last_places"), F.col("like_first").alias("last_like"), F.col("lengths").alias("total"))
    starts = _starts(first.join(last, "part").collect())  # two conversations of each task
    learned = text_ids(tokenizer, OPEN + escaped_role(LEARNED_ROLE) + "\n")
    return placed.filter("last_key IS NULL").select("part", "seq", "conv_id", "lengths", "own_ids", "own_from", "like_first", "places").mapInArrow(
        lambda batches: _tree(batches, starts, learned), TREE)


def read_back(tree: DataFrame, tokenizer: str) -> DataFrame:
    """Each conversation read from the tree: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``. Roles and texts are parsed from the decoded ids, texts under
    the loss mask from those ids alone."""
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree = stored(tree, "tree")
    nodes = tree.select(F.explode("owned").alias("n")).select("n.node", "n.ids", "n.loss_begin", "n.loss_end")
    members = tree.select("conv_id", F.posexplode("nodes").alias("turn_no", "node"))
    turns = members.join(nodes, "node").select("conv_id", "turn_no", "ids", "loss_begin", "loss_end")
    turns = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn_no")
    return turns.mapInArrow(lambda batches: _digests(batches, tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(batches, path: str):
    text_of = lambda ids: encoding(path).decode_bytes(np.frombuffer(ids, "<u4").tolist()).decode()
    now, n, turns, loss, chars, loss_chars = None, 0, None, None, 0, 0

    def batch_of():
        row = ((now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars),)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*row), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv_id, ids, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_begin", "loss_end"))):
            if now is None or now[0] != conv_id:
                if now is not None:
                    yield batch_of()
                now, n, turns, loss, chars, loss_chars = (conv_id,), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            whole = text_of(ids)
            role, _, text = whole[len(OPEN) : -len(CLOSE)].partition("\n")
            turns.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
            under = unescaped(text_of(ids[4 * begin : 4 * end]))
            loss.update(under.encode())
            n, chars, loss_chars = n + 1, chars + len(whole), loss_chars + len(under)
    if now is not None:
        yield batch_of()
