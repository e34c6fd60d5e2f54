"""Exact dedup (op7): Patricia-trie owners.

Every task first combines its own copies, so a text travels once for each `memory` bytes of different texts that a task
reads, however often it occurs. The combined texts go to partitions of length and content hash (the
text's length and the first bits of its SHA-256), where each is inserted as a whole byte string in one compressed radix
trie of the partition; strings that begin alike share a path and fork where they part. The terminal
node keeps the smallest identifier, the number of rows and who asked. A partition is sorted by its strings, so whatever lies
left of the path to the newest one takes no more insertions: when the trie has grown past `memory` bytes, these
subtrees are spilled (their owners are emitted, their nodes freed). Memory is that bound and the longest path. Equality is
decided by the bytes in the trie; the hash only chooses the place.

A text that very many tasks hold (over 1,000 and a 10,000th of all combined texts, so fewer than 10,000 texts) is combined
once more in salted partitions before, so its copies do not all go to one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, frugal, read_table, stage

MEMORY = 8 << 20
_TO_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_RUN = re.compile(b"  +")
_NODE = 400  # about what a node takes besides its label


def normalise(text: bytes) -> bytes:
    """Each run of white space becomes one space."""
    text = text.translate(_TO_SPACE)
    return _RUN.sub(b" ", text) if b"  " in text else text


class Owner:
    """What a terminal node holds: the smallest id (None if all are), the rows, and the combined texts that were inserted."""

    __slots__ = ("least", "rows", "reps")

    def __init__(self):
        self.least, self.rows, self.reps = None, 0, []


class Node:
    __slots__ = ("edges", "owner")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.owner: Owner | None = None


class Patricia:
    """A compressed radix trie over byte strings; `size` is about its bytes."""

    def __init__(self):
        self.root, self.size, self.forks, self.spills = Node(), 0, 0, 0

    def insert(self, key: bytes, least: int | None, rows: int, rep: int = 0) -> Owner:
        node, at = self.root, 0
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = Node()
                node.edges[key[at]] = (key[at:], leaf)
                self.size += len(key) - at + _NODE
                node, at = leaf, len(key)
                break
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), len(key) - at)
            while low < high:  # the longest common prefix, by bisection on slices
                mid = (low + high + 1) // 2
                low, high = (mid, high) if label[:mid] == key[at : at + mid] else (low, mid - 1)
            fork = Node()
            fork.edges[label[low]] = (label[low:], child)
            node.edges[key[at]] = (label[:low], fork)
            self.size += _NODE
            self.forks += 1
            node, at = fork, at + low
        owner = node.owner = node.owner or Owner()
        if least is not None and (owner.least is None or least < owner.least):
            owner.least = least
        owner.rows += rows
        owner.reps.append(rep)
        self.size += 40
        return owner

    def owners(self, node: Node | None = None) -> Iterator[Owner]:
        """The owners in a subtree."""
        stack = [node or self.root]
        while stack:
            n = stack.pop()
            if n.owner is not None:
                yield n.owner
            stack.extend(child for _, child in n.edges.values())

    def spill(self, key: bytes) -> Iterator[Owner]:
        """The owners of all subtrees beside the path to key, which are freed; key is the largest string so far."""
        node, at, self.size = self.root, 0, 0
        self.spills += 1
        while at < len(key):
            if node.owner is not None:
                yield node.owner
                node.owner = None
            label, child = node.edges[key[at]]
            for first, (_, beside) in node.edges.items():
                if first != key[at]:
                    yield from self.owners(beside)
            node.edges = {key[at]: (label, child)}
            self.size += len(label) + _NODE
            node, at = child, at + len(label)


_COMBINED = "doc_id long, rep long, sha binary, n_bytes long, least long, rows long, body binary"


def _combine(memory: int):
    """A light row for each document; a combined text (body not null) for each different one of up to `memory` bytes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        found, held = {}, 0

        def flush() -> pa.RecordBatch:
            reps = list(found.values())
            cols = [pa.nulls(len(reps), pa.int64()), pa.array([r[0] for r in reps], pa.int64()), pa.array([r[3] for r in reps], pa.binary()), pa.array([len(t) for t in found], pa.int64()), pa.array([r[1] for r in reps], pa.int64()), pa.array([r[2] for r in reps], pa.int64()), pa.array(list(found), pa.binary())]
            found.clear()
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "rep", "sha", "n_bytes", "least", "rows", "body"])

        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1).cast(pa.binary())):
                text = normalise(text.as_py() or b"")
                rep = found.get(text)
                if rep is None:
                    rep = found[text] = [uid, doc, 0, hashlib.sha256(text).digest()]
                    uid, held = uid + 1, held + len(text) + _NODE
                rep[2] += 1
                if doc is not None and (rep[1] is None or doc < rep[1]):
                    rep[1] = doc
                rows.append((rep[0], rep[3]))
                if held >= memory:
                    yield flush()
                    held = 0
            n, none = len(rows), pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), none, none, none, pa.nulls(n, pa.binary())], names=["doc_id", "rep", "sha", "n_bytes", "least", "rows", "body"])
        if found:
            yield flush()

    return run


_OWNED = "rep long, head long, keep_id long, group_size long, sha binary, n_bytes long, body binary"


def _owners(memory: int, bodies: bool = False):
    """Walk a partition sorted by place and string: each combined text with its owner. With bodies, the first of equal texts (head) carries the text on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, trie = None, Patricia()
        last: bytes | None = None
        shas: dict[int, tuple] = {}

        def emit(owners: Iterator[Owner]) -> Iterator[pa.RecordBatch]:
            out = [(rep, o.reps[0], o.least, o.rows, *(shas.pop(rep, (None, None, None)) if rep == o.reps[0] else (None, None, None))) for o in owners for rep in o.reps]
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in _OWNED.split(", ")])

        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in ("place", "sha", "n_bytes", "rep", "least", "rows")]
            for where, sha, n, rep, least, rows, body in zip(*fields, batch.column("body")):
                body = body.as_py()
                if where != place:
                    yield from emit(trie.owners())
                    place, trie = where, Patricia()
                elif trie.size > memory:
                    yield from emit(trie.spill(last))
                owner = trie.insert(body, least, rows, rep)
                if bodies and owner.reps[0] == rep:
                    shas[rep] = (sha, n, body)
                last = body
        yield from emit(trie.owners())

    return run


def _place(*more) -> "F.Column":
    """The partition of a text: its length and the first 16 bits of its hash."""
    return F.xxhash64(F.floor(F.log2(F.col("n_bytes") + 1)), F.substring("sha", 1, 2), *more).alias("place")


def _in_tries(texts: DataFrame, memory: int, *more, bodies: bool = False) -> DataFrame:
    placed = texts.select(_place(*more), "sha", "n_bytes", "rep", "least", "rows", "body")
    return placed.repartition("place").sortWithinPartitions("place", "body").mapInArrow(frugal(_owners(memory, bodies)), _OWNED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, many: int = 1000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is the empty text; empty texts are equal to each other. A null id never owns a group that
    has another id; rows that share the smallest id are all kept. Other columns are ignored. An empty
    table gives an empty result. `memory` bounds a task's combined texts and trie; a text of more than `many`
    combined copies goes through salted partitions first.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = stage(rows.mapInArrow(frugal(_combine(memory)), _COMBINED), "op7")
    texts, total = both.where("n_bytes is not null"), None
    often = stage(texts.groupBy("n_bytes", "sha").agg(F.count("*").alias("copies")).where(F.col("copies") > many), "op7-often")
    if often.limit(1).count():
        total = texts.count()
        hot = F.broadcast(often.where(F.col("copies") > max(many, total // 10_000)).drop("copies"))
        part = stage(_in_tries(texts.join(hot, ["n_bytes", "sha"]), memory, F.pmod(F.xxhash64("rep"), F.lit(256)), bodies=True), "op7-hot")
        heads = part.where("n_bytes is not null").select("sha", "n_bytes", "rep", F.col("keep_id").alias("least"), F.col("group_size").alias("rows"), "body")
        cold = texts.join(hot, ["n_bytes", "sha"], "left_anti").select(heads.columns)
        done = _in_tries(cold.unionAll(heads), memory).select(F.col("rep").alias("head"), "keep_id", "group_size")
        to = part.select("rep", "head").unionAll(cold.select("rep", F.col("rep").alias("head")))
        owners = to.join(done, "head").select("rep", "keep_id", "group_size")
    else:
        owners = _in_tries(texts, memory).select("rep", "keep_id", "group_size")
    each = both.where("n_bytes is null").select("doc_id", "rep", "sha")
    return each.join(owners, "rep").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
