"""SentencePiece encoding and decoding (op6): streaming Viterbi over a piece model.

The lattice of a text has a node for each way a piece can end at a boundary between characters; characters without a piece become byte
pieces. In a unigram model a path's score is the sum of its pieces' scores. In a BPE model (the default) pieces have no weights of their own:
a transition between two neighbouring pieces scores 0 if merging the two pieces' text, best score first, gives just these two pieces,
and minus infinity if not. A path without forbidden transitions is the model's own encoding, and each boundary has at most one
live path to it, so the ids are those of BPE merging (`sentencepiece` gives the same).

A pass needs only the nodes of the last max_piece bytes, and where all surviving backpointer paths go through
one boundary, everything before it is final: its ids are committed and the window starts anew (`StreamingViterbi`).
A space after something else, if spaces only ever begin pieces, is such a boundary for any text, so a text falls into segments
whose ids do not depend on each other. Every segment goes through the same streaming pass; a worker keeps the ids of
about CACHE short segments, so a word is encoded once for many occurrences, and one that begins as the one before goes on from its nodes.

A space stands for the model's space mark; a literal mark in a text has no piece and is kept as bytes, so decoding gives
back every text exactly. As in the model's own encoder, one space goes before a text that is not empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Poly, arrow_batches, frugal, pieces, read_table, texts

MARK = "▁"
#: Segments of up to 64 bytes whose ids a worker remembers (some 30 MB), and pairs of pieces; at the bound it forgets those that it does not need at once.
CACHE, PAIRS = 1 << 17, 1 << 18
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_POLY, _KEYS = Poly(51), Poly(52)


@dataclass(frozen=True)
class Pieces:
    """A model's vocabulary: normal pieces (bytes, id, score), the ids of the 256 byte pieces, and the cost of a fallback."""

    table: dict[bytes, tuple[int, float]]
    byte_ids: np.ndarray
    by_id: list[bytes]
    unknown: float
    longest: int
    spaces_lead: bool
    bpe: bool = False

    @staticmethod
    def read(path: str, bpe: bool = True) -> Pieces:
        """Read on the driver; the vocabulary itself is sent to the executors."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        table, byte_ids, by_id = {}, np.full(256, -1, np.int32), []
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(name[1:-1], 16)] = i
                by_id.append(bytes([int(name[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                by_id.append(b"")
            else:
                text = name.replace(MARK, " ").encode()
                table.setdefault(text, (i, float(sp.get_score(i))))
                by_id.append(text)
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        return Pieces.of(table, byte_ids, by_id, bpe)

    @staticmethod
    def of(table: dict[bytes, tuple[int, float]], byte_ids: np.ndarray, by_id: list[bytes], bpe: bool = False) -> Pieces:
        lead = all(b" " not in t.lstrip(b" ") for t in table)
        return Pieces(table, byte_ids, by_id, min((s for _, s in table.values()), default=0.0) - 10, max(map(len, table), default=1), lead, bpe)

    def merged(self, text: bytes) -> list[bytes]:
        """The pieces that merging leaves of a short text: the neighbours with the best score first, the left ones of equals."""
        parts = [c.encode() for c in text.decode()]
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                got = self.table.get(parts[i] + parts[i + 1])
                if got is not None and got[1] > best:
                    best, at = got[1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Lattice:
    """What a worker knows of a model: its pieces by their bytes from the end, and which neighbours stay apart."""

    def __init__(self, model: Pieces):
        self.model, self.root, self.known = model, {}, {}
        for text, found in model.table.items():
            node = self.root
            for byte in reversed(text):
                node = node.setdefault(byte, {})
            node[256] = found

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging leaves two neighbouring pieces as they are; -1 is the start, or a character without a piece."""
        m = self.model
        a, b = b"" if left < 0 else m.by_id[left], m.by_id[right]
        if len(self.known) >= PAIRS:
            self.known.clear()
        out = self.known[(left + 1) << 20 | right] = m.merged(a + b) == ([a, b] if a else [b])
        return out


class StreamingViterbi:
    """Feed bytes in any portions; ids come out as soon as they are certain. Holds at most the bytes since the last certain boundary.

    A node is the end of a character: the piece of the best path that ends there, and where that piece begins. The next node needs those of
    the last `longest` bytes, which are looked through backwards as far as a piece can reach. A path can be alive only if it ends among them; once
    the backpointers of all of them meet in one boundary, what lies before it is committed.
    """

    def __init__(self, lattice: Lattice | Pieces):
        self.lattice = lattice if isinstance(lattice, Lattice) else Lattice(lattice)
        self.model = self.lattice.model
        self.text, self.first, self.ends, self.best = bytearray(), [0], [-1], [0.0]

    def keep(self, n: int) -> None:
        """Forget all but the first n bytes of what is held (of a character, all or none)."""
        while self.ends[n] is None:
            n -= 1
        del self.text[n:], self.first[n + 1 :], self.ends[n + 1 :], self.best[n + 1 :]

    def feed(self, portion: bytes, last: bool = True) -> list[int]:
        self.text += portion
        out, often, more = [], 4 * self.model.longest, True
        while more:
            more = self._advance(len(self.ends) + often, last)
            if len(self.ends) > often:
                out += self._commit()
        if last:
            out += self.path(len(self.text))
            self.text, self.first, self.ends, self.best = bytearray(), [0], [-1], [0.0]
        return out

    def _advance(self, upto: int, last: bool) -> bool:
        """Make the nodes of the characters held, up to about `upto` bytes; whether there are more."""
        text, first, ends, best, root, known, m = bytes(self.text), self.first, self.ends, self.best, self.lattice.root, self.lattice.known, self.model
        e, n, bpe, apart = len(ends) - 1, len(text), m.bpe, self.lattice.stay_apart
        while e < n:
            if e >= upto:
                return True
            lead, start = text[e], e
            if lead < 0x80:
                e += 1
            else:
                e += 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if e > n:
                    if not last:
                        return False
                    e = n
                for _ in range(e - start - 1):  # places within a character
                    first.append(0)
                    ends.append(None)
                    best.append(-np.inf)
            node, s, begin, piece, top = root, e, -1, -1, -np.inf
            if bpe:  # one path at most is alive here
                while s:
                    s -= 1
                    node = node.get(text[s])
                    if node is None:
                        break
                    if 256 in node:
                        i = node[256][0]
                        allowed = known.get((ends[s] + 1) << 20 | i)
                        if allowed or allowed is None and apart(ends[s], i):
                            begin, piece = s, i
                            break
                if begin < 0:
                    begin = start
                first.append(begin)
                ends.append(piece)
                best.append(0.0)
                continue
            while s:
                s -= 1
                node = node.get(text[s])
                if node is None:
                    break
                if 256 in node and best[s] + node[256][1] > top:
                    begin, piece, top = s, node[256][0], best[s] + node[256][1]
            if best[start] + m.unknown > top and text[start:e] not in m.table:
                begin, piece, top = start, -1, best[start] + m.unknown
            first.append(begin)
            ends.append(piece)
            best.append(top)
        return False

    def path(self, e: int) -> list[int]:
        """The ids of the best path to a node."""
        ids, first, ends = [], self.first, self.ends
        while e > 0:
            s, i = first[e], ends[e]
            if i >= 0:
                ids.append(i)
            else:
                ids += [int(x) for x in self.model.byte_ids[list(self.text[s:e])][::-1]]
            e = s
        ids.reverse()
        return ids

    def _commit(self) -> list[int]:
        alive = {e for e in range(max(1, len(self.ends) - self.model.longest), len(self.ends)) if self.ends[e] is not None}
        while len(alive) > 1:
            e = max(alive)
            alive.discard(e)
            alive.add(self.first[e])
        at = alive.pop() if alive else 0
        if at <= 0:
            return []
        ids = self.path(at)
        del self.text[:at]
        base = self.best[at]
        # what stands before the text that is left is the piece that ends at the boundary
        self.first = [0] + [s - at for s in self.first[at + 1 :]]
        self.ends = self.ends[at:]
        self.best = [0.0] + [b - base for b in self.best[at + 1 :]]
        return ids


class Encoder:
    """Encoding of batches of texts with one model; remembers the ids of short segments."""

    def __init__(self, model: Pieces):
        self.model, self.lattice, self.cache = model, Lattice(model), {}

    def segments(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each segment. New ones are taken in order, so that one that begins as the one before goes on from its nodes."""
        new = sorted({w for w in words if w not in self.cache})
        if len(self.cache) + len(new) > CACHE:
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        stream, before, found = StreamingViterbi(self.lattice), b"", {}
        for w in new:
            if len(w) > 64:
                found[w] = StreamingViterbi(self.lattice).feed(w)
                continue
            same, most = 0, min(len(before), len(w))
            while same < most and before[same] == w[same]:
                same += 1
            stream.keep(same)
            stream.text = bytearray(w)
            stream._advance(len(w), True)
            self.cache[w] = stream.path(len(w))
            before = w
        return [found[w] if w in found else self.cache[w] for w in words]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a piece, end to end, and where each text's begin."""
        m, docs = self.model, len(offsets) - 1
        filled = np.diff(offsets) > 0
        buf = np.insert(buf, offsets[:-1][filled], np.uint8(32))
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        n = len(buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
        cut = np.zeros(n, bool)
        cut[offsets[:-1][filled]] = True
        if m.spaces_lead:
            cut[1:] |= (buf[1:] == 32) & (buf[:-1] != 32)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        other = _KEYS.spans(_KEYS.of_bytes(buf), starts, ends)
        _, index, inverse = np.unique(_POLY.spans(_POLY.of_bytes(buf), starts, ends) ^ (other << np.uint64(1)), return_index=True, return_inverse=True)
        text = buf.tobytes()
        lists = self.segments([text[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())])
        counts = np.array([len(x) for x in lists], np.int64)
        pool, where, each = np.array([i for x in lists for i in x], np.int32), np.cumsum(counts) - counts, counts[inverse]
        at = np.concatenate([[0], np.cumsum(each)])
        out = pool[np.repeat(where[inverse] - at[:-1], each) + np.arange(at[-1])]
        return out, at[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids, end to end, and where each begins."""
        if not hasattr(self, "flat"):
            self.flat = np.frombuffer(b"".join(self.model.by_id), np.uint8)
            self.size = np.array([len(t) for t in self.model.by_id], np.int64)
            self.place = np.cumsum(self.size) - self.size
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.repeat(self.place[ids] - at[:-1], size) + np.arange(at[-1])]
        begin = at[bounds]
        lead = begin[:-1][np.diff(begin) > 0]
        lead = lead[out[lead] == 32]  # the space that encoding put first
        return np.delete(out, lead), begin - np.searchsorted(lead, begin)


def encode(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_ids, round_trip of each input row: whether decoding the ids gives exactly the text.

    Null text is empty, and an empty text has no ids. Repeated rows get equal ids. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            buf, offsets = texts(batch.column(1))
            for i, j in pieces(offsets, 1 << 18):
                part, cut = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, begin = encoder.encode(part, cut)
                back, at = encoder.decode(ids, begin)
                whole = len(back) == len(part) and bool((back == part).all()) and bool((at == cut).all())
                same = np.ones(j - i, bool) if whole else np.array([np.array_equal(back[at[d] : at[d + 1]], part[cut[d] : cut[d + 1]]) for d in range(j - i)], bool)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)), pa.array(np.diff(begin)), pa.array(same)], names=["doc_id", "ids", "n_ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null ids are none. Ids that make no valid UTF-8 raise an error."""
    spark = encoded.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            lists = batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
            out, at = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.large_string()).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op6_pieces(spark: SparkSession, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), Pieces.read(model_path))
