"""Suffix-array dedup (op4): prefix-free parsing of bytes.

The parse cuts every text at rolling-hash triggers into overlapping phrases (see repeats.py): the triggers are the
smallest hashes of their neighbourhood rather than a residue class, so no phrase exceeds 337 starts and every
200-byte string lies in exactly one phrase. The dictionary is the set of different phrases; the parse is the
table of (document, start, phrase), laid in the order of phrases, so the parse lists each phrase's places in the corpus. In
corpus order, two suffixes that agree on 200 bytes are suffixes of dictionary phrases at the same place from an equal trigger. So the
sorted suffixes of the dictionary fall apart by trigger: the different phrases of one trigger are a part of the dictionary, its suffix
array (`window_ranks`, prefix doubling over the bytes) gives the neighbours that share 200 bytes, and the parse
carries them to all places of the corpus. No suffix of a phrase that is alone under its trigger is ever formed.

Suffixes are ordered by their first 200 bytes. What follows lies in the next phrases of the parse; it would order suffixes
that agree on 200 bytes, which are repeats in any order, so no suffix array of the parse itself is made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, stage
from .repeats import BYTES, covered, finish, identified, phrase_table, repeated


#: A trigger with more different phrases has its windows told apart by an aggregation. A phrase has up to 337 windows, each a row there, so the bound is higher than for words.
MANY = 2000


def _kernel(texts_too: bool):
    def run(ids, buf, offsets, d, start, n) -> pa.RecordBatch:
        gone = covered(len(buf), offsets, d, start, n, BYTES.win)
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(buf)]
        first[inner] = gone[inner]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        removed = total(gone)
        kept, at = buf[~gone].tobytes(), np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
        rest = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        cols = [ids, pa.array(np.diff(offsets)), pa.array(removed), pa.array(total(first)), pa.array([hashlib.sha256(x).hexdigest() for x in rest])]
        return pa.RecordBatch.from_arrays(cols + [pa.array(rest, pa.binary())] * texts_too, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts_too)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each input row; with_text adds the kept bytes.

    Every byte in a 200-byte string that also starts anywhere else is removed, the first occurrence too. Null text is
    empty; texts under 200 bytes stay whole. Repeated rows are copies of each other, even under one id. The kept
    bytes need not be valid UTF-8. Other columns are ignored; an empty table gives an empty result.
    """
    rows = identified(docs, id_col, text_col)
    parse = stage(phrase_table(rows, BYTES), "op4-parse")
    ranges, walked = repeated(parse, rows.withColumn("old", F.lit(False)), BYTES, keep_first=False, many=MANY)
    discard(parse, walked)
    return finish(rows, ranges, BYTES, _kernel(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))
