"""Toxicity (op2): maximum-scoring segment search over token log-odds.

Fit: log-odds of tokens between toxic and clean labelled documents under an informative Dirichlet prior; those whose
z-score and size are large enough are the model (no more than the labelled documents have), all other tokens get one small negative drift.
Score: one linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa). Their scores are set
against the extreme-value law of segments of clean text, P(S > x) = 1 - exp(-K n exp(-lambda x)) (Karlin and
Altschul): lambda solves sum p exp(lambda s) = 1, K is fitted on clean documents. The evidence of all
segments that stand above what chance gives is summed, and a logistic curve fitted on the same training
rows turns it into a probability.

A token is a run of ASCII letters, digits and non-ASCII bytes, lower-cased in ASCII; its first four bytes are a second,
coarser token, so that inflected forms share evidence. Training is on at most max_docs labelled documents, chosen by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Poly, arrow_batches, discard, frugal, hashed_sample, pieces, read_table, stage, texts, word_spans

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
SEPARATOR = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
STEM_BYTES = 4
_STEM = np.uint64(0x5851F42D4C957F2D)
_POLY = Poly(11)


@dataclass(frozen=True)
class Model:
    """keys are sorted token hashes; scores are theirs; drift is every other token's."""

    keys: np.ndarray
    scores: np.ndarray
    drift: float
    rate: float  # lambda
    log_k: float
    slope: float
    bias: float


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    folded = FOLD[buf]
    starts, ends, first = word_spans(folded, offsets, SEPARATOR)
    prefix = _POLY.of_bytes(folded)
    return starts, ends, first, _POLY.spans(prefix, starts, ends), _POLY.spans(prefix, starts, np.minimum(ends, starts + STEM_BYTES)) ^ _STEM


def segments(at: np.ndarray, value: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a sequence that is drift but at the given tokens."""
    out: list[list] = []  # first, last, sum before it, sum with it
    total, last = 0.0, -1
    for k, s in zip(at.tolist(), value.tolist()):
        total += drift * (k - last - 1)
        last = k
        if s <= 0:
            total += s
            continue
        now = [k, k, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= now[2]:
                j -= 1
            if j < 0 or out[j][3] >= now[3]:
                out.append(now)
                break
            now = [out[j][0], now[1], out[j][2], now[3]]
            del out[j:]
    return [(a, b, r - l) for a, b, l, r in out]


def _lookup(model: Model, words: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that the model knows, and their scores; a word goes before its stem where it says more."""
    if not len(model.keys):
        return np.zeros(0, np.int64), np.zeros(0)
    best = np.zeros(len(words))
    for h in (stems, words):
        i = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
        found = np.where(model.keys[i] == h, model.scores[i], 0.0)
        best = np.where(np.abs(found) > np.abs(best), found, best)
    at = np.flatnonzero(best)
    return at, best[at]


def passages(model: Model, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """For each text its evidence's ingredients: tokens, and (first byte, end byte, score) of its maximal segments."""
    starts, ends, first, words, stems = tokens(buf, offsets)
    at, value = _lookup(model, words, stems)
    cut = np.searchsorted(at, first)
    for d in range(len(offsets) - 1):
        n, i, j = int(first[d + 1] - first[d]), int(cut[d]), int(cut[d + 1])
        if i == j:
            yield d, n, []
            continue
        base = int(offsets[d])
        yield d, n, [(int(starts[first[d] + a]) - base, int(ends[first[d] + b]) - base, s) for a, b, s in segments(at[i:j] - first[d], value[i:j], model.drift)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts by class, summed over each piece of the training texts."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        buf, offsets = texts(batch.column(1))
        for i, j in pieces(offsets):
            _, _, first, words, stems = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            label = np.repeat(toxic[i:j], np.diff(first))
            keys, inverse = np.unique(np.concatenate([words, stems]), return_inverse=True)
            both = np.concatenate([label, label])
            yes = np.bincount(inverse, both, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(yes), pa.array(np.bincount(inverse, minlength=len(keys)) - yes)], names=["key", "yes", "no"])


def _evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    level = model.log_k + math.log(max(n, 1))
    return math.log1p(sum(max(0.0, model.rate * s - level) for _, _, s in found))


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts(batch.column(1))
            rows = []
            for i, j in pieces(offsets):
                for _, n, found in passages(model, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    rows.append((n, max((s for *_, s in found), default=0.0), [s for *_, s in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["toxic", "n", "best", "scores"])

    return run


def _rate(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(rate s) = 1; the mean of s is negative."""
    low, high = 1e-3, 1.0
    f = lambda x: float(np.sum(p * np.exp(np.minimum(x * s, 700)))) - 1
    if s.max(initial=-1.0) <= 0:
        return 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (p - y) + ridge * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 60_000, least_z: float = 3.5, least_odds: float = 1.0) -> Model:
    """Learn from the labelled documents; labels has id_col and toxic (0 or 1; null rows are left out; an id with both labels is toxic).

    Without labelled documents, or with one class alone, no token is known and every score is the share of label 1.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    ids = hashed_sample(chosen, "_id", max_docs).collect()
    picked = F.broadcast(spark.createDataFrame([(r._id, r.toxic) for r in ids], "_id long, toxic int"))
    sample = stage(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(picked, "_id").select("toxic", "text"), "op2-sample")
    counts = stage(sample.mapInArrow(_counts, "key long, yes long, no long").groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "op2-counts")
    n1, n0 = counts.agg(F.sum("yes"), F.sum("no")).first()
    share = sum(r.toxic for r in ids) / len(ids) if ids else 0.5
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 0.0, 0.0, math.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not n1 or not n0:
        discard(sample, counts)
        return empty
    prior = F.lit(0.5) + 0.01 * (F.col("yes") + F.col("no"))
    a1, a0 = F.col("yes") + prior, F.col("no") + prior
    odds = counts.select("key", "no", (F.log(a1 / (n1 - F.col("yes"))) - F.log(a0 / (n0 - F.col("no")))).alias("s"), F.sqrt(1 / a1 + 1 / a0).alias("sd"), (a0 / n0).alias("p"))
    known = odds.where((F.abs(F.col("s") / F.col("sd")) >= least_z) & (F.abs("s") >= least_odds)).select("key", "s", "p").orderBy("key").collect()
    keys = np.array([r.key for r in known], np.int64).view(np.uint64)
    order = np.argsort(keys)
    s, p = np.array([r.s for r in known])[order], np.array([r.p for r in known])[order]
    p = p / max(1.0, float(p.sum()) / 0.9)
    drift = -(0.05 + max(0.0, float((p * s).sum())))
    rate = _rate(np.append(p, 1 - p.sum()), np.append(s, drift))
    model = Model(keys[order], s, drift, rate, 0.0, 1.0, 0.0)
    seen = sample.mapInArrow(_measure(model), "toxic int, n long, best double, scores array<double>").toPandas()
    discard(sample, counts)
    clean = seen[seen.toxic == 0]
    log_k = float((rate * clean.best - np.log(np.maximum(clean.n, 1))).mean()) - 0.5772156649 if len(clean) else 0.0
    model = Model(model.keys, s, drift, rate, log_k, 1.0, 0.0)
    x = np.array([_evidence(model, n, [(0, 0, v) for v in scores]) for n, scores in zip(seen.n, seen.scores)])
    slope, bias = _logistic(x, seen.toxic.to_numpy(float))
    return Model(model.keys, s, drift, rate, log_k, slope, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_evidence: float = 3.0) -> DataFrame:
    """doc_id, score, and the significant passages (byte offsets in the UTF-8 text, evidence) of each input row.

    Null text is empty; a text without tokens or known tokens has no passage and gets the model's lowest score. The whole
    text is scanned. Repeated rows get equal scores. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts(batch.column(1))
            scores, spans = [], []
            for i, j in pieces(offsets):
                for _, n, found in passages(model, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    level = model.log_k + math.log(max(n, 1))
                    x = model.slope * _evidence(model, n, found) + model.bias
                    scores.append(1 / (1 + math.exp(-min(max(x, -30), 30))))
                    spans.append([{"start": a, "end": b, "evidence": model.rate * s - level} for a, b, s in found if model.rate * s - level >= least_evidence])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])))], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, score double, passages array<struct<start:long,end:long,evidence:double>>")


def clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under limit, all columns unchanged; nothing is shuffled.

    Null text is empty, and scored as such. Repeated rows stay or go together. No column but the text is looked at, whatever their names; an empty table stays empty.
    """
    arrow_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts(batch.column(place))
            good = []
            for i, j in pieces(offsets):
                for _, n, found in passages(model, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    x = model.slope * _evidence(model, n, found) + model.bias
                    good.append(1 / (1 + math.exp(-min(max(x, -30), 30))) < limit)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def held_out(id_col: str = "doc_id") -> "F.Column":
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Fit on the labelled documents that are not held out."""
    return fit(docs, read_table(spark, sf_dir, "labels").where(~held_out()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, train(spark, docs, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
