"""Quality rules (op9): robust multivariate outliers by the minimum covariance determinant.

Each text gives base counts and a vector of transformed statistics. For each language and source, location and
scatter are estimated by concentration steps from two starts (medians with absolute deviations; the same with the correlation
of tanh-transformed statistics): take the share of rows that lies nearest by Mahalanobis distance, estimate
again from them, and repeat until the determinant stands still; the start with the smaller determinant stays.

A step is one aggregation over all rows: counts and moments for each group and bin of the distance's logarithm (16 bins to the
power of two), from which whole bins are taken until they hold the share; so the nearest rows are known up to one bin, and a hot
language or source is summed by all tasks. The scatter of the rows taken is corrected by the consistency factor of the share
they really are (for normal data), and every group's estimate is shrunk to that of its language, and this to that of all, by PRIOR
rows each: small groups borrow without a switch. Groups stay a table: estimates never pass through the driver, which sees the sums of all.

A document is rejected if its squared distance passes LIMIT. That is no chi-square quantile: statistics of clean text
have long tails (short texts, code, lists).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Poly, arrow_batches, discard, mix, pieces, read_table, spread_join, stage, texts, word_spans

_BYTES, _WORDS = Poly(21), Poly(22)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_POINT = np.array([b not in range(0x80, 0xC0) for b in range(256)]).astype(np.int64)
_UPPER = np.array([65 <= b <= 90 for b in range(256)]).astype(np.int64)
_PUNCT = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)]).astype(np.int64)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct"]
#: log of a smoothed ratio each; the smoothing keeps the ratios of short texts near the middle
FEATURES = {
    "word_length": ("word_chars", 250, "n_words", 50),
    "symbols": ("n_symbols", 1, "n_words", 50),
    "upper": ("n_upper", 5, "word_chars", 250),
    "punctuation": ("n_punct", 5, "n_words", 50),
    "repeats": ("n_repeat_words", 5, "n_words", 50),
    "lines": ("n_dup_lines", 1, "n_lines", 10),
}
D = len(FEATURES)
#: squared robust distance: about 17 deviations, far outside the quantiles of the normal law
LIMIT = 300.0
#: the smallest scatter of a statistic that is taken for real, in log units
FLOOR = 0.15
#: rows that the estimate of a language counts for in that of a source
PRIOR = 50.0
#: distance bins to the power of two
BINS = 16


def counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a piece."""
    docs = len(offsets) - 1
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    starts, ends, first = word_spans(buf, offsets)
    n_words = np.diff(first)
    solid = (~SPACE[buf]).astype(np.int64)
    prefix = _BYTES.of_bytes(buf)
    # lines: each document's text split at \n
    breaks = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    of = np.repeat(np.arange(docs), np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=docs) + 1)
    filled = np.concatenate([[0], np.cumsum(solid)])
    some = filled[end] > filled[begin]
    line, line_doc = _BYTES.spans(prefix, begin[some], end[some]), of[some]
    order = np.lexsort((line, line_doc))
    same = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup = np.bincount(line_doc[order][1:][same], minlength=docs)
    # five-word windows found twice or more
    word = _BYTES.spans(prefix, starts, ends)
    doc_of = np.repeat(np.arange(docs), n_words)
    at = np.flatnonzero(doc_of[:-4] == doc_of[4:]) if len(word) >= 5 else np.zeros(0, np.int64)
    window = mix(_WORDS.spans(_WORDS.prefix(word), at, at + 5) + mix(doc_of[at].astype(np.uint64)))
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": n_words, "word_chars": per(solid * _POINT[buf]), "n_symbols": per(_SYMBOL[buf]), "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc_of[repeated], minlength=docs), "n_lines": np.bincount(of, minlength=docs), "n_upper": per(_UPPER[buf]), "n_punct": per(_PUNCT[buf]),
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = texts(batch.column(3))
        parts = [counts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets)]
        out = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x.astype(np.int64)) for x in out)], names=["doc_id", "lang", "source", *COUNTS])


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_SUMS = ["c", *(f"s{i}" for i in range(D)), *(f"x{i}_{j}" for i, j in _PAIRS)]
_GROUP = ["lk", "sk"]
_PARAMS = "lk string, sk string, start int, n long, mu array<double>, p array<double>, logdet double, was double"


def chi2_cdf(x: np.ndarray, d: int) -> np.ndarray:
    """Chi-square distribution for an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.zeros_like(x)
    for k in range(d // 2):
        total = total + term
        term = term * half / (k + 1)
    return 1 - np.exp(-half) * total


def consistency(share: np.ndarray) -> np.ndarray:
    """By how much the scatter of the nearest share of normal rows must grow to be that of all."""
    q = np.clip(np.asarray(share, float), 1e-6, 1 - 1e-9)
    low, high = np.zeros_like(q), np.full_like(q, 200.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = chi2_cdf(mid, D) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return q / np.maximum(chi2_cdf(low, D + 2), 1e-12)


def shrunk(c: np.ndarray, s: np.ndarray, x: np.ndarray, factor: np.ndarray, mu0: np.ndarray, s0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter (without the floor) of c rows with sums s and products x, with PRIOR rows of (mu0, s0) mixed in."""
    mean = s / np.maximum(c, 1)[:, None]
    own = x / np.maximum(c, 1)[:, None, None] - mean[:, :, None] * mean[:, None, :]
    w = (c / (c + PRIOR))[:, None]
    return w * mean + (1 - w) * mu0, w[:, :, None] * factor[:, None, None] * own + (1 - w)[:, :, None] * s0


def _unpack(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, s, x = sums[:, 0], sums[:, 1 : D + 1], np.zeros((len(sums), D, D))
    for k, (i, j) in enumerate(_PAIRS):
        x[:, i, j] = x[:, j, i] = sums[:, D + 1 + k]
    return c, s, x


def _estimates(whole: dict[int, list[float]]):
    """Rows of sums (of the group, and of its language) to the group's shrunk mean, precision and determinant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            own, lang = f[_SUMS].to_numpy(float), f[[f"l_{c}" for c in _SUMS]].to_numpy(float)
            factor = consistency(own[:, 0] / f["n"].to_numpy(float))
            c, s, x = _unpack(np.array([whole[int(k)] for k in f["start"]]))
            mu = s / c[:, None]
            top = mu, factor[:, None, None] * (x / c[:, None, None] - mu[:, :, None] * mu[:, None, :])
            mu, s = shrunk(*_unpack(own), factor, *shrunk(*_unpack(lang), factor, *top))
            s = s + FLOOR**2 * np.eye(D)
            yield pd.DataFrame({"lk": f["lk"], "sk": f["sk"], "start": f["start"], "n": f["n"], "mu": list(mu), "p": list(np.linalg.inv(s).reshape(-1, D * D)), "logdet": np.linalg.slogdet(s)[1], "was": f["logdet"]})

    return run


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two starts for each group from its medians, deviations and the moments of tanh."""
    for f in frames:
        if not len(f):
            continue
        med, mad = (np.array(f[c].tolist()) for c in ("med", "mad"))
        t = np.zeros((len(f), D, D))
        for i, j in _PAIRS:
            t[:, i, j] = t[:, j, i] = f[f"t{i}_{j}"]
        root = np.sqrt(np.einsum("nii->ni", t) + 1e-3)
        corr = t / root[:, :, None] / root[:, None, :]
        shape = 0.9 * corr * (1 - np.eye(D)) + np.eye(D)
        for start, r in enumerate((np.broadcast_to(np.eye(D), shape.shape), shape)):
            s = r * mad[:, :, None] * mad[:, None, :]
            yield pd.DataFrame({"lk": f["lk"], "sk": f["sk"], "start": start, "n": f["n"], "mu": list(med), "p": list(np.linalg.inv(s).reshape(-1, D * D)), "logdet": np.linalg.slogdet(s)[1], "was": np.inf})


def _distance() -> "F.Column":
    """Squared Mahalanobis distance to the joined mean mu and precision p."""
    diff = [F.col(f) - F.col("mu")[i] for i, f in enumerate(FEATURES)]
    return sum((1 if i == j else 2) * diff[i] * diff[j] * F.col("p")[i * D + j] for i, j in _PAIRS)


def estimate(rows: DataFrame, share: float = 0.75, steps: int = 10, still: float = 1e-3) -> DataFrame:
    """lk, sk, n, mu, p (precision) of each group of a staged table with the columns lk, sk and FEATURES; a staged table."""
    names = list(FEATURES)
    q = rows.groupBy(*_GROUP).agg(F.count("*").alias("n"), *(F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q_{f}") for f in names))
    mad = lambda f: F.greatest((F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0]) / 1.349, F.lit(FLOOR))
    middle = stage(q.select(*_GROUP, "n", F.array(*(F.col(f"q_{f}")[1] for f in names)).alias("med"), F.array(*(mad(f) for f in names)).alias("mad")), "op9-middle")
    total = middle.agg(F.sum("n")).first()[0] or 0
    z = [F.tanh((F.col(f) - F.col("med")[i]) / F.col("mad")[i]) for i, f in enumerate(names)]
    moments = spread_join(rows, middle, _GROUP, "n", total).groupBy(*_GROUP).agg(F.first("n").alias("n"), F.first("med").alias("med"), F.first("mad").alias("mad"), *(F.avg(z[i] * z[j]).alias(f"t{i}_{j}") for i, j in _PAIRS))
    params = stage(moments.mapInPandas(_starts, _PARAMS), "op9-params")
    discard(middle)
    add = lambda of: [F.sum(c).over(of).alias(f"l_{c}") for c in _SUMS]
    for _ in range(steps):
        near = spread_join(rows, params, _GROUP, "n", total).withColumn("bin", F.floor(BINS * F.log2(_distance() + 1e-6)))
        sums = [F.sum(names[i]).alias(f"s{i}") for i in range(D)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i, j in _PAIRS]
        binned = near.groupBy(*_GROUP, "start", "n", "logdet", "bin").agg(F.count("*").alias("c"), *sums)
        inner = Window.partitionBy(*_GROUP, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        taken = binned.withColumn("before", F.coalesce(F.sum("c").over(inner), F.lit(0))).where(F.col("before") < share * F.col("n"))
        kept = stage(taken.groupBy(*_GROUP, "start").agg(F.first("n").alias("n"), F.first("logdet").alias("logdet"), *(F.sum(c).alias(c) for c in _SUMS)), "op9-kept")
        whole = {r["start"]: [float(r[c]) for c in _SUMS] for r in kept.groupBy("start").agg(*(F.sum(c).alias(c) for c in _SUMS)).collect()}
        new = stage(kept.select("*", *add(Window.partitionBy("lk", "start"))).mapInPandas(_estimates(whole), _PARAMS), "op9-params")
        discard(kept, params)
        params = new
        moved = params.agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if moved is None or moved < still:
            break
    best = params.groupBy(*_GROUP).agg(F.min_by(F.struct("n", "mu", "p"), F.struct("logdet", "start")).alias("b")).select(*_GROUP, "b.n", "b.mu", "b.p")
    return stage(best, "op9-best")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """doc_id, the base counts, base_failed, distance2 and kept of each input row.

    Null or empty text has no words and fails the base rule; rows that fail it have no distance and no part in the
    estimates. Null language or source is a value of its own. Repeated rows count as often as they occur. Other columns
    are ignored. An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    measured = rows.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    features = [F.log((F.col(a) + x) / (F.col(b) + y)).alias(f) for f, (a, x, b, y) in FEATURES.items()]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    key = lambda c, k: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(k)
    both = stage(measured.select("*", failed.alias("base_failed"), *features, key("lang", "lk"), key("source", "sk")), "op9")
    good = both.where("not base_failed")
    found = estimate(good.select(*_GROUP, *FEATURES))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = spread_join(good, found, _GROUP, "n").select(*out, (_distance() <= limit).alias("kept"), _distance().alias("distance2"))
    return judged.unionAll(both.where("base_failed").select(*out, F.lit(False), F.lit(None).cast("double")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
