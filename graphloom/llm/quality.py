"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Each whole text becomes a few dozen ratios (characters, words, repetition, lines), spread over fixed knots so that a
linear model can bend. Trusted positives are the documents labelled 1 outside the held-out fold; the unlabelled
set is every document outside the held-out fold, whatever its label. No row is sampled: each Newton step sums gradients
and curvature over the whole stored feature table, in two levels, and brings one small matrix to the driver.

The class prior is estimated without negatives: a first model tells positives from unlabelled text, and on rows that it was not
fitted to (every second) the share of unlabelled mass over positive mass in a region of high scores is smallest where only positives
live; the lower confidence bound of that minimum is the prior. The second model minimises  prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)])  for logistic loss l. Where the second term is
negative, a step raises it instead, as the non-negative estimator asks for; of all weights on the way those of the smallest risk stay.

Defined results: null text is the empty text, whose ratios are all 0; ids that repeat are scored once per row; of several labels of
one id the largest counts; a null id has no label and is not held out; without positives every score is the prior 0.5; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored

#: Knots of the hat functions over each ratio.
KNOTS = np.array([0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7, 1.0])
_COMMON = np.frombuffer(b".,;:'\"-?!()", np.uint8)
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in _COMMON.tolist()])
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
N_RATIOS = 26
SIZE = 1 + N_RATIOS * (len(KNOTS) - 1)


def ratios(text: str | None) -> np.ndarray:
    """The ratios of a text, each from 0 to 1."""
    x = np.zeros(N_RATIOS, np.float32)
    if not text:
        return x
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digit = count[_UPPER].sum(), count[_LOWER].sum(), count[_DIGIT].sum()
    high = count[128:].sum()
    letters = upper + lower + high
    words = raw.split()
    m = len(words)
    x[0] = upper / max(1, letters)
    x[1] = digit / n
    x[2] = count[_SYMBOLS].sum() / n
    x[3] = count[_COMMON].sum() / n
    x[4] = count[33] / max(1, m)
    x[5] = letters / n
    x[6] = count[32] / n
    x[7] = min(1.0, 10 * count[10] / n)
    x[8] = min(1.0, np.log1p(n) / 14)
    if m:
        freq = Counter(words)
        pairs = set(zip(words, words[1:], strict=False))
        x[9] = len(freq) / m
        x[10] = max(freq.values()) / m
        x[11] = sum(map(bytes.__eq__, words, words[1:])) / m
        x[12] = len(pairs) / max(1, m - 1)
        x[13] = min(1.0, n / m / 20)
        x[14] = sum(1 for w in freq if not w[-1:].isalnum() and w[-1] < 128) / len(freq)
        x[15] = sum(v for w, v in freq.items() if len(w) > 1 and w.isupper()) / m
        x[16] = sum(v for w, v in freq.items() if len(w) > 24) / m
        x[17] = sum(v for w, v in freq.items() if not any(97 <= c | 32 <= 122 or c > 127 for c in w[:4])) / m
        x[18] = sum(v for _, v in freq.most_common(10)) / m
        x[19] = min(1.0, np.log1p(m) / 12)
        x[20] = min(len(set(words[k : k + 50])) / len(words[k : k + 50]) for k in range(0, max(1, m - 25), 50))
        x[21] = sum(1 for v in freq.values() if v == 1) / m
    squeezed = len(zlib.compress(raw, 1))
    x[22] = min(1.0, squeezed / n)
    lines = [s for s in raw.split(b"\n") if s.strip()]
    if lines:
        x[23] = 1 - len(set(lines)) / len(lines)
        x[24] = sum(len(s) for s in lines if len(s) < 30) / n
    x[25] = count[124] / n
    return np.clip(x, 0, 1)


def expand(x: np.ndarray) -> np.ndarray:
    """A constant and, for each ratio, hat functions over the knots (but the first)."""
    rows, d = x.shape
    right = np.clip(np.searchsorted(KNOTS, x, side="right"), 1, len(KNOTS) - 1)
    share = (x - KNOTS[right - 1]) / (KNOTS[right] - KNOTS[right - 1])
    hats = np.zeros((rows, d, len(KNOTS)))
    i, j = np.ogrid[:rows, :d]
    hats[i, j, right] = share
    hats[i, j, right - 1] += 1 - share
    return np.concatenate([np.ones((rows, 1)), hats[:, :, 1:].reshape(rows, -1)], axis=1)


def features(docs: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [ratios(v.as_py()) for v in batch.column(1)]
            flat = np.concatenate(x) if x else np.empty(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_RATIOS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], ["doc_id", "x", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("text_hash")).mapInArrow(task, "doc_id long, x array<float>, text_hash long")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_RATIOS)


def _sums(rows: DataFrame, of_batch, size: int) -> np.ndarray:
    """The sum of ``of_batch(x, positive)`` over all rows: by task, then by a bounded number of groups, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                total += of_batch(expand(_matrix(part.column(0))), part.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_buffer()) for v in table.column("total")], axis=0)
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x", "positive").mapInArrow(partial, "part int, total binary")
    return np.sum([np.frombuffer(r["total"]) for r in parts.groupBy("part").applyInArrow(merge, "total binary").collect()] or [np.zeros(size)], axis=0)


def _curves(w: np.ndarray):
    """Sums at weights ``w``: for positives and for all rows, count, losses, gradient parts and curvature."""
    d = len(w)

    def of_batch(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        g = np.clip(x @ w, -30, 30)
        s = 1 / (1 + np.exp(-g))
        up, down = np.logaddexp(0, -g), np.logaddexp(0, g)
        out = []
        for rows in (positive, slice(None)):
            a, b = x[rows], s[rows]
            out += [[len(a), up[rows].sum(), down[rows].sum()], b @ a, a.sum(axis=0), ((a * (b * (1 - b))[:, None]).T @ a).ravel()]
        return np.concatenate(out)

    return of_batch, 2 * (3 + 2 * d + d * d)


def _unpack(v: np.ndarray, d: int) -> tuple:
    half = 3 + 2 * d + d * d
    return tuple((p[0], p[1], p[2], p[3 : 3 + d], p[3 + d : 3 + 2 * d], p[3 + 2 * d :].reshape(d, d)) for p in (v[:half], v[half:]))


def fit(rows: DataFrame, steps: int = 8, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and class prior from training rows (doc_id, x, positive)."""
    d = SIZE
    apart = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    told = rows.where(~F.coalesce(apart, F.lit(False)))
    penalty = max(ridge, 1 / max(1, rows.where("positive").count())) * np.eye(d)
    penalty[0, 0] = 1e-9
    w = np.zeros(d)
    for _ in range(steps):  # positives against unlabelled text, as if of equal number
        (n_p, _, _, sp, xp, hp), (n_u, _, _, su, _, hu) = _unpack(_sums(told, *_curves(w)), d)
        if not n_p:
            return np.zeros(d), 0.5
        step = np.linalg.solve((hp / n_p + hu / n_u) + penalty, (sp - xp) / n_p + su / n_u + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    prior = estimate_prior(rows.where(apart), w)
    w = np.zeros(d)
    w[0] = np.log(prior / (1 - prior))
    best, least, since = w, np.inf, 0
    for _ in range(2 * steps):
        (n_p, up_p, down_p, sp, xp, _), (n_u, _, down_u, su, _, hu) = _unpack(_sums(rows, *_curves(w)), d)
        negative = down_u / n_u - prior * down_p / n_p
        risk = prior * up_p / n_p + max(0.0, negative) + 0.5 * w @ penalty @ w
        best, least, since = (w, risk, 0) if risk < least - 1e-6 else (best, least, since + 1)
        if since == 4:
            break
        if negative < 0:  # the corrected risk does not fall this way any more: raise its negative part back to 0
            step = -0.5 * np.linalg.solve(hu / n_u + penalty, su / n_u - prior * sp / n_p)
        else:
            step = np.linalg.solve(hu / n_u + penalty, su / n_u - prior * xp / n_p + penalty @ w)
        step *= min(1.0, 20 / max(1e-9, np.abs(step).max()))
        w = w - step
        if negative >= 0 and np.abs(step).max() < 1e-2:
            break
    return best, prior


def estimate_prior(rows: DataFrame, w: np.ndarray, bins: int = 400, least_mass: float = 0.5, z: float = 1.5) -> float:
    """The smallest ratio of unlabelled to positive mass over regions of high score that hold half of the positives or more.

    It is a lower confidence bound (``z`` standard errors): too high a prior would make unlabelled positives pay for more positives than there
    are, and the risk negative; too low a one only lowers the scores of positives.
    """

    def of_batch(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        s = np.clip(((1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))) * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(s[positive], minlength=bins), np.bincount(s, minlength=bins)]).astype(float)

    v = _sums(rows, of_batch, 2 * bins)
    p, u = v[:bins][::-1].cumsum(), v[bins:][::-1].cumsum()
    if not p[-1]:
        return 0.5
    mass_p, mass_u = p / p[-1], u / u[-1]
    high = mass_p + z * np.sqrt(mass_p * (1 - mass_p) / p[-1])
    low = mass_u - z * np.sqrt(mass_u * (1 - mass_u) / u[-1])
    enough = mass_p >= least_mass
    return float(np.clip((low[enough] / high[enough]).min(), 0.05, 0.99))


def score(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, cut: float = 0.3) -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted, prior) for each row of ``docs`` (doc_id, text); ``labels`` (doc_id, quality). An id and
    text_hash (xxhash64) together tell the row."""
    held_out = F.coalesce(fold("doc_id") == held_out_fold, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long"), "quality").where(fold("doc_id") != held_out_fold).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    table = stored(features(docs).join(known, "doc_id", "left").select("doc_id", "x", "text_hash", held_out.alias("held_out"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("positive")), "quality")
    weights, prior = fit(table.where("NOT held_out"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [1 / (1 + np.exp(-np.clip(expand(_matrix(batch.column(3).slice(k, 2000))) @ weights, -30, 30))) for k in range(0, batch.num_rows, 2000)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(s) if s else np.empty(0))], ["doc_id", "text_hash", "held_out", "score"])

    scored = table.select("doc_id", "text_hash", "held_out", "x").mapInArrow(task, "doc_id long, text_hash long, held_out boolean, score double")
    return scored.withColumns({"predicted": (F.col("score") >= cut).cast("int"), "prior": F.lit(prior)})
