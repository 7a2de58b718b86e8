"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios (operator 3).

A text's features are the hashed n-grams of its lower-cased characters, for n in `LENGTHS`, each counted once however
often it occurs. Each feature is scaled by its naive Bayes log-count ratio
r = log((p + a * P) / (P + a)) - log((q + a * Q) / (Q + a)), where p and q are its counts among the toxic and the other
texts, whose shares are P and Q of one, and a is `SMOOTHING`: a rare feature has a ratio near 0. A logistic regression
is fitted on the scaled features; the prior variance of a feature's weight is its squared ratio over `ridge`.

Fitting reads a bounded sample: at most about `train_rows` labelled rows, those with the smallest key hashes, so that
the same rows are picked on any cluster. All 2 ** BITS features count. The sample's features are a table in the shared
folder; each step of the fit (limited-memory BFGS) is one job over it, whose tasks return a loss and a gradient. Counts,
weights and gradients, 2 ** BITS numbers each, are the only things that pass through the driver. Scoring covers all
rows and whole texts.

Defined results: null and empty texts have no features and score the intercept; null labels and null doc_ids teach
nothing; a document with several labels counts as toxic if one says so; a table without both classes of labels gives
the constant score of its labels' mean; repeated rows get equal scores; other columns are ignored. No label, language,
source or id enters a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

BITS = 18
LENGTHS = (4, 5, 6)
SMOOTHING = 50.0
BLOCK = 1 << 16


def features(text: str) -> np.ndarray:
    """The hashed n-grams of a text's lower-cased characters; long texts go through in overlapping blocks."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") if text else np.empty(0, "<u4")
    found = []
    for a in range(0, len(raw), BLOCK):
        x = raw[a : a + BLOCK + max(LENGTHS) - 1].copy()
        x[(x >= 9) & (x <= 13)] = 32
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) ^ x[n - 1 :]
            if n in LENGTHS:
                found.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    if not found:
        return np.empty(0, np.int64)
    return np.concatenate(found)


def once(h: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Distinct values: a value's last position wins its slot."""
    at = np.arange(len(h), dtype=np.int32)
    slot[h] = at
    return h[slot[h] == at]


def sample(df: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(text, toxic) of the bounded training sample. Its labels are few enough to broadcast."""
    fit = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    fit = fit.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = fit.count()
    if n > train_rows:
        share = int((2 * train_rows / n - 1) * (1 << 63)) if n < 2 * train_rows else -(1 << 63) + int(train_rows / n * (1 << 64))
        fit = fit.where(F.xxhash64("doc_id", F.lit("sample")) < share)
    return df.select("doc_id", "text").join(F.broadcast(fit), "doc_id").select("text", "toxic")


def sample_features(rows: DataFrame) -> DataFrame:
    """(label, f): the distinct features of each sample text, sorted."""

    def run(batches):
        slot = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            out = [np.sort(once(features(t or ""), slot)).astype(np.int32) for t in batch.column(0).to_pylist()]
            label = [float(y > 0) for y in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(out, pa.list_(pa.int32()))], names=["label", "f"])

    return rows.mapInArrow(run, "label double, f array<int>")


def feature_counts(held: DataFrame) -> DataFrame:
    """(h, p, q): in how many toxic and other sample texts each feature occurs; each task adds up its own rows first."""

    def run(batches):
        count = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for y, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                count[int(y)][f.values.to_numpy()] += 1
        at = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[1][at]), pa.array(count[0][at])], names=["h", "p", "q"])

    return held.mapInArrow(run, "h bigint, p bigint, q bigint").groupBy("h").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def log_count_ratios(p: np.ndarray, q: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Of the features' document counts in pos toxic and neg other texts; 0 where a feature doesn't occur."""
    a, b = SMOOTHING * pos / (pos + neg), SMOOTHING * neg / (pos + neg)
    return np.where(p + q > 0, np.log((p + a) / (pos + a)) - np.log((q + b) / (neg + b)), 0.0)


def loss_and_gradient(held: DataFrame, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed logistic loss over the sample and its gradient; x: a feature's weights and, last, the intercept."""
    shared = held.sparkSession.sparkContext.broadcast(x)

    def run(batches):
        v, total, loss = shared.value, np.zeros(len(shared.value)), 0.0
        for batch in batches:
            for y, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = f.values.to_numpy()
                z = float(v[f].sum() + v[-1])
                loss += float(np.logaddexp(0.0, z)) - y * z
                g = 1 / (1 + np.exp(-z)) - y if abs(z) < 500 else float(z > 0) - y
                total[f] += g  # a text's features are distinct
                total[-1] += g
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=["loss", "gradient"])

    parts = held.mapInArrow(run, "loss double, gradient binary").collect()  # a row of 2 ** BITS doubles for each of few tasks
    shared.destroy()
    return sum(r["loss"] for r in parts), np.sum([np.frombuffer(r["gradient"]) for r in parts], axis=0)


def minimise(f, x: np.ndarray, steps: int, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Limited-memory BFGS with step halving; f gives a value and its gradient."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -slope, []
        for s, y in reversed(moves):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        d = d * ((moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.linalg.norm(slope))))
        for (s, y), a in zip(moves, reversed(back), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0
        while True:
            new = x + step * d
            new_value, new_slope = f(new)
            if new_value <= value + 1e-4 * step * (slope @ d) or step < 1e-4:
                break
            step /= 2
        if (new - x) @ (new_slope - slope) > 0:
            moves = [*moves, (new - x, new_slope - slope)][-memory:]
        settled = abs(value - new_value) <= tolerance * abs(value)
        x, value, slope = new, new_value, new_slope
        if settled:
            break
    return x


def fit(df: DataFrame, labels: DataFrame, train_rows: int = 6_000, ridge: float = 1.0, steps: int = 40):
    """(weights over all 2 ** BITS features, intercept)."""
    held = materialise(sample_features(sample(df, labels, train_rows)), 500)
    n = {r["label"] > 0: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos or not neg:
        share = (pos + 0.5) / (pos + neg + 1)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    c = feature_counts(held).toPandas()  # at most 2 ** BITS rows
    p, q = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    p[c["h"]], q[c["h"]] = c["p"], c["q"]
    # with u for a weight over its prior deviation: a feature counts r * (weight = r * u)
    scale = np.append(log_count_ratios(p, q, pos, neg) ** 2, 1.0)
    few = held.coalesce(8)

    def penalised(u):
        loss, slope = loss_and_gradient(few, scale * u)
        prior = np.append(u[:-1], 0.0)
        return (loss + ridge / 2 * (prior @ prior)) / (pos + neg), (scale * slope + ridge * prior) / (pos + neg)

    u = minimise(penalised, np.append(np.zeros(1 << BITS), np.log(pos / neg)), steps)
    w = scale * u
    return w[:-1].astype(np.float32), float(w[-1])


def score(df: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # 2 ** BITS floats, whatever the input

    def run(batches):
        w, slot = shared.value, np.zeros(1 << BITS, np.int32)
        for batch in batches:
            z = []
            for t in batch.column(1).to_pylist():
                h = features(t or "")
                h = h[w[h] != 0]
                z.append(float(w[once(h, slot)].sum(dtype=np.float64)) + intercept)
            s = np.round(1 / (1 + np.exp(-np.clip(np.array(z), -500, 500))), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = df.schema["doc_id"].dataType.simpleString()
    out = df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def toxicity(df: DataFrame, labels: DataFrame, train_rows: int = 6_000) -> DataFrame:
    return score(df, *fit(df, labels, train_rows))
