"""Language identification by a convolutional network over bytes (operator 13).

A text's UTF-8 bytes are cut into windows of `WINDOW` bytes; neighbours share `max(WIDTHS) - 1` bytes, so that no n-gram
is lost, and the last one is filled up with zeros. The network embeds each byte in `DEPTH` numbers, runs `FILTERS`
filters of each of the `WIDTHS` over a window, keeps each filter's greatest value (rectified, with its bias), and gives
the languages' probabilities by a dense layer and softmax. A text's log-probabilities are the means over its windows,
weighted by their bytes.

Training, in numpy on the driver, reads a bounded sample of labelled texts: about `train_rows` rows in all, as evenly over
the languages as they allow, those with the smallest key hashes, and `TRAIN_WINDOWS` windows of each, spread over the
text. It is Adam over minibatches with seeded numbers, so a table gives one model. Prediction covers all windows of all
rows; a filter's value at a place is read from two tables of byte pairs, which is the same sum as embedding and filter.

Defined results: null texts and texts without a letter are `und` with score 0; null langs and null doc_ids teach nothing;
without a labelled language all are `und`; one language alone is given to all with score 1; at most `MOST_LANGS` languages are
learned, the most frequent ones; repeated rows get equal results; an empty table gives no rows; other columns are
ignored. No lang, source or id enters a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, DEPTH, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 8
TRAIN_WINDOWS, MOST_LANGS, CHUNK, LONGEST = 4, 256, 64, max(WIDTHS)
STEP = WINDOW - LONGEST + 1  # places a window has for the widest filter
BATCH, PASSES, RATE = 64, 6, 0.01


def windows_of(text: bytes, most: int = 0) -> np.ndarray:
    """The windows of a text, as rows; most: so many of them, spread over it."""
    n = max(1, -(-max(0, len(text) - LONGEST + 1) // STEP))
    raw = np.zeros(n * STEP + LONGEST - 1, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[::STEP]
    return rows if not most or n <= most else rows[np.linspace(0, n - 1, most).astype(int)]


class Network:
    """Bytes to log-probabilities of languages; forward and backward passes over windows, in numpy."""

    def __init__(self, langs: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        self.embed = normal(256, DEPTH, scale=0.5)
        self.embed[0] = 0  # the filling
        self.filters = normal(LONGEST, DEPTH, n, scale=(LONGEST * DEPTH) ** -0.5)
        self.used = np.zeros_like(self.filters)
        for k, w in enumerate(WIDTHS):
            self.used[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters *= self.used
        self.bias = np.zeros(n, np.float32)
        self.dense = normal(n, langs, scale=n**-0.5)
        self.shift = np.zeros(langs, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.shift]

    def pair_tables(self) -> list[np.ndarray]:
        """Of each two neighbouring places of a filter, what a pair of bytes adds: tables of 65,536 rows."""
        one = np.einsum("bd,kdf->kbf", self.embed, self.filters)
        return [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(1 << 16, -1).astype(np.float32) for k in range(0, LONGEST, 2)]

    def pooled(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Each filter's greatest value in each window, and rectified."""
        pairs = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        total = tables[0][pairs[:, :STEP]]
        for k in range(1, len(tables)):
            total += tables[k][pairs[:, 2 * k : 2 * k + STEP]]
        return np.maximum(total.max(axis=1) + self.bias, 0)

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.dense + self.shift
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean loss over windows, and its gradients in the order of parameters()."""
        n = len(windows)
        places = np.lib.stride_tricks.sliding_window_view(windows, LONGEST, axis=1)  # (n, STEP, LONGEST) bytes
        x = self.embed[places].reshape(n, STEP, LONGEST * DEPTH)
        flat = self.filters.reshape(LONGEST * DEPTH, -1)
        total = x @ flat
        at = total.argmax(axis=1)
        top = np.take_along_axis(total, at[:, None, :], 1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        logs = self.log_probabilities(pooled)
        d = np.exp(logs)
        d[np.arange(n), labels] -= 1
        d /= n
        back = (d @ self.dense.T) * (top > 0)  # (n, filters), each at its own place
        own = x[np.arange(n)[:, None], at]
        filters = np.einsum("nf,nfc->cf", back, own).reshape(self.filters.shape) * self.used
        embed = np.zeros_like(self.embed)
        spread = np.einsum("nf,kdf->nfkd", back, self.filters)
        np.add.at(embed, places[np.arange(n)[:, None], at], spread)
        embed[0] = 0
        return float(-logs[np.arange(n), labels].mean()), [embed, filters, back.sum(axis=0), pooled.T @ d, d.sum(axis=0)]


def train(windows: np.ndarray, labels: np.ndarray, langs: int, passes: int = PASSES, seed: int = 0) -> Network:
    """Adam over shuffled minibatches, its rate falling to nothing."""
    net, rng = Network(langs, seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    steps, t = passes * -(-len(windows) // BATCH), 0
    for _ in range(passes):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            t += 1
            rows = order[a : a + BATCH]
            for p, g, m, v in zip(net.parameters(), net.gradients(windows[rows], labels[rows])[1], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(key):
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def sample(documents: DataFrame, train_rows: int) -> tuple[list[str], DataFrame]:
    """The languages to learn, and the bounded sample (doc_id, lang, text)."""
    known = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    langs = sorted(r["lang"] for r in top)
    share = [(r["lang"], min(1.0, train_rows / len(top) / r["n"])) for r in top]
    if not share:
        return [], known.select("doc_id", "lang", "text").limit(0)
    least = documents.sparkSession.createDataFrame(share, "lang string, share double")  # MOST_LANGS rows at most
    place = (F.xxhash64("doc_id", F.lit("language")) / F.lit(2.0**64)) + 0.5
    return langs, known.join(F.broadcast(least), "lang").where(place <= F.col("share")).select("doc_id", "lang", "text")


def fit(documents: DataFrame, train_rows: int = 2_000) -> tuple[list[str], Network | None]:
    """The languages and the network; none if there is no labelled text."""
    langs, rows = sample(documents, train_rows)

    def run(batches):
        for batch in batches:
            cut = [(lang, windows_of(bytes(text), TRAIN_WINDOWS)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            flat = [(lang, w.tobytes()) for lang, ws in cut for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.binary())], names=["lang", "bytes"])

    got = rows.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, bytes binary").collect()  # TRAIN_WINDOWS windows for each sample row
    if not got:
        return langs, None
    got = sorted((r["lang"], bytes(r["bytes"])) for r in got)
    number = {lang: k for k, lang in enumerate(langs)}
    return langs, train(np.array([np.frombuffer(b, np.uint8) for _, b in got]), np.array([number[lang] for lang, _ in got]), len(langs))


def predict(documents: DataFrame, langs: list[str], net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row (doc_id, text)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast((langs, net))  # a few thousand numbers

    def run(batches):
        names, model = shared.value
        tables = model.pair_tables() if model else []
        for batch in batches:
            out = []
            for text, letters in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                if not letters or model is None:
                    out.append(("und", 0.0))
                    continue
                raw = text.as_py()
                rows, total = windows_of(raw), np.zeros(len(names))
                weight = np.full(len(rows), STEP, np.float64)
                weight[-1] = max(1, len(raw) - (len(rows) - 1) * STEP)
                for a in range(0, len(rows), CHUNK):
                    logs = model.log_probabilities(model.pooled(rows[a : a + CHUNK], tables))
                    total += weight[a : a + CHUNK] @ logs
                logs = total / weight.sum()
                p = np.exp(logs - logs.max())
                best = int(p.argmax())
                out.append((names[best], round(float(p[best] / p.sum()), 9)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = documents.select("doc_id", F.col("text").cast("binary").alias("text"), letters.alias("letters")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def language(documents: DataFrame, train_rows: int = 2_000) -> DataFrame:
    return predict(documents, *fit(documents, train_rows))
