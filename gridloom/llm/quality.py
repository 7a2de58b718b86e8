"""Quality rules as weak supervision (operator 10).

Each rule votes good (1), bad (-1) or abstains (0). The votes of all rows are counted by pattern, with partial sums in
the tasks; the patterns are at most 3 ** len(RULES), so their counts may go to the driver. There expectation-maximisation
estimates each rule's accuracy on good and on bad documents and the share of good ones; no labels are read. A document
is kept if its posterior probability of being good reaches `threshold`.

Defined results: null and empty texts have no words, so the base rule rejects them; repeated rows get equal results;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

RULES = ("word_length", "symbols", "repeated_lines", "repeated_windows", "capitals", "letters", "vocabulary", "separators")
#: The bounds of each rule: (good if at most, bad if at least) of a figure that is low in good texts.
BOUNDS = {
    "word_length": (6.0, 12.0), "symbols": (0.01, 0.05), "repeated_lines": (0.05, 0.3), "repeated_windows": (0.05, 0.28),
    "capitals": (0.2, 0.6), "letters": (0.15, 0.25), "vocabulary": (0.5, 0.85), "separators": (0.02, 0.2),
}
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, pattern int"
WINDOW = 8
#: Beta priors of the rules' accuracies on bad and good texts and of the share of good ones, as means and pseudo-votes.
PRIOR = {"bad": 0.3, "good": 0.98, "share": 0.85, "votes": 20.0}


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of eight words that are found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    roll = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(roll, kind="stable")
    twice = roll[order][1:] == roll[order][:-1]
    if not twice.any():
        return 0
    at = np.unique(order[np.r_[twice, False] | np.r_[False, twice]])
    seen: dict[tuple, int] = {}
    marks = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        gram = tuple(words[i : i + WINDOW])
        first = seen.setdefault(gram, i)
        if first != i:
            for p in (first, i):
                marks[p] += 1
                marks[p + WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def measure(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    letters = sum(map(str.isalpha, text))
    figures = (
        chars / n, symbols / chars, dup / max(len(lines), 8), repeat / n,
        sum(map(str.isupper, text)) / max(letters, 1), (chars - letters) / max(chars, 300), 1 - len(set(words)) / n, words.count(b"|") / n,
    )
    pattern = 0
    for name, x in zip(RULES, figures, strict=True):
        good, bad = BOUNDS[name]
        pattern = 3 * pattern + (1 if x <= good else 2 if x >= bad else 0)
    return n, chars, symbols, dup, repeat, pattern


def measured(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the measures of each text; pattern has the votes as digits base 3 (0 abstains, 1 good, 2 bad)."""
    source = text_col if text_col in keep else "__text"

    def run(batches):
        for batch in batches:
            rows = [measure(t or "") for t in batch.column(source).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.int32()) for k in range(6)]
            names = [x.split()[0] for x in MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols, names=[*keep, *names])

    picked = df.select(*keep) if source in keep else df.select(*keep, F.col(text_col).alias(source))
    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return picked.mapInArrow(run, head + MEASURES)


def votes_of(pattern: np.ndarray) -> np.ndarray:
    digits = (pattern[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1)) % 3
    return np.where(digits == 2, -1, digits)


def fit(pattern: np.ndarray, count: np.ndarray, rounds: int = 60) -> dict[int, float]:
    """Pattern to posterior probability of good, by expectation-maximisation over the counted patterns.

    acc[c, r]: probability that rule r, if it votes, votes rightly on class c (0 bad, 1 good). Both are estimated; PRIOR
    gives the mean and the number of the pseudo-votes that keep them off 0 and 1 and say which class is which.
    """
    if not len(pattern):
        return {}
    v, n = votes_of(pattern), count.astype(float)
    means, votes = np.array([[PRIOR["bad"]], [PRIOR["good"]]]), PRIOR["votes"]
    acc, prior = means.repeat(len(RULES), axis=1), PRIOR["share"]
    post = np.zeros(len(n))
    for _ in range(rounds):
        good = np.log(prior) + ((v == 1) * np.log(acc[1]) + (v == -1) * np.log(1 - acc[1])).sum(axis=1)
        bad = np.log(1 - prior) + ((v == -1) * np.log(acc[0]) + (v == 1) * np.log(1 - acc[0])).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        w1, w0 = n * post, n * (1 - post)
        for c, w in ((0, w0), (1, w1)):
            right = (w[:, None] * (v == (1 if c else -1))).sum(0)
            acc[c] = (right + votes * means[c]) / ((w[:, None] * (v != 0)).sum(0) + votes)
        prior = float((w1.sum() + votes * PRIOR["share"]) / (n.sum() + votes))
    return dict(zip(pattern.tolist(), post.tolist(), strict=True))


def verdicts(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, quality (posterior) and kept to rows that have MEASURES."""
    counts = rows.where("n_words > 0").groupBy("pattern").count().toPandas()  # at most 3 ** len(RULES) rows
    counts = counts.sort_values("pattern")
    post = fit(counts["pattern"].to_numpy(np.int64), counts["count"].to_numpy(np.int64))
    spark = rows.sparkSession
    scored = spark.createDataFrame([(int(p), float(x)) for p, x in post.items()], "pattern int, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.join(F.broadcast(scored), "pattern", "left").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= threshold))


def quality(df: DataFrame, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    rows = materialise(measured(df, text_col, (id_col,)))
    out = verdicts(rows, threshold)
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def keep_good(df: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df that quality() keeps, with all their columns."""
    plain = {c: f"__{k}" for k, c in enumerate(df.columns)}
    numbered = df.select(*[F.col(f"`{c}`").alias(x) for c, x in plain.items()])
    rows = materialise(measured(numbered, plain[text_col], tuple(plain.values())))
    return verdicts(rows, threshold).where("kept").select(*[F.col(x).alias(c) for c, x in plain.items()])
