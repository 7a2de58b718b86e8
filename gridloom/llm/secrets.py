"""Secret scans by sliding-window Shannon entropy (operator 7).

Three base kinds (assign, access, hex) follow fixed patterns. The method adds kind `entropy`: every maximal run of token
characters of at least `MIN_RUN` is a candidate, and so is what follows its fixed prefix, if it has one (`ghp_`, `sk-live-`:
up to two short words that end in a dash or underscore). A candidate's character class (hex, alphanumeric, base64) sets the
window's entropy threshold. The window's entropy comes from incremental counts: one count goes up and one down per step, and the
sum of c*log2(c) is corrected by the two changes. Runs that overlap a base span, and runs that the allow-list matches
(public values, plain words and numbers, identifiers, runs that are mostly readable words) are suppressed. Positions are code points, ends exclusive.

Defined results: null texts are empty; texts of any length are scanned whole; repeated rows give repeated rows; an empty
table gives an empty one; other columns are ignored by the scan and kept by redaction, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_RUN = 20
#: A word in a name: capitals alone, or small letters after at most one capital.
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Escapes of an address's punctuation that lost their percent signs.
ESCAPES = re.compile(r"3A2F2F|2F|2E|2D|3A|3D|3F|5F")
#: What a word that can be spoken has: four letters, no more than three consonants or vowels in a row.
SPOKEN = re.compile(r"(?=.{4})(?=.*[aeiouyAEIOUY])(?!.*[^aeiouyAEIOUY]{4})(?!.*[aeiouyAEIOUY]{4})")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
WINDOW = 20
#: Fixed prefixes of keys.
PREFIX = re.compile(rf"(?:[A-Za-z]{{2,8}}[_-]){{1,2}}(?=[A-Za-z0-9+/_=-]{{{WINDOW}}})")
#: Entropy in bits a character that a window of 20 must reach, by class, and the digits and letters the run must have.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Runs that look random but are public: hash-named paths, UUID-like groups, rulers, URLs' path words.
ALLOW = re.compile(r"[0-9]+|[A-Za-z]+|(?:[A-Za-z]+[-_/=+]+)*[A-Za-z]*|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(.)\1*")
#: Fixed values that are public: examples that documentation prints, and digests and identifiers that everyone knows.
PUBLIC = {
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "je7MtGbClwBF/2Zp9Utk/h3yCo8nvbEXAMPLEKEY",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789",
    "dGhlIHNhbXBsZSBub25jZQ==", "258EAFA5-E914-47DA-95CA-C5AB0DC85B11",
}
PLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def char_class(run: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def best_entropy(run: str) -> float:
    """The largest entropy of a window of WINDOW characters, by incremental counts."""
    counts: dict[str, int] = {}
    total = 0.0
    best = 0.0
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += PLOG[n + 1] - PLOG[n]
        counts[c] = n + 1
        if i >= WINDOW:
            old = run[i - WINDOW]
            n = counts[old]
            total += PLOG[n - 1] - PLOG[n]
            counts[old] = n - 1
        if i >= WINDOW - 1:
            best = max(best, math.log2(WINDOW) - total / WINDOW)
    return best


def readable(run: str) -> bool:
    """Names, paths and escaped addresses: few changes between letters and digits, and words with vowels make up most."""
    run = ESCAPES.sub(" ", run)
    parts = WORDS.findall(run)
    held = sum(len(w) for w in parts if SPOKEN.match(w) and 4 * sum(c in "aeiouyAEIOUY" for c in w) >= len(w))
    return held >= 0.55 * (len(run) - run.count(" "))


def is_random(run: str) -> bool:
    """Whether the run, or what follows its prefix, looks random."""
    head = PREFIX.match(run)
    return looks_random(run) or head is not None and run not in PUBLIC and not ALLOW.fullmatch(run) and looks_random(run[head.end() :])


def looks_random(run: str) -> bool:
    if run in PUBLIC or ALLOW.fullmatch(run) or readable(run) or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
        return False
    return best_entropy(run) >= THRESHOLDS[char_class(run)]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans as (start, index of the kind, end), sorted."""
    base = []
    if "=" in text or ":" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts = [a for a, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))  # the furthest end so far
    added = []
    for m in RUN.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)
        if not (before and ends[before - 1] > a) and is_random(m[0]):
            added.append((a, 3, b))
    return base, added


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, added = scan(t or "")
                n = [sum(k == x[1] for x in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
            cols = [pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by mark; null texts stay null."""

    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            clean = [None if t is None else masked(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(clean, pa.string()))

    numbered = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(df.schema))
    return numbered.mapInArrow(run, kinds).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def masked(text: str, mark: str) -> str:
    base, added = scan(text)
    out, last = [], 0
    for a, _, b in sorted(base + added):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text
