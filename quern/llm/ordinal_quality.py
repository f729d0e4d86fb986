"""Graded quality by ordinal cumulative-link regression on hashed text.

Grades: 0 for low quality, 1 for good but toxic text, 2 for good text. One weight vector over hashed features is shared by
all thresholds: P(grade >= k) = sigmoid(w.x - t_k) with t_1 < t_2. Features are the presence of word pieces and of words
and of a few facts about the form of the text (length, variety, shares of letters), all hashed into ``BUCKETS``.
The weights have an L1 penalty, so words that tell nothing weigh nothing. Expected grade = sum of the tail
probabilities; a document is kept if its tail probability P(grade >= ``KEEP_GRADE``) is at least ``KEEP_TAIL``.

The fit uses a sample of at most about ``MAX_ROWS`` labelled documents, chosen by a hash of doc_id; it runs on the driver
in numpy over features of bounded number. Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import as_bytes, bound_batches, keep, mix64, only

BUCKETS = 1 << 18
#: Labelled documents that are fitted on, and distinct features of one of them that are kept for the fit, chosen by a hash that is the same for all (scoring uses all):
#: what reaches the driver is at most their product times four bytes.
MAX_ROWS, MAX_FEATURES = 16_000, 3_000
GRADES = 3
KEEP_GRADE, KEEP_TAIL = 2, 0.3
LAMBDA, ROUNDS, RATE = 2e-4, 300, 0.1

_PIECES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _step(share: float) -> int:
    return min(20, int(share * 20 + 0.5))


class Hasher(dict):
    MOST = 200_000

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[piece] = xxhash.xxh3_64_intdigest(piece) % BUCKETS
        return value


_HASHES = Hasher()
keep("quality", _HASHES)


def features(text: str | None) -> np.ndarray:
    """The sorted distinct buckets of a text; a null text is empty."""
    text = text or ""
    low = text.lower()
    pieces, words = _PIECES.findall(low), low.split()
    kinds, distinct = set(pieces), set(words)
    signs = sum(map(len, (p for p in pieces if not p[0].isalnum())))
    letters = max(1, len(text) - text.count(" "))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)) if text else 0
    digits = sum(len(p) for p in pieces if p[0].isdigit())
    form = (
        f"\0variety {_step(len(distinct) / max(1, len(words)))}", f"\0length {len(words).bit_length()}", f"\0signs {_step(signs / letters)}",
        f"\0upper {_step(upper / letters)}", f"\0digits {_step(digits / letters)}", f"\0word {min(20, letters // max(1, len(words)))}",
        f"\0lines {_step(text.count(chr(10)) / max(1, len(words)))}",
    )
    found = np.fromiter(map(_HASHES.__getitem__, [*kinds, *form]), np.int32, len(kinds) + len(form))
    return np.unique(found)


def fitted(text: str) -> np.ndarray:
    """At most ``MAX_FEATURES`` of a text's buckets."""
    found = features(text)
    if len(found) <= MAX_FEATURES:
        return found
    order = np.argsort(mix64(found.astype(np.uint64)), kind="stable")
    return np.sort(found[order[:MAX_FEATURES]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Shared weights by bucket and the ordered thresholds of grades 1, 2, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of texts by their features."""
        scores = np.array([self.weights[x].sum() for x in found]).reshape(-1, 1)
        return _sigmoid(scores - self.thresholds)

    def digest(self) -> str:
        return hashlib.sha256(self.weights.tobytes() + self.thresholds.tobytes()).hexdigest()


def fit(found: list[np.ndarray], grades: np.ndarray, least: int = 5, rounds: int = ROUNDS) -> Model:
    """Of features and grades 0, 1, 2, ... Proximal gradient steps (Adam with soft thresholds), all rows at once.

    Features of fewer than ``least`` rows get no weight. Without rows every grade is equally likely.
    """
    weights = np.zeros(BUCKETS)
    levels = np.arange(1, GRADES)
    if not len(found):
        return Model(weights, np.log((levels) / (GRADES - levels)))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    used = np.flatnonzero(counts >= least)
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[used] = np.arange(len(used))
    rows = [number[x] for x in found]
    rows = [x[x >= 0] for x in rows]
    columns = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    lengths = np.array([len(x) for x in rows])
    row_of = np.repeat(np.arange(len(rows)), lengths)
    share = np.array([np.clip(np.mean(grades >= k), 1e-3, 1 - 1e-3) for k in levels])
    # Thresholds as a first value and positive gaps, so that they stay in order.
    start = np.maximum.accumulate(np.log((1 - share) / share))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    x = np.concatenate((np.zeros(len(used)), start[:1], gaps))
    m, v = np.zeros_like(x), np.zeros_like(x)
    reached = grades[:, None] >= levels
    n, k = len(rows), len(used)
    # Each threshold's two sides weigh alike, within bounds: rare grades count.
    balance = np.where(reached, np.clip(0.5 / share, 0.5, 4), np.clip(0.5 / (1 - share), 0.5, 4))
    for t in range(1, rounds + 1):
        thresholds = x[k] + np.concatenate(([0.0], np.cumsum(np.exp(x[k + 1 :]))))
        scores = np.bincount(row_of, weights=x[columns], minlength=n)
        error = (_sigmoid(scores[:, None] - thresholds) - reached) * balance / n
        grad = np.zeros_like(x)
        grad[:k] = np.bincount(columns, weights=error.sum(axis=1)[row_of], minlength=k)
        down = -error.sum(axis=0)
        grad[k] = down.sum()
        grad[k + 1 :] = [down[i:].sum() * np.exp(x[k + i]) for i in range(1, len(levels))]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        x = x - step * m / (1 - 0.9**t)
        x[:k] = np.sign(x[:k]) * np.maximum(np.abs(x[:k]) - np.minimum(step[:k], 1e3) * LAMBDA, 0)
    weights[used] = x[:k]
    return Model(weights, x[k] + np.concatenate(([0.0], np.cumsum(np.exp(x[k + 1 :])))))


def grade(quality: str = "quality", toxic: str = "toxic"):
    """The grade of a labelled row; null where a label that it needs is null."""
    return F.when(F.col(quality) == 0, 0).when((F.col(quality) == 1) & (F.col(toxic) == 1), 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most about ``max_rows`` labelled documents. Labels that contradict each other on a doc_id all count."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rated = labels.select(F.col("doc_id").alias("_rated"), grade().cast("int").alias("_grade")).where("_rated IS NOT NULL AND _grade IS NOT NULL")
    total = rated.count()
    if total > max_rows:
        rated = rated.where(F.pmod(F.xxhash64("_rated", F.lit(3)), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("_rated")).select("_rated", "text", "_grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            found = [fitted((x or b"").decode()).tobytes() for x in as_bytes(batch.column(1))]
            yield pa.record_batch({"doc": batch.column(0), "found": pa.array(found, pa.binary()), "grade": batch.column(2)})

    kind = dict(rated.dtypes)["_rated"]
    got = sorted(rows.mapInArrow(run, f"doc {kind}, found binary, grade int").collect(), key=lambda r: (r.doc, r.grade, bytes(r.found)))
    return fit([np.frombuffer(bytes(r.found), np.int32) for r in got], np.array([r.grade for r in got], dtype=np.int64))


def score(docs: DataFrame, model: Model, grade: str = "_grade", tail: str = "_tail", keep: str = "_keep") -> DataFrame:
    """All rows and columns of ``docs`` with the expected grade, P(grade >= KEEP_GRADE) and whether that is at least KEEP_TAIL, under the three names given;
    columns of ``docs`` that have one of them are replaced.

    Null and empty texts are scored as texts without words; very long texts are read whole; repeated rows get equal scores; an empty table stays empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    added = (grade, tail, keep)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {a.lower() for a in added}])
    at, names = docs.columns.index("text"), [*docs.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            tails = shared.value.tails([features((x or b"").decode()) for x in as_bytes(batch.column(at))]).round(9)
            high = tails[:, KEEP_GRADE - 1]
            more = [pa.array(tails.sum(axis=1)), pa.array(high), pa.array(high >= KEEP_TAIL)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    schema = StructType(list(docs.schema)).add(grade, "double").add(tail, "double").add(keep, "boolean")
    return docs.mapInArrow(run, schema)
