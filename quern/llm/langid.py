"""Language identification by multinomial naive Bayes over hashed character n-grams.

n-grams of ``ORDERS`` characters of the lower-cased text are hashed into ``BUCKETS``; a language is the smoothed distribution
of its buckets. The log-probability matrix (``BUCKETS`` x languages, single precision, at most ``MAX_LANGS`` languages) is broadcast; a
batch of texts is one array of code points: its n-grams are hashed together, their rows of the matrix gathered and summed by text. Long texts are scored
in segments, so memory does not grow with a text, and an n-gram across a cut counts once.

The model is fitted on a sample of at most about ``MAX_DOCS`` documents of every language, chosen by a hash of doc_id;
every text to be predicted is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import as_bytes, bound_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Documents of a language that are learned from, and languages that are learned: those of most documents, ties by name.
MAX_DOCS, MAX_LANGS = 4_000, 400
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters that are scored together.
SEGMENT = 1 << 16
_LETTER = regex.compile(r"\p{L}")


def segments(text: str) -> Iterator[tuple[str, int]]:
    """Parts of the lower-cased text, each with the number of characters that it repeats from the part before."""
    low, overlap = text.lower(), max(ORDERS) - 1
    for at in range(0, max(1, len(low)), SEGMENT):
        start = max(0, at - overlap)
        yield low[start : at + SEGMENT], at - start


def ngrams(parts: list[tuple[str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams of some parts and the number of the part of each, in the order of the parts. n-grams do not cross parts, and those that end
    within what a part repeats are left out."""
    code = np.frombuffer("".join([p for p, _ in parts]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    lengths = np.array([len(p) for p, _ in parts], dtype=np.int64)
    owner = np.repeat(np.arange(len(parts)), lengths)
    ends = np.cumsum(lengths)
    first = np.repeat(ends - lengths + np.array([skip for _, skip in parts], dtype=np.int64), lengths)
    last = np.repeat(ends, lengths)
    place = np.arange(len(code))
    for order in ORDERS:
        n = len(code) - order + 1
        if n <= 0:
            continue
        own = (place[:n] + order <= last[:n]) & (place[:n] + order > first[:n])
        h = np.full(n, 0x811C9DC5 + order, dtype=np.uint32)
        for i in range(order):
            h = (h ^ code[i : i + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1)))[own], owner[:n][own]


def packs(texts: list[str | None]) -> Iterator[tuple[list[int], list[tuple[str, int]]]]:
    """(numbers of texts, their parts) of about ``SEGMENT`` characters together; null texts have none."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in segments(text) if text else ():
            owners.append(i)
            parts.append(part)
            size += len(part[0])
            if size >= SEGMENT:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


@dataclass
class Model:
    """Languages in order, log priors and the log-probability matrix."""

    langs: list[str]
    priors: np.ndarray
    logs: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and posterior probabilities; ``und`` and 0 for texts that are null or have no letter, or without a language."""
        total = np.tile(self.priors, (len(texts), 1))
        for owners, parts in packs(texts):
            sums = np.zeros((len(parts), len(self.langs)))
            for found, owner in ngrams(parts):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                if len(starts):
                    sums[owner[starts]] += np.add.reduceat(self.logs[found], starts, axis=0, dtype=np.float64)
            np.add.at(total, owners, sums)
        langs, scores = [], []
        for text, row in zip(texts, total, strict=True):
            if text is None or not self.langs or not _LETTER.search(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmax(row))
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(row - row[best]).sum()))
        return langs, scores


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text, modulo 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Learns from (doc_id, text, lang) of rows with text and lang that are not held out and have a doc_id; an empty table gives a model without languages.

    Rows that repeat a doc_id count each. The driver gets the counts of at most eight tasks: eight times languages times ``BUCKETS`` numbers."""
    bound_batches(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    sizes = {r["lang"]: r["count"] for r in most.collect()}
    langs = sorted(sizes)
    logs = np.zeros((BUCKETS, len(langs)), dtype=np.float32)
    if not langs:
        return Model([], np.zeros(0), logs)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, max_docs / n)) for lang, n in sizes.items()], "lang string, share double")
    known = known.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(draw < F.col("share")).select("lang", "text").repartition(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for _, parts in packs([raw.decode()]):
                    for found, _ in ngrams(parts):
                        own += np.bincount(found, minlength=BUCKETS)
        for lang, own in counts.items():
            yield pa.record_batch({"lang": [lang], "counts": pa.array([own.astype("<i4").tobytes()], pa.binary())})

    total = np.zeros((BUCKETS, len(langs)))
    for lang, counts in sample.mapInArrow(run, "lang string, counts binary").collect():
        total[:, langs.index(lang)] += np.frombuffer(bytes(counts), "<i4")
    logs = np.log((total + SMOOTHING) / (total.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    seen = np.array([sizes[x] for x in langs], dtype=np.float64)
    return Model(langs, np.log(seen / seen.sum()), logs)


def predict(docs: DataFrame, model: Model, lang: str = "_lang", score: str = "_score") -> DataFrame:
    """All rows and columns of ``docs`` with the language and its probability (0 to 1) under the names given; columns of ``docs`` that have one of them are replaced.

    Only ``text`` is read, whole however long. Null texts and those without a letter are ``und`` with 0; equal texts get equal results; an empty table stays empty."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (lang.lower(), score.lower())])
    at, names = docs.columns.index("text"), [*docs.columns, lang, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else x.decode() for x in as_bytes(batch.column(at))]
            langs, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(run, StructType(list(docs.schema)).add(lang, "string").add(score, "double"))
