"""Line deduplication by a sharded minimal perfect hash over the distinct lines.

Lines are told by 128 bits of hash of their keys. One pass counts keys: each task sends one row per key and batch with the
smallest document and their number, so a line that stands in every document costs a row per batch. Every distinct key is indexed: a shard by
the key's first hash holds a perfect hash, fingerprints (the second hash), counts and first documents. Documents then probe the arrays: a task
packs the hashes of its rows by shard and packs meet their shard's arrays. A shard whose keys are met so often that its packs would exceed ``SALT_BYTES`` is
copied, and its packs are dealt over the copies by partition and batch; other shards are not. A key counted once is kept at a look at its count; of the
others a row loses those whose first document is before its own. What comes back is, per row, the hashes to drop. Line texts are never
shuffled or joined; documents are joined once, by doc_id and the hash of their text, with the hashes that they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import U64, as_bytes, bound_batches, hidden, mix64, only, shuffle_partitions, stage
from quern.llm.mph import PerfectHash

SPACE = b" \t\n\v\f\r"
#: Shorter keys (code points) are never dropped.
MIN_LENGTH = 10
#: Keys of one shard, and bytes of packed hashes that meet one copy of a shard's arrays, about.
SHARD_KEYS, SALT_BYTES = 200_000, 48 << 20


def digest(line: bytes, min_length: int = MIN_LENGTH) -> bytes | None:
    """The 16-byte hash of a line's key; None if the key is too short to be dropped."""
    key = line.strip(SPACE).lower()
    if len(key) < min_length or (len(key) < 4 * min_length and len(key.decode()) < min_length):
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def count_keys(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(h1, h2, lo, n) of all distinct keys: the first document and the number of rows with the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("lines")
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for doc, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if doc is None or not raw:
                    continue
                for key in {digest(line, min_length) for line in raw.split(b"\n")}:
                    if key is None:
                        continue
                    known = seen.get(key)
                    if known is None:
                        seen[key] = [doc, 1]
                    else:
                        known[0], known[1] = min(known[0], doc), known[1] + 1
            if seen:
                h1, h2 = _halves(list(seen))
                lo, n = (pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(2))
                yield pa.record_batch({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "lo": lo, "n": n})

    partial = docs.select("doc", "text").mapInArrow(run, "h1 long, h2 long, lo long, n long")
    return partial.groupBy("h1", "h2").agg(F.min("lo").alias("lo"), F.sum("n").alias("n"))


class LineIndex:
    """Arrays of one shard: by a key's slot its fingerprint, first document and number of rows."""

    def __init__(self, index: PerfectHash, fingers: np.ndarray, first: np.ndarray, counts: np.ndarray) -> None:
        self.index, self.fingers, self.first, self.counts = index, fingers, first, counts

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, lo: np.ndarray, n: np.ndarray) -> LineIndex:
        # Both halves make the key: equal first halves alone must not meet.
        keys = h1.view(U64) ^ (h2.view(U64) * U64(0x9E3779B97F4A7C15))
        index = PerfectHash.build(keys)
        slots = index.lookup(keys)
        out = [np.empty(len(keys), dtype=t) for t in ("<u8", "<i8", "<u4")]
        for target, values in zip(out, (h2.view(U64), lo, np.minimum(n, 0xFFFFFFFF)), strict=True):
            target[slots] = values
        return cls(index, *out)

    def to_row(self) -> dict[str, bytes]:
        return {"mph": self.index.to_bytes(), "fingers": self.fingers.tobytes(), "first": self.first.tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def from_row(cls, row: dict[str, bytes]) -> LineIndex:
        arrays = (np.frombuffer(row[k], t) for k, t in (("fingers", "<u8"), ("first", "<i8"), ("counts", "<u4")))
        return cls(PerfectHash.from_bytes(row["mph"]), *arrays)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for keys that the shard does not hold."""
        if not len(self.fingers):
            return np.full(len(h1), -1)
        slots = self.index.lookup(h1 ^ (h2 * U64(0x9E3779B97F4A7C15)))
        return np.where((slots >= 0) & (self.fingers[slots] == h2), slots, -1)


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, mph, fingers, first, counts): a row for each shard with keys."""

    def run(table: pa.Table) -> pa.Table:
        h1, h2, lo, n = (table.column(c).to_numpy() for c in ("h1", "h2", "lo", "n"))
        row = LineIndex.build(h1, h2, lo, n).to_row()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in row.items()}})

    dealt = keys.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "lo", "n")
    return dealt.groupBy("shard").applyInArrow(run, "shard int, mph binary, fingers binary, first binary, counts binary")


def pack_probes(docs: DataFrame, shards: int, copies: dict[int, int], min_length: int = MIN_LENGTH) -> DataFrame:
    """(shard, salt, docs, rows, h1, h2): for each batch of rows (doc, text, row) and shard, arrays of ids and hashes. ``copies``: of the shards that have several."""
    shared = docs.sparkSession.sparkContext.broadcast(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            ids: list[int] = []
            rows: list[int] = []
            keys: list[bytes] = []
            for doc, raw, row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if doc is None or not raw:
                    continue
                own = {digest(line, min_length) for line in raw.split(b"\n")}
                own.discard(None)
                keys += sorted(own)
                ids += [doc] * len(own)
                rows += [row] * len(own)
            if not keys:
                continue
            h1, h2 = _halves(keys)
            shard = np.mod(h1.view(np.int64), shards)
            order = np.argsort(shard, kind="stable")
            found, starts = np.unique(shard[order], return_index=True)
            columns = [np.split(x[order], starts[1:]) for x in (np.array(ids, dtype="<i8"), np.array(rows, dtype="<i8"), h1, h2)]
            out = {k: pa.array([x.tobytes() for x in v], pa.binary()) for k, v in zip(("docs", "rows", "h1", "h2"), columns, strict=True)}
            place = int(mix64(np.array([partition << 32 | number]))[0])
            salts = [place % shared.value.get(x, 1) for x in found.tolist()]
            yield pa.record_batch({"shard": pa.array(found, pa.int32()), "salt": pa.array(salts, pa.int32()), **out})

    return docs.select("doc", "text", "row").mapInArrow(run, "shard int, salt int, docs binary, rows binary, h1 binary, h2 binary")


def losses(packs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc, row, gone): the joined 16-byte hashes of the lines that a row loses, a row for each shard; ``index`` has a shard's number of copies in ``salts``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[tuple[int, int], list[bytes]] = {}
        if right.num_rows:
            arrays = LineIndex.from_row(right.to_pylist()[0])
            for pack in zip(*(left.column(c).to_pylist() for c in ("docs", "rows", "h1", "h2")), strict=True):
                ids, rows, h1, h2 = (np.frombuffer(x, t) for x, t in zip(pack, ("<i8", "<i8", "<u8", "<u8"), strict=True))
                slots = arrays.probe(h1, h2)
                gone = (slots >= 0) & (arrays.counts[slots] > 1)
                gone &= arrays.first[slots] < ids
                own: dict[tuple[int, int], list[bytes]] = {}
                for doc, row, x, y in zip(ids[gone].tolist(), rows[gone].tolist(), h1[gone], h2[gone], strict=True):
                    own.setdefault((doc, row), []).append(x.tobytes() + y.tobytes())
                out |= own  # a row that repeats in several packs loses the same
        docs, rows = zip(*out, strict=True) if out else ((), ())
        # One order of the hashes, however a row's repeats were dealt.
        gone = [b"".join(sorted(set(v))) for v in out.values()]
        return pa.table({"doc": pa.array(docs, pa.int64()), "row": pa.array(rows, pa.int64()), "gone": pa.array(gone, pa.binary())})

    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pair = packs.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt"))
    return pair.applyInArrow(run, "doc long, row long, gone binary")


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, lines: str | None = None, dropped: str | None = None) -> DataFrame:
    r"""All rows and columns of ``docs`` with the text that is left, and the numbers of its lines before and of those dropped, under the names ``lines`` and ``dropped``
    (without names they are left out; columns of ``docs`` that are called so are replaced).

    A text is split at \n; null and empty texts are one empty line and stay as they are. A line's key is the line without
    ASCII white space at its ends, in ASCII lower case. A key of at least ``min_length`` code points in two documents or
    more loses all its lines but those in its smallest doc_id. A row without doc_id neither counts nor loses; rows that
    repeat a doc_id are one document. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    added = {n.lower() for n in (lines, dropped) if n}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("row"))
    keys = stage(count_keys(pairs, min_length), "line-keys")
    shards = max(2 * shuffle_partitions(spark), -(-keys.count() // SHARD_KEYS))
    # How often a shard is probed is known from its counts; a row a hot shard reaches the driver, one for each SALT_BYTES of probes at most.
    sizes = keys.groupBy(F.pmod("h1", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("n").alias("probes"))
    sizes = sizes.select("shard", F.ceil(F.col("probes") * 32 / SALT_BYTES).cast("int").alias("salts"))
    copies = {r.shard: r.salts for r in sizes.where("salts > 1").collect()}
    index = build_index(keys, shards)
    if copies:
        index = index.join(F.broadcast(spark.createDataFrame(list(copies.items()), "shard int, salts int")), "shard", "left")
    index = stage(index.withColumn("salts", F.coalesce("salts", F.lit(1)) if copies else F.lit(1)), "line-index")
    gone = losses(pack_probes(pairs, shards, copies, min_length), index)
    name, by, row = hidden(docs, "gone"), hidden(docs, "by"), hidden(docs, "row")
    gone = gone.groupBy(F.col("doc").alias(by), F.col("row").alias(row)).agg(F.collect_set("gone").alias(name))
    joined = docs.join(stage(gone, "line-losses"), (docs["doc_id"] == F.col(by)) & (F.xxhash64(docs["text"]) == F.col(row)), "left").drop(by, row)
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index("text")
        for batch in batches:
            texts, before, less = [], [], []
            for raw, drop in zip(as_bytes(batch.column(at)), batch.column(len(kept)).to_pylist(), strict=True):
                cut = (raw or b"").split(b"\n")
                before.append(len(cut))
                if drop:
                    lost = {d[i : i + 16] for d in drop for i in range(0, len(d), 16)}
                    cut = [x for x in cut if digest(x, min_length) not in lost]
                less.append(before[-1] - len(cut))
                texts.append(b"\n".join(cut) if less[-1] else raw)
            columns = list(batch.columns)[: len(kept)]
            columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
            more = {n: pa.array(v, pa.int64()) for n, v in ((lines, before), (dropped, less)) if n}
            yield pa.RecordBatch.from_arrays([*columns, *more.values()], names=[*kept, *more])

    schema = StructType(list(docs.schema))
    for extra in (lines, dropped):
        schema = schema.add(extra, "long") if extra else schema
    return joined.select(*[F.col(f"`{c}`") for c in kept], name).mapInArrow(run, schema)
