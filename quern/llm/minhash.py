"""Near-duplicate documents by b-bit MinHash.

A document is the set of 64-bit hashes of its five-word shingles. ``HASHES`` minima are taken; groups of ``ROWS``
minima make ``BANDS`` band keys, and of every minimum the low ``BITS`` bits are kept, packed into 64-bit words. Documents
with equal sets are one class. Classes that share a band key are candidates; equal packed bits, counted by XOR and bit count and
corrected for chance, estimate their similarity; candidates whose estimate is not clearly below the threshold (``SLACK``:
five standard errors) are confirmed on the full sets, so no estimate decides a link.

A pair at the threshold 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6; more similar ones less.

Skew: a bucket of n classes is not expanded into n*n pairs. First every bucket's smallest class is compared with its others, and confirmed
links merge components. What is left of a bucket in several components is then compared across them in blocks (``across``), so
the components are those of all links; pairs that the links already connect are never compared, and no row stands for a pair.
A component that fills blocks of its own meets only the blocks of others, so a large group with a few strays costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import U64, as_bytes, bound_batches, keep, mix64, only, shuffle_partitions, stage
from quern.llm.graph import components

WORDS, HASHES, ROWS, BITS = 5, 128, 4, 4
BANDS = HASHES // ROWS
THRESHOLD = 75
SLACK = 0.20
#: Members of a block and bytes of their full sets, about; two blocks meet in a task.
BLOCK, BLOCK_BYTES = 512, 24 << 20
#: Up to so many candidate ids (8 bytes each) are broadcast to pick their documents; more are joined by shuffle.
BROADCAST_IDS = 400_000

_RANDOM = np.random.default_rng(20240607)
PLACES = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) * U64(2) + U64(1)
FACTORS = (_RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
SHIFTS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
BAND_SALTS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


class _Words(dict):
    """Hashes of words; emptied when it holds too many."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()
keep("minhash", _WORDS)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (UTF-8): of five words, or of all if there are fewer."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    hashed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    total = hashed[: n - WORDS + 1] * PLACES[0]
    for i in range(1, WORDS):
        total += hashed[i : n - WORDS + 1 + i] * PLACES[i]
    return np.unique(mix64(total))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    short = (found >> U64(32)).astype(np.uint32)[None, :]
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, short.shape[1], 2048):
        np.minimum(least, (short[:, at : at + 2048] * FACTORS + SHIFTS).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, sixteen to a word."""
    bits = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(bits << (np.arange(64 // BITS, dtype=np.uint64) * U64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    key = BAND_SALTS.copy()
    for i in range(ROWS):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + rows[:, i])
    return key


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, text) -> (doc, n, h1, h2, sig, bands): set size, set hash, packed bits and band keys; null where a set is empty."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("minhash")
        for batch in batches:
            known: dict[bytes, tuple] = {}
            rows = []
            for raw in as_bytes(batch.column(1)):
                found = shingles(raw)
                if not len(found):
                    rows.append((0, None, None, None, None))
                    continue
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest not in known:
                    least = minima(found)
                    h = np.frombuffer(digest, "<i8").tolist()
                    known[digest] = (len(found), *h, packed(least).view(np.int64).tolist(), band_keys(least).view(np.int64).tolist())
                rows.append(known[digest])
            n, h1, h2, sig, bands = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch(
                {"doc": batch.column(0), "n": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "sig": pa.array(sig, longs), "bands": pa.array(bands, longs)}
            )

    return docs.mapInArrow(run, "doc long, n long, h1 long, h2 long, sig array<long>, bands array<long>")


def estimate(a: str, b: str) -> Column:
    """The similarity that two packed signatures say: equal groups of bits, corrected for equality by chance."""
    odd = None
    for i in range(HASHES * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        odd = F.bit_count(x) if odd is None else odd + F.bit_count(x)
    chance = 2.0**-BITS
    return (1 - odd / float(HASHES) - chance) / (1 - chance)


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc, text) -> (doc, grams): the full sets, as packed 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("minhash")
        for batch in batches:
            grams = pa.array([shingles(raw).tobytes() for raw in as_bytes(batch.column(1))], pa.binary())
            yield pa.record_batch({"doc": batch.column(0), "grams": grams})

    return docs.mapInArrow(run, "doc long, grams binary")


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two full sets (sorted) have at least ``threshold`` hundredths in common."""
    p, q = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(p) < threshold * len(q):
        return False
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    common = int(np.count_nonzero(q[at] == p))
    return 100 * common >= threshold * (len(p) + len(q) - common)


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("ga")), "a")
    both = both.join(sets.select(F.col("doc").alias("b"), F.col("grams").alias("gb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                good.append(similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _matching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of all pairs of two blocks of packed signatures."""
    odd = np.zeros((len(a), len(b)), dtype=np.int16)
    for i in range(a.shape[1]):
        x = a[:, None, i] ^ b[None, :, i]
        x |= x >> U64(1)
        x |= x >> U64(2)
        odd += np.bitwise_count(x & U64(0x1111111111111111))
    chance = 2.0**-BITS
    return (1 - odd / HASHES - chance) / (1 - chance)


def blocks(rest: DataFrame) -> DataFrame:
    """(key, rep, comp, block, other): each member's block in its bucket and, as a row each, the blocks that it is to meet.

    Members are weighed by ``BLOCK`` and by the bytes of their sets. Components of less than a block share blocks of the bucket, dealt by hash; a larger one has blocks
    of its own, numbered behind them, which do not meet each other."""
    weight = F.lit(1.0 / BLOCK) + F.col("n") * 8.0 / BLOCK_BYTES
    sizes = rest.groupBy("key", "comp").agg(F.sum(weight).alias("weight"))
    large = F.col("weight") >= 1
    shared = sizes.groupBy("key").agg(
        F.greatest(F.ceil(F.sum(F.when(~large, F.col("weight")))).cast("int"), F.lit(0)).alias("shared"),
        F.sum(F.when(large, F.ceil("weight")).otherwise(0)).cast("int").alias("own"),
    )
    shared = shared.withColumn("shared", F.coalesce("shared", F.lit(0)))
    order = Window.partitionBy("key").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.where(large).withColumn("span", F.ceil("weight").cast("int"))
    ranges = ranges.select("key", "comp", "span", F.coalesce(F.sum("span").over(order), F.lit(0)).cast("int").alias("before"))
    rows = rest.join(shared, "key").join(ranges, ["key", "comp"], "left")
    single = F.col("span").isNull()
    low = F.when(single, 0).otherwise(F.col("shared") + F.col("before"))
    rows = rows.withColumn("low", low).withColumn("many", F.coalesce("span", "shared"))
    rows = rows.withColumn("block", F.col("low") + F.pmod(F.xxhash64("rep"), F.col("many")).cast("int"))
    every = F.sequence(F.lit(0), F.col("shared") + F.col("own") - 1)
    others = F.when(single, every).otherwise(F.filter(every, lambda x: (x < F.col("low")) | (x >= F.col("low") + F.col("span"))))
    return rows.select("key", "rep", "comp", "block", F.explode(others).alias("other"))


def across(rest: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): confirmed links, by component, between members of the buckets ``rest`` (key, rep, comp, n), enough to join whatever is linked.

    Buckets are dealt over pairs of blocks. Two steps, each with a row per member and block pair and none per pair of members:
    estimates on packed signatures list a member's likely partners (in the first bucket only that the two share); then the members
    that are in such a list come with their full sets, and pairs that are not yet joined in the task are confirmed.
    """
    parts = shuffle_partitions(rest.sparkSession)
    dealt = blocks(rest).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp")
    dealt = dealt.join(sketches, "rep").select("key", "i", "j", "block", "rep", "comp", "sig", "bands")
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for at, members in groupby(rows, key=lambda r: (r["key"], r["i"], r["j"])):
            yield at, list(members)

    def list_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), members in groups(batches):
            block, comp = (np.array([m[c] for m in members]) for c in ("block", "comp"))
            sig = np.array([m["sig"] for m in members], dtype=np.int64).view(U64)
            bands = np.array([m["bands"] for m in members], dtype=np.int64)
            one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
            a, b = np.nonzero((_matching(sig[one], sig[two]) >= threshold / 100 - SLACK) & (comp[one][:, None] != comp[two][None, :]))
            a, b = one[a], two[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            keep = []
            for start in range(0, len(a), 50_000):
                same = bands[a[start : start + 50_000]] == bands[b[start : start + 50_000]]
                keep.append(bands[a[start : start + 50_000], same.argmax(axis=1)] == key)
            keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            own = {k: [] for k in np.union1d(a, b).tolist()}
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                own[x].append(members[y]["rep"])
            yield pa.record_batch({
                "key": pa.array([key] * len(own), pa.int64()), "i": pa.array([i] * len(own), pa.int32()), "j": pa.array([j] * len(own), pa.int32()),
                "rep": pa.array([members[k]["rep"] for k in own], pa.int64()), "comp": pa.array([members[k]["comp"] for k in own], pa.int64()),
                "partners": pa.array([np.array(v, dtype="<i8").tobytes() for v in own.values()], pa.binary()),
            })

    def confirm_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in groups(batches):
            grams = {m["rep"]: np.frombuffer(m["grams"], "<u8") for m in members}
            own = {m["rep"]: m["comp"] for m in members}
            roots = {c: c for c in own.values()}

            def root(x: int, roots: dict = roots) -> int:
                while roots[x] != x:
                    roots[x] = roots[roots[x]]
                    x = roots[x]
                return x

            found = []
            for m in members:
                for other in np.frombuffer(m["partners"], "<i8").tolist():
                    x, y = root(m["comp"]), root(own[other])
                    if x != y and similar(grams[m["rep"]], grams[other], threshold):
                        roots[max(x, y)] = min(x, y)
                        found.append((min(x, y), max(x, y)))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    listed = stage(dealt.mapInArrow(list_partners, "key long, i int, j int, rep long, comp long, partners binary"), "minhash-partners")
    full = listed.join(sets.select(F.col("doc").alias("rep"), "grams"), "rep").select("key", "i", "j", "rep", "comp", "partners", "grams")
    full = full.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stage(full.mapInArrow(confirm_partners, "a long, b long"), "minhash-late")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are not read).

    Null and empty texts have no shingles and link with nothing. Rows without doc_id are linked with nothing and have a null
    component, and are kept. Rows that repeat a doc_id are judged row by row; equal texts are always in one class. An empty
    table gives an empty table. The smallest doc_id of a component stands for it.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    rows = stage(signatures(pairs), "minhash")
    live = rows.where("doc IS NOT NULL AND n > 0")
    classes = live.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = stage(classes, "minhash-classes")
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    members = stage(
        buckets.join(shared.where("least < most").select("key"), "key").select("key", "rep").distinct(), "minhash-buckets"
    )
    wanted = members.select(F.col("rep").alias("doc")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = stage(sets_of(pairs.join(wanted, "doc", "left_semi").select("doc", "text")).distinct(), "minhash-sets")
    sigs = classes.select("rep", "sig")

    def likely(edges: DataFrame) -> DataFrame:
        """Pairs whose estimate leaves the threshold possible."""
        edges = edges.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
        edges = edges.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        return edges.where(estimate("sa", "sb") >= threshold / 100 - SLACK).select("a", "b").distinct()

    # The smallest class of each bucket is proposed to the others of it.
    hubs = members.groupBy("key").agg(F.min("rep").alias("hub"))
    proposed = members.join(hubs, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    known = components(confirm(likely(proposed), sets, threshold))
    # Then whatever of a bucket is in several components is compared across them.
    state = members.join(known, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    state = stage(state, "minhash-state")
    several = state.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key")
    rest = state.join(several, "key", "left_semi").join(classes.select("rep", "n"), "rep")
    late = components(across(stage(rest, "minhash-rest"), classes.select("rep", "sig", "bands"), sets, threshold))
    late = late.select(F.col("node").alias("from"), F.col("root").alias("to"))
    # The second components are those of the first ones, so roots of roots are final.
    named = classes.select("h1", "h2", "rep").join(known, F.col("rep") == F.col("node"), "left")
    named = named.select("h1", "h2", F.coalesce("root", "rep").alias("first")).join(late, F.col("first") == F.col("from"), "left")
    named = named.select("h1", "h2", F.coalesce("to", "first").alias("rep"))
    joined = rows.select("doc", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc"))
    return joined.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
