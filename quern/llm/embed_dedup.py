"""Near-duplicate vectors: exact comparison inside dense groups, a pivot-permutation index for the others.

Dense groups: of a bounded, hash-chosen sample, vectors that have many others of the sample within cosine ``HOME`` become centres. A
vector's home is the first centre within ``HOME``. If a vector with a home is linked to another, the other is within the sum of both
angles of that centre, so the list of a centre has all vectors that near, and its pairs with a home are compared without exception.
A pair counts at the smaller of its homes. The sample decides what is compared where, not what is found.

The others: ``pivots`` unit vectors come from a fixed generator, not from the data, so the chance that a pair is found depends on its
cosine and dimension alone, however the data lie. A vector is described by its ``PREFIX`` nearest pivots. Two vectors are candidates
if they share at least ``SHARED`` of them: then, among the first ``PREFIX - SHARED + 2`` of each in pivot order, they share two, so
inverted lists by label and pair of pivots find them. Lists of one member are dropped; in the others all cosines are
computed in double precision. A pair that meets in several lists counts in the first of them only.

Measured on random vectors at cosine 0.98 exactly, of 10,000 pairs at most two are not candidates (see tests).

Equal vectors of a label are one class first. A list of more than ``BLOCK`` members is dealt over pairs of blocks, so no task
holds more than two blocks. A list sends one row per linked member, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bound_batches, shuffle_partitions, stage
from quern.llm.graph import components

THRESHOLD = 0.98
PREFIX, SHARED = 8, 3
KEYED = PREFIX - SHARED + 2
#: The number of pivots follows the square root of the number of vectors, within these.
LEAST_PIVOTS, MOST_PIVOTS = 64, 512
BLOCK = 1024
#: Cosine of a vector and its centre; centres by dimension, the vectors they are chosen from, and those that a centre must have around it.
HOME, MOST_CENTRES, SAMPLE, AROUND = 0.9, 64, 2048, 16


def usable(embedding: str = "embedding"):
    """Condition: not null, not empty, every component finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    e = F.col(embedding)
    return F.coalesce(e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0), F.lit(False))


def choose_centres(classes: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, unit vectors with dense surroundings in a sample by hash: ``SAMPLE`` rows reach the driver."""
    rows = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for (vector,) in rows:
        x = np.array(vector, dtype=np.float64)
        by_dim.setdefault(len(x), []).append(x / np.linalg.norm(x))
    out = {}
    for dim, vectors in by_dim.items():
        x = np.array(vectors)
        near = x @ x.T >= HOME
        open_, found = np.ones(len(x), dtype=bool), []
        while len(found) < MOST_CENTRES:
            around = near[:, open_].sum(axis=1)
            best = int(around.argmax())
            if around[best] < AROUND:
                break
            found.append(best)
            open_ &= ~near[best]
        if found:
            out[dim] = x[found]
    return out


@lru_cache(maxsize=8)
def drawn(dim: int, count: int) -> np.ndarray:
    """Unit vectors of a fixed generator."""
    more = np.random.default_rng(dim).normal(size=(count, dim))
    return more / np.linalg.norm(more, axis=1)[:, None]


def prefixes(vectors: np.ndarray, pivots: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The nearest pivots of unit vectors of one dimension, in pivot order. Where ``pivots`` has fewer than ``count`` of a
    dimension, the rest come from a fixed generator."""
    dim = vectors.shape[1]
    own = pivots.get(dim, np.zeros((0, dim)))
    if len(own) < count:
        own = np.vstack([own, drawn(dim, count - len(own))])
    near = np.argsort(-(vectors @ own.T), axis=1, kind="stable")[:, :PREFIX]
    return np.sort(near, axis=1)


def postings(classes: DataFrame, centres: dict[int, np.ndarray], count: int, threshold: float = THRESHOLD) -> DataFrame:
    """(label, list, cid, home): a row for every list that a class stands in. The list number holds dimension and both pivots, or is
    negative and holds dimension and centre; without a home it is null."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    pairs = list(combinations(range(KEYED), 2))
    # Linked to a vector within HOME of a centre; a little more for rounding.
    reach = np.cos(min(np.pi, np.arccos(HOME) + np.arccos(min(1.0, threshold)))) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, cids, vectors = (batch.column(i).to_pylist() for i in range(3))
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                x = np.array([vectors[i] for i in rows], dtype=np.float64)
                x /= np.linalg.norm(x, axis=1)[:, None]
                cosines = x @ shared.value.get(dim, np.zeros((0, dim))).T
                inside = cosines >= HOME
                housed = inside.any(axis=1)
                home = np.where(housed, inside.argmax(axis=1) if inside.shape[1] else 0, -1)
                at, centre = np.nonzero(cosines >= reach)
                free = np.flatnonzero(~housed)
                found = prefixes(x[free], {}, count)
                keys = np.stack([(dim * count + found[:, a]) * count + found[:, b] for a, b in pairs], axis=1)
                at = np.concatenate([at, np.repeat(free, len(pairs))])
                yield pa.record_batch({
                    "label": pa.array([labels[rows[k]] for k in at], batch.schema.field(0).type),
                    "list": pa.array(np.concatenate([-1 - dim * MOST_CENTRES - centre, keys.ravel()]), pa.int64()),
                    "cid": pa.array([cids[rows[k]] for k in at], pa.int64()),
                    "home": pa.array(home[at], pa.int32(), mask=home[at] < 0),
                })

    kind = dict(classes.dtypes)["label"]
    return classes.select("label", "cid", "embedding").mapInArrow(run, f"label {kind}, list long, cid long, home int")


def roots(adjacent: np.ndarray) -> np.ndarray:
    """For each member the first member that it reaches, by a search over rows that takes each row once."""
    out = np.arange(len(adjacent))
    left = adjacent.any(axis=1)
    while left.any():
        start = int(left.argmax())
        front = np.zeros(len(adjacent), dtype=bool)
        front[start] = True
        while front.any():
            out[front] = start
            left &= ~front
            front = adjacent[front].any(axis=0) & left
    return out


def linked(rows: DataFrame, count: int, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, links, root): for each list part and linked class its number of linked vectors and a smaller class it is linked to."""

    def part(members: list[dict], key: int, i: int, j: int) -> list[tuple[int, int, int]]:
        members.sort(key=lambda m: m["cid"])
        x = np.array([m["embedding"] for m in members], dtype=np.float64)
        norms = np.linalg.norm(x, axis=1)
        unit = x / norms[:, None]
        block = np.array([m["block"] for m in members])
        rows_, cols = (np.flatnonzero(block == i), np.flatnonzero(block == j))
        dots = unit[rows_] @ unit[cols].T
        passed = dots >= threshold
        # How a product of matrices rounds depends on their shapes: close ones are computed one by one.
        a, b = np.nonzero(np.abs(dots - threshold) < 1e-9)
        p, q = rows_[a], cols[b]
        passed[a, b] = np.einsum("ij,ij->i", x[p], x[q]) / (norms[p] * norms[q]) >= threshold
        if i == j:
            np.fill_diagonal(passed, False)
        if key < 0:
            # The smaller of the homes names the list in which the pair counts.
            home = np.array([MOST_CENTRES if m["home"] is None else m["home"] for m in members])
            passed &= np.minimum.outer(home[rows_], home[cols]) == (-1 - key) % MOST_CENTRES
        elif passed.any():
            # So do the first two shared pivots.
            first, second = divmod(key % (count * count), count)
            near = prefixes(unit, {}, count)[:, :KEYED]
            a, b = np.nonzero(passed)
            for at in range(0, len(a), 100_000):
                c, d = a[at : at + 100_000], b[at : at + 100_000]
                p, q = rows_[c], cols[d]
                both = (near[p][:, :, None] == near[q][:, None, :]).any(axis=2)
                order = np.argsort(~both, axis=1, kind="stable")[:, :2]
                own = np.take_along_axis(near[p], order, axis=1)
                passed[c, d] = (own[:, 0] == first) & (own[:, 1] == second)
        if not passed.any():
            return []
        adjacent = np.zeros((len(members), len(members)), dtype=bool)
        adjacent[np.ix_(rows_, cols)] = passed
        adjacent |= adjacent.T
        links = adjacent @ np.array([m["n"] for m in members])
        cids = [m["cid"] for m in members]
        return [(cids[k], int(links[k]), cids[r]) for k, r in enumerate(roots(adjacent).tolist()) if links[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in batch.to_pylist())
        out: list[tuple] = []
        for (_, key, i, j), members in groupby(stream, key=lambda r: (r["label"], r["list"], r["i"], r["j"])):
            out += part(list(members), key, i, j)
            if len(out) > 5000:
                yield pa.record_batch(dict(zip(("cid", "links", "root"), map(pa.array, zip(*out, strict=True)), strict=True)))
                out = []
        if out:
            yield pa.record_batch(dict(zip(("cid", "links", "root"), map(pa.array, zip(*out, strict=True)), strict=True)))

    return rows.mapInArrow(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of equal label and equal length are compared. A row without vec_id or label, or with a vector that is null,
    empty, zero or has a null or non-finite component, links with nothing and is its own component (null without
    vec_id); it is kept. Repeated rows are vectors of their own that link with each other. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    # Zeros of either sign are equal; grouping treats them so.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    rows = rows.withColumn("ok", usable() & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = stage(rows.withColumn("h", F.when(F.col("ok"), F.xxhash64("embedding"))), "vectors")
    live = rows.where("ok")
    classes = stage(live.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")), "vector-classes")
    total = classes.count()
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(max(1, total)) / 2))))
    lists = stage(postings(classes, choose_centres(classes), count, threshold), "vector-lists")
    sizes = lists.groupBy("label", "list").agg(F.count("*").alias("size")).where("size > 1")
    lists = lists.join(stage(sizes, "vector-list-sizes"), ["label", "list"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    lists = lists.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lists = lists.select("label", "list", "cid", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = lists.join(classes.select(F.col("label").alias("l"), "cid", "n", "embedding"), "cid").where("label = l").drop("l")
    parts = parts.repartition(shuffle_partitions(spark), "label", "list", "i", "j").sortWithinPartitions("label", "list", "i", "j")
    found = stage(linked(parts, count, threshold), "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = stage(components(found.where("cid <> root").select(F.col("root").alias("a"), F.col("cid").alias("b"))), "vector-components")
    named = classes.join(links, "cid", "left").join(known, F.col("cid") == F.col("node"), "left")
    named = named.select(
        "label", "h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")
    )
    named = stage(named, "vector-named")
    joined = rows.alias("r").join(named.alias("c"), ["h", "label", "embedding"], "left")
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
