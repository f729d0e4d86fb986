"""Media streams, vectors, hashing and components on hand-made cases."""

import hashlib
import os
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quern.llm import embed_dedup, graph, mpeg_audio, queries
from quern.llm.mph import PerfectHash


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 20_000])
def test_payloads_come_back(n):
    raw = os.urandom(n)
    media = mpeg_audio.pack(mpeg_audio.padded(raw), n)
    stream = mpeg_audio.parse(media)
    payload, count = mpeg_audio.unpack(media, stream)
    assert payload == mpeg_audio.padded(raw) and count == n and payload[:n] == raw
    assert stream.broken == stream.resyncs == 0 and stream.checked == len(payload) // 576
    assert stream.duration == Fraction(len(payload), 16_000) and stream.table["frames"] == len(stream.heads)


def test_resynchronisation_checksums_and_tags():
    media = bytearray(mpeg_audio.pack(mpeg_audio.padded(b"\xff" * 5000), 5000))
    clean = mpeg_audio.parse(bytes(media))
    dirty = mpeg_audio.parse(bytes(media[: clean.offsets[3]]) + b"\xff\xfb\x90\0junk" + bytes(media[clean.offsets[3] :]) + b"TAGtitle".ljust(128, b"\0"))
    assert dirty.resyncs == 1 and dirty.skipped == 8 and len(dirty.heads) == len(clean.heads) and dirty.tag1["title"] == "title"
    media[clean.offsets[2] + 4] ^= 1
    assert mpeg_audio.parse(bytes(media)).broken == 1
    cut = mpeg_audio.parse(bytes(media[:-10]))
    assert cut.cut and len(cut.heads) == len(clean.heads) - 1
    assert clean.seek(0) == clean.offsets[0] and clean.seek(Fraction(577, 16_000)) == clean.offsets[1] and clean.seek(99) is None
    assert mpeg_audio.parse(None).duration == mpeg_audio.parse(b"\xff\xff" * 99).duration == 0
    head = mpeg_audio.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (head.version, head.layer, head.kbps, head.rate, head.length, head.samples) == (1.0, 3, 128, 44100, 417, 1152)


def test_media_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 3), (None, "é" * 1000, 4)], "doc_id long, text string, media int")
    rows = {(r.id, r.n_bytes): r for r in mpeg_audio.features(mpeg_audio.store_text(docs), payload=True).collect()}
    assert rows[(1, 0)].media_sha256 == rows[(2, 0)].media_sha256 and rows[(None, 2000)].payload_bytes == 2304
    assert mpeg_audio.features(mpeg_audio.store_text(docs.limit(0)), payload=True).count() == 0


def test_vectors_against_sql(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        base = rng.normal(size=32)
        for k in range(40):
            base = base + rng.normal(size=32) * (0.05 if g else 0.0)
            rows.append((len(rows), [float(x) for x in base.astype(np.float32)], g % 2))
    rows += [(len(rows) + i, [float(x) for x in rng.normal(size=32).astype(np.float32)], i % 3) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [None] + [1.0] * 31, 1), (903, [float("nan")] * 32, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    con = duckdb.connect()
    ids, vectors, labels = zip(*rows, strict=True)
    con.register("embeddings", pa.table({"vec_id": ids, "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}))
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.VECTOR_SQL})").fetchall())
    assert got == want and max(r[1] for r in want) >= 39
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_index_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1)[:, None]
    for count in (64, 256, 512):
        pivots = {64: x[rng.choice(len(x), count, replace=False)]}
        a, b = (embed_dedup.prefixes(v, pivots, count) for v in (x, y))
        shared = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
        assert np.mean(shared >= embed_dedup.SHARED) > 0.998


@pytest.mark.parametrize("noise", [0.04, 0.13, 0.3])
def test_links_inside_a_hot_group(spark, noise):
    """A third of 20,000 vectors are near copies of one vector, in one label; at the largest noise they are no dense group."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    hot = x[0] + noise * x[: len(x) // 3]
    hot[1::2] = hot[: len(hot) - 1 : 2][: len(hot[1::2])] + 0.1 * np.linalg.norm(hot[0]) * x[1 : len(hot) : 2]  # pairs near the threshold
    x[: len(hot)] = hot
    label = np.where(np.arange(len(x)) < len(hot), 0, np.arange(len(x)) % 10)
    want = np.zeros(len(x), dtype=np.int64)
    for k in range(10):
        own = np.flatnonzero(label == k)
        unit = x[own] / np.linalg.norm(x[own], axis=1)[:, None]
        for at in range(0, len(own), 1000):
            want[own[at : at + 1000]] = (unit[at : at + 1000] @ unit.T >= embed_dedup.THRESHOLD).sum(axis=1) - 1
    rows = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x)), "label": label})
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows)).toPandas().set_index("vec_id")["n_links"].reindex(range(len(x))).to_numpy()
    recall = got[: len(hot)].sum() / want[: len(hot)].sum()
    print(f"noise {noise}: {want[: len(hot)].sum() // 2} links in the group, recall {recall:.6f}")
    assert (got <= want).all() and want[: len(hot)].sum() > 5000
    assert recall == 1 if noise < 0.3 else recall > 0.998


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(30)] + [(500, x) for x in range(501, 560)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in graph.components(df).collect()} == root
    assert graph.components(df.limit(0)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000, dtype=np.uint64))
    index = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(index.lookup(keys).tolist()) == list(range(len(keys)))
    assert len(index.to_bytes()) * 8 / len(keys) < 5 and PerfectHash.build(keys[:0]).lookup(keys[:3]).tolist() == [-1] * 3
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([1, 1], dtype=np.uint64))


def test_media_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op2_mpeg_audio(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    by_text = {}
    for d in docs:
        raw, r = (d.text or "").encode(), rows[d.doc_id]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and by_text.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
