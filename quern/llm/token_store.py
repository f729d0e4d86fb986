"""Token-id shards with keyed access: raw ids behind a minimal perfect hash of the document keys.

A shard file holds, in ascending key order, the raw ids of its documents (two bytes an id where the vocabulary
fits, else four), and an index: the perfect hash of the keys, and by its slots a fingerprint, an offset and a length.
``Shard.get`` reads a document in constant time; an absent key is told by its fingerprint. Layout: MAGIC, length
of a JSON header, header, then the sections at the places that the header names, and a CRC-32 of all at the end.

Plan: documents are dealt by ranges of doc_id (the only shuffle) and sorted within a range; each task encodes its
range and writes files of at most about ``SHARD_IDS`` ids into the shared folder under names of its own. The
files of tasks that succeeded are listed in a written table, so a rerun task leaves nothing behind that counts. A document's
start is that of its range (one row per range reaches the driver) plus its place in the range.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import word_bpe
from quern.llm.common import (
    U64, as_bytes, bound_batches, keep, mix64, only, offsets_by_partition, qualified, shared_dir, shuffle_partitions, stage,
)
from quern.llm.mph import PerfectHash

MAGIC = b"QRNTOK1\0"
#: Ids of one file, but for a longer document's.
SHARD_IDS = 4_000_000
#: Added to the n-th further document of one key before hashing.
REPEAT = 0xA24BAED4963EE407
#: Stands for a missing key.
NO_KEY = 0x9FB21C651E98DF25
FINGER_SALT = U64(0x5851F42D4C957F2D)


def key_hashes(keys: np.ndarray, missing: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A 64-bit key for each (doc_id or missing, how many rows of that doc_id came before)."""
    base = np.where(missing, U64(NO_KEY), keys.astype(np.int64).view(U64))
    return mix64(base ^ np.where(missing, U64(1) << U64(63), U64(0))) + nth.astype(U64) * U64(REPEAT)


def build_shard(keys: list[int | None], ids: list[bytes], width: int, more: dict) -> bytes:
    """The bytes of a shard of documents in their order; ``ids`` are raw."""
    missing = np.array([k is None for k in keys], dtype=bool)
    values = np.array([k or 0 for k in keys], dtype=np.int64)
    seen: dict[int | None, int] = {}
    nth = np.zeros(len(keys), dtype=np.int64)
    for i, k in enumerate(keys):
        nth[i] = seen[k] = seen.get(k, -1) + 1
    hashed = key_hashes(values, missing, nth)
    index = PerfectHash.build(hashed)
    slots = index.lookup(hashed)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
    finger, at, size = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4")
    finger[slots] = (mix64(hashed ^ FINGER_SALT) >> U64(32)).astype("<u4")
    at[slots] = np.cumsum(lengths) - lengths
    size[slots] = lengths
    sections = {
        "index": index.to_bytes(), "fingerprints": finger.tobytes(), "offsets": at.tobytes(), "lengths": size.tobytes(),
        "keys": values.astype("<i8").tobytes(), "missing": missing.tobytes(), "payload": b"".join(ids),
    }
    places, offset = {}, 0
    for name, raw in sections.items():
        places[name] = [offset, len(raw)]
        offset += len(raw)
    head = json.dumps(more | {"width": width, "documents": len(keys), "ids": int(lengths.sum()), "sections": places}).encode()
    body = MAGIC + struct.pack("<I", len(head)) + head + b"".join(sections.values())
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard read back; ValueError if the file is damaged."""

    def __init__(self, raw: bytes) -> None:
        if raw[: len(MAGIC)] != MAGIC or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(memoryview(raw)[:-4]):
            raise ValueError("not a shard, or a damaged one")
        (size,) = struct.unpack_from("<I", raw, len(MAGIC))
        start = len(MAGIC) + 4
        self.head = json.loads(raw[start : start + size])
        base = start + size
        part = {k: memoryview(raw)[base + a : base + a + n] for k, (a, n) in self.head["sections"].items()}
        self.index = PerfectHash.from_bytes(part["index"])
        self.fingerprints = np.frombuffer(part["fingerprints"], "<u4")
        self.offsets, self.lengths = np.frombuffer(part["offsets"], "<u8"), np.frombuffer(part["lengths"], "<u4")
        self.keys, self.missing = np.frombuffer(part["keys"], "<i8"), np.frombuffer(part["missing"], bool)
        self.payload = np.frombuffer(part["payload"], f"<u{self.head['width']}")

    def slots(self, keys: np.ndarray, missing: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for those that the shard does not hold."""
        hashed = key_hashes(keys, missing, nth)
        slots = self.index.lookup(hashed)
        if len(self.fingerprints):
            good = self.fingerprints[slots] == (mix64(hashed ^ FINGER_SALT) >> U64(32)).astype("<u4")
            slots = np.where(good, slots, -1)
        return slots

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of a document; None if it is not here."""
        slot = self.slots(np.array([key or 0]), np.array([key is None]), np.array([nth]))[0]
        return None if slot < 0 else self.at(slot)

    def at(self, slot: int) -> np.ndarray:
        start = int(self.offsets[slot])
        return self.payload[start : start + int(self.lengths[slot])]


#: Bytes of known pieces in a worker.
WORD_BYTES = 24 << 20
#: Chunks of ``word_bpe.Encoder`` whose words are looked up together.
CHUNKS = 2
#: Pieces that the library encodes as one text, and texts of one call: a long text costs it more a piece.
PART, CALL = 50, 50


def library_encoder(tokenizer_json: str, width: int):
    """texts (UTF-8, null as empty) -> raw ids, by the tokenizers library without special tokens.

    Where the file's rules are the word-level ones of ``word_bpe``, the library's model encodes each distinct piece of a chunk once;
    else the library encodes the whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    spec, own = word_bpe.load(tokenizer_json), Tokenizer.from_str(tokenizer_json)
    own.no_truncation()
    own.no_padding()
    code = {2: "H", 4: "I"}[width]
    raw = lambda x: array(code, x.ids).tobytes()
    if not word_bpe.applies(spec):
        return lambda texts: [raw(own.encode((t or b"").decode(), add_special_tokens=False)) for t in texts]
    bare = Tokenizer(own.model)
    bare.pre_tokenizer = WhitespaceSplit()  # no letter that stands for a byte is white space
    letters = np.array([ord(x) for x in word_bpe.byte_letters()], "<u4")
    letters[0x20] = 0x20  # the space parts pieces, which have none
    # The last id of a piece, and no other, has the mark of a word's end: pieces never hold both signs and letters.
    final = np.array([x.endswith(word_bpe.WORD_END.encode()) for x in word_bpe.pieces_by_id(spec)])

    def spelled(part: list[bytes]) -> str:
        text = b" ".join(part)
        plain = text.decode("latin-1")
        return plain if text.isascii() and plain.isprintable() else letters[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le")

    def pieces(found: pa.Array) -> pa.Array:
        ids, listed = [np.zeros(0, f"<u{width}")], found.to_pylist()
        texts = [spelled(listed[at : at + PART]) for at in range(0, len(listed), PART)]
        for at in range(0, len(texts), CALL):
            made = bare.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)
            ids += [np.array(x.ids, f"<u{width}") for x in made]
        ids = np.concatenate(ids)
        ends = np.append(0, np.flatnonzero(final[ids]) + 1) * width
        if len(ends) != len(found) + 1:
            raise ValueError("a piece has no end or several")
        return pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    split = word_bpe.Splitter(word_bpe.special_tokens(spec))
    return word_bpe.PieceEncoder(split, pieces, lambda text: raw(own.encode(text.decode(), add_special_tokens=False)), WORD_BYTES, CHUNKS)


_ENCODERS: dict = {}
keep("tokens", _ENCODERS)


def together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches in their order, as many together as have ``most`` bytes."""
    part, size = [], 0
    for batch in batches:
        part.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(part)
            part, size = [], 0
    if part:
        yield pa.Table.from_batches(part)


def write_shards(
    docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Writes the ids of all documents in ascending key order; returns the list of files: (path, pid, seq, documents, ids).

    Every document's ids end with ``end_id``. A null text has no other ids; a null key comes first; rows that repeat a
    key come in the order of their texts and are told apart by their number; an empty table writes no file.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    spec = word_bpe.load(source)
    highest = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id or 0])
    width = 2 if highest < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(source)
    folder = f"{qualified(spark, shared_dir(spark))}/quern/tokens-{uuid.uuid4().hex}"
    end = b"" if end_id is None else end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        if _ENCODERS.get("key") != (source_id := hash(shared.value), width):
            _ENCODERS.update(key=(source_id, width), encode=library_encoder(shared.value, width))
        encode = _ENCODERS["encode"]
        pid, seq, start = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, seq, start
            raw = build_shard(keys, ids, width, {"range": pid, "shard": seq, "start": start})
            name = f"{folder}/{pid:06d}-{seq:06d}-{uuid.uuid4().hex}.qtok"
            store, path = fs.FileSystem.from_uri(name)
            store.create_dir(os.path.dirname(path), recursive=True)
            with store.open_output_stream(path) as f:
                f.write(raw)
            row = {"path": [name], "pid": [pid], "seq": [seq], "documents": [len(keys)], "ids": [held]}
            start, seq, keys, ids, held = start + held, seq + 1, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=LIST)

        for part in together(batches, CHUNKS * word_bpe.Encoder.CHUNK):
            for k, raw in zip(part.column(0).to_pylist(), encode(as_bytes(part.column(1))), strict=True):
                keys.append(k)
                ids.append(raw + end)
                held += len(ids[-1]) // width
                if held >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    LIST = pa.schema([("path", pa.string()), ("pid", pa.int32()), ("seq", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])
    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = dealt.repartitionByRange(shuffle_partitions(spark), F.col("key").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    return stage(dealt.mapInArrow(run, "path string, pid int, seq int, documents long, ids long"), "token-shards")


def read_shard(path: str) -> Shard:
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as f:
        return Shard(f.read())


def read_documents(files: DataFrame, ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32 and, if asked for, ids) of every document in the listed files.

    Each document is fetched through its shard's index; its checksum is that of its ids as 32-bit integers.
    """
    spark = files.sparkSession
    bound_batches(spark)
    shifts = offsets_by_partition(files, "pid", "ids")  # one row per range
    shift = F.broadcast(spark.createDataFrame(shifts, "pid int, before long"))
    fields = [("key", pa.int64()), ("pid", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "key long, pid int, place long, n_tokens long, ids_crc32 long"
    if ids:
        fields, schema = [*fields, ("ids", pa.list_(pa.int32()))], schema + ", ids array<int>"
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard = read_shard(path)
                nth = np.zeros(len(shard.keys), dtype=np.int64)
                for i in range(1, len(nth)):
                    if shard.keys[i] == shard.keys[i - 1] and shard.missing[i] == shard.missing[i - 1]:
                        nth[i] = nth[i - 1] + 1
                slots = shard.slots(shard.keys, shard.missing, nth)
                if (slots < 0).any():
                    raise ValueError(f"{path}: a key is missing in its index")
                found = [shard.at(s) for s in slots.tolist()]
                out = {
                    "key": pa.array(shard.keys, pa.int64(), mask=shard.missing),
                    "pid": [shard.head["range"]] * len(found),
                    "place": pa.array(shard.offsets[slots].astype(np.int64) + shard.head["start"]),
                    "n_tokens": [len(x) for x in found],
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in found],
                }
                if ids:
                    out["ids"] = [x.astype(np.int32) for x in found]
                for at in range(0, len(found), 5000):
                    yield pa.RecordBatch.from_pydict({k: v[at : at + 5000] for k, v in out.items()}, schema=arrow)

    found = files.select("path").repartition(shuffle_partitions(spark), "path").mapInArrow(run, schema)
    return found.join(shift, "pid").select(
        "key", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else [])
    )
