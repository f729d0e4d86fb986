"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

The lexicon's white-space words are compiled into an automaton in which equal suffixes share their states; every arc adds a
number, and the sum along a word is the word's place in a table of id sequences. Every chunk of texts sends its distinct words through the automaton;
words outside the lexicon are cut into pieces and merged exactly (``word_bpe.Merger``), so the lexicon saves work and never changes a result. A worker
keeps only the last merged words (``MERGED``), so its memory does not grow with what it has seen.

The automaton is one file in the shared folder that Spark ships to every executor (``addFile``); the workers of an executor map the same file.

Plan: one pass counts the words of all documents in the JVM (partial sums in each task; every occurrence counts) and writes the counts of those found twice
or more; a histogram of counts on a logarithmic scale says from which count on at most ``LEXICON_WORDS`` words are left, and those reach the driver, which
compiles them (words of at most ``LONGEST`` bytes). The second pass encodes; it has no shuffle.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm import word_bpe
from quern.llm.common import as_bytes, bound_batches, keep, only, put, shared_dir, stage

#: Words of the lexicon and their longest length in bytes: what is collected and shipped is bounded by them.
LEXICON_WORDS, LONGEST = 65_536, 48
#: Merged words of one generation that a worker keeps, each of at most ``LONGEST`` bytes; there are two.
MERGED = 60_000
#: Steps of the histogram of counts for each doubling.
STEPS = 16


class Transducer:
    """Arcs sorted by (state, byte) in arrays; state 0 is the start. Immutable."""

    def __init__(self, keys, goals, adds, final, starts, ids) -> None:
        self.keys, self.goals, self.adds, self.final, self.starts, self.ids = keys, goals, adds, final, starts, ids

    @classmethod
    def compile(cls, words: Iterable[bytes], ids: Iterable[np.ndarray]) -> Transducer:
        """Of distinct words in byte order and the ids of each."""
        # A state is a list [final, {byte: state}]; those behind the last word's shared prefix are frozen: replaced
        # by an equal frozen state if there is one.
        register: dict[tuple, list] = {}
        root = [False, {}]
        path, last = [root], b""

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                key = (state[0], tuple((b, id(s)) for b, s in state[1].items()))
                path[-1][1][last[len(path) - 1]] = register.setdefault(key, state)

        for word in words:
            shared = len(os.path.commonprefix((word, last)))
            freeze(shared)
            for b in word[shared:]:
                path[-1][1][b] = state = [False, {}]
                path.append(state)
            path[-1][0] = True
            last = word
        freeze(0)
        numbers, order, stack = {id(root): 0}, [root], [root]
        while stack:
            for nxt in stack.pop()[1].values():
                if id(nxt) not in numbers:
                    numbers[id(nxt)] = len(order)
                    order.append(nxt)
                    stack.append(nxt)
        counts: dict[int, int] = {}
        todo = [(root, False)]
        while todo:
            state, ready = todo.pop()
            if id(state) in counts:
                continue
            if ready:
                counts[id(state)] = state[0] + sum(counts[id(s)] for s in state[1].values())
            else:
                todo.append((state, True))
                todo += [(s, False) for s in state[1].values()]
        arcs = []
        for n, state in enumerate(order):
            add = int(state[0])
            for b, nxt in sorted(state[1].items()):
                arcs.append((n << 8 | b, numbers[id(nxt)], add))
                add += counts[id(nxt)]
        keys, goals, adds = (np.array(x, dtype="<i4") for x in (zip(*arcs, strict=True) if arcs else ((), (), ())))
        ids = list(ids)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<i4")
        flat = np.concatenate(ids).astype("<i4") if ids else np.zeros(0, "<i4")
        return cls(keys, goals, adds, np.array([s[0] for s in order], dtype="<i4"), starts, flat)

    def to_bytes(self) -> bytes:
        parts = [self.keys, self.goals, self.adds, self.final, self.starts, self.ids]
        return struct.pack("<6q", *map(len, parts)) + b"".join(p.astype("<i4").tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw) -> Transducer:
        at, parts = 48, []
        for n in struct.unpack_from("<6q", raw):
            parts.append(np.frombuffer(raw, dtype="<i4", count=n, offset=at))
            at += 4 * n
        return cls(*parts)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """The automaton in a memory-mapped file."""
        with open(path, "rb") as f:
            return cls.from_bytes(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """The raw ids of each word; None outside the lexicon. All words step together."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        width = int(lengths[live].max(initial=0))
        raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in live]), dtype=np.uint8).reshape(-1, width)
        state, place = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        found = np.full(len(words), -1, dtype=np.int64)
        for j in range(width):
            key = state << 8 | raw[:, j]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, raw, at = live[ok], raw[ok], at[ok]
            state, place = self.goals[at].astype(np.int64), place[ok] + self.adds[at]
            ends = lengths[live] == j + 1
            hit = ends & (self.final[state] == 1)
            found[live[hit]] = place[hit]
            live, raw, state, place = live[~ends], raw[~ends], state[~ends], place[~ends]
        raw, starts = memoryview(self.ids).cast("B"), (self.starts * 4).tolist()
        return [bytes(raw[starts[i] : starts[i + 1]]) if i >= 0 else None for i in found.tolist()]


def frequent_words(docs: DataFrame, text_column: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """At most ``most`` of the most frequent white-space words of all whole texts, ASCII letters in lower case, in byte order.

    Words found once are left out. Words whose counts fall in one step of the histogram come or stay away together."""
    words = F.explode(F.split(F.col(text_column), r"[\x20\x09-\x0D]+")).alias("word")
    lowered = F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word")
    counts = docs.select(words).where(F.octet_length("word").between(1, LONGEST)).select(lowered).groupBy("word").agg(F.count("*").alias("n"))
    counts = stage(counts.where("n > 1").withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")), "lexicon-counts")
    left, least = most, None
    for row in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), reverse=True):
        left -= row.words
        if left < 0:
            break
        least = row.step
    if least is None:
        return []
    return sorted(r.word.encode() for r in counts.where(F.col("step") >= least).select("word").collect())


class Lexicon:
    """A tokenizer file's vocabulary with a compiled lexicon; ``encode`` and ``decode`` work on columns."""

    def __init__(self, tokenizer_json: str, words: list[bytes] | None = None) -> None:
        self.text = tokenizer_json
        spec = word_bpe.load(tokenizer_json)
        if not word_bpe.applies(spec):
            raise ValueError("this tokenizer has another normalizer, splitting or model than the lexicon compiles")
        words = words or []
        split, merger = word_bpe.Splitter({}), word_bpe.Merger(spec)
        ids = word_bpe.by_pieces(split, _merged(merger), "<u4")[0](words)
        self.automaton = Transducer.compile(words, [np.frombuffer(x, "<i4") for x in ids]).to_bytes()
        self.key = hashlib.sha256(tokenizer_json.encode() + self.automaton).hexdigest()
        self.file: str | None = None

    def __getstate__(self) -> dict:
        """What is broadcast: the automaton goes by its file if it has one."""
        return self.__dict__ | ({"automaton": None} if self.file else {})

    @classmethod
    def of(cls, docs: DataFrame, tokenizer_path: str, text_column: str = "text", most: int = LEXICON_WORDS) -> Lexicon:
        with open(tokenizer_path, encoding="utf-8") as f:
            return cls(f.read(), frequent_words(docs, text_column, most))

    def ship(self, spark: SparkSession) -> None:
        """Writes the automaton into the shared folder and has Spark bring it to every executor, later ones too."""
        if self.file is None:
            name = f"lexicon-{self.key}.fsa"
            path = put(spark, f"{shared_dir(spark)}/quern/{name}", self.automaton)
            spark.sparkContext.addFile(path)
            self.file = name

    def encoder(self) -> word_bpe.Encoder:
        """Of this process; made once."""
        if self.key not in _ENCODERS:
            spec = word_bpe.load(self.text)
            automaton = Transducer.mapped(SparkFiles.get(self.file)) if self.file else Transducer.from_bytes(self.automaton)
            split = word_bpe.Splitter(word_bpe.special_tokens(spec))
            merge_words, encode_text = word_bpe.by_pieces(split, _merged(word_bpe.Merger(spec)), "<u4")

            merged, before = {}, {}

            def encode_words(words: list[bytes]) -> list[bytes]:
                nonlocal merged, before
                out = automaton.lookup(words)
                unseen = []
                for i, x in enumerate(out):
                    if x is None:
                        word = words[i]
                        ids = merged.get(word)
                        if ids is None:
                            ids = before.get(word)
                            if ids is None:
                                unseen.append(i)
                                continue
                            merged[word] = ids
                        out[i] = ids
                for i, ids in zip(unseen, merge_words([words[i] for i in unseen]), strict=True):
                    out[i] = ids
                    if len(words[i]) <= LONGEST:
                        merged[words[i]] = ids
                if len(merged) > MERGED:
                    merged, before = {}, merged
                return out

            _ENCODERS.clear()
            _ENCODERS[self.key] = word_bpe.Encoder(encode_words, encode_text)
        return _ENCODERS[self.key]


def _merged(merger: word_bpe.Merger):
    return lambda pieces: [x.astype("<u4", copy=False).tobytes() for x in merger.merge([word_bpe.utf8(p) for p in pieces])]


_ENCODERS: dict[str, word_bpe.Encoder] = {}
keep("lexicon", _ENCODERS)


def encode(docs: DataFrame, lexicon: Lexicon, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """Adds ``ids_column``: the ids of every whole text as little-endian unsigned 32-bit integers in a binary.

    Null and empty texts have no ids. All rows and columns stay; a column of that name is replaced.
    """
    return _map(docs, lexicon, text_column, {ids_column: "binary"}, lambda lex, col: [lex.encoder()(as_bytes(col))])


def decode(rows: DataFrame, lexicon: Lexicon, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """Adds ``text_column``: the strings of the ids joined as the tokenizer joins them. Null ids decode to ''."""
    return _map(rows, lexicon, ids_column, {text_column: "string"}, lambda lex, col: [_decoded(lex, col.to_pylist())])


def round_trip(docs: DataFrame, lexicon: Lexicon, text_column: str = "text", ids_column: str = "ids", decoded_column: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one Python pass: a task needs one worker, and so one set of caches, instead of two."""

    def both(lex: Lexicon, column: pa.Array) -> list[list[bytes]]:
        ids = lex.encoder()(as_bytes(column))
        return [ids, _decoded(lex, ids)]

    return _map(docs, lexicon, text_column, {ids_column: "binary", decoded_column: "string"}, both)


def _decoded(lexicon: Lexicon, ids: list[bytes | None]) -> list[bytes]:
    if _PIECES.get("key") != lexicon.key:
        _PIECES.update(key=lexicon.key, pieces=word_bpe.pieces_by_id(word_bpe.load(lexicon.text)))
    get = _PIECES["pieces"].__getitem__
    return [b" ".join(map(get, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in ids]


_PIECES: dict = {}


def _map(rows: DataFrame, lexicon: Lexicon, source: str, new: dict[str, str], run) -> DataFrame:
    spark = rows.sparkSession
    bound_batches(spark)
    lexicon.ship(spark)
    shared = spark.sparkContext.broadcast(lexicon)  # the tokenizer's file
    kept = [c for c in rows.columns if c.lower() not in {n.lower() for n in new}]
    rows = rows.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(rows.schema))
    for name, kind in new.items():
        schema = schema.add(name, kind)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("lexicon")
        for batch in batches:
            made = run(shared.value, batch.column(kept.index(source)))
            columns = [pa.array(x, pa.binary()).cast(pa.binary() if kind == "binary" else pa.string()) for x, kind in zip(made, new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *new])

    return rows.mapInArrow(each, schema)
