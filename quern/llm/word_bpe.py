"""The word-level parts of a lower-casing BPE vocabulary with word ends: splitting, merging and decoding.

``Splitter`` cuts a text into the pieces that are encoded one by one. ``Merger`` applies the merge list to
many pieces at once in numpy: all pieces of one length class form a matrix, and each round merges the
lowest-ranked pair (the leftmost of equals) of every row.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: What the tokenizer file must say for this module to apply.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"


def applies(spec: dict) -> bool:
    """Whether a tokenizer file (parsed JSON) has the normalizer, splitting and model that this module knows."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER
        and len(steps) == 2
        and steps[0] == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        and steps[1]["type"] == "ByteLevel"
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and model["type"] == "BPE"
        and model["end_of_word_suffix"] == WORD_END
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and spec.get("decoder") is None
        and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    )


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = [""] * 256, 0x100
    for b in range(256):
        if b in prints:
            letters[b] = chr(b)
        else:
            letters[b], free = chr(free), free + 1
    return letters


# Latin-1 in lower case, and its pieces, as bytes: most texts need nothing else.
_LOWER = bytes(ord(chr(b).lower()) for b in range(256))
_LETTER, _NUMBER, _SPACE = (
    "".join(f"\\x{b:02x}" for b in range(256) if test(chr(b)))
    for test in (
        lambda c: unicodedata.category(c)[0] == "L",
        lambda c: unicodedata.category(c)[0] == "N",
        lambda c: c in "\t\n\v\f\r \x85\xa0",
    )
)
_LATIN = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+".encode("latin-1"))
_WIDE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
# The same for many words at once, one a line: the line ends are found too.
_LATIN_LINES, _WIDE_LINES = re.compile(_LATIN.pattern + rb"|\n"), regex.compile(_WIDE.pattern + r"|\n")


@cache
def unsettled() -> np.ndarray:
    """Of every code point whether Unicode tables of different ages may compose, order, lower or cut it in different ways: it is newer than
    Python's tables, or a mark or a composed letter newer than Unicode 3.2."""

    def told(letter: str) -> bool:
        kind = unicodedata.category(letter)
        if kind[0] != "M" and kind != "Cn" and not unicodedata.decomposition(letter):
            return False
        return kind == "Cn" or unicodedata.ucd_3_2_0.category(letter) == "Cn"

    return np.fromiter(map(told, map(chr, range(0x110000))), bool, 0x110000)


def joined(strings: pa.Array) -> bytes:
    """The bytes of an array of large strings or binaries without nulls, one after another."""
    _, ends, raw = strings.buffers()
    first, last = np.frombuffer(ends, np.int64)[[strings.offset, strings.offset + len(strings)]] if len(strings) else (0, 0)
    return bytes(memoryview(raw)[first:last]) if last else b""


class Splitter:
    """Cuts texts into pieces: Latin-1 bytes, str where a text needs more than Latin-1, int ids of special tokens."""

    def __init__(self, special: dict[str, int]) -> None:
        self.special = special
        self.marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(self, text: str) -> list:
        try:
            return _LATIN.findall(text.encode("latin-1").translate(_LOWER))
        except UnicodeEncodeError:
            # One letter is lowered by its place in a word in Python but not in the vocabulary's normalizer.
            return _WIDE.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def lines(self, words: list[bytes], latin: bool) -> list:
        """The pieces of words (UTF-8, without white space of ASCII) in their order, with a line end behind each word; ``latin``: all words are Latin-1.

        No piece crosses a line end and no letter changes by one, so they are the pieces of each word by itself."""
        text = b"".join([w + b"\n" for w in words]).decode()
        if latin:
            return _LATIN_LINES.findall(text.encode("latin-1").translate(_LOWER))
        return _WIDE_LINES.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def cut(self, text: bytes, latin: bool) -> pa.Array:
        """As ``lines`` of a text of words with a line end behind each: their pieces in UTF-8."""
        if text.isascii():
            return pa.array(_LATIN_LINES.findall(text.translate(_LOWER)), pa.large_binary())
        if not latin:
            return pa.array(_WIDE_LINES.findall(unicodedata.normalize("NFC", text.decode()).replace("Σ", "σ").lower()), pa.large_string()).view(pa.large_binary())
        found = pa.array(_LATIN_LINES.findall(text.decode().encode("latin-1").translate(_LOWER)), pa.large_binary())
        ends, raw = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1), joined(found)
        ends = ends + np.append(0, np.cumsum(np.frombuffer(raw, np.uint8) >= 0x80))[ends]  # such a letter takes two bytes in UTF-8
        return pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(raw.decode("latin-1").encode())])

    def __call__(self, text: str) -> list:
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])


def utf8(piece: bytes | str) -> bytes:
    """The UTF-8 bytes of a piece."""
    if isinstance(piece, str):
        return piece.encode()
    return piece if piece.isascii() else piece.decode("latin-1").encode()


class Merger:
    #: Rows of a matrix have at most so many symbols; longer pieces are merged one by one with a heap.
    WIDEST = 64
    #: Rows of one matrix: it stays in a core's cache.
    ROWS = 4096

    def __init__(self, spec: dict) -> None:
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.final = np.array([vocab[c + WORD_END] for c in letters], dtype=np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        last = np.append(keys[order][1:] != keys[order][:-1], True)  # of a repeated pair the last rank holds
        self.keys, self.ranks = keys[order][last], order[last].astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.none = np.int32(len(merges))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``none`` where they do not merge or a symbol is missing (-1)."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (UTF-8 bytes, not empty)."""
        out: list[np.ndarray] = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        edges = [0, 4, 6, 8, 10, 12, 16, 24, 32, self.WIDEST]
        for low, high in zip(edges, edges[1:], strict=False):
            picked = np.flatnonzero((lengths > low) & (lengths <= high))
            for start in range(0, len(picked), self.ROWS):
                self._matrix(words, picked[start : start + self.ROWS], lengths, high, out)
        for i in np.flatnonzero(lengths > self.WIDEST):
            out[i] = self._heap(words[i])
        return out

    def _matrix(self, words: list[bytes], picked: np.ndarray, lengths: np.ndarray, width: int, out: list) -> None:
        n = lengths[picked]
        raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in picked]), dtype=np.uint8).reshape(-1, width)
        symbols = np.where(np.arange(width) < n[:, None], self.inner[raw], np.int32(-1))
        rows = np.arange(len(picked))
        symbols[rows, n - 1] = self.final[raw[rows, n - 1]]
        symbols = np.hstack([symbols, np.full((len(picked), 1), -1, dtype=np.int32)])
        ranks = np.hstack([self.rank(symbols[:, :-1], symbols[:, 1:]), np.full((len(picked), 1), self.none, dtype=np.int32)])
        places = np.arange(width + 1)
        while len(picked):
            best = ranks.argmin(axis=1)
            rows = np.arange(len(picked))
            lowest = ranks[rows, best]
            done = lowest == self.none
            if done.any():
                ready = symbols[done]
                held = ready >= 0
                ids, ends = ready[held], np.cumsum(held.sum(axis=1)).tolist()
                for i, start, end in zip(picked[done].tolist(), [0, *ends], ends, strict=False):
                    out[i] = ids[start:end]
                keep = ~done
                picked, symbols, ranks, best, lowest = picked[keep], symbols[keep], ranks[keep], best[keep], lowest[keep]
                if not len(picked):
                    break
                rows = np.arange(len(picked))
            gone = best[:, None]
            # The right one of the pair goes; so does the rank between the two.
            symbols[rows, best] = self.made[lowest]
            symbols = np.take_along_axis(symbols, np.minimum(places + (places > gone), width), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(places + (places >= gone), width), axis=1)
            symbols[:, -1], ranks[:, -1] = -1, self.none
            ranks[rows, best] = self.rank(symbols[rows, best], symbols[rows, np.minimum(best + 1, width)])
            inner = best > 0
            some, at = rows[inner], best[inner]
            ranks[some, at - 1] = self.rank(symbols[some, at - 1], symbols[some, at])

    def _heap(self, word: bytes) -> np.ndarray:
        """One long word: a heap of pairs over a linked list, in O(n log n)."""
        raw = np.frombuffer(word, dtype=np.uint8)
        symbols = self.inner[raw]
        symbols[-1] = self.final[raw[-1]]
        n, ids = len(raw), symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(self.rank(symbols[:-1], symbols[1:]).tolist()) if r < self.none]
        heapify(heap)
        one = np.empty(1, dtype=np.int32)

        def push(i: int, j: int) -> None:
            one[0] = ids[i]
            r = int(self.rank(one, np.array([ids[j]], dtype=np.int32))[0])
            if r < self.none:
                heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], dtype=np.int32)


def lowered(text: bytes) -> bytes:
    """A text (UTF-8) with ASCII letters in lower case, where NFC gives the same for both cases.

    Of some letters only the small one has a composed form (t and U+0308). Marks that compose with ASCII letters are in
    U+0300 to U+036F, whose first bytes are 0xCC and 0xCD: in a text that has them only words of ASCII are lowered.
    """
    if b"\xcc" in text or b"\xcd" in text:
        return b" ".join([w.lower() if w.isascii() else w for w in text.split()])
    return text.lower()


class Encoder:
    """Encodes texts by the white-space words in them; each distinct word of a chunk of texts (``chunks`` times ``CHUNK`` bytes) is encoded once.

    ``encode_words`` gives the raw ids of whole words (UTF-8). No piece crosses white space and ASCII letters are lowered first only where that
    changes nothing (``lowered``), so the ids of a text are those of its words in order; a text that may hold a special token goes to
    ``encode_text`` as a whole. Arrow splits a chunk, numbers its distinct words and puts their ids in order. Words are kept from chunk to chunk in two
    generations of ``most_bytes`` each (0: none are kept), which saves work and changes no result: the frequent ones are met again and move on, the others go.
    """

    #: Bytes of texts that are looked up together, and what an entry of the cache takes besides its bytes.
    CHUNK, ENTRY = 4 << 20, 190
    #: Longer words are not kept.
    LONGEST = 64

    def __init__(self, encode_words, encode_text, most_bytes: int = 0, chunks: int = 1) -> None:
        self.encode_words, self.encode_text, self.most_bytes = encode_words, encode_text, most_bytes
        self.chunk = chunks * self.CHUNK
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        out = list(map(self.words.get, words))
        unseen, met = [], []
        for i, ids in enumerate(out):
            if ids is None:
                ids = out[i] = self.old.get(words[i]) if words[i] else b""
                (unseen if ids is None else met).append(i)
        for i, ids in zip(unseen, self.encode_words([words[i] for i in unseen]), strict=True):
            out[i] = ids
        if self.most_bytes:
            for i in met + unseen:
                if len(words[i]) <= self.LONGEST:
                    self.words[words[i]] = out[i]
                    self.size += len(words[i]) + len(out[i]) + self.ENTRY
            if self.size > self.most_bytes:
                self.words, self.old, self.size = {}, self.words, 0
        return out

    def _distinct(self, words: pa.Array) -> pa.Array:
        """The ids of an array of distinct words."""
        return pa.array(self._ids(words.view(pa.large_binary()).to_pylist()), pa.large_binary())

    def _chunk(self, texts: list[bytes]) -> list[bytes]:
        whole = [b"<|" in t for t in texts]
        plain = pa.array([b"" if w else lowered(t) for t, w in zip(texts, whole, strict=True)], pa.large_binary())
        cut = pc.ascii_split_whitespace(plain.view(pa.large_string()))
        coded = cut.values.dictionary_encode()
        ids = self._distinct(coded.dictionary).take(coded.indices)
        _, ends, raw = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)[cut.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        raw = memoryview(raw or b"")
        return [self.encode_text(t) if w else bytes(raw[i:j]) for t, w, (i, j) in zip(texts, whole, pairwise(ends), strict=True)]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text (null: none) in little-endian order."""
        out: list[bytes] = []
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append(t or b"")
            size += len(part[-1])
            if size >= self.chunk:
                out += self._chunk(part)
                part, size = [], 0
        return out + self._chunk(part)


class PieceEncoder(Encoder):
    """An ``Encoder`` that keeps pieces instead of words: words with other signs around them share theirs.

    A word with a letter that is ``unsettled`` goes to ``encode_text`` as a whole.
    ``encode_pieces`` gives the raw ids of an array of distinct pieces (UTF-8) as an array. Known pieces are held in Arrow arrays, which Arrow looks up all
    together; after a chunk that makes them more than ``most_bytes`` those met last stay, half as much. This saves work and changes no result.
    """

    #: What a known piece takes besides its bytes and ids.
    ENTRY = 24

    def __init__(self, split: Splitter, encode_pieces, encode_text, most_bytes: int, chunks: int = 1) -> None:
        super().__init__(None, encode_text, most_bytes, chunks)
        self.split, self.encode_pieces, self.turn = split, encode_pieces, 0
        # The line end behind each word comes first and always stays.
        self.known, self.known_ids = pa.array([b"\n"], pa.large_binary()), pa.array([b""], pa.large_binary())
        self.met = np.array([np.iinfo(np.int64).max])

    def _distinct(self, words: pa.Array) -> pa.Array:
        strange = self._strange(words)
        if not strange.any():
            return self._by_pieces(words)
        mask = pa.array(strange)
        ids = pa.array([self.encode_text(w) for w in words.filter(mask).view(pa.large_binary()).to_pylist()], pa.large_binary())
        return pc.replace_with_mask(self._by_pieces(pc.if_else(mask, pa.scalar("", pa.large_string()), words)), mask, ids)

    @staticmethod
    def _strange(words: pa.Array) -> np.ndarray:
        """Which words have a letter of which the tables in use may say different things."""
        out = ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        if out.any():
            other = words.filter(pa.array(out))
            found = unsettled()[np.frombuffer(joined(other).decode().encode("utf-32-le"), "<u4")]
            out[out] = np.diff(np.append(0, np.cumsum(found))[np.append(0, np.cumsum(pc.utf8_length(other).to_numpy()))]) > 0
        return out

    def _by_pieces(self, words: pa.Array) -> pa.Array:
        cut, order = self._cut(words)
        coded = cut.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        unseen = coded.dictionary.filter(pa.array(new))
        at = place.fill_null(0).to_numpy().astype(np.int64)
        self.met[at[at > 0]] = self.turn
        at[new] = np.arange(len(self.known), len(self.known) + len(unseen))
        made = self.encode_pieces(unseen)
        places = at[coded.indices.to_numpy()]
        ids = pa.concat_arrays([self.known_ids, made]).take(pa.array(places))
        _, ends, raw = ids.buffers()
        # A line end has no ids, so a word's ids end with its line.
        ends = np.append(0, np.frombuffer(ends, np.int64, len(ids) + 1)[1:][places == 0]) if len(ids) else np.zeros(1, np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), raw or pa.py_buffer(b"")])
        self._keep(unseen, made)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out.take(pa.array(back))

    def _cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of words with a line end behind each, and the order in which the words come."""
        lines = pc.binary_join_element_wise(words, *pa.array(["", "\n"], pa.large_string()))
        # 1: ASCII; 0: Latin-1; -1: others.
        latin = pc.string_is_ascii(words).to_numpy(zero_copy_only=False).astype(np.int8)
        other = np.flatnonzero(latin == 0)
        some = lines.take(pa.array(other))
        if len(other):
            _, ends, raw = some.buffers()
            # Latin-1 in UTF-8 has no byte above 0xC3.
            high = np.append(0, np.cumsum(np.frombuffer(raw, np.uint8) >= 0xC4))[np.frombuffer(ends, np.int64, len(other) + 1)]
            latin[other[np.diff(high) > 0]] = -1
        groups = [np.flatnonzero(latin == kind) for kind in (1, 0, -1)]
        cut = [self.split.cut(joined(lines.take(pa.array(own))), kind >= 0) for own, kind in zip(groups, (1, 0, -1), strict=True)]
        return pa.concat_arrays(cut), np.concatenate(groups)

    def _keep(self, unseen: pa.Array, made: pa.Array) -> None:
        short = pc.less_equal(pc.binary_length(unseen), self.LONGEST)
        self.known = pa.concat_arrays([self.known, unseen.filter(short)])
        self.known_ids = pa.concat_arrays([self.known_ids, made.filter(short)])
        self.met = np.append(self.met, np.full(len(self.known) - len(self.met), self.turn))
        self.turn += 1
        sizes = (pc.add(pc.binary_length(self.known), pc.binary_length(self.known_ids))).to_numpy() + self.ENTRY
        if sizes.sum() > self.most_bytes:
            newest = np.argsort(-self.met, kind="stable")
            stay = pa.array(np.sort(newest[: max(1, np.searchsorted(np.cumsum(sizes[newest]), self.most_bytes // 2))]))
            self.known, self.known_ids, self.met = self.known.take(stay), self.known_ids.take(stay), self.met[stay.to_numpy()]


def by_pieces(split: Splitter, encode_pieces, dtype: str):
    """(encode_words, encode_text) for ``Encoder`` from a function that gives the raw ids of distinct pieces (Latin-1 bytes, or str).

    Words are cut all together; each distinct piece of them is encoded once."""
    special = np.dtype(dtype).type

    def joined(cut: list[list]) -> list[bytes]:
        every = list({p for pieces in cut for p in pieces if not isinstance(p, int)})
        known = dict(zip(every, encode_pieces(every), strict=True))
        return [
            known[pieces[0]] if len(pieces) == 1 and not isinstance(pieces[0], int)
            else b"".join([special(p).tobytes() if isinstance(p, int) else known[p] for p in pieces])
            for pieces in cut
        ]

    def words(found: list[bytes]) -> list[bytes]:
        # Latin-1 in UTF-8 has no byte above 0xC3.
        latin = np.fromiter((w.isascii() or max(w) < 0xC4 for w in found), bool, len(found))
        groups = [(np.flatnonzero(latin).tolist(), True), (np.flatnonzero(~latin).tolist(), False)]
        cut = [split.lines([found[i] for i in own], narrow) for own, narrow in groups]
        every = list((dict.fromkeys(cut[0]) | dict.fromkeys(cut[1])).keys() - {b"\n", "\n"})
        raw = [b"", b"", *encode_pieces(every)]
        number = {b"\n": 0, "\n": 1} | dict(zip(every, range(2, len(raw)), strict=True))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(found)
        for (own, _), pieces in zip(groups, cut, strict=True):
            places = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
            ids = b"".join(map(raw.__getitem__, places.tolist()))
            ends = np.cumsum(sizes[places])[places < 2].tolist()
            for i, start, end in zip(own, [0, *ends[:-1]], ends, strict=False):
                out[i] = ids[start:end]
        return out

    return words, lambda text: joined([split(text.decode())])[0]


def pieces_by_id(spec: dict) -> list[bytes]:
    """The string of every id, in UTF-8, as decoding joins them; a gap in the ids decodes to nothing."""
    strings = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [strings.get(i, "").encode() for i in range(max(strings) + 1)]


def special_tokens(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


def load(text: str) -> dict:
    return json.loads(text)
