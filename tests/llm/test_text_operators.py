"""Dedup, mixing, language, quality and encoding against brute force on small awkward tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import langid, lexicon, line_dedup, minhash, mixing, ordinal_quality, queries, token_store, word_bpe

AWKWARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "alpha BETA gamma\tdelta epsilon zeta eta theta iota kappa"), (3, None), (4, ""),
    (5, "one two"), (6, "ONE two"), (7, "two one"), (8, " \n\t"), (None, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (9, "This line repeats often\nunique nine\n  THIS line repeats often \nshort\nshort"), (10, "this LINE repeats often\nshort"),
    (11, "x" * 5000 + " İΣς ﬁ é <|endoftext|> it's 12"), (11, "one two"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, kept int")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else {tuple(words)} if words else set()


def components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def mutated(n, rng):
    words = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    out = []
    for _ in range(n):
        if rng.random() < 0.3:
            words = list(words)
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = f"m{rng.randint(0, 9)}"
        own = list(words)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"o{rng.randint(0, 999)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_of_a_drifting_group(spark, monkeypatch):
    rng = random.Random(3)
    texts = mutated(150, rng) + [" ".join(f"u{rng.randint(0, 99999)}" for _ in range(60)) for _ in range(20)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    want = components({i: shingle_set(t) for i, t in rows})
    assert 20 < len(set(want.values())) < 170
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingle_set(dict(rows)[i])) for i, r in got.items())


def test_near_duplicates_of_awkward_rows(docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    by = dict((r[0], r) for r in got if r[0] not in (None, 11))
    assert by[1][2] == by[2][2] == 1 and not by[2][3] and by[5][2] == by[6][2] == 5 and by[7][2] == 7
    assert by[3] == (3, 0, 3, True) and by[4] == (4, 0, 4, True) and by[8][1] == 0
    assert [r for r in got if r[0] is None] == [(None, 6, None, True)]
    assert sorted(r[2] for r in got if r[0] == 11) == [5, 11] and len(got) == len(AWKWARD)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_lines_of_awkward_rows(docs):
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs.withColumn("_gone", F.lit(1)), lines="_n_lines", dropped="size").collect()}
    texts = sorted((i, t) for i, t in got if i in (9, 10))
    assert texts == [(9, AWKWARD[9][1]), (10, "short")] and (3, None) in got and (4, "") in got
    assert [(r._n_lines, r["size"]) for k, r in got.items() if k[0] in (9, 10)] == [(5, 0), (2, 1)] and all(r.kept == 2 and r._gone == 1 for r in got.values())
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("salt_bytes", [48 << 20, 64])
def test_line_query_against_sql(spark, monkeypatch, salt_bytes):
    monkeypatch.setattr(line_dedup, "SALT_BYTES", salt_bytes)
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.LINE_SQL})").fetchall())
    assert sorted(map(tuple, queries.op5_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want


def test_mixing(spark, docs):
    rows = [(i, "w " * (1 + i % 9), s) for i, s in enumerate(["a"] * 4000 + ["b"] * 300 + ["c"] * 50 + [None] * 700)] + [(None, None, "a"), (5000, "", "zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    sizes, goals, taken = {}, {}, {}
    for r in got:
        assert 0 <= r._copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r._size
        goals[r.source], taken[r.source] = r._target, taken.get(r.source, 0) + r._size * r._copies
        assert r._size == len((r.text or "").split())
    order = ["a", "b", "c", "zero", None]
    weight = dict(zip(order, [5, 2, 1, 5, 2], strict=True))
    want, open_, left = {}, set(order), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            want |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            want[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= set(over)
    for s in order:
        assert goals[s] == pytest.approx(want[s]) and abs(taken[s] - goals[s]) <= 0.15 * goals[s]
    assert mixing.mix(df.limit(0)).count() == 0
    clash = df.withColumn("_size", F.lit(77)).withColumn("_copies", F.lit("c"))
    out = mixing.emit(clash)
    assert out.columns == clash.columns and {(r["_size"], r["_copies"]) for r in out.collect()} == {(77, "c")}
    assert mixing.emit(docs).columns == docs.columns


def test_language(spark, docs):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op7_langid(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in queries.table(spark, sf, "documents").collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held == [i for i in rows if rows[i].held_out] and len(held) > 20
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())
    model = langid.train(docs)
    assert model.predict([None, "", "123 !", "Wort"]) == (["und", "und", "und", "en"], [0.0, 0.0, 0.0, 1.0])
    assert langid.train(docs.limit(0)).predict(["abc"]) == (["und"], [0.0])


def naive_bayes(rows, texts):
    """Languages and probabilities by counting one n-gram after another."""

    def buckets(text):
        low = text.lower()
        for order in langid.ORDERS:
            for i in range(len(low) - order + 1):
                h = 0x811C9DC5 + order
                for c in low[i : i + order]:
                    h = (h ^ ord(c)) * 0x01000193 % 2**32
                    h ^= h >> 15
                yield (h * 0x9E3779B1 % 2**32) >> (32 - langid.BUCKETS.bit_length() + 1)

    counts, docs = {}, {}
    for text, lang in rows:
        docs[lang] = docs.get(lang, 0) + 1
        own = counts.setdefault(lang, {})
        for x in buckets(text):
            own[x] = own.get(x, 0) + 1
    logs = {}
    for lang, own in counts.items():
        n = sum(own.values()) + langid.SMOOTHING * langid.BUCKETS
        logs[lang] = lambda x, own=own, n=n: math.log((own.get(x, 0) + langid.SMOOTHING) / n)
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        seen = list(buckets(text))
        total = {k: math.log(docs[k] / sum(docs.values())) + sum(map(f, seen)) for k, f in logs.items()}
        best = max(sorted(total), key=total.get)
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


@pytest.mark.parametrize("segment", [64, 1 << 16])
def test_language_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    table = queries.table(spark, "/root/testdata/sf0.001", "documents").where("n_chars < 1500 AND doc_id < 90").collect()
    rows = [(r.doc_id, r.text, r.lang, 1) for r in table] + [(1000 + i, t, None, 2) for i, t in enumerate([None, "", "1 2 3", "der die das", "é" * 300, "der die das"])] + [(None, "le la les", "fr", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _score int")
    known = [(t, lang) for i, t, lang, _ in rows if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = naive_bayes(known, [r[1] for r in rows])
    got = langid.predict(docs.coalesce(1), langid.train(docs), lang="found").collect()
    assert len(got) == len(rows) and got[0]["lang"] == rows[0][2]
    for r, (i, text, _, _), (lang, score) in zip(got, rows, want, strict=True):
        assert r.text == text and r.found == lang and r["_score"] == pytest.approx(score, abs=1e-4), i
    assert langid.predict(docs.limit(0), langid.train(docs)).count() == 0


def test_quality_against_brute_force(spark, docs):
    """Scores are the sums of the weights of the distinct features; the fit is better than its neighbours."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 0), (6, 0, 1), (9, 1, 1), (10, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = ordinal_quality.train(docs, labels)
    rows = ordinal_quality.score(docs.withColumn("_keep", F.lit("x")), model, keep="kept").collect()
    for r in rows:
        score = sum(model.weights[x] for x in set(ordinal_quality.features(r.text).tolist()))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r._grade == pytest.approx(sum(tails), abs=1e-6) and r._tail == pytest.approx(tails[1], abs=1e-6)
        assert r.kept == (round(tails[1], 9) >= ordinal_quality.KEEP_TAIL) and r["_keep"] == "x"
    rng = np.random.default_rng(3)
    found = [np.sort(rng.choice(40, 12, replace=False)).astype(np.int32) for _ in range(600)]
    truth = np.array([sum((x < 5) * 1.0 - (x >= 35) for x in f) + rng.logistic() for f in found])
    grades = (truth > 0).astype(int) + (truth > 1.5)
    fit = ordinal_quality.fit(found, grades)

    def loss(w, thresholds):
        total = 0.0
        for k, t in enumerate(thresholds, 1):
            share = np.clip(np.mean(grades >= k), 1e-3, 1 - 1e-3)
            z = np.array([w[f].sum() for f in found]) - t
            side = np.where(grades >= k, np.clip(0.5 / share, 0.5, 4), np.clip(0.5 / (1 - share), 0.5, 4))
            total += np.mean(side * np.log1p(np.exp(np.where(grades >= k, -z, z))))
        return total + ordinal_quality.LAMBDA * np.abs(w).sum()

    best = loss(fit.weights, fit.thresholds)
    for _ in range(40):
        step = np.zeros_like(fit.weights)
        step[:40] = rng.normal(size=40) * 0.2
        assert loss(fit.weights + step, fit.thresholds + rng.normal(size=2) * 0.1) > best - 1e-3


@pytest.mark.parametrize("name", ["op3_minhash", "op10_mixing"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 200


def test_quality_holds_out(spark, docs):
    table = queries.table(spark, "/root/testdata/sf0.01", "documents")
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    model = ordinal_quality.train(table.where("doc_id % 3 <> 0"), labels)
    assert model.thresholds[0] < model.thresholds[1]
    rows = ordinal_quality.score(table.where("doc_id % 3 = 0"), model).join(labels, "doc_id").collect()
    good = [r._keep for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r._keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2
    scored = ordinal_quality.score(docs, model).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r._grade <= 2 and r.size == 1 for r in scored)
    assert ordinal_quality.train(docs, labels.limit(0)).tails([np.zeros(0, np.int32)]).round(6).tolist() == [[0.666667, 0.333333]]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_lexicon_round_trip(spark, docs, tokenizer):
    lex = lexicon.Lexicon.of(docs, queries.tokenizer_path(), most=20)
    for r in lexicon.round_trip(docs, lex).collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    assert lexicon.Lexicon.of(docs.limit(0), queries.tokenizer_path()).encoder()([None]) == [b""]


def encoder(spec, most_bytes):
    split = word_bpe.Splitter(word_bpe.special_tokens(spec))
    return word_bpe.Encoder(*word_bpe.by_pieces(split, lexicon._merged(word_bpe.Merger(spec)), "<u4"), most_bytes)


def test_pieces_like_the_library(tokenizer):
    spec = word_bpe.load(open(queries.tokenizer_path(), encoding="utf-8").read())
    rng = random.Random(1)
    bits = list("abcABC  '\n\t.,!09é ÉßªΣσςİǅéſ½²Ⅷ\x85\xa0\x1c­中кД😀́_-…“") + ["'s", "'LL", "<|startoftext|>", " the ", "ation"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["ab" * 300 + "x", "é" * 500]
    words = sorted({b"the", b"ation", b"abc", "é".encode()})
    merged = word_bpe.Merger(spec).merge(words)
    automaton = lexicon.Transducer.from_bytes(lexicon.Transducer.compile(words, merged).to_bytes())
    assert [np.frombuffer(x, "<u4").tolist() for x in automaton.lookup(words)] == [x.tolist() for x in merged]
    assert automaton.lookup([b"th", b"zzz", b""]) == [None] * 3
    own = encoder(spec, 1000)([t.encode() for t in texts])
    for t, ids in zip(texts, own, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_letters_and_marks_like_the_library(tokenizer):
    spec = word_bpe.load(open(queries.tokenizer_path(), encoding="utf-8").read())
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [a + chr(m) for a in letters + letters.lower() for m in range(0x300, 0x370)]
    texts += [f"AB {a}\u1dc2{chr(m)}x{a} CD" for a in letters for m in range(0x300, 0x370)]
    own = encoder(spec, 1000)([t.encode() for t in texts])
    assert not [t for t, ids in zip(texts, own, strict=True) if np.frombuffer(ids, "<u4").tolist() != tokenizer.encode(t, add_special_tokens=False).ids]


def test_whole_texts_of_a_table_like_the_library(spark, tokenizer, monkeypatch):
    """Every document of a table by both encoders, with caches that turn over often."""
    path = queries.tokenizer_path()
    texts = [r.text for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    want = [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    raw = [None if t is None else t.encode() for t in texts]
    monkeypatch.setattr(token_store, "WORD_BYTES", 1 << 20)
    monkeypatch.setattr(lexicon, "MERGED", 500)
    monkeypatch.setattr(word_bpe.Encoder, "CHUNK", 1 << 16)
    source = open(path, encoding="utf-8").read()
    assert [np.frombuffer(x, "<u2").tolist() for x in token_store.library_encoder(source, 2)(raw)] == want
    own = lexicon.Lexicon(source, sorted({w for t in texts[:50] for w in (t or "").lower().encode().split() if len(w) <= lexicon.LONGEST}))
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encoder()(raw)] == want


def no_single_words(monkeypatch):
    """From now on a word that is cut by itself fails."""

    def fails(self, text):
        raise AssertionError(f"{text!r} was cut by itself")

    monkeypatch.setattr(word_bpe.Splitter, "plain", fails)


MANY_WORDS = [f"Wörd{i}, W{i}'s x\x85Y{i}\tžluť{i}É \x00Σ{i}ΟΣ's DON'T\xa0{i}" for i in range(300)] + ["", None, "\x85\xa0", "a\u0301b\u0301 é", "y" * 200 + " " + "ž" * 200]


def test_token_store_cuts_words_together(tokenizer, monkeypatch):
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in MANY_WORDS]
    no_single_words(monkeypatch)
    encode = token_store.library_encoder(open(queries.tokenizer_path(), encoding="utf-8").read(), 2)
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, "<u2").tolist() for x in encode([t and t.encode() for t in MANY_WORDS])] == want
    assert encode([]) == []


def test_lexicon_cuts_words_together(tokenizer, monkeypatch):
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in MANY_WORDS]
    no_single_words(monkeypatch)
    lex = lexicon.Lexicon(open(queries.tokenizer_path(), encoding="utf-8").read(), sorted({f"w{i}'s".encode() for i in range(0, 300, 2)}))
    for _ in range(2):  # the second time with merged words
        ids = lex.encoder()([t and t.encode() for t in MANY_WORDS])
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want


class Counted:
    """Stands for the library's class and notes which pieces a bare model is given."""

    given: list[str] = []
    from_str = staticmethod(Tokenizer.from_str)

    def __init__(self, model):
        self.__dict__["own"] = Tokenizer(model)

    def __setattr__(self, name, value):
        setattr(self.own, name, value)

    def encode_batch_fast(self, texts, **more):
        self.given.extend(p for t in texts for p in t.split(" "))
        return self.own.encode_batch_fast(texts, **more)


def test_token_store_gives_each_piece_to_the_library_once(tokenizer, monkeypatch):
    source = open(queries.tokenizer_path(), encoding="utf-8").read()
    rounds = [[f"{a}Haat{i}{b} čaš{chr(0x4E00 + i)}{b}\t\té{i}{a} w\xe9{b}" for i in range(300)] for a, b in [("", ""), ("(", ","), ("", "."), ("[", "'s")]]
    want = [[x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)] for texts in rounds]
    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    monkeypatch.setattr(Counted, "given", [])
    encode = token_store.library_encoder(source, 2)
    for texts, ids in zip(rounds, want, strict=True):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in texts])] == ids
    assert len(Counted.given) == len(set(Counted.given)) > 300
    # A cache that holds little gives the same ids and stays small.
    monkeypatch.setattr(token_store, "WORD_BYTES", 2000)
    monkeypatch.setattr(word_bpe.Encoder, "CHUNK", 100)
    encode = token_store.library_encoder(source, 2)
    for texts, ids in zip(rounds, want, strict=True):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in texts])] == ids
        assert sum(map(len, encode.known.to_pylist())) < 2000


def test_token_store_leaves_new_letters_to_the_library(tokenizer):
    """Letters and marks by themselves and behind another mark; the tables of Python, of its regex module and of the library lack different new ones."""
    points = [c for c in [*range(0x80, 0x20000), *range(0x2B730, 0x2CEB0), *range(0x32300, 0x33500), *range(0x3CF00, 0x3FD00, 7)] if not 0xD800 <= c < 0xE000]
    texts = [f"A{chr(c)}b,{chr(c)}. \u0301{chr(c)}\xc9'S plain words" for c in points]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = token_store.library_encoder(open(queries.tokenizer_path(), encoding="utf-8").read(), 2)([t.encode() for t in texts])
    assert not [hex(c) for c, x, ids in zip(points, got, want, strict=True) if np.frombuffer(x, "<u2").tolist() != ids]


def test_token_store_encodes_batches_together():
    batches = [pa.RecordBatch.from_pydict({"key": [i, None], "text": ["x" * 40, None]}) for i in range(7)]
    tables = list(token_store.together(iter(batches), 3 * batches[0].nbytes))
    assert [t.num_rows for t in tables] == [6, 6, 2] and pa.concat_tables(tables) == pa.Table.from_batches(batches)
    assert list(token_store.together(iter([]), 1)) == []


def test_token_shards(docs, tokenizer):
    files = token_store.write_shards(docs, queries.tokenizer_path(), shard_ids=2000)
    got = sorted(((r.start, r.key, r.n_tokens, r.ids_crc32) for r in token_store.read_documents(files).collect()))
    want, start = [], 0
    for key, text in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((start, key, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    shard = next(s for s in map(token_store.read_shard, [r.path for r in files.collect()]) if 11 in s.keys.tolist())
    assert shard.get(11, 1) is not None and shard.get(12345) is None
    assert token_store.write_shards(docs.limit(0), queries.tokenizer_path()).count() == 0
    raw = bytearray(token_store.build_shard([1], [b"\1\0"], 2, {}))
    raw[-6] ^= 1
    with pytest.raises(ValueError):
        token_store.Shard(bytes(raw))
    assert hashlib.sha256(token_store.Shard(token_store.build_shard([1], [b"\1\0"], 2, {})).get(1).tobytes()).hexdigest()
