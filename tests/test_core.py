"""Hand-checkable cases of the engine's operators."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import catalog as C
from quern.operators import evalset as E
from quern.operators import metrics as M
from quern.operators import search as S
from quern.plans.setup import Setup, SetupError


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def chunk_ranking(spark):
    parts = [(3, "b", 0.9), (0, "a", 0.8), (1, "a", 0.7), (2, "a", 0.6), (4, "c", 0.5), (5, "b", 0.1)]
    return spark.createDataFrame([(1, d, c, s, i + 1) for i, (c, d, s) in enumerate(parts)], "query_id int, doc_id string, ord int, score double, rank int")


def test_best_chunk_and_sums(chunk_ranking):
    assert [r[1] for r in rows(S.best_chunk(chunk_ranking, 10), "rank")] == ["b", "a", "c"]
    assert [(r[1], r[2]) for r in rows(S.sum_of_chunks(chunk_ranking, 3, 10), "rank")] == [("a", 2.1), ("b", 1.0), ("c", 0.5)]


def test_metrics(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "d", 2)], "query_id int, doc_id string, grade int")
    one, two = M.per_query(queries, qrels, run).orderBy("query_id").collect()
    ideal = 2 + 2 / math.log2(3) + 1 / 2
    assert one.ndcg_10 == pytest.approx((1 + 1) / ideal)
    assert (one.mrr_10, one.success_1, one.p_10, one.judged_10) == (1.0, 1.0, 0.2, pytest.approx(2 / 3))
    assert one.recall_100 == pytest.approx(2 / 3)
    assert (two.mrr_10, two.ndcg_10, two.recall_100, two.judged_10) == (0.0, 0.0, None, 0.0)


def test_rbo(spark):
    shape = "key int, doc_id string, rank int"
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (3, "x", 1)], shape)
    b = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "x", 1), (3, "y", 1)], shape)
    got = dict(rows(M.rbo(a, b), "key"))
    assert got[1] == pytest.approx(0.81 + 0.1 / 0.9 * 0.81, abs=1e-6) and got[2] == pytest.approx(1.0) and got[3] == 0.0


def test_statistics(spark):
    assert [round(M.sign_test(*x), 9) for x in ((3, 3), (0, 0), (5, 0), (3, 12))] == [1, 1, 2 / 32, round(2 * 576 / 32768, 9)]
    got = spark.createDataFrame([(3, 3), (0, 0), (5, 0), (3, 12)], "h int, l int").select(M.sign_test_column(F.col("h"), F.col("l")).alias("p")).collect()
    assert [round(r.p, 9) for r in got] == [1, 1, 2 / 32, round(2 * 576 / 32768, 9)]
    equal = spark.createDataFrame([(i, 0.5, 0.5) for i in range(30)], "query_id int, a double, b double")
    apart = spark.createDataFrame([(i, 1.0, 0.0) for i in range(30)], "query_id int, a double, b double")
    assert M.randomization(equal, 500).first().p == 1.0 and M.randomization(apart, 500).first().p < 0.01
    pairs = spark.createDataFrame([(0, 1, 1), (2, 1, 1), (2, 0, 1), (1, 0, 1), (1, 1, 1)], "a int, b int, weight int")
    assert tuple(M.grade_shift(pairs).first()) == (1, 3)


def test_fusion_and_rerank(spark):
    shape = "query_id int, doc_id string, score double, rank int"
    a = spark.createDataFrame([(1, "x", 9.0, 1), (1, "y", 8.0, 2)], shape)
    b = spark.createDataFrame([(1, "y", 5.0, 1)], shape)
    got = rows(S.rrf([a, b], ids=("doc_id",)).select("doc_id", "score"), "rank")
    assert got == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9))]
    new = spark.createDataFrame([(1, "x", 0.1), (1, "y", 0.2)], "query_id int, doc_id string, score double")
    three = a.unionByName(spark.createDataFrame([(1, "z", 99.0, 3)], shape))
    assert [r[0] for r in rows(S.rerank(three, new, 2, ("doc_id",)).select("doc_id"), "rank")] == ["y", "x", "z"]


def test_token_max(spark):
    data = zip([0, 7, 5, 7, 2, 1], [0.9, 0.2, 0.0, 0.6, 0.8, 0.5], [1, 1, 1, 1, 1, 0], strict=True)
    df = spark.createDataFrame([("d", 0, t, w, m, t <= 3) for t, w, m in data], "doc_id string, ord int, token int, weight double, mask int, special boolean")
    assert [tuple(r) for r in S.token_max(df).select("token", "weight").collect()] == [(7, 0.6)]


def test_chunks(spark):
    long = "x" * 2500
    docs = spark.createDataFrame([(1, "One. Two! Three?"), (2, ""), (3, None), (4, f"Start. {long} end. Last.")], "doc_id int, text string")
    got = rows(S.chunks(docs), "doc_id", "ord")
    assert got == [(1, 0, "One. Two! Three?"), (4, 0, "Start."), (4, 1, "x" * 1000), (4, 2, "x" * 1000), (4, 3, "x" * 500 + " end. Last.")]


def test_metadata_chunks(spark):
    shape = "doc_id string, title string, title_lang string, title_translated string, title_translated_lang string, keywords_cs array<string>, keywords_en array<string>, abstract_cs string, abstract_en string"
    df = spark.createDataFrame([("a", "Názov", "sk", "Title", "en", ["x", "y"], [], " a  b ", None), ("b", None, None, None, None, None, None, None, None)], shape)
    assert rows(S.metadata_chunks(df), "ord") == [("a", -2, "Title"), ("a", -1, "Názov\nx, y\na b")]


def test_text(spark):
    values = [
        (T.equality_key(F.lit("Právní úprava: PROSTITUCE!")), "pravni uprava prostituce"),
        (T.short_lang(F.lit("en-US")), "en"),
        (T.short_lang(F.lit(" ")), None),
        (T.query_text(F.lit("návratnost  50 % : a?")), "návratnost 50 : a?"),
        (T.query_text(F.lit("čas: pojetí?"), escaped=True), "čas\\: pojetí\\?"),
        (T.unescape(F.lit("a &amp;amp;lt; b")), "a < b"),
        (T.copy_share(F.lit("a b"), F.lit("x")), 1.0),
        (T.prepare(F.lit("ﬁn­al")), "final"),
        (T.cut_keywords(F.lit("One two. Three. Keywords: a, b"))["text"], "One two. Three."),
        (T.cut_keywords(F.lit("Some Keywords: a in one sentence"))["cut"], False),
        (T.first_json(F.lit('so: {"a": 1} end'), "a int")["a"], 1),
        (T.fill("Hi {x}!", x=F.lit(3)), "Hi 3!"),
    ]
    got = spark.range(1).select(*[c.alias(str(i)) for i, (c, _) in enumerate(values)]).first()
    assert list(got) == [v for _, v in values]


def test_body_choice(spark):
    file = "array<struct<bundle:string,name:string,description:string,format:string,size:bigint,url:string,md5:string,access:string>>"
    pdf = lambda n, d=None: ("ORIGINAL", n, d, C.PDF, 1, "u", "m", None)
    txt = lambda n, s, a=None: ("TEXT", n, None, "text/plain", s, "u", "m", a)
    data = [
        (1, [pdf("a", C.BODY_DESCRIPTION), pdf("b"), txt("a.txt", 1), txt("b.txt", 9)]), (2, [pdf("a"), pdf("b"), txt("a.txt", 1), txt("b.txt", 9)]),
        (3, [pdf("a", C.BODY_DESCRIPTION), pdf("b"), txt("b.txt", 9)]), (4, [txt("a.txt", 1)]), (5, [pdf("a"), txt("a.txt", 1, "restrictedAccess")]),
    ]
    df = spark.createDataFrame(data, f"id int, files {file}").select("id", C.choose_body(F.col("files"), F.lit(None).cast("string")).alias("b"))
    got = {r.id: (r.b.name, r.b.rule, r.b.same_as_largest, r.b.missing) for r in df.collect()}
    assert got[1] == ("a.txt", "description", False, None) and got[2] == ("b.txt", "largest text", True, None)
    assert got[3][0] is None and got[3][3] == "no text" and got[4][3] == "no pdf" and got[5][3] == "restricted"


def test_outcomes_and_representative(spark):
    got = spark.createDataFrame([("N", "Prospěl"), (None, "Neprospěl"), (None, "Uznáno"), (None, "Výborně"), (None, None)], "s string, g string").select(E.outcome(F.col("s"), F.col("g"))).collect()
    assert [r[0] for r in got] == ["N", "N", "U", "O", None]
    df = spark.createDataFrame([(1, "old", "O", "2001", False, True), (1, "late", "N", "2005", False, True), (2, "t", "N", "1", True, True), (3, "u", "O", "1", False, False)],
        "grp int, doc_id string, outcome string, accepted string, is_target boolean, usable boolean")
    assert rows(E.representative(df), "grp") == [(1, "old"), (2, "t")]


def test_stratified(spark):
    df = spark.createDataFrame([("t", i, 0 if i < 200 else 1 if i < 280 else 2) for i in range(300)], "topic string, doc_id int, grade int")
    got = {r.grade: r["count"] for r in E.stratified(df, 150).groupBy("grade").count().collect()}
    assert got[2] == 20 and sum(got.values()) == 150


def test_setups_are_checked(spark):
    good = {"branches": {"l": {"kind": "lexical"}}, "fusion": {"method": "none"}}
    assert Setup.of(good).fingerprint() == Setup.of(good | {"name": "x"}).fingerprint()
    for bad in ({}, good | {"colour": 1}, {"branches": {"l": {"kind": "magic"}}}, good | {"rerank": {"step": "none.v1", "candidates": 5}},
        good | {"rerank": {"step": "token-overlap.v1", "candidates": 5}, "aggregation": {"method": "sum of top chunks", "chunks": 2}}):
        with pytest.raises(SetupError):
            Setup.of(bad)


def test_changes_and_terms(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, text string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "doc_id int, text string")
    assert rows(C.changes(old, new, "doc_id", "text"), "doc_id") == [(2, "changed"), (3, "withdrawn"), (4, "added")]
    docs = spark.createDataFrame([("h1", "Mutace genu TP53 a\nBRCA1"), ("h2", "gen TP 53")], "doc_id string, text string")
    terms = spark.createDataFrame([("tp53",), ("TP53 a BRCA1",), ("egfr",)], "term string")
    assert rows(E.term_holders(terms, docs), "term") == [("TP53 a BRCA1", "h1"), ("tp53", "h1")]


def test_groups_and_terms_of_the_contract(spark):
    """Status before grade, rigorous theses, terms of several words, commas after authors."""
    got = spark.createDataFrame([("O", "Neprospěl"), ("U", "Výborně"), ("N", None), (None, "Uznáno"), (None, "Uznáno zčásti"), ("", "Nedostatečně"), ("O", None), (None, "")], "s string, g string")
    assert [r.o for r in got.select(E.outcome(F.col("s"), F.col("g")).alias("o")).collect()] == ["O", "U", "N", "U", "O", "N", "O", None]
    shape = "doc_id int, thesis_type string, outcome string, title string, author string"
    members = spark.createDataFrame(
        [(1, "diplomová práce", "O", "Straße", "Novák, J.,"), (2, "Rigorózní práce", "O", "STRASSE!", "Novák J. "), (3, "bakalářská práce", "O", "Film", "A"), (4, "diplomová práce", "O", "ﬁlm", "A,"), (5, "x", "O", "", "B"), (6, "x", "O", "", "B")], shape
    )
    assert {(r.same_work, r.shape) for r in E.same_work(E.same_title_groups(members)).collect()} == {(True, "rigorous thesis"), (False, "rigorous thesis")}
    docs = spark.createDataFrame([(1, "the bathe catalog"), (2, "He saw the\ncat."), (3, None), (4, "the CAT – the")], "doc_id int, text string")
    terms = spark.createDataFrame([("the cat",), ("cat",), ("cat - the",), (None,), ("...",)], "term string")
    assert {(r.term, r.doc_id) for r in E.term_holders(terms, docs).collect()} == {("the cat", 2), ("the cat", 4), ("cat", 2), ("cat", 4), ("cat - the", 4)}


def test_plan_order_and_medians(spark):
    rows, first = spark.range(500).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(7, 2), (9, 1)], "doc_id long, priority int")
    got = {r.doc_id: r.pos for r in E.plan_order(rows, first).collect()}
    assert (got[9], got[7]) == (1, 2) and sorted(got.values()) == list(range(1, 501))
    values = [("a", float(x)) for x in (5, 1, 4, 2)] + [("b", 3.0)] * 5 + [("c", None), ("d", 1e9), ("d", -1.0), ("d", 0.0)]
    got = {r.k: (r["median"], r.upper_median) for r in C.medians(spark.createDataFrame(values, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (3.0, 4.0), "b": (3.0, 3.0), "d": (0.0, 0.0)}
