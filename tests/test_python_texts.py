"""Texts that go through Python: entities without a semicolon, pieces of a batch, keys that are made once."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quern import oracles, workloads
from quern.functions import text as T
from quern.operators import evalset as E


def test_pages_with_entities_cut_off(spark, tmp_path):
    """A page may end, or a tag begin, in the middle of an entity; the SQL leaves such a one as it is."""
    pages = ["a &amp;amp&lt;p&gt; b", "x &amp", "x &am", "&ltb &copyright; &amp;lt;i&amp;gt; c", "&quot;q&quot; &#39;&middot;&copy;\n z", "&notit; &ampx; &bogus; & &; &#; &amp;amp;amp;", "<b>&amp;</b>&amp <i>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(db.execute(oracles.oracle_sql()["html_unescape_strip"]).fetchall())
    assert {r.page_id: r.text for r in workloads.QUERIES["html_unescape_strip"](spark, str(tmp_path)).collect()} == want


def test_closed_entities_go_deep(spark):
    got = spark.range(1).select(T.unescape_closed(F.lit("&amp;amp;amp;#233;&eacute;&#xe9;&#XE9 &amp")).alias("t"), T.unescape(F.lit("&amp")).alias("u")).first()
    assert (got.t, got.u) == ("ééé&#XE9 &amp", "&")


def test_a_batch_of_texts_goes_in_pieces():
    texts = pa.array([None, "", *[f"Straße {i % 7} " + "x" * (i % 400) for i in range(1000)]])
    for made, plain in ((T.equality_key, T._key), (T.typed, T._typed), (T.unescape, T._unescaped)):
        out = list(made.func(iter([texts])))
        assert max(map(len, out)) == T.PIECE and [t for a in out for t in a.to_pylist()] == [None if t is None else plain(t) for t in texts.to_pylist()]


def test_group_keys_in_pieces():
    titles, authors = ["Straße", "STRASSE!", " ", None] * 200, ["A,", "a", "b", "c"] * 200
    out = list(E._group_keys(iter([(pa.array(titles), pa.array(authors))])))
    assert max(map(len, out)) == T.PIECE and [k for a in out for k in a.to_pylist()] == ["strasse|a", "strasse|a", None, None] * 200


def test_group_keys_are_made_once_a_row(spark):
    """A pass through Python on each side of the join: none for the filter, none for title and author apart."""
    rows = spark.createDataFrame([(i, f"T {i % 3}", "A") for i in range(9)], "doc_id int, title string, author string")
    plan = E.same_title_groups(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 2 and E.same_title_groups(rows).count() == 9


def test_terms_in_pieces():
    titles = ["Straße", "STRASSE!", " ", None] * 200
    shared = type("Shared", (), {"value": {"strasse": [("Straße", "strasse", frozenset(["strasse"]))]}})
    out = list(E._holding(shared).func(iter([pa.array(titles)])))
    assert max(map(len, out)) == T.PIECE and [t for a in out for t in a.to_pylist()] == [["Straße"], ["Straße"], [], []] * 200
