"""Sources, sinks and streams."""

import gzip

from pyspark.sql import functions as F

from quern import workloads
from quern.plans.setup import Setup, answer
from quern.sources import jsonl, records, trec
from quern.sources.paged import Paged
from quern.streaming import ingest

PAGE = """<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><responseDate>x</responseDate><ListRecords>
<record><header><identifier>oai:x/1 </identifier><datestamp>2020</datestamp><setSpec>a</setSpec><setSpec>b</setSpec></header>
<metadata><metadata><element name="dc"><element name="title"><element name="en"><field name="value">Title</field></element></element>
<element name="date"><element name="issued"><element name="none"><field name="value">2019</field></element></element></element></element></metadata></metadata></record>
<record><header status="deleted"><identifier>oai:x/2</identifier><datestamp>2021</datestamp></header></record>
<resumptionToken>next</resumptionToken></ListRecords></OAI-PMH>"""


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write('{"a": 1, "b": "x"}\n\n{"a": 2}\n{"a": 3, "b": "y", "c": 1}\n{"a": 4, "b"')
    read = lambda **k: sorted(r.a for r in jsonl.read(spark, str(path), "a int, b string", **k).collect())
    assert read() == [1, 2, 3] and read(required=("b",)) == [1, 3] and read(required=("b",), closed=True) == [1]


def test_trec(spark, tmp_path):
    (tmp_path / "qrels").write_text("q1 0 d1 1\nq1 0 d2 0\nq1 0 d1 2\n")
    got = {(r.query_id, r.doc_id): r.grade for r in trec.read_qrels(spark, str(tmp_path / "qrels")).collect()}
    assert got == {("q1", "d1"): 2, ("q1", "d2"): 0}
    run = spark.createDataFrame([("q1", "b", 1, 0.5), ("q1", "a", 2, 0.25)], "query_id string, doc_id string, rank int, score double")
    trec.write_run(run, "s", str(tmp_path / "run"))
    assert [tuple(r) for r in trec.read_run(spark, str(tmp_path / "run")).orderBy("rank").collect()] == [("q1", "b", 1), ("q1", "a", 2)]
    assert spark.read.text(str(tmp_path / "run")).first().value == "q1 Q0 b 1 0.500000 s"


def test_xml_records(spark, tmp_path):
    with gzip.open(tmp_path / "p1.xml.gz", "wt") as f:
        f.write(PAGE)
    rows = records.read(spark, str(tmp_path))
    assert [(r.identifier, r.deleted, r.sets) for r in records.headers(rows).orderBy("identifier").collect()] == [("oai:x/1", False, ["a", "b"]), ("oai:x/2", True, None)]
    got = sorted((r.name, r.value, r.lang) for r in records.fields(rows).collect())
    assert [g[:2] for g in got] == [("dc.date.issued", "2019"), ("dc.title", "Title")] and got[0][2] is None and got[1][2] == "en"
    page = spark.createDataFrame([(PAGE,)], "p string").select(records.resumption_token(F.col("p")).alias("t"), records.error_code(F.col("p")).alias("e")).first()
    assert (page.t, page.e) == ("next", None)


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(Paged)
    options = {"fetcher": "tests.paged_fixture:fetch", "collections": "plain,flaky,stale", "pause": "0"}
    rows = spark.read.format("paged").options(**options).load().collect()
    for c in ("plain", "flaky", "stale"):
        assert sorted(r.id for r in rows if r.collection == c) == [f"{c}-{i}" for i in range(5)]
    stream = spark.readStream.format("paged").options(**options | {"collections": "plain"}).load()
    out = str(tmp_path / "out")
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start(out)
    try:
        for _ in range(60):
            q.awaitTermination(0.5)
            if q.lastProgress and len(q.recentProgress) >= 4:
                break
    finally:
        q.stop()
    assert {r.id for r in spark.read.parquet(out).collect()} == {f"plain-{i}" for i in range(5)}


def test_windows_agree_with_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ingest.tumbling(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    want = workloads.QUERIES["events_tumbling"](spark, "/root/testdata/sf0.001").withColumn("start", F.col("start").cast("timestamp"))
    got = spark.sql("SELECT * FROM tumbling")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_versions(spark, tmp_path):
    table = ingest.VersionedTable(spark, str(tmp_path / "v"))
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id int, content string, gone boolean")
    table.apply(batch((1, "a", False), (2, "b", False)), 0)
    table.apply(batch((1, "a", False), (2, "c", False), (3, "d", False)), 1)
    table.apply(batch((3, None, True)), 2)
    table.apply(batch((3, None, True)), 2)
    assert sorted(map(tuple, table.current().collect())) == [(1, 1, "a"), (2, 2, "c")]
    assert table.history().count() == 5


def test_a_setup_answers_like_its_plan(spark):
    d = workloads.Data(spark, "/root/testdata/sf0.001")
    setup = Setup.of({"branches": {"l": {"kind": "lexical"}, "s": {"kind": "semantic"}}, "fusion": {"method": "rrf", "k": 60}})
    got = answer(setup, d.queries(), d.chunks(), {"lexical": d.lexical_scores(), "semantic": d.semantic_scores()})
    from quern.operators import search as S

    want = S.best_chunk(S.rrf([d.lexical(), d.semantic()]), 100)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


class _Server:
    """Pages of a collection whose tokens are forgotten once."""

    def __init__(self, forget):
        self.forget, self.asked = forget, []

    def __call__(self, collection, token):
        from quern.sources.paged import StaleToken

        self.asked.append(token)
        page = int(token or 0)
        if token in self.forget:
            self.forget.remove(token)
            raise StaleToken
        rows = [(f"{collection}{page}", "b"), (f"{collection}{page + 1}", "b")]  # neighbours overlap
        return rows, None if page == 3 else str(page + 1)


def test_forgotten_tokens(monkeypatch):
    from quern.sources import paged

    server = _Server({"2"})
    monkeypatch.setattr(paged, "fetcher", lambda name: server)
    rows = list(paged.PagedReader({"collections": "a", "fetcher": "x"}).read(paged.Collection("a")))
    assert [(r[1], r[2]) for r in rows] == [(0, "a0"), (0, "a1"), (1, "a2"), (2, "a3"), (3, "a4")]
    stream = paged.PagedStream({"collections": "a", "fetcher": "x"})
    at, pages = stream.initialOffset(), []
    for _ in range(5):
        server.forget = {"3"} if len(pages) == 3 else set()
        got, end = stream.read(at)
        got = list(got)
        server.forget = {"1"} if len(pages) == 1 else set()
        assert list(stream.readBetweenOffsets(at, end)) == got
        pages.append([r[1] for r in got])
        at = end
    assert pages == [[0, 0], [1, 1], [2, 2], [3, 3], []] and at == {"a": paged.COMPLETE}
