"""Chunks at odd white space, against plain Python."""

import re

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import search as S


def test_white_space_at_ends(spark):
    """Only the ends are looked at, and as white space counts what Java's Unicode \\s matches."""
    marks = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "c string").where("c <> '\\0'")
    around = F.concat("c", F.lit("x"), "c", "c")
    odd = marks.where(T.strip(around) != F.regexp_replace(around, r"(?U)^\s+|\s+$", "")).collect()
    assert not odd and "regexp" not in spark.range(1).select(T.strip(F.lit("a")))._jdf.queryExecution().logical().toString()


def test_chunks_at_odd_white_space(spark):
    long = "y" * 999 + "  " + "z" * 1500
    texts = ["  . a ", "　One. Two!\n\n Three?  ", ".  .\t. x", f"Start. {long}! End.", f"{long}.\u0085{long}", " \n ", "x" * 1000 + " " + "y" * 5, ". " * 700]
    got = {i: [] for i in range(len(texts))}
    for r in S.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "ord").collect():
        got[r.doc_id].append(r.text)
    assert list(got.values()) == [plain_chunks(t) for t in texts]


def plain_chunks(text, most=1000):
    done, cur = [], ""
    for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text)):
        if not s:
            continue
        if cur and len(cur) + len(s) + 1 > most:
            done, cur = [*done, cur], ""
        while len(s) > most:
            done.append(s[:most])
            s = s[most:]
        cur = f"{cur} {s}".strip()
    return [*done, cur] if cur else done
