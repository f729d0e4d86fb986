"""The pipeline's stages, each row of each against plain Python, on a table with awkward rows and clashing column names."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import ordinal_quality, queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"
LONG = "the same passage of a text that is found in several documents of the table and so is a repeat"
AWKWARD = [
    (None, LONG, "en", None, 7), (None, None, None, None, None), (100001, None, "en", None, 0), (100002, "", None, "x", 0), (100003, " \n\t", "de", "x", None),
    (100004, LONG, "en", "x", 1), (100004, LONG, "en", "x", 1), (100005, LONG + " indeed", "en", "y", 2), (100005, "other words\n" + LONG.upper(), "en", "y", 3),
    (100006, "Kept line one\n" + LONG + "\nshort\n\n" + LONG, "en", None, 9), (100007, ("ab cd " * 9000 + "\n") * 2, "fr", "long", 5), (-5, LONG + "\nİ ﬁ É", "en", "", 4),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    table = queries.table(spark, SF, "documents")
    both = table.unionByName(spark.createDataFrame(AWKWARD, table.schema))
    extra = {"_keep": F.lit("k"), "gone": F.lit(1), "_mix_copy": F.lit(2), "any": F.lit(None).cast("string"), "_dropped": F.lit(3), "decoded": F.lit(4)}
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    both.withColumns(extra).write.parquet(path)
    return spark.read.parquet(path)


def good(rows, model):
    def tail(text):
        score = sum(model.weights[x] for x in set(ordinal_quality.features(text).tolist()))
        return 1 / (1 + math.exp(model.thresholds[1] - score))

    return [r for r in rows if round(tail(r["text"]), 9) >= ordinal_quality.KEEP_TAIL]


def key(line):
    found = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    return found if len(found) >= 10 else None


def lines(rows, _):
    first = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if r["doc_id"] is not None and key(line):
                first[key(line)] = min(first.get(key(line), r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        own = (r["text"] or "").split("\n")
        left = [x for x in own if r["doc_id"] is None or not key(x) or first[key(x)] >= r["doc_id"]]
        text = "\n".join(left)
        out.append(r if len(left) == len(own) else r | {"text": text, "n_chars": len(text)})
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def representatives(rows, _):
    sets = {}
    for r in rows:
        if r["doc_id"] is not None and shingles(r["text"]):
            sets.setdefault(shingles(r["text"]), set()).add(r["doc_id"])
    nodes = sorted(sets, key=lambda s: min(sets[s]))
    root = list(range(len(nodes)))
    for i, a in enumerate(nodes):
        for j in range(i):
            b = nodes[j]
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                old, new = sorted((root[i], root[j]), reverse=True)
                root = [new if x == old else x for x in root]
    least = {}
    for s, c in zip(nodes, root, strict=True):
        least[c] = min(least.get(c, min(sets[s])), min(sets[s]))
    class_of = dict(zip(nodes, root, strict=True))
    kept = {r["doc_id"] for r in rows if not shingles(r["text"]) or (r["doc_id"] is not None and least[class_of[shingles(r["text"])]] == r["doc_id"])}
    return [r for r in rows if r["doc_id"] is None or r["doc_id"] in kept]


def mixed(rows, _):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rate, free, left = {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        for s in over or free:
            goal = 3 * sizes[s] if over else left * weight[s] / total
            rate[s] = goal / sizes[s] if sizes[s] else 0.0
        if not over:
            break
        left -= sum(3 * sizes[s] for s in over)
        free -= set(over)
    out = []
    for r in rows:
        name = "null" if r["doc_id"] is None else r["doc_id"]
        drawn = int(hashlib.md5(f"17:{name}".encode()).hexdigest()[:13], 16) / 2**52
        whole = math.floor(rate[r["source"]])
        out += [r] * (whole + (drawn < rate[r["source"]] - whole))
    return out


def encoded(rows, _):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out = []
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        new = {"ids": np.array(ids, "<u4").tobytes(), "n_tokens": len(ids), "decoded": tokenizer.decode(ids, skip_special_tokens=False)}
        out.append({k: v for k, v in r.items() if k != "text"} | new)
    return out


BRUTE = {"quality": good, "lines": lines, "near_duplicates": representatives, "mix": mixed, "encode": encoded}


def rows_of(df):
    return [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()} for r in df.collect()]


def bag(rows):
    return Counter(tuple(sorted(r.items())) for r in rows)


def test_each_stage_on_all_rows(spark, docs):
    model = ordinal_quality.train(docs, queries.table(spark, SF, "labels"))
    rows = rows_of(docs)
    for name, function in corpus_pipeline.STAGES:
        got = function(spark, docs, SF)
        assert name == "encode" or got.columns == docs.columns, name
        want = bag(BRUTE[name](rows, model))
        assert bag(rows_of(got)) == want, name
        assert name == "encode" or want != bag(rows), name


def test_the_whole_run(spark):
    docs = queries.table(spark, SF, "documents")
    model = ordinal_quality.train(docs, queries.table(spark, SF, "labels"))
    rows = rows_of(docs)
    for name, _ in corpus_pipeline.STAGES:
        rows = BRUTE[name](rows, model)
    got = rows_of(corpus_pipeline.run(spark, SF))
    assert bag(got) == bag(rows) and len(rows) > 100


def test_empty_table(spark, docs):
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), SF).count() == 0, name


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
