"""Catalog records: body choice, first and last wins, fallbacks, versions, visibility, vectors of documents, small graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Fixed values of the catalog.
BODY_DESCRIPTION, OPEN_ACCESS, PDF = "Text práce", "openAccess", "application/pdf"


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key: the first in the given order. Partial aggregation keeps a frequent key out of one task."""
    names = rows.columns
    best = rows.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in names])


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key: the last in the given order."""
    names = rows.columns
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in names])


def fallback(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def choose_body(files: Column, item_access: Column) -> Column:
    """(name, url, size, md5, access, rule, same_as_largest, missing) of the text of the body among a record's files.

    A PDF that is described as the body wins and nothing stands in for it; else the largest text paired with a PDF. ``missing`` says why there is none,
    or that access is restricted. Equal sizes: the first PDF."""
    pdfs = F.filter(files, lambda f: (f["bundle"] == "ORIGINAL") & (f["format"] == PDF))
    texts = F.filter(files, lambda f: f["bundle"] == "TEXT")
    described = F.filter(pdfs, lambda f: F.coalesce(f["description"] == BODY_DESCRIPTION, F.lit(False)))

    def largest(of: Column) -> Column:
        pairs = F.transform(of, lambda p, i: F.struct(F.try_element_at(F.filter(texts, lambda t: t["name"] == F.concat(p["name"], F.lit(".txt"))), F.lit(-1)).alias("t"), (-i).alias("i")))
        found = F.filter(pairs, lambda x: x["t"].isNotNull())
        return F.array_max(F.transform(found, lambda x: F.struct(x["t"]["size"].alias("size"), x["i"].alias("i"), x["t"].alias("t"))))["t"]

    rule = F.when(F.size(described) > 0, "description").otherwise("largest text")
    text = F.when(F.size(described) > 0, largest(described)).otherwise(largest(pdfs))
    access = fallback(text["access"], item_access)
    reason = (
        F.when(text.isNull() & (F.size(pdfs) == 0), "no pdf").when(text.isNull(), "no text").when(access.isNotNull() & (access != OPEN_ACCESS), "restricted")
    )
    return F.struct(
        text["name"].alias("name"), text["url"].alias("url"), text["size"].alias("size"), text["md5"].alias("md5"),
        F.when(text.isNotNull(), access).alias("access"), F.when(text.isNotNull(), rule).alias("rule"),
        (text["name"] == largest(pdfs)["name"]).alias("same_as_largest"), reason.alias("missing"),
    )


def text_with_fallback(ids: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, text, source): the first source's text, else the second's; documents without any are gone."""
    both = ids.select("doc_id").join(first.select("doc_id", F.col("text").alias("t1")), "doc_id", "left").join(second.select("doc_id", F.col("text").alias("t2")), "doc_id", "left")
    source = F.when(F.nullif(F.col("t1"), F.lit("")).isNotNull(), "first").otherwise("second")
    return both.select("doc_id", fallback(F.col("t1"), F.col("t2")).alias("text"), source.alias("source")).where("text IS NOT NULL")


def changes(old: DataFrame, new: DataFrame, key: str, *content: str) -> DataFrame:
    """(key, change): added, changed or withdrawn between two snapshots; equal rows are not listed."""
    mark = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*content)).cast("binary"), 256).alias(n))
    both = mark(old, "h1").join(mark(new, "h2"), key, "full")
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "withdrawn").when(F.col("h1") != F.col("h2"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def visible(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Results (doc_id, version, ...) whose document is public now, in its current version and open."""
    now = catalog.where("is_public AND NOT locked").select("doc_id", "version")
    return results.join(now, ["doc_id", "version"], "left_semi")


def running_headers(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, line): lines of 8 to 150 characters that stand within two lines of a page number at least ``least`` times.

    Windows are by document and line number inside a document's own rows."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    order = Window.partitionBy("doc_id").orderBy("n")
    is_number = lambda c: F.coalesce(F.trim(c).rlike(r"^\d{1,4}$"), F.lit(False))
    near = F.lit(False)
    for step in (1, 2):
        near = near | is_number(F.lag("line", step).over(order)) | is_number(F.lead("line", step).over(order))
    marked = lines.withColumn("near", near).withColumn("line", F.trim("line"))
    able = marked.where(F.col("near") & F.length("line").between(8, 150) & ~is_number(F.col("line")))
    return able.groupBy("doc_id", "line").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def line_places(docs: DataFrame) -> DataFrame:
    """(doc_id, n, line, position, beside_number): every line with its character position in the text and whether the nearest line before or after it that is
    not empty is a page number. Windows are over a document's own lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    order = Window.partitionBy("doc_id").orderBy("n")
    upto = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    full = F.when(F.trim("line") != "", F.trim("line"))
    before = F.last(full, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(full, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    number = lambda c: F.coalesce(c.rlike(r"^\d{1,4}$"), F.lit(False))
    return lines.select("doc_id", "n", "line", upto.alias("position"), (number(before) | number(after)).alias("beside_number"))


def language_vote(docs: DataFrame, lexicon: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, lang, share): the language whose frequent words cover most of a text's tokens; null below ``least``. Ties by name.

    The lexicon (word, lang) is small by nature and counted before it is broadcast."""
    from quern.operators.search import maybe_broadcast

    found = docs.select("doc_id", T.tokens(F.col("text")).alias("toks")).select("doc_id", F.size("toks").alias("n"), "toks")
    words = found.select("doc_id", "n", F.explode("toks").alias("word"))
    counts = words.groupBy("doc_id", "n", "word").agg(F.count("*").alias("c")).join(maybe_broadcast(lexicon), "word", "left")
    shares = counts.where("lang IS NOT NULL").groupBy("doc_id", "lang").agg((F.sum("c") / F.first("n")).alias("share"))
    best = shares.groupBy("doc_id").agg(F.max_by(F.struct("lang", "share"), F.struct("share", F.negative(F.ascii("lang")), "lang")).alias("b"))
    out = docs.select("doc_id").join(best, "doc_id", "left")
    ok = F.col("b.share") >= least
    return out.select("doc_id", F.when(ok, F.col("b.lang")).alias("lang"), F.round(F.coalesce("b.share", F.lit(0.0)), 6).alias("share"))


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, dim, mean): the mean vector of each group, a row a dimension; partial sums in each task."""
    return vectors.select(by, F.posexplode("embedding").alias("dim", "x")).groupBy(by, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def neighbours(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest other vectors of a stated set of vectors (vec_id, embedding): (vec_id, other, score, rank)."""
    from quern.operators.search import dense, top

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    scored = dense(asked, vectors.select("vec_id", F.col("embedding").alias("vec")), k=k + 1).where("query_id <> vec_id")
    ranked = top(scored, k, ("vec_id",))
    return ranked.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("other"), "score", "rank")


#: Parts of the range of values that a rank is looked for in.
PARTS = 1024


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median, upper_median): the mean of the middle two values, and the upper one of them; null values are left out.

    A histogram over each group's range says which of its ``PARTS`` parts hold the two ranks; only the distinct values of those parts are counted and put in order."""
    rows = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    part = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (PARTS - 1))).otherwise(0).cast("int")
    placed = rows.join(ends, by).withColumn("_part", part)
    sizes = placed.groupBy(by, "_part").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    running = Window.partitionBy(by).orderBy("_part")
    upto = sizes.withColumn("_to", F.sum("_c").over(running))
    first, second = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda k: (F.col("_to") > k) & (F.col("_to") - F.col("_c") <= k)
    wanted = upto.where(holds(first) | holds(second)).select(by, "_part", (F.col("_to") - F.col("_c")).alias("_before"))
    values = placed.join(wanted, [by, "_part"]).groupBy(by, "_part", "_before", "_n", "_v").agg(F.count("*").alias("_c"))
    inside = F.sum("_c").over(Window.partitionBy(by, "_part").orderBy("_v"))
    values = values.withColumn("_to", F.col("_before") + inside)
    out = values.groupBy(by).agg(F.max(F.when(holds(first), F.col("_v"))).alias("_a"), F.max(F.when(holds(second), F.col("_v"))).alias("upper_median"))
    return out.select(by, ((F.col("_a") + F.col("upper_median")) / 2).alias("median"), "upper_median")
