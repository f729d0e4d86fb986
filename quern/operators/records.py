"""Records of a catalog: values by language, files, projections to documents and members, eligibility, names and numbers of ids.

``fields`` is a map from a dotted name to an array of (value, lang), as ``sources.records.fields`` gives it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import catalog as C
from quern.operators import evalset as E

#: The bundles whose files are kept, the least bytes of an open body, and the fields that hold names of people.
KEPT_BUNDLES, LEAST_BODY = ("ORIGINAL", "TEXT"), 20_000
PEOPLE = ("dc.creator", "dc.contributor.advisor", "dc.contributor.referee", "dc.contributor.consultant", "dc.contributor.author")


def values(fields: Column, key: str) -> Column:
    """All (value, lang) of a key; none where it is missing."""
    return F.coalesce(F.try_element_at(fields, F.lit(key)), F.array().cast("array<struct<value:string,lang:string>>"))


def first_value(fields: Column, key: str) -> Column:
    return F.try_element_at(values(fields, key), F.lit(1))["value"]


def first_lang(fields: Column, key: str) -> Column:
    return T.short_lang(F.try_element_at(values(fields, key), F.lit(1))["lang"])


def in_language(fields: Column, key: str, lang: str) -> Column:
    """The first value in a language, whatever its region."""
    return F.try_element_at(F.filter(values(fields, key), lambda v: T.short_lang(v["lang"]) == lang), F.lit(1))["value"]


def keywords(fields: Column, lang: str, key: str = "dc.subject") -> Column:
    """The keywords of a language: values are lists joined by "|"; blanks are left out."""
    own = F.filter(values(fields, key), lambda v: (T.short_lang(v["lang"]) == lang) & v["value"].isNotNull())
    parts = F.flatten(F.transform(own, lambda v: F.split(v["value"], r"\|")))
    return F.filter(F.transform(parts, T.strip), lambda w: w != "")


def documents(records: DataFrame, fields: str = "fields") -> DataFrame:
    """The columns of a document, each with its chain of fallbacks; other columns of ``records`` stay."""
    f = F.col(fields)
    made = {
        "faculty": C.fallback(first_value(f, "uk.faculty-name.cs"), in_language(f, "dc.description.faculty", "cs"), first_value(f, "dc.description.faculty")),
        "department": C.fallback(in_language(f, "dc.description.department", "cs"), first_value(f, "dc.description.department")),
        "thesis_type": first_value(f, "dc.type"), "year": first_value(f, "dc.date.issued"), "language": T.short_lang(first_value(f, "dc.language.iso")),
        "title": F.coalesce(first_value(f, "dc.title"), F.lit("")), "title_lang": first_lang(f, "dc.title"),
        "title_translated": first_value(f, "dc.title.translated"), "title_translated_lang": first_lang(f, "dc.title.translated"),
        "abstract_cs": C.fallback(first_value(f, "uk.abstract.cs"), in_language(f, "dc.description.abstract", "cs")),
        "abstract_en": C.fallback(first_value(f, "uk.abstract.en"), in_language(f, "dc.description.abstract", "en")),
        "keywords_cs": keywords(f, "cs"), "keywords_en": keywords(f, "en"), "defence_status": first_value(f, "uk.thesis.defenceStatus"),
    }
    return records.select(*[c for c in records.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def members(records: DataFrame, key: str = "doc_id", fields: str = "fields") -> DataFrame:
    """(key, thesis_type, outcome, accepted, title, author): what decides which record of a group stands for it."""
    f = F.col(fields)
    return records.select(
        key, F.nullif(F.lower(F.coalesce(first_value(f, "dc.type"), F.lit(""))), F.lit("")).alias("thesis_type"),
        E.outcome(first_value(f, "uk.thesis.defenceStatus"), first_value(f, "thesis.grade.cs")).alias("outcome"),
        F.coalesce(C.fallback(first_value(f, "dcterms.dateAccepted"), first_value(f, "dc.date.issued")), F.lit("")).alias("accepted"),
        F.coalesce(first_value(f, "dc.title"), F.lit("")).alias("title"),
        E.first_author(C.fallback(first_value(f, "dc.creator"), first_value(f, "dc.contributor.author"))).alias("author"),
    )


def files(bundles: Column) -> Column:
    """The files of kept bundles, with the bundle's name in each, in order: thumbnails and licences are left out."""
    kept = F.filter(bundles, lambda b: b["name"].isin(*KEPT_BUNDLES))
    return F.flatten(F.transform(kept, lambda b: F.transform(b["bitstreams"], lambda x: F.struct(
        b["name"].alias("bundle"), x["name"].alias("name"), x["format"].alias("format"), F.coalesce(x["size"].try_cast("long"), F.lit(0)).alias("size"),
    ))))


def largest_body(of: Column) -> Column:
    """The older rule: the largest text that belongs to a PDF (its name and ".txt"), the first of equals; a text without bytes never counts."""
    names = F.transform(F.filter(of, lambda f: (f["bundle"] == "ORIGINAL") & (f["format"] == C.PDF)), lambda f: F.concat(f["name"], F.lit(".txt")))
    paired = F.filter(of, lambda f: (f["bundle"] == "TEXT") & F.array_contains(names, f["name"]) & (f["size"] > 0))
    best = F.array_max(F.transform(paired, lambda f, i: F.struct(f["size"].alias("size"), (-i).alias("i"), f["name"].alias("name"))))
    return best["name"]


def eligible(status: Column, department: Column, body_bytes: Column, access: Column, least: int = LEAST_BODY) -> Column:
    """Defended or unknown, of a known department, with an open body of enough bytes."""
    return (status.isNull() | (status == "O")) & (F.coalesce(department, F.lit("")) != "") & (F.coalesce(access, F.lit(C.OPEN_ACCESS)) == C.OPEN_ACCESS) & (F.coalesce(body_bytes, F.lit(0)) >= least)


def with_overrides(docs: DataFrame, overrides: DataFrame, key: str, *columns: str) -> DataFrame:
    """``docs`` with the override's value where it has one, and ``provenance``: a map from each overridden column to "override"."""
    side = overrides.select(F.col(key), *[F.col(c).alias(f"_o_{c}") for c in columns])
    rows = docs.join(side, key, "left")
    taken = F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c), F.when(F.col(f"_o_{c}").isNotNull(), "override"))]), lambda _, v: v.isNotNull())
    out = [F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in docs.columns]
    return rows.select(*out, taken.alias("provenance"))


def stem(handle: Column) -> Column:
    """An id as a file name."""
    return F.replace(handle, F.lit("/"), F.lit("_"))


def slug(name: Column) -> Column:
    """Small letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def handle_number(handle: Column) -> Column:
    """The number behind the last slash; 0 if it is none."""
    return F.coalesce(F.substring_index(handle, "/", -1).try_cast("long"), F.lit(0).cast("long"))


def shard(handle: Column) -> Column:
    """The folder of a text: thousands of its number, or "other"."""
    number = F.substring_index(handle, "/", -1)
    return F.when(number.rlike(r"^\d+$"), F.floor(number.try_cast("long") / 1000).cast("string")).otherwise("other")


def private_names(fields: Column) -> Column:
    """Distinct words of more than two letters in the fields of people."""
    every = F.concat(*[F.transform(values(fields, k), lambda v: v["value"]) for k in PEOPLE])
    words = F.flatten(F.transform(F.filter(every, lambda v: v.isNotNull()), T.tokens))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)))


def draw_departments(rows: DataFrame, departments: int, per_department: int, faculties: int, seed: str = "0", ids: str = "doc_id") -> DataFrame:
    """(faculty, department, ids): whole departments with enough rows in a fixed random order, at most an even share of them of each faculty, and of each
    ``per_department`` rows in a fixed random order. The order of departments is over one row each."""
    able = rows.groupBy("faculty", "department").agg(F.count("*").alias("n")).where(F.col("n") >= per_department)
    key = E.shuffled("faculty", "department", seed=seed)
    per = Window.partitionBy("faculty").orderBy(key, "department")
    cap = -(-departments // faculties)
    chosen = able.withColumn("_k", key).withColumn("_n", F.row_number().over(per)).where(F.col("_n") <= cap).orderBy("_k", "faculty", "department").limit(departments)
    inside = Window.partitionBy("faculty", "department").orderBy(E.shuffled(ids, seed=seed), ids)
    picked = rows.join(F.broadcast(chosen.select("faculty", "department")), ["faculty", "department"]).withColumn("_n", F.row_number().over(inside))
    return picked.where(F.col("_n") <= per_department).select("faculty", "department", ids)


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n, place): counts of each column's values, the most common first, ties by value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = rows.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order))


def set_counts(rows: DataFrame, announced: DataFrame) -> DataFrame:
    """(collection, found, announced, complete): distinct ids of each collection against the number that it announced."""
    found = rows.groupBy("collection").agg(F.countDistinct("id").alias("found"))
    both = announced.join(found, "collection", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.select("collection", "found", "announced", (F.col("found") >= F.col("announced")).alias("complete"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side``: empty if both are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def duration(seconds: Column) -> Column:
    """Hours and minutes."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 3600).cast("string"), F.lit(" h "), F.floor(whole % 3600 / 60).cast("string"), F.lit(" min"))
