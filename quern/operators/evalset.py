"""Building of evaluation sets: pools, judgments, groups of the same work, samples, exact terms. Orders come from ``md5`` of a seed and the id,
so that a sample is the same in every run and engine."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quern.functions import text as T

#: Terms of one block.
MOST_TERMS = 20_000
WORDS = re.compile(r"\w+")


def shuffled(*parts: Column | str, seed: str = "0") -> Column:
    """A sort key that puts rows in a fixed random order."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts]).cast("binary"))


def uniform(*parts: Column | str, seed: str = "0") -> Column:
    """A fixed random number above 0 and below 1."""
    return (F.conv(F.substring(shuffled(*parts, seed=seed), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def remapped_run(run: DataFrame, groups: DataFrame, corpus: DataFrame, depth: int) -> DataFrame:
    """A run in which members of a group stand for their representative and documents outside the corpus are gone, cut after that."""
    mapped = run.join(groups, run["doc_id"] == groups["member"], "left").select("query_id", F.coalesce("representative", "doc_id").alias("doc_id"), "rank")
    inside = mapped.join(corpus.select("doc_id"), "doc_id", "left_semi").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def pool(runs: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(topic, doc_id): what any run has in the first ``depth`` for any language of a topic."""
    return runs.where(F.col("rank") <= depth).join(queries.select("query_id", F.col("grp").alias("topic")), "query_id").select("topic", "doc_id").distinct()


def replaced(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows of other keys and the new rows: only the partitions that the new rows name are rewritten."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def missing(pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Pairs without a judgment; a judge refuses to store while there are any."""
    return pairs.join(judgments.select("topic", "doc_id"), ["topic", "doc_id"], "left_anti")


def reused_grades(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Asked (topic, doc_id, prompt, temperature) with the cached grade of the same prompt and temperature, else null."""
    key = cache.select("topic", "doc_id", F.sha1(F.col("prompt").cast("binary")).alias("prompt_hash"), "temperature", "grade")
    return asked.withColumn("prompt_hash", F.sha1(F.col("prompt").cast("binary"))).join(key, ["topic", "doc_id", "prompt_hash", "temperature"], "left").drop("prompt_hash")


def languages(topics: DataFrame) -> DataFrame:
    """Topics (id, part, cs, en, narrative) as a query for each language."""
    both = F.array(F.struct(F.lit("cs").alias("lang"), F.col("cs").alias("text")), F.struct(F.lit("en").alias("lang"), F.col("en").alias("text")))
    rows = topics.select("id", "part", "narrative", F.inline(both))
    return rows.select(F.concat_ws("-", "id", "lang").alias("query_id"), F.col("id").alias("grp"), "lang", "part", "text", "narrative")


def outcome(status: Column, grade: Column) -> Column:
    """Outcome of a defence: a status that is there holds; else by the grade N not passed, U recognised, O any other; null without both."""
    failed = grade.startswith("Neprospěl") | grade.startswith("Nedostatečně")
    by_grade = F.when(failed, "N").when(grade == "Uznáno", "U").when(grade != "", "O")
    return F.coalesce(F.nullif(status, F.lit("")), by_grade)


def first_author(author: Column) -> Column:
    """An author's name without white space and commas at its end; old records end with a comma."""
    return F.regexp_replace(T.strip(F.coalesce(author, F.lit(""))), r"(?U)[,\s]+$", "")


def _group_keys(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The equality keys of titles and authors, joined; null if one is blank."""
    for batch in batches:
        for piece in T.pieces(*batch):
            keys = [(T._key(t or ""), T._key(a or "")) for t, a in piece]
            yield pa.array(["|".join(k) if all(k) else None for k in keys], pa.string())


def same_title_groups(records: DataFrame, title: str = "title", author: str = "author") -> DataFrame:
    """(grp, doc_id, ...) of records that share title and author by their equality keys; groups of one and blank keys are left out.

    Sizes are counted by key with partial sums and joined back, so a frequent key is not gathered in one task."""
    # Not deterministic to Spark only: else a filter on the keys makes them once more, in workers of its own.
    key = F.arrow_udf(_group_keys, StringType()).asNondeterministic()
    keyed = records.withColumn("grp", key(F.col(title), first_author(F.col(author)))).where("grp IS NOT NULL")
    sizes = keyed.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    return keyed.join(sizes, "grp")


def representative(members: DataFrame, group: str = "grp") -> DataFrame:
    """(grp, representative): the best usable member by being a target, a passed defence, not failed, the latest date, the id."""
    rank = F.struct("is_target", F.col("outcome").isin("O", "U").alias("p"), (F.col("outcome") != "N").alias("f"), "accepted", "doc_id")
    return members.where("usable").groupBy(group).agg(F.max_by("doc_id", rank).alias("representative"))


#: Fixed value: the type of a rigorous thesis, which belongs to the master's thesis that it grew from.
RIGOROUS = "rigorózní práce"


def same_work(members: DataFrame, group: str = "grp") -> DataFrame:
    """(grp, same_work, shape): at most one type besides the rigorous kind means one work. A null type is a type of its own.

    ``shape``: recognized if any outcome is U, repeated defence if there is one type, else rigorous thesis."""
    kind = F.coalesce(F.nullif(F.lower("thesis_type"), F.lit("")), F.lit("\0"))
    found = members.groupBy(group).agg(
        F.countDistinct(F.when(kind != RIGOROUS, kind)).alias("others"), F.countDistinct(kind).alias("kinds"), F.max(F.coalesce(F.col("outcome") == "U", F.lit(False))).alias("u")
    )
    shape = F.when(F.col("u"), "recognized").when(F.col("kinds") == 1, "repeated defence").otherwise("rigorous thesis")
    return found.select(group, (F.col("others") <= 1).alias("same_work"), shape.alias("shape"))


def stratified(judged: DataFrame, size: int, grades: tuple[int, ...] = (1, 0, 2), seed: str = "0") -> DataFrame:
    """``size`` judged pairs with an even share of each grade; what a grade lacks is filled up from the others in the order of ``grades``."""
    key = shuffled("topic", "doc_id", seed=seed)
    share = size // len(grades)
    order = Window.partitionBy("grade").orderBy(key)
    numbered = judged.withColumn("n", F.row_number().over(order))
    turn = F.array_position(F.array(*map(F.lit, grades)), F.col("grade"))
    # First the even shares, then the rest of each grade in turn; at most ``size`` rows of a grade can be chosen.
    able = numbered.where(F.col("n") <= size).withColumn("extra", F.col("n") > share).withColumn("turn", turn)
    picked = able.orderBy("extra", F.when(F.col("extra"), F.col("turn")), "turn", "n").limit(size)
    return picked.drop("n", "extra", "turn")


def weighted_draw(units: DataFrame, least: int, target: int, cap: int, seed: str = "0") -> DataFrame:
    """Units (unit, faculty, size) drawn without replacement by weight ``size``: ``least`` of each faculty first, then others until
    the sum of sizes, each at most ``cap``, reaches ``target``. One row a unit: units are departments, not documents."""
    key = -F.log(uniform("unit", seed=seed)) / F.col("size")
    per = Window.partitionBy("faculty").orderBy(key, "unit")
    drawn = units.withColumn("first", F.row_number().over(per) <= least).withColumn("key", -F.log(uniform("unit", seed=seed + "b")) / F.col("size"))
    order = Window.orderBy(F.desc("first"), "key", "unit")
    running = F.sum(F.least("size", F.lit(cap))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = drawn.withColumn("before", running - F.least("size", F.lit(cap)))
    return drawn.where(F.col("first") | (F.col("before") < target)).select("unit", "faculty", "size", "first")


def capped(rows: DataFrame, by: str, cap: int, total: int, ids: str = "doc_id", seed: str = "0") -> DataFrame:
    """At most ``cap`` rows of each value of ``by`` in a fixed random order, ``total`` in all."""
    key = shuffled(ids, seed=seed)
    order = Window.partitionBy(by).orderBy(key, ids)
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).orderBy(key, ids).limit(total).drop("n")


def quota(rows: DataFrame, quotas: dict[str, int], lang: str = "lang", by: str = "faculty", cap: int = 3, ids: str = "doc_id", seed: str = "0") -> DataFrame:
    """Up to a quota of each language, in which no value of ``by`` has more than ``cap``: caps first, then quotas in the fixed random order."""
    key = shuffled(ids, seed=seed)
    inner, outer = Window.partitionBy(lang, by).orderBy(key, ids), Window.partitionBy(lang).orderBy(key, ids)
    least = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    able = rows.withColumn("n", F.row_number().over(inner)).where(F.col("n") <= cap)
    return able.withColumn("m", F.row_number().over(outer)).where(F.col("m") <= F.try_element_at(least, F.col(lang))).drop("n", "m")


def plan_order(rows: DataFrame, first: DataFrame, seed: str = "0") -> DataFrame:
    """Rows with ``pos``: a priority list (doc_id, priority) first, then all others in a fixed random order, so that any prefix is a sample.

    The random key is a hash, so its first digits deal the others evenly over 4,096 buckets; a bucket is numbered for itself and shifted by the sizes of
    those before it (at most 4,096 counts). Only the priority list is ordered in one task."""
    joined = rows.join(first, "doc_id", "left").withColumn("_key", shuffled("doc_id", seed=seed))
    head, rest = joined.where("priority IS NOT NULL"), joined.where("priority IS NULL").withColumn("_bucket", F.substring("_key", 1, 3))
    head = head.withColumn("pos", F.row_number().over(Window.orderBy("priority", "_key", "doc_id")).cast("long"))
    sizes = rest.groupBy("_bucket").agg(F.count("*").alias("n")).unionByName(head.select(F.lit("").alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_bucket", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "doc_id"))
    rest = rest.withColumn("_n", own).join(F.broadcast(shifts), "_bucket").withColumn("pos", F.col("_before") + F.col("_n"))
    return head.drop("priority", "_key").unionByName(rest.select(*rows.columns, "pos"))


def _holding(shared):
    """An Arrow UDF: the terms of a broadcast block that a text holds."""

    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in T.pieces(batch):
                out = []
                for (text,) in piece:
                    plain = T._typed(text or "")
                    tokens = set(WORDS.findall(plain))
                    keys = tokens & shared.value.keys()
                    # A term that is one token is in the text if the token is.
                    out.append([term for k in keys for term, typed, words in shared.value[k] if typed == k or (words <= tokens and typed in plain)])
                yield pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(held, ArrayType(StringType()))


def term_holders(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, doc_id): documents that hold a term: all its words among their tokens, and the term itself in the squeezed text.

    Terms are a stated set: they are shipped in blocks of at most ``MOST_TERMS``, and each document's text is read once for a block, in one Arrow pass. A text looks up
    its own tokens among the terms' longest words, so it is not compared with every term."""
    spark = terms.sparkSession
    asked = terms.select("term").where("term IS NOT NULL").distinct()
    blocks = max(1, -(-asked.count() // MOST_TERMS))
    asked, found = asked.withColumn("_block", F.pmod(F.xxhash64("term"), F.lit(blocks))), None
    for block in range(blocks):
        by_key: dict[str, list[tuple]] = {}
        for (term,) in asked.where(F.col("_block") == block).select("term").collect():
            plain = T._typed(term)
            if words := WORDS.findall(plain):
                by_key.setdefault(max(words, key=len), []).append((term, plain, frozenset(words)))
        held = _holding(spark.sparkContext.broadcast(by_key))
        rows = docs.select("doc_id", F.explode(held("text")).alias("term")).select("term", "doc_id").distinct()
        found = rows if found is None else found.unionByName(rows)
    return found


def choose_terms(candidates: DataFrame, holders: DataFrame, most: int) -> DataFrame:
    """Every candidate (topic, term, pos, title) with the first reason that speaks against it, and the first without one chosen."""
    counts = holders.groupBy("term").agg(F.count("*").alias("holders"))
    rows = candidates.join(counts, "term", "left").fillna(0, ["holders"])
    reason = (
        F.when(F.contains(T.typed(F.col("title")), T.typed(F.col("term"))), "in title")
        .when(F.col("holders") > most, F.concat(F.lit("in "), F.col("holders") - 1, F.lit(" other documents")))
        .when(F.col("holders") == 0, "not found")
    )
    rows = rows.withColumn("reason", reason)
    order = Window.partitionBy("topic").orderBy(F.col("reason").isNotNull(), "pos")
    first = (F.row_number().over(order) == 1) & F.col("reason").isNull()
    return rows.withColumn("chosen", first).withColumn("reason", F.coalesce("reason", F.when(F.col("chosen"), "chosen").otherwise("another term chosen")))
