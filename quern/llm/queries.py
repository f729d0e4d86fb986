"""The registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import embed_dedup, langid, lexicon, line_dedup, minhash, mixing, mpeg_audio, ordinal_quality, pii, token_store


def tokenizer_path() -> str:
    """The vocabulary that the queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs), base="base", spans="found")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda c, kind: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")
    counts = [of("base", kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"),
        of("found", "secret").alias("n_secret"), F.size("found").cast("long").alias("n_spans"), (F.size("found") > 0).alias("has_pii"),
    )


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpeg_audio.stage_media(table(spark, sf_dir, "documents"))
    found = mpeg_audio.features(media, payload=True)
    feature = F.to_json(
        F.struct(
            "n_frames", "n_samples", "sample_rate", "duration_num", "duration_den", "kbps_min", "kbps_max",
            "table", "checked", "broken", "resyncs", "skipped", "tag", "seek",
        )
    )
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
        "media_sha256", feature.alias("feature"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


MINHASH_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5_number_lower(unnest(s)) AS g FROM sets),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 4 * b.n >= 3 * a.n AND 4 * a.n >= 3 * b.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a AS node, a AS other FROM pairs UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM sets LEFT JOIN roots ON node = doc_id
"""


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return token_store.read_documents(files).withColumnRenamed("key", "doc_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), lines="n_lines", dropped="n_dropped")
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    return rows.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


LINE_SQL = r"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, row_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM cut),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (
  SELECT k.*, coalesce(r.first_doc < k.doc_id, false) AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id, doc_id
"""


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = lexicon.Lexicon.of(docs, tokenizer_path())
    rows = lexicon.round_trip(docs, words)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    rows = langid.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", langid.held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, label, row_number() OVER () AS row_id FROM embeddings),
good AS MATERIALIZED (
  SELECT vec_id, label, row_id, list_transform(e, lambda x: coalesce(x, 0)) AS e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.row_id <> b.row_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
named AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, coalesce(n.component_id, v.vec_id) AS component_id,
  coalesce(n.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN degrees d ON d.a = v.vec_id LEFT JOIN named n ON n.node = v.vec_id
"""


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = ordinal_quality.score(docs, ordinal_quality.train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.col("_grade").alias("grade"), F.col("_tail").alias("tail"), F.col("_keep").alias("kept"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM capped WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, place) AS level FROM levels WHERE level <= ratio),
goals AS (SELECT source, source_size, CASE WHEN level.level IS NULL THEN cap ELSE least(weight * level.level, cap) END AS target FROM capped LEFT JOIN level ON true),
rates AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (least(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken FROM rates
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_mpeg_audio, op3_minhash, op4_token_store, op5_line_dedup, op6_bpe_lexicon, op7_langid, op8_pivot_index, op9_ordinal_quality, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash": MINHASH_SQL, "op5_line_dedup": LINE_SQL, "op8_pivot_index": VECTOR_SQL, "op10_mixing": MIX_SQL}
