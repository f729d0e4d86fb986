"""The same results in DuckDB SQL, written independently of the plans. ``WITH`` parts are shared by name."""

from __future__ import annotations

import re

PARTS = {
    "q": """SELECT item_id AS query_id, text, item_id // 2 AS grp, CASE WHEN item_id % 2 = 0 THEN 'cs' ELSE 'en' END AS lang,
  CASE WHEN item_id % 3 = 0 THEN 'en' ELSE 'cs' END AS target_lang, (['title','about','passage','exact','topic'])[((item_id // 2) % 5 + 1)::INT] AS type FROM benchmark""",
    "qrels": """SELECT b.item_id AS query_id, l.doc_id, l.quality + (1 - l.toxic) * l.quality AS grade FROM benchmark b JOIN labels l ON l.doc_id % 13 = b.item_id % 13""",
    "sents": r"""SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '') AS ss FROM documents""",
    "folded": """SELECT doc_id, list_reduce(list_transform(ss, lambda s: {'done': []::VARCHAR[], 'cur': s}), lambda a, x: {
  'done': (CASE WHEN length(a.cur) + length(x.cur) + 1 > 1000 AND a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END)
    || list_transform(range((length(x.cur) - 1) // 1000), lambda i: substr(x.cur, (i * 1000 + 1)::BIGINT, 1000)),
  'cur': trim((CASE WHEN length(a.cur) + length(x.cur) + 1 > 1000 AND a.cur <> '' THEN '' ELSE a.cur END)
    || ' ' || substr(x.cur, ((length(x.cur) - 1) // 1000) * 1000 + 1, 1000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))},
  {'done': []::VARCHAR[], 'cur': ''}) AS f FROM sents WHERE len(ss) > 0""",
    "chunk_lists": "SELECT doc_id, CASE WHEN f.cur <> '' THEN list_append(f.done, f.cur) ELSE f.done END AS cs FROM folded",
    "chunks": "SELECT doc_id, unnest(range(len(cs)))::INT AS ord, unnest(cs) AS text FROM chunk_lists",
    "chunk_toks": r"SELECT doc_id, ord, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM chunks",
    "stats": "SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM chunk_toks",
    "terms": "SELECT doc_id, ord, len, term, count(*) AS tf FROM (SELECT doc_id, ord, len(toks) AS len, unnest(toks) AS term FROM chunk_toks) GROUP BY ALL",
    "raw_idf": "SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM terms GROUP BY term) CROSS JOIN stats",
    "idf": "SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf",
    "q_terms": r"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM q) GROUP BY ALL",
    "bm25": """SELECT query_id, doc_id, ord, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM terms JOIN q_terms USING (term) JOIN idf USING (term) CROSS JOIN stats GROUP BY ALL""",
    "lex": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord)::INT AS rank FROM bm25 WHERE score > 0) WHERE rank <= 200""",
    "lex_docs": """SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r)::INT AS rank FROM
  (SELECT query_id, doc_id, max(score) AS score, min(rank) AS r FROM lex GROUP BY ALL)) WHERE rank <= 100""",
    "hv_c": r"""SELECT doc_id, ord, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS dim, sum(tf) AS c FROM terms GROUP BY ALL""",
    "hv": "SELECT doc_id, ord, dim, c / norm AS w FROM hv_c JOIN (SELECT doc_id, ord, sqrt(sum(c * c)) AS norm FROM hv_c GROUP BY ALL) USING (doc_id, ord)",
    "hq_c": "SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS dim, sum(qtf) AS c FROM q_terms GROUP BY ALL",
    "hq": "SELECT query_id, dim, c / norm AS qw FROM hq_c JOIN (SELECT query_id, sqrt(sum(c * c)) AS norm FROM hq_c GROUP BY ALL) USING (query_id)",
    "sem_all": "SELECT query_id, doc_id, ord, round(sum(qw * w), 6) AS score FROM hq JOIN hv USING (dim) GROUP BY ALL",
    "sem": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord)::INT AS rank FROM sem_all) WHERE rank <= 200",
    "rrf": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord)::INT AS rank FROM (SELECT query_id, doc_id, ord, round(sum(p), 9) AS score FROM
  (SELECT query_id, doc_id, ord, 1.0::DOUBLE / (60 + rank) AS p FROM lex UNION ALL SELECT query_id, doc_id, ord, 1.0::DOUBLE / (60 + rank) FROM sem) GROUP BY ALL)""",
    "wrrf": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord)::INT AS rank FROM (SELECT query_id, doc_id, ord, round(sum(p), 9) AS score FROM
  (SELECT query_id, doc_id, ord, 0.4::DOUBLE / (60 + rank) AS p FROM lex UNION ALL SELECT query_id, doc_id, ord, 1.0::DOUBLE / (60 + rank) FROM sem) GROUP BY ALL)""",
    "wsum": """SELECT query_id, doc_id, ord, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, ord, score AS s FROM sem_all UNION ALL
  SELECT query_id, doc_id, ord, score * 0.03::DOUBLE FROM bm25) GROUP BY ALL""",
    "overlap": r"""SELECT l.query_id, l.doc_id, l.ord, l.rank, l.score, round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\p{L}\p{N}_]+')), list_distinct(t.toks)))
  / greatest(len(list_distinct(regexp_extract_all(lower(q.text), '[\p{L}\p{N}_]+'))), 1), 6) AS s2 FROM lex l JOIN q USING (query_id) JOIN chunk_toks t ON t.doc_id = l.doc_id AND t.ord = l.ord""",
    "values_": """SELECT q.query_id, coalesce(CASE WHEN f.first <= 10 THEN 1.0 / f.first END, 0.0) AS mrr_10, CASE WHEN f.first <= 1 THEN 1.0 ELSE 0.0 END AS success_1,
  CASE WHEN f.first <= 10 THEN 1.0 ELSE 0.0 END AS success_10, CASE WHEN f.first <= 100 THEN 1.0 ELSE 0.0 END AS success_100,
  CASE WHEN i.idcg > 0 THEN coalesce(f.dcg, 0) / i.idcg ELSE 0.0 END AS ndcg_10, coalesce(f.hits_10, 0) / 10.0 AS p_10,
  CASE WHEN i.relevant > 0 THEN coalesce(f.hits_100, 0) / i.relevant END AS recall_100, coalesce(f.judged, 0.0) AS judged_10
  FROM q LEFT JOIN (SELECT r.query_id, min(rank) FILTER (grade >= 1) AS first, sum(coalesce(grade, 0) / log2(rank + 1)) FILTER (rank <= 10) AS dcg,
    count(*) FILTER (grade >= 1 AND rank <= 10) AS hits_10, count(*) FILTER (grade >= 1 AND rank <= 100) AS hits_100,
    avg(CASE WHEN grade IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (rank <= 10) AS judged
    FROM lex_docs r LEFT JOIN qrels j ON r.query_id = j.query_id AND r.doc_id = j.doc_id GROUP BY 1) f ON f.query_id = q.query_id
  LEFT JOIN (SELECT query_id, sum(grade / log2(place + 1)) FILTER (place <= 10) AS idcg, count(*) FILTER (grade >= 1) AS relevant FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM qrels) GROUP BY 1) i ON i.query_id = q.query_id""",
    "rbo_values": """WITH a AS (SELECT q.grp, r.doc_id, r.rank FROM lex_docs r JOIN q USING (query_id) WHERE query_id % 2 = 0 AND rank <= 10), b AS (SELECT q.grp, r.doc_id, r.rank FROM lex_docs r JOIN q USING (query_id) WHERE query_id % 2 = 1 AND rank <= 10),
  k AS (SELECT grp, least(ka, kb) AS k FROM (SELECT grp, max(rank) AS ka FROM a GROUP BY 1) JOIN (SELECT grp, max(rank) AS kb FROM b GROUP BY 1) USING (grp)),
  d AS (SELECT grp, k, unnest(range(1, k + 1)) AS d FROM k),
  o AS (SELECT d.grp, d.k, d.d, count(a.doc_id) AS x FROM d LEFT JOIN (SELECT a.grp, a.doc_id, greatest(a.rank, b.rank) AS at FROM a JOIN b ON a.grp = b.grp AND a.doc_id = b.doc_id) a ON a.grp = d.grp AND a.at <= d.d GROUP BY ALL)
  SELECT grp, round(max(CASE WHEN d = k THEN x / k * pow(0.9, k) END) + 0.1 / 0.9 * sum(x / d * pow(0.9, d)), 6) AS rbo FROM o GROUP BY grp""",
    "known": """SELECT v.*, q.type, CASE WHEN q.lang = q.target_lang THEN 'same_language' ELSE 'cross_lingual' END AS crossing, q.lang || '->' || q.target_lang AS pair
  FROM values_ v JOIN q USING (query_id) WHERE q.type <> 'topic'""",
    "pairs_ab": "SELECT query_id, mrr_10 AS a, success_10 AS b FROM values_",
    "meta_rows": """SELECT doc_id, lang, source || ' ' || doc_id AS t1, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || n_chars END AS t2 FROM documents""",
    "meta_chunks": """SELECT * FROM (SELECT doc_id, -1 AS ord, concat_ws(chr(10), CASE WHEN lang <> 'en' THEN t1 END, CASE WHEN lang = 'en' THEN t2 END, CASE WHEN doc_id % 3 = 0 THEN 'k1, k2' END) AS text FROM meta_rows
  UNION ALL SELECT doc_id, -2, concat_ws(chr(10), CASE WHEN lang = 'en' THEN t1 END, CASE WHEN lang <> 'en' THEN t2 END, CASE WHEN doc_id % 5 = 0 THEN 'an abstract' END) FROM meta_rows) WHERE text <> ''""",
    "member_rows": """SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN (['diplomová práce', 'rigorózní práce', 'bakalářská práce'])[(doc_id // 7) % 3 + 1] END AS thesis_type,
  CASE WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'U' ELSE 'N' END WHEN doc_id % 7 <> 3 THEN (['O', 'N', 'U', 'O', 'N'])[doc_id % 5 + 1] END AS outcome, (2000 + doc_id % 20)::VARCHAR AS accepted, 'Práce č. ' || doc_id // 21 AS title, 'Novák, Jan ' || doc_id % 2 AS author FROM documents""",
    "judged": "SELECT doc_id, quality + (1 - toxic) * quality AS a, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE quality * 2 - toxic END AS b FROM labels",
    "sample_key": "SELECT doc_id, source, lang, n_chars, md5('0:' || doc_id::VARCHAR) AS k FROM documents",
    "vec": "SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings",
    "vq": "SELECT vec_id AS query_id, e AS qe, label AS ql FROM vec WHERE vec_id % 100 = 0",
    "vs": "SELECT query_id, vec_id, ql, label, round(list_inner_product(qe, e), 6) AS score FROM vq CROSS JOIN vec",
    "knn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM vs WHERE query_id <> vec_id) WHERE rank <= 10",
}


def sql(body: str) -> str:
    """A query with the parts that it names, and those that they name, before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit_part(name)

    def visit_part(name: str) -> None:
        for other in PARTS:
            if other != name and other not in need and re.search(rf"(?:FROM|JOIN)\s+{other}\b", PARTS[name]):
                visit_part(other)
        if name not in need:
            need.append(name)

    for name in PARTS:
        if re.search(rf"(?:FROM|JOIN)\s+{name}\b", body) and name not in need:
            visit_part(name)
    return (f"WITH {', '.join(f'{n} AS MATERIALIZED ({PARTS[n]})' for n in need)} " if need else "") + body


_RANKED = "SELECT query_id, doc_id, ord, score, rank FROM {} WHERE rank <= 20"

ORACLES = {
    "chunk_documents": "SELECT doc_id, ord, text FROM chunks",
    "token_stats": "SELECT (SELECT n FROM stats) AS n_chunks, round((SELECT avg_len FROM stats), 6) AS avg_len, (SELECT count(*) FROM idf) AS n_terms, (SELECT sum(tf) FROM terms) AS n_tokens",
    "bm25_idf": "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": _RANKED.format("lex"),
    "bm25_best_chunk_docs": "SELECT query_id, doc_id, score, rank FROM lex_docs WHERE rank <= 10",
    "bm25_top3_sum_docs": """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f)::INT AS rank FROM (
  SELECT query_id, doc_id, round(sum(score), 6) AS score, min(rank) AS f FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS n FROM lex) WHERE n <= 3 GROUP BY ALL)) WHERE rank <= 10""",
    "mean_of_top3_docs": """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
  SELECT query_id, doc_id, round(avg(score), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS n FROM lex) WHERE n <= 3 GROUP BY ALL)) WHERE rank <= 10""",
    "hash_dense_topk": _RANKED.format("sem"),
    "rrf_hybrid": _RANKED.format("rrf"),
    "rrf_weighted": _RANKED.format("wrrf"),
    "weighted_sum_fusion": "SELECT query_id, doc_id, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord)::INT AS rank FROM wsum) WHERE rank <= 20",
    "normalised_sum_fusion": """SELECT query_id, doc_id, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord)::INT AS rank FROM (
  SELECT query_id, doc_id, ord, round(sum(s), 6) AS score FROM (
    SELECT query_id, doc_id, ord, round(CASE WHEN h > l THEN (score - l) / (h - l) ELSE 0.0 END, 6) AS s FROM (SELECT *, max(score) OVER w AS h, min(score) OVER w AS l FROM sem WINDOW w AS (PARTITION BY query_id))
    UNION ALL SELECT query_id, doc_id, ord, round(CASE WHEN h > l THEN (score - l) / (h - l) ELSE 0.0 END, 6) FROM (SELECT *, max(score) OVER w AS h, min(score) OVER w AS l FROM lex WINDOW w AS (PARTITION BY query_id)))
  GROUP BY ALL)) WHERE rank <= 20""",
    "rerank_head_tail": """SELECT query_id, doc_id, ord, CASE WHEN rank > 20 THEN score ELSE s2 END AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY (rank > 20), CASE WHEN rank <= 20 THEN s2 END DESC NULLS LAST, rank)::INT AS rank FROM overlap""",
    "rescore_union_candidates": """SELECT query_id, doc_id, ord, round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}\\p{N}_]+')), list_distinct(t.toks))) / greatest(len(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}\\p{N}_]+'))), 1), 6) AS score
  FROM (SELECT DISTINCT query_id, doc_id, ord FROM (SELECT query_id, doc_id, ord FROM lex WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, ord FROM sem WHERE rank <= 20)) JOIN q USING (query_id) JOIN chunk_toks t USING (doc_id, ord)""",
    "passage_selection": "SELECT query_id, doc_id, ord, score, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank)::INT AS place FROM lex) WHERE place <= 2",
    "blind_branch_fusion": """SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT query_id, doc_id, round(s / (1.0 + CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 9) AS score FROM (
  SELECT query_id, doc_id, round(sum(p), 9) AS s FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM lex_docs UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM lex_docs WHERE doc_id % 2 = 0) GROUP BY ALL))""",
    "query_router": """SELECT query_id, doc_id, ord, score, rank FROM lex JOIN q USING (query_id) WHERE lang = 'cs' AND rank <= 10 UNION ALL
  SELECT query_id, doc_id, ord, score, rank FROM sem JOIN q USING (query_id) WHERE lang <> 'cs' AND rank <= 10""",
    "trec_run_lines": "SELECT format('{} Q0 {} {} {:.6f} bm25', query_id, doc_id, rank, score) AS line FROM lex_docs",
    "metric_values": "SELECT query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("mrr_10", "success_1", "success_10", "success_100", "ndcg_10", "p_10", "recall_100", "judged_10")) + " FROM values_",
    "metric_breakdowns": """SELECT CASE g WHEN 7 THEN 'all' WHEN 3 THEN 'crossing' WHEN 5 THEN 'type' ELSE 'pair' END AS part, coalesce(crossing, type, pair, 'all') AS name, queries, mrr_10, success_1, success_10, success_100
  FROM (SELECT crossing, type, pair, grouping(crossing, type, pair) AS g, count(*) AS queries, round(avg(mrr_10), 4) AS mrr_10, round(avg(success_1), 4) AS success_1, round(avg(success_10), 4) AS success_10, round(avg(success_100), 4) AS success_100
  FROM known GROUP BY GROUPING SETS ((), (crossing), (type), (pair)))""",
    "rbo_pairs": "SELECT grp AS key, rbo FROM rbo_values",
    "paired_sign_test": """SELECT higher, lower, round(least(1.0, 2 * (SELECT coalesce(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 1.0) FROM (SELECT unnest(range(0, least(higher, lower) + 1)) AS i))), 6) AS p
  FROM (SELECT count(*) FILTER (a < b) AS higher, count(*) FILTER (a > b) AS lower, count(*) FILTER (a <> b) AS n FROM pairs_ab)""",
    "randomization_pvalue": """WITH d AS (SELECT query_id, a - b AS d FROM pairs_ab), s AS (SELECT p, abs(sum(CASE WHEN substr(md5('0:' || p || ':' || query_id), 1, 1) < '8' THEN d ELSE -d END)) AS s FROM d CROSS JOIN (SELECT unnest(range(10000)) AS p) GROUP BY p)
  SELECT (SELECT count(*) FROM d) AS n, round((SELECT abs(sum(d)) / count(*) FROM d), 6) AS observed, round(((SELECT count(*) FROM s WHERE s >= (SELECT abs(sum(d)) FROM d) - 1e-9) + 1) / 10001.0, 6) AS p""",
    "kappa_weighted": """WITH c AS (SELECT a, b, count(*) AS w FROM judged GROUP BY ALL), r AS (SELECT a, sum(w) AS wa FROM c GROUP BY 1), s AS (SELECT b, sum(w) AS wb FROM c GROUP BY 1)
  SELECT round(1 - (SELECT sum(pow((a - b) / 2.0, 2) * w) FROM c) * (SELECT sum(w) FROM c) / (SELECT sum(pow((a - b) / 2.0, 2) * wa * wb) FROM r CROSS JOIN s), 6) AS kappa""",
    "confusion_matrix": "SELECT a AS human, count(*) FILTER (b = 0) AS g0, count(*) FILTER (b = 1) AS g1, count(*) FILTER (b = 2) AS g2 FROM judged GROUP BY a",
    "grade_shift": "SELECT count(*) FILTER (b > a) AS higher, count(*) FILTER (b < a) AS lower FROM judged",
    "pool_reweight": "SELECT s.grade, round(coalesce(p.n, 0) / s.n, 6) AS weight FROM (SELECT a AS grade, count(*) AS n FROM judged WHERE doc_id % 10 = 0 GROUP BY 1) s LEFT JOIN (SELECT a AS grade, count(*) AS n FROM judged GROUP BY 1) p USING (grade)",
    "pool_union": "SELECT DISTINCT grp AS topic, doc_id FROM (SELECT query_id, doc_id FROM lex_docs WHERE rank <= 10 UNION ALL SELECT query_id, doc_id FROM sem WHERE rank <= 10) JOIN q USING (query_id)",
    "replace_partition": "SELECT query_id, doc_id, grade FROM qrels WHERE query_id NOT IN (SELECT query_id FROM qrels WHERE query_id % 4 = 0) UNION ALL SELECT query_id, doc_id, 0 FROM qrels WHERE query_id % 4 = 0",
    "remapped_run": """SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id)::INT AS rank FROM (
  SELECT query_id, d - d % 2 AS doc_id, min(rank) AS r FROM (SELECT query_id, doc_id AS d, rank FROM lex_docs) WHERE (d - d % 2) % 3 <> 0 GROUP BY ALL)) WHERE rank <= 20""",
    "near_duplicate_groups": r"""SELECT md5(key) AS grp, count(*) AS members, min(doc_id) AS first_doc FROM (SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\p{L}\p{N}]+', ' ', 'g')) || '|' || source AS key FROM documents) WHERE key NOT LIKE '|%' GROUP BY key HAVING count(*) > 1""",
    "representative_argmax": "SELECT grp, arg_max(doc_id, (doc_id % 7 = 0, doc_id % 3 <> 0, n_chars, doc_id)) AS representative FROM (SELECT *, source || lang AS grp FROM documents) WHERE doc_id % 11 <> 0 GROUP BY 1",
    "exact_term_holders": r"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark UNION SELECT text FROM benchmark),
  tp AS (SELECT term, trim(regexp_replace(replace(lower(translate(nfc_normalize(term), '‐‑–', '---')), 'ß', 'ss'), '\s+', ' ', 'g')) AS plain FROM t), ts AS (SELECT *, regexp_extract_all(plain, '[\p{L}\p{N}_]+') AS words FROM tp), d AS (SELECT doc_id, trim(regexp_replace(replace(lower(translate(nfc_normalize(text), '‐‑–', '---')), 'ß', 'ss'), '\s+', ' ', 'g')) AS s FROM documents),
  k AS (SELECT doc_id, s, list_distinct(regexp_extract_all(s, '[\p{L}\p{N}_]+')) AS toks FROM d)
  SELECT term, count(*) AS holders FROM (SELECT doc_id, s, toks, unnest(toks) AS first FROM k) JOIN ts ON ts.words[1] = first WHERE list_has_all(toks, words) AND contains(s, plain) GROUP BY 1""",
    "copy_share": r"""SELECT doc_id, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS share FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(i.text), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 3)) AS a,
  list_distinct(list_filter(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 3)) AS b FROM documents d JOIN benchmark i ON i.item_id = d.doc_id)""",
    "stratified_sample": """WITH j AS (SELECT l.doc_id AS doc_id, doc_id % 5 AS topic, quality + (1 - toxic) * quality AS grade FROM labels l), n AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY md5('0:' || topic || ':' || doc_id)) AS n FROM j)
  SELECT topic, doc_id, grade FROM (SELECT *, row_number() OVER (ORDER BY (n > 30), CASE WHEN n > 30 THEN list_position([1, 0, 2], grade) END NULLS FIRST, list_position([1, 0, 2], grade), n) AS place FROM n) WHERE place <= 90""",
    "weighted_draw": """WITH u AS (SELECT source || '-' || lang AS unit, lang AS faculty, count(*) AS size FROM documents GROUP BY ALL),
  r AS (SELECT *, -ln((('0x' || substr(md5('0:' || unit), 1, 8))::BIGINT + 0.5) / 4294967296.0) / size AS k1, -ln((('0x' || substr(md5('0b:' || unit), 1, 8))::BIGINT + 0.5) / 4294967296.0) / size AS k2 FROM u),
  f AS (SELECT *, row_number() OVER (PARTITION BY faculty ORDER BY k1, unit) <= 2 AS first FROM r),
  g AS (SELECT *, sum(least(size, 40)) OVER (ORDER BY first DESC, k2, unit ROWS UNBOUNDED PRECEDING) - least(size, 40) AS before FROM f)
  SELECT unit, faculty, size, first FROM g WHERE first OR before < 400""",
    "capped_draw": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY k, doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS n FROM sample_key) WHERE n <= 5) WHERE place <= 60",
    "quota_targets": """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY k, doc_id) AS n FROM sample_key) WHERE n <= 3)
  WHERE m <= CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 10 ELSE 0 END""",
    "priority_then_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY (CASE WHEN doc_id % 50 = 7 THEN doc_id END) NULLS LAST, k, doc_id) AS pos FROM sample_key",
    "fallback_text_chain": """SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS source FROM documents WHERE text <> '' AND (doc_id % 2 = 0 OR doc_id % 3 = 0)""",
    "topic_language_expand": "SELECT item_id || '-' || lang AS query_id, item_id AS grp, lang, CASE WHEN lang = 'cs' THEN text ELSE lower(text) END AS text FROM benchmark CROSS JOIN (VALUES ('cs'), ('en')) t(lang)",
    "grade_cache_reuse": """SELECT a.topic, a.doc_id, CASE WHEN a.doc_id % 3 = 0 AND a.topic % 2 = 0 THEN a.grade END AS grade FROM (SELECT query_id AS topic, doc_id, grade FROM qrels) a""",
    "running_headers": r"""WITH g AS (SELECT doc_id, source, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)),
  l AS (SELECT doc_id, 3 * i AS n, 'Chapter of ' || source AS line FROM g UNION ALL SELECT doc_id, 3 * i + 1, (i % 500 + 1)::VARCHAR FROM g UNION ALL SELECT doc_id, 3 * i + 2, line FROM g),
  m AS (SELECT doc_id, trim(line) AS line, coalesce(regexp_matches(trim(line), '^\d{1,4}$'), false) AS own, coalesce(regexp_matches(trim(lag(line, 1) OVER w), '^\d{1,4}$'), false) OR coalesce(regexp_matches(trim(lag(line, 2) OVER w), '^\d{1,4}$'), false)
    OR coalesce(regexp_matches(trim(lead(line, 1) OVER w), '^\d{1,4}$'), false) OR coalesce(regexp_matches(trim(lead(line, 2) OVER w), '^\d{1,4}$'), false) AS near FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n))
  SELECT doc_id, line, count(*) AS times FROM m WHERE near AND NOT own AND length(line) BETWEEN 8 AND 150 GROUP BY ALL HAVING count(*) >= 3""",
    "html_unescape_strip": r"""SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT page_id, """
    + "replace(replace(replace(replace(replace(replace(replace(replace(" * 3
    + "html"
    + ", '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·')" * 3
    + " AS h FROM pages)",
    "url_parts": r"SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1",
    "json_props_extract": "SELECT event_type, count(*) AS events, count(DISTINCT props) AS distinct_props, sum((props->>'$.k')::BIGINT) AS sum_k, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "first_wins_dedup": "SELECT grp, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY source, doc_id) AS n FROM (SELECT *, md5(lower(text)) AS grp FROM documents)) WHERE n = 1",
    "last_wins_log": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "snapshot_changes": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'withdrawn' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (0, 1, 2)",
    "visibility_filter": "SELECT query_id, doc_id, rank FROM lex_docs WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 1",
    "knn_graph": "SELECT query_id AS vec_id, vec_id AS other, score, rank FROM knn",
    "dense_topk": "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM vs) WHERE rank <= 5",
    "centroid_vectors": "SELECT label, dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(len(e)))::INT AS dim, unnest(e) AS x FROM vec) GROUP BY ALL",
    "topic_volume_by_day": "SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT time_bucket(INTERVAL 30 minutes, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY ALL",
    "events_sessions": """SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 minutes THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
  (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""",
    "turn_pairs": "SELECT a.conv_id, a.turn, length(a.text) AS asked, length(b.text) AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
    "tpch_q1_like": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "tpch_join_revenue": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "tpch_semi_anti": """SELECT (SELECT count(*) FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)) AS with_large, (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_orders""",
    "tpch_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "tpch_percentile": "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS median FROM customer GROUP BY 1",
    "length_histogram": "SELECT lang, floor(n_chars / 1000)::BIGINT AS kilo, count(*) AS n FROM documents GROUP BY ALL",
    "query_escaping": r"""SELECT item_id, regexp_replace(trim(regexp_replace(replace(text, '%', ''), '\s+', ' ', 'g')), '([+\-!(){}\[\]^"~*?:\\/&|])', '\\\1', 'g') AS text FROM benchmark""",
    "consistency_by_type": "SELECT type, round(avg(rbo), 4) AS rbo, count(*) AS groups FROM (SELECT v.rbo, q.type FROM rbo_values v JOIN q ON q.grp = v.grp AND q.query_id % 2 = 0) GROUP BY ROLLUP (type)",
    "twin_removed_corpus": "SELECT doc_id, source FROM documents WHERE n_chars >= 200 AND doc_id % 7 <> 3",
    "result_snippets": r"SELECT l.query_id, l.doc_id, l.ord, l.rank, substr(trim(regexp_replace(c.text, '\s+', ' ', 'g')), 1, 160) AS snippet FROM lex l JOIN chunks c ON c.doc_id = l.doc_id AND c.ord = l.ord WHERE rank <= 3",
    "language_vote": r"""WITH w(word, lang) AS (VALUES ('the','en'),('and','en'),('of','en'),('le','fr'),('de','fr'),('et','fr'),('der','de'),('und','de'),('die','de'),('el','es'),('los','es'),('y','es')),
  t AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM documents)), s AS (SELECT doc_id, lang, count(*) / max(n) AS share FROM t JOIN w USING (word) GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, ascii(lang), lang DESC) AS r FROM s) SELECT d.doc_id, CASE WHEN b.share >= 0.05 THEN b.lang END AS lang, round(coalesce(b.share, 0.0), 6) AS share FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.r = 1""",
    "body_choice": """WITH f AS (SELECT doc_id, doc_id % 5 <> 0 AS pdfs, doc_id % 5 <> 0 AND doc_id % 3 = 0 AS described, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN doc_id % 11 END AS a FROM documents),
  c AS (SELECT *, CASE WHEN NOT pdfs THEN NULL WHEN described THEN CASE WHEN a IS NOT NULL THEN 'a.txt' END WHEN a >= 6 THEN 'a.txt' ELSE 'b.txt' END AS name FROM f)
  SELECT doc_id, name, CASE name WHEN 'a.txt' THEN a WHEN 'b.txt' THEN 6 END AS size, CASE WHEN name IS NOT NULL THEN CASE WHEN described THEN 'description' ELSE 'largest text' END END AS rule,
  CASE WHEN NOT pdfs THEN 'no pdf' WHEN name IS NULL THEN 'no text' WHEN name = 'a.txt' AND doc_id % 13 = 0 THEN 'restricted' END AS missing FROM c""",
    "metadata_chunks": "SELECT doc_id, ord, text FROM meta_chunks",
    "source_overview": "SELECT source, sum(n) AS documents, arg_max(lang, (n, lang)) AS main_lang, min(low) AS shortest, max(high) AS longest FROM (SELECT source, lang, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY ALL) GROUP BY 1",
    "two_level_retrieval": """SELECT query_id, doc_id, ord, score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id, s.doc_id ORDER BY s.rank) AS n FROM sem s JOIN lex_docs l ON l.query_id = s.query_id AND l.doc_id = s.doc_id AND l.rank <= 5) WHERE n = 1""",
    "median_latency": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, list_sort(list(value))[(count(value) // 2)::BIGINT + 1] AS upper_median FROM events GROUP BY 1",
    "integrity_report": """SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS stray_judgments, (SELECT count(*) FROM (SELECT query_id FROM q GROUP BY 1 HAVING count(*) > 1)) AS repeated_queries,
  (SELECT count(*) FROM (SELECT lower(trim(text)) AS t FROM q GROUP BY 1 HAVING count(DISTINCT lang) > 1)) AS shared_texts""",
    "content_hashes": "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents",
}


ORACLES |= {
    "catalog_projection": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 2 = 0 THEN 'Fakulta-' || lang END AS faculty, CASE WHEN doc_id % 3 <> 1 THEN 'dep-' || doc_id % 6 END AS department,
  'Práce č. ' || doc_id // 21 AS title, 'cs' AS title_lang, CASE WHEN doc_id % 2 = 0 THEN 'Thesis ' || doc_id END AS title_translated, CASE WHEN doc_id % 2 = 0 THEN 'en' END AS title_translated_lang, 'jedna;' || doc_id % 9 AS keywords_cs, 'one;two' AS keywords_en FROM documents""",
    "group_members": "SELECT * FROM member_rows",
    "same_work_groups": """SELECT 'prace c ' || regexp_extract(title, '[0-9]+$') || '|novak jan ' || right(author, 1) AS grp, count(DISTINCT coalesce(thesis_type, '-')) FILTER (coalesce(thesis_type, '-') <> 'rigorózní práce') <= 1 AS same_work,
  CASE WHEN bool_or(coalesce(outcome = 'U', false)) THEN 'recognized' WHEN count(DISTINCT coalesce(thesis_type, '-')) = 1 THEN 'repeated defence' ELSE 'rigorous thesis' END AS shape FROM member_rows GROUP BY title, author HAVING count(*) > 1""",
    "eligible_documents": """SELECT doc_id, 'dep-' || doc_id % 6 AS department FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 3 <> 1 AND doc_id % 5 <> 0 AND n_chars >= 1000""",
    "department_draw": """WITH u AS (SELECT lang, source, count(*) AS n, md5('0:' || lang || ':' || source) AS k FROM documents GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, source) AS n2 FROM u),
  c AS (SELECT lang, source FROM r WHERE n2 <= 2 ORDER BY k, lang, source LIMIT 8)
  SELECT faculty, department, doc_id FROM (SELECT s.lang AS faculty, s.source AS department, doc_id, row_number() OVER (PARTITION BY s.lang, s.source ORDER BY s.k, doc_id) AS n FROM sample_key s JOIN c ON s.lang = c.lang AND s.source = c.source) WHERE n <= 5""",
    "private_name_tokens": "SELECT doc_id, 'jan novák' AS names FROM documents",
    "ids_and_shards": r"""SELECT doc_id, replace(h, '/', '_') AS stem, coalesce(try_cast(p AS BIGINT), 0) AS number, CASE WHEN try_cast(p AS BIGINT) IS NOT NULL THEN (try_cast(p AS BIGINT) // 1000)::VARCHAR ELSE 'other' END AS shard, source || '-žluť' AS slug,
  (n_chars * 7) // 3600 || ' h ' || (n_chars * 7) % 3600 // 60 || ' min' AS took FROM (SELECT *, '20.500/' || CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE '' END || doc_id * 37 AS h, CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE '' END || doc_id * 37 AS p FROM documents)""",
    "kept_files": """SELECT doc_id, 5 AS files, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b THEN 'a.pdf.txt' ELSE 'b.pdf.txt' END AS body FROM (SELECT doc_id, doc_id % 13 AS a, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 7 ELSE 0 END AS b FROM documents)""",
    "override_provenance": """SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'fixed' ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN 'cs' ELSE lang END AS lang, CASE WHEN doc_id % 8 = 0 THEN 'lang,source' WHEN doc_id % 4 = 0 THEN 'lang' ELSE '' END AS overridden FROM documents""",
    "category_histogram": """SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INT AS place FROM (SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL)""",
    "collection_counts": """SELECT source AS collection, count(DISTINCT doc_id % 97) AS found, max(doc_id) % 60 AS announced, count(DISTINCT doc_id % 97) >= max(doc_id) % 60 AS complete FROM documents GROUP BY 1""",
    "table_differences": "SELECT CASE lang WHEN 'de' THEN 'first' ELSE 'second' END AS side, source, lang, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY ALL",
    "multiset_operations": "SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 INTERSECT ALL SELECT source FROM documents WHERE doc_id % 3 = 0) GROUP BY 1",
    "window_frames": """SELECT event_id, ntile(4) OVER w AS quarter, round(cume_dist() OVER w, 6) AS share, round(percent_rank() OVER w, 6) AS place, nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
  count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS within_hour FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "date_arithmetic": """SELECT event_id, ts::DATE + 30 AS due, last_day(ts::DATE) AS month_end, (dayofweek(ts) + 1)::INT AS weekday, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, (DATE '2025-01-01' - ts::DATE)::INT AS days_left FROM events""",
    "line_positions": r"""WITH g AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
  l AS (SELECT doc_id, 3 * i AS n, x AS line FROM g UNION ALL SELECT doc_id, 3 * i + 1, '' FROM g WHERE i % 3 = 1 UNION ALL SELECT doc_id, 3 * i + 2, (i + 1)::VARCHAR FROM g WHERE i % 3 = 1),
  f AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position,
    last_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    first_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM l)
  SELECT doc_id, count(*) AS lines, sum(position)::BIGINT AS positions, count(*) FILTER (coalesce(regexp_matches(b, '^[0-9]{1,4}$'), false) OR coalesce(regexp_matches(a, '^[0-9]{1,4}$'), false)) AS beside FROM f GROUP BY 1""",
    "metrics_by_type": """SELECT query_id, metric, round(value, 6) AS value FROM (SELECT query_id, unnest(CASE WHEN q.type = 'topic' THEN ['ndcg_10', 'p_10', 'recall_100', 'judged_10'] ELSE ['mrr_10', 'success_1', 'success_10', 'success_100'] END) AS metric,
  unnest(CASE WHEN q.type = 'topic' THEN [ndcg_10::DOUBLE, p_10, recall_100, judged_10] ELSE [mrr_10::DOUBLE, success_1, success_10, success_100] END) AS value FROM values_ v JOIN q USING (query_id))""",
    "results_keep_metrics": "SELECT query_id, CASE WHEN query_id % 3 <> 0 THEN 0.5 ELSE round(mrr_10, 6) END AS mrr_10, round(ndcg_10, 6) AS ndcg_10 FROM values_",
    "all_chunks_union": "SELECT doc_id, ord, length(text) AS n FROM chunks UNION ALL SELECT doc_id, ord, length(text) FROM meta_chunks",
    "entities_to_a_fixpoint": "SELECT doc_id, chr((doc_id % 26 + 97)::INT) || 'é' || chr((doc_id % 26 + 97)::INT) || ' a < b &unknown;' AS text FROM documents",
    "equality_keys": "SELECT doc_id, 'strasse film zlut kun No ' || source AS grp FROM documents",
    "defence_outcomes": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'N' WHEN 2 THEN 'U' ELSE CASE doc_id // 5 % 6 WHEN 0 THEN 'N' WHEN 1 THEN 'U' WHEN 2 THEN 'O' WHEN 3 THEN 'O' END END AS outcome FROM documents""",
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    out = {}
    for name, body in ORACLES.items():
        full = sql(body)
        # A body with parts of its own goes behind the shared ones.
        out[name] = full.replace(") WITH ", "), ", 1) if body.startswith("WITH ") and full != body else full
    return out
