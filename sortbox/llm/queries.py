"""Registered queries of the corpus operators (``opN_<name>``) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortbox.llm import (
    decontamination,
    divergence,
    html_extraction,
    infill,
    language_id,
    licenses,
    near_dup,
    packing,
    quality,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)
from sortbox.llm.tables import read


def op1_latent_semantic_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    docs = decontamination.with_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return docs.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op2_boosted_dom_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as files: a tree for each source, every eighth document a licence file."""
    name = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("file-"), F.col("doc_id"), F.lit(".txt")))
    folder = F.concat_ws("/", F.col("source"), F.expr("concat('a', doc_id div 4096)"), F.expr("concat('b', doc_id div 256 % 16)"))
    deeper = F.when(F.col("doc_id") % 8 == 0, folder).otherwise(F.concat(folder, F.expr("concat('/c', doc_id % 4)")))
    return docs.withColumn("path", F.concat_ws("/", deeper, name))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(document_paths(read(spark, sf_dir, "documents")), ["doc_id"])


def op6_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), added=True)


def op11_piece_table_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored hash is taken from the arranged text and its form, not from the input."""
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return infill.restore(infill.transform(read(spark, sf_dir, "documents")), keep=columns, with_text=False)


def op12_merge_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), place AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM place
), owners AS (
  SELECT h, min(doc_id) AS owner FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN owners USING (h) WHERE owner < doc_id
), each_word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM each_word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), at_line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words
), dup AS (
  SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM at_line
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), place AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM place
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS k FROM win WHERE n > 1) GROUP BY doc_id
), base AS (
  SELECT words.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN dup ON dup.doc_id = words.doc_id LEFT JOIN covered ON covered.doc_id = words.doc_id
), ruled AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), failing AS (
  SELECT host, unnest([struct_pack(rule := 'base', bad := base_failed), struct_pack(rule := 'symbols', bad := 10 * n_symbols > n_words),
                       struct_pack(rule := 'lines', bad := 10 * n_dup_lines > n_words), struct_pack(rule := 'letters', bad := word_chars < 2 * n_words)]) AS r FROM ruled
), hosts AS (
  SELECT host, r.rule AS rule, count(*) AS n, count(*) FILTER (WHERE r.bad) AS f FROM failing GROUP BY ALL
), moments AS (
  SELECT rule, avg(f / n) AS m, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS v FROM hosts GROUP BY rule
), strength AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM moments
), bars AS (
  SELECT *, greatest(m + least(2 * sqrt(m * (1 - m) / (k + 1)), 0.4), 0.25) AS bar FROM strength
), rates AS (
  SELECT host, n, k, bar, (f + m * k) / (n + k) AS rate FROM hosts JOIN bars USING (rule)
), verdicts AS (
  SELECT host, bool_and(NOT rate - 2 * sqrt(rate * (1 - rate) / (n + k + 1)) > bar) AS passes FROM rates GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept
FROM ruled JOIN verdicts USING (host)
"""

OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

# crc32 bit by bit: the table has the eight shifts of each byte, the fold goes over the text's bytes.
OP9_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8
), texts AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), checks AS (
  SELECT text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                   lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM texts, crc_table
), base AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(d.text, ''))) + 16 AS BIGINT) AS size, crc AS text_crc32, md5(coalesce(d.text, '')) AS key
  FROM documents d JOIN checks ON checks.text = coalesce(d.text, '')
), total AS (
  SELECT sum(size) AS t FROM base
), classed AS (
  SELECT base.*, t, CASE WHEN size * 160 > t THEN 0 WHEN size * 640 > t THEN 1 WHEN size * 2560 > t THEN 2 WHEN size * 10240 > t THEN 3 ELSE 4 END AS tier
  FROM base, total
), placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY tier, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS DOUBLE) AS middle,
         row_number() OVER (ORDER BY tier, key, doc_id) - 1 AS rank FROM classed
), shards AS (
  SELECT unnest(range(0, 40)) AS s
), done_0 AS (
  SELECT CAST(NULL AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS shard WHERE false
)""" + "".join(
    # One class after the other: what the shards hold, the room left, and where the room's ends lie.
    f""", sums_{t} AS (
  SELECT coalesce(sum(size) FILTER (WHERE tier < {t}), 0) AS begin, sum(size) FILTER (WHERE tier = {t}) AS own FROM classed
), room_{t} AS (
  SELECT s, greatest(0, begin + own - 40 * coalesce((SELECT sum(size) FROM done_{t} d WHERE d.shard = s), 0)) AS room FROM shards, sums_{t}
), ends_{t} AS (
  SELECT list(e ORDER BY s) FILTER (WHERE s < 39) AS ends, max(e) AS whole
  FROM (SELECT s, CAST(sum(room) OVER (ORDER BY s) AS DOUBLE) AS e FROM room_{t})
), done_{t + 1} AS (
  SELECT * FROM done_{t} UNION ALL
  SELECT rank, size, len(list_filter(ends, lambda e: e <= (middle - begin) * (whole / own))) FROM placed, sums_{t}, ends_{t} WHERE tier = {t}
)"""
    for t in range(5)
) + r"""
SELECT doc_id, placed.size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY rank) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed JOIN done_5 USING (rank)
"""

def _values(rows: list[tuple[str, str, bool]]) -> str:
    return ", ".join(f"({i}, '{name}', '{text}', {whole})" for i, (name, text, whole) in enumerate(rows))


OP5_SQL = r"""
WITH templates AS (
  SELECT template, license, CAST(whole AS INT) AS whole, regexp_extract_all(lower(text), '[a-z0-9]+(?:[.][0-9]+)*') AS ws
  FROM (VALUES __TEMPLATES__) v(template, license, text, whole)
), t_places AS (
  SELECT template, len(ws) AS size, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM templates
), weights AS (
  SELECT word, 0.3 + ln((1.0 + (SELECT count(DISTINCT license) FROM templates)) / (1 + count(DISTINCT license))) AS w
  FROM t_places JOIN templates USING (template) GROUP BY word
), t_words AS (
  SELECT template, word, any_value(w) AS w, count(*) * any_value(w) AS v FROM t_places JOIN weights USING (word) GROUP BY template, word
), bounds AS (
  SELECT template, word, v, sum(v * v) OVER (PARTITION BY template ORDER BY word NOT IN __COMMON__, w, word ROWS UNBOUNDED PRECEDING) AS upto, sum(v * v) OVER (PARTITION BY template) AS length2 FROM t_words
), cues AS (
  SELECT template, size, word, place FROM bounds JOIN t_places USING (template, word) WHERE upto >= (0.7 - 1e-5) ** 2 * length2
), files AS (
  SELECT doc_id, text, concat(source, '/a', doc_id // 4096, '/b', doc_id // 256 % 16, CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat('/c', doc_id % 4) END) AS folder,
         CASE WHEN doc_id % 8 = 0 THEN concat('LICENSE-', doc_id) ELSE concat('file-', doc_id, '.txt') END AS name FROM documents
), lists AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[.][0-9]+)*') AS ws FROM files
), begins AS (
  SELECT DISTINCT doc_id, template, size, pos - place AS begin
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lists) JOIN cues USING (word)
), windows AS (
  SELECT doc_id, template, begin, ws[CAST(greatest(begin, 0) + 1 AS BIGINT):CAST(begin + size AS BIGINT)] AS win, size, list_filter(t_ws, lambda x: regexp_matches(x, '^[0-9]')) AS numbers
  FROM begins JOIN lists USING (doc_id) JOIN (SELECT template, ws AS t_ws FROM templates) USING (template)
), w_words AS (
  SELECT doc_id, template, begin, word, count(*) AS n
  FROM (SELECT doc_id, template, begin, unnest(win) AS word FROM windows WHERE 2 * len(win) >= size AND list_has_all(win, numbers)) GROUP BY ALL
), cosines AS (
  SELECT doc_id, template, begin,
         round(sum(n * coalesce(weights.w, 0) * coalesce(v, 0)) / (sqrt(sum((n * coalesce(weights.w, other)) ** 2)) * any_value(t_norm)), 6) AS cosine
  FROM w_words LEFT JOIN weights USING (word) LEFT JOIN t_words USING (template, word)
  JOIN (SELECT template, sqrt(sum(v * v)) AS t_norm FROM t_words GROUP BY template) USING (template),
       (SELECT 0.3 + ln(1.0 + count(DISTINCT license)) AS other FROM templates) GROUP BY ALL
), own AS (
  SELECT doc_id, license, whole, cosine FROM cosines JOIN templates USING (template) WHERE cosine >= 0.7
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY whole DESC, cosine DESC, license) = 1
), given AS (
  SELECT folder, license, cosine, concat(folder, '/', name) AS from_path FROM own JOIN files USING (doc_id) WHERE doc_id % 8 = 0
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY whole DESC, cosine DESC, license, concat(folder, '/', name)) = 1
), up AS (
  SELECT DISTINCT f.folder, g.license, g.cosine, g.from_path, length(g.folder) AS depth
  FROM files f JOIN given g ON f.folder = g.folder OR starts_with(f.folder, g.folder || '/')
), nearest AS (
  SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY folder ORDER BY depth DESC) = 1
)
SELECT f.doc_id, concat(f.folder, '/', f.name) AS path, coalesce(own.license, nearest.license) AS license,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN nearest.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       coalesce(own.cosine, nearest.cosine) AS cosine,
       CASE WHEN own.license IS NOT NULL THEN concat(f.folder, '/', f.name) ELSE nearest.from_path END AS from_path
FROM files f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN nearest ON nearest.folder = f.folder
""".replace("__TEMPLATES__", _values(licenses.template_rows())).replace("__COMMON__", str(licenses.COMMON))

OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occurs AS (
  SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM occurs GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM occurs SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c, 0) AS c,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // (t.n + v) AS BIGINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (lang_n + 1) // (l.n + v) AS BIGINT) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE c > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 200
"""

QUERIES = {
    "op1_latent_semantic_decontamination": op1_latent_semantic_decontamination,
    "op2_boosted_dom_extraction": op2_boosted_dom_extraction,
    "op3_recurrent_toxicity": op3_recurrent_toxicity,
    "op4_suffix_tree_dedup": op4_suffix_tree_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_host_quality_rules": op6_host_quality_rules,
    "op7_hyperdimensional_language_id": op7_hyperdimensional_language_id,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_sampled_splitter_shards": op9_sampled_splitter_shards,
    "op10_hierarchical_packing": op10_hierarchical_packing,
    "op11_piece_table_infill": op11_piece_table_infill,
    "op12_merge_heap_token_counts": op12_merge_heap_token_counts,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {
    "op4_suffix_tree_dedup": OP4_SQL,
    "op5_license_scan": OP5_SQL,
    "op6_host_quality_rules": OP6_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op9_sampled_splitter_shards": OP9_SQL,
    "op11_piece_table_infill": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
