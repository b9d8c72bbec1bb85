"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import table


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op01_extract import extracted

    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op02_url_filter import filtered

    return filtered(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op03_ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op04_curves import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op05_toxicity import fitted, held_out, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    out = scored(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op06_unit_dedup import unit_dedup

    out = unit_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text", "n_units", "n_removed", spans.alias("removed_spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op07_decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.op08_pack import pack

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op09_shard import LAW, shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    return shards(docs, 8).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op10_suffix_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_extract, op2_url_filter, op3_ngram_join, op4_curves, op5_toxicity, op6_unit_dedup, op7_decontaminate, op8_pack, op9_shard, op10_suffix_dedup)}

_BLANK = "\\x20\\x09\\x0B-\\x0D"
_OP6_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM parts),
cut AS (
  SELECT doc_id, k, line, regexp_extract_all(line, '[^\\x0A{_BLANK}]+[{_BLANK}]*') AS tokens, regexp_extract(line, '^[{_BLANK}]*') AS lead,
         CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - strlen(line) - 1 AS pos
  FROM lines),
tokens AS (SELECT doc_id, k, pos + strlen(lead) AS pos, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM cut),
words AS (
  SELECT *, translate(regexp_extract(token, '^[^{_BLANK}]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word,
         CAST(pos + sum(strlen(token)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS j
  FROM tokens),
runs AS (SELECT doc_id, j, list(word) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS run FROM words),
ranked AS (SELECT doc_id, j, row_number() OVER (PARTITION BY md5(array_to_string(run, ' ')) ORDER BY doc_id, j) AS n FROM runs WHERE len(run) = 50),
marked AS (
  SELECT w.*, coalesce(max(r.j) OVER (PARTITION BY w.doc_id ORDER BY w.j), -50) > w.j - 50 AS gone
  FROM words w LEFT JOIN (SELECT doc_id, j FROM ranked WHERE n > 1) r ON r.doc_id = w.doc_id AND r.j = w.j),
units AS (
  SELECT doc_id, k, string_agg(word, ' ' ORDER BY i) AS unit, bool_and(gone) AS every, coalesce(string_agg(token, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS rest
  FROM marked GROUP BY doc_id, k),
judged AS (SELECT *, every OR row_number() OVER (PARTITION BY unit ORDER BY doc_id, k) > 1 AS whole FROM units),
islands AS (SELECT doc_id, k, pos, stop, strlen(token) AS size, i - row_number() OVER (PARTITION BY doc_id, k, gone ORDER BY i) AS island, gone FROM marked),
spans AS (
  SELECT c.doc_id, c.pos AS start, c.pos + strlen(c.line) AS stop FROM cut c JOIN judged u ON u.doc_id = c.doc_id AND u.k = c.k AND u.whole
  UNION ALL
  SELECT i.doc_id, min(i.stop - i.size), max(i.stop) FROM islands i JOIN judged u ON u.doc_id = i.doc_id AND u.k = i.k AND NOT u.whole WHERE i.gone GROUP BY i.doc_id, i.k, i.island),
told AS (SELECT doc_id, count(*) AS n_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS spans FROM spans GROUP BY doc_id),
kept AS (
  SELECT c.doc_id, count(*) AS n, string_agg(CASE WHEN u.unit IS NULL THEN c.line ELSE c.lead || u.rest END, chr(10) ORDER BY c.k) FILTER (WHERE u.unit IS NULL OR NOT u.whole) AS text
  FROM cut c LEFT JOIN judged u ON u.doc_id = c.doc_id AND u.k = c.k GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE k.n END AS n_units, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.spans, '') AS removed_spans
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN told t ON t.doc_id = d.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP3_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS n FROM docs),
runs AS (SELECT doc_id, n, k, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(run, ' ') AS s FROM runs WHERE (n >= 3 AND k <= n - 2) OR (n < 3 AND k = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id, s.n
"""
_OP7_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP7_SQL = f"""
WITH docs AS (SELECT doc_id, {_OP7_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP7_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_words AS (SELECT item, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS n, least(10, len(w)) AS size FROM items),
item_runs AS (SELECT item, size, k, n, list(word) OVER (PARTITION BY item ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM item_words),
patterns AS (SELECT DISTINCT item, size, array_to_string(run[1:size], ' ') AS p FROM item_runs WHERE k <= n - size + 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs),
runs AS (SELECT doc_id, k, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM words),
sized AS (SELECT doc_id, k, size, array_to_string(run[1:size], ' ') AS p FROM runs, (SELECT DISTINCT size FROM patterns) WHERE len(run) >= size),
found AS (SELECT s.doc_id, s.k, s.size, x.item FROM sized s JOIN patterns x ON x.size = s.size AND x.p = s.p),
hits AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS j FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN names m ON m.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op3_ngram_join": _OP3_SQL, "op6_unit_dedup": _OP6_SQL, "op7_decontaminate": _OP7_SQL}
