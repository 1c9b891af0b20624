"""The registered query of each operator, on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontamination, jaccard, katz, licenses, media, packing, quality, sharding, token_counts, warc
from brindle.llm.common import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"
#: Production sharding: 256 shards over a table of 65,537 slots.
SHARDS, SLOTS = tuple(f"shard-{i:03d}" for i in range(256)), 65_537


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", SHARDS, SLOTS).select("doc_id", "slot", "shard")


def _sharding_sql() -> str:
    table = ",".join(map(str, sharding.fill_table(SHARDS, SLOTS)))
    return f"""WITH t AS MATERIALIZED (SELECT [{table}] AS shards),
    s AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
    SELECT doc_id, slot, CAST(t.shards[slot + 1] AS INTEGER) AS shard FROM s, t"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.encode_media(_table(spark, sf_dir, "documents")), "media")
    features = media.read_media(stored)
    return features.withColumn("feature", F.lower(F.hex("phash"))).drop("phash")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_table(spark, sf_dir, "documents"))


QUERIES |= {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_warc": op5_warc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_media_columns": op7_media_columns,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_katz_scores": op10_katz_scores,
}
ORACLES["op1_sharding"] = _sharding_sql()

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS win
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
g AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
                  CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY html HAVING count(*) > 1)
SELECT p.page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (html)"""

_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD_SQL = f"""
d AS MATERIALIZED (SELECT doc_id, {_SPLIT} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
      SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS MATERIALIZED (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""

ORACLES["op9_jaccard_join"] = f"""
WITH RECURSIVE {JACCARD_SQL}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN component c USING (doc_id)"""


def _license_sql() -> str:
    rows = ",".join(
        f"({k}, '{t.label}', {str(t.exact).lower()}, [{','.join(repr(w) for w in licenses.template_words(t.text))}])" for k, t in enumerate(licenses.TEMPLATES)
    )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t(tid, label, exact, w) AS (VALUES {rows}),
tg AS (SELECT tid, label, exact, len(w) - 2 AS n, i AS tpos, w[i + 1:i + 3] AS g FROM (SELECT *, unnest(range(0, len(w) - 2)) AS i FROM t)),
dg AS (SELECT r, i AS pos, w[i + 1:i + 3] AS g FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
m AS MATERIALIZED (SELECT r, tid, label, exact, n, tpos, pos - tpos AS diagonal FROM dg JOIN tg USING (g)),
dd AS (SELECT DISTINCT r, tid, label, exact, n, diagonal FROM m),
-- each diagonal with those up to three words on: a template position counts where it first stands, if beyond all before
near AS (SELECT r, tid, label, n, dd.diagonal, m.tpos, min(m.tpos + m.diagonal) AS pos FROM dd JOIN m USING (r, tid, label, exact, n)
         WHERE NOT exact AND m.diagonal BETWEEN dd.diagonal AND dd.diagonal + 3 GROUP BY ALL),
walk AS (SELECT *, coalesce(max(pos) OVER (PARTITION BY r, tid, diagonal ORDER BY tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM near),
spans AS (SELECT r, label, false AS exact, diagonal AS start, CAST(count(*) FILTER (pos > top) AS DOUBLE) / n AS covered
         FROM walk GROUP BY r, tid, label, n, diagonal HAVING covered >= 0.75),
whole AS (SELECT r, label, exact, diagonal AS start, CAST(1 AS DOUBLE) AS covered FROM m WHERE exact GROUP BY r, tid, label, exact, n, diagonal HAVING count(DISTINCT tpos) = n),
found AS (SELECT * FROM spans UNION ALL SELECT * FROM whole)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word,
       max(start) FILTER (exact) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(covered), 0.0) AS score
FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id, w"""


ORACLES["op4_license_scan"] = _license_sql()
