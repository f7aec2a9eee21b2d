"""The subpackage's queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import ROW_BYTES, shards

    text = F.coalesce("text", F.lit(""))
    return shards(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import RULES, judge

    return judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media

    return media(_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import dedup

    return dedup(_table(spark, sf_dir, "documents"), digest=True)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained

    return contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import LineIndex

    docs = _table(spark, sf_dir, "documents")
    return LineIndex(spark).insert(docs).dedup(docs, digest=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup

    return dedup(_table(spark, sf_dir, "documents"), digest=True)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def queries() -> dict:
    found = {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2:3].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


#: A-Z to a-z, and white space as the contracts have it.
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SQL = {
    "op2_url_filters": f"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT host, path, max({{'a': length(h) + length(p), 'b': length(h), 'c': (v = 'block')::INT, 'rule': h || p, 'v': v}}) AS best FROM (SELECT DISTINCT host, path FROM x) JOIN r
 ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2)
SELECT page_id, x.host, x.path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM x LEFT JOIN m ON x.host = m.host AND x.path = m.path""",
    "op5_benchmark_decontamination": f"""
WITH s AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS own, least(len(w), 5) AS g
 FROM (SELECT item_id, {_WORDS.replace("text", f"translate(text, '{_UP}', '{_LOW}')")} AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT item_id, g, len(own) AS n, unnest(own) AS x FROM s),
d AS (SELECT doc_id, {_WORDS.replace("text", f"translate(text, '{_UP}', '{_LOW}')")} AS w FROM documents),
t AS (SELECT DISTINCT doc_id, g, unnest(list_transform(range(1, len(w) - g + 2), lambda j: array_to_string(w[j:j + g - 1], ' '))) AS x FROM d JOIN (SELECT DISTINCT g FROM i) ON len(w) >= g)
SELECT doc_id, item_id, n::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / n AS containment FROM t JOIN i USING (g, x) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""",
    "op6_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
y AS (SELECT *, translate(trim(line, {_SPACES}), '{_UP}', '{_LOW}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM y WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT y.doc_id, line, k, first IS NOT NULL AND first < y.doc_id AS gone FROM y LEFT JOIN f ON f.key = y.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1""",
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("text", f"translate(text, '{_UP}', '{_LOW}')")} AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS own FROM w),
s AS (SELECT doc_id, len(own) AS n, hash(unnest(own)) AS x FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c AS (SELECT doc_id AS node, doc_id AS label FROM d UNION SELECT b, label FROM c JOIN p ON a = node)
SELECT doc_id, len(own)::BIGINT AS n_shingles, (SELECT min(label) FROM c WHERE node = doc_id) AS component_id, (SELECT count(*) FROM p WHERE a = doc_id)::BIGINT AS n_links FROM d""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS k, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS m FROM x),
f AS (SELECT m, min(doc_id) AS first FROM h GROUP BY 1),
g AS (SELECT DISTINCT h.doc_id, unnest(range(k, k + 50)) AS i FROM h JOIN f USING (m) WHERE first < h.doc_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
j AS (SELECT t.doc_id, word, t.i, g.i IS NOT NULL AS gone FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS s FROM j GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, coalesce(s, sha256('')) AS kept_sha256 FROM w LEFT JOIN a ON a.doc_id = w.doc_id""",
}


def oracle_sql() -> dict:
    """SQL for the queries that it can express in reasonable time; the others are tested by brute force."""
    return dict(_SQL)
