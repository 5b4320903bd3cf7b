"""The opN_<name> queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdsearch import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..runtime import shared_folder
    from .warc import new_folder, read_warc, write_warc

    folder = new_folder(shared_folder(spark))
    write_warc(table(spark, sf_dir, "pages"), folder)
    records = read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    own = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(own, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").alias("refers_to"),
    )


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_crf_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op7_fertility_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .quality import rate_quality

    return rate_quality(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_bootstrapped_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal import find_personal

    found = find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict_language

    return predict_language(table(spark, sf_dir, "documents"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ballkmeans import clusters

    return clusters(table(spark, sf_dir, "embeddings"))


def op12_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exactdup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), digest=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_setsketch_near_dedup, op2_crf_secret_scan, op3_karmarkar_karp_packing, op4_bootstrapped_personal_data, op5_counterfactual_toxicity, op6_kd_tree_search, op7_fertility_quality, op8_source_mixing, op9_warc_round_trip, op10_ftrl_language_id, op11_ball_kmeans, op12_progressive_exact_dedup, op13_source_divergence)}
SQL: dict[str, str] = {
    "op6_kd_tree_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_source_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 3.0 * source_size / weight AS stops,
    (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER w, 0) AS left_size,
    (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT CAST(left_size AS DOUBLE) / CAST(left_weight AS DOUBLE) AS level FROM c
  WHERE stops >= CAST(left_size AS DOUBLE) / CAST(left_weight AS DOUBLE) ORDER BY stops, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(CAST(3 AS DOUBLE) * source_size, (SELECT level FROM l) * weight) AS target FROM s
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
""",
    "op9_warc_round_trip": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
""",
    "op12_progressive_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), counts AS MATERIALIZED (SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), langs AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang
), g AS MATERIALIZED (
  SELECT p.lang, p.source, coalesce(l.v, 0) AS v, l.size AS lang_size, coalesce(s.size, 0) AS size FROM (SELECT DISTINCT lang, source FROM d) p
  LEFT JOIN langs l ON p.lang = l.lang LEFT JOIN (SELECT lang, source, sum(c) AS size FROM counts GROUP BY ALL) s ON p.lang = s.lang AND p.source = s.source
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + CAST(2 AS HUGEINT)) // (CAST(g.size AS HUGEINT) + 2 * g.v) AS p,
    1 + 1000000000 * (k.n + 2) // (CAST(g.lang_size AS HUGEINT) + 2 * g.v) AS q
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE c > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows_)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}


def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assigning all vectors and averaging, written out one after another."""
    far = "CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, e FROM v) ORDER BY h LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min((d, c)) AS best FROM (SELECT r, c, {far} AS d FROM v, c{n} c) GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT best[2] AS c, i, sum(e[i]) AS s, count(*) AS n FROM (SELECT best, e, unnest(range(1, 65)) AS i FROM a{n} JOIN v USING (r)) GROUP BY ALL)")
            parts.append(f"m{n} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, o.e) AS e FROM c{n} o LEFT JOIN m{n} m USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = best[2]"""


SQL["op11_ball_kmeans"] = _kmeans_sql()
