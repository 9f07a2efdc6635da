"""The contract queries opN_<name>: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, lattice_dedup, license_scan, mixing, suffix_dedup, token_counts, toxicity, url_filter

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), vocabulary(PIECES)).select("doc_id", "held_out", "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.lattice_dedup(table(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_links", "component", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), budgets=(1024,))
    return r.select("doc_id", "n_bytes", "n_tokens", (F.col("fit_1024") < F.col("n_chars")).alias("over_limit"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return r.select("doc_id", "held_out", "score", "predicted")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mixing.mix(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_lattice_dedup, op4_decontaminate, op5_jaccard_join, op6_token_counts, op7_toxicity, op8_license_scan, op9_mix, op10_url_filter)}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op4_decontaminate": f"""
        WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS ws FROM benchmark),
        w AS (SELECT DISTINCT item, array_to_string(ws[i:least(i + 9, len(ws))], ' ') AS k, least(10, len(ws)) AS n
              FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(i) WHERE len(ws) > 0),
        d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("text")} AS ws FROM documents),
        g AS (SELECT rid, i, ws, unnest(lens) AS n FROM d, unnest(range(1, len(ws) + 1)) AS r(i), (SELECT list(DISTINCT n) AS lens FROM w)),
        h AS (SELECT rid, i, w.n, item FROM g JOIN w ON w.n = g.n AND w.k = array_to_string(ws[i:i + g.n - 1], ' ') WHERE i + g.n - 1 <= len(ws)),
        c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
        t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)""",
    "op9_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM s),
        r AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS goal, sum(w) OVER () AS all_w FROM w),
        l AS (SELECT *, (goal - coalesce(sum(most) OVER o, 0)) / (all_w - coalesce(sum(w) OVER o, 0)) > ratio AS capped FROM r
              WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE w * ((goal - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) / (sum(CASE WHEN NOT capped THEN w END) OVER ())) END AS target,
                     ('0x' || md5('17:' || coalesce('s' || source, 'n'))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
        k AS (SELECT d.*, source_size, target, u, coalesce(target / nullif(source_size, 0), 0) AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS n
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, ((floor(u + rate * n) - floor(u + rate * (n - 1))) * size)::BIGINT AS taken FROM k""",
    "op2_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
        w AS (SELECT rid, o, i, md5(substring(h, 2 * i + 1, 200)) AS k FROM d, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS r(i)),
        f AS (SELECT k, min((o, i)) AS first FROM w GROUP BY k),
        c AS (SELECT rid, i, i + 100 AS e FROM w JOIN f USING (k) WHERE first < (o, i)),
        g AS (SELECT rid, i, e, CASE WHEN i <= max(e) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c),
        s AS (SELECT rid, min(i) AS i, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM g) GROUP BY rid, run),
        t AS (SELECT rid, count(*) AS n_spans, sum(e - i) AS n_removed, list_sort(list(i)) AS starts, list_sort(list(e)) AS stops FROM s GROUP BY rid)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda j:
                 substring(h, 2 * (CASE WHEN j = 1 THEN 0 ELSE stops[j - 1] END) + 1, 2 * ((CASE WHEN j = n_spans + 1 THEN len(h) // 2 ELSE starts[j] END) - (CASE WHEN j = 1 THEN 0 ELSE stops[j - 1] END)))), '') END)) AS kept_sha256
        FROM d LEFT JOIN t USING (rid)""",
    "op3_lattice_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE CASE WHEN len(a.e) = len(b.e) THEN list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) END >= 0.93),
        r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op5_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS g FROM d WHERE len(ws) > 0),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE i * 10 >= 8 * (x.n + y.n - i)),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(n_links, 0)::BIGINT AS n_links, component, d.doc_id = component AS kept
        FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id""",
    "op10_url_filter": r"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        m AS (SELECT host, path, arg_max(h || rules.p, len(h || rules.p)) AS rule, arg_max(verdict, len(h || rules.p)) AS said
              FROM (SELECT DISTINCT host, path FROM p) q, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY host, path),
        y AS (SELECT doc_id, count(*) AS n, sum(1 - quality) AS bad FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
        h AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(host, '.') AS q FROM p LEFT JOIN y ON doc_id = page_id GROUP BY host),
        h1 AS (SELECT *, CASE WHEN len(q) <= 2 OR regexp_matches(host, '^[0-9.:\[\]]+$') THEN host WHEN q[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND len(q[-1]) = 2 THEN array_to_string(q[-3:], '.') ELSE array_to_string(q[-2:], '.') END AS domain FROM h),
        h2 AS (SELECT host, n, bad, domain, CASE WHEN contains(domain, '.') THEN regexp_extract(domain, '^[^.]*\.(.*)$', 1) ELSE domain END AS suffix FROM h1),
        d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h2 GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
        lv AS (SELECT 's' AS lv, n, bad FROM s WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM d WHERE n > 0 UNION ALL SELECT 'h', n, bad FROM h2 WHERE n > 0),
        t AS (SELECT lv, sum(n) AS N1, sum(bad) / sum(n) AS mean, sum(n * n) AS N2, sum(bad * bad / n) AS Q, count(*) AS C FROM lv GROUP BY lv),
        b AS (SELECT lv, mean * (1 - mean) AS v, (Q - N1 * mean * mean - (C - 1) * mean * (1 - mean)) / nullif(N1 - N2 / N1, 0) AS btw FROM t),
        k AS (SELECT lv, coalesce(CASE WHEN btw > 0 THEN greatest(1.0, least(1000.0, v / btw - 1)) ELSE 1000.0 END, 1000.0) AS k FROM b),
        o AS (SELECT coalesce((SELECT k FROM k WHERE lv = 's'), 1000.0) AS k_s, coalesce((SELECT k FROM k WHERE lv = 'd'), 1000.0) AS k_d, coalesce((SELECT k FROM k WHERE lv = 'h'), 1000.0) AS k_h,
                     (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM s) AS g),
        s2 AS (SELECT suffix, (bad + k_s * g) / (n + k_s) AS r FROM s, o), d2 AS (SELECT domain, (bad + k_d * r) / (n + k_d) AS r FROM d JOIN s2 USING (suffix), o),
        ab AS (SELECT host, bad + k_h * r AS a, n - bad + k_h * (1 - r) AS b FROM h2 JOIN d2 USING (domain), o),
        post AS (SELECT host, a / (a + b) AS rate, sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS sd FROM ab)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN rate - 1.645 * sd > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS bad_rate, round(rate - 1.645 * sd, 6) AS bad_low
        FROM p JOIN post USING (host) LEFT JOIN m USING (host, path)""",
}
