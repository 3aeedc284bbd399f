"""Queries of the operators over the supplied tables, and their SQL equivalents where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.llm import decontaminate, filter_audit, html_extract, pii, quality, runs, sentencepiece, sharding, substring_dedup, toxicity, url_filter
from lodestar.llm.common import held_out, table
from lodestar.llm.exact_dedup import exact_dedup
from lodestar.llm.simhash import simhash_components


#: Host and path of the rules that the URL query applies.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_url_filter(spark, sf_dir):
    rules = [url_filter.prefix_rule(*r) for r in URL_RULES] + [url_filter.pattern_rule(p) for p in url_filter.PATTERNS]
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_html_extract(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_pii(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="an example key")


def op6_sharding(spark, sf_dir):
    found = sharding.interleave(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece.encode(table(spark, sf_dir, "documents"), sentencepiece.load())


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_substring_dedup(spark, sf_dir):
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark, sf_dir):
    return runs.collapse_runs(table(spark, sf_dir, "documents"), made_periodic=True).drop("runs", "collapsed")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_html_extract": op4_html_extract,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Words of a text, in SQL.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op1_url_filter": """
        WITH parts AS (
            SELECT page_id, lower(coalesce(url, '')) AS url,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(url, '(?s)^[a-z][a-z0-9+.-]*://([^/?#]*\\.)?archive\\.org([^a-z0-9_.%-]|$)') THEN 'allow'
            WHEN regexp_matches(url, '(?s)^[a-z][a-z0-9+.-]*://([^/?#]*\\.)?doubleclick\\.net([^a-z0-9_.%-]|$)|/adserver/|/wp-login\\.php|/cgi-bin/|\\.exe$|\\.apk$') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
    "op6_sharding": """
        WITH bits AS (
            SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step
        ), raw AS (
            SELECT doc_id, source, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), sized AS (
            SELECT doc_id, md5('0|' || t) AS hash, coalesce('=' || source, 'null') AS src, octet_length(encode(t)) + 1 AS size,
                   xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(step[xor(c & 255, b) + 1], c >> 8))) AS text_crc32
            FROM raw, bits
        ), named AS (
            SELECT *, md5('0|' || coalesce(doc_id::VARCHAR, 'null') || '|' || text_crc32 || '|' || size) AS own, count(*) OVER () AS total FROM sized
        ), groups AS (
            SELECT hash, count(*) AS n, min(src) AS first, any_value(total) AS total FROM named GROUP BY hash HAVING count(*) > 1 AND count(*) * 16 <= any_value(total)
        ), led AS (
            SELECT *, (sum(n) OVER (PARTITION BY first ORDER BY hash) - n)::BIGINT AS lead, (sum(n) OVER (PARTITION BY first))::BIGINT AS mass FROM groups
        ), housed AS (
            SELECT hash, n, total, 8 * (2 * lead + n) // (2 * mass) AS home FROM led
        ), homes AS (
            SELECT hash, home FROM (SELECT *, sum(n) OVER (PARTITION BY home ORDER BY hash) AS upto FROM housed) WHERE upto <= total // 8
        ), marked AS (
            SELECT named.*, home FROM named LEFT JOIN homes USING (hash)
        ), shards AS (
            SELECT k, (k + 1) * total // 8 - k * total // 8 AS size, g, (k + 1) * total // 8 - k * total // 8 - g AS f
            FROM (SELECT t.k, (SELECT count(*) FROM named) AS total, (SELECT count(*) FROM marked WHERE home = t.k) AS g FROM range(8) AS t(k))
        ), fronts AS (
            SELECT *, (sum(f) OVER (ORDER BY k) - f)::BIGINT AS first FROM shards
        ), owing AS (
            SELECT src, count(*) FILTER (home IS NULL) AS others, list_transform(range(8), lambda k: greatest(0, count(*) - 8 * len(list_filter(list(home), lambda h: h = k)))) AS owed FROM marked GROUP BY src
        ), quotas AS (
            SELECT *, list_transform(range(9), lambda k: coalesce(list_sum(owed[1:k]), 0)::BIGINT) AS upto FROM owing
        ), ranked AS (
            SELECT marked.*, owed, upto, (2 * (row_number() OVER (PARTITION BY src ORDER BY hash, own, doc_id, text_crc32, size) - 1) + 1)::DOUBLE * upto[9]::DOUBLE / (2 * others)::DOUBLE AS spot
            FROM marked JOIN quotas USING (src) WHERE home IS NULL
        ), timed AS (
            SELECT *, k + (spot - upto[k + 1]) / owed[k + 1] AS time FROM (SELECT *, len(list_filter(upto, lambda x: x <= spot)) - 1 AS k FROM ranked)
        ), ordered AS (
            SELECT *, row_number() OVER (ORDER BY time, src, hash, own, doc_id, text_crc32, size) - 1 AS place FROM timed
        ), others AS (
            SELECT o.doc_id, o.size, o.text_crc32, s.k AS shard, o.place - s.first AS j, s.g, s.f FROM ordered o JOIN fronts s ON o.place >= s.first AND o.place < s.first + s.f
        ), grouped AS (
            SELECT m.doc_id, m.size, m.text_crc32, home, s.g, s.f, row_number() OVER (PARTITION BY home ORDER BY hash, own, doc_id, text_crc32, m.size) - 1 AS r FROM marked m JOIN shards s ON s.k = m.home
        )
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (j + greatest(0, least(g, (2 * g * (j + 1) + f - 1) // (2 * f))))::BIGINT AS slot, NULL::INT AS grown_shard FROM others
        UNION ALL
        SELECT doc_id, size::BIGINT, text_crc32::BIGINT, 'rows', home::INT, (r + f * (2 * r + 1) // (2 * g))::BIGINT, NULL::INT FROM grouped""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op11_substring_dedup": f"""
        WITH texts AS (
            SELECT doc_id, {_WORDS} AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS key FROM texts, unnest(range(1, greatest(len(w) - 18, 1))) AS t(i)
        ), repeats AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS i FROM repeats, unnest(range(0, 20)) AS t(k)
        ), listed AS (
            SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM texts LEFT JOIN listed USING (doc_id)""",
    "op12_filter_audit": f"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
        ), masks AS (
            SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS f
            FROM texts
        ), known AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
        ), counted AS (
            SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, f
        ), letters AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS t(c, k)
        ), orders AS (
            SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
        ), steps AS (
            SELECT filter_order, step::INT AS step, ks[step] AS own, ks[1:step - 1] AS prior FROM orders, unnest(range(1, 6)) AS t(step)
        ), placed AS (
            SELECT *, f[own] AS fails, len(list_filter(prior, lambda k: f[k])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS failed FROM counted, steps
        )
        SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
               coalesce(sum(n * (120 // greatest(failed, 1))) FILTER (fails), 0)::BIGINT AS shapley
        FROM placed GROUP BY part, filter_order, step""",
}
