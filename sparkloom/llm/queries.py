"""The registered queries of this subpackage, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, language, mixing, pii, quality_model, quality_rules, secret_scan, simhash, url_filter, warc
from .common import table

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LEVEL = """
{0}_k AS (SELECT coalesce(CASE WHEN sum(n) IS NULL OR sum(n * m * (1 - m)) <= 0 THEN 2.0 ELSE
    CASE WHEN sum(n * (b / n - m) ** 2) / sum(n) - sum(m * (1 - m)) / sum(n) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0,
      greatest(sum(n * m * (1 - m)) / sum(n) - sum(m * (1 - m)) / sum(n), 1e-12) / (sum(n * (b / n - m) ** 2) / sum(n) - sum(m * (1 - m)) / sum(n)) - 1)) END END, 2.0) AS k
  FROM {0} WHERE n >= 2)"""

#: SQL where it can express a query. The others rest on hashes, random ranks or trained models that it hasn't.
ORACLES: dict[str, str] = {
    "op4_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, count(*) OVER (PARTITION BY html) AS n FROM p),
digits AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1), '' ORDER BY i) AS b32
  FROM (SELECT DISTINCT hex FROM p), range(32) AS r(i) GROUP BY hex
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM best JOIN digits USING (hex)
""",
    "op5_url_filter": """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
pg AS (SELECT page_id, coalesce(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
              coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM raw),
rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hit AS (SELECT page_id, pg.host, pg.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS said
  FROM pg LEFT JOIN rules r ON (pg.host = r.host OR ends_with(pg.host, '.' || r.host)) AND starts_with(pg.path, r.path) GROUP BY ALL),
seen AS (SELECT host, greatest(CASE WHEN quality = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END, CASE WHEN toxic = 1 THEN 1 WHEN toxic IS NOT NULL THEN 0 END) AS bad
  FROM pg JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '^/[^/]*/([0-9]{1,18})', 1) AS BIGINT)),
bare AS (SELECT DISTINCT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS name FROM pg),
parts AS (SELECT host, name, string_split(name, '.') AS w, regexp_matches(name, '^([0-9]+(\\.[0-9]+){3}|\\[.*)$') AS num FROM bare),
cuts AS (SELECT *, CASE WHEN len(w) >= 3 AND length(w[-1]) = 2 AND w[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS c FROM parts),
named AS (SELECT host, CASE WHEN num THEN name ELSE array_to_string(w[greatest(len(w) - c + 1, 1):], '.') END AS suffix,
                 CASE WHEN num THEN name ELSE array_to_string(w[greatest(len(w) - c, 1):], '.') END AS domain FROM cuts),
counts AS (SELECT host, suffix, domain, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS b FROM named LEFT JOIN seen USING (host) GROUP BY ALL),
base AS (SELECT CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) ELSE 0 END AS share FROM counts),
sx AS (SELECT suffix, CAST(sum(n) AS DOUBLE) AS n, sum(b) AS b, any_value(share) AS m FROM counts, base GROUP BY suffix),""" + _LEVEL.format("sx") + """,
dm AS (SELECT domain, suffix, CAST(sum(c.n) AS DOUBLE) AS n, sum(c.b) AS b, any_value((sx.b + k * m) / (sx.n + k)) AS m FROM counts c JOIN sx USING (suffix), sx_k GROUP BY ALL),""" + _LEVEL.format("dm") + """,
hs AS (SELECT host, CAST(c.n AS DOUBLE) AS n, c.b AS b, (dm.b + k * m) / (dm.n + k) AS m FROM counts c JOIN dm USING (domain), dm_k),""" + _LEVEL.format("hs") + """,
post AS (SELECT host, (b + k * m) / (n + k) AS mean, n + k AS weight FROM hs, hs_k),
bad AS (SELECT host FROM post, base WHERE greatest(0, mean - 0.5 * sqrt(mean * (1 - mean) / (weight + 1))) > share)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM hit
""",
    "op10_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM sized
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item, n, i FROM places JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
}


def op1_quality_classifier(spark, sf_dir):
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_warc_archives(spark, sf_dir):
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url", "payload")


#: The contract's rules.
RULES = [
    url_filter.rule("block", "com/en/"),
    url_filter.rule("allow", "example.com/en/7"),
    url_filter.rule("allow", "net/de/"),
    url_filter.rule("block", "example.net/de/8"),
    url_filter.rule("block", "org/es/"),
]


def op5_url_filter(spark, sf_dir):
    """Outcomes come from `labels`: a page's url names the document it shows (`/en/7817`); bad is quality 0 or toxic 1."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0), F.when(F.col("toxic") == 1, 1).when(F.col("toxic").isNotNull(), 0))
    shown = F.regexp_extract(url_filter.host_path(F.col("url"))[1], "^/[^/]*/([0-9]{1,18})", 1).try_cast("long")
    return url_filter.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("key"), bad.alias("bad")), RULES, key=shown)


def op6_personal_data(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark, sf_dir):
    return mixing.sample(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_verdict(decontaminate.hits(docs, table(spark, sf_dir, "benchmark")))
    return found.select("_all.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_simhash_near_dedup, op3_quality_rules, op4_warc_archives, op5_url_filter,
        op6_personal_data, op7_language_id, op8_mix_sources, op9_secret_scan, op10_decontaminate,
    )
}
