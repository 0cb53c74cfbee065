"""Queries of gap analysis over `events`: errors are positives, and answers are made of event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import gaps as G

from .registry import query
from .tables import table


def _scored(spark, sf):
    return table(spark, sf, "events").select((F.col("event_type") == "error").alias("positive"), F.round("value", 2).alias("score"), F.col("event_id").alias("id"))


_SWEEP = """WITH e AS (SELECT CAST(event_type = 'error' AS INTEGER) AS pos, round(value, 2) AS score FROM events),
    g AS (SELECT score, sum(pos) AS p, sum(1 - pos) AS n FROM e GROUP BY score),
    c AS (SELECT score AS threshold, CAST(coalesce(sum(p) OVER w, 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS pos FROM g
    WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) """


@query("threshold_table", _SWEEP + "SELECT * FROM c")
def _(spark, sf):
    return G.threshold_table(_scored(spark, sf))


@query(
    "optimal_threshold",
    _SWEEP + """, a AS (SELECT * FROM c UNION ALL SELECT min(score) - 1e-9, CAST(sum(pos) AS BIGINT), CAST(sum(1 - pos) AS BIGINT), CAST(sum(pos) AS BIGINT) FROM e),
    m AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, CASE WHEN pos > 0 THEN CAST(tp AS DOUBLE) / CAST(pos AS DOUBLE) ELSE 0 END AS r FROM a),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
    SELECT round(threshold, 6) AS threshold, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f WHERE r >= 0.5 - 1e-12 ORDER BY f.f1 DESC, p DESC, f.threshold DESC LIMIT 1""",
)
def _(spark, sf):
    best = G.optimal_threshold(_scored(spark, sf), 0.5)
    return best.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_WEAK = """WITH w AS (SELECT event_id AS id, label, weakness, row_number() OVER (PARTITION BY label ORDER BY weakness DESC, event_id) AS k FROM (
    SELECT *, CASE WHEN label = 'PASS' THEN round(value, 2) - 50 ELSE 50 - round(value, 2) END AS weakness FROM (
    SELECT event_id, value, CASE WHEN event_type = 'error' THEN 'NO_PASS' ELSE 'PASS' END AS label FROM events))) """


def _labelled(spark, sf):
    label = F.when(F.col("event_type") == "error", " no_pass").otherwise("Pass ")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), label.alias("label"), F.round("value", 2).alias("score"))


def _weak(spark, sf, k):
    return G.weakest(_labelled(spark, sf), 50.0, k)


@query("weakest_top_k_per_label", _WEAK + "SELECT id, label, round(weakness, 6) AS weakness, 'in/' || id || '_' || l || '.png' AS filepath FROM w, (VALUES ('ir'), ('rgb')) v(l) WHERE k <= 50")
def _(spark, sf):
    rows = _weak(spark, sf, 50).select("id", "label", F.round("weakness", 6).alias("weakness"), F.lit("in").alias("input_path"), F.col("id").cast("string").alias("object_name"))
    return G.lighting_paths(rows, ["ir", "rgb"]).select("id", "label", "weakness", "filepath")


@query("weak_breakdown", _WEAK + "SELECT label, count(*) AS cnt, count(*) FILTER (weakness > 0) AS misclassified, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM w GROUP BY label")
def _(spark, sf):
    return G.breakdown(G.with_weakness(_labelled(spark, sf), 50.0))


_ANSWER = "CASE WHEN {c} THEN 'Yes, it is.' WHEN {n} THEN '  NO' ELSE 'yes or no' END"


def _answers(spark, sf):
    e = table(spark, sf, "events")
    answer = lambda c, n: F.when(c, "Yes, it is.").when(n, "  NO").otherwise("yes or no")
    return e.select("event_id", answer(F.col("event_type") == "error", F.col("event_type") != "click").alias("response"), answer(F.col("value") > 60, F.col("value") < 40).alias("gt"))


_GAPS = f"""WITH a AS (SELECT event_id, {_ANSWER.format(c="event_type = 'error'", n="event_type <> 'click'")} AS response, {_ANSWER.format(c="value > 60", n="value < 40")} AS gt FROM events),
    y AS (SELECT *, CASE response WHEN 'Yes, it is.' THEN 'yes' WHEN '  NO' THEN 'no' END AS r, CASE gt WHEN 'Yes, it is.' THEN 'yes' WHEN '  NO' THEN 'no' END AS t FROM a),
    g AS (SELECT event_id, response, gt, CASE WHEN r = 'yes' THEN 'FP' ELSE 'FN' END AS gap FROM y WHERE r <> t) """


@query("yes_no_gaps", _GAPS + "SELECT * FROM g")
def _(spark, sf):
    return G.disagreements(_answers(spark, sf))


@query("yes_no_totals", _GAPS + "SELECT count(*) FILTER (gap = 'FP') AS fp, count(*) FILTER (gap = 'FN') AS fn, count(*) AS total FROM g")
def _(spark, sf):
    return G.gap_totals(G.disagreements(_answers(spark, sf)))
