"""Queries of nearest neighbours and assignment over `embeddings`.

In searches every vector whose id is divisible by 50 is a target, and all vectors are sources. In assignment and distance
statistics, where a target would be its own nearest source, the other vectors are the sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.operators import neighbors as N

from .registry import query
from .tables import table

_KNN = """WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT t.vec_id AS target, s.vec_id AS source, round({d}, 9) AS distance FROM t, s),
    k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, source) AS rank FROM d) """
_L2 = "sqrt(list_sum(list_transform(list_zip(t.v, s.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
_L1 = "list_sum(list_transform(list_zip(t.v, s.v), lambda x: abs(x[1] - x[2])))"
_COS = "1 - list_dot_product(t.v, s.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(s.v, s.v)))"
_TOP = "SELECT target, rank, source, round(distance, 6) AS distance FROM k WHERE rank <= 5"


def sides(spark, sf, apart=False):
    """Targets and sources; apart: no target among the sources."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    return rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "target"), (rows.filter("vec_id % 50 <> 0") if apart else rows).withColumnRenamed("vec_id", "source")


def _knn(metric):
    def run(spark, sf):
        return N.exact_pairs(*sides(spark, sf), 5, metric, 9).withColumn("distance", F.round("distance", 6))

    return run


for _name, _d in (("euclidean", _L2), ("cosine", _COS), ("manhattan", _L1)):
    query(f"knn_{_name}", _KNN.format(d=_d) + _TOP)(_knn(_name))


@query("knn_blocks", _KNN.format(d=_L2) + _TOP)
def _(spark, sf):
    return N.nearest(*sides(spark, sf), 5, digits=9).withColumn("distance", F.round("distance", 6))


@query(
    "knn_label_distance_filtered",
    _KNN.format(d=_L2)
    + """SELECT source, round(min(distance), 6) AS distance FROM k JOIN embeddings a ON a.vec_id = target JOIN embeddings b ON b.vec_id = source
    WHERE rank <= 5 AND a.label = b.label AND distance <= 1.3 GROUP BY source""",
)
def _(spark, sf):
    t, s = sides(spark, sf)
    pairs = N.exact_pairs(t, s, 5, "euclidean", 9)
    got = N.mine(pairs, (t.select("target", "label"), s.select("source", "label")), 1.3)
    return got.withColumn("distance", F.round("distance", 6))


@query("l2_normalized_vectors", "SELECT vec_id, i - 1 AS pos, round(CAST(embedding[i] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12), 6) AS x FROM embeddings, generate_series(1, 64) g(i)")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(
    "distance_stats_by_class",
    _KNN.format(d=_L2).replace("FROM t, s)", "FROM t, s WHERE s.vec_id % 50 <> 0)")
    + """, one AS (SELECT target, distance FROM k WHERE rank = 1), r AS (SELECT CAST(label AS VARCHAR) AS type, distance FROM one JOIN embeddings ON vec_id = target UNION ALL SELECT 'overall', distance FROM one)
    SELECT type, count(*) AS cnt, round(min(distance), 6) AS min, round(max(distance), 6) AS max, round(avg(distance), 6) AS mean, round(quantile_cont(distance, 0.5), 6) AS median,
    round(stddev_pop(distance), 6) AS std, round(quantile_cont(distance, 0.25), 6) AS p25, round(quantile_cont(distance, 0.75), 6) AS p75 FROM r GROUP BY type""",
)
def _(spark, sf):
    t, s = sides(spark, sf, True)
    return N.distance_stats(N.exact_pairs(t, s, 5, "euclidean", 9), t.select("target", F.col("label").cast("string").alias("type")))


@query(
    "largest_remainder_quota",
    """WITH r AS (SELECT CAST(label AS VARCHAR) AS name, count(*) * 100.0::DOUBLE AS x0 FROM embeddings GROUP BY label), x AS (SELECT name, x0 / (sum(x0 / 100) OVER ()) AS x FROM r),
    f AS (SELECT name, floor(x) AS fl, round(x - floor(x), 12) AS rem FROM x), k AS (SELECT *, row_number() OVER (ORDER BY rem DESC, name DESC) AS k, 100 - sum(fl) OVER () AS lft FROM f)
    SELECT name, CAST(fl + CASE WHEN k <= lft THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k""",
)
def _(spark, sf):
    ratios = table(spark, sf, "embeddings").groupBy(F.col("label").cast("string").alias("name")).agg(F.count("*").cast("double").alias("ratio"))
    return N.quotas(ratios, 100)


@query("unique_assignment_global")
def _(spark, sf):
    return spark.createDataFrame(N.assign(*sides(spark, sf, True), 120), "source long, distance double")


@query("unique_assignment_stratified")
def _(spark, sf):
    t, s = (df.withColumn("classes", F.array(F.concat(F.lit("Class"), F.col("label")))) for df in sides(spark, sf, True))
    return spark.createDataFrame(N.assign_stratified(t, s, 80, ["class1", "CLASS7", "class3"]), "type string, source long, distance double")


@query(
    "exclude_by_path_or_name",
    """WITH gone AS (SELECT url FROM pages WHERE page_id % 7 = 0) SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM gone)
    AND regexp_extract(url, '[^/]*$') NOT IN (SELECT regexp_extract(url, '[^/]*$') FROM gone)""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return N.exclude(pages, pages.filter("page_id % 7 = 0"), "url")


@query(
    "rare_class_presence",
    """WITH per AS (SELECT l_orderkey % 500 AS i, list_distinct(list(lower(l_returnflag))) AS c FROM lineitem GROUP BY 1), h AS (SELECT len(list_filter(c, lambda x: x IN ('a', 'r'))) AS h FROM per)
    SELECT count(*) FILTER (h > 0) AS rare_images, count(*) FILTER (h = 0) AS common_images, CAST(sum(h) AS BIGINT) AS rare_instances FROM h""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("image_id"), F.col("l_returnflag").alias("type"))
    return N.class_presence(rows, ["A", "R"])


@query("class_image_counts", "SELECT l_returnflag AS type, count(DISTINCT l_orderkey % 500) AS image_count, count(*) AS instance_count FROM lineitem GROUP BY 1")
def _(spark, sf):
    return N.class_counts(table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("image_id"), F.col("l_returnflag").alias("type")))
