"""Queries of text functions, reply parsers and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import enrich as E

from .registry import query
from .tables import table


@query(
    "label_text",
    """SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem,
    trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS token_key, upper(trim('  ' || url || ' ')) AS label_key FROM pages""",
)
def _(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.basename(url).alias("base"), T.stem(url).alias("stem"), T.token_key(url).alias("token_key"), T.label_key(F.concat(F.lit("  "), url, F.lit(" "))).alias("label_key"))


@query("phrase_normalize", "SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS phrase FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.phrase(F.col("text")).alias("phrase"))


@query("phrase_boundary", "SELECT item_id, regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9]the[^a-z0-9]') AS has_the FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.has_phrase(F.lower("text"), F.lit("the")).alias("has_the"))





@query("reply_cleanup", "SELECT item_id, '{\"n\": ' || item_id || '.5}' AS inner_text, item_id + 0.5::DOUBLE AS number FROM benchmark")
def _(spark, sf):
    reply = F.concat(F.lit('<think>x\n y</think> ```json\n{"n": '), "item_id", F.lit(".5}\n``` bye"))
    inner = T.without_fence(T.without_think(reply))
    return table(spark, sf, "benchmark").select("item_id", inner.alias("inner_text"), T.first_number(inner).alias("number"))


@query("span_text", "SELECT item_id, substr(text, 3, 5) || ' ' || substr(text, 11, 4) AS spans, regexp_replace(translate(rtrim(text), '\"', ''''), '[/.]$', '') AS cleaned FROM benchmark")
def _(spark, sf):
    spans = F.array(F.array(F.lit(2), F.lit(7)), F.array(F.lit(10), F.lit(14)))
    return table(spark, sf, "benchmark").select("item_id", T.joined_spans(F.col("text"), spans).alias("spans"), T.clean_span(F.col("text")).alias("cleaned"))


@query("augment_suffix", "SELECT p_partkey, 'img' || p_partkey AS person, p_partkey % 2 = 0 AS augmented FROM part")
def _(spark, sf):
    name = F.concat(F.lit("img"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.lit("_aug3")).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", T.without_augment_suffix(name).alias("person"), T.is_augmented(name).alias("augmented"))


@query("prompt_tasks", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'temporal_localization' WHEN 1 THEN 'mcq' WHEN 2 THEN 'bcq' ELSE 'open_qa' END AS task FROM orders")
def _(spark, sf):
    key = F.element_at(F.array(*[F.lit(x) for x in ("anomaly_temporal_localization", "normal_mcq", "bcq_x", "zzz")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.task_of(key).alias("task"))


@query(
    "answer_forms",
    """SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'maybe' END AS short, CASE WHEN item_id % 2 = 0 THEN 'B. two' ELSE 'C. other text' END AS letter,
    CASE WHEN item_id % 2 = 0 THEN '{"start":"00:01","end":"01:02:03.5"}' ELSE 'later' END AS range_text FROM benchmark""",
)
def _(spark, sf):
    i = F.col("item_id")
    short = F.when(i % 3 == 0, " yes, it is.").when(i % 3 == 1, "NO.").otherwise("maybe")
    letter = F.when(i % 2 == 0, " b ").otherwise("C. other text")
    when = F.when(i % 2 == 0, "Start_Time: 00:01, end_time: 01:02:03.5").otherwise("later")
    choices = F.array(F.lit("A. one"), F.lit("B. two"))
    return table(spark, sf, "benchmark").select("item_id", T.short_answer(short).alias("short"), T.letter_answer(letter, choices).alias("letter"), T.time_range(when).alias("range_text"))


@query("chunk_text", "SELECT item_id, 'Chunk 0 (0.0-' || item_id || '.5s): a\n\n---\n\nChunk 1 (' || item_id || '.5-9.0s): b' AS chunks FROM benchmark")
def _(spark, sf):
    half = F.col("item_id") + F.lit(0.5)
    one = lambda i, a, b, c: F.struct(F.lit(i).alias("index"), a.alias("start"), b.alias("end"), F.lit(c).alias("caption"))
    chunks = F.array(one(0, F.lit(0.0), half, "a"), one(1, half, F.lit(9.0), "b"))
    return table(spark, sf, "benchmark").select("item_id", T.chunk_text(chunks).alias("chunks"))


@query("caption_lists", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'c|d|e' ELSE 'plain' END AS captions FROM benchmark")
def _(spark, sf):
    i = F.col("item_id")
    raw = F.when(i % 3 == 0, '[" a ", "", "b"]').when(i % 3 == 1, '[["c"], ["d", " e"]]').otherwise(" plain ")
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.caption_list(raw), "|").alias("captions"))


@query("template_fill", "SELECT item_id, 'Item ' || item_id || ' says: ' || text AS prompt FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.fill_template("Item {i} says: {t}", i=F.col("item_id"), t=F.col("text")).alias("prompt"))


@query("phrase_boxes", "SELECT item_id, 'thing ' || item_id AS phrase, CAST(1 AS BIGINT) AS n, CAST(item_id AS DOUBLE) AS x1 FROM benchmark")
def _(spark, sf):
    line = F.concat(F.lit("thing "), "item_id", F.lit(": [["), "item_id", F.lit(", 2, 3.5, 4], [1, 2]]"))
    rows = table(spark, sf, "benchmark").select("item_id", T.phrase_boxes(line).alias("b"))
    return rows.select("item_id", "b.phrase", F.size("b.boxes").cast("bigint").alias("n"), F.col("b.boxes")[0][0].alias("x1"))


@query(
    "mcq_permute",
    """WITH c AS (SELECT item_id, text, i, chr(CAST(65 + i AS INTEGER)) AS l, 'word ' || split_part(text, ' ', CAST(i + 1 AS INTEGER)) || i AS raw, trim(regexp_extract(raw, '^[^\n]*')) AS t FROM benchmark, generate_series(0, item_id % 4) g(i)),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5(concat_ws('|', text, l, t)), l) AS k, count(*) OVER (PARTITION BY item_id) AS n FROM c),
    a AS (SELECT item_id, CASE WHEN count(*) < 2 THEN any_value(l || '. ' || raw) ELSE string_agg(chr(CAST(64 + k AS INTEGER)) || '. ' || t, ';' ORDER BY k) END AS choices, any_value(n) AS n, max(CASE WHEN l = 'B' THEN chr(CAST(64 + k AS INTEGER)) END) AS answer FROM o GROUP BY item_id)
    SELECT item_id, choices, CASE WHEN n >= 2 THEN answer ELSE 'b) the second' END AS answer FROM a""",
)
def _(spark, sf):
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    choice = lambda i: F.concat(F.get(letters, i), F.lit(". word "), F.get(F.split("text", " "), i), i.cast("string"))
    choices = F.transform(F.sequence(F.lit(0), (F.col("item_id") % 4).cast("int")), choice)
    rows = table(spark, sf, "benchmark").select("item_id", T.permuted(F.col("text"), choices, F.lit("b) the second")).alias("p"))
    return rows.select("item_id", F.array_join("p.choices", ";").alias("choices"), "p.answer")


@query("qa_parse", "SELECT item_id, 'mcq' AS type, text AS question, CAST(2 AS BIGINT) AS n_choices, 'B' AS answer, 'because ' || item_id AS reasoning FROM (SELECT item_id, trim(text, E' \\n\\t') AS text FROM benchmark)")
def _(spark, sf):
    reply = F.concat(F.lit("intro\n======\nMultiple-Choice Question: "), "text", F.lit("\nA. one\nB. two\n=====\nAnswer: B\n=======\nReasoning: because "), "item_id")
    rows = E.with_questions(table(spark, sf, "benchmark").select("item_id", reply.alias("reply")), "reply").select("item_id", F.explode("questions").alias("q"))
    return rows.select("item_id", "q.type", "q.question", F.size("q.choices").cast("bigint").alias("n_choices"), "q.answer", "q.reasoning")


def _echo():
    return lambda prompts: [f"{len(p)} characters" for p in prompts]


@query("llm_enrich_fake", "SELECT item_id, length(text) || ' characters' AS reply FROM benchmark")
def _(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", "text")
    done = rows.filter("item_id < 5").select("item_id", F.concat(F.length("text"), F.lit(" characters")).alias("reply"))
    return E.resume(rows, done, ["item_id"], lambda df: E.usable(E.enrich(df, "text", "reply", _echo), "reply"))


@query("anomaly_gate", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'anomaly' ELSE 'normal' END AS mode FROM benchmark WHERE item_id % 2 = 0")
def _(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, " Yes, it is").otherwise("No").alias("asked"), F.when(F.col("item_id") % 3 == 0, "so\nAnomaly: x").otherwise("anomaly\nnone").alias("verdict"))
    return E.anomaly_gate(rows, "asked", "verdict").select("item_id", "mode")
