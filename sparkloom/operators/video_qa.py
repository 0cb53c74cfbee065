"""Questions on videos: captions of several steps merged, prompts fanned out, replies parsed into tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text, video
from sparkloom.operators import enrich
from sparkloom.operators.datasets import latest_step

#: What each task asks of an answer.
INSTRUCTIONS = {
    "mcq": "Answer with a single letter.",
    "mcq_openended": "Answer with the correct option letter followed by a brief explanation.",
    "bcq": "Answer with Yes or No.",
    "bcq_openended": "Answer with Yes or No followed by a brief explanation.",
    "temporal_localization": 'Answer with the start and end timestamps in the format {"start": "MM:SS", "end": "MM:SS"}.',
}
#: Tasks whose items go by another name.
NAMES = {"temporal_event_desc": "temporal_description", "event_summary": "video_summarization"}


def with_chunks(videos: DataFrame, length: str = "video_length") -> DataFrame:
    """A row for each chunk of a video: chunk_index, timestamp_start, timestamp_end."""
    size = video.chunk_seconds(F.col(length))
    rows = videos.withColumn("_c", F.explode(video.chunks(F.col(length), size)))
    return rows.select(*videos.columns, F.col("_c.index").alias("chunk_index"), F.col("_c.start").alias("timestamp_start"), F.col("_c.end").alias("timestamp_end"))


def highlight_from_reply(entries: DataFrame, reply: str = "reply", length: str = "video_length", before: float = 3.0, after: float = 3.0) -> DataFrame:
    """entries with highlight_start and highlight_end about the first number of a reply; null where there is none."""
    at = F.greatest(F.lit(0.0), F.least(text.first_number(F.col(reply)), F.col(length)))
    start, end = video.highlight(at, F.col(length), before, after)
    known = text.first_number(F.col(reply)).isNotNull()
    return entries.withColumns({"highlight_start": F.when(known, start), "highlight_end": F.when(known, end)})


def merged_steps(steps: list[DataFrame], fields: list[str], key: str = "video") -> DataFrame:
    """One row a video with each field of the latest step that has it."""
    rows = None
    for i, s in enumerate(steps):
        part = s.select(key, F.lit(i).alias("_step"), *[(F.col(f) if f in s.columns else F.lit(None)).cast("string").alias(f) for f in fields])
        rows = part if rows is None else rows.unionAll(part)
    return latest_step(rows, key, "_step", fields)


def prompt_keys(entries: DataFrame, qa_types: list[str], default_mode: str = "normal") -> DataFrame:
    """A row for each question type of a video, with prompt_key `<mode>_<type>`; mode auto counts as normal."""
    mode = F.coalesce(F.col("mode"), F.lit(default_mode)) if "mode" in entries.columns else F.lit(default_mode)
    mode = F.when(mode == "auto", "normal").otherwise(mode)
    return entries.withColumn("prompt_key", F.explode(F.array(*[F.concat(mode, F.lit("_" + t)) for t in qa_types])))


def ask(entries: DataFrame, prompt: str, factory: Callable[[], enrich.Model], done: DataFrame | None = None) -> DataFrame:
    """Replies (qa_output) to prompts by (video, prompt_key), skipping what is done; failed and empty ones go."""
    return enrich.resume(entries, done, ["video", "prompt_key"], lambda df: enrich.usable(enrich.enrich(df, prompt, "qa_output", factory), "qa_output"))


def task_items(replies: DataFrame, root: str = "") -> DataFrame:
    """(task, video_id, question, answer, reasoning) of replies (video, prompt_key, qa_output).

    A choice question gives an mcq and an mcq_openended item if it has choices and a letter; a yes/no question a bcq and
    a bcq_openended item if its answer is one; times become JSON; other questions and answers pass as they are.
    """
    rows = enrich.with_questions(replies, "qa_output").select("video", text.task_of(F.col("prompt_key")).alias("bucket"), F.explode("questions").alias("q"))
    vid = F.when(F.col("video").startswith(root.rstrip("/") + "/"), F.substring("video", len(root.rstrip("/")) + 2, 1 << 30)).otherwise(F.col("video")) if root else F.col("video")
    choices = F.when(F.size("q.choices") > 0, F.concat(F.col("q.question"), F.lit("\n"), F.array_join("q.choices", "\n")))
    letter, short = F.substring(F.upper(text.strip(F.col("q.answer"))), 1, 1), text.short_answer(F.col("q.answer"))
    item = lambda ok, task, q, a: F.when(ok, F.struct(F.lit(task).alias("task") if isinstance(task, str) else task.alias("task"), q.alias("question"), a.alias("answer")))
    asked = lambda q, task: F.concat(q, F.lit("\n" + INSTRUCTIONS[task]))
    b, plain = F.col("bucket"), F.col("q.question")
    mcq_ok, bcq_ok = (b == "mcq") & choices.isNotNull() & (letter != ""), (b == "bcq") & short.isin("Yes", "No")
    every = F.array(
        item(mcq_ok, "mcq", asked(choices, "mcq"), letter),
        item(mcq_ok, "mcq_openended", asked(choices, "mcq_openended"), text.letter_answer(F.col("q.answer"), F.col("q.choices"))),
        item(bcq_ok, "bcq", asked(plain, "bcq"), short),
        item(bcq_ok, "bcq_openended", asked(plain, "bcq_openended"), F.col("q.answer")),
        item(b == "temporal_localization", "temporal_localization", asked(plain, "temporal_localization"), text.time_range(F.col("q.answer"))),
        item(~b.isin("mcq", "bcq", "temporal_localization"), F.coalesce(*[F.when(b == k, v) for k, v in NAMES.items()], b), plain, F.col("q.answer")),
    )
    out = rows.withColumn("i", F.explode(F.filter(every, lambda x: x.isNotNull())))
    return out.select("i.task", vid.alias("video_id"), "i.question", "i.answer", F.col("q.reasoning").alias("reasoning"))


def parse_stats(replies: DataFrame) -> DataFrame:
    """One row: replies, those with questions, those without, and empty ones."""
    n = F.size("questions")
    rows = enrich.with_questions(replies, "qa_output")
    empty = F.coalesce(F.trim("qa_output") == "", F.lit(True))
    return rows.agg(F.count("*").alias("total"), F.count_if(n > 0).alias("ok"), F.count_if((n == 0) & ~empty).alias("failed"), F.count_if(empty).alias("skipped"))
