"""Column expressions on text: labels, phrases, paths, model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def label_key(c: Column) -> Column:
    return F.upper(strip(c))


def phrase(c: Column) -> Column:
    """Lower-cased, runs of white space as one space."""
    return strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def token_key(c: Column) -> Column:
    """Lower-cased, all but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def has_phrase(c: Column, p: Column) -> Column:
    """Whether phrase p stands in c with no a-z or 0-9 next to it."""
    return F.call_function("rlike", c, F.concat(F.lit(r"(?<![a-z0-9])\Q"), p, F.lit(r"\E(?![a-z0-9])")))


def clean_span(c: Column) -> Column:
    """Right end trimmed, double quotes to single, en dash to em dash, one trailing slash or full stop dropped."""
    quoted = F.translate(F.regexp_replace(c, r"\s+$", ""), "“”\"–", "'''—")
    return F.regexp_replace(quoted, r"[/.]$", "")


def joined_spans(c: Column, spans: Column) -> Column:
    """Parts of c by 0-based, half-open [begin, end) pairs, joined by spaces."""
    return F.array_join(F.transform(spans, lambda s: F.substring(c, F.get(s, 0) + 1, F.get(s, 1) - F.get(s, 0))), " ")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/]*$", 0)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def yes_no(c: Column) -> Column:
    """'yes' or 'no' if just one of the two stands in the text as a word; null otherwise."""
    low = F.lower(F.trim(c))
    yes, no = low.rlike(r"\byes\b"), low.rlike(r"\bno\b")
    return F.when(yes & ~no, "yes").when(no & ~yes, "no")


def without_think(c: Column, strict: bool = False) -> Column:
    """c without what models think aloud. strict: a reply of which nothing is left fails the job."""
    left = strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    return F.when((left == "") & c.isNotNull(), F.raise_error(F.lit("a reply holds thinking alone")).cast("string")).otherwise(left) if strict else left


def absolute(path: Column, root: str) -> Column:
    """path as it is if it begins with a slash, else under root; null and empty paths as they are."""
    return F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def without_fence(c: Column) -> Column:
    """The inside of the first ``` fence, whatever its language; the text itself where there is none."""
    inside = F.regexp_extract(c, r"(?s)```[A-Za-z0-9_+-]*[ \t]*\n?(.*?)```", 1)
    return strip(F.when(c.rlike(r"(?s)```.*?```"), inside).otherwise(c))


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def without_augment_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)_aug\d+$", "")


def is_augmented(c: Column) -> Column:
    return c.rlike(r"(?i)_aug\d+$")


def label_line(category: Column, b: tuple[Column, ...]) -> Column:
    """A label line: category without spaces, three zeros, the box in two digits, seven zeros."""
    two = [F.format_string("%.2f", c.cast("double")) for c in b]
    return F.concat_ws(" ", F.regexp_replace(category, " ", ""), *[F.lit("0.00"), F.lit("0"), F.lit("0.00")], *two, *[F.lit("0.00")] * 7)


def noun_chunks(chunks: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(chunks, lambda x: F.trim(x)), lambda x: x != ""))


def phrase_boxes(line: Column) -> Column:
    """`phrase: [[x1, y1, x2, y2], ...]` as a struct (phrase, boxes); boxes without four numbers go."""
    rest = F.from_json(F.regexp_extract(line, r":\s*(\[\[.*\]\])\s*$", 1), "array<array<double>>")
    return F.struct(F.trim(F.regexp_extract(line, r"^(.*?):\s*\[\[", 1)).alias("phrase"), F.filter(rest, lambda b: F.size(b) == 4).alias("boxes"))


def phrase_boxes_text(name: Column, boxes: Column) -> Column:
    inner = F.transform(boxes, lambda b: F.concat(F.lit("["), F.array_join(F.transform(b, lambda x: x.cast("string")), ", "), F.lit("]")))
    return F.concat(name, F.lit(": ["), F.array_join(inner, ", "), F.lit("]"))


def fill_template(template: str, **values: Column) -> Column:
    """template with {names} filled in; an unknown name is an error when the plan is made."""
    parts = re.split(r"\{(\w+)\}", template)
    if missing := set(parts[1::2]) - set(values):
        raise ValueError(f"no value for {sorted(missing)}")
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p].cast("string") for i, p in enumerate(parts)])


#: Tasks by what a prompt key contains, the first that fits; other keys are open questions.
TASKS = ["causal_linkage", "temporal_event_desc", "scene_description", "event_summary", "temporal_localization", "mcq", "bcq"]


def task_of(key: Column) -> Column:
    out = None
    for task in TASKS:
        out = F.when(key.contains(task), task) if out is None else out.when(key.contains(task), task)
    return out.otherwise("open_qa")


def short_answer(answer: Column) -> Column:
    """Yes or No where an answer begins so; else the answer."""
    low = F.lower(F.regexp_replace(strip(answer), r"\.+$", ""))
    return F.when(low.startswith("yes"), "Yes").when(low.startswith("no"), "No").otherwise(answer)


def letter_answer(answer: Column, choices: Column) -> Column:
    """`X. text` of the choice that an answer's letter names; an answer of that form, or without a choice, as it is."""
    raw = strip(answer)
    letter = F.concat(F.substring(F.upper(raw), 1, 1), F.lit("."))
    found = F.get(F.filter(choices, lambda c: c.startswith(letter)), 0)
    return F.when((raw == "") | raw.rlike(r"^[A-Z]\.\s+\S"), raw).otherwise(F.coalesce(strip(found), raw))


def time_range(answer: Column) -> Column:
    """`Start_Time: a, End_Time: b` (names and stamps: fixed values) as JSON with start and end; other answers as they are."""
    stamp = r"((?:\d{2}:)?\d{2}:\d{2}(?:\.\d+)?)"
    pattern = r"(?i)Start_Time:\s*" + stamp + r",?\s*End_Time:\s*" + stamp
    made = F.to_json(F.struct(F.regexp_extract(answer, pattern, 1).alias("start"), F.regexp_extract(answer, pattern, 2).alias("end")))
    return F.when(answer.rlike(pattern), made).otherwise(answer)


def chunk_text(chunks: Column) -> Column:
    """Chunks (index, start, end, caption) as text, one decimal for seconds, parted by rules (form and rule: fixed values)."""
    one = lambda c: F.format_string("Chunk %d (%.1f-%.1fs): %s", c["index"], c["start"], c["end"], c["caption"])
    return F.array_join(F.transform(chunks, one), "\n\n---\n\n")


def question_text(question: Column, kind: Column, choices: Column) -> Column:
    """A question with its choices and what to answer (a fixed value), for mcq; others as they are."""
    listed = F.when(F.size(choices) > 0, F.concat(F.lit("\n"), F.array_join(choices, "\n"))).otherwise("")
    return F.when(kind == "mcq", F.concat(question, listed, F.lit("\nAnswer with the option's letter from the given choices directly."))).otherwise(question)


def caption_list(raw: Column) -> Column:
    """Captions of a JSON text, a list of texts, a list of lists or plain text, trimmed; empty ones go."""
    nested, flat = F.from_json(raw, "array<array<string>>"), F.from_json(raw, "array<string>")
    single = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), 0)
    many = F.when(raw.rlike(r"^\s*\[\s*\["), F.flatten(nested)).when(raw.rlike(r"^\s*\["), flat).otherwise(F.array(F.when(raw.rlike('^\\s*"'), single).otherwise(raw)))
    return F.filter(F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))


def token_limit(limit: int | None, model: str = "") -> int:
    """A tokenizer's length limit where it makes sense (0 < limit < 1,000,000), else the model family's."""
    if limit is not None and 0 < limit < 1_000_000:
        return limit
    return 77 if "clip" in model.lower() and "siglip" not in model.lower() else 64


def permuted(question: Column, choices: Column, answer: Column) -> Column:
    """(choices, answer): `X. text` choices in an order that hangs on the question alone, lettered anew, and the answer's new
    letter. Of choices with one letter the last counts; fewer than two letters, or an answer that names none, change nothing.
    """
    letter = F.substring(F.upper(strip(answer)), 1, 1)
    named = F.filter(F.transform(choices, lambda c: F.struct(F.regexp_extract(c, r"^([A-Z])\.", 1).alias("l"), strip(F.regexp_extract(c, r"^[A-Z]\.\s*(.*)", 1)).alias("t"))), lambda x: x["l"] != "")
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["l"] == x["l"]))
    keyed = F.array_sort(F.transform(last, lambda x: F.struct(F.md5(F.concat_ws("|", question, x["l"], x["t"])).alias("h"), x["l"].alias("l"), x["t"].alias("t"))))
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    lettered = F.transform(keyed, lambda x, i: F.concat(F.get(letters, i), F.lit(". "), x["t"]))
    right = F.get(F.filter(keyed, lambda x: x["l"] == letter), 0)["t"]
    # Of choices alike in text the last carries the answer.
    at = F.size(keyed) - F.array_position(F.reverse(F.transform(keyed, lambda x: x["t"])), right).cast("int")
    able = (F.size(last) >= 2) & right.isNotNull()
    return F.struct(F.when(able, lettered).otherwise(choices).alias("choices"), F.when(able, F.get(letters, at)).otherwise(answer).alias("answer"))
