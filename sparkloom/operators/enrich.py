"""Resumable enrichment of records by model calls, and parsers of what models reply.

A model is any function from a list of prompts to a list of replies. Its client is made once per partition by a factory,
calls go in batches, and rows that an earlier run has finished are left out by an anti-join.
"""

from __future__ import annotations

import ast
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.datasets import pending

Model = Callable[[list[str]], list[str]]
FAILED = "[FAILED]"


def with_retry(call: Callable[[], list[str]], tries: int = 3, wait: float = 5.0, linear: bool = True, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """call's result; after an error it is tried again, after wait (times the number of tries so far, if linear)."""
    for i in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if i == tries:
                raise
            sleep(wait * i if linear else wait)
    raise AssertionError


def enrich(df: DataFrame, prompt: str, out: str, factory: Callable[[], Model], batch: int = 16, tries: int = 3, wait: float = 5.0) -> DataFrame:
    """df with column `out`, the model's reply to column `prompt`; a batch that fails to the end gets FAILED. Null
    prompts get null."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in frames:
            replies: list[str | None] = [None] * len(pdf)
            todo = [i for i, p in enumerate(pdf[prompt]) if p is not None]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                model = model or factory()
                try:
                    got = with_retry(lambda: model([pdf[prompt].iloc[i] for i in part]), tries, wait)  # noqa: B023
                except Exception:
                    got = [FAILED] * len(part)
                for i, r in zip(part, got):
                    replies[i] = r
            yield pdf.assign(**{out: replies})

    return df.mapInPandas(run, schema)


def resume(df: DataFrame, done: DataFrame | None, keys: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step's results for rows that `done` lacks, and those of done that did not fail."""
    if done is None:
        return step(df)
    return done.unionByName(step(pending(df, done, keys)).select(*done.columns))


def usable(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.trim(column) != "") & (F.col(column) != FAILED))


def loose_json(reply: str | None):
    """What a reply holds as JSON: itself, a Python literal, or its outermost braces or brackets; None if nothing parses."""
    text = re.sub(r"(?s)^.*?```[A-Za-z]*\s*(.*?)```.*$", r"\1", reply or "").strip()
    inner = [m[0] for p in (r"(?s)\{.*\}", r"(?s)\[.*\]") if (m := re.search(p, text))]
    for part in (text, *sorted(inner, key=len, reverse=True)):
        for parse in (json.loads, ast.literal_eval):
            try:
                return parse(part)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                pass
    return None


def whole_objects(reply: str | None) -> list[dict]:
    """Objects of a JSON array, of lines of JSON, or of an array that was cut off: all that are whole."""
    got = loose_json(reply)
    if isinstance(got, list):
        return [x for x in got if isinstance(x, dict)]
    if isinstance(got, dict):
        return [got]
    found, at, reader = [], 0, json.JSONDecoder()
    text = reply or ""
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = reader.raw_decode(text, at)
            found.append(value)
        except ValueError:
            at += 1
    return found


_HEAD = re.compile(r"^(?:\d+\.\s*)?(multiple-choice question|open-ended question|question):\s*", re.I)
_KIND = {"multiple-choice question": "mcq", "open-ended question": "openended", "question": "binary"}


def parse_qa(reply: str | None) -> list[dict]:
    """Questions of a reply: blocks parted by five or more `=`, with type, question, choices, answer and reasoning."""
    out: list[dict] = []
    for part in filter(None, (p.strip() for p in re.split(r"\n?={5,}\n?", reply or ""))):
        if m := _HEAD.match(part):
            entry = {"type": _KIND[m[1].lower()], "question": "", "choices": [], "answer": "", "reasoning": ""}
            body = part[m.end() :]
            split = re.search(r"\n(?=A\.)", body)
            rest = body[split.end() :] if split else ""
            entry["question"] = (body[: split.start()] if split else body).strip()
            entry["choices"] = [x.strip() for x in rest.split("\n") if re.match(r"[A-Z]\.\s+\S", x.strip())]
            if a := re.search(r"(?im)^answer:\s*(.*)$", rest):
                entry["answer"] = a[1].strip()
            if r := re.search(r"(?is)(?:^|\n)reasoning:\s*(.*)$", rest):
                entry["reasoning"] = r[1].strip()
            out.append(entry)
        elif out and (m := re.match(r"(?is)answer:\s*(.*)$", part)):
            answer, _, reasoning = re.split(r"(?i)(\nreasoning:)", m[1] + "", maxsplit=1) if re.search(r"(?i)\nreasoning:", m[1]) else (m[1], "", "")
            out[-1]["answer"] = answer.strip()
            out[-1]["reasoning"] = out[-1]["reasoning"] or reasoning.strip()
        elif out and (m := re.match(r"(?is)reasoning:\s*(.*)$", part)):
            out[-1]["reasoning"] = m[1].strip()
    return out


QA_TYPE = "array<struct<type: string, question: string, choices: array<string>, answer: string, reasoning: string>>"


def with_questions(df: DataFrame, reply: str, out: str = "questions") -> DataFrame:
    parse = F.pandas_udf(lambda s: s.map(parse_qa), QA_TYPE)
    return df.withColumn(out, parse(F.col(reply)))


def reconcile(before: list[dict], after: list[dict]) -> list[dict]:
    """Checked expressions: matched by text; a box that stays keeps its id and score, else the one at its place, else a new
    one with 0.9; expressions left without boxes go."""
    old = {e["text"]: e for e in before}
    out, new = [], 0
    for e in after:
        known = old.get(e["text"], {}).get("instances", [])
        instances = []
        for i, box in enumerate(e.get("boxes", [])):
            same = next((k for k in known if k["bbox"] == box), known[i] if i < len(known) else None)
            if same is None:
                same, new = {"bbox_id": f"new_{new:05d}", "bbox_score": 0.9}, new + 1
            instances.append({"bbox_id": same["bbox_id"], "bbox": box, "bbox_score": same["bbox_score"]})
        if instances:
            out.append({"text": e["text"], "instances": instances, "verified": True})
    return out


EXPRESSIONS = "array<struct<text: string, char_span: array<int>, noun: string>>"


def expressions(reply: str | None) -> list[dict]:
    """Expressions of a reply (a list of objects with `text`, or an object with such a list): the span of characters is the
    whole text where none is given, the noun its last word; those without text go."""
    got = loose_json(reply)
    found = got if isinstance(got, list) else next((v for v in got.values() if isinstance(v, list)), []) if isinstance(got, dict) else []
    out = []
    for e in found:
        e = {"text": e} if isinstance(e, str) else e
        if not isinstance(e, dict) or not isinstance(e.get("text"), str) or not e["text"].strip():
            continue
        span, noun = e.get("char_span"), e.get("noun")
        whole = isinstance(span, list) and len(span) == 2 and all(isinstance(x, int) and not isinstance(x, bool) for x in span)
        out.append({"text": e["text"], "char_span": span if whole else [0, len(e["text"])], "noun": noun if isinstance(noun, str) and noun else e["text"].split()[-1]})
    return out


def with_expressions(df: DataFrame, reply: str, out: str = "expressions") -> DataFrame:
    return df.withColumn(out, F.pandas_udf(lambda s: s.map(expressions), EXPRESSIONS)(F.col(reply)))


def scored_boxes(df: DataFrame, boxes: str, width: str, height: str, score: float = 0.9, out: str = "instances") -> DataFrame:
    """df with column `out`: boxes in thousandths (arrays of four) as whole pixels inside the image, with the score that a
    model which gives none gets; boxes without four numbers, or empty once in pixels, go."""
    side = lambda v, s: F.least(F.greatest((v * F.col(s) / 1000).cast("int"), F.lit(0)), F.col(s).cast("int"))
    four = F.filter(boxes, lambda b: F.size(b) == 4)
    pixel = F.transform(four, lambda b: F.struct(F.array(side(b[0], width), side(b[1], height), side(b[2], width), side(b[3], height)).alias("bbox"), F.lit(score).alias("bbox_score")))
    return df.withColumn(out, F.filter(pixel, lambda x: (x["bbox"][2] > x["bbox"][0]) & (x["bbox"][3] > x["bbox"][1])))


def embed(df: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64, out: str = "embedding") -> DataFrame:
    """df with column `out`, vectors of column `text`; other columns are carried along, so nothing is joined back."""
    schema = df.withColumn(out, F.lit(None).cast("array<float>")).schema

    def run(frames):
        model = factory()
        for pdf in frames:
            vectors = [v for at in range(0, len(pdf), batch) for v in model(pdf[text].iloc[at : at + batch].tolist())]
            yield pdf.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def anomaly_gate(df: DataFrame, asked: str, verdict: str) -> DataFrame:
    """Rows whose reply begins with yes, with mode: anomaly if the verdict's last line begins so, else normal."""
    last = F.element_at(F.split(F.trim(F.lower(verdict)), "\n"), -1)
    return df.filter(F.lower(F.trim(asked)).startswith("yes")).withColumn("mode", F.when(F.trim(last).startswith("anomaly"), "anomaly").otherwise("normal"))
