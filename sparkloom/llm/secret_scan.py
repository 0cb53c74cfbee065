"""Secret scans: fixed patterns, and guess costs of values that stand where credentials do.

Method: three base patterns find assignments, access key ids and long hexadecimal strings. Besides, whatever follows a
credential word (`pwd: ...`, `client_secret = ...`, `Authorization: Bearer ...`) is a candidate value, and dynamic
programming finds its cheapest segmentation into common words, dates, repeats, keyboard walks and brute-force spans. A
value that costs at least `min_bits` to guess is a secret; cheap ones (`changeme`, `your_token_here`) are placeholders.
The values of base assignments are scored alike, which tells secrets from placeholders among them.

Scale: one pass over each text in its own row, no shuffle. Substring tests keep patterns away from texts without any of
their fixed parts. The word ranks are a public vocabulary of fixed size, sent as a broadcast.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_point_spans, map_rows

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ASSIGN_PARTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
_HEX_FLAGS = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_HEX_RUN = b"h" * 32
_CONTEXT = re.compile(
    rb"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|(?:client[-_ ]?)?secret(?:[-_ ]?key)?|(?:access|auth|bearer|refresh)?[-_ ]?token|(?:api|access|private|secret)[-_ ]?key|credentials?)["']?"""
    rb"""(?:\x20*(?:=>|[:=])\x20*|\x20+is\x20+)["']?(?=([!-~]{8}))|(?<![A-Za-z])(?:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]{16,})""",
    re.I,
)
_CONTEXT_PARTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"basic")
_RUN = re.compile(rb"[!-~]*")
_ENDS = b"\"'`,;)>]}."
#: Where an unquoted value ends before its run does: at a separator and the next name, at a quote that closes, at a tag.
_NEXT = re.compile(rb"""["'`]?[&,;|]+["'`{\[]*[A-Za-z0-9_.-]+["'`]?(?:=|:)|["'`](?=[>,;:)}\]/&]|\Z)|</?[A-Za-z]""")
_CLOSE = {q: re.compile(rb"(?:\\.|[^\\" + bytes([q]) + rb"])*") for q in b"\"'"}

#: Keys of a common keyboard by row, each beside its neighbours.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d")
_UNIT = 32  # characters of a repeated unit, at most
_LEET = str.maketrans("013457@$!", "oleastasi")


@dataclass(frozen=True)
class Scan:
    """min_bits: guess cost from which a value is secret. vocabulary: a tokenizer file whose order ranks words by use."""

    min_bits: float = 36.0
    vocabulary: str = "/opt/tokenizers/word_bpe_49k.json"
    max_word: int = 24


def _neighbours() -> set[tuple[str, str]]:
    out = set()
    for r, keys in enumerate(_ROWS):
        for i, k in enumerate(keys):
            near = [keys[i + 1 : i + 2]]
            if r + 1 < len(_ROWS):
                near += [_ROWS[r + 1][j : j + 1] for j in (i - 1, i) if j >= 0]
            out |= {(k, n) for n in near if n} | {(n, k) for n in near if n}
    return out


_NEAR = _neighbours()


def load_ranks(path: str) -> dict[str, int]:
    """Words of three letters or more, by their order in the public vocabulary. The driver reads it, executors get the ranks."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = [w[:-4] for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    return {w: i + 1 for i, w in enumerate(w for w in dict.fromkeys(whole) if len(w) >= 3 and w.isalpha())}


def _char_bits(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33 if ord(c) < 128 else 1000)


def _date_bits(text: str) -> float | None:
    return None if _DATE.fullmatch(text) is None else 7.0 if len(text) == 4 else 15.5


def _walks(a: str, b: str) -> bool:
    """Whether lower-case b follows a on the keyboard, in the alphabet or among digits."""
    return (a, b) in _NEAR or (abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum())


#: Characters after the begin of a periodic run within which long repeats may begin. Where a run goes on, a later begin is
#: reached either by a repeat of the same unit, which one longer repeat undercuts, or by other spans, each of at most a
#: few bits a character less than `limit` in all, so that this far in none is below it.
_DEEP = 512


def guess_bits(value: str, ranks: dict[str, int], max_word: int = 24, limit: float = math.inf, memory: dict[str, float] | None = None) -> float:
    """Least cost, in bits, of guessing value as a sequence of words, dates, repeats, walks and brute-force characters.

    All spans of every kind are tried from every place. Costs from limit on are told from lower ones, but not exactly.
    """
    n, low = len(value), value.lower()
    plain, memory = low.translate(_LEET), {} if memory is None else memory
    best = [0.0] + [math.inf] * n if n <= 256 else np.array([0.0] + [math.inf] * n)
    walk = [i + 1 for i in range(n)]  # by begin: where the longest walk ends
    for i in range(n - 2, -1, -1):
        if _walks(low[i], low[i + 1]):
            walk[i] = walk[i + 1]
    periods = []  # (length of a unit, by begin: characters that equal those a unit later)
    for p in range(1, min(_UNIT, n // 2) + 1):
        same, long = [0] * (n + 1), 0
        for i in range(n - p - 1, -1, -1):
            if value[i] == value[i + p]:
                same[i] = same[i + 1] + 1
                long = max(long, same[i])
        if long >= p:
            periods.append((p, same))
    run = {p: 0 for p, _ in periods}  # by unit: where the present run began
    for i in range(n):
        for p, same in periods:
            if i and not same[i - 1]:
                run[p] = i
        at = float(best[i])
        if at >= limit:
            continue

        def reach(j: int, cost: float) -> None:
            if cost < best[j]:
                best[j] = cost

        reach(i + 1, at + _char_bits(value[i]))
        for j in range(i + 3, min(n, i + max_word) + 1):
            rank, swapped = ranks.get(low[i:j]), 0.0
            if rank is None:
                rank, swapped = ranks.get(plain[i:j]), 3.0
            if rank is not None:
                reach(j, at + 1 + math.log2(rank + 1) + swapped + (1.0 if value[i:j] != low[i:j] else 0.0))
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if (bits := _date_bits(value[i:j])) is not None:
                    reach(j, at + bits)
        for j in range(i + 4, walk[i] + 1):
            if (cost := at + 6.0 + 1.5 * (j - i - 1)) >= limit:
                break
            reach(j, cost)
        for p, same in periods:
            times = same[i] // p + 1
            if times < 2:
                continue
            if i - run[p] > _DEEP:
                times = min(times, max(2, _DEEP // p))
            unit = value[i : i + p]
            if unit not in memory:
                memory[unit] = guess_bits(unit, ranks, max_word, math.inf, memory)
            own = at + memory[unit] + 1
            if times > 64 and n > 256:
                ends = best[i + 2 * p : i + times * p + 1 : p]
                np.minimum(ends, own + np.log2(np.arange(2, times + 1)), out=ends)
            else:
                for t in range(2 if p > 1 else 3, times + 1):
                    reach(i + t * p, own + math.log2(t))
    return float(best[n])


def _guesses(raw: bytes, taken: list[tuple[int, int]], ranks: dict[str, int], p: Scan) -> list[tuple[str, int, int]]:
    """Values after credential words that cost min_bits or more; taken: the base spans, sorted.

    A value is a whole run. Where base spans meet it, it ends at its closing quote, or else before the next name or
    assignment, and the search goes on from there; only a value that lies wholly inside a base span is skipped.
    """
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    assigned = [m.start() for m in _ASSIGN.finditer(raw)] if taken else []
    out, at, run = [], 0, 0
    while (m := _CONTEXT.search(raw, at)) is not None:
        g = 1 if m[1] is not None else 2
        start = m.start(g)
        if g == 1 and start >= run:
            run = _RUN.match(raw, start).end()
        at = run if g == 1 else m.end(2)
        end = _stripped(raw, start, at)
        if (i := bisect_left(starts, end)) and reach[i - 1] > start:
            quote = raw[start - 1]
            if quote in _CLOSE and (close := _CLOSE[quote].match(raw, start, at).end()) < at:
                at = end = close
            else:
                if (cut := _NEXT.search(raw, start, at)) is not None:
                    at = cut.start()
                if (k := bisect_right(assigned, start)) < len(assigned):
                    at = min(at, assigned[k])
                end = _stripped(raw, start, at)
            at = max(at, start)
            if (i := bisect_right(starts, start)) and reach[i - 1] >= end:
                continue
        if end - start >= 8 and costly(raw[start:end], ranks, p):
            out.append(("guess", start, end))
    return out


def costly(value: bytes, ranks: dict[str, int], p: Scan = Scan()) -> bool:
    return guess_bits(value.decode("latin-1"), ranks, p.max_word, p.min_bits) >= p.min_bits


def assigned(text: str | None, ranks: dict[str, int], p: Scan = Scan()) -> list[tuple[int, int, bool]]:
    """(start, end, in code points, whether costly) of the values that base assignments give."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if not any(x in low for x in _ASSIGN_PARTS):
        return []
    found = [(costly(m[2], ranks, p), m.start(2), m.end(2)) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
    return [(s, e, c) for c, s, e in code_point_spans(raw, found)]


def _stripped(raw: bytes, start: int, end: int) -> int:
    while end > start and raw[end - 1] in _ENDS:
        end -= 1
    return end


def find(text: str | None, ranks: dict[str, int], p: Scan = Scan()) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in KINDS. Nothing in a null or empty text."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found: list[tuple[str, int, int]] = []
    if any(x in low for x in _ASSIGN_PARTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    if _HEX_RUN in raw.translate(_HEX_FLAGS):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(raw)]
    if any(x in low for x in _CONTEXT_PARTS):
        found += _guesses(raw, sorted((s, e) for _, s, e in found), ranks, p)
    return sorted(code_point_spans(raw, found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _shared_ranks(df: DataFrame, p: Scan):
    return df.sparkSession.sparkContext.broadcast(load_ranks(p.vocabulary))


def scan(df: DataFrame, p: Scan = Scan(), text: str = "text", row: str = "doc_id") -> DataFrame:
    """One row per row of df: row, n_assign, n_access, n_hex, n_guess, n_costly, base_sha256, spans, assigned.

    spans: `kind:start:end`, comma-joined. assigned: `start:end:costly` or `start:end:cheap` for the value of each base
    assignment, by its guess cost; n_costly counts the former. Null and empty texts have no spans. Repeated rows are each returned; an empty table gives an empty result; other
    columns of df are not read.
    """
    ranks = _shared_ranks(df, p)

    def run(ids, texts):
        made = {k: [] for k in ("_row", "n_assign", "n_access", "n_hex", "n_guess", "n_costly", "base_sha256", "spans", "assigned")} | {"_row": ids}
        for t in texts:
            spans = find(t, ranks.value, p)
            for k in KINDS:
                made[f"n_{k}"].append(sum(s[0] == k for s in spans))
            made["base_sha256"].append(hashlib.sha256(spell([s for s in spans if s[0] != "guess"]).encode()).hexdigest())
            made["spans"].append(spell(spans))
            values = assigned(t, ranks.value, p) if made["n_assign"][-1] else []
            made["n_costly"].append(sum(c for _, _, c in values))
            made["assigned"].append(",".join(f"{s}:{e}:{'costly' if c else 'cheap'}" for s, e, c in values))
        return made

    kind = df.schema[row].dataType.simpleString()
    schema = f"_row {kind}, n_assign long, n_access long, n_hex long, n_guess long, n_costly long, base_sha256 string, spans string, assigned string"
    return map_rows(df, [F.col(row).alias("_row"), F.col(text).alias("_text")], schema, run).withColumnRenamed("_row", row)


def redact(df: DataFrame, p: Scan = Scan(), mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """df with every found span replaced by mark; spans that overlap are replaced as one. No row goes."""
    ranks = _shared_ranks(df, p)

    def run(texts):
        out = []
        for t in texts:
            parts, at = [], 0
            for _, s, e in find(t, ranks.value, p):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if parts else t)
        return {"_new": out}

    source = df.select(F.col(text).alias("_text"), F.struct(*[F.col(c) for c in df.columns]).alias("_all"))
    new = map_rows(source, ["_text"], "_new string", run, ["_all"])
    return new.select(*[F.col("_new").alias(c) if c == text else F.col("_all")[c].alias(c) for c in df.columns])
