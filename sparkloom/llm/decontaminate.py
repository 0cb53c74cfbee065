"""Benchmark decontamination: a generalised suffix automaton of the test items, over which document words are streamed.

Method: the items' words, lower-cased, make one suffix automaton (a restart at the root between items). Streaming a
document through it gives, at every word, the length of the longest match that ends there; a window of `window` words
occurs there if that length reaches it. An item of fewer words is one window of its own length. Hit words are those
inside any occurrence; spans of them can be cut and documents over a coverage limit dropped.

Scale: items are dealt into shards of about `shard_words` words, each with its own automaton, written to the shared folder.
A worker holds one shard at a time. Documents are read once, whatever the number of shards, and never shuffled: a worker
takes a bounded stretch of them and streams it through shard after shard. A word that is in no item resets the automaton,
so only runs of known words are walked.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import make_dir, map_rows, opened, shared_dir

#: Bytes of words: 0-9, a-z (A-Z lower-cased) and all of other code points; the rest of ASCII separates.
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Contamination:
    """window: item words that make a hit. one_in: a document is contaminated if one in so many of its words is hit.

    max_span: hit spans of so many words are cut from documents that stay. shard_words: words of items in one automaton,
    which bounds what a worker holds (under a kilobyte a word; a longer item has a shard of its own). stretch: bytes of
    texts that a worker holds where there are several shards.
    """

    window: int = 13
    one_in: int = 20
    max_span: int = 13
    shard_words: int = 100_000
    stretch: int = 16_000_000


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Automaton:
    """Suffix automaton of many word lists, with the items in which each state's window occurs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
        #: Items whose full-length windows end in a state; and short items by the state of the whole item.
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[str]] = {}
        for item, ws in items:
            if 0 < len(ws) < window:
                self.short.setdefault(self._walk(ws), []).append(item)
            else:
                state, length = 0, 0
                for i, w in enumerate(ws):
                    state, length = self.step(state, length, self.vocab[w])
                    if i + 1 >= window:
                        self.items.setdefault(self._down(state, window), set()).add(item)
        #: For each state, the states of whole short items on its suffix path, longest first.
        self.ends: dict[int, list[int]] = {}
        if self.short:
            for s in sorted(range(len(self.link)), key=self.length.__getitem__):
                up = self.ends.get(self.link[s], []) if s else []
                own = [s] if s in self.short else []
                if own or up:
                    self.ends[s] = own + up
        self.least = min([len(ws) for _, ws in items if ws] + [window])
        self.short_length = {s: self.length[s] for s in self.short}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _walk(self, ws: list[bytes]) -> int:
        state = 0
        for w in ws:
            state = self.next[state][self.vocab[w]]
        return state

    def _down(self, state: int, length: int) -> int:
        """The state that holds the last `length` words of a match in state."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after word c."""
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            length = self.length[state]
        to = nxt[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [begin, end) of word places, merged, and the items with occurring windows."""
        get, window = self.vocab.get, self.window
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.least:
                continue
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                state, length = self.step(state, length, c)
                reach = 0
                if length >= window:
                    reach = window
                    found |= self.items[self._down(state, window)]
                if self.short and length >= self.least:
                    # The match may be a suffix of what its state stands for: only short items within its length occur.
                    for s in self.ends.get(state, ()):
                        if (n := self.short_length[s]) <= length:
                            found.update(self.short[s])
                            reach = max(reach, n)
                if reach:
                    begin = i + 1 - reach
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i + 1))
        return spans, found


def _shards(benchmark: DataFrame, p: Contamination, text: str, item: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items dealt by hash into shards of about shard_words words; one shard at a time is fetched."""
    rows = benchmark.select(F.col(item).cast("string").alias("_item"), F.col(text).alias("_text")).filter("_text is not null")
    total = rows.agg(F.sum(F.regexp_count("_text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = max(1, -(-total // p.shard_words))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == k)
        yield [(r[0], words(r[1])) for r in part.orderBy("_item", "_text").toLocalIterator()]


#: The shard that this worker read last, by its path.
_held: list = [None, None]


def _automaton(path: str) -> Automaton:
    if _held[0] != path:
        _held[:] = [None, None]
        with opened(path, "rb") as f:
            _held[:] = [path, pickle.loads(f.read())]
    return _held[1]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and out[-1][1] >= b:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def hits(df: DataFrame, benchmark: DataFrame, p: Contamination = Contamination(), text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of df: n_words, spans (array of [b, e) word places), items (sorted ids) and _all, the row itself.

    A null or empty text has no words and no hits; items without words hit nothing; an empty benchmark hits nothing.
    Items with equal ids count once; those with null ids make hits, but are not among the ids. Repeated rows are each
    returned. The shards' files stay in the shared folder, as the result is read later.
    """
    folder = f"{shared_dir(df.sparkSession)}/decontaminate-{uuid.uuid4().hex}"
    make_dir(df.sparkSession, folder)
    paths = []
    for shard in _shards(benchmark, p, item_text, item):
        paths.append(f"{folder}/{len(paths)}.pickle")
        with opened(paths[-1], "wb") as f:
            f.write(pickle.dumps(Automaton(shard, p.window), pickle.HIGHEST_PROTOCOL))
    source = df.select(F.col(text).alias("_text"), F.struct(*[F.col(c) for c in df.columns]).alias("_all"))
    kind = StructType.fromDDL("n_words long, spans array<struct<b: int, e: int>>, items array<string>")
    fields = list(to_arrow_schema(kind))
    stretch = p.stretch if len(paths) > 1 else 0

    def scanned(parts):
        texts = [t for part in parts for t in part.column(0).to_pylist()]
        sizes, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        for path in paths:
            machine = _automaton(path)
            for k, t in enumerate(texts):
                ws = words(t)
                sizes[k] = len(ws)
                more, found = machine.scan(ws)
                spans[k] += more
                items[k] |= found
        spans = [[{"b": b, "e": e} for b, e in (_joined(x) if len(paths) > 1 else x)] for x in spans]
        items, at = [sorted(x - {None}) for x in items], 0
        for part in parts:
            to = at + part.num_rows
            yield pa.RecordBatch.from_arrays([*[pa.array(x[at:to], f.type) for x, f in zip((sizes, spans, items), fields)], part.column(1)], names=[*[f.name for f in fields], "_all"])
            at = to

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                held.append(batch.slice(at, 1000))
                size += held[-1].column(0).nbytes
                if size >= stretch:
                    yield from scanned(held)
                    held, size = [], 0
        if held:
            yield from scanned(held)

    return source.mapInArrow(run, kind.add(source.schema["_all"]))


def with_verdict(found: DataFrame, p: Contamination = Contamination()) -> DataFrame:
    """hits() with n_hit, n_items, items_sha256 (of the sorted, comma-joined ids) and contaminated."""
    found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["e"] - s["b"])))
    return found.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
            "contaminated": (F.col("n_hit") > 0) & (p.one_in * F.col("n_hit") >= F.col("n_words")),
        }
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(_TO_WORDS), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False])).astype(np.int8)))
    starts, ends, at, out = edge[::2], edge[1::2], 0, []
    for b, e in spans:
        out.append(raw[at : starts[b]])
        at = ends[e - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove(df: DataFrame, benchmark: DataFrame, p: Contamination = Contamination(), text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without contaminated rows; in the other rows, hit spans of p.max_span words or more are cut from the text."""
    found = with_verdict(hits(df, benchmark, p, text, item, item_text), p).filter(~F.col("contaminated"))
    long_spans = F.filter("spans", lambda s: s["e"] - s["b"] >= p.max_span)
    found = found.select(F.col("_all")[text].alias("_text"), long_spans.alias("_spans"), "_all")

    def run(texts, spans):
        return {"_new": [without(t, [(s["b"], s["e"]) for s in ss]) if ss else t for t, ss in zip(texts, spans)]}

    new = map_rows(found, ["_text", "_spans"], "_new string", run, ["_all"])
    return new.select(*[F.col("_new").alias(c) if c == text else F.col("_all")[c].alias(c) for c in df.columns])
