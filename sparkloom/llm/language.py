"""Language identification by unigram piece models summed over all segmentations.

Method: a fixed public vocabulary gives the pieces. Each language has a probability for every piece, learned by
expectation maximisation on a bounded sample of labelled texts: forward and backward sums over all segmentations of a
word give expected piece counts. A text's score under a language is the sum, over all of its words, of the log of the
forward sum; the posterior over languages is returned with the best of them.

Scale: texts are read once for scoring, in their own rows, with no shuffle. Only the sample comes to the driver. A
worker keeps the scores of words it has met, up to a fixed number, so most words are looked up and not summed again.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import crc_mod, cut, join_small, map_rows, stretch

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_LONG = 32  # letters; longer words are summed with rescaling


@dataclass(frozen=True)
class Identify:
    """sample_docs: texts a language is learned from, at most; of a longer one a stretch of sample_chars, anywhere in it.
    rounds: of expectation maximisation. smooth: added counts.

    vocabulary: a sentencepiece model file, read by the driver only. memory: words a worker remembers.
    """

    sample_docs: int = 250
    sample_chars: int = 50_000
    rounds: int = 2
    smooth: float = 0.05
    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model"
    memory: int = 300_000


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, each once; `_` stands for the begin of a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i).replace("▁", "_").lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return list(dict.fromkeys(p for p in found if _LETTERS.fullmatch(p.removeprefix("_")) or p == "_"))


class Vocabulary:
    """Pieces by a 64-bit polynomial hash of their letters; places beyond the last piece mean an unknown letter."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)
    FLAGS = 1 << 20

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces of the vocabulary share a hash")
        self.flags = np.zeros(self.FLAGS, bool)
        self.flags[self._flag(keys)] = True

    @classmethod
    def _hash(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(cls.FACTOR) + ord(c) + 1) % (1 << 64)
        return h

    @classmethod
    def _flag(cls, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of pieces with hashes h; -1 where there is none."""
        out = np.full(len(h), -1)
        some = np.flatnonzero(self.flags[self._flag(h)])
        if len(some) and self.size:
            at = np.minimum(np.searchsorted(self.keys, h[some]), self.size - 1)
            same = self.keys[at] == h[some]
            out[some[same]] = self.order[at[same]]
        return out


class Lattice:
    """All ways to cut words into pieces: edges (word, start, end, piece), sorted by end and word."""

    def __init__(self, words: list[str], vocab: Vocabulary):
        codes = np.frombuffer("".join(["_" + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.lengths = len(words), np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        owner = np.repeat(np.arange(self.n), self.lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        room = self.lengths[owner] - place
        top = int(self.lengths.max(initial=0))
        h, at, cols = np.zeros(len(codes), np.uint64), np.arange(len(codes)), []
        for size in range(1, min(vocab.longest, top) + 1):
            fits = room[at] >= size
            at, h = at[fits], h[fits]
            h = h * vocab.FACTOR + codes[at + size - 1]
            piece = vocab.find(h)
            if size == 1:
                piece = np.where(piece < 0, vocab.size, piece)
            got = np.flatnonzero(piece >= 0)
            cols.append((owner[at[got]], place[at[got]], place[at[got]] + size, piece[got]))
        word, start, end, piece = (np.concatenate(x) for x in zip(*cols)) if cols else [np.zeros(0, np.int64)] * 4
        order = np.argsort(end * (self.n + 1) + word, kind="stable")
        self.word, self.start, self.end, self.piece = word[order], start[order], end[order], piece[order]
        self.cuts = np.searchsorted(self.end, np.arange(top + 2))

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of every beginning of each word: (words, places, languages)."""
        top = int(self.lengths.max(initial=0))
        alpha = np.zeros((self.n, top + 1, probs.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, top + 1):
            a, b = self.cuts[j], self.cuts[j + 1]
            if a < b:
                w = self.word[a:b]
                first = np.flatnonzero(np.diff(w, prepend=-1))
                alpha[w[first], j] = np.add.reduceat(alpha[w, self.start[a:b]] * probs[self.piece[a:b]], first)
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(self.n), self.lengths]

    def expected(self, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts, for words that occur counts[word, language] times."""
        alpha = self.forward(probs)
        total = np.maximum(self.total(alpha), 1e-300)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.lengths] = counts / total
        flat = [beta[:, :, lang].ravel().copy() for lang in range(probs.shape[1])]
        wide = alpha.shape[1]
        for j in range(wide - 1, 0, -1):
            a, b = self.cuts[j], self.cuts[j + 1]
            if a < b:
                at, to, piece = self.word[a:b] * wide + j, self.word[a:b] * wide + self.start[a:b], self.piece[a:b]
                for lang, f in enumerate(flat):
                    np.add.at(f, to, f[at] * probs[piece, lang])
        out = np.zeros_like(probs)
        for lang, f in enumerate(flat):
            share = alpha[self.word, self.start, lang] * probs[self.piece, lang] * f[self.word * wide + self.end]
            out[:, lang] = np.bincount(self.piece, share, minlength=len(probs))
        return out


class Languages:
    """Piece probabilities of some languages, and the scores they give to texts."""

    def __init__(self, names: list[str], pieces: list[str], probs: np.ndarray, memory: int):
        self.names, self.memory = names, memory
        self.vocab = Vocabulary(pieces)
        self.probs = probs
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {"": 0}
        self.scores = np.zeros((1024, len(self.names)))

    def __getstate__(self):
        return self.__dict__ | {"place": {"": 0}, "scores": np.zeros((1024, len(self.names)))}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log of the sum over all segmentations, for words of letters."""
        out = np.zeros((len(words), len(self.names)))
        short = [k for k, w in enumerate(words) if len(w) < _LONG]
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            lattice = Lattice([words[k] for k in part], self.vocab)
            out[part] = np.log(np.maximum(lattice.total(lattice.forward(self.probs)), 1e-300))
        for k, w in enumerate(words):
            if len(w) >= _LONG:
                out[k] = self._long(w)
        return out

    def _long(self, w: str) -> np.ndarray:
        """As word_scores, the sums rescaled at every letter."""
        lattice, longest = Lattice([w], self.vocab), self.vocab.longest
        last, shift = [np.ones(len(self.names))], np.zeros(len(self.names))
        for j in range(1, int(lattice.lengths[0]) + 1):
            a, b = lattice.cuts[j], lattice.cuts[j + 1]
            now = sum(last[s - j] * self.probs[p] for s, p in zip(lattice.start[a:b].tolist(), lattice.piece[a:b].tolist()))
            top = np.maximum(now, 1e-300)
            shift += np.log(top)
            last = [x / top for x in last[-longest:]] + [now / top]
        return shift

    def _learn(self, tokens: list[str]):
        """Scores of tokens (split at white space) go into memory: the sum over their runs of letters."""
        runs = [[t] if t.isalpha() else _LETTERS.findall(t) for t in tokens]
        flat = [r for rs in runs for r in rs]
        scores = self.word_scores(flat)
        owner = np.repeat(np.arange(len(tokens)), [len(rs) for rs in runs])
        made = np.zeros((len(tokens), len(self.names)))
        np.add.at(made, owner, scores)
        n = len(self.place)
        while n + len(tokens) > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
        self.scores[n : n + len(tokens)] = made
        self.place.update(zip(tokens, range(n, n + len(tokens))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counted = [Counter(t.lower().split()) if t else {} for t in texts]
        if len(self.place) > self.memory:
            self._forget()
        new = {w for counts in counted for w in counts} - self.place.keys()
        if new:
            self._learn(list(new))
        names, score = [], []
        for t, counts in zip(texts, counted):
            if not self.names or not t or not _LETTERS.search(t):
                names.append(UNKNOWN), score.append(0.0)
                continue
            at = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
            logs = np.fromiter(counts.values(), np.float64, len(counts)) @ self.scores[at]
            best = int(np.argmax(logs))
            names.append(self.names[best])
            score.append(float(1.0 / np.exp(logs - logs[best]).sum()))
        return names, score


def learn(samples: list[tuple[str, str]], p: Identify = Identify()) -> Languages:
    """Models from (language, text) pairs. Words of _LONG letters and more teach in parts below that length."""
    pieces = load_pieces(p.vocabulary)
    names = sorted({lang for lang, _ in samples})
    counts: dict[str, np.ndarray] = {}
    for lang, text in samples:
        for w, c in Counter(_LETTERS.findall(text.lower())).items():
            for part in (w[i : i + _LONG - 1] for i in range(0, len(w), _LONG - 1)):
                counts.setdefault(part, np.zeros(len(names)))[names.index(lang)] += c
    n = len(pieces) + 1
    probs = np.full((n, len(names)), 1.0 / n)
    model = Languages(names, pieces, probs, p.memory)
    words = list(counts)
    if words:
        lattices = [(Lattice(words[a : a + 20000], model.vocab), np.array([counts[w] for w in words[a : a + 20000]])) for a in range(0, len(words), 20000)]
        for _ in range(p.rounds):
            found = sum(lattice.expected(probs, c) for lattice, c in lattices) + p.smooth
            probs = found / found.sum(axis=0)
    model.probs = probs
    return model


def _sample(df: DataFrame, p: Identify) -> list[tuple[str, str]]:
    """At most sample_docs learning rows of each language, chosen by hash.

    Only languages and hashes are ranked; then the texts of the chosen hashes are fetched.
    """
    rows = df.filter((crc_mod(F.col("_row"), 3) != 1) & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    sizes = cut(rows.groupBy("_lang").agg(F.count("*").alias("_n")))
    rows = rows.withColumn("_h", F.xxhash64("_row", "_text"))
    hashed = F.pmod("_h", F.lit(1_000_000)) / 1_000_000
    some = join_small(rows.select("_lang", "_h"), sizes, ["_lang"]).filter(hashed < F.lit(1.3 * p.sample_docs) / F.col("_n") + F.lit(1e-6))
    ranked = some.select("_lang", "_h").distinct().withColumn("_k", F.row_number().over(W.partitionBy("_lang").orderBy("_h")))
    marks = cut(ranked.filter(F.col("_k") <= p.sample_docs).select("_lang", "_h"))
    found = join_small(rows.select("_lang", "_h", "_text"), marks, ["_lang", "_h"], "inner").dropDuplicates(["_lang", "_h"])
    return sorted((r[0], r[1]) for r in found.select(F.col("_lang").cast("string"), stretch("_text", "_h", p.sample_chars)).collect())


def identify(df: DataFrame, p: Identify = Identify(), text: str = "text", lang: str = "lang", row: str = "doc_id") -> DataFrame:
    """One row per row of df: row, held_out, lang_pred, score.

    Rows with crc32 of the row id as text, modulo 3, equal to 1 are held out from learning; null ids too. Rows with null
    language teach nothing. `und`, with score 0, stands for null texts, texts without a letter, and all texts where
    nothing could be learned. Ties go to the first language by code points. Repeated rows are each returned; an empty
    table gives an empty result; other columns of df are not read.
    """
    plain = df.select(F.col(row).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    model = df.sparkSession.sparkContext.broadcast(learn(_sample(plain, p), p))

    def run(ids, held, texts):
        names, score = model.value.predict(texts)
        return {"_row": ids, "held_out": held, "lang_pred": names, "score": score}

    kind = df.schema[row].dataType.simpleString()
    held = F.coalesce(crc_mod(F.col("_row"), 3) == 1, F.lit(True)).alias("_held")
    return map_rows(plain, ["_row", held, "_text"], f"_row {kind}, held_out boolean, lang_pred string, score double", run).withColumnRenamed("_row", row)
