"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions on top.

Method: the base patterns find e-mail addresses, IP addresses, card and phone numbers. The network reads characters as
classes and gives each a score for being outside, at the begin of or inside each kind; it is trained here in numpy, on
windows of a bounded sample of texts with their base spans and with further numbers and addresses written into them in
ways that the base patterns miss. A text is covered by overlapping windows; the scores of all windows over a character
are averaged, nearer centres counting more, and one Viterbi decoding over each covered stretch reconciles them. A span
is believed if its path scores so much better than none that, on windows kept from training, few such spans were wrong.

Scale: one pass over each text in its own row, no shuffle; only the sample comes to the driver. Every kind has a digit
or an @, so windows without either can't yield a span and aren't decoded.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_point_spans, map_rows, stretch

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never begins inside a run of digits: one that begins the run would be longer and further left.
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)

#: Classes of characters: 0 pads; one each for digits, a-z, A-Z, letters beyond ASCII, white space and other marks.
_MARKS = " \n.-()+@_%/:,'\"=#$"
_CLASSES = 7 + len(_MARKS)
_CLASS = np.full(128, 6, np.int64)
_CLASS[[*range(0x30, 0x3A)]], _CLASS[[*range(0x61, 0x7B)]], _CLASS[[*range(0x41, 0x5B)]] = 1, 2, 3
_CLASS[[9, 11, 12, 13]] = 5
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 7 + _i
_LABELS = 1 + 2 * len(KINDS)


@dataclass(frozen=True)
class Detect:
    """window, stride: characters of a window and between windows. hidden: units a direction. steps, batch: of training.

    sample_docs: texts that training windows come from; of a longer one a stretch of sample_chars, anywhere in it.
    sample_windows: windows of one text at most, spread over all its places with digits or an @. checks: batches by which
    spans' scores are calibrated. precision: share of right spans above the learned score. seed: of all random choices.
    """

    window: int = 96
    stride: int = 48
    hidden: int = 12
    steps: int = 240
    batch: int = 48
    train_window: int = 64
    rate: float = 0.02
    sample_docs: int = 400
    sample_chars: int = 50_000
    sample_windows: int = 8
    checks: int = 24
    precision: float = 0.99
    seed: int = 5


def luhn(digits: bytes | str) -> bool:
    ds = [int(c) for c in (digits.decode() if isinstance(digits, bytes) else digits)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(ds))) % 10 == 0


def _digits(raw: bytes) -> bytes:
    return raw.translate(None, _NOT_DIGITS)


def _emails(raw: bytes) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping: at each @, all name characters before it since the last match, and the domain after."""
    out, last, at = [], 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > last and raw[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(raw, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = raw.find(b"@", max(at + 1, last))
    return out


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Base spans in bytes, kind by kind."""
    found = _emails(raw) if b"@" in raw else []
    n = len(_digits(raw))
    if n >= 4:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(raw) if all(len(g.lstrip(b"0")) <= 3 and int(g) <= 255 for g in m.groups())]
    if n >= 12:
        for m in _CARD.finditer(raw):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
    if n >= 9 and b"+" in raw:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(raw) if 9 <= len(_digits(m[0])) <= 15]
    return found


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 4)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """BiLSTM-CRF over classes of characters. All arrays are time-major: (places, windows, ...)."""

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h = h
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((_CLASSES, 4 * h)) * 0.3).astype(np.float32)
            self.p["x" + d][:, h : 2 * h] += 1.0  # forget gates begin open
            self.p["u" + d] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
        self.p["o"] = (rng.standard_normal((2 * h, _LABELS)) * 0.3).astype(np.float32)
        self.p["c"] = np.zeros(_LABELS, np.float32)
        self.p["t"] = np.zeros((_LABELS, _LABELS), np.float32)
        self.limits = dict.fromkeys(range(len(KINDS)), 0.0)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states over places; with keep, also what the gradient needs."""
        h, table, u = self.h, self.p["x" + d], self.p["u" + d]
        n = x.shape[1]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((len(x), n, h), np.float32), []
        for t in range(len(x)):
            z = table[x[t]] + state @ u
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, prior = cell, state
            cell = f * cell + i * g
            th = np.tanh(cell)
            state = o * th
            out[t] = state
            if keep:
                kept.append((i, f, o, g, before, th, prior))
        return out, kept

    def _lstm_grad(self, x, d, kept, dout, grads):
        h, u = self.h, self.p["u" + d]
        dx, du = np.zeros_like(self.p["x" + d]), np.zeros_like(u)
        dstate, dcell = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, th, prior = kept[t]
            dstate = dstate + dout[t]
            dcell = dcell + dstate * o * (1 - th * th)
            dz = np.hstack([dcell * g * i * (1 - i), dcell * before * f * (1 - f), dstate * th * o * (1 - o), dcell * i * (1 - g * g)])
            np.add.at(dx, x[t], dz)
            du += prior.T @ dz
            dstate, dcell = dz @ u.T, dcell * f
        grads["x" + d], grads["u" + d] = dx, du

    def emissions(self, x: np.ndarray, keep: bool = False):
        fw, kf = self._lstm(x, "f", keep)
        bw, kb = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([fw, bw[::-1]], axis=2)
        e = both @ self.p["o"] + self.p["c"]
        return (e, both, kf, kb) if keep else e

    def loss_grad(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log likelihood of labels y under the CRF, and its gradients."""
        e, both, kf, kb = self.emissions(x, True)
        e = e.astype(np.float64)
        t, (n, b, k) = self.p["t"].astype(np.float64), e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for s in range(1, n):
            m = alpha[s - 1].max(axis=1, keepdims=True)
            alpha[s] = np.log(np.exp(alpha[s - 1] - m) @ np.exp(t) + 1e-300) + m + e[s]
        for s in range(n - 2, -1, -1):
            q = e[s + 1] + beta[s + 1]
            m = q.max(axis=1, keepdims=True)
            beta[s] = np.log(np.exp(q - m) @ np.exp(t.T) + 1e-300) + m
        top = alpha[-1].max(axis=1, keepdims=True)
        log_z = (np.log(np.exp(alpha[-1] - top).sum(axis=1, keepdims=True)) + top)[:, 0]
        de = np.exp(alpha + beta - log_z[None, :, None])
        place, row = np.ogrid[:n, :b]
        gold = e[place, row, y].sum(axis=0) + t[y[:-1], y[1:]].sum(axis=0)
        de[place, row, y] -= 1
        dt = np.zeros_like(t)
        for s in range(1, n):
            a, z = alpha[s - 1] - log_z[:, None], e[s] + beta[s]
            ma, mz = a.max(axis=1, keepdims=True), z.max(axis=1, keepdims=True)
            dt += (np.exp(a - ma + mz + ma)).T @ np.exp(z - mz) * np.exp(t)
        np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        de = (de / b).astype(np.float32)
        grads = {"t": (dt / b).astype(np.float32), "c": de.sum(axis=(0, 1)), "o": both.reshape(n * b, -1).T @ de.reshape(n * b, -1)}
        dboth = de @ self.p["o"].T
        self._lstm_grad(x, "f", kf, dboth[:, :, : self.h], grads)
        self._lstm_grad(x[::-1], "b", kb, dboth[::-1, :, self.h :], grads)
        return float((log_z - gold).mean()), grads

    def train(self, batches, rate: float) -> list[float]:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for step, (x, y) in enumerate(batches, 1):
            loss, grads = self.loss_grad(x, y)
            losses.append(loss)
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def viterbi(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """The best label sequence of each stretch of scores; stretches of like lengths are decoded together."""
        out: list[np.ndarray | None] = [None] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        t = self.p["t"]
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            n = len(stretches[part[-1]])
            e = np.zeros((n, len(part), _LABELS), np.float32)
            size = np.array([len(stretches[i]) for i in part])
            for j, i in enumerate(part):
                e[: size[j], j] = stretches[i]
            back = np.zeros((n, len(part), _LABELS), np.int8)
            score, rows = e[0].copy(), np.arange(len(part))
            for s in range(1, n):
                ways = score[:, :, None] + t
                pick = ways.argmax(axis=1)
                new = np.take_along_axis(ways, pick[:, None, :], 1)[:, 0] + e[s]
                live = (s < size)[:, None]
                back[s] = np.where(live, pick, np.arange(_LABELS))
                score = np.where(live, new, score)
            path = np.zeros((n, len(part)), np.int64)
            path[-1] = score.argmax(axis=1)
            for s in range(n - 1, 0, -1):
                path[s - 1] = back[s, rows, path[s]]
            for j, i in enumerate(part):
                out[i] = path[: size[j], j]
        return out


def _spelled(rng: np.random.Generator, kind: str) -> str:
    """A made-up value of a kind, or (kind none) something with digits that isn't personal."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    w = lambda a, b: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(a, b)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    if kind == "phone":
        return pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(11)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"1-{d(3)}-{d(3)}-{d(4)}")
    if kind == "card":
        sep = pick("", "", " ", "-", ".", "/")
        return sep.join([d(4), d(4), d(4), d(4)]) if rng.random() < 0.8 else sep.join([d(4), d(6), d(5)])
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "email":
        host = pick(w(3, 9), w(3, 6) + "-" + w(2, 5), w(2, 5) + d(1), "b" + chr(0xFC) + w(2, 6))
        name = pick(w(3, 9), w(2, 6) + "." + w(2, 8), w(3, 7) + d(2), w(1, 3) + "_" + w(3, 8), w(3, 6) + "+" + w(2, 5))
        return name + "@" + host + "." + pick("com", "org", "example.net", "co.uk", "de")
    return pick(f"{d(4)}", f"{d(2)}:{d(2)}", f"{d(1)}.{d(2)}", f"{d(1)},{d(3)}.{d(2)}", f"${d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"#{d(5)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(3)}%", d(rng.integers(1, 9)), f"{w(2, 4)}{d(3)}{w(1, 3)}{d(6)}", f"{d(3)} {d(2)}", f"{d(2)}-{d(3)}", d(24), "@" + w(3, 8), f"{w(2, 5)} @ {d(2)}", f"{pick('978', '979')}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{pick('978', '979')}{d(10)}", f"20{d(6)}-{d(3)}", d(rng.integers(10, 20)))


def _batches(texts: list[str], p: Detect, steps: int | None = None, seed: int = 0):
    """Training batches: windows of the texts with base spans, and windows into which values are written."""
    rng = np.random.default_rng(p.seed + seed)
    n = p.train_window
    real, fill = [], []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        spans = code_point_spans(raw, base_spans(raw))
        y = np.zeros(len(t), np.int64)
        for k, s, e in spans:
            y[s], y[s + 1 : e] = 1 + 2 * KINDS.index(k), 2 + 2 * KINDS.index(k)
        x = classes(t)
        hot = np.flatnonzero((x == 1) | (x == _CLASS[ord("@")]))
        for at in hot[np.unique(np.linspace(0, len(hot) - 1, p.sample_windows).astype(int))].tolist() if len(hot) else []:
            a = min(max(0, at - int(rng.integers(0, n))), max(0, len(t) - n))
            real.append((x[a : a + n], y[a : a + n]))
        plain = re.sub(r"[0-9@]", "", t)
        if len(plain) > n:
            fill.append(plain)
    fill = fill or ["the quick brown fox jumps over the lazy dog while all rest and sing a song of old. " * 3]
    for _ in range(p.steps if steps is None else steps):
        x, y = np.zeros((n, p.batch), np.int64), np.zeros((n, p.batch), np.int64)
        for j in range(p.batch):
            if real and rng.random() < 0.3:
                a, b = real[rng.integers(len(real))]
            else:
                kind = [*KINDS, "none", "phone", "none"][rng.integers(7)]
                value, around = _spelled(rng, kind), fill[rng.integers(len(fill))]
                cut = int(rng.integers(0, len(around) - n + 1))
                lead = around[cut : cut + int(rng.integers(0, n - 8))]
                lead = lead.rstrip() + " " if lead.strip() else ""
                tail = " " if rng.random() < 0.7 else [", ", ". ", "\n", "; ", ") "][rng.integers(5)]
                whole = (lead + value + tail + around[cut : cut + n])[:n]
                a, b = classes(whole), np.zeros(len(whole), np.int64)
                if kind != "none" and len(lead) < n:
                    at = 1 + 2 * KINDS.index(kind)
                    b[len(lead)], b[len(lead) + 1 : len(lead) + len(value)] = at, at + 1
            x[: len(a), j], y[: len(b), j] = a, b
        yield x, y


def train(texts: list[str], p: Detect = Detect()) -> Network:
    """A network, and by kind the score from which its spans are believed (limits)."""
    net = Network(p.hidden, p.seed)
    net.train(_batches(texts, p), p.rate)
    seen: dict[int, list[tuple[float, bool]]] = {k: [] for k in range(len(KINDS))}
    for x, y in _batches(texts, p, p.checks, 1):
        e = net.emissions(x)
        for j, path in enumerate(net.viterbi([e[:, j] for j in range(x.shape[1])])):
            said = {(k, a, b) for k, a, b, _ in _path_spans(net, e[:, j], y[:, j])}
            for k, a, b, gain in _path_spans(net, e[:, j], path):
                if b < len(path):  # what the window cuts off can't be told right or wrong
                    seen[k].append((gain, any(k == c and a < f and d < b for c, d, f in said)))
    for k, found in seen.items():
        right, limit = 0, np.inf
        for n, (gain, good) in enumerate(sorted(found, reverse=True), 1):
            right += good
            if right >= p.precision * n:
                limit = gain
        net.limits[k] = float(limit)
    return net


def _path_spans(net: Network, scores: np.ndarray, path: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, begin, end, gain) of the spans of a path of labels: gain is how much better it scores there than without the span."""
    out, t = [], net.p["t"]
    if not path.any():
        return out
    begin = kind = None
    ys = [*path.tolist(), 0]
    for i, y in enumerate(ys):
        inside = begin is not None and y == 2 + 2 * kind
        if begin is not None and not inside:
            own = path[begin:i]
            gain = float((scores[np.arange(begin, i), own] - scores[begin:i, 0]).sum() + t[own[:-1], own[1:]].sum() - (i - begin - 1) * t[0, 0])
            if begin:
                gain += float(t[0, own[0]] - t[0, 0])
            if i < len(path):
                gain += float(t[own[-1], 0] - t[0, 0])
            out.append((kind, begin, i, gain))
            begin = None
        if y and not inside:
            begin, kind = i, (y - 1) // 2
    return out


def _defined(kind: str, value: str) -> bool:
    """What makes a kind, as in the base rules: how many digits a number has, and whether its check is right."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in parts)
    return "@" in value


def network_spans(net: Network, texts: list[str], p: Detect) -> list[list[tuple[str, int, int]]]:
    """Spans that the network finds in each text and believes, in code points, before any check against base spans."""
    xs = [classes(t) for t in texts]
    jobs = []  # (text, begin of window)
    for k, x in enumerate(xs):
        hot = np.flatnonzero((x == 1) | (x == _CLASS[ord("@")]))
        if len(hot):
            last = max(0, -(-(len(x) - p.window) // p.stride))
            high = np.minimum(hot // p.stride, last)
            low = np.maximum(-(-(hot - p.window + 1) // p.stride), 0)
            wanted = np.unique(np.concatenate([np.clip(high - i, low, high) for i in range(-(-p.window // p.stride))]))
            jobs += [(k, int(i) * p.stride) for i in wanted]
    bell = (1.0 - np.abs(np.linspace(-1, 1, p.window)) * 0.95).astype(np.float32)
    total: dict[int, np.ndarray] = {}
    weight: dict[int, np.ndarray] = {}
    for at in range(0, len(jobs), 512):
        part = jobs[at : at + 512]
        x = np.zeros((p.window, len(part)), np.int64)
        for j, (k, a) in enumerate(part):
            piece = xs[k][a : a + p.window]
            x[: len(piece), j] = piece
        e = net.emissions(x)
        for j, (k, a) in enumerate(part):
            n = min(p.window, len(xs[k]) - a)
            if k not in total:
                total[k], weight[k] = np.zeros((len(xs[k]), _LABELS), np.float32), np.zeros(len(xs[k]), np.float32)
            total[k][a : a + n] += e[:n, j] * bell[:n, None]
            weight[k][a : a + n] += bell[:n]
    places, stretches = [], []
    for k, w in weight.items():
        edge = np.flatnonzero(np.diff((w > 0).astype(np.int8), prepend=0, append=0))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            places.append((k, a))
            stretches.append(total[k][a:b] / w[a:b, None])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (k, a), scores, path in zip(places, stretches, net.viterbi(stretches) if stretches else []):
        out[k] += [(KINDS[kind], a + b, a + e) for kind, b, e, gain in _path_spans(net, scores, path) if gain >= net.limits[kind]]
    return out


def find(texts: list[str | None], net: Network | None, p: Detect = Detect()) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end, in code points) of every text by start and kind: base spans, then what the network adds.

    A span that the network believes is added if it stands alone between other characters, meets no base span and has
    what makes its kind. net None: base spans only.
    """
    out, rest = [], []
    for k, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        base = base_spans(raw)
        out.append(code_point_spans(raw, base))
        if net is not None and (b"@" in raw or len(_digits(raw)) >= 4):
            rest.append(k)
    if rest:
        for k, spans in zip(rest, network_spans(net, [texts[k] for k in rest], p)):
            t, taken = texts[k], sorted((s, e) for _, s, e in out[k])
            for kind, s, e in spans:
                while e > s and t[e - 1] in " .,;:-(\n":
                    e -= 1
                while s < e and t[s] in " .,;:-)\n":
                    s += 1
                alone = (s == 0 or not t[s - 1].isalnum()) and (e == len(t) or not t[e].isalnum())
                if alone and _defined(kind, t[s:e]) and not any(a < e and s < b for a, b in taken):
                    out[k].append((kind, s, e))
    return [sorted(x, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) for x in out]


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _base_only(text: str | None) -> list[tuple[str, int, int]]:
    return find([text], None)[0]


def fit(df: DataFrame, p: Detect = Detect(), text: str = "text", row: str = "doc_id") -> Network:
    """The network, trained on at most sample_docs texts of df, chosen by hash; half of them with digits where there are."""
    rows = df.select(F.col(row).alias("_row"), F.col(text).alias("_text")).filter("_text is not null")
    rows = rows.withColumn("_h", F.xxhash64(F.lit(p.seed), "_row", "_text"))
    n = rows.count()
    some = rows.filter(F.pmod("_h", F.lit(1_000_000)) < int(min(1.0, 8 * p.sample_docs / max(1, n)) * 1_000_000))
    # First hashes alone come, some eight times the sample; then the texts of those that are wanted.
    marks = some.select("_h", F.col("_text").rlike("[0-9@]").alias("_hot")).distinct().orderBy("_h").limit(16 * p.sample_docs).collect()
    wanted = [r[0] for hot in (True, False) for r in [m for m in marks if m[1] == hot][: p.sample_docs // 2]]
    texts = some.filter(F.col("_h").isin(wanted)).dropDuplicates(["_h"]).select("_h", stretch("_text", "_h", p.sample_chars)).collect() if wanted else []
    return train([r[1] for r in sorted(texts)], p)


def detect(df: DataFrame, p: Detect = Detect(), text: str = "text", row: str = "doc_id", net: Network | None = None) -> DataFrame:
    """One row per row of df: row, n_email, n_ip, n_card, n_phone (base), n_added, n_spans (all), base_sha256, spans (`kind:start:end`).

    Null and empty texts have no spans. Repeated rows are each returned; an empty table gives an empty result; other
    columns of df are not read. net: a trained network; none: one is trained on a sample of df.
    """
    shared = df.sparkSession.sparkContext.broadcast(net or fit(df, p, text, row))

    def run(ids, texts):
        made = {f"n_{k}": [] for k in KINDS} | {"_row": ids, "n_added": [], "n_spans": [], "base_sha256": [], "spans": []}
        for t, spans in zip(texts, find(texts, shared.value, p)):
            base = _base_only(t)
            for k in KINDS:
                made[f"n_{k}"].append(sum(s[0] == k for s in base))
            made["n_added"].append(len(spans) - len(base))
            made["n_spans"].append(len(spans))
            made["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
            made["spans"].append(spell(spans))
        return made

    kind = df.schema[row].dataType.simpleString()
    schema = f"_row {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, n_spans long, base_sha256 string, spans string"
    return map_rows(df, [F.col(row).alias("_row"), F.col(text).alias("_text")], schema, run).withColumnRenamed("_row", row)
