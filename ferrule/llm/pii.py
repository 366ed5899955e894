"""Personal data: fixed patterns plus a character BiLSTM with CRF transitions.

The patterns give the base spans (e-mail, IPv4, payment card, phone).  The model, trained
here in numpy from labelled spans, adds spans that the patterns miss: numbers without a
country code, and cards or phones that run into a neighbouring number.  Two forms are plain
enough to be added whether the model finds them or not: addresses written with ``(at)`` or
``[at]``, and digits alone behind a word for phones (without one they look like any number, so
those stay).  Every kind's span holds a digit, an ``@`` or such an at (and a card passes its
checksum), so windows are laid around each of these wherever they stand in the text; what is
further than the window's context from all of them cannot be part of a span of the model.
Overlapping windows are decoded by Viterbi and reconciled over the whole text: a character
takes the tag of the window in which it stands furthest from an edge.

Defined results: a null text is an empty one; an empty text has no spans; offsets are
code points, ends exclusive; equal rows get equal results; texts of any length are read
whole; an added span that overlaps a base span, or an earlier added one, is left out.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, table

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_PIECE = re.compile(r"\S+")
_AT = re.compile(r"[(\[] ?[Aa][Tt] ?[)\]]")
_AT_DOMAIN = re.compile(r"[(\[] ?[Aa][Tt] ?[)\]] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBER = re.compile(r"[0-9]{10,}+")
_JOINED_BEFORE, _JOINED_BEHIND = re.compile(r"[0-9][.,:/-]\Z"), re.compile(r"[.,:/-][0-9]")
_PHONE_WORD = re.compile(
    r"(?<![^\W_])(?:tele)?(?:phones?|phoned|tel|fax|calls?|called|dial|mobile|mob|cell|ring|sms|whatsapp|hotline|fon|telefon|telefono|handy|téléphone|tél|teléfono|móvil|portable)"
    r"[^\w\n]{0,3}(?:(?:number|no|nr|me|us|at|on|is|under|now|numéro|número|nummer)[^\w\n]{1,3}){0,3}\Z",
    re.I,
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind, sorted."""
    found = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---------------------------------------------------------------- the model

#: Characters around a digit or ``@`` that a window takes in, and a window's length.
CONTEXT = 24
WIDTH = 96
HIDDEN = 16
EMBED = 10
TAGS = 1 + 2 * len(KINDS)  # outside, and begin/inside of each kind

_CLASSES = " @.-+()_:/,;=\"'|#$%&*!?[]{}<>"
N_CLASSES = len(_CLASSES) + 8


def _char_table() -> np.ndarray:
    """A class for each of the first 0x250 code points; what lies beyond is class 0 (other)."""
    out = np.zeros(0x250, np.int64)
    first = len(_CLASSES) + 1
    for c in range(0x250):
        ch = chr(c)
        if ch in _CLASSES:
            out[c] = 1 + _CLASSES.index(ch)
        elif "0" <= ch <= "9":
            out[c] = first
        elif ch in "abcdef":
            out[c] = first + 1
        elif ch.isalpha() and ch.islower():
            out[c] = first + 2
        elif ch in "ABCDEF":
            out[c] = first + 3
        elif ch.isalpha():
            out[c] = first + 4
        elif ch.isspace():
            out[c] = first + 5
    return out


PAD = N_CLASSES - 1
_TABLE = _char_table()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x250, _TABLE[np.minimum(codes, 0x24F)], 0)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, wx, wh, b, reverse):
    """x: (batch, time, in).  Hidden states and what the backward pass needs."""
    n, steps, _ = x.shape
    h = np.zeros((n, HIDDEN), x.dtype)
    c = np.zeros((n, HIDDEN), x.dtype)
    pre = x @ wx + b
    out = np.zeros((n, steps, HIDDEN), x.dtype)
    kept = []
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        g = pre[:, t] + h @ wh
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        u = np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        tc = np.tanh(c)
        kept.append((t, h, before, i, f, o, u, tc))
        h = o * tc
        out[:, t] = h
    return out, kept


def _lstm_back(x, wx, wh, kept, d_out):
    d_wx, d_wh, d_b = np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1], wx.dtype)
    d_x = np.zeros_like(x)
    d_h = np.zeros((x.shape[0], HIDDEN), x.dtype)
    d_c = np.zeros_like(d_h)
    for t, h, before, i, f, o, u, tc in reversed(kept):
        d_h = d_h + d_out[:, t]
        d_c = d_c + d_h * o * (1 - tc * tc)
        d_g = np.concatenate(
            [d_c * u * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - u * u)], axis=1
        )
        d_wx += x[:, t].T @ d_g
        d_wh += h.T @ d_g
        d_b += d_g.sum(0)
        d_x[:, t] = d_g @ wx.T
        d_h = d_g @ wh.T
        d_c = d_c * f
    return d_x, d_wx, d_wh, d_b


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, a bidirectional LSTM, a projection to tags and CRF transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "emb": scale(N_CLASSES, EMBED) * 3,
            "fx": scale(EMBED, 4 * HIDDEN), "fh": scale(HIDDEN, 4 * HIDDEN), "fb": np.zeros(4 * HIDDEN, np.float32),
            "bx": scale(EMBED, 4 * HIDDEN), "bh": scale(HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32),
            "w": scale(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32),
        }

    def emissions(self, x, train=False):
        p = self.p
        e = p["emb"][x]
        f, kf = _lstm(e, p["fx"], p["fh"], p["fb"], False)
        b, kb = _lstm(e, p["bx"], p["bh"], p["bb"], True)
        h = np.concatenate([f, b], axis=2)
        scores = h @ p["w"] + p["c"]
        return (scores, (e, kf, kb, h)) if train else scores

    def step(self, x, y):
        """Gradients of the CRF's negative log likelihood, the mean over the batch."""
        p = self.p
        s, (e, kf, kb, h) = self.emissions(x, train=True)
        n, steps, _ = s.shape
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, steps):
            alpha[:, t] = s[:, t] + _logsum(alpha[:, t - 1, :, None] + p["trans"], 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _logsum(p["trans"] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        d_s = np.exp(alpha + beta - z[:, None, None])
        d_t = np.zeros_like(p["trans"])
        for t in range(1, steps):
            pair = alpha[:, t - 1, :, None] + p["trans"] + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            d_t += np.exp(pair).sum(0)
            np.subtract.at(d_t, (y[:, t - 1], y[:, t]), 1)
        rows = np.arange(n)[:, None]
        d_s[rows, np.arange(steps), y] -= 1
        d_s /= n
        g = {"trans": d_t / n, "w": np.einsum("nth,ntk->hk", h, d_s), "c": d_s.sum((0, 1))}
        d_h = d_s @ p["w"].T
        d_ef, g["fx"], g["fh"], g["fb"] = _lstm_back(e, p["fx"], p["fh"], kf, d_h[:, :, :HIDDEN])
        d_eb, g["bx"], g["bh"], g["bb"] = _lstm_back(e, p["bx"], p["bh"], kb, d_h[:, :, HIDDEN:])
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], x.ravel(), (d_ef + d_eb).reshape(-1, EMBED))
        return g

    def fit(self, x, y, epochs=6, batch=64, rate=0.02, seed=3):
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        n, total = 0, epochs * (len(x) // batch)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x) - batch + 1, batch):
                part = order[at : at + batch]
                g = self.step(x[part], y[part])
                n += 1
                size = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
                pace = rate * (1 - 0.95 * n / total)
                for k, d in g.items():
                    d = (d * min(1.0, 5.0 / (size + 1e-9))).astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)
        return self

    def decode(self, x):
        """The best tag path of each window."""
        s = self.emissions(x)
        trans = self.p["trans"]
        n, steps, _ = s.shape
        best, back = s[:, 0], np.zeros((n, steps, TAGS), np.int8)
        for t in range(1, steps):
            c = best[:, :, None] + trans
            back[:, t] = c.argmax(1)
            best = c.max(1) + s[:, t]
        tags = np.zeros((n, steps), np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags


def labelled_spans(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows of invented prose with labelled spans of each kind, and with look-alikes that are none."""
    r = np.random.default_rng(seed)
    pick = lambda options: options[int(r.integers(len(options)))]
    digits = lambda k: "".join(str(int(d)) for d in r.integers(0, 10, k))
    lower = "abcdefghijklmnopqrstuvwxyzéèüñ"
    word = lambda: "".join(pick(lower) for _ in range(int(r.integers(2, 9))))
    latin = lambda: "".join(pick(lower[:26]) for _ in range(int(r.integers(2, 9))))

    def email():
        local = pick([latin, lambda: latin() + "." + latin(), lambda: latin() + "." + digits(2), lambda: latin() + digits(3)])()
        host = pick([latin, lambda: latin() + digits(1), lambda: latin() + "-" + latin()])()
        at = pick(["@", "@", "@", "@", " @ ", "(at)@"[:4]])
        if "@" not in at:
            local += digits(2)
        return local + at + host + "." + pick(["com", "org", "net", "de", "fr", "example.com", "co.uk"])

    def ip():
        return ".".join(str(int(x)) for x in r.integers(0, 256, 4))

    def card():
        gap = pick(["", "", " ", "-"])
        return gap.join(digits(4) for _ in range(4)) if r.random() < 0.85 else digits(4) + gap + digits(6) + gap + digits(5)

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(2)}{a}{b}{c}", f"{a}.{b}.{c}"])

    def none():
        return pick([
            lambda: digits(4), lambda: digits(2), lambda: digits(1) + "." + digits(1) + ".", lambda: digits(1) + ".",
            lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: "$" + digits(3) + "." + digits(2), lambda: digits(2) + "%",
            lambda: "v" + digits(1) + "." + digits(2) + "." + digits(1), lambda: "@" + latin(), lambda: digits(2) + ":" + digits(2),
            lambda: digits(6), lambda: digits(1) + "," + digits(3) + "," + digits(3), lambda: "#" + digits(5),
            lambda: 'token = "' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"', lambda: digits(3) + " x " + digits(3),
            lambda: digits(24), lambda: "".join(pick("0123456789abcdef") for _ in range(32)), lambda: latin() + digits(2),
        ])()

    makers = (email, ip, card, phone)
    xs, ys = np.full((n, WIDTH), PAD, np.int64), np.zeros((n, WIDTH), np.int64)
    for row in range(n):
        text, tags = "", []
        style = pick(["", "", "", "!!", "***", "%%%", " |", "###"])
        while len(text) < WIDTH + 30:
            roll = r.random()
            if roll < 0.16:
                k = int(r.integers(4))
                piece = makers[k]()
                mark = [1 + 2 * k] + [2 + 2 * k] * (len(piece) - 1)
            elif roll < 0.28:
                piece = none()
                mark = [0] * len(piece)
            else:
                piece = word()
                piece = piece.upper() if style == "!!" else piece.capitalize() if r.random() < 0.15 else piece
                mark = [0] * len(piece)
            tail = pick(["", "", "", "", ",", ".", ".\n"]) + style + ("" if text.endswith("\n") else " ")
            text += piece + tail
            tags += mark + [0] * len(tail)
        lo = int(r.integers(0, 30)) if r.random() < 0.8 else 0
        hi = min(len(text), lo + (WIDTH if r.random() < 0.6 else int(r.integers(20, WIDTH))))
        cut = tags[lo:hi]
        if cut and cut[0] and cut[0] % 2 == 0:  # a span cut at the edge is seen again whole by another window
            j = 0
            while j < len(cut) and cut[j] and cut[j] % 2 == 0:
                cut[j] = 0
                j += 1
        xs[row, : hi - lo] = classes(text[lo:hi])
        ys[row, : hi - lo] = cut
    return xs, ys


#: Labelled windows that the model is trained on.
TRAINING_WINDOWS = 3_000
_trained: dict[int, Tagger] = {}


def trained(n: int = TRAINING_WINDOWS) -> Tagger:
    if n not in _trained:
        _trained[n] = Tagger().fit(*labelled_spans(n))
    return _trained[n]


def _windows(marks: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows of at most WIDTH characters that cover CONTEXT characters around every mark."""
    out = []
    breaks = np.flatnonzero(np.diff(marks) > 2 * CONTEXT)
    for first, last in zip(np.r_[marks[:1], marks[breaks + 1]], np.r_[marks[breaks], marks[-1:]], strict=True):
        lo, end = max(0, int(first) - CONTEXT), min(length, int(last) + CONTEXT + 1)
        while end - lo > WIDTH:
            out.append((lo, lo + WIDTH))
            lo += WIDTH // 2
        out.append((lo, end))
    return out


def _padded(size: int) -> int:
    """The width a window is padded to; it hangs on the window alone, so a text's tags do not hang on its neighbours."""
    return -(-size // 16) * 16


def _alike(jobs: list[tuple], batch: int):
    """Batches of windows, given in order of size, that are padded to one width."""
    for _, group in itertools.groupby(jobs, lambda job: _padded(job[0])):
        own = list(group)
        yield from (own[lo : lo + batch] for lo in range(0, len(own), batch))


def model_spans(texts: list[str], tagger: Tagger, batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the model finds in each text."""
    coded, jobs = [], []
    for k, text in enumerate(texts):
        ats = [i for m in (_AT.finditer(text) if "(" in text or "[" in text else ()) for i in range(*m.span())]
        if "@" not in text and not ats and not _DIGIT.search(text):
            coded.append(None)
            continue
        x = classes(text)
        coded.append(x)
        digit, at = len(_CLASSES) + 1, 1 + _CLASSES.index("@")
        marks = (x == digit) | (x == at)
        marks[ats] = True
        marks = np.flatnonzero(marks)
        jobs += [(hi - lo, k, lo, hi) for lo, hi in _windows(marks, len(x))]
    jobs.sort()
    depth = {}
    tags = {}
    for part in _alike(jobs, batch):
        x = np.full((len(part), _padded(part[0][0])), PAD, np.int64)
        for row, (_, k, lo, hi) in enumerate(part):
            x[row, : hi - lo] = coded[k][lo:hi]
        y = tagger.decode(x)
        for row, (size, k, lo, hi) in enumerate(part):
            if k not in tags:
                tags[k] = np.zeros(len(coded[k]), np.int8)
                depth[k] = np.full(len(coded[k]), -1, np.int32)
            here = np.minimum(np.arange(size), np.arange(size)[::-1])
            if lo == 0:
                here = np.maximum(here, np.arange(size)[::-1])
            if hi == len(coded[k]):
                here = np.maximum(here, np.arange(size))
            better = here > depth[k][lo:hi]
            tags[k][lo:hi][better] = y[row, :size][better]
            depth[k][lo:hi][better] = here[better]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, t in tags.items():
        inside = np.flatnonzero(t)
        start = kind = end = -1
        for i in inside:
            this = (int(t[i]) - 1) // 2
            if i == end and this == kind and t[i] % 2 == 0:
                end = i + 1
                continue
            if start >= 0:
                out[k].append((int(start), kind, int(end)))
            start, kind, end = i, this, i + 1
        if start >= 0:
            out[k].append((int(start), kind, int(end)))
    return out


def plausible(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a span of the model could be of its kind: it holds what the kind cannot lack."""
    span = text[start:end]
    n = sum("0" <= c <= "9" for c in span)
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    if kind == 0:
        return ("@" in span or _AT.search(span) is not None) and "." in span and len(span) >= 6
    if kind == 1:
        return n >= 4 and span.count(".") == 3
    if kind == 2:
        return 14 <= n <= 19 and n >= len(span) - 5 and luhn("".join(c for c in span if "0" <= c <= "9"))
    return 10 <= n <= 15 and (len(span) > n or _PHONE_WORD.search(text[max(0, start - 2 * CONTEXT) : start]) is not None)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of addresses with an at in brackets and of bare numbers behind a word for phones."""
    found = []
    last = 0
    for m in _AT_DOMAIN.finditer(text) if "(" in text or "[" in text else ():
        start = mark = m.start() - (text[m.start() - 1 : m.start()] == " ")
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < mark:
            found.append((start, 0, m.end()))
            last = m.end()
    for m in _NUMBER.finditer(text):
        joined = _JOINED_BEFORE.search(text[max(0, m.start() - 2) : m.start()]) or _JOINED_BEHIND.match(text, m.end())
        if not joined and plausible(text, m.start(), 3, m.end()):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def find_personal_data(texts: list[str | None], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    whole = [t or "" for t in texts]
    out = []
    for text, more in zip(whole, model_spans(whole, tagger), strict=True):
        base = base_spans(text)
        every = list(base)
        held = bytearray(len(text))  # so that many spans are as cheap each as few

        def take(lo, kind, hi, every=every, held=held):
            if 1 not in held[lo:hi]:
                every.append((lo, kind, hi))
                held[lo:hi] = b"\x01" * (hi - lo)

        for lo, _, hi in base:
            held[lo:hi] = b"\x01" * (hi - lo)
        for lo, kind, hi in plain_spans(text):
            take(lo, kind, hi)
        for start, kind, end in more:
            pieces = [(start, end)]
            if not plausible(text, start, kind, end):  # neighbours that the model took for one
                pieces = [(start + m.start(), start + m.end()) for m in _PIECE.finditer(text[start:end])]
            for lo, hi in pieces:
                if plausible(text, lo, kind, hi):
                    take(lo, kind, hi)
        out.append((base, sorted(every)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind in angle brackets."""
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if end <= at:
            continue
        out += [text[at : max(at, start)], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join(out) + text[at:]


def scan(documents: DataFrame, keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """Adds counts and spans; with ``redacted`` also ``redacted_text``."""
    tagger = trained()
    added = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType())]
    added += [("redacted_text", T.StringType())] * redacted

    def make(texts):
        made: dict[str, list] = {name: [] for name, _ in added}
        for text, (base, every) in zip(texts, find_personal_data(texts, tagger), strict=True):
            for k, kind in enumerate(KINDS):
                made[f"n_{kind}"].append(sum(x[1] == k for x in base))
            made["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            made["spans"].append(written(every))
            if redacted:
                made["redacted_text"].append(redact(text, every))
        return made

    return map_texts(documents, "text", make, added, keep)


def op8_personal_data(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
