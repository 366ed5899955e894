"""Language identification with error-correcting output codes.

Every language has a codeword.  Linear classifiers over hashed byte n-grams (one to three
bytes, words padded with blanks) each predict a bit; decoding charges a language the
logistic loss of its bits, weighted by how well each classifier separates the training
rows, and takes the cheapest.  A small gap to the runner-up flags the text as ambiguous.  A text whose
cheapest codeword still costs nearly as much as tossed coins, as a whole and in most of its
pieces, is flagged as foreign: no language learned is its own.  (As a whole a text in two
learned languages costs as much; its pieces do not.)

Training uses a bounded sample: at most ``PER_LANGUAGE`` rows a language, ``MOST_LANGUAGES``
languages (the most frequent) and ``TRAINING_ROWS`` rows in all, picked by a digest among
labelled rows that are not held out.  Predictions read whole texts and nothing else.

Defined results: null texts and texts without a letter are ``und`` with score 0; texts of
letters with no labelled row to learn from are ``und`` too, and none of these is foreign; rows with a null ``doc_id`` are
not held out and not learned from; equal texts get equal predictions; extra columns are
left out unless kept by name.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

PER_LANGUAGE = 400
MOST_LANGUAGES = 1_000
TRAINING_ROWS = 4_000
BUCKETS = 4_096
#: A gap of weighted losses between the two best languages under which a text is ambiguous.
AMBIGUOUS = 0.01
#: A weighted loss (tossed coins have 0.69) from which a text of so many bytes in letters, and a piece of it, is foreign.
FOREIGN, FOREIGN_BYTES, PIECE_BYTES = 0.45, 128, 64
UNKNOWN = "und"

#: ASCII bytes other than letters become blanks.
_LETTER_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Number signs (\u00bd, \u00b2, \u2460) and marks are none."""
    return bool(text) and any(map(str.isalpha, text))


def _letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTER_BYTES).split())


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram shares, as a unit vector."""
    return _features(_letters(text))


def _features(joined: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + joined + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    shift = np.uint32(32 - 12)
    codes = np.concatenate(
        [
            (b * np.uint32(2654435761)) >> shift,
            ((two + np.uint32(65_537)) * np.uint32(2246822519)) >> shift,
            ((three + np.uint32(40_503)) * np.uint32(3266489917)) >> shift,
        ]
    )
    x = np.sqrt(np.bincount(codes, minlength=BUCKETS).astype(np.float32))
    return x / (np.linalg.norm(x) + 1e-9)


def _pieces(joined: bytes) -> list[bytes]:
    """Words run together to pieces of some ``PIECE_BYTES``; a short rest joins none."""
    out, held, size = [], [], 0
    for word in joined.split(b" "):
        held.append(word)
        size += len(word) + 1
        if size >= PIECE_BYTES:
            out.append(b" ".join(held))
            held, size = [], 0
    return out


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """(k, bits) of -1 and 1: all splits of few languages, else random rows far from each other."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 6:
        columns = [c for c in itertools.product((-1, 1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    r = np.random.default_rng(seed)
    bits = max(15, int(np.ceil(6 * np.log2(k))))
    best, apart = None, -1
    for _ in range(200):
        m = np.where(r.random((k, bits)) < 0.5, -1.0, 1.0)
        m = m[:, np.abs(m.sum(0)) < k]
        gap = int(((m.shape[1] - m @ m.T) / 2 + np.eye(k) * bits).min())
        if gap > apart:
            best, apart = m, gap
    return best


class CodeClassifier:
    """One linear classifier a bit and the languages' codewords."""

    def __init__(self, x: np.ndarray, labels: list[str], steps: int = 150, decay: float = 1e-4):
        self.names = sorted(set(labels))
        self.code = codewords(len(self.names))
        y = self.code[[self.names.index(v) for v in labels]]
        share = np.array([labels.count(v) for v in labels], float)
        weight = ((1 / share) / (1 / share).sum())[:, None].astype(np.float32)
        w = np.zeros((x.shape[1], y.shape[1]), np.float32)
        bias, ahead, ahead_bias = np.zeros(y.shape[1], np.float32), w.copy(), np.zeros(y.shape[1], np.float32)
        for n in range(steps):  # accelerated gradient descent on the mean logistic loss
            z = y * (x @ ahead + ahead_bias)
            g = (-y / (1 + np.exp(np.clip(z, -30, 30))) * weight).astype(np.float32)
            new = ahead - 4.0 * (x.T @ g + decay * ahead)
            new_bias = ahead_bias - 4.0 * g.sum(0)
            pace = n / (n + 3)
            ahead, ahead_bias = new + pace * (new - w), new_bias + pace * (new_bias - bias)
            w, bias = new, new_bias
        self.w, self.bias = w, bias
        margin = y * (x @ w + bias)
        right = ((margin > 0) * weight).sum(0)
        self.trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
        self.trust /= self.trust.sum()

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each language for each row."""
        z = (x @ self.w + self.bias)[:, None, :] * self.code
        return (np.logaddexp(0, -z) * self.trust).sum(2)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores between 0 and 1, gaps to the runner-up, and losses."""
        loss = self.losses(x)
        best = loss.argmin(1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        if len(self.names) == 1:
            gap = np.full(len(x), np.inf)
        else:
            two = np.partition(loss, 1, axis=1)
            gap = two[:, 1] - two[:, 0]
        return [self.names[i] for i in best], (1 / p.sum(1)).astype(float), gap, loss.min(1)


    def is_foreign(self, text: str) -> bool:
        """Whether most pieces of a text of some length are like no language learned."""
        joined = _letters(text)
        pieces = _pieces(joined) if len(joined) >= FOREIGN_BYTES else []
        odd = sum(int((self.losses(np.array([_features(p) for p in pieces[lo : lo + 256]], np.float32)).min(1) >= FOREIGN).sum()) for lo in range(0, len(pieces), 256))
        return 2 * odd > len(pieces)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, rows: int = TRAINING_ROWS) -> CodeClassifier | None:
    """Fit on a bounded sample of labelled rows; None where there is none."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = labelled.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"))
    counts = {r.lang: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(min(MOST_LANGUAGES, rows)).collect()}
    if not counts:
        return None
    each = max(1, min(per_language, rows // len(counts)))
    # rows whose digest falls under the language's share, with room to trim to the bound
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.5 * each / n + 5 / n))])
    digest = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    picked = labelled.where(F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"), digest.alias("digest"))
    picked = picked.where(F.col("digest") < share[F.col("lang")] * (1 << 40))

    def make(texts):
        return {"x": [features(t).astype(np.float16).tobytes() if has_letter(t) else None for t in texts]}

    sample = map_texts(picked, "text", make, [("x", T.BinaryType())], keep=["lang", "digest"]).where("x IS NOT NULL")
    sample = sample.dropDuplicates(["lang", "digest"]).collect()  # rows that repeat id and text are drawn all or none
    taken: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r.lang, r.digest, r.x)):
        if len(taken.setdefault(r.lang, [])) < each:
            taken[r.lang].append(np.frombuffer(r.x, np.float16))
    if not taken:
        return None
    x = np.array([v for lang in sorted(taken) for v in taken[lang]], np.float32)
    return CodeClassifier(x, [lang for lang in sorted(taken) for _ in taken[lang]])


def identify(documents: DataFrame, model: CodeClassifier | None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score``, ``ambiguous`` and ``foreign``."""

    def make(texts):
        made = {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "ambiguous": [True] * len(texts), "foreign": [False] * len(texts)}
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if model is not None else []
        for lo in range(0, len(rows), 256):
            part = rows[lo : lo + 256]
            names, scores, gaps, losses = model.predict(np.array([features(texts[i]) for i in part], np.float32))
            for i, name, score, gap, loss in zip(part, names, scores, gaps, losses, strict=True):
                made["lang_pred"][i], made["score"][i], made["ambiguous"][i] = name, float(score), bool(gap < AMBIGUOUS)
                made["foreign"][i] = bool(loss >= FOREIGN) and model.is_foreign(texts[i])
        return made

    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType()), ("foreign", T.BooleanType())]
    return map_texts(documents, "text", make, added, keep)


def op3_language(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, train(documents), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous", "foreign")
