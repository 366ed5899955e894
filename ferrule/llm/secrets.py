"""Secret scans: patterns propose candidates, a random forest removes false positives.

Candidates are tokens that look like keys: values quoted or assigned to a name for keys,
passwords in addresses, tokens of known shapes, and long unbroken runs of letters and digits.  A forest of decision trees, trained
here in numpy from labelled findings, judges each by its length, character classes and
transitions, spread of characters, share covered by dictionary words, the path it may stand in, and
the words beside it.

Labelled findings come as rows (text before, candidate, text after, is_secret); without
any, a generator writes them from public shapes of keys and of their look-alikes
(checksums of files, identifiers, numbers, placeholders, prose, embedded images, rules of dashes).

An assigned value follows a name for keys, with a suffix of up to 25 characters, and ``=`` or ``:``; in quotes it may
hold blanks and ends with its line at the latest; one without quotes ends at white space, quotes, brackets, commas, semicolons or ``&`` and has eight characters at least.

Defined results: null and empty texts have no candidates; texts are read whole; spans are
code points, ends exclusive; equal texts get equal results; candidates do not overlap
(leftmost, then longest); extra columns are left out unless kept by name.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, table

_CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"
)
_QUOTED = re.compile(r"""(?:[=:]\s{0,4})(["'])([^"'\s]{8,}+)\1""")
_ASSIGNS = re.compile(r"(?<=[A-Za-z0-9_\s-])[=:]")
_NAMES = re.compile(
    r"(?:secret|token|passwo?r?d|passphrase|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key)(?:[_-][A-Za-z0-9_-]{0,24})?\s{0,4}$", re.I
)
_PHRASE = re.compile(r"""\s{0,4}(["'])([^"'\r\n]{8,}+)\1""")
_VALUE = re.compile(r"\s{0,4}(?!\$)([^\s\"'`<>(){}\[\],;&]{8,}+)")
_LOGIN = re.compile(r"://[^\s:/@\"'<>]++:([^\s/@\"'<>]{8,}+)@")
_WORD = re.compile(r"[A-Za-z]+")
_KEYED = re.compile(r"(?:secret|token|passw|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|signature)", re.I)
_HARMLESS = re.compile(r"(?:sha(?:1|256|512)?|md5|checksum|digest|commit|hash|etag|uuid|guid|integrity|revision|example|sample|placeholder|dummy|id)(?![A-Za-z])", re.I)
_SHAPE = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|sk-|AIza|glpat-|npm_|eyJ|-----BEGIN")
_DICTIONARY = frozenset(
    "the and for with that this from have are was not you all your can will one our out use any new get set time page"
    " name value user data file path test example sample index list item type class code line text string number key"
    " token secret password public private access config server client host local http https www com org net html json"
    " xml image video photo article news blog post category product order account login home search about contact help"
    " changeme placeholder insert here replace dummy default content main body header footer style script version build".split()
)

FEATURES = (
    "length", "digits", "lower", "upper", "symbols", "changes", "case_changes", "entropy", "hex", "longest_run",
    "dictionary", "vowels", "path", "extension", "assigned", "quoted", "keyed", "harmless", "shape", "distinct", "all_digits",
    "common_bigrams", "dashes", "login", "embedded", "marks",
)
_BIGRAMS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())


def candidates(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in _CANDIDATE.finditer(text)]
    if '"' in text or "'" in text:
        found += [m.span(2) for m in _QUOTED.finditer(text)]
    read = 0
    for m in _ASSIGNS.finditer(text):
        if m.start() < read or not _NAMES.search(text[max(0, m.start() - 48) : m.start()]):
            continue
        phrase = _PHRASE.match(text, m.end())
        if phrase:
            found.append(phrase.span(2))
            continue
        value = _VALUE.match(text, m.end())
        if value:
            start, read = value.span(1)
            end = start + len(value[1].rstrip(".:"))  # a sentence's end
            if end - start >= 8:
                found.append((start, end))
    found += [m.span(1) for m in _LOGIN.finditer(text)]
    out, last = [], 0
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= last:
            out.append((start, end))
            last = end
    return out


def _characters(tokens: list[str]) -> dict[str, np.ndarray]:
    """What the characters of tokens tell: each feature of all tokens at once."""
    size = np.array([len(t) for t in tokens])
    code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    own = np.repeat(np.arange(len(tokens)), size)
    per_token = lambda mask, at=own: np.bincount(at, weights=mask, minlength=len(tokens))
    kind = np.full(len(code), 3)
    for k, (a, z) in enumerate(("az", "AZ", "09")):
        kind[(code >= ord(a)) & (code <= ord(z))] = k
    low = np.where(kind == 1, code + 32, code)
    letter = kind <= 1
    alpha, wide = letter.copy(), np.unique(code[code > 127])
    alpha |= np.isin(code, [c for c in wide.tolist() if chr(c).isalpha()])
    inside, before = own[1:] == own[:-1], own[1:]
    differs = inside & (kind[1:] != kind[:-1])
    turns = differs & letter[1:] & letter[:-1]
    twos = inside & alpha[1:] & alpha[:-1]
    common = twos & np.isin(low[:-1] << 7 | low[1:], [ord(x[0]) << 7 | ord(x[1]) for x in _BIGRAMS]) & letter[1:] & letter[:-1]
    starts = np.flatnonzero(np.r_[True, ~inside | differs])
    longest = np.zeros(len(tokens), np.int64)
    np.maximum.at(longest, own[starts], np.diff(np.r_[starts, len(code)]))
    held, counts = np.unique(own << 21 | code, return_counts=True)
    share = counts / size[held >> 21]
    pairs = np.maximum(1, size - 1)
    return {
        "length": np.minimum(size, 200), "lower": per_token(kind == 0) / size, "upper": per_token(kind == 1) / size, "digits": per_token(kind == 2) / size,
        "symbols": per_token(kind == 3) / size, "changes": per_token(differs, before) / pairs, "case_changes": per_token(turns, before) / pairs,
        "entropy": -per_token(share * np.log2(share), held >> 21), "hex": per_token((kind == 2) | ((low >= 97) & (low <= 102))) == size, "longest_run": longest / size,
        "vowels": per_token(np.isin(low, [ord(c) for c in "aeiou"]) & letter) / np.maximum(1, per_token(letter)), "distinct": np.bincount(held >> 21, minlength=len(tokens)) / size,
        "all_digits": per_token(kind == 2) == size, "common_bigrams": per_token(common, before) / np.maximum(1, per_token(twos, before)),
        "dashes": per_token(code == ord("-")), "marks": per_token(np.isin(code, [ord(c) for c in "!#%^*?~&$"])) > 0,
    }


def describe(found: list[tuple[str, str, str]]) -> np.ndarray:
    """(candidates, FEATURES) from (before, token, after); ``before`` and ``after`` are some 40 characters beside it."""
    told = _characters([t for _, t, _ in found])
    beside = []
    for before, token, after in found:
        pieces = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))
        near = before[-24:]
        beside.append((
            sum(len(p) for p in pieces if p.lower() in _DICTIONARY) / len(token), "/" in token or before[-1:] in ("/", "\\") or after[:1] in ("/", "\\"),
            re.match(r"\.[a-z]{2,4}\b", after) is not None, re.search(r"[=:]\s*[\"']?$", before) is not None, before[-1:] in ("'", '"') and after[:1] in ("'", '"'),
            _KEYED.search(near) is not None, _HARMLESS.search(near) is not None, _SHAPE.match(token) is not None, after[:1] == "@", "base64," in before[-7:] + token[:60],
        ))
    told |= zip(("dictionary", "path", "extension", "assigned", "quoted", "keyed", "harmless", "shape", "login", "embedded"), np.array(beside, float).T, strict=True)
    return np.stack([told[name] for name in FEATURES], axis=1).astype(float)


class Forest:
    """Decision trees on bootstrap samples, split by Gini impurity on random subsets of features."""

    def __init__(self, trees: int = 40, depth: int = 8, leaf: int = 3, seed: int = 17):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        r = np.random.default_rng(self.seed)
        self.nodes = [self._grow(x, y.astype(float), r.integers(0, len(x), len(x)), r) for _ in range(self.trees)]
        return self

    def _grow(self, x, y, rows, r):
        feature, limit, left, right, value = [], [], [], [], []

        def node(rows, depth):
            me = len(feature)
            for column, v in ((feature, -1), (limit, 0.0), (left, 0), (right, 0), (value, y[rows].mean())):
                column.append(v)
            if depth == self.depth or len(rows) < 2 * self.leaf or value[me] in (0.0, 1.0):
                return me
            best = (1e-9, None)
            for f in r.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1]))), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(order))
                a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
                impurity = (n * a * (1 - a) + (len(order) - n) * b * (1 - b)) / len(order)
                ok = (v[1:] > v[:-1]) & (n >= self.leaf) & (len(order) - n >= self.leaf)
                if ok.any():
                    i = int(np.where(ok, impurity, np.inf).argmin())
                    gain = value[me] * (1 - value[me]) - impurity[i]
                    if gain > best[0]:
                        best = (gain, (f, (v[i] + v[i + 1]) / 2))
            if best[1] is None:
                return me
            feature[me], limit[me] = best[1]
            goes = x[rows, feature[me]] <= limit[me]
            left[me] = node(rows[goes], depth + 1)
            right[me] = node(rows[~goes], depth + 1)
            return me

        node(rows, 0)
        return tuple(np.array(c) for c in (feature, limit, left, right, value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of secrets, the mean over the trees' leaves."""
        total = np.zeros(len(x))
        for feature, limit, left, right, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= limit[at], left[at], right[at])
                at = np.where(f < 0, at, down)
            total += value[at]
        return total / len(self.nodes)


def generated_findings(n: int, seed: int = 23) -> list[tuple[str, str, str, bool]]:
    """Labelled findings: (text before, candidate, text after, is_secret)."""
    r = np.random.default_rng(seed)
    pick = lambda options: options[int(r.integers(len(options)))]
    chars = lambda alphabet, k: "".join(alphabet[int(i)] for i in r.integers(0, len(alphabet), k))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "th er in on an re ed ti es or st en at to nt ha nd ou ea is de ci ón ie au le ment tion ung sch ver".split()
    ascii_syllables = [x for x in syllables if x.isascii()]
    word = lambda: "".join(pick(syllables) for _ in range(int(r.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(int(r.integers(2, 6))))
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "API_TOKEN", "passwd", "bearer"]
    key_ids = ["access_key_id", "aws_access_key_id", "AWS_ACCESS_KEY_ID"]
    attributes = [' class="', ' href="', ' name: "', " title = '", '"label": "', "?ref=", "&utm_campaign=", " file=", " lang: '", " alt='"]
    plain = lambda: "".join(pick(ascii_syllables) for _ in range(int(r.integers(2, 4))))
    phrase = lambda: pick(["-", "-", "_", ""]).join(plain() for _ in range(int(r.integers(3, 6))))
    schemes = ["https", "postgres", "mysql", "redis", "ftp", "amqp", "mongodb+srv"]
    bare = lambda: (plain() + plain() + plain())[: int(r.integers(8, 12))]

    def password():
        typed = plain()[:6] + chars(mixed[52:], int(r.integers(1, 5)))
        token = pick([typed.capitalize(), typed, typed + plain()[:6], chars(mixed + "!#%^*?~", 8)]) + pick(["!", "#", "?", "*", "%"]) + chars(mixed, int(r.integers(2, 6)))
        return token + chars(mixed, max(0, 8 - len(token)))

    out = []
    for _ in range(n):
        shout = (lambda s: s.upper()) if r.random() < 0.1 else (lambda s: s)
        if r.random() < 0.5:
            kind = int(r.integers(10))
            token = [
                lambda: chars(hexes, pick([32, 40, 40, 40, 64])), lambda: chars(mixed, int(r.integers(20, 60))),
                lambda: pick(["AKIA", "ASIA"]) + chars(mixed[:26] + "234567", 16), lambda: pick(["ghp_", "gho_", "glpat-", "sk_live_", "npm_"]) + chars(mixed, 36),
                lambda: chars(mixed + "+/", pick([40, 44, 64])), lambda: pick(["xoxb-", "xoxp-"]) + chars("0123456789", 12) + "-" + chars(mixed, 24),
                lambda: chars(mixed + "+/", int(r.integers(200, 1_800))), lambda: pick([phrase, phrase, lambda: chars(mixed[:52], int(r.integers(16, 40)))])(),
                password, password,
            ][kind]()
            quote = pick(['"', '"', "'", ""])
            if kind == 8 and r.random() < 0.5:
                token = bare() if quote and r.random() < 0.6 else " ".join(plain() for _ in range(4)) if quote else (plain() + chars(mixed[52:], int(r.integers(1, 4))) + pick([plain, bare])())[:24]
            before = prose() + pick([" ", " ", "?", "&"]) + pick(key_ids if kind == 2 and r.random() < 0.3 else names) + pick([" = ", "=", ": ", " : "]) + quote
            if kind in (2, 3, 5) and r.random() < 0.5:
                quote, before = "", prose() + " "
            if kind in (0, 1) and r.random() < 0.3:
                quote, before = "", prose() + pick([" Authorization: Bearer ", " authorization: bearer ", " Authorization: Basic "])
                token = token if kind else chars(hexes, int(r.integers(20, 41)))
            if kind == 9:
                before, after = prose() + " " + pick(schemes) + "://" + plain() + ":", "@" + plain() + pick([".com", ":5432", "/"]) + " " + prose()
                out.append((before, token, after, True))
                continue
            out.append((shout(before), shout(token), quote + " " + prose(), True))
        else:
            kind = int(r.integers(16))
            before, after = prose() + " ", " " + prose()
            if kind == 0:
                token, before = chars(hexes, pick([32, 40, 64])), prose() + pick([" sha256: ", " md5=", " commit ", " checksum: ", " etag: ", " sha1 "])
            elif kind == 1:
                token = chars("0123456789", int(r.integers(16, 28)))
            elif kind == 2:
                token = "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12))
            elif kind == 3:
                token, before, after = "/".join(word() + pick(["", "-", "_"]) + chars("0123456789", 2) for _ in range(4)), before + "/", pick([".html", ".png", ".js", " "]) + after
            elif kind == 4:
                token = (word() + word() + word() + word() + word())[:60] + chars("0123456789", int(r.integers(1, 4)))
            elif kind == 5:
                token, before = pick(["your-token-goes-here1", "changeme-changeme-01", "example_secret_key_1", "xxxxxxxxxxxxxxxxxxx1", "INSERT_API_KEY_HERE_0", "0000000000000000000000"]), prose() + " " + pick(names) + ' = "'
            elif kind == 6:
                token = pick(["-", "_"]).join(word() for _ in range(4)) + "-" + chars("0123456789", 4)
            elif kind == 7:
                token, before = chars(hexes, pick([16, 24, 32, 40])), prose() + pick([" id=", " object id: ", " uuid ", " revision ", ' id = "'])
            elif kind == 8:
                token, before = pick(["public", "main", "images", "product"]) + "/" + word() + "/" + chars("0123456789", 6) + "/" + word() + word(), before + pick(["http://host/", "/"])
            elif kind == 9:
                long = lambda: "".join(pick(ascii_syllables) for _ in range(int(r.integers(7, 13)))).capitalize()
                token = pick([phrase, long, long, lambda: plain() + plain() + plain() + plain(), lambda: "/".join(plain() for _ in range(4))])()
            elif kind == 10:
                token, before = phrase(), prose() + pick(attributes)
                after = (before[-1] if before[-1] in "\"'" else "") + after
            elif kind == 11:
                token, quote = pick(["your-token-goes-here", "changeme-changeme", "insert-password-here", "example_secret_key", "xxxxxxxxxxxxxxxxxxxx", "get_user_access_token", "YOUR_API_KEY_HERE", "user_password_default", "placeholder"]), pick(['"', "'", ""])
                before, after = prose() + " " + pick(names) + pick([" = ", "=", ": "]) + quote, quote + after
            elif kind == 12:
                token, kept = chars(mixed + "+/", int(r.integers(100, 1_800))), pick(["data:image/png;base64,", "data:font/woff2;base64,"])
                before, after = prose() + pick([' src="', " url(", " "]), pick(['"', ")", " "]) + after
                token, before = (kept + token, before) if before[-1] == '"' and r.random() < 0.7 else (token, before + kept)
            elif kind == 13:
                token = pick(["-", "_", "-_", "+-", "/"]) * int(r.integers(16, 80))
            elif kind == 14:
                token, before = bare(), prose() + " " + pick(names) + pick([" = ", "=", ": "])
            else:
                token = pick([".", "_"]).join(pick(["config", "settings", "self", "user", "get", "env", plain()]) for _ in range(3))
                before, after = prose() + " " + pick(names) + pick([" = ", "=", ": "]), pick(["(", "[", ",", ";", " "]) + after
            out.append((shout(before), shout(token), after, False))
    return out


#: Generated findings the forest is trained on, and the share of trees' votes that makes a secret.
TRAINING_FINDINGS = 4_000
DECISION = 0.5
_trained: dict[int, Forest] = {}


def trained(findings: list[tuple[str, str, str, bool]] | None = None, n: int = TRAINING_FINDINGS) -> Forest:
    if findings is None and n in _trained:
        return _trained[n]
    rows = generated_findings(n) if findings is None else findings
    forest = Forest().fit(describe([row[:3] for row in rows]), np.array([s for *_, s in rows]))
    if findings is None:
        _trained[n] = forest
    return forest


def find_secrets(texts: list[str | None], forest: Forest, decision: float = DECISION) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of candidates, spans that are secrets) of each text."""
    places, rows = [], []
    for k, text in enumerate(texts):
        for start, end in candidates(text) if text else []:
            places.append((k, start, end))
            rows.append((text[max(0, start - 40) : start], text[start:end], text[end : end + 40]))
    number, spans = [0] * len(texts), [[] for _ in texts]
    for lo in range(0, len(rows), 20_000):
        for (k, start, end), p in zip(places[lo : lo + 20_000], forest.predict(describe(rows[lo : lo + 20_000])), strict=True):
            number[k] += 1
            if p >= decision:
                spans[k].append((start, end))
    return list(zip(number, spans, strict=True))


def scan(documents: DataFrame, forest: Forest | None = None, keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """Adds n_candidates, n_secrets and spans; with ``redacted`` also ``redacted_text``."""
    forest = forest or trained()
    added = [("n_candidates", T.LongType()), ("n_secrets", T.LongType()), ("spans", T.StringType())]
    added += [("redacted_text", T.StringType())] * redacted

    def make(texts):
        made: dict[str, list] = {name: [] for name, _ in added}
        for text, (n, spans) in zip(texts, find_secrets(texts, forest), strict=True):
            made["n_candidates"].append(n)
            made["n_secrets"].append(len(spans))
            made["spans"].append(",".join(f"{a}:{b}" for a, b in spans))
            if redacted:
                cuts = [0, *[x for s in spans for x in s], len(text or "")]
                parts = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)] if text else []
                made["redacted_text"].append("<SECRET>".join(parts) if text else text)
        return made

    return map_texts(documents, "text", make, added, keep)


def op7_secrets(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
