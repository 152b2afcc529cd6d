"""Personal data: candidate spans, boosted trees, calibrated thresholds.

High-recall generators propose spans, which may overlap. The four base kinds
(email, ip, card, phone) follow fixed formats and always stay. Further
candidates (secrets, national phone numbers, social security numbers, bank
accounts, spelled-out addresses) are scored by gradient-boosted trees over
features of their format and of the characters around them. Scores become
probabilities by isotonic regression on held back examples of each kind; a candidate is
selected if its probability reaches the threshold of its kind, the lowest one with which
at least ``PRECISION`` of further held back candidates are real.

The trees are trained on the driver on generated examples (``EXAMPLES``, a fixed
number) and shipped to the tasks. Offsets are code points, ends exclusive.

Null or empty text: no spans. Equal spans of one kind count once; a proposed
span inside a base span is dropped. Secrets of any length are one whole span. Repeated rows give repeated rows. Columns
other than ``doc_id`` and ``text`` are passed through by ``redact`` and not read
by ``find``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from cohesia.llm.batches import map_batches
from cohesia.llm.boosting import BoostedTrees

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban", "address")
PRECISION = 0.94
EXAMPLES = 12_000
CONTEXT = 32
#: Characters of a candidate that its features are taken from; the span is the whole candidate.
HEAD = 256
Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind; failing matches are dropped without another try."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


# Further candidates: wide formats, cheap to scan for.
_SIGN = re.compile(r"[=:]")
_KEY_BEFORE = re.compile(r"([A-Za-z][A-Za-z0-9_-]{1,23})[\"']?[ \t]{0,4}\Z")
_VALUE_AFTER = re.compile(r"[ \t]{0,4}(?:(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]+)?[\"']?([^\s\"'<>]{4,256})")
_REST = re.compile(r"[^\s\"'<>]*")
_IN_PROSE = re.compile(r"\b(?:[Pp]ass(?:word|wd|phrase|code)|PIN|[Aa]ccess code|[Ss]ecret)[ \t]+(?:(?:is|was)[ \t]+)?[\"']?([^\s\"'<>=:]{4,})")
_IN_URL = re.compile(r"://[^\s/@:]*:([^\s/@]+)@")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{14,}[A-Za-z0-9+/_-]={0,2}")
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?(?:[\[({](?:at|AT)[\])}]|(?<= )(?:at|AT)(?= )) ?[A-Za-z0-9-]{2,40} ?(?:[\[({](?:dot|DOT|\.)[\])}]|(?<= )(?:dot|DOT)(?= )|\.) ?[A-Za-z]{2,10}(?![A-Za-z0-9])")
_TRAIL = ",.;:!?)]}"


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of the kinds the trees decide on."""
    out: set[Span] = set()

    def add(start: int, end: int, kind: str) -> None:
        while end > start and text[end - 1] in _TRAIL:
            end -= 1
        if end - start >= 4:
            out.add((start, end, kind))

    run = 0  # end of the last value that reached its bound: values within it end there, so a run is read once
    for m in _SIGN.finditer(text):
        if _KEY_BEFORE.search(text, max(0, m.start() - 30), m.start()) and (v := _VALUE_AFTER.match(text, m.end())):
            start, end = v.span(1)
            if end - start == HEAD:
                end = run = run if end <= run else _REST.match(text, end).end()
            if "//" not in text[start : start + CONTEXT]:  # an address; what is secret in it is proposed by itself
                add(start, end, "secret")
    if "://" in text:
        out.update((*m.span(1), "secret") for m in _IN_URL.finditer(text))
    for m in _IN_PROSE.finditer(text):
        add(*m.span(1), "secret")
    if _DIGIT.search(text):
        out.update((*m.span(), "secret") for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]))
        out.update((*m.span(), "phone") for m in _NATIONAL.finditer(text))
        out.update((*m.span(), "ssn") for m in _SSN.finditer(text))
        out.update((*m.span(), "iban") for m in _IBAN.finditer(text))
    if "dot" in text or "DOT" in text or "[" in text or "(" in text or "{" in text:
        out.update((*m.span(), "address") for m in _SPELLED.finditer(text))
    return sorted(out)


_CUES = {
    "secret": ("password", "passwd", "passphrase", "passcode", "pwd", "pin", "token", "secret", "api", "key", "auth", "bearer", "basic", "credential"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "cell", "dial", "ring"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "transfer", "pay"),
    "address": ("mail", "contact", "write", "reach", "email", "address"),
}
_AGAINST = {
    "secret": ("page", "title", "see", "figure", "note", "http", "https", "version", "path", "file", "time", "url", "image"),
    "phone": ("version", "order", "isbn", "part", "model", "ref", "invoice", "between", "id", "serial"),
    "ssn": ("part", "model", "item", "order", "ref", "serial", "sku"),
    "iban": ("part", "model", "code", "serial", "product"),
    "address": ("meet", "arrived", "look", "stood", "stop", "ended"),
}
_WORDS = re.compile(r"[^a-z]+")


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate and cues around it."""
    start, end, kind = span
    s = text[start : min(end, start + HEAD)]
    n = len(s)
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    freq = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in freq.values())
    digits, upper, lower = (sum(f(c) for c in s) for f in (str.isdigit, str.isupper, str.islower))
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    near = [w for w in _WORDS.split(before) if w][-4:]
    nearness = lambda words: max((len(near) - k for k, w in enumerate(reversed(near)) for c in words if w.startswith(c) or w.endswith(c)), default=0)
    iban = valid = 0.0
    flat = s.replace(" ", "")
    if kind == "iban":
        iban = float(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1)
    if kind == "ssn":
        valid = float(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    marks = Counter(c for c in s if not c.isalnum())
    vowels = sum(c in "aeiouyAEIOUY" for c in s) / max(1, upper + lower)
    return [
        KINDS.index(kind), end - start, digits / n, upper / n, lower / n, entropy, changes, len(freq) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)), float(s[:4] in ("AKIA", "ASIA", "ghp_", "xoxb", "sk_l", "eyJh")),
        nearness(_CUES[kind]), nearness(_AGAINST[kind]), float("=" in before[-4:]), float(":" in before[-4:]), float("://" in before), float(after[:1] == "@"),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), marks["-"] + marks["."], marks["/"], marks["("] + marks["["] + marks["{"], iban, valid,
        float(s[:1].isdigit()), float(s[:1] in "01"), float(before[-1:] in "\"'" and before[-1:] != ""), sum(marks.values()) / n, vowels,
        groups[0] if groups else 0, groups[-1] if groups else 0, len(groups), len(marks),
    ]


def _examples(seed: int, count: int) -> list[tuple[str, Span, int]]:
    """Generated candidates with labels.

    One form stands in several contexts, and some contexts leave open what it is: there the label is drawn, so that no
    threshold separates the kinds without loss.
    """
    r = random.Random(seed)
    draw = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    d, hexed = lambda n: draw("0123456789", n), lambda n: draw("0123456789abcdef", n)
    mixed = lambda n: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", n)
    big = lambda n: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", n)
    syllables = ("the", "an", "er", "on", "re", "ti", "la", "de", "en", "ou", "ment", "sch", "ing", "st", "ver", "qua", "no", "port")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    odds = lambda p: int(r.random() < p)

    def human() -> str:  # a password as people make them
        return r.choice((word() + d(r.randint(1, 4)), word().capitalize() + r.choice("!$_-#") + d(2), word() + r.choice("!$_#") + word(), mixed(r.randint(7, 14)), d(r.randint(4, 8))))

    def machine() -> str:
        long = r.randint(1, 12) == 1
        jwt = "eyJh" + ".".join(mixed(r.randint(20, 200)) for _ in range(3))
        return r.choice((hexed(r.choice((16, 32, 40, 64))), mixed(r.randint(16, 700 if long else 48)), mixed(r.randint(20, 60)) + "==", jwt))

    def plain() -> str:  # a value that is no secret
        return r.choice((word() + word(), f"{word()}-{word()}", word(), f"{word()}_{word()}", "required", "null", "None", "true", "optional", "changed", "strong", "Bearer", "********", f"{word()}.{r.choice(('py', 'html', 'jpg'))}", f"//{word()}.example.org/{d(4)}", f"{d(2)}:{d(2)}"))

    def secret() -> tuple[str, str, str, int]:
        key = r.choice(("password", "passwd", "pwd", "secret", "db_password", "token", "api_key", "apikey", "auth_token", "access_token", "secret_key", "Authorization"))
        sign = r.choice(("=", ": ", " = ", "='", ' = "', ":", ' : "'))
        other = r.choice(("note", "page", "figure", "title", "see", "path", "time", "version", "file", "name", word()))
        way = r.choice((0, 1, 2, 3, 4, 4, 4, 4, 4, 5, 6, 7, 8, 9, 10, 11, 11, 11))
        if way < 3:
            return f"{key}{sign}", r.choice((human, machine, machine))(), r.choice(("", '"', "'")), 1
        if way == 3:
            return f"{key}{sign}", plain(), "", 0
        if way == 4:
            return f"{other}{sign}", r.choice((plain, plain, lambda: word() + d(2), lambda: word().capitalize() + r.choice(' ,.') + word()))(), "", 0
        if way == 5:  # a long value under a key that says nothing
            return f"{other}{sign}", machine(), "", odds(0.85)
        if way == 6:  # a token on its own
            return "", r.choice(("AKIA" + big(16), r.choice(("ghp_", "sk_live_", "xoxb-")) + mixed(r.randint(20, 36)), hexed(40), machine())), "", odds(0.97)
        if way == 7:
            scheme = r.choice(("jdbc:mysql", "postgres", "https", "ftp", "mongodb", "amqp"))
            return f"{scheme}://{word()}:", human(), f"@{word()}" + r.choice(("", ".example.com/db", ":5432/x")), 1
        if way == 8:
            cue = r.choice(("password ", "the password is ", "passcode was ", "PIN is ", "passphrase "))
            good = odds(0.5)
            return cue, human() if good else r.choice(("required", "policy", "must", "field", "reset", "protected", word())), "", good
        if way == 9:
            return r.choice(("Authorization: Bearer ", "bearer ", "token: Bearer ")), machine(), "", 1
        part = r.choice("/-_")
        look = r.choice((
            lambda: part.join(word() for _ in range(r.choice((3, 4, 5, 60, 90)))) + d(1), lambda: d(r.randint(16, 19)), lambda: f"{d(4)}-{d(2)}-{d(2)}-{word()}-{word()}", lambda: "IMG_" + d(12),
            lambda: f"www.{word()}{word()}.example.org/{d(4)}", lambda: f"https://www.{word()}.example.net/{word()}/{word()}-{d(2)}/index.html", lambda: f"{word()}.{word()}.{word()}{word()}.{d(2)}", lambda: word() * 4 + d(1),
        ))()
        return r.choice(("", "", "see ", "file ", "path=", "see: ")), look, "", 0

    def phone() -> tuple[str, str, str, int]:
        good = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}"))
        bad = r.choice((f"{d(4)} {d(4)} {d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(5)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(3)}", good))
        way = r.randrange(5)
        if way < 2:
            return r.choice(("phone ", "call ", "tel. ", "fax: ", "mobile ", "ring ", "call me on ")), good, "", 1
        if way == 2:
            return "", good, "", odds(0.97 if good[0] == "(" else 0.93)
        return r.choice(("version ", "in ", "order ", "between ", "invoice ", "isbn ", "serial ")), bad, "", 0 if bad != good else odds(0.05)

    def ssn() -> tuple[str, str, str, int]:
        good, way = f"{r.randint(1, 8)}{d(2)}-{r.randint(1, 9)}{d(1)}-{r.randint(1, 9)}{d(3)}", r.randrange(4)
        if way < 2:
            return r.choice(("ssn ", "ssn: ", "social security number ", "social security no. ")), good, "", 1
        if way == 2:
            return "", good, "", odds(0.9)
        return r.choice(("part no. ", "model ", "item ", "order ", "")), r.choice((good, f"9{d(2)}-{d(2)}-{d(4)}", f"000-{d(2)}-{d(4)}")), "", 0

    def iban() -> tuple[str, str, str, int]:
        body = d(18)
        good = f"DE{98 - int(body + '131400') % 97:02d}{body}"
        good = r.choice((good, " ".join(good[i : i + 4] for i in range(0, 22, 4))))
        if odds(0.5):
            return r.choice(("iban ", "account ", "", "pay to ")), good, "", 1
        return r.choice(("", "serial ", "iban ", "product code ")), draw("ABCDEFGH", 2) + d(2) + r.choice((" ", "")).join(["", *(big(4) for _ in range(4))]), "", 0

    def address() -> tuple[str, str, str, int]:
        at, dot = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), ("(at)", "."), ("{at}", "{dot}"), ("at", "dot")))
        top, way = r.choice(("com", "org", "net", "de")), r.randrange(3)
        if way == 0 or at != "at" and way == 1:
            return r.choice(("mail ", "contact ", "write to ", "")), f"{word()}{r.choice(('.', '_', ''))}{word()} {at} {word()} {dot} {top}", "", 1
        if way == 1:
            return "", f"{word()} at {word()} dot {top}", "", odds(0.6)
        return r.choice(("meet ", "they stood ", "look ", "")), r.choice((f"{word()} (at) {word()} . {word()}", f"{word()} at {word()}. {word().capitalize()}", f"{word()} at {word()} dot {word()}")), "", 0

    makers = (secret, secret, secret, phone, ssn, iban, address)
    out = []
    while len(out) < count:
        maker = r.choice(makers)
        cue, value, close, label = maker()
        left, right = " ".join(word() for _ in range(r.randint(0, 6))), " ".join(word() for _ in range(r.randint(0, 4)))
        head = f"{left} {cue}" if left else cue
        # what a generator proposes there is what is judged
        text = f"{head}{value}{close} {right}"
        inside = [c for c in candidates(text) if c[2] == maker.__name__ and c[0] < len(head) + len(value) and c[1] > len(head)]
        out += [(text, c, label) for c in inside[:2]]
    return out[:count]


def _rising(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: the lowest score of each step, and the share of ones there (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    score, label = score[order], label[order]
    steps: list[list[float]] = []  # lowest score, ones, rows
    for s, y in zip(score.tolist(), label.tolist(), strict=True):
        steps.append([s, y, 1.0])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, ones, rows = steps.pop()
            steps[-1][1] += ones
            steps[-1][2] += rows
    return np.array([s for s, *_ in steps]), np.array([(y + 0.5) / (n + 1.0) for _, y, n in steps])


@dataclass
class Detector:
    trees: BoostedTrees
    calibration: dict[str, tuple[np.ndarray, np.ndarray]]
    thresholds: dict[str, float]

    def probabilities(self, kinds: list[str], x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities that candidates of the given kinds are what they look like."""
        raw, out = self.trees.predict(x), np.zeros(len(x))
        for i, (kind, v) in enumerate(zip(kinds, raw, strict=True)):
            low, share = self.calibration[kind]
            out[i] = share[max(0, int(np.searchsorted(low, v, side="right")) - 1)]
        return out

    def spans(self, text: str) -> list[Span]:
        """Base spans and selected candidates by start, then kind as listed."""
        base = base_spans(text)
        more = [c for c in candidates(text) if not any(b[0] <= c[0] and c[1] <= b[1] for b in base)] if text else []
        if more:
            p = self.probabilities([c[2] for c in more], np.array([features(text, c) for c in more]))
            more = [c for c, v in zip(more, p, strict=True) if v >= self.thresholds[c[2]]]
        return sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _threshold(p: np.ndarray, label: np.ndarray) -> float:
    """The lowest calibrated probability from which on at least PRECISION of the held-out candidates are real."""
    best = 1.0
    for limit in sorted(set(p.tolist()), reverse=True):
        chosen = label[p >= limit]
        if chosen.mean() >= PRECISION:
            best = limit
    return best


@lru_cache(maxsize=2)
def train(seed: int = 11) -> Detector:
    """Trees from half of the examples, calibration from a quarter, thresholds from the last."""
    rows = _examples(seed, EXAMPLES)
    x, y = np.array([features(t, s) for t, s, _ in rows]), np.array([k for *_, k in rows], dtype=float)
    kinds = np.array([s[2] for _, s, _ in rows])
    part = np.arange(len(rows)) % 4
    trees = BoostedTrees().fit(x[part < 2], y[part < 2])
    raw = trees.predict(x)
    learned = [k for k in KINDS if (kinds == k).any()]
    detector = Detector(trees, {k: _rising(raw[(part == 2) & (kinds == k)], y[(part == 2) & (kinds == k)]) for k in learned}, {})
    for k in learned:
        own = (part == 3) & (kinds == k)
        detector.thresholds[k] = _threshold(detector.probabilities([k] * int(own.sum()), x[own]), y[own])
    return detector


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(documents: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of base spans and all spans, for every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(train())

    def make():
        detector = shared.value

        def step(batch):
            found = [detector.spans(t or "") for t in batch.column("text").to_pylist()]
            base = [base_spans(t or "") for t in batch.column("text").to_pylist()]
            out = {"doc_id": batch.column("doc_id")}
            out |= {f"n_{k}": [sum(s[2] == k for s in b) for b in base] for k in BASE}
            order = lambda s: (s[0], KINDS.index(s[2]), s[1])
            out["base_sha256"] = [hashlib.sha256(_joined(sorted(b, key=order)).encode()).hexdigest() for b in base]
            out["spans"] = [_joined(s) for s in found]
            return out

        return step

    return map_batches(documents.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _replaced(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns, every span in ``column`` replaced by its kind; null stays null."""
    shared = documents.sparkSession.sparkContext.broadcast(train())

    def make():
        detector = shared.value

        def step(batch):
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            out[column] = [t if t is None else _replaced(t, detector.spans(t)) for t in batch.column(column).to_pylist()]
            return out

        return step

    return map_batches(documents, make, documents.schema)
