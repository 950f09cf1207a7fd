"""Personal data by candidate gradient boosting.

Base patterns (email, ip, card, phone) are taken as they are, in linear time whatever the text. Where they fail, e.g.
when two numbers stand so close that a pattern swallows both, high-recall generators propose overlapping spans of
seven kinds; boosted trees score each by format (digits, separators, check sums, entropy) and context (words and
signs around it); a threshold by kind, calibrated on held-out examples for a precision of ``PRECISION``, selects; of
overlapping selected spans the most probable stays, and none overlaps a base span. The trees learn from examples that
``examples`` composes (seeded; no corpus text is read), so they are the same on every run and size.

Defined results. Null and empty texts: no spans. Whole texts are read, of any length; offsets are code points, ends
exclusive. Equal starts are ordered by kind as listed. Repeated rows are judged alike; empty tables give empty
results; other columns pass through and the operator adds one struct of the caller's name.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, table

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
BASE_KINDS = KINDS[:4]
PRECISION = 0.97
Span = tuple[int, int, int]  # start, end, kind's place in KINDS

# ---- base patterns -------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never starts inside a run of digits unless one ended there, and then no digit follows: looking back is safe.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]+", "", s)


def _emails(t: str) -> Iterator[tuple[int, int]]:
    free, at = 0, t.find("@")
    while at >= 0:
        end = _DOMAIN.match(t, at + 1)
        start = at
        if end:
            while start > free and _LOCAL.match(t, start - 1):
                start -= 1
        if end and start < at:
            yield start, end.end()
            free = end.end()
            at = t.find("@", free)
        else:
            at = t.find("@", at + 1)


def base_spans(t: str) -> list[Span]:
    found = [(a, b, 0) for a, b in _emails(t)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(t) if all(len(z := g.lstrip("0")) < 4 and int(z or 0) < 256 for g in m.groups())]
    for m in _CARD.finditer(t):
        if len(m[0]) > 11 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


# ---- candidates and their features ---------------------------------------------------------------------------------

_B, _E = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
GENERATORS = tuple(
    (KINDS.index(kind), re.compile(pattern))
    for kind, pattern in (
        ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{2,63}){1,4}"),
        ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{2,63}){1,4}"),
        ("ip", _B + r"(?:[0-9A-Fa-f]{1,4}:){3,7}:?(?:[0-9A-Fa-f]{1,4}:){0,3}[0-9A-Fa-f]{1,4}" + _E),
        ("ip", _B + _GROUPS + "::(?:" + _GROUPS + ")?(?![A-Za-z0-9:])"),
        ("ip", "(?<![A-Za-z0-9:])::" + _GROUPS + _E),
        ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
        ("card", r"(?<![0-9])[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?![0-9])"),
        ("card", r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"),
        ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?|00[0-9]{1,3}[ .-])\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
        ("phone", r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
        ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"),
        ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        ("iban", _B + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E),
    )
)
_MAYBE = re.compile(r"[0-9]|[A-Fa-f]:|:[A-Fa-f]|[\[(] ?(?:at|AT) ?[\])]")
CUES = tuple(
    re.compile(p, re.I)
    for p in (
        r"phone|tel\b|tel\.|call|mobil|fax|móvil|appel|anruf", r"card|visa|credit|carte|karte|tarjeta|payment", r"ssn|social|security",
        r"iban|bank|account|konto|compte|cuenta", r"token|key|secret|passw|api|auth|bearer|credential", r"mail|contact|kontakt|write", r"\bip\b|host|server|addr",
        r"commit|sha\d*|md5|hash|checksum|digest|rev", r"order|invoice|isbn|part|serial|version|article|ref|no\.|nr\.|date|page|figure|table", r"[=:]\s*[\"']?\s*$",
    )
)
CONTEXT = 28


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(t: str, start: int, end: int, kind: int) -> list[float]:
    s, before, after = t[start:end], t[max(0, start - CONTEXT) : start], t[end : end + 12]
    d = _digits(s)
    letters = sum(c.isalpha() for c in s)
    prev, nxt = before[-1:] or " ", after[:1] or " "
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(s), len(d), letters, sum(c.isupper() for c in s), sum(c in " .-/()" for c in s), _entropy(s), len(set(d)),
        float(12 <= len(d) <= 19 and luhn(d)), float(kind == 6 and _iban_ok(s)), float(s[:1] == "+"), float("(" in s), float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))),
        float(d[:1] in ("3", "4", "5", "6")) if d else 0.0, float(bool(re.match(r"(?:19|20)[0-9]{2}[-./]", s))), float(bool(re.match(r"(?:000|666|9..)-|...-00|.*-0000$", s))),
        float(prev.isspace()), float(prev in "\"'`"), float(prev.isalnum()), float(prev in "-./+:=#"), float(nxt.isspace()), float(nxt in "\"'`"), float(nxt.isalnum()), float(nxt in "-/+=%"),
        float(bool(re.match(r"(?:sk|pk|ghp|xox|AKIA|eyJ)", s))), *(float(bool(c.search(before))) for c in CUES),
    ]


def candidates(t: str, taken: list[Span]) -> list[Span]:
    if not _MAYBE.search(t):
        return []
    found = {}
    for kind, pattern in GENERATORS:
        for m in pattern.finditer(t):
            found[(m.start(), m.end(), kind)] = None
    if not found:
        return []
    used = sorted((a, b) for a, b, _ in taken)
    starts = [a for a, _ in used]
    ends = list(np.maximum.accumulate([b for _, b in used])) if used else []
    # free of base spans: none that begins before its end reaches past its start
    return [c for c in sorted(found) if not (k := bisect_left(starts, c[1])) or ends[k - 1] <= c[0]]


# ---- boosted trees -------------------------------------------------------------------------------------------------

TREES, DEPTH, RATE, BINS = 60, 3, 0.25, 24


class Boosted:
    """Gradient boosting of oblivious trees (one test by level) for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f, self.trees = np.full(len(y), self.bias), []
        tests = [(j, c, x[:, j] > c) for j, col in enumerate(cuts) for c in col if 0 < (x[:, j] > c).sum() < len(y)]
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h, leaf, tree = y - p, p * (1 - p) + 1e-9, np.zeros(len(y), np.int64), []
            for level in range(DEPTH):
                best, at = -1.0, None
                for j, c, over in tests:
                    split = leaf * 2 + over
                    gain = (np.bincount(split, g, 2 ** (level + 1)) ** 2 / (np.bincount(split, h, 2 ** (level + 1)) + 1.0)).sum()
                    if gain > best + 1e-12:
                        best, at = gain, (j, c, over)
                tree.append(at[:2])
                leaf = leaf * 2 + at[2]
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1.0)
            f = f + value[leaf]
            self.trees.append((tree, value))

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for tree, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for j, c in tree:
                leaf = leaf * 2 + (x[:, j] > c)
            f += value[leaf]
        return 1 / (1 + np.exp(-f))


def composed(seed: int) -> Iterator[tuple[str, Span, int]]:
    """Composed texts without end, a span in each that is of its kind or only looks so, and which of the two (1 or 0)."""
    r = random.Random(seed)
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["th", "er", "on", "la", "que", "sch", "ei", "ción", "re", "an", "ti", "ou"]) for _ in range(r.randint(1, 4)))

    def card(ok: bool) -> str:
        while True:
            d = r.choice("3456" if ok else "0123456789") + dig(r.choice([15, 15, 15, 14, 12, 18]))
            if luhn(d) == ok:
                break
        sep = r.choice(["", "", "", " ", "-", ".", "/"]) if len(d) == 16 else ""
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    def iban(ok: bool) -> str:
        cc, b = "".join(r.choice("ABCDEFGHKLMNPRST") for _ in "12"), dig(r.choice([16, 18, 20, 22]))
        num = int("".join(str(int(c, 36)) for c in b + cc + "00"))
        check = f"{98 - num % 97:02d}" if ok else dig(2)
        return cc + check + b

    def phone() -> str:
        return r.choice(["+1 (%s) %s-%s", "+1-%s-%s-%s", "(%s) %s-%s", "%s-%s-%s", "+49 %s %s %s", "%s.%s.%s", "0033 %s %s %s", "+44 %s %s%s"]) % (dig(3), dig(3), dig(4))

    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    group = lambda: f"{r.randrange(1, 65536) >> r.choice([0, 0, 4, 8, 12]) or 1:x}"
    short_ip = lambda: r.choice(["2001:db8", "fe80", "fd00", "2a02:" + group(), "2607:f8b0:" + group()]) + "::" + ":".join(group() for _ in range(r.choice([1, 1, 2, 4])))
    name = lambda: word() + r.choice(["", ".", "_"]) + r.choice([word(), dig(2)])
    yes = (
        ("email", lambda: f"{name()} {r.choice(['[at]', '(at)', '[ at ]'])} {word()}.{r.choice(['com', 'org', 'net'])}".encode("ascii", "ignore").decode(), ("", "mail ", "contact: ")),
        ("ip", lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)), ("", "host ", "ip ")),
        ("ip", short_ip, ("", "host ", "ip ", "server ", "addr=")),
        ("card", lambda: card(True), ("", "", "", "card ", "visa: ")),
        ("card", lambda: card(False), ("credit card ", "card number: ", "Karte ")),
        ("phone", phone, ("", "", "", "call ", "tel. ", "phone: ", "mobil ")),
        ("secret", lambda: r.choice([hexes(40), hexes(40), hexes(64), hexes(40).upper(), mixed(32), "sk_live_" + mixed(24), "ghp_" + mixed(36), mixed(r.randint(200, 900))]), ('token = "', "api_key=", "?token=", "SECRET=", "secret: ", "password ", "key: ", "Bearer ", 'TOKEN = "', "")),
        ("ssn", lambda: f"{r.randrange(100, 660)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", ("", "ssn ", "social security ")),
        ("iban", lambda: iban(True), ("", "iban ", "account: ")),
    )
    no = (
        ("card", lambda: card(False), ("", "", "", "order ", "serial ", "invoice no. ")),
        ("phone", lambda: f"{r.randrange(1900, 2030)}-{dig(4)}-{dig(4)}", ("", "part ", "ref ")),
        ("phone", lambda: f"{dig(3)}.{dig(3)}.{dig(3)}", ("version ", "table ", "")),
        ("phone", lambda: f"{dig(3)} {dig(3)} {dig(3)}", ("page ", "figure ", "table ", "")),
        ("secret", lambda: r.choice([hexes(40), hexes(64), hexes(32)]), ("commit ", "sha256: ", "md5 ", "checksum: ", "rev ", "commit=", "sha256=", "?rev=")),
        ("secret", lambda: "-".join([word(), word(), dig(2), word(), word()]).ljust(24, "x"), ("", "", "see ")),
        ("secret", lambda: "/".join(word() for _ in range(6)) + "/" + dig(3) + "/page/of/it", ("", "see ", "https://", "href=", "?page=")),
        ("ssn", lambda: f"{r.choice(['000', '666', '9' + dig(2)])}-{dig(2)}-{dig(4)}", ("", "part ", "order ")),
        ("ssn", lambda: f"{dig(3)}-{dig(2)}-{dig(4)}", ("part no. ", "order ", "serial ")),
        ("iban", lambda: iban(False), ("", "", "part ", "serial ")),
        ("ip", lambda: ":".join(dig(2) for _ in range(4)), ("", "date ", "at ")),
        ("ip", lambda: r.choice(["{}::{}", "::{}", "{}::"]).format(*(r.choice(["add", "Bad", "dead", "fee", "Cafe", "ace", "face", "de", "a", "b", "c"]) for _ in "12")), ("", "call ", "see ", "class ", "ref ")),
    )
    while True:
        y = int(r.random() < 0.5)
        kind, make, cues = r.choice(yes if y else no)
        s = make()
        # neighbours that base patterns swallow it with, as well as plain text
        head = " ".join(word() for _ in range(r.randint(0, 6))) + r.choice([" ", ", ", ". ", "\n", " " + dig(16) + " ", ' ']) + r.choice(cues)
        tail = ('"' if head.endswith('"') else r.choice(["", "", ".", ",", "!!", "%%%"])) + r.choice([" ", " " + dig(16) + " ", " 97.51.17.173 ", "\n", " | "]) + word()
        yield head + s + tail, (len(head), len(head) + len(s), KINDS.index(kind)), y


def is_for(c: Span, truth: Span) -> bool:
    """A candidate covers the span and little else."""
    return c[2] == truth[2] and c[0] <= truth[0] and c[1] >= truth[1] and c[1] - c[0] <= truth[1] - truth[0] + 3


def examples(n: int, seed: int) -> list[tuple[str, Span, int]]:
    """Composed texts, a candidate in each and whether it is personal data; spans without a candidate teach nothing."""
    out: list[tuple[str, Span, int]] = []
    for t, truth, y in composed(seed):
        found = candidates(t, [])
        out += [(t, c, y) for c in found if is_for(c, truth)]
        # a candidate that overlaps the truth and isn't it is wrong
        out += [(t, c, 0) for c in found if y and c[0] < truth[1] and c[1] > truth[0] and (c[2] != truth[2] or c[1] - c[0] < truth[1] - truth[0] - 1)][:1]
        if len(out) >= n:
            return out[:n]


@cache
def model() -> tuple[Boosted, np.ndarray]:
    """The trees, and by kind the least probability whose held-out precision reaches PRECISION."""
    xy = lambda rows: (np.array([features(t, *c) for t, c, _ in rows]), np.array([y for *_, y in rows], float))
    trees = Boosted(*xy(examples(3000, 1)))
    x, y = xy(held := examples(3000, 2))
    p, kinds = trees.probability(x), np.array([c[2] for _, c, _ in held])
    bars = np.full(len(KINDS), 0.9)
    for k in range(len(KINDS)):
        pk, yk = p[kinds == k], y[kinds == k]
        right = [b for b in np.linspace(0.3, 0.95, 27) if (pk >= b).sum() >= 10 and yk[pk >= b].mean() >= PRECISION]
        bars[k] = min(right) if right else 0.95
    return trees, bars


def find(texts: list[str | None], fitted: tuple[Boosted, np.ndarray] | None = None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    trees, bars = fitted or model()
    base = [base_spans(t) if t else [] for t in texts]
    asked, rows = [], []
    for i, t in enumerate(texts):
        for c in candidates(t, base[i]) if t else ():
            asked.append((i, c))
            rows.append(features(t, *c))
    added: dict[int, list[Span]] = {}
    if rows:
        p = trees.probability(np.array(rows))
        # the most probable first, then the longest, then the first
        for prob, i, c in sorted(((q, i, c) for q, (i, c) in zip(p, asked) if q >= bars[c[2]]), key=lambda z: (z[1], -round(z[0], 9), z[2][0] - z[2][1], z[2])):
            own = added.setdefault(i, [])
            k = bisect_left(own, c)  # kept sorted and free of overlap, so only the neighbours matter
            if not (k < len(own) and own[k][0] < c[1] or k and own[k - 1][1] > c[0]):
                own.insert(k, c)
    return [(b, sorted([*b, *added.get(i, [])], key=lambda s: (s[0], s[2]))) for i, b in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(t: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes one mark with the kind of its first."""
    out, at, end = [], 0, -1
    for a, b, k in spans:
        if a >= end:
            out += [t[at:a], f"[{KINDS[k].upper()}]"]
        at = end = max(end, b)
    return "".join(out) + t[at:]


_TYPE = "base string, spans string, n_email long, n_ip long, n_card long, n_phone long, redacted string"


def detect(docs: DataFrame, text: str = "text", out: str = "pii", with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and a struct ``out``: base and all spans as kind:start:end, base counts, redacted text."""

    bounded_batches(docs.sparkSession)
    # fitted once, on the driver: 60 trees of three tests each
    shared = docs.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf(_TYPE)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [x if isinstance(x, str) else None for x in part]
            rows = []
            for t, (base, spans) in zip(texts, find(texts, shared.value)):
                n = Counter(s[2] for s in base)
                rows.append((written(base), written(spans), n[0], n[1], n[2], n[3], redact(t, spans) if with_text and t is not None else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TYPE.split(", ")])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], scan(F.col(f"`{text}`")).alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select(
        "doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", F.sha2(F.col("pii.base"), 256).alias("base_sha256"), F.col("pii.spans").alias("spans"),
        F.when(F.col("pii.spans") == "", 0).otherwise(F.size(F.split("pii.spans", ","))).cast("long").alias("n_spans"), (F.col("pii.spans") != "").alias("personal"),
    )
