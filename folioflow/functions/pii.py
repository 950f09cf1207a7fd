"""Detection and rewriting of eight kinds of personal data by regular expressions, as Catalyst expressions.

A kind is looked for in the original text; the kinds found are then rewritten one after the other, each on what
the ones before have left. The order is part of the semantics: phone numbers come second and take most digit groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import held

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
#: (kind, case-blind, pattern), in the order of rewriting. The patterns are part of the contract.
KINDS: tuple[tuple[str, bool, str], ...] = (
    ("EMAIL", True, r"\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"),
    ("PHONE", False, r"(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{1,4}\)?[\s.\-]?)?\d{2,3}(?:[\s.\-]?\d{2}){2,3}"),
    ("SSN", False, r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IBAN", True, r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("CREDIT_CARD", False, r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"),
    ("IP", False, rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"),
    ("API_KEY", True, r"\b(?:sk|pk)[-_](?:live|test)?[_-]?[a-z0-9]{16,}\b"),
    ("JWT", False, r"\beyJ[a-zA-Z0-9_-]{10,}(?:\.[a-zA-Z0-9_-]+){2}\b"),
)
#: What every match of a kind holds, looked for first as it is found faster; a test is a sign or a pattern.
_SIGNS = {"EMAIL": "@", "SSN": "-", "IP": ".", "JWT": "eyJ"}
_HINTS = {"PHONE": r"(?U)\d\d[\s.\-]?\d\d", "CREDIT_CARD": r"(?U)\d{4}", "API_KEY": "[kKK][-_]", "IBAN": r"(?U)\d\d[A-Za-z0-9İıſK]"}
MODES = {"off": "off", "none": "off", "redact": "redact", "remove": "redact", "mask": "mask", "partial": "mask", "tag": "tag", "label": "tag"}


def mode_of(name: str | None) -> str:
    try:
        return MODES[(name or "off").lower()]
    except KeyError:
        raise ValueError(f"unknown pii_mode '{name}': off, redact, mask or tag") from None


def pattern(kind: str) -> str:
    """The Java form, with Unicode digits, blanks and word bounds."""
    blind, p = next((b, p) for k, b, p in KINDS if k == kind)
    return f"(?{'iu' if blind else ''}U){p}"


def holds(text: Column, kind: str) -> Column:
    return (text.contains(_SIGNS[kind]) if kind in _SIGNS else text.rlike(_HINTS[kind])) & text.rlike(pattern(kind))


def detect(text: Column) -> Column:
    """The kinds that the text holds, in order, as an array."""
    flags = [F.when(holds(text, k), F.lit(k)) for k, _, _ in KINDS]
    return F.array_compact(F.array(*flags))


def _rewrite(c: Column, kind: str, mode: str) -> Column:
    p = pattern(kind)
    if mode == "redact":
        return F.regexp_replace(c, p, f"[{kind}_REDACTED]")
    if mode == "tag":
        return F.regexp_replace(c, p, f'<PII type="{kind}">$0</PII>')
    # mask: each hit on its own; the pieces between hits are what splitting leaves
    hits, rest = F.regexp_extract_all(c, F.lit(p), 0), F.split(c, p, -1)
    masked = F.transform(hits, lambda h: mask(h, kind))
    return F.array_join(F.zip_with(rest, masked, lambda r, m: F.concat(r, F.coalesce(m, F.lit("")))), "")


def mask(hit: Column, kind: str) -> Column:
    """Part of a hit: the first letter of a mail name, the last four digits of a phone, the first two signs else."""
    if kind == "EMAIL":
        return F.concat(F.substring(hit, 1, 1), F.lit("***"), F.substr(hit, F.instr(hit, F.lit("@"))))
    if kind == "PHONE":
        d = F.regexp_replace(hit, "[^0-9]", "")
        return F.when(F.length(d) >= 4, F.concat(F.lit("***-***-"), F.substring(d, -4, 4))).otherwise(F.lit("***"))
    return F.when(F.octet_length(hit) <= 4, F.lit("****")).otherwise(F.concat(F.substring(hit, 1, 2), F.lit("****")))


def sanitize(df: DataFrame, text: str, mode: str, out: str = "pii") -> DataFrame:
    """Adds a struct ``out``: text, n (hits) and types (kinds in the order of their first hit)."""
    mode = mode_of(mode)
    t = F.col(text)
    if mode == "off":
        return df.withColumn(out, F.struct(t.alias("text"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("types")))
    # a column by step, so that a rewritten text is computed once though both its count and the next step need it
    steps, now = [], text
    df = df.withColumn("__pii_kinds", detect(t))
    for k, _, _ in KINDS:
        found = F.array_contains("__pii_kinds", k)
        df = df.withColumns(
            {f"__pii_{k}": F.when(found, _rewrite(F.col(now), k, mode)).otherwise(F.col(now)), f"__pii_n_{k}": F.when(found, F.regexp_count(F.col(now), F.lit(pattern(k)))).otherwise(F.lit(0))}
        )
        now, steps = f"__pii_{k}", [*steps, k]
    counts = [F.col(f"__pii_n_{k}") for k in steps]
    types = F.array_compact(F.array(*[F.when(F.col(f"__pii_n_{k}") > 0, F.lit(k)) for k in steps]))
    done = df.withColumn(out, F.struct(F.col(now).alias("text"), sum(counts[1:], counts[0]).alias("n"), types.alias("types")))
    return done.drop("__pii_kinds", *[f"__pii_{k}" for k in steps], *[f"__pii_n_{k}" for k in steps])


def sanitized(text: Column, mode: str) -> Column:
    """The rewritten text alone, for use on array elements."""
    mode = mode_of(mode)
    if mode == "off":
        return text
    def rewritten(c: Column, kind: str) -> Column:
        # a step names what it rewrites several times: as a lambda's variable it is computed once
        return held(c, lambda x: F.when(holds(text, kind), _rewrite(x, kind, mode)).otherwise(x))

    return reduce(rewritten, (k for k, _, _ in KINDS), text)
