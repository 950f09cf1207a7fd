"""Text extraction and page-quality signals as Catalyst expressions; no user functions.

Sizes are UTF-8 bytes, language and garbled checks look at code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that is trimmed: the Unicode property, without the control characters that Python's strip also takes.
BLANKS = "\t\n\x0b\f\r \x85\xa0                　"

_DROPPED = ("script", "style", "noscript")
_ENTITIES = (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"))
LANGUAGE_SAMPLE, GARBLED_SAMPLE, GARBLED_LEAST = 2000, 4000, 20


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often ``use`` names it.

    The optimizer puts a column's expression wherever the column is named; a lambda's variable it leaves alone.
    """
    return F.transform(F.array(value), use)[0]


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; what stands in the named columns is computed here, once, and not where it is used.

    The condition is always true and not deterministic to the planner, which moves nothing across it.
    """
    return df.withColumns({n: F.when(F.spark_partition_id() >= 0, F.col(n)) for n in names})


def html_text(html: Column) -> Column:
    """HTML to text: scripts and styles go, breaks and block ends become lines, other tags blanks, six entities signs."""
    s = html
    for tag in _DROPPED:
        s = F.regexp_replace(s, f"(?is)<{tag}[^>]*>.*?</{tag}>", "\n")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, r"(?i)</(?:h[1-6]|div|p|tr|li)>", "\n")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    s = F.regexp_replace(s, "[\\t ]+\\n", "\n")
    s = F.regexp_replace(s, "\\n{3,}", "\n\n")
    for name, sign in _ENTITIES:
        s = F.replace(s, F.lit(f"&{name};"), F.lit(sign))
    return trim(s)


def csv_text(raw: Column) -> Column:
    """Lines with their ends trimmed; the values aren't parsed."""
    lines = F.split(F.regexp_replace(raw, "\\n$", ""), "\n")
    return F.array_join(F.transform(lines, lambda x: F.rtrim(x, F.lit(BLANKS))), "\n")


def xml_text(raw: Column) -> Column:
    bare = trim(F.regexp_replace(raw, "<[^>]+>", " "))
    return F.regexp_replace(bare, f"[{BLANKS}]+", " ")


def utf8_text(content: Column) -> Column:
    """Binary content as text; content that isn't UTF-8 is an empty text."""
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(F.lit(""))


def text_density(n_bytes: Column, width: Column | int = 0, height: Column | int = 0) -> Column:
    """Bytes by hundredth of the page's mean side; pages without a size count as one unit."""
    side = [F.greatest(F.lit(x).cast("float") if isinstance(x, int) else x.cast("float"), F.lit(1.0).cast("float")) for x in (width, height)]
    area = F.sqrt(side[0] * side[1]).cast("float") / F.lit(100.0).cast("float")
    return (n_bytes.cast("float") / F.greatest(area.cast("float"), F.lit(1.0).cast("float"))).cast("float")


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def confidence(n_bytes: Column, density: Column, ocr_used: Column, failed: Column) -> Column:
    """How far the extraction can be trusted, in [0, 1]."""
    c = F.when(n_bytes == 0, _f(0.1)).when(n_bytes < 20, _f(0.4)).otherwise(_f(0.75))
    c = F.when(ocr_used, F.greatest((c * _f(0.85)).cast("float"), _f(0.35))).otherwise(c)
    c = F.when(density > _f(0.5), F.least((c + _f(0.15)).cast("float"), _f(1.0))).when((density < _f(0.05)) & (n_bytes > 0), (c * _f(0.9)).cast("float")).otherwise(c)
    return F.when(failed, _f(0.0)).otherwise(c).cast("float")


#: Later scripts win ties.
SCRIPTS = (("en", "A-Za-z"), ("zh", "一-鿿"), ("ru", "Ѐ-ӿ"), ("ar", "؀-ۿ"))


def language_hint(text: Column) -> Column:
    """The script most letters of the first 2000 code points belong to; null if blank, ``unknown`` if none counts."""

    def counted(sample: Column) -> Column:
        counts = [F.length(F.regexp_replace(sample, f"[^{cls}]+", "")).alias(name) for name, cls in SCRIPTS]
        return held(F.struct(*counts), most)

    def most(n: Column) -> Column:
        top = F.greatest(*[n[name] for name, _ in SCRIPTS])
        hint = F.when(top == 0, F.lit("unknown"))
        for name, _ in reversed(SCRIPTS):
            hint = hint.when(n[name] == top, F.lit(name))
        return hint

    return F.when(trim(text) != "", held(F.substring(text, 1, LANGUAGE_SAMPLE), counted))


def garbled(text: Column) -> Column:
    """Replacement or control characters, or signs of no known kind, make up too much of the first 4000 code points."""
    sample = F.substring(text, 1, GARBLED_SAMPLE)
    n = F.length(sample).cast("double")
    broken = F.length(F.regexp_replace(sample, "[^�\\p{Cc}]+|[\\n\\t]+", ""))
    odd = F.length(F.regexp_replace(sample, "[\\p{IsAlphabetic}\\p{N}\\p{Punct}" + BLANKS + "]+", ""))
    return (F.octet_length(text) >= GARBLED_LEAST) & ((broken / n > 0.08) | (odd / n > 0.55))


def looks_scanned(mean_bytes: Column) -> Column:
    return mean_bytes < 40.0


def hybrid_ocr(n_bytes: Column, density: Column, layout_complex: Column, wanted: Column) -> Column:
    """Whether recognition should supplement sparse native text; ``wanted``: hybrid mode or the ocr strategy."""
    return wanted & ((n_bytes < 80) | (density < 0.08)) & (layout_complex | (density < 0.15))


def broken_page(n_bytes: Column, density: Column, is_garbled: Column, fast: Column) -> Column:
    return ~fast & ((n_bytes < 5) | ((density < 0.06) & (n_bytes < 120)) | (is_garbled & (n_bytes < 500)))


def ocr_wanted(text: Column, use_ocr: Column, hybrid: Column, broken: Column) -> Column:
    return use_ocr & ((trim(text) == "") | hybrid | broken)


def ocr_score(text: Column) -> Column:
    """Letters, digits and white space of a candidate."""
    return F.length(F.regexp_replace(text, "[^\\p{IsAlphabetic}\\p{N}" + BLANKS + "]+", ""))


def merged_ocr(native: Column, recognised: Column, hybrid: Column) -> Column:
    """Hybrid pages keep their native text and get a supplement, others are replaced."""
    return F.when(hybrid & (trim(native) != ""), F.concat(native, F.lit("\n\n### OCR supplement:\n"), recognised)).otherwise(recognised)


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
