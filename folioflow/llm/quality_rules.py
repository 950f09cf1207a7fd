"""Quality rules: a table of thresholds compiled into one projection, with no user functions.

Counts follow the word definition ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words, so every count is 0
and the base rule rejects them. Every expression is linear in the text (n log n for texts that do repeat a window),
so very long texts need no special path. The operator needs one column with the text; other columns are passed on
and it overwrites none: its own columns live in one struct whose name the caller chooses. Repeated rows are judged
alike and independently; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, words

WINDOW = 5
STOP_WORDS = tuple(
    w
    for s in "the of and to in is it that der die und in den das la de le et les que el en y un una des du".split()
    for w in dict.fromkeys((s, s.capitalize()))
)


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= metric <= high``."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The base rules come first in the compiled projection; a failure of either decides alone.
BASE = (Rule("n_words", low=10), Rule("repeat_share", high=0.2))
RULES = (
    Rule("mean_word_chars", low=2.0, high=25.0),
    Rule("symbols_per_word", high=0.5),
    Rule("stop_share", low=0.005),
    Rule("dup_line_share", high=0.5),
    Rule("bullet_line_share", high=0.95),
)


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _rows(df: DataFrame, text: str) -> DataFrame:
    """Adds the arrays and counts under private names, in steps, so that lambdas read arrays that exist once."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", words(F.col(text)))
    df = df.withColumns(
        {
            "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
            "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
            "__n": F.size("__words").cast("long"),
            "__chars": F.length(F.array_join("__words", "")).cast("long"),
            "__symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "__stops": F.size(F.filter("__words", lambda w: w.isin(*STOP_WORDS))).cast("long"),
        }
    )
    h = F.col("__hash")
    df = df.withColumns(
        {
            "__grams": F.when(
                F.size(h) >= WINDOW,
                F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
            ).otherwise(F.array().cast("array<bigint>")),
            "__n_lines": F.size("__lines").cast("long"),
            "__n_dup": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__bullets": F.size(F.filter("__lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long"),
        }
    )
    g = F.col("__grams")
    twice = F.size(F.array_distinct(g)) < F.size(g)
    s = F.col("__sorted")
    at = F.col("__at")
    df = df.withColumn("__sorted", F.when(twice, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    df = df.withColumn(
        "__at",
        F.sort_array(
            F.filter(
                F.transform(s, lambda x, k: F.when((x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]), x["i"])),
                lambda x: x.isNotNull(),
            )
        ),
    )
    covered = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))).cast("long"))
    return df.withColumn("__repeat", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))


def metrics() -> dict[str, Column]:
    n = F.col("__n")
    return {
        "n_words": n,
        "repeat_share": _share(F.col("__repeat"), n),
        "mean_word_chars": _share(F.col("__chars"), n),
        "symbols_per_word": _share(F.col("__symbols"), n),
        "stop_share": _share(F.col("__stops"), n),
        "dup_line_share": _share(F.col("__n_dup"), F.col("__n_lines")),
        "bullet_line_share": _share(F.col("__bullets"), F.col("__n_lines")),
    }


def compile_rules(rules: tuple[Rule, ...], values: dict[str, Column]) -> Column:
    """The conjunction of the table's rows as one boolean expression."""
    tests = [values[r.metric] >= F.lit(r.low) for r in rules if r.low is not None]
    tests += [values[r.metric] <= F.lit(r.high) for r in rules if r.high is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "rules") -> DataFrame:
    """All columns of ``df`` and a struct ``out`` of counts, ``base_failed`` and ``kept``."""
    values = metrics()
    # 100 * repeats > 20 * words, in whole numbers, so that the bound itself passes exactly
    base_failed = (F.col("__n") < BASE[0].low) | (100 * F.col("__repeat") > 100 * BASE[1].high * F.col("__n"))
    verdict = F.struct(
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__n_dup").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & compile_rules(rules, values)).alias("kept"),
    )
    # always true and not deterministic to the planner: a filter on the verdict that was pushed down would put the arrays
    # into the lambdas that read them and compute them anew for every word
    held = F.when(F.spark_partition_id() >= 0, verdict)
    return _rows(df, text).select(*[F.col(f"`{c}`") for c in df.columns], held.alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    from folioflow.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "rules.*")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5),
g AS (SELECT r, p, ws[p:p + 4] AS g FROM i),
f AS (SELECT r, p FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, least(5, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 5)) AS n FROM f),
rep AS (SELECT r, sum(n)::BIGINT AS n FROM c GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS stops,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) AS bullets, len(ls) AS lines
    FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 25.0 AND n_symbols::DOUBLE / n_words <= 0.5
  AND stops::DOUBLE / n_words >= 0.005 AND (lines = 0 OR n_dup_lines::DOUBLE / lines <= 0.5)
  AND (lines = 0 OR bullets::DOUBLE / lines <= 0.95) AS kept
FROM b
"""
