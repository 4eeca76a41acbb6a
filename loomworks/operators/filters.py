"""Filters (FLT1-FLT16): named chains that count what each step removes, and thresholds."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Defaults of the name and code filters.
NAME_PATTERN, MIN_CODE = "^[a-z_][a-z0-9_]{2,64}$", 16


def name_matches(name: Column, pattern: str = NAME_PATTERN) -> Column:
    """FLT4: not blank, and the stripped name matches from its start; an empty pattern takes any name."""
    stripped = T.strip(F.coalesce(name, F.lit("")))
    return (stripped != "") & (stripped.rlike(f"^(?:{pattern})") if pattern else F.lit(True))


def name_allowed(name: Column, weak: list[str] | None = None) -> Column:
    """FLT5: not in the list, whatever its case; not stripped."""
    return ~F.lower(F.coalesce(name, F.lit(""))).isin(*[w.lower() for w in weak]) if weak else F.lit(True)


def code_long_enough(code: Column, least: int = MIN_CODE, stripped: bool = True) -> Column:
    """FLT6 (stripped) and FLT8 (not): at least so many code points."""
    code = F.coalesce(code, F.lit(""))
    return F.length(T.strip(code) if stripped else code) >= least


class FilterChain:
    """FLT1-FLT3, FLT7: predicates in order; a row is charged to the first that it fails.  Nothing is evaluated here."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, Callable[[Column], Column]]] = []

    def add(self, name: str, predicate: Callable[[Column], Column]) -> FilterChain:
        """predicate: Column -> Column; wrap a plain Python function by F.udf(f, 'boolean', useArrow=True)."""
        self.steps.append((name, predicate))
        return self

    def first_failed(self, value: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, predicate in reversed(self.steps):
            out = F.when(~F.coalesce(predicate(value), F.lit(False)), F.lit(name)).otherwise(out)
        return out

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(self.first_failed(F.col(column)).isNull())

    def stats(self, df: DataFrame, column: str) -> DataFrame:
        """(filter, removed) for every step, zero where it removed nothing; one map-side combined count."""
        names = list(dict.fromkeys(n for n, _ in self.steps))
        counted = df.select(self.first_failed(F.col(column)).alias("filter")).agg(*[F.count_if(F.col("filter") == n).alias(f"_{i}") for i, n in enumerate(names)])
        pairs = F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"_{i}").alias("removed")) for i, n in enumerate(names)])
        return counted.select(F.inline(pairs))

    @classmethod
    def for_names(cls, pattern: str = NAME_PATTERN, weak: list[str] | None = None) -> FilterChain:
        return cls().add("regex", lambda c: name_matches(c, pattern)).add("weaklist", lambda c: name_allowed(c, weak))

    @classmethod
    def for_code(cls, least: int = MIN_CODE) -> FilterChain:
        return cls().add("min_length", lambda c: code_long_enough(c, least))


def scores_valid(ratings: Column, summary: Column, low: int = 1, high: int = 5) -> Column:
    """FLT14: all five scores in range and a summary; null is false."""
    ok = F.coalesce(summary != "", F.lit(False))
    for d in T.DIMENSIONS:
        ok = ok & F.coalesce(ratings[d].between(low, high), F.lit(False))
    return ok


def meets_thresholds(ratings: Column, thresholds: Mapping[str, int], require_all: bool = True) -> Column:
    """FLT15: all (or any) of the thresholds are reached; a missing or null score counts as 0; no thresholds pass."""
    tests = [F.coalesce(ratings[d], F.lit(0)) >= t for d, t in thresholds.items()]
    if not tests:
        return F.lit(True)
    out = tests[0]
    for t in tests[1:]:
        out = out & t if require_all else out | t
    return out
