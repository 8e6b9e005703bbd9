"""Exact cuts: the n least rows of each value of a column, without a sort of all of them in one place."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.shared import stored

#: Characters of a key that are counted at once, and keys of a part that are sorted.
STEP, SMALL = 3, 10_000


def falling(x: Column, most: float, digits: int = 9) -> Column:
    """Twelve hexadecimal digits that sort as ``x``, a number from 0 to ``most``, does from the greatest down; equal to ``digits`` decimals."""
    return F.lower(F.lpad(F.hex(F.round((F.lit(most) - x) * 10.0**digits).cast("long")), 12, "0"))


def nth_keys(rows: DataFrame, want: dict, by: str | None, key: str) -> dict:
    """For each value of ``by`` named in ``want``, the key of its want-th row in the order of keys; None where there are no more rows than that.

    A radix selection: rows are counted by the next few characters of their key, the
    part that holds the boundary is counted by the next few, until it is small.
    Each step brings at most 4096 counts a value to the driver (keys begin with
    hexadecimal digits), and later steps read only the parts at the boundary.
    """
    value = F.col(by).cast("string") if by else F.lit("all")
    left = {str(v): ("", n) for v, n in want.items() if n > 0}
    out, depth = {}, 0
    while left:
        inside = reduce(lambda a, b: a | b, [(value == F.lit(v)) & F.col(key).startswith(p) for v, (p, _) in left.items()])
        counts = defaultdict(list)
        for v, part, n in rows.filter(inside).groupBy(value.alias("v"), F.substring(key, depth + 1, STEP).alias("part")).agg(F.count("*").alias("n")).collect():
            counts[v].append((part, n))
        depth += STEP
        small = {}
        for v, (prefix, need) in list(left.items()):
            parts = sorted(counts[v])
            if sum(n for _, n in parts) <= need and not prefix:
                out[v] = None
                del left[v]
                continue
            for part, n in parts:
                if n >= need:
                    break
                need -= n
            left[v] = (prefix + part, need)
            if n <= SMALL or len(part) < STEP:
                small[v] = left.pop(v)
        if small:
            at = reduce(lambda a, b: a | b, [(value == F.lit(v)) & F.col(key).startswith(p) for v, (p, _) in small.items()])
            for v, keys in rows.filter(at).groupBy(value.alias("v")).agg(F.sort_array(F.collect_list(key))).collect():
                out[v] = keys[small[v][1] - 1]
    return out


def least(rows: DataFrame, want: dict, by: str | None, key: Column, written: bool = False) -> DataFrame:
    """Of each value of ``by`` named in ``want`` (of all rows, named "all", if ``by`` is None) the rows of least ``key``, as many as wanted or all there are.

    The key is a string that begins with hexadecimal digits and is different for
    each row. Rows are written once with their key, or, where they are cheap to read
    again (``written``), get it in each pass; nothing but a filter reads them after
    the boundaries are known, so no task holds the rows of a value.
    """
    kept = rows.withColumn("_key", key) if written else stored(rows.withColumn("_key", key), "keyed")
    bounds = nth_keys(kept, want, by, "_key")
    value = F.col(by).cast("string") if by else F.lit("all")
    tests = [(value == F.lit(v)) & (F.lit(True) if b is None else F.col("_key") <= F.lit(b)) for v, b in bounds.items()]
    return kept.filter(reduce(lambda a, b: a | b, tests) if tests else F.lit(False)).drop("_key")
