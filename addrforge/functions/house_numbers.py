"""House numbers are strings ("38a", "38-40"): leading number, suffix and the nearest of a list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("long")


def suffix(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"^\d+", "")))


def closeness(target: Column, candidate: Column, position: Column) -> Column:
    """Sort key of a candidate for a target, smallest first.

    Equal text; else the first of all, if the target has no number; else the same number by suffix; else the nearest
    number; else what has no number. Ties go to the smaller string, equal text to the earlier position.
    """
    t, c, ts, cs = leading_number(target), leading_number(candidate), suffix(target), suffix(candidate)
    letters = F.when(cs == "", 0).when(ts == "", 1).when((F.length(ts) == 1) & (F.length(cs) == 1), F.abs(F.ascii(ts) - F.ascii(cs))).otherwise(F.abs(F.length(ts) - F.length(cs)) + 1)
    same = F.trim(target) == F.trim(candidate)
    rank = F.when(same, 0).when(t.isNull(), 1).when((c == t) & (ts == cs), 2).when(c == t, 3).when(c.isNotNull(), 4).otherwise(5)
    gap = F.when(rank == 3, letters.cast("long")).when(rank == 4, F.abs(c - t)).otherwise(F.lit(0).cast("long"))
    place = F.when(rank.isin(3, 4), F.lit(0).cast("long")).otherwise(position.cast("long"))
    return F.struct(rank.alias("rank"), gap.alias("gap"), place.alias("place"), candidate.alias("text"))
