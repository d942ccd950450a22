"""Fuzzy name score on normalised phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_EDITS = 2


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or most + 1 if it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def fuzzy_score(q: Column, name: Column) -> Column:
    """1 for equal phrases, 0.95 for an opening, up to 0.9 word by word, up to 0.8 as a whole, else 0."""
    qs, ns = F.split(q, " "), F.split(name, " ")
    best = F.transform(qs, lambda w: F.array_min(F.transform(ns, lambda n: F.when(n.startswith(w), 0).otherwise(bounded_distance(w, n, MOST_EDITS)))))
    mean = F.aggregate(best, F.lit(0), lambda held, d: held + d) / F.size(qs)
    by_word = (F.size(qs) > 1) & (F.size(ns) > 1) & (F.array_max(best) <= MOST_EDITS)
    whole = F.levenshtein(q, name, MOST_EDITS)
    longest = F.greatest(F.length(q), F.length(name), F.lit(1))
    return (
        F.when(q == name, 1.0).when(name.startswith(q), 0.95)
        .when(by_word, F.greatest(F.lit(0.0), 1 - mean / MOST_EDITS) * 0.9)
        .when(whole >= 0, (1 - whole / longest) * 0.8).otherwise(0.0)
    )
