"""German and Cologne phonetic codes as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrforge.functions.text import collapse_runs, replace_all

# Spellings by sound, applied in this order.
GERMAN_SOUNDS = [
    ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"),
    *((c + c, c) for c in "bcdfghklmnprstz"),
    ("ph", "f"), ("th", "t"), ("ch", "x"), ("sch", "x"), ("ck", "k"), ("qu", "kw"), ("chs", "ks"), ("dt", "t"), ("ts", "z"), ("tz", "z"), ("pf", "f"),
    ("ah", "a"), ("eh", "e"), ("ih", "i"), ("oh", "o"), ("uh", "u"),
    ("ei", "ai"), ("ey", "ai"), ("ay", "ai"), ("eu", "oi"), ("äu", "oi"), ("ie", "i"), ("v", "f"), ("c", "k"),
]


def german_code(word: Column) -> Column:
    """Sound spelling without vowels after the first letter, runs collapsed."""
    sounds = replace_all(F.regexp_replace(F.trim(F.lower(word)), r"[^a-zäöüß\s\-]", ""), GERMAN_SOUNDS)
    return collapse_runs(F.concat(F.substring(sounds, 1, 1), F.regexp_replace(F.substring(sounds, 2, 1_000_000), "[aeiou]", "")))


def cologne_code(word: Column) -> Column:
    """Digits by letter and its neighbours; vowels and j stay as 0, y and h have none, equal neighbouring codes become one."""
    spelled = F.regexp_replace(replace_all(F.trim(F.lower(word)), [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]), "[^a-z]", "")

    def code(i: Column) -> Column:
        at = lambda k: F.substring(spelled, k, F.lit(1))
        c, after = at(i), F.when(i < F.length(spelled), at(i + 1)).otherwise("")
        before = F.when(i > 1, at(F.greatest(i - 1, F.lit(1)))).otherwise("")
        one = lambda s: list(s)
        return (
            F.when(c.isin(one("aeijou")), "0")
            .when(c == "b", "1")
            .when(c == "p", F.when(after == "h", "3").otherwise("1"))
            .when(c.isin(one("dt")), F.when(after.isin(one("csz")), "8").otherwise("2"))
            .when(c.isin(one("fvw")), "3")
            .when(c.isin(one("gkq")), "4")
            .when((c == "c") & (i == 1), F.when(after.isin(one("ahkloqrux")), "4").otherwise("8"))
            .when(c == "c", F.when(~before.isin(one("sz")) & after.isin(one("ahkoqux")), "4").otherwise("8"))
            .when(c == "x", F.when(before.isin(one("ckq")), "8").otherwise("X"))
            .when(c == "l", "5")
            .when(c.isin(one("mn")), "6")
            .when(c == "r", "7")
            .when(c.isin(one("sz")), "8")
            .otherwise("")
        )

    # "48" is one code among one-digit ones: it stands as X until runs have collapsed
    codes = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(spelled), F.lit(1))), code), "")
    return F.replace(collapse_runs(codes), F.lit("X"), F.lit("48"))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s\-]+"), lambda t: t != "")


def german_phrase(c: Column) -> Column:
    return F.array_join(F.transform(_words(c), german_code), "")


def cologne_phrase(c: Column) -> Column:
    return F.array_join(F.transform(_words(c), cologne_code), "")


def code_similarity(a: Column, b: Column) -> Column:
    """1 for equal codes, 0 if one is empty, else one minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def phonetic_score(german_a: Column, cologne_a: Column, german_b: Column, cologne_b: Column) -> Column:
    """0.4 of the German and 0.6 of the Cologne similarity, of codes of whole phrases that were computed before the join."""
    cologne = F.when((cologne_a == "") | (cologne_b == ""), 0.0).otherwise(code_similarity(cologne_a, cologne_b))
    return 0.4 * code_similarity(german_a, german_b) + 0.6 * cologne
