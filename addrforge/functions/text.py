"""Text normalisation as native column expressions (no Python on the executors)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as equal, and words before a city name that do not belong to it.
UMLAUTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]
CITY_PREFIXES = ["kreis", "stadt", "gemeinde", "hansestadt", "landkreis"]
# Trigrams of common street endings.
COMMON_TRIGRAMS = ["str", "tra", "ras", "ass", "sse", "weg", "pla", "lat", "atz", "rin", "ing", "lle", "lee"]
# Endings and openings that speech recognition adds to a street's root.
VOICE_SUFFIXES = (
    "straße strasse weg platz gasse allee ring damm hof park berg steig pfad ufer graben zeile chaussee promenade brücke brucke "
    "kirche markt tor bad feld grund hang tal wall anger plan stieg winkel siedlung"
).split()
VOICE_PREFIXES = ["in der", "in den", "in dem", "an der", "an den", "an dem", "am", "auf der", "auf dem", "auf den", "beim", "im", "zum", "zur",
                  "hinter der", "hinter dem", "unter der", "unter dem", "vor der", "vor dem", "neben der", "neben dem"]


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda held, pair: F.replace(held, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


def collapse_runs(c: Column) -> Column:
    """Equal neighbouring characters become one."""
    return F.regexp_replace(c, r"(.)\1+", "$1")


def normalize_string(c: Column) -> Column:
    """Lower case, umlauts spelled out, punctuation dropped, white space and hyphens as single spaces. Null stays null."""
    spelled = replace_all(F.lower(c), UMLAUTS)
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, r"[^\p{L}\p{N}_\s\-]", ""), r"[\s\-]+", " "))


def normalize_compact(c: Column) -> Column:
    return F.replace(normalize_string(c), F.lit(" "), F.lit(""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_string(c), " "), lambda t: t != "")


def consonant_key(c: Column) -> Column:
    """Each token's first letter and its later consonants without h and y, runs collapsed, joined."""
    key = lambda t: collapse_runs(F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1_000_000), "[aeiouyh]", "")))
    return F.array_join(F.transform(tokens(c), key), "")


def strip_city_prefix(c: Column) -> Column:
    return F.regexp_replace(c, f"(?i)^({'|'.join(CITY_PREFIXES)}) ", "")


def city_key(c: Column) -> Column:
    return normalize_compact(strip_city_prefix(c))


def city_variants(c: Column) -> Column:
    """The name, with spaces and hyphens exchanged, and the same without an administrative prefix; distinct, first spelling kept."""
    forms = lambda x: [x, F.replace(x, F.lit(" "), F.lit("-")), F.replace(x, F.lit("-"), F.lit(" "))]
    every = F.array(*forms(c), *forms(strip_city_prefix(c)))
    first = F.transform(every, lambda x: F.lower(x))
    return F.filter(every, lambda x, i: F.array_position(first, F.lower(x)) == i + 1)


def title_case(c: Column) -> Column:
    """Words capitalised; with a hyphen in the text, its hyphen parts instead, each as a whole."""
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))
    parts = F.array_join(F.transform(F.split(c, "-"), up), "-")
    words = F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), up), " ")
    return F.when(c.contains("-"), parts).otherwise(words)


def trigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def select_trigrams(every: Column) -> Column:
    """The trigrams worth searching: common endings left out, then some of the start and the middle of long names."""
    rare = F.filter(every, lambda t: ~t.isin(COMMON_TRIGRAMS))
    half = F.slice(every, F.lit(1), F.floor(F.size(every) / 2).cast("int") + 2)
    some = F.when((F.size(rare) < 3) & (F.size(every) >= 3), half).when(F.size(rare) == 0, every).otherwise(rare)
    n, mid = F.size(some), F.floor(F.size(some) / 2).cast("int")
    long = F.concat(F.slice(some, 1, 3), F.slice(some, F.greatest(mid, F.lit(1)), F.lit(3)))
    medium = F.concat(F.slice(some, 1, 3), F.slice(some, mid + 1, F.lit(2)), F.slice(some, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    return F.array_distinct(F.when(n >= 9, long).when(n >= 6, medium).when(n >= 4, F.slice(some, 1, 3)).otherwise(some))


def hyphen_variants(c: Column) -> Column:
    """The text and, from three letters on, with spaces and hyphens exchanged; distinct."""
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(F.array(c, F.replace(c, F.lit(" "), F.lit("-")), F.replace(c, F.lit("-"), F.lit(" ")))))


def fuzzy_variants(c: Column) -> Column:
    """The normalised text, its swaps of neighbours and its deletions of one letter (two letters left at least); distinct, in that order."""
    s, n = normalize_string(c), F.length(normalize_string(c))
    some = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swap = F.transform(some, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(1)), F.substring(s, i, F.lit(1)), F.substring(s, i + 2, n)))
    drop = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))
    return F.when(n < 3, F.array(s)).otherwise(F.array_distinct(F.concat(F.array(s), swap, drop)))


def strip_voice_suffix(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?i)\s*({'|'.join(VOICE_SUFFIXES)})\s*$", ""))


def strip_voice_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?i)^(" + "|".join(p.replace(" ", r"\s+") for p in VOICE_PREFIXES) + r")\s+", ""))


def split_search(c: Column) -> dict[str, Column]:
    """One-line search -> street, house_number, city: the number ends the first comma part, a postal code may open the second."""
    first, second = F.trim(F.split_part(c, F.lit(","), F.lit(1))), F.trim(F.split_part(c, F.lit(","), F.lit(2)))
    parts = r"^(.+?)\s+(\d[\p{L}\p{N}_/\-]*)$"
    numbered = first.rlike(parts)
    return {
        "street": F.when(numbered, F.regexp_extract(first, parts, 1)).otherwise(first),
        "house_number": F.when(numbered, F.regexp_extract(first, parts, 2)),
        "city": F.when(second != "", F.regexp_replace(second, r"^\d{5}\s+", "")),
    }
