"""English text search: lexemes of a text by the Snowball stemmer of English (Porter2), and ranks of matches by distance."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of English that are no lexemes.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()

#: Words with stems of their own, and words that are left alone after the first step.
SPECIAL = dict(zip("skis skies dying lying tying idly gently ugly early only singly".split(), "ski sky die lie tie idl gentl ugli earli onli singl".split())) | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
LEFT = set("inning outing canning herring earring proceed exceed succeed".split())
#: Endings of the second and third step and what they become; endings that the fourth takes off.
SECOND = dict(zip(
    "tional enci anci abli entli izer ization ational ation ator alism aliti alli fulness ousli ousness iveness iviti biliti bli ogi fulli lessli li".split(),
    "tion ence ance able ent ize ize ate ate ate al al al ful ous ous ive ive ble ble og ful less -".split(),
))
THIRD = dict(zip("tional ational alize icate iciti ical ful ness ative".split(), "tion ate al ic ic ic - - -".split()))
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile("[aeiouy]")


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant behind a vowel, and after the next such one."""
    head = re.match("gener|commun|arsen", word)
    first = _REGION.search(word)
    r1 = head.end() if head else first.end() if first else len(word)
    second = _REGION.search(word, r1)
    return r1, second.end() if second else len(word)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in LEFT:
        return w
    # past forms and participles
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # suffixes
    end = _ending(w, SECOND)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[:-3].endswith("l")) and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(end)] + SECOND[end].strip("-")
    end = _ending(w, THIRD)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + THIRD[end].strip("-")
    end = _ending(w, FOURTH)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def lexemes(text: Column) -> Column:
    """The stems of a text's words in order, with an empty one for each stop word, so that distances stay; null has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return _stems(F.transform(words, lambda w: F.when(w.isin(STOP), "").otherwise(w)))


def asked(text: Column) -> Column:
    """The distinct lexemes of a query."""
    return F.array_remove(F.array_distinct(lexemes(text)), "")


def match_rank(held: Column, wanted: Column) -> Column:
    """How well lexemes match a query that they hold all of: by the distances between its terms, or the places of its only one.

    Each pair of places of two different terms d words apart counts 0.1 / sqrt(1.005 + 0.05 exp(d / 1.5 - 2)), and pairs add up as
    chances do; a single term's n-th place counts 0.1 / n^2, divided by the sum of all 1 / n^2.
    """
    at = F.filter(F.transform(held, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_contains(wanted, p["x"]))
    # Weights of terms and distances.
    near = lambda d: F.when(d > 100, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    others = lambda a: F.filter(at, lambda b: (b["i"] > a["i"]) & (b["x"] != a["x"]))
    apart = lambda a: F.aggregate(others(a), F.lit(1.0), lambda m, b: m * (1 - 0.1 * F.sqrt(near(b["i"] - a["i"]))))
    many = 1 - F.aggregate(at, F.lit(1.0), lambda m, a: m * apart(a))
    alone = F.aggregate(F.transform(at, lambda p, i: 0.1 / ((i + 1) * (i + 1))), F.lit(0.0), lambda s, x: s + x) / 1.64493406685
    return F.round(F.when(F.size(wanted) > 1, many).otherwise(alone), 6)
