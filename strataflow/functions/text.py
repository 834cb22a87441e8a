"""Tokenizers for search, as Column expressions and as Arrow-batched functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def simple_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
# Suffix rules of a light English stemmer, the first that fits counts.
_SUFFIXES = (("sses", "ss"), ("ies", "i"), ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ly", ""), ("s", ""))


def stem(word: str) -> str:
    """A light English stem; words of up to three letters and those in -ss, -us or -is stay."""
    if len(word) <= 3 or word.endswith(("ss", "us", "is")):
        return word
    for suffix, new in _SUFFIXES:
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            base = word[: len(word) - len(suffix)] + new
            return base[:-1] if suffix in ("ing", "ed") and len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" else base
    return word


def words(text: str, stemming: bool = True) -> list[str]:
    """Search terms: lower case, outer punctuation and possessives dropped, hyphenated words also in parts,
    single characters dropped."""
    out = []
    for raw in (text or "").lower().split():
        w = _EDGE.sub("", raw)
        for tail in ("'s", "’s", "'", "’"):
            w = w.removesuffix(tail)
        forms = [w.replace("-", ""), *w.split("-")] if "-" in w else [w]
        out += [stem(f) if stemming else f for f in forms if len(f) > 1]
    return out


_CODE = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|[A-Za-z_][\w]*(?:(?:::|\.|->)[A-Za-z_]\w*)*|\d+|[^\w\s]+')
_HUMP = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def code_words(text: str) -> list[str]:
    """Terms of source code: qualified names whole and in parts, camel and snake case split, operators, and words in strings."""
    out = []
    for token in _CODE.findall(text or ""):
        if token[0] in "\"'":
            out += words(token[1:-1], False)
        elif token[0].isalpha() or token[0] == "_":
            parts = re.split(r"::|\.|->", token)
            if len(parts) > 1:
                out.append(token.lower())
            for p in parts:
                humps = [h.lower() for x in p.split("_") for h in _HUMP.findall(x)]
                out.append(p.lower())
                out += humps if len(humps) > 1 else []
        else:
            out.append(token)
    return out


def _stem(w: Column) -> Column:
    """stem() as an expression."""
    out = F.when((F.char_length(w) <= 3) | w.rlike("(ss|us|is)$"), w)
    for suffix, new in _SUFFIXES:
        base = F.concat(F.substring(w, F.lit(1), F.char_length(w) - len(suffix)), F.lit(new))
        if suffix in ("ing", "ed"):
            base = F.when((F.char_length(base) > 3) & base.rlike(r"([^lsz])\1$"), F.substring(base, F.lit(1), F.char_length(base) - 1)).otherwise(base)
        out = out.when(F.endswith(w, F.lit(suffix)) & (F.char_length(w) - len(suffix) >= 3), base)
    return out.otherwise(w)


def search_terms(text: Column, stemming: bool = True) -> Column:
    """words() as an expression: search terms of a text, in order."""
    raw = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    bare = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, r"(?U)^[^\w]+|[^\w]+$", ""), "('s|’s)$", ""))
    forms = F.transform(bare, lambda w: F.when(F.contains(w, F.lit("-")), F.concat(F.array(F.replace(w, F.lit("-"), F.lit(""))), F.split(w, "-"))).otherwise(F.array(w)))
    kept = F.filter(F.flatten(forms), lambda w: F.char_length(w) > 1)
    return F.transform(kept, _stem) if stemming else kept


@F.pandas_udf(ArrayType(StringType()))
def code_terms(texts: pd.Series) -> pd.Series:
    return texts.map(code_words)


# English number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "k": 1000, "m": 10**6, "b": 10**9}


def parse_number(text: str | None) -> float | None:
    """The number in digits ("1,200", "1.5k") or words ("twenty-five"); None when there is none."""
    if not text:
        return None
    s = text.strip().lower().replace(",", "")
    m = re.fullmatch(r"[$€£]?(-?\d+(?:\.\d+)?)\s*(k|m|b|thousand|million|billion|hundred)?", s)
    if m:
        return float(m[1]) * _SCALES.get(m[2], 1)
    total, group, seen = 0, 0, False
    for w in re.split(r"[\s-]+", s):
        if w in _ONES:
            group += _ONES.index(w)
        elif w in _TENS:
            group += 20 + 10 * _TENS.index(w)
        elif w == "hundred":
            group = max(group, 1) * 100
        elif w in ("thousand", "million", "billion"):
            total += max(group, 1) * _SCALES[w]
            group = 0
        elif w == "and" and seen:
            continue
        else:
            return None
        seen = True
    return float(total + group) if seen else None


def number_of(text: Column) -> Column:
    """parse_number() as an expression."""
    t = F.replace(F.lower(F.trim(text)), F.lit(","), F.lit(""))
    scale = F.create_map(*[F.lit(x) for kv in _SCALES.items() for x in (kv[0], float(kv[1]))])
    digits = r"^[$€£]?(-?\d+(?:\.\d+)?)\s*(k|m|b|thousand|million|billion|hundred)?$"
    in_digits = F.regexp_extract(t, digits, 1).cast("double") * F.coalesce(F.try_element_at(scale, F.regexp_extract(t, digits, 2)), F.lit(1.0))
    small = {w: float(i) for i, w in enumerate(_ONES)} | {w: 20.0 + 10 * i for i, w in enumerate(_TENS)}
    value = F.create_map(*[F.lit(x) for kv in small.items() for x in kv])
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("group"), F.lit(False).alias("seen"), F.lit(True).alias("ok"))

    def step(s: Column, w: Column) -> Column:
        plain, big = F.try_element_at(value, w), w.isin("thousand", "million", "billion")
        skip = (w == "and") & s["seen"]
        group = F.when(plain.isNotNull(), s["group"] + plain).when(w == "hundred", F.greatest(s["group"], F.lit(1.0)) * 100).when(big, F.lit(0.0)).otherwise(s["group"])
        total = F.when(big, s["total"] + F.greatest(s["group"], F.lit(1.0)) * F.try_element_at(scale, w)).otherwise(s["total"])
        known = plain.isNotNull() | (w == "hundred") | big
        return F.struct(total.alias("total"), group.alias("group"), (s["seen"] | known).alias("seen"), (s["ok"] & (known | skip)).alias("ok"))

    in_words = F.aggregate(F.split(t, r"[\s-]+"), start, step, lambda s: F.when(s["ok"] & s["seen"], s["total"] + s["group"]))
    return F.when(t.rlike(digits), in_digits).otherwise(in_words)
