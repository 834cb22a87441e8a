"""Small document tables with the cases that every operator must handle, and brute-force counterparts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = (
    "the quick brown fox jumps over the lazy dog while seven wizards brew potions in a dim cellar and nobody outside hears the strange low humming "
    "that fills the valley every night until the morning bell rings over the sleepy town and people rise to bake bread and sweep the streets"
)


def documents(spark, rows, extra=False):
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:  # columns whose names clash with words that operators use
        from pyspark.sql import functions as F

        for name in ("size", "h", "kind", "ids", "weight", "h", "_x", "position", "label"):
            df = df.withColumn(name, F.lit("x"))
    return df


def edge_rows(seed=5, n=60):
    """Near and exact copies, nulls, empty and blank texts, short and long ones, odd bytes."""
    rng = random.Random(seed)
    words = BASE.split()
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, "one", "en", None), (4, "one", "en", "b"), (5, "a b c d", "en", "b"), (6, "A  b\tC d", "fr", "c")]
    rows += [(7, BASE, "en", "a"), (8, BASE, "en", "b"), (9, BASE.upper(), "en", "a"), (10, BASE + " " + BASE, "en", "d"), (11, "\0 é 😀 " * 30, "xx", "d"), (12, "ab " * 4000, "en", "a")]
    for i in range(13, n):
        w = list(words)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("zig zag zog".split())
        cut = rng.choice([len(w), len(w), 6, 8, 9, 12, 30])
        start = rng.randrange(0, max(1, len(w) - cut + 1))
        rows.append((i * 7, " ".join(w[start : start + cut]), rng.choice(["en", "fr", None]), rng.choice("abcd")))
    return rows


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def of_every_size(spark, most=1100):
    """Two copies each of texts of 5 to most + 4 words, in one partition; (doc_id, shingles, least doc_id) is known.

    A written table of such sizes has a dictionary of more than 8 KB.
    """
    return spark.range(0, 2 * most, 1, 1).selectExpr(
        "id as doc_id", f"concat_ws(' ', transform(sequence(0, id % {most} + 4), j -> concat('w', id % {most}, '_', j))) as text", "'en' as lang", "'a' as source", "0L as n_chars"
    )
