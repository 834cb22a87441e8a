"""Mixing sources to target weights by Efraimidis-Spirakis sampling [native].

Targets are water-filled: sources share ``share`` of all words by weight, none above ``cap`` times
its own words. Each source first takes complete epochs, then a fractional one: documents sorted by
exponential keys -ln(u) / w, scaled by the quality weight w, until the prefix sum of sizes reaches
the source's budget. u comes from a hash of the id, so reruns agree.

Prefix sums are two-level: the logarithm of the key is cut into ``cells`` equal ranges per unit, range totals per
source are summed first, and exact prefix sums run only within a (source, range). No task sorts a whole source: a weight
only shifts the logarithm of an exponential key, whose density is 1/e at most, so whatever the weights are a range holds
about a source's documents / (e cells). ``cells`` grows with the rows, to CELL_ROWS a range.

Nulls: a null text has size 0, a null source is a source of its own (last in the order), a null id
hashes like any other value. Ties are broken by id, size and a hash of the text. Repeated rows count as rows of their
own; of equal ones at the end of a budget as many are taken as it has words for. Sources without words have target 0, very
long texts are taken up to the budget's last word, an empty table gives an empty mix. Extra columns are not read, but
apply_cuts() passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEED = 17
CELL_ROWS = 1 << 17


def word_count(text: Column) -> Column:
    """Number of words; every word is turned into one character."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Documented default weight: 1 for plain prose, down to 0.05 as symbols fill the text."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * symbols / n)), F.lit(0.05))


def targets(totals: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size -> source, source_size, target. One row per source in, one out.

    The excess of capped sources is reshared until none is above its cap. That fixed point is
    min(cap_i, level x weight_i), where the capped ones are a prefix in the order of cap_i / weight_i.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_all", F.lit(share) * F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    t = t.withColumn("_done", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_left", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_level", (F.col("_all") - F.col("_done")) / F.col("_left"))
    t = t.withColumn("_open", F.col("_level") * F.col("_w") < F.col("_cap"))
    level = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level")))).over(everything)["level"]
    t = t.withColumn("_final", level)
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return t.select("source", "source_size", target.alias("target"))


def _key(doc_id: Column, weight: Column, seed: int) -> Column:
    """Exponential key of a document: -ln(u) / weight, u from a hash of its id."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.greatest(weight, F.lit(1e-9))


def cells_for(rows: int) -> int:
    """Ranges per unit of the keys' logarithm, for a source of so many rows."""
    return max(64, -(-rows // (2 * CELL_ROWS)))


def _placed(rows: DataFrame, weights, share: float, cap: float, cells: int | None, seed: int) -> DataFrame:
    """``rows`` with source_size, target, _key, _epochs, _part (the words of the fractional epoch) and _nth (the
    number of equal rows before, which are interchangeable)."""
    cells = cells or cells_for(rows.count())
    rows = rows if "mark" in rows.columns else rows.withColumn("mark", F.lit(0).cast("long"))
    keyed = rows.withColumn("_key", _key(F.col("doc_id"), F.col("weight"), seed))
    keyed = keyed.withColumn("_bin", F.floor(F.log("_key") * cells).cast("long"))
    by_bin = keyed.groupBy("source", "_bin").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bin.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    goal = targets(by_bin.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, cap)
    starts = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).select(starts["source"], "_bin", "_before", "source_size", "target")
    ordered = Window.partitionBy("source", "_bin").orderBy("_key", "doc_id", "size", "mark")
    placed = keyed.withColumn("_within", F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("_nth", (F.row_number().over(ordered) - F.rank().over(ordered)).cast("long"))
    s = starts.select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), "_before", "source_size", "target")
    out = placed.join(s, placed["source"].eqNullSafe(s["_s"]) & (placed["_bin"] == s["_b"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size").cast("double"))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("_before") - F.col("_within")))
    return out.withColumn("_epochs", epochs).withColumn("_part", part.cast("long")).drop("_s", "_b", "_bin", "_before", "_within")


def mix(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, cells: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, weight (and mark) -> these, source_size, target and taken.

    ``taken`` counts the words that the mix takes from the document, epochs included. The document on
    which the budget ends gives only the words up to it, so each source ends within one word of its
    target. ``rows`` is read several times; pass a written table when it is costly.
    """
    placed = _placed(rows, weights, share, cap, cells, seed)
    return placed.withColumn("taken", (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long")).drop("_key", "_epochs", "_part", "_nth", "mark")


def cuts(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, cells: int | None = None, seed: int = SEED) -> DataFrame:
    """source, epochs and last (key, doc_id, size, mark, nth, part): the last document of the fractional epoch in the
    order of keys, the number of equal rows before it, and its words; null when there is none. One row a source says all
    that mix() decides."""
    placed = _placed(rows, weights, share, cap, cells, seed)
    last = F.struct(F.col("_key").alias("key"), "doc_id", "size", "mark", F.col("_nth").alias("nth"), F.col("_part").alias("part"))
    return placed.groupBy("source").agg(F.max("_epochs").alias("epochs"), F.max(F.when(F.col("_part") > 0, last)).alias("last"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, weight and mark (a hash of the text) of every document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"), F.xxhash64("text").alias("mark"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (all of it when it has no more)."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(words, 1, n.cast("int")), "")


def apply_cuts(docs: DataFrame, table: DataFrame, seed: int = SEED) -> DataFrame:
    """Repeat, cut or leave out documents as cuts() says; documents without words are left out.

    Every document's key is made anew and compared with its source's cut, so texts are not shuffled. Only the rows that equal
    the cut's document, one a source unless rows repeat, are written and numbered: by the file they lie in, then within it.
    """
    c = table.select(F.col("source").alias("_sf_source"), F.col("epochs").alias("_sf_epochs"), F.col("last").alias("_sf_last"))
    rows = docs.withColumn("_sf_size", word_count(F.col("text"))).where("_sf_size > 0")
    rows = rows.withColumn("_sf_key", _key(F.col("doc_id"), quality_weight(F.col("text")), seed)).withColumn("_sf_mark", F.xxhash64("text"))
    both = rows.join(scratch.broadcast_if_small(c), docs["source"].eqNullSafe(c["_sf_source"]))
    mine = F.struct(F.col("_sf_key").alias("key"), F.col("doc_id").alias("doc_id"), F.col("_sf_size").alias("size"), F.col("_sf_mark").alias("mark"))
    last = F.when(F.col("_sf_last").isNotNull(), F.struct(*(F.col(f"_sf_last.{f}").alias(f) for f in ("key", "doc_id", "size", "mark"))))
    at_cut = last.isNotNull() & mine.eqNullSafe(last)
    plain = both.where(~at_cut).withColumn("_sf_part", F.when(last.isNotNull() & (mine < last), F.col("_sf_size")).otherwise(0))

    equal = scratch.cut(both.where(at_cut), "at-the-cut")
    equal = equal.select("*", F.col("_metadata.file_name").alias("_sf_file"), F.col("_metadata.row_index").alias("_sf_row"))
    counts = equal.groupBy(F.col("_sf_source").alias("_sf_s"), F.col("_sf_file").alias("_sf_f")).agg(F.count("*").alias("_sf_n"))
    before = Window.partitionBy("_sf_s").orderBy("_sf_f").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_sf_before", F.coalesce(F.sum("_sf_n").over(before), F.lit(0)))
    equal = equal.withColumn("_sf_nth", F.row_number().over(Window.partitionBy("_sf_source", "_sf_file").orderBy("_sf_row")) - 1)
    equal = equal.join(counts, F.col("_sf_source").eqNullSafe(F.col("_sf_s")) & (F.col("_sf_file") == F.col("_sf_f")))
    words = F.col("_sf_last.nth") * F.col("_sf_size") + F.col("_sf_last.part") - (F.col("_sf_before") + F.col("_sf_nth")) * F.col("_sf_size")
    equal = equal.withColumn("_sf_part", F.greatest(F.lit(0), F.least(F.col("_sf_size"), words))).select(*plain.columns)

    both = plain.unionByName(equal)
    part = F.col("_sf_part")
    full = (F.col("_sf_epochs") + (part == F.col("_sf_size")).cast("long")).cast("int")
    rest = F.when((part > 0) & (part < F.col("_sf_size")), F.array(part.cast("int"))).otherwise(F.array().cast("array<int>"))
    out = both.withColumn("_sf_piece", F.explode(F.concat(F.array_repeat(F.lit(-1), full), rest)))
    out = out.withColumn("text", F.when(F.col("_sf_piece") < 0, F.col("text")).otherwise(first_words(F.col("text"), F.col("_sf_piece"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
