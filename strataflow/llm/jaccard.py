r"""N-gram Jaccard join: size-aware, heavy-light, exact.

Sets are the distinct 5-word shingles of lower-cased (A-Z) texts, words ``[^\x20\x09-\x0D]+``; a text
of one to four words has its whole sequence as one shingle. Sets A, B link when 9 |A & B| >=
4 (|A| + |B|), that is at a similarity of 0.8.

Light part: a set of ``boundary`` shingles or fewer enumerates, for each partner size m that could link, all
its subsets of the c(n, m) shingles that a link must share. Two sets meet at a subset exactly
when they link, so nothing is verified. Heavy part: a larger set scans the inverted lists of its
prefix, the n - ceil(0.8 n) + 1 shingles least in a global order; linked sets share one. The boundary
is where the counted subsets of the sizes at hand start to cost more than scanning.

The global order puts shingles found often in whole files last. It steers cost only, any order is
exact, so it may be bounded to the FREQUENT most frequent ones, counted over all documents.

Only components are asked for, so lists are not turned into all pairs. First, sets that are equal are one.
Then every list links its members to one hub, after verification of the pair. Then the members of lists that
still hold several components meet across components: in lists of SHORT members at once, the members of longer lists
in a second join, with their lists' shingles put last, and what is still in long lists in a third, by exact
frequency. Every pair that meets is verified, so no link between different texts
is lost, and pairs within a component never arise. Very frequent shingles' lists are salted for the first step.

Nulls and texts without words: empty sets, linked with nothing, component_id the own id. A null
doc_id has component null. Rows that repeat a doc_id count as one node. Ties do not matter: the component is the least id.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strataflow.llm import bitmap, scratch
from strataflow.llm import bytesops as B
from strataflow.operators.components import components

K = 5
FREQUENT = 1 << 20
LOCAL = 1 << 21
LIST = 4096
SHORT = 32
MOST_LIGHT = 12
MOST_LISTS = (1 << 15) - 1
SIGNATURE = 4096
#: cost of a posting that is grouped and joined back, and of verifying, against one subset key
SCAN_COST, VERIFY_COST = 2.0, 4.0


def needed(n, m):
    """Least intersection of linked sets of n and m shingles."""
    return (4 * (n + m) + 8) // 9


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def partners(n: int, most: int) -> list[int]:
    return [m for m in range((4 * n + 4) // 5, min(most, 5 * n // 4) + 1) if needed(n, m) <= min(n, m)]


def boundary(sizes: dict[int, int]) -> int:
    """The largest set size to enumerate, by cost, given how many sets have each size."""
    best, least = 0, None
    for b in range(0, MOST_LIGHT + 1):
        cost = 0.0
        for n, count in sizes.items():
            if n <= b:
                cost += count * sum(comb(n, needed(n, m)) for m in partners(n, b))
            if 5 * n >= 4 * (b + 1):  # may link with a set above the boundary
                cost += count * (SCAN_COST * prefix_length(n) + VERIFY_COST)
        if least is None or cost < least:
            best, least = b, cost
    return best


def _sets(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, text indices relative to the first, shingles) chunk by chunk."""
    for low, high in B.chunks(texts):
        doc, h = B.shingles(texts[low:high], lower=True, k=K)
        yield low, high, doc, h


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, key 1, key 2) of every document, and rows (null, count, shingle, null) of
    shingles found in several documents of LOCAL shingles read in a row."""
    held, total = [], 0

    def frequent() -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(held) if held else np.zeros(0, B.U64), return_counts=True)
        h, count = h[count > 1].view(np.int64), count[count > 1]
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(count.astype(np.int64)), pa.array(h), none], ["doc_id", "n", "k1", "k2"])

    for batch in batches:
        texts = B.texts_of(batch.column("text"))
        n, k1, k2 = np.zeros(len(texts), np.int64), np.zeros(len(texts), B.U64), np.zeros(len(texts), B.U64)
        for low, high, doc, h in _sets(texts):
            n[low:high] = np.bincount(doc, minlength=high - low)
            some = np.flatnonzero(n[low:high])
            if len(some):
                first = np.searchsorted(doc, some)
                k1[low + some] = np.add.reduceat(B.mix(h), first)
                k2[low + some] = np.add.reduceat(B.mix(h ^ B.U64(0xA5A5A5A5A5A5A5A5)), first)
            held.append(h)
            total += len(h)
            if total > LOCAL:
                yield frequent()
                held, total = [], 0
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["doc_id", "n", "k1", "k2"])
    yield frequent()


class Frequency:
    """Weights of sorted shingles; a table of their high bits answers for most others."""

    BITS = 22

    def __init__(self, known: np.ndarray, weight: np.ndarray):
        self.known, self.weight = known, weight
        self.some = np.zeros(1 << self.BITS, dtype=bool)
        self.some[known >> B.U64(64 - self.BITS)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Weights of shingles, 0 of those that are not known."""
        out = np.zeros(len(h), dtype=np.int64)
        maybe = np.flatnonzero(self.some[h >> B.U64(64 - self.BITS)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == h[maybe], self.weight[at], 0)
        return out


def _weights(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent shingles, sorted, and their weights."""
    top = survey.where("doc_id is null and k2 is null").groupBy("k1").agg(F.sum("n").alias("w")).orderBy(F.desc("w"), "k1").limit(FREQUENT).toArrow()
    h = top.column("k1").to_numpy().astype(np.int64).view(B.U64)
    order = np.argsort(h)
    return h[order], top.column("w").to_numpy().astype(np.int64)[order]


def _heads(frequency: Frequency, doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, shingle, weight, position) of each set's prefix, in the order of weight, then hash; n: the sets' sizes."""
    w = frequency(h)
    order = np.lexsort((h, w, doc))
    doc, h, w = doc[order], h[order], w[order]
    position = np.arange(len(doc)) - np.searchsorted(doc, doc)
    head = position < prefix_length(n[doc])
    return doc[head], h[head], w[head], position[head]


def _poster(shared, most_light: int):
    """Postings (h, doc, place) of documents; equal sets post once a task. h is the shingle, its top bits crossed with the salt.

    ``place`` packs, from the top: light (1 bit), salt (15), set size (24), position or the partner's size (23).
    """
    plans = {n: [(m, list(combinations(range(n), needed(n, m)))) for m in partners(n, most_light)] for n in range(1, most_light + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = Frequency(*shared.value)
        seen: set[bytes] = set()
        for batch in batches:
            texts, ids = B.texts_of(batch.column("text")), batch.column("doc_id").cast(pa.int64())
            valid = ~np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            out: list[list[np.ndarray]] = [[], [], []]

            def put(h, salt, doc, n, p, light):
                salt = np.asarray(salt, np.int64)
                place = np.int64(light) << 62 | salt << 47 | np.asarray(n, np.int64) << 23 | p
                for column, value in zip(out, (h.view(np.int64) ^ salt << 48, doc, np.broadcast_to(place, len(h)))):
                    column.append(value)

            for low, high, doc, h in _sets(texts):
                n = np.bincount(doc, minlength=high - low)
                if n.max(initial=0) >= 1 << 24:
                    raise ValueError("a set of more than 16 million shingles does not fit a posting")
                fresh = np.zeros(high - low, dtype=bool)
                first = np.searchsorted(doc, np.arange(high - low + 1))
                for i in np.flatnonzero((n > 0) & valid[low:high]):
                    key = hashlib.sha256(h[first[i] : first[i + 1]].tobytes()).digest()
                    if key not in seen:
                        if len(seen) >= 1 << 18:  # memory bound; posting a set twice is harmless
                            seen.clear()
                        seen.add(key)
                        fresh[i] = True
                large = fresh & (5 * n >= 4 * (most_light + 1))
                take = large[doc]
                if take.any():
                    d, g, w, position = _heads(frequency, doc[take], h[take], n)
                    lists = np.minimum((w + LIST - 1) // LIST, MOST_LISTS)
                    salt = np.where(lists > 1, 1 + (ids[low + d].astype(np.int64) & 0x7FFFFFFF) % np.maximum(lists, 1), 0)
                    put(g, salt, ids[low + d], n[d], position, 0)
                for size in range(1, most_light + 1):
                    members = np.flatnonzero(fresh & (n == size))
                    if not len(members):
                        continue
                    sets = h[first[members][:, None] + np.arange(size)]
                    for m, subsets in plans[size]:
                        for subset in subsets:
                            key = np.full(len(members), (min(size, m) << 8 | max(size, m)) + 1, dtype=B.U64)
                            for j in subset:
                                key = B.mix(key * B.STEPS[0] + sets[:, j])
                            put(key, 0, ids[low + members], size, m, 1)
            if out[0]:
                c = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in c], ["h", "doc", "place"])

    return run


POSTING = StructType([StructField(c, LongType(), False) for c in ("h", "doc", "place")])


def _bits(place: str, shift: int, width: int):
    return F.shiftright(F.col(place), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _chosen(docs: DataFrame, ids: DataFrame, columns: list[tuple], emitter):
    """Rows that ``emitter()``, made once a task, makes of the shingles of the documents named by ``ids`` (doc), and perhaps
    of a few more: (ids, text indices, shingles, number of texts).

    A bitmap of the ids keeps the texts of all others, and so every text, out of the shuffle.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap.build(ids, "doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = emitter()
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(0))
            wanted = np.flatnonzero(bitmap.contains(bits.value, ids) & ~np.asarray(batch.column("doc_id").is_null()))
            texts = B.texts_of(batch.column("text").take(pa.array(wanted)))
            for low, high, doc, h in _sets(texts):
                yield pa.RecordBatch.from_arrays(emit(ids[wanted[low:high]], doc, h, high - low), [c for c, _ in columns])

    # without nulls, so that no inferred filter tells the two sides of a self-join apart and they share one shuffle
    return docs.select("doc_id", "text").mapInArrow(scratch.lean(run), StructType([StructField(c, t, False) for c, t in columns]))


def _signature(ids, doc, h, n):
    """Parities of SIGNATURE hash buckets, as 64-bit words: sets differ in at least as many shingles as in bits."""
    parts, step = [], 64  # sets at a time, so that their counters take 2 MB
    bucket = (h >> B.U64(20)).astype(np.int64) % SIGNATURE
    for low in range(0, n, step):
        first, last = np.searchsorted(doc, (low, low + step))
        counts = np.bincount((doc[first:last] - low) * SIGNATURE + bucket[first:last], minlength=min(step, n - low) * SIGNATURE)
        parts.append(np.packbits((counts & 1).astype(np.uint8)))
    words = np.concatenate(parts).view(np.int64)
    offsets = np.arange(n + 1, dtype=np.int32) * (SIGNATURE // 64)
    return [pa.array(ids), pa.array(np.bincount(doc, minlength=n)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words))]


def _shingle_lists(ids, doc, h, n):
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return [pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))]


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose sets link.

    Signatures come first: linked sets differ in (n + m) / 9 shingles at most, so pairs whose signatures
    differ in more bits are dropped. Sets are made for what is left only.
    """
    longs = ArrayType(LongType(), False)
    ends = lambda p: p.select(F.explode(F.array("u", "v")).alias("doc"))
    signs = _chosen(docs, ends(pairs), [("doc", LongType()), ("n", LongType()), ("sign", longs)], lambda: _signature)
    both = pairs.select("u", "v").join(signs.toDF("u", "na", "a"), "u").join(signs.toDF("v", "nb", "b"), "v")
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = scratch.cut(both.where(9 * bits <= F.col("na") + F.col("nb")).select("u", "v"), "near", narrow=True)
    sets = _chosen(docs, ends(near), [("doc", LongType()), ("shingles", longs)], lambda: _shingle_lists)
    both = near.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _fits(n, p, m, q):
    """Whether sets of n and m shingles that first meet at positions p and q can link."""
    return (9 * F.least(n, m) >= 4 * (n + m)) & (9 * F.least(n - p, m - q) >= 4 * (n + m))


def _open_lists(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (h, doc, n, p, component) that can meet any other of their list, and (h, _c), the lists
    with several components and their lengths.

    A posting is dropped when even the smallest set of its list asks for more shingles than it has left.
    """
    least = rows.groupBy("h").agg(F.min("n").alias("_m"))
    m = F.greatest(F.col("_m"), F.floor((4 * F.col("n") + 4) / 5))
    kept = rows.join(least, "h").where(9 * (F.col("n") - F.col("p")) >= 4 * (F.col("n") + m)).drop("_m")
    kept = scratch.cut(kept, "open", narrow=True)
    counts = kept.groupBy("h").agg(F.count("*").alias("_c"), F.min("component").alias("_c0"), F.max("component").alias("_c1")).where("_c0 < _c1")
    return kept, scratch.cut(counts.select("h", "_c"), "counts", narrow=True)


def _meetings(rows: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of postings (h, doc, n, p, component) of one list, of different components, that can link."""
    x = rows.select("h", F.col("doc").alias("u"), F.col("n").alias("nu"), F.col("p").alias("pu"), F.col("component").alias("cu"))
    y = rows.select("h", F.col("doc").alias("v"), F.col("n").alias("nv"), F.col("p").alias("pv"), F.col("component").alias("cv"))
    both = x.join(y, "h").where((F.col("u") > F.col("v")) & (F.col("cu") != F.col("cv")) & _fits(F.col("nu"), F.col("pu"), F.col("nv"), F.col("pv")))
    return both.select("u", "v").distinct()


def _across(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (u, v) that can link, of documents (doc, component) in different components.

    The order is now by the shingles' exact frequency among these documents. What only one of them has comes
    first, and fills the prefixes of documents that merely share passages or a common ancestor: they meet no more.
    """
    sets = _chosen(docs, members.select("doc"), [("doc", LongType()), ("shingles", ArrayType(LongType(), False))], lambda: _shingle_lists)
    sets = members.join(sets, "doc")
    rows = sets.select("doc", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    counts = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    met = rows.join(counts, "h").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("met"))
    # shingles of one document alone take the first places
    alone = F.col("n") - F.size("met")
    length = F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1
    heads = met.where(alone < length).select("doc", "n", alone.alias("_alone"), F.posexplode(F.slice("met", F.lit(1), length - alone)).alias("_i", "s"))
    heads = heads.select("doc", F.col("n").cast("long").alias("n"), (F.col("_alone") + F.col("_i")).cast("long").alias("p"), "s.h")
    return _meetings(scratch.cut(heads.join(members, "doc"), "heads", narrow=True))


def _again(docs: DataFrame, members: DataFrame, known: tuple[np.ndarray, np.ndarray], long: DataFrame) -> DataFrame:
    """Pairs (u, v) that can link, of documents (doc, component) of long lists, in different components.

    The shingles of long lists (h, _c) are now known to be frequent and go last in the order, the
    FREQUENT most frequent of all at most. What still meets in long lists is left to exact frequencies.
    """
    top = long.orderBy(F.desc("_c"), "h").limit(FREQUENT).toArrow()
    h = np.concatenate([top.column("h").to_numpy().astype(np.int64).view(B.U64), known[0]])
    w = np.concatenate([top.column("_c").to_numpy().astype(np.int64) + SHORT, known[1]])
    keep = np.sort(np.lexsort((h, -w))[:FREQUENT])
    h, first = np.unique(h[keep], return_index=True)
    shared = docs.sparkSession.sparkContext.broadcast((h, w[keep][first]))  # 16 MB at most

    def emitter():
        frequency = Frequency(*shared.value)

        def emit(ids, doc, h, n):
            sizes = np.bincount(doc, minlength=n)
            d, g, _, p = _heads(frequency, doc, h, sizes)
            return [pa.array(ids[d]), pa.array(g.view(np.int64)), pa.array(sizes[d]), pa.array(p)]

        return emit

    rows = members.join(_chosen(docs, members.select("doc"), [(c, LongType()) for c in ("doc", "h", "n", "p")], emitter), "doc")
    rows, counts = _open_lists(rows)
    left = rows.join(counts.where(F.col("_c") > SHORT), "h").select("doc", "component").distinct()
    return _meetings(rows.join(counts.where(F.col("_c") <= SHORT), "h").drop("_c")).unionByName(_across(docs, scratch.cut(left, "members", narrow=True)))


def _one_of_equals(members: DataFrame, own: DataFrame) -> DataFrame:
    """Those of the documents (doc, component) that are left when one of those with equal sets is enough.

    Every task posts a set anew, so lists hold copies; they link, and are in one component.
    """
    sets = own.join(scratch.broadcast_if_small(members), F.col("doc_id") == F.col("doc")).groupBy("n", "k1", "k2")
    return scratch.cut(sets.agg(F.min(F.struct("doc", "component")).alias("m")).select("m.*").distinct(), "members", narrow=True)


@scratch.tidy
def links_and_sizes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of every row, and (node, component) of every linked document."""
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    survey = scratch.cut(docs.select("doc_id", "text").mapInArrow(scratch.lean(_survey), "doc_id long, n long, k1 long, k2 long"), "survey", files=scratch.tasks(docs))
    rows = survey.where("k2 is not null")
    sizes = rows.select("doc_id", F.col("n").alias("n_shingles"))
    small = rows.where((F.col("n") > 0) & (F.col("n") <= 2 * MOST_LIGHT)).groupBy("n").count().collect()  # 24 rows at most
    most_light = boundary({r["n"]: r["count"] for r in small})
    known = _weights(survey)
    shared = spark.sparkContext.broadcast(known)  # FREQUENT pairs of numbers, 16 MB at most

    own = rows.where("n > 0 and doc_id is not null")
    firsts = own.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c")
    firsts = scratch.broadcast_if_small(scratch.cut(firsts, "firsts", narrow=True))
    equal = own.join(firsts, ["n", "k1", "k2"]).select(F.col("doc_id").alias("u"), "v").where("u <> v")

    posts = docs.select("doc_id", "text").mapInArrow(scratch.lean(_poster(shared, most_light)), POSTING)
    # one shuffle and one sort; lists are bounded by their salts, and lists with one member, which are most of all, end here
    whole, salt = Window.partitionBy("h"), _bits("place", 47, 15)
    lists = posts.withColumns({"hub": F.min(F.struct("doc", "place")).over(whole), "last": F.max("doc").over(whole)}).where((F.col("hub.doc") < F.col("last")) | (salt > 0))
    lists = lists.select(
        F.col("h").bitwiseXOR(F.shiftleft(salt, 48)).alias("h"), "doc", (_bits("place", 62, 1) == 1).alias("light"), salt.alias("salt"), _bits("place", 23, 24).alias("n"), _bits("place", 0, 23).alias("p"), "hub",
    )
    lists = scratch.cut(lists, "lists", files=2 * scratch.tasks(docs))

    # subsets: members of the two sizes are joined through one of each; every one of these is a link
    light = lists.where("light").select("h", "doc", "n", F.col("p").alias("m"))
    ends = light.groupBy("h", "n", "m").agg(F.min("doc").alias("v")).select(F.col("h").alias("_h"), F.col("m").alias("_n"), F.col("n").alias("_m"), "v")
    subset_links = light.join(ends, (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")) & (F.col("m") == F.col("_m"))).select(F.col("doc").alias("u"), "v")

    heavy = lists.where("not light").select("h", "salt", "doc", "n", "p", "hub")
    hub_n, hub_p = _bits("hub.place", 23, 24), _bits("hub.place", 0, 23)
    stars = heavy.where((F.col("doc") != F.col("hub.doc")) & _fits(F.col("n"), F.col("p"), hub_n, hub_p)).select(F.col("doc").alias("u"), F.col("hub.doc").alias("v"))
    salted = heavy.where("salt > 0").select("h", "hub").distinct()
    top = salted.groupBy("h").agg(F.min("hub").alias("top"))
    across = salted.join(top, "h").where("hub.doc <> top.doc").select(F.col("hub.doc").alias("u"), F.col("top.doc").alias("v"))
    stars = scratch.cut(stars.unionByName(across).distinct(), "stars", narrow=True)
    links = equal.unionByName(subset_links).unionByName(_verified(docs, stars))
    found = scratch.cut(components(links, "star-components"), "components", narrow=True)

    # lists that still hold several components
    members = scratch.broadcast_if_small(found)
    placed = heavy.join(members, F.col("doc") == F.col("node"), "left").select("h", "doc", "n", "p", F.coalesce("component", "doc").alias("component"))
    mixed = placed.groupBy("h").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("h")
    mixed = scratch.cut(mixed, "mixed-lists", narrow=True)
    still, counts = _open_lists(placed.join(scratch.broadcast_if_small(mixed), "h", "left_semi"))
    # two documents of one list meet in a short list, or are both among those of long ones, which are joined again
    short = still.join(counts.where(F.col("_c") <= SHORT), "h").drop("_c")
    long = counts.where(F.col("_c") > SHORT)
    members = _one_of_equals(scratch.cut(still.join(long, "h").select("doc", "component").distinct(), "listed", narrow=True), own)
    rest = _meetings(short).unionByName(_again(docs, members, known, long)).distinct()
    tried = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rest = scratch.cut(rest.join(tried, ["u", "v"], "left_anti"), "rest", narrow=True)
    more = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(_verified(docs, rest))
    return sizes, components(more, "components")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    sizes, found = links_and_sizes(docs)
    return sizes.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents whose id is the least of their component; rows that repeat an id stay or go together."""
    _, found = links_and_sizes(docs)
    gone = found.where("node <> component").select(F.col("node").alias("_sf_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_sf_gone"), "left_anti")
