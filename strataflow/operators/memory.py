"""Structured memory: ledgers, state machines, preferences, trees, entity facts; and memory upkeep."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow import shared

# ---- ledgers: key, a, b, ts, amount, direction (Credit or Debit), description


def signed(amount: Column, direction: Column) -> Column:
    return F.when(F.lower(direction) == "debit", -amount).otherwise(amount)


def ledger_balance(entries: DataFrame) -> DataFrame:
    """(key, balance, entries): credits less debits."""
    return entries.groupBy("key").agg(F.sum(signed(F.col("amount"), F.col("direction"))).alias("balance"), F.count("*").alias("entries"))


def running_balance(entries: DataFrame, tie: str = "description") -> DataFrame:
    """Each entry with the key's balance after it."""
    w = Window.partitionBy("key").orderBy("ts", tie).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("balance", F.sum(signed(F.col("amount"), F.col("direction"))).over(w))


def ledger_sum(entries: DataFrame, by: list[str] = ()) -> DataFrame:
    """total and entries, by the given columns."""
    return entries.groupBy(*by).agg(F.sum("amount").alias("total"), F.count("*").alias("entries"))


def net_balances(payments: DataFrame) -> DataFrame:
    """(person, currency, net): received less paid. payments: payer, payee, amount, currency."""
    paid = payments.select(F.col("payer").alias("person"), "currency", (-F.col("amount")).alias("net"))
    got = payments.select(F.col("payee").alias("person"), "currency", F.col("amount").alias("net"))
    return paid.unionByName(got).groupBy("person", "currency").agg(F.sum("net").alias("net"))


def pair_balances(payments: DataFrame) -> DataFrame:
    """(a, b, currency, net) with a < b: what b owes a when positive."""
    ahead = F.col("payer") < F.col("payee")
    flat = payments.where("payer <> payee").select(
        F.least("payer", "payee").alias("a"), F.greatest("payer", "payee").alias("b"), "currency", F.when(ahead, F.col("amount")).otherwise(-F.col("amount")).alias("net")
    )
    return flat.groupBy("a", "b", "currency").agg(F.sum("net").alias("net"))


def simplify_debts(balances: DataFrame) -> DataFrame:
    """(currency, debtor, creditor, amount): transfers that settle net balances, in whole cents.

    Debtors and creditors are laid end to end on one line of cents, largest first, and each overlap is a transfer: at most
    n - 1 of them, found by prefix sums and an interval join rather than by a loop over people.
    """
    cents = balances.select("currency", "person", F.round(F.col("net") * 100).cast("long").alias("c")).where("c <> 0")

    def line(df: DataFrame, person: str, start: str, end: str) -> DataFrame:
        w = Window.partitionBy("currency").orderBy(F.desc("c"), "person").rowsBetween(Window.unboundedPreceding, 0)
        high = F.sum("c").over(w)
        return df.select("currency", F.col("person").alias(person), (high - F.col("c")).alias(start), high.alias(end))

    owe = line(cents.where("c < 0").withColumn("c", -F.col("c")), "debtor", "_s", "_e")
    get = line(cents.where("c > 0"), "creditor", "_s2", "_e2")
    pairs = owe.join(get, "currency").where((F.col("_s") < F.col("_e2")) & (F.col("_s2") < F.col("_e")))
    amount = (F.least("_e", "_e2") - F.greatest("_s", "_s2")) / 100.0
    return pairs.select("currency", "debtor", "creditor", amount.alias("amount"))


# ---- state machines: entity, category, target, valid_from


def state_history(states: DataFrame, tie: str = "target") -> DataFrame:
    """(entity, category, from_state, to_state, at) transitions in order."""
    w = Window.partitionBy("entity", "category").orderBy("valid_from", tie)
    return states.select("entity", "category", F.lag("target").over(w).alias("from_state"), F.col("target").alias("to_state"), F.col("valid_from").alias("at"))


def current_state(states: DataFrame) -> DataFrame:
    """(entity, category, state, since): the latest entry; of equal times the greatest target."""
    latest = F.max(F.struct("valid_from", "target"))
    return states.groupBy("entity", "category").agg(latest.alias("_m")).select("entity", "category", F.col("_m.target").alias("state"), F.col("_m.valid_from").alias("since"))


def entity_facts(facts: DataFrame) -> DataFrame:
    """Facts (entity, assoc_type, target, valid_from, valid_until) with ``is_current``: open, and the
    latest of the entity's facts of that type and target."""
    w = Window.partitionBy("entity", "assoc_type", "target")
    return facts.withColumn("is_current", F.col("valid_until").isNull() & (F.col("valid_from") == F.max("valid_from").over(w)))


def write_facts(old: DataFrame, new: DataFrame, single_valued: DataFrame) -> DataFrame:
    """Facts after a batch of new ones: repeats of an open fact are dropped, and a new value of a
    single-valued type (``single_valued`` has assoc_type) closes the one before at its start.

    Facts: entity, assoc_type, target, valid_from, valid_until, depends_on (a target, or null).
    """
    columns = ["entity", "assoc_type", "target", "valid_from", "valid_until", "depends_on"]
    every = old.select(*columns).unionByName(new.select(*columns))
    by_value = Window.partitionBy("entity", "assoc_type", "target").orderBy("valid_from")
    every = every.withColumn("_before", F.lag(F.struct("valid_from", "valid_until")).over(by_value))
    open_before = F.col("_before").isNotNull() & (F.col("_before.valid_until").isNull() | (F.col("_before.valid_until") > F.col("valid_from")))
    every = every.where(~open_before).drop("_before")
    one = single_valued.select("assoc_type", F.lit(True).alias("_one"))
    every = every.join(one, "assoc_type", "left")
    nxt = F.lead("valid_from").over(Window.partitionBy("entity", "assoc_type").orderBy("valid_from", "target"))
    closed = F.when(F.col("_one") & nxt.isNotNull(), F.least(F.coalesce("valid_until", nxt), nxt)).otherwise(F.col("valid_until"))
    every = every.withColumn("valid_until", closed)
    # what depends on a value that was superseded ends with it
    gone = every.where("valid_until is not null").groupBy("entity", "target").agg(F.max("valid_until").alias("_gone"))
    gone = gone.select(F.col("entity").alias("_e"), F.col("target").alias("_t"), "_gone")
    out = every.join(gone, (F.col("entity") == F.col("_e")) & (F.col("depends_on") == F.col("_t")), "left")
    end = F.when(F.col("_gone").isNotNull() & (F.col("_gone") > F.col("valid_from")), F.least(F.coalesce("valid_until", "_gone"), F.col("_gone"))).otherwise(F.col("valid_until"))
    return out.select("entity", "assoc_type", "target", "valid_from", end.alias("valid_until"), "depends_on")


# ---- preferences: entity, item, rank, ts


def rank_preferences(items: DataFrame, by: str = "rank") -> DataFrame:
    """Preferences with ``position``: by stated rank, or by recency (``by`` = ts)."""
    order = [F.col("rank").asc_nulls_last(), "item"] if by == "rank" else [F.desc("ts"), "item"]
    return items.withColumn("position", F.row_number().over(Window.partitionBy("entity").orderBy(*order)))


def update_preferences(items: DataFrame, new: DataFrame) -> DataFrame:
    """The latest entry of each (entity, item)."""
    latest = F.max(F.struct("ts", "rank"))
    return items.unionByName(new).groupBy("entity", "item").agg(latest.alias("_m")).select("entity", "item", "_m.rank", "_m.ts")


def common_preferences(items: DataFrame, a: str, b: str) -> DataFrame:
    """Items that both entities have."""
    return items.where(F.col("entity") == a).select("item").intersect(items.where(F.col("entity") == b).select("item"))


# ---- trees: parent, child


def children(tree: DataFrame, parent: str) -> DataFrame:
    return tree.where(F.col("parent") == parent).select("child")


@shared.tidy
def descendants(tree: DataFrame, root: str, high: int | None = None) -> DataFrame:
    """(node, depth) below a node, to any depth or to ``high``."""
    links = shared.cut(tree.select("parent", "child").distinct(), "tree")
    level = links.where(F.col("parent") == root).select(F.col("child").alias("node"), F.lit(1).alias("depth"))
    found = level
    for depth in count(2) if high is None else range(2, high + 1):
        level = links.join(level.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        level = shared.cut(level.join(found, "node", "left_anti"), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def related(edges: DataFrame, start: int, predicate: str, high: int | None = None) -> DataFrame:
    """(node, depth) reached over edges whose association type has the predicate."""
    from strataflow.operators.paths import neighbours

    return neighbours(edges.where(F.split("assoc_type", ":")[1] == predicate), start, high)


# ---- upkeep


def decay_strength(memories: DataFrame, now: int, rate_per_hour: float = 0.01) -> DataFrame:
    """strength * exp(-rate * hours since accessed_at)."""
    hours = F.greatest(F.lit(now) - F.col("accessed_at"), F.lit(0)) / float(3600 * 10**9)
    return memories.withColumn("strength", F.col("strength") * F.exp(-F.lit(rate_per_hour) * hours))


def forget(memories: DataFrame, least: float = 0.1) -> DataFrame:
    """Memories that are strong enough, or of the tiers that are never forgotten."""
    return memories.where((F.col("strength") >= least) | F.col("tier").isin("Schema"))


def evict(nodes: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nodes most worth keeping: by tier, then importance, then recency."""
    tier = F.when(F.col("node_type").isin("Strategy", "Concept"), 2).when(F.col("node_type").isin("Goal", "Memory", "Claim"), 1).otherwise(0)
    return nodes.orderBy(tier.desc(), F.desc("confidence"), F.desc("updated_at"), "id").limit(keep)


def consolidate(memories: DataFrame, size: int = 3, most: int = 3) -> DataFrame:
    """(bucket, chunk, members, formed_at): full chunks of episodic memories of a goal bucket, in order of
    (formed_at, memory_id), at most ``most`` a bucket in one pass; chunks without any signal are skipped."""
    w = Window.partitionBy("bucket").orderBy("formed_at", "memory_id")
    m = memories.where("tier = 'Episodic'").withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    chunks = m.groupBy("bucket", "chunk").agg(
        F.array_sort(F.collect_list("memory_id")).alias("members"), F.max("formed_at").alias("formed_at"), F.sum(F.abs("signal")).alias("_signal"), F.count("*").alias("_n")
    )
    good = chunks.where((F.col("_n") == size) & (F.col("_signal") > 0))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("chunk"))
    return good.withColumn("_rank", rank).where(F.col("_rank") <= most).select("bucket", "chunk", "members", "formed_at")


def group_by_embedding(memories: DataFrame, least: float = 0.8, size: int = 3) -> DataFrame:
    """(bucket, group, members): greedy centroid groups within each bucket, in order of memory_id; ``size`` members at least.

    A bucket's semantic memories are few by construction (one per consolidated chunk).
    """
    schema = "bucket long, group int, members array<long>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        groups: list[tuple[np.ndarray, list]] = []
        for r in pdf.sort_values("memory_id").itertuples():
            v = np.asarray(r.embedding, dtype=float)
            best = max(((float(v @ c) / ((np.linalg.norm(v) * np.linalg.norm(c)) or 1.0), -i) for i, (c, _) in enumerate(groups)), default=(-1.0, 0))
            if best[0] >= least:
                c, members = groups[-best[1]]
                groups[-best[1]] = ((c * len(members) + v) / (len(members) + 1), [*members, r.memory_id])
            else:
                groups.append((v, [r.memory_id]))
        rows = [(int(pdf["bucket"].iloc[0]), i, m) for i, (_, m) in enumerate(groups) if len(m) >= size]
        return pd.DataFrame(rows, columns=["bucket", "group", "members"])

    return memories.groupBy("bucket").applyInPandas(run, schema)


def merge_nodes(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph with absorbed nodes replaced by survivors (mapping: absorbed, survivor); loops that this makes go."""
    m = mapping.select(F.col("absorbed").alias("_a"), F.col("survivor").alias("_s"))
    out = nodes.join(m, nodes["id"] == m["_a"], "left_anti")
    e = edges
    for end in ("source", "target"):
        e = e.join(m, F.col(end) == F.col("_a"), "left").withColumn(end, F.coalesce("_s", end)).drop("_a", "_s")
    return out, e.where("source <> target")
