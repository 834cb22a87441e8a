"""Full-text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow import shared
from strataflow.functions import scoring
from strataflow.functions.text import simple_tokens

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf, length) of every document's terms; texts are dropped before the shuffle."""
    t = docs.select(key, tokens.alias("_tokens")).withColumn("length", F.size("_tokens"))
    return t.select(key, "length", F.explode("_tokens").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", tokens: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents with a query term; idf = ln((N - df + 0.5) / (df + 0.5) + 1).

    Query terms are filtered out of each document's tokens, and these narrow rows are written once: texts are read and
    tokenised in one pass, and nothing but hits is shuffled.
    """
    terms = sorted(set(query))
    tok = tokens if tokens is not None else simple_tokens(F.col(text))
    t = docs.select(key, tok.alias("_tokens")).select(key, F.size("_tokens").alias("length"), F.filter("_tokens", lambda x: x.isin(terms)).alias("_hits"))
    t = shared.cut(t, "terms", files=shared.tasks(docs))
    total = t.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    hits = t.where(F.size("_hits") > 0).select(key, "length", F.explode("_hits").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as query terms
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(total))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return scored.groupBy(key).agg(F.sum(idf * tf).alias("score"))


def bm25_mixed(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The better of the prose and the code score of each document."""
    from strataflow.functions import text as T

    prose = bm25(docs, T.words(query), key, tokens=T.search_terms(F.coalesce(F.col(text), F.lit(""))))
    code = bm25(docs, T.code_words(query), key, tokens=T.code_terms(F.coalesce(F.col(text), F.lit(""))))
    return prose.unionByName(code).groupBy(key).agg(F.max("score").alias("score"))


def match_all(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with every query term."""
    terms = sorted(set(query))
    return docs.where(F.size(F.array_intersect(simple_tokens(F.col(text)), F.array(*[F.lit(t) for t in terms]))) == len(terms)).select(key)


def top(scores: DataFrame, k: int, key: str = "doc_id", least: float | None = None) -> DataFrame:
    s = scores if least is None else scores.where(F.col("score") >= least)
    return s.orderBy(F.desc("score"), key).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine, dot product, or minus the Euclidean distance."""
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine":
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
    if metric == "euclid":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"unknown metric {metric!r}")


def vector_search(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding", metric: str = "cosine",
                  equal: dict | None = None, unequal: dict | None = None, least: float | None = None) -> DataFrame:
    """(key, score) of the k nearest vectors that pass the payload filters: an exact scan, filters first."""
    df = vectors
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    for c, v in (unequal or {}).items():
        df = df.where(~F.col(c).eqNullSafe(F.lit(v)))
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(df.select(key, similarity(F.col(column), q, metric).alias("score")), k, key, least)


def rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score) by reciprocal rank fusion of ranked lists (key, rank from 1)."""
    parts = [x.select(key, (F.lit(1.0) / (k + F.col("rank"))).alias("_part")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("_part").alias("score"))


def ranked(scores: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, score, rank); with a limit only that many are ranked, after a top-k of partial results."""
    s = scores if limit is None else top(scores, limit, key)
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def weighted_fusion(a: DataFrame, b: DataFrame, key: str, weight: float = 0.5) -> DataFrame:
    """(key, score): weight * a + (1 - weight) * b, each scaled to [0, 1]; equal scores all become 1."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        ends = df.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        s = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(1.0))
        return df.join(F.broadcast(ends)).select(key, s.alias(name))

    both = scaled(a, "_a").join(scaled(b, "_b"), key, "full")
    return both.select(key, (weight * F.coalesce("_a", F.lit(0.0)) + (1 - weight) * F.coalesce("_b", F.lit(0.0))).alias("score"))


def hybrid_claims(claims: DataFrame, query: list[str], vector: list[float], k: int = 10, per_index: int = 50, least: float = 0.3) -> DataFrame:
    """(claim_id, score): claims (claim_id, text, embedding) by BM25 and cosine, fused by rank."""
    text = ranked(bm25(claims, query, "claim_id"), "claim_id", per_index)
    near = ranked(vector_search(claims, vector, per_index, "claim_id", least=least), "claim_id")
    return top(rrf([text, near], "claim_id"), k, "claim_id")


def context_similarity(goals_a: Column, goals_b: Column, env_a: Column, env_b: Column) -> Column:
    """0.7 Jaccard of goals + 0.3 Jaccard of environment keys."""

    def jaccard(a: Column, b: Column) -> Column:
        either = F.size(F.array_union(a, b))
        return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))

    return 0.7 * jaccard(goals_a, goals_b) + 0.3 * jaccard(env_a, env_b)


#: Factors of memory tiers.
TIER_BOOST = {"Schema": 3.0, "Semantic": 1.5}


def retrieve_memories(memories: DataFrame, query: list[str], vector: list[float], now: int, goals: list[str] = (), pagerank: DataFrame | None = None, k: int = 10,
                      per_signal: int = 50, half_life: float = 24.0) -> DataFrame:
    """(memory_id, score): meaning, words, context, recency, graph rank and use, fused by rank and boosted by tier.

    memories: memory_id, text, embedding, goals, importance, accessed_at, access_count, tier.
    """
    key = "memory_id"
    recency = scoring.importance_decay(scoring.age_hours(F.col("accessed_at"), F.lit(now)), F.col("importance"), half_life)
    none = F.array().cast("array<string>")
    wanted = F.array(*[F.lit(g) for g in goals]) if goals else none
    lists = [
        ranked(vector_search(memories, vector, per_signal, key), key),
        ranked(bm25(memories, query, key), key, per_signal),
        ranked(memories.select(key, context_similarity(F.col("goals"), wanted, none, none).alias("score")).where("score > 0"), key, per_signal),
        ranked(memories.select(key, recency.alias("score")), key, per_signal),
        ranked(memories.select(key, F.col("access_count").cast("double").alias("score")).where("score > 0"), key, per_signal),
    ]
    if pagerank is not None:
        lists.append(ranked(pagerank, key, per_signal))
    fused = rrf(lists, key)
    boost = F.create_map(*[F.lit(x) for kv in TIER_BOOST.items() for x in kv])
    out = fused.join(memories.select(key, "tier"), key)
    return top(out.select(key, (F.col("score") * F.coalesce(F.try_element_at(boost, F.col("tier")), F.lit(1.0))).alias("score")), k, key)


def retrieve_strategies(strategies: DataFrame, query: list[str], now: int, k: int = 10, per_signal: int = 50) -> DataFrame:
    """(strategy_id, score): words, quality and recency fused by rank. strategies: strategy_id, text, quality, used_at."""
    key = "strategy_id"
    recency = scoring.temporal_decay(scoring.age_hours(F.col("used_at"), F.lit(now)), 168.0)
    lists = [
        ranked(bm25(strategies, query, key), key, per_signal),
        ranked(strategies.select(key, F.col("quality").alias("score")), key, per_signal),
        ranked(strategies.select(key, recency.alias("score")), key, per_signal),
    ]
    return top(rrf(lists, key), k, key)


def code_search(entities: DataFrame, name: str | None = None, kind: str | None = None, language: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """Code entities (name, kind, language, file) by part of the name, kind, language and a LIKE pattern of the file."""
    df = entities
    if name is not None:
        df = df.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if kind is not None:
        df = df.where(F.lower("kind") == kind.lower())
    if language is not None:
        df = df.where(F.lower("language") == language.lower())
    return df if file_pattern is None else df.where(F.col("file").like(file_pattern))


def current_results(results: DataFrame, superseded: DataFrame, at: int, key: str = "target") -> DataFrame:
    """Results valid at a time whose target no newer fact replaced (``superseded`` has ``key``)."""
    live = results.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    return live.join(superseded.select(key).distinct(), key, "left_anti")


def superseded_targets(edges: DataFrame) -> DataFrame:
    """(target): ends of structured (category:predicate) edges that are closed, or that a later edge of the same source and
    type left behind, or that depend (props depends_on) on such an end's label; those that an open, latest edge names stay.

    edges: source, target, label (of the target), assoc_type, valid_from, valid_until, props.
    """
    from pyspark.sql import Window

    e = edges.where(F.contains("assoc_type", F.lit(":")))
    latest = F.max(F.coalesce("valid_from", F.lit(0))).over(Window.partitionBy("source", "assoc_type"))
    e = e.withColumn("_old", F.col("valid_until").isNotNull() | (F.coalesce("valid_from", F.lit(0)) < latest))
    gone = e.where("_old").select("target", F.lower("label").alias("label")).distinct()
    depends = edges.where(F.col("valid_until").isNull() & F.try_element_at("props", F.lit("depends_on")).isNotNull())
    # what depends on a label names it as one of its words' runs; labels meet the words, so no pair of all is formed
    words = F.split(F.lower(F.try_element_at("props", F.lit("depends_on"))), "[^\\p{L}\\p{N}]+")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))))
    cascade = depends.select("target", F.explode(F.array_distinct(runs)).alias("label")).join(gone.select("label").distinct(), "label", "left_semi").select("target")
    current = e.where("not _old").select("target").distinct()
    return gone.select("target").unionByName(cascade).distinct().join(current, "target", "left_anti")


def valid_results(results: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """Search results (key, score) without targets of superseded facts."""
    return results.join(superseded_targets(edges).withColumnRenamed("target", key), key, "left_anti")


def anchored_results(results: DataFrame, edges: DataFrame, entity: int, key: str = "node", boost: float = 1.5, demote: float = 0.5) -> DataFrame:
    """Results weighted by an entity's current state: nodes that its open facts name are raised, those that only its
    closed facts name are lowered, others stay."""
    mine = edges.where((F.col("source") == entity) & F.contains("assoc_type", F.lit(":")))
    state = mine.groupBy(F.col("target").alias(key)).agg(F.max(F.col("valid_until").isNull()).alias("_open"))
    factor = F.when(F.col("_open"), F.lit(boost)).when(~F.col("_open"), F.lit(demote)).otherwise(F.lit(1.0))
    return results.join(state, key, "left").select(key, (F.col("score") * factor).alias("score"))


def epoch_results(results: DataFrame, edges: DataFrame, entity: int, category: str, key: str = "node") -> DataFrame:
    """Results recorded (``at``) within the entity's present epoch: since its latest open fact of a category began."""
    mine = edges.where((F.col("source") == entity) & F.startswith("assoc_type", F.lit(category + ":")) & F.col("valid_until").isNull())
    since = mine.agg(F.max("valid_from").alias("_since"))
    return results.join(F.broadcast(since)).where(F.col("_since").isNull() | (F.col("at") >= F.col("_since"))).drop("_since")  # one row
