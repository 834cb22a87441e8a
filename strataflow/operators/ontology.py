"""Ontologies and the behaviour of predicates.

Properties are a small table: property, parent, inverse, symmetric, transitive, functional, domain, range,
append_only, cascade. Classes: class, parent. Both come from Turtle files or from inference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.scoring import observation_confidence

PROPERTIES = "property string, parent string, inverse string, symmetric boolean, transitive boolean, functional boolean, domain string, range string, append_only boolean, cascade boolean, max_cardinality int"
CLASSES = "class string, parent string"


def ancestors(table: DataFrame, child: str, high: int = 10) -> DataFrame:
    """(child, ancestor, depth) of a parent table, each with itself at depth 0; a cycle ends the climb."""
    links = table.where("parent is not null").select(F.col(child).alias("_c"), F.col("parent").alias("_p")).distinct()
    level = table.select(F.col(child).alias("child"), F.col(child).alias("ancestor")).distinct().withColumn("depth", F.lit(0))
    found = level
    for depth in range(1, high + 1):
        level = level.join(links, F.col("ancestor") == F.col("_c")).select("child", F.col("_p").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        found = found.unionByName(level)
    return found.groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


def expand_property(properties: DataFrame, name: str) -> DataFrame:
    """The property and all its sub-properties."""
    return ancestors(properties, "property").where(F.col("ancestor") == name).select(F.col("child").alias("property"))


def is_a(classes: DataFrame, sub: str, above: str) -> DataFrame:
    """One row ``holds``."""
    return ancestors(classes, "class").where((F.col("child") == sub) & (F.col("ancestor") == above)).agg((F.count("*") > 0).alias("holds"))


def violations(facts: DataFrame, properties: DataFrame, classes: DataFrame) -> DataFrame:
    """Facts (subject, predicate, object, subject_class, object_class) with ``problem``: a domain or range that
    their classes do not meet, or more objects than the property admits."""
    up = ancestors(classes, "class")
    p = properties.select(F.col("property").alias("predicate"), "domain", "range", "max_cardinality")
    f = facts.join(F.broadcast(p), "predicate")  # an ontology is small and fixed by its files
    sub, obj = (up.select(F.col("child").alias(f"_{n}"), F.col("ancestor").alias(f"_{n}a")) for n in ("s", "o"))
    bad_domain = f.where("domain is not null").join(sub, (F.col("subject_class") == F.col("_s")) & (F.col("domain") == F.col("_sa")), "left_anti").withColumn("problem", F.lit("domain"))
    bad_range = f.where("range is not null").join(obj, (F.col("object_class") == F.col("_o")) & (F.col("range") == F.col("_oa")), "left_anti").withColumn("problem", F.lit("range"))
    many = f.where("max_cardinality is not null").withColumn("_n", F.size(F.collect_set("object").over(Window.partitionBy("subject", "predicate"))))
    too_many = many.where(F.col("_n") > F.col("max_cardinality")).drop("_n").withColumn("problem", F.lit("cardinality"))
    return bad_domain.unionByName(bad_range).unionByName(too_many).drop("domain", "range", "max_cardinality")


def complete(facts: DataFrame, properties: DataFrame, rounds: int = 3) -> DataFrame:
    """Facts (subject, predicate, object) with what symmetric, inverse, sub-property and transitive properties imply."""
    p = F.broadcast(properties.select(F.col("property").alias("predicate"), "inverse", "symmetric", "transitive", "parent"))
    found = facts.select("subject", "predicate", "object").distinct()
    for _ in range(rounds):
        f = found.join(p, "predicate", "left")
        turned = f.where("symmetric").select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"))
        inverse = f.where("inverse is not null").select(F.col("object").alias("subject"), F.col("inverse").alias("predicate"), F.col("subject").alias("object"))
        above = f.where("parent is not null").select("subject", F.col("parent").alias("predicate"), "object")
        chain = f.where("transitive").select("subject", "predicate", "object")
        follow = chain.select(F.col("subject").alias("object"), "predicate", F.col("object").alias("_far"))
        longer = chain.join(follow, ["object", "predicate"]).select("subject", "predicate", F.col("_far").alias("object"))
        found = found.unionByName(turned).unionByName(inverse).unionByName(above).unionByName(longer).distinct()
    return found


def predicate_stats(edges: DataFrame) -> DataFrame:
    """Per predicate (the part of assoc_type after the colon): observations, reverse pairs, distinct and
    single-valued subjects, superseded facts, and distinct objects."""
    e = edges.where("assoc_type is not null").select(F.coalesce(F.split("assoc_type", ":")[1], F.col("assoc_type")).alias("predicate"), "source", "target", "valid_until")
    pairs = e.select("predicate", "source", "target").distinct()
    back = pairs.select("predicate", F.col("target").alias("source"), F.col("source").alias("target"))
    mutual = pairs.join(back, ["predicate", "source", "target"], "left_semi").where("source <> target").groupBy("predicate").agg(F.count("*").alias("reverse_pairs"))
    per_subject = pairs.groupBy("predicate", "source").agg(F.count("*").alias("_k"))
    subjects = per_subject.groupBy("predicate").agg(F.count("*").alias("subjects"), F.sum(F.when(F.col("_k") == 1, 1).otherwise(0)).alias("single_valued"))
    objects = pairs.select("predicate", "target").distinct().groupBy("predicate").agg(F.count("*").alias("objects"))
    totals = e.groupBy("predicate").agg(F.count("*").alias("observations"), F.sum(F.when(F.col("valid_until").isNotNull(), 1).otherwise(0)).alias("superseded"))
    distinct = pairs.groupBy("predicate").agg(F.count("*").alias("pairs"))
    out = totals.join(subjects, "predicate").join(objects, "predicate").join(distinct, "predicate").join(mutual, "predicate", "left")
    return out.withColumn("reverse_pairs", F.coalesce("reverse_pairs", F.lit(0)))


def top_classes(edges: DataFrame, nodes: DataFrame, end: str = "source", k: int = 5) -> DataFrame:
    """(predicate, class, n): the k most frequent concept types at one end of each predicate's edges."""
    kinds = nodes.select(F.col("id").alias("_id"), F.coalesce("concept_type", "node_type").alias("class"))
    e = edges.select(F.coalesce(F.split("assoc_type", ":")[1], F.col("assoc_type")).alias("predicate"), F.col(end).alias("_id"))
    counts = e.join(kinds, "_id").groupBy("predicate", "class").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("predicate").orderBy(F.desc("n"), "class"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


#: Shares from which a behaviour is inferred, and the least numbers of observations and subjects.
SYMMETRIC, FUNCTIONAL, SUPERSEDES, LEAST_OBSERVATIONS, LEAST_SUBJECTS = 0.85, 0.90, 0.70, 5, 3


def infer_behaviour(stats: DataFrame) -> DataFrame:
    """predicate, symmetric, functional, superseding, append_only and confidence, from predicate_stats()."""
    s = stats.where(F.col("observations") >= LEAST_OBSERVATIONS)
    functional = (F.col("subjects") >= LEAST_SUBJECTS) & (F.col("single_valued") / F.col("subjects") >= FUNCTIONAL)
    return s.select(
        "predicate", (F.col("reverse_pairs") / F.col("pairs") >= SYMMETRIC).alias("symmetric"), functional.alias("functional"),
        (F.col("superseded") / F.col("observations") >= SUPERSEDES).alias("superseding"), (F.col("superseded") == 0).alias("append_only"),
        observation_confidence(F.col("observations")).alias("confidence"),
    )
