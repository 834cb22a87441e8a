"""Reading files into tables and graphs, and writing them out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow import shared
from strataflow.model import Graph
from strataflow.sources.tables import TYPES


def parse_cell(c: Column, kind: str) -> Column:
    """A text cell in a column type: empty or "null" is null, and so is what does not parse."""
    text = F.trim(c)
    text = F.when((text == "") | (F.lower(text) == "null"), F.lit(None)).otherwise(text)
    sql = TYPES[kind.lower()]
    if sql == "BOOLEAN":
        return F.when(F.lower(text).isin("true", "1", "yes"), True).when(F.lower(text).isin("false", "0", "no"), False)
    return text if sql == "STRING" else text.try_cast(sql)


def _typed(df: DataFrame, columns: dict[str, str], mapping: dict[str, str], skip_errors: bool) -> DataFrame:
    source = {c: mapping.get(c, c) for c in columns}
    missing = set(source.values()) - set(df.columns)
    if missing:
        raise ValueError(f"no such fields: {sorted(missing)}")
    out = df.select(*(parse_cell(F.col(f"`{source[c]}`"), k).alias(c) for c, k in columns.items()), *(F.col(f"`{source[c]}`").alias(f"_raw_{c}") for c in columns))
    bad = F.lit(False)
    for c in columns:
        raw = F.trim(F.col(f"_raw_{c}"))
        bad = bad | (F.col(c).isNull() & raw.isNotNull() & (raw != "") & (F.lower(raw) != "null"))
    if skip_errors:
        out = out.where(~bad)
    else:
        out = out.where(F.when(bad, F.raise_error(F.lit("a cell does not parse in its column's type")).cast("boolean")).otherwise(F.lit(True)))
    return out.select(*columns)


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], mapping: dict[str, str] | None = None, skip_errors: bool = True, delimiter: str = ",") -> DataFrame:
    """CSV with a header; ``mapping`` names the header of a column. Rows that do not parse are skipped or fail the job."""
    df = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return _typed(df, columns, mapping or {}, skip_errors)


def _json_fields(columns: dict[str, str], mapping: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(mapping.get(c, c), T.StringType()) for c in columns])


def read_ndjson(spark: SparkSession, path: str, columns: dict[str, str], mapping: dict[str, str] | None = None, skip_errors: bool = True) -> DataFrame:
    """One JSON object a line; blank and, with ``skip_errors``, broken lines are skipped."""
    mode = "DROPMALFORMED" if skip_errors else "FAILFAST"
    df = spark.read.schema(_json_fields(columns, mapping or {})).option("mode", mode).option("primitivesAsString", True).json(path)
    return _typed(df, columns, mapping or {}, skip_errors)


def read_json_array(spark: SparkSession, path: str, columns: dict[str, str], mapping: dict[str, str] | None = None, skip_errors: bool = True) -> DataFrame:
    """Files that each hold one array of objects."""
    df = spark.read.schema(_json_fields(columns, mapping or {})).option("multiLine", True).json(path)
    return _typed(df, columns, mapping or {}, skip_errors)


def import_graph(nodes: DataFrame, edges: DataFrame, now: int) -> Graph:
    """A graph from names. nodes: name, type, props; edges: source, target (names), kind, assoc_type, weight,
    confidence, valid_from, valid_until, props. Nodes of one name (in any case) are one; ends without a node become Concepts.

    Ids are hashes of the lower-case names, so that imports agree without a shared counter.
    """
    named = nodes.select(F.lower(F.trim("name")).alias("_key"), "name", F.coalesce("type", F.lit("Concept")).alias("type"), "props")
    ends = edges.select(F.col("source").alias("name")).unionByName(edges.select(F.col("target").alias("name")))
    ends = ends.select(F.lower(F.trim("name")).alias("_key"), "name", F.lit(None).cast("string").alias("type"), F.lit(None).cast("map<string,string>").alias("props"))
    first = F.min(F.struct(F.col("type").isNull().alias("implied"), "name", "type")).alias("_m")
    merged = named.unionByName(ends).groupBy("_key").agg(first, F.max_by("props", F.size("props")).alias("props"))
    identity = lambda c: F.xxhash64(F.lower(F.trim(c)))
    out_nodes = merged.select(
        F.xxhash64("_key").alias("id"), F.lit("Concept").alias("node_type"), F.coalesce("_m.type", F.lit("Concept")).alias("concept_type"), F.col("_m.name").alias("label"),
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(1.0).alias("confidence"), "props",
    )
    out_edges = edges.select(
        F.xxhash64("source", "target", "kind", "assoc_type", "valid_from").alias("id"), identity("source").alias("source"), identity("target").alias("target"),
        F.coalesce("kind", F.lit("Association")).alias("edge_kind"), "assoc_type", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("weight", F.lit(1.0)).alias("cost_signal"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), "valid_from", "valid_until", F.lit(True).alias("is_valid"),
        F.lit(1).alias("observation_count"), "props",
    )
    return Graph.of(out_nodes, out_edges)


def export_graph(graph: Graph, folder: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("edge_kind").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str) -> Graph:
    return Graph.of(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


class VectorStore:
    """Vectors with payload columns in Parquet snapshots: upsert, fetch, delete, search and count."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._path: str | None = None

    def read(self) -> DataFrame:
        if self._path is None:
            raise ValueError("the store is empty")
        return self.spark.read.parquet(self._path)

    def _replace(self, df: DataFrame) -> None:
        import uuid

        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        old, self._path = self._path, path
        if old:
            shared.remove(self.spark, old)

    def upsert(self, vectors: DataFrame) -> None:
        self._replace(vectors if self._path is None else self.read().join(vectors.select(self.key), self.key, "left_anti").unionByName(vectors))

    def delete(self, ids: DataFrame) -> None:
        self._replace(self.read().join(ids.select(self.key), self.key, "left_anti"))

    def fetch(self, ids: list) -> DataFrame:
        return self.read().where(F.col(self.key).isin(ids))

    def search(self, query: list[float], k: int, **options) -> DataFrame:
        from strataflow.operators.search import vector_search

        return vector_search(self.read(), query, k, self.key, **options)

    def count(self) -> int:
        return self.read().count()


# ---- Turtle

_TURTLE = re.compile(r'@prefix|@base|a(?=\s)|<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|[\w-]*:[\w.-]*\w|[\w-]+:|\d+|true|false|[.;,\[\]]')
#: Terms of the ontology vocabularies that are read.
TERMS = {
    "subPropertyOf": "parent", "inverseOf": "inverse", "domain": "domain", "range": "range", "maxCardinality": "max_cardinality", "cascade": "cascade", "cascadeDependents": "cascade",
    "appendOnly": "append_only",
}
CHARACTERISTICS = {"SymmetricProperty": "symmetric", "TransitiveProperty": "transitive", "FunctionalProperty": "functional"}


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of local names of a Turtle subset: prefixes, ';' and ',' lists, 'a', literals; no blank nodes."""
    text = re.sub(r"(?m)^\s*#.*$|\s#\s.*$", "", text)
    local = lambda t: re.sub(r'^"(.*?)"(?:@.*|\^\^.*)?$', r"\1", t, flags=re.S) if t.startswith('"') else re.split(r"[#/:]", t.strip("<>"))[-1]
    out, tokens, i = [], _TURTLE.findall(text), 0
    while i < len(tokens):
        if tokens[i] in ("@prefix", "@base"):
            while i < len(tokens) and tokens[i] != ".":
                i += 1
            i += 1
            continue
        subject, i = local(tokens[i]), i + 1
        while i < len(tokens) and tokens[i] != ".":
            if tokens[i] == ";":
                i += 1
                continue
            predicate, i = "type" if tokens[i] == "a" else local(tokens[i]), i + 1
            while i < len(tokens) and tokens[i] not in (";", "."):
                if tokens[i] != ",":
                    out.append((subject, predicate, local(tokens[i])))
                i += 1
        i += 1
    return out


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(properties, classes) of Turtle files; files of an ontology are few and small."""
    from strataflow.operators.ontology import CLASSES, PROPERTIES

    fields = [f.name for f in T.StructType.fromDDL(PROPERTIES)]
    properties: dict[str, dict] = {}
    classes: dict[str, set] = {}
    for r in spark.read.text(path, wholetext=True).collect():
        for s, p, o in parse_turtle(r[0]):
            if p == "type" and (o.endswith("Property") or o in CHARACTERISTICS):
                properties.setdefault(s, {})
                if o in CHARACTERISTICS:
                    properties[s][CHARACTERISTICS[o]] = True
            elif p == "type" and o == "Class":
                classes.setdefault(s, set())
            elif p == "subClassOf":
                classes.setdefault(s, set()).add(o)
            elif p in TERMS:
                v = (o == "true") if TERMS[p] in ("cascade", "append_only") else int(o) if TERMS[p] == "max_cardinality" else o
                properties.setdefault(s, {})[TERMS[p]] = v
    flags = ("symmetric", "transitive", "functional", "append_only", "cascade")
    rows = [tuple(name if f == "property" else d.get(f, False if f in flags else None) for f in fields) for name, d in sorted(properties.items())]
    links = [(c, p) for c, above in sorted(classes.items()) for p in (sorted(above) or [None])]
    return spark.createDataFrame(rows, PROPERTIES), spark.createDataFrame(links, CLASSES)
