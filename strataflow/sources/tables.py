"""Versioned tables as Parquet snapshots: definitions, constraints and changes.

A table is a folder of numbered parts and a small definition file that names the current ones: parts with new versions, and
parts with closings, the ends of earlier versions. A change writes its own rows only, then replaces the definition
by a rename, so readers see the old rows or the new ones; reading joins the closings, and compaction merges all parts into one.
There is one writer at a time. Paths go through Spark and Hadoop, so any store will do.

Rows have the system columns _row_id, _version_id, _group_id, _valid_from, _valid_until, _created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow import shared
from strataflow.model import SYSTEM_COLUMNS
from strataflow.operators import temporal
from strataflow.plans import ast as A

#: Names of column types.
TYPES = {
    "string": "STRING", "text": "STRING", "varchar": "STRING", "int64": "BIGINT", "int": "BIGINT", "integer": "BIGINT", "bigint": "BIGINT",
    "float64": "DOUBLE", "float": "DOUBLE", "double": "DOUBLE", "real": "DOUBLE", "bool": "BOOLEAN", "boolean": "BOOLEAN",
    "timestamp": "BIGINT", "json": "STRING", "jsonb": "STRING", "noderef": "BIGINT",
}
_SYSTEM = {c: "BIGINT" for c in SYSTEM_COLUMNS}
CLOSING = "_version_id BIGINT, _valid_until BIGINT"


class ConstraintError(ValueError):
    """A change that the table's definition forbids."""


class TableStore:
    def __init__(self, spark: SparkSession, folder: str, group_id: int = 0):
        self.spark, self.folder, self.group = spark, folder.rstrip("/"), group_id

    # ---- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{s.getPath().getName()}/definition.json")))

    def definition(self, name: str) -> dict:
        d = shared.load_json(self.spark, f"{self.folder}/{name}/definition.json")
        if d is None:
            raise KeyError(f"unknown table {name}")
        return d

    def _save(self, name: str, d: dict) -> None:
        shared.save_json(self.spark, f"{self.folder}/{name}/definition.json", d)

    def _part(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}/{number:08d}"

    def read(self, name: str) -> DataFrame:
        """All versions of the table's rows; columns added later read their default."""
        d = self.definition(name)
        ddl = {**_SYSTEM, **{c["name"]: c["type"] for c in d["columns"]}}
        schema = ", ".join(f"`{k}` {v}" for k, v in ddl.items())
        if not d["parts"]:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*(self._part(name, n) for n in d["parts"]))
        if d["closings"]:
            ends = self.spark.read.schema(CLOSING).parquet(*(self._part(name, n) for n in d["closings"]))
            ends = ends.groupBy(F.col("_version_id").alias("_v")).agg(F.min("_valid_until").alias("_end"))
            df = df.join(ends, F.col("_version_id") == F.col("_v"), "left").withColumn("_valid_until", F.coalesce("_valid_until", "_end")).drop("_v", "_end")
        late = [c for c in d["columns"] if c.get("since", 0) > 0 and c["default"] is not None]
        for c in late:
            # rows written before the column came have no value of their own
            before = F.col("_version_id") < c["since"]
            df = df.withColumn(c["name"], F.when(before & F.col(c["name"]).isNull(), F.lit(c["default"]).cast(c["type"])).otherwise(F.col(c["name"])))
        return df

    def _change(self, name: str, d: dict, rows: DataFrame | None = None, closings: DataFrame | None = None) -> None:
        """Write a change's own rows, then the definition that names them."""
        d = {**d, "parts": list(d["parts"]), "closings": list(d["closings"])}
        for df, kind in ((rows, "parts"), (closings, "closings")):
            if df is not None:
                df.write.mode("overwrite").parquet(self._part(name, d["next_part"]))
                d[kind].append(d["next_part"])
                d["next_part"] += 1
        self._save(name, d)

    def _replace(self, name: str, d: dict, rows: DataFrame) -> None:
        """One part in place of all. Those that the change before left behind are deleted; the last ones stay for their readers."""
        rows.write.mode("overwrite").parquet(self._part(name, d["next_part"]))
        self._save(name, {**d, "parts": [d["next_part"]], "closings": [], "next_part": d["next_part"] + 1, "stale": [*d["parts"], *d["closings"]]})
        for n in d["stale"]:
            fs, p = self._fs(self._part(name, n))
            fs.delete(p, True)

    # ---- statements

    def apply(self, s: A.Statement, now: int) -> int:
        match s:
            case A.CreateTable():
                return self.create(s)
            case A.DropTable(name):
                self.definition(name)
                fs, p = self._fs(f"{self.folder}/{name}")
                fs.delete(p, True)
                return 0
            case A.AlterTable(name, columns):
                return self.add_columns(name, columns)
            case A.CreateIndex():
                return self.index(s)
            case A.Insert():
                return self.insert(s, now)
            case A.Update(name, assignments, where):
                return self.update(name, dict(assignments), where, now)
            case A.Delete(name, where):
                return self.delete(name, where, now)
        raise ValueError(f"cannot run {s}")

    @staticmethod
    def _column(c: A.ColumnDef, since: int = 0) -> dict:
        if c.type.lower() not in TYPES:
            raise ConstraintError(f"unknown type {c.type}")
        default = c.default.value if isinstance(c.default, A.Literal) else c.default.id if isinstance(c.default, A.NodeRef) else None
        return {"name": c.name, "declared": c.type.lower(), "type": TYPES[c.type.lower()], "not_null": c.not_null or c.primary_key, "auto": c.autoincrement, "node": c.references_graph, "default": default, "since": since}

    def create(self, s: A.CreateTable) -> int:
        if s.name in self.names():
            raise ConstraintError(f"table {s.name} exists")
        columns = [self._column(c) for c in s.columns]
        names = [c["name"] for c in columns]
        if len(set(names)) != len(names) or set(names) & set(SYSTEM_COLUMNS):
            raise ConstraintError("column names must differ, also from the system columns")
        key = list(s.primary_key) or [c.name for c in s.columns if c.primary_key]
        uniques = ([key] if key else []) + [list(u) for u in s.uniques] + [[c.name] for c in s.columns if c.unique]
        for u in uniques:
            if set(u) - set(names):
                raise ConstraintError(f"unknown column in {u}")
        for c in columns:
            c["not_null"] |= c["name"] in key
        self._save(s.name, {"columns": columns, "key": key, "uniques": uniques, "indexes": {}, "parts": [], "closings": [], "stale": [], "next_part": 0, "next_row": 1, "next_version": 1})
        return 0

    def add_columns(self, name: str, columns: tuple[A.ColumnDef, ...]) -> int:
        d = self.definition(name)
        empty = not d["parts"]
        for c in columns:
            new = self._column(c, d["next_version"])
            if new["name"] in [x["name"] for x in d["columns"]]:
                raise ConstraintError(f"column {c.name} exists")
            if new["not_null"] and new["default"] is None and not empty:
                raise ConstraintError(f"{c.name}: NOT NULL needs a DEFAULT in a table with rows")
            d["columns"].append(new)
        self._save(name, d)
        return 0

    def index(self, s: A.CreateIndex) -> int:
        """A unique index is a constraint, checked at once and from then on; a plain one is a note only,
        as scans are pruned by the Parquet statistics."""
        d = self.definition(s.table)
        if set(s.columns) - {c["name"] for c in d["columns"]}:
            raise ConstraintError(f"unknown column in {s.columns}")
        if s.name in d["indexes"]:
            raise ConstraintError(f"index {s.name} exists")
        if s.unique:
            self._unique(temporal.row_viewport(self.read(s.table)), list(s.columns))
            d["uniques"].append(list(s.columns))
        d["indexes"][s.name] = list(s.columns)
        self._save(s.table, d)
        return 0

    @staticmethod
    def _unique(active: DataFrame, columns: list[str]) -> None:
        """Within a group; rows with a null in the columns are exempt."""
        full = active
        for c in columns:
            full = full.where(F.col(c).isNotNull())
        if not full.groupBy("_group_id", *columns).count().where("count > 1").isEmpty():
            raise ConstraintError(f"duplicate values in {', '.join(columns)}")

    @staticmethod
    def _literal(e: A.Expr, c: dict):
        """A literal in the column's type: integers and timestamps accept one another, nothing else is converted."""
        v = e.id if isinstance(e, A.NodeRef) else e.value
        if v is None:
            return None
        kind = {"STRING": str, "BIGINT": int, "DOUBLE": float, "BOOLEAN": bool}[c["type"]]
        if type(v) is not kind or isinstance(e, A.NodeRef) and c["declared"] != "noderef":
            raise ConstraintError(f"{c['name']} is {c['declared']}, not {v!r}")
        return v

    def insert(self, s: A.Insert, now: int) -> int:
        d = self.definition(s.table)
        by_name = {c["name"]: c for c in d["columns"]}
        names = list(s.columns) or list(by_name)
        if set(names) - set(by_name):
            raise ConstraintError(f"unknown columns {sorted(set(names) - set(by_name))}")
        rows = []
        for i, values in enumerate(s.rows):
            if len(values) != len(names):
                raise ConstraintError(f"{len(values)} values for {len(names)} columns")
            row_id = d["next_row"] + i
            row = {c["name"]: row_id if c["auto"] else c["default"] for c in d["columns"]}
            row |= {n: self._literal(v, by_name[n]) for n, v in zip(names, values)}
            rows.append((row_id, d["next_version"] + i, self.group, now, None, now, *(row[c["name"]] for c in d["columns"])))
        schema = ", ".join(f"`{k}` {v}" for k, v in {**_SYSTEM, **{c["name"]: c["type"] for c in d["columns"]}}.items())
        return self.append(s.table, self.spark.createDataFrame(rows, schema), d)

    def append(self, name: str, rows: DataFrame, d: dict | None = None) -> int:
        """Add versions that carry their system columns; constraints are checked first."""
        d = d or self.definition(name)
        n = self._check(name, d, rows)
        ends = rows.agg(F.max("_row_id"), F.max("_version_id")).first()
        d["next_row"], d["next_version"] = max(d["next_row"], (ends[0] or 0) + 1), max(d["next_version"], (ends[1] or 0) + 1)
        self._change(name, d, rows)
        return n

    def load(self, name: str, df: DataFrame, now: int) -> int:
        """Append the rows of a DataFrame with the table's column names; ids are dealt by a sorted window-free scheme
        of partition offsets, so no task sees all rows."""
        d = self.definition(name)
        pieces = df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
        offset, at = {}, 0
        for r in pieces.groupBy("_p").count().orderBy("_p").collect():  # a row a partition
            offset[r["_p"]], at = at, at + r["count"]
        if not offset:
            return 0
        table = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])
        number = table[F.col("_p")] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
        columns = []
        for c in d["columns"]:
            value = F.col(c["name"]).cast(c["type"]) if c["name"] in df.columns else (number + d["next_row"]) if c["auto"] else F.lit(c["default"]).cast(c["type"])
            columns.append(value.alias(c["name"]))
        rows = pieces.select(
            (number + d["next_row"]).cast("long").alias("_row_id"), (number + d["next_version"]).cast("long").alias("_version_id"), F.lit(self.group).cast("long").alias("_group_id"),
            F.lit(now).cast("long").alias("_valid_from"), F.lit(None).cast("long").alias("_valid_until"), F.lit(now).cast("long").alias("_created_at"), *columns,
        )
        return self.append(name, rows, d)

    def _check(self, name: str, d: dict, rows: DataFrame) -> int:
        required = [c["name"] for c in d["columns"] if c["not_null"]]
        counts = rows.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in required)).first()
        for c in required:
            if counts[c] < counts["_n"]:
                raise ConstraintError(f"{c} must not be null")
        active = temporal.row_viewport(self.read(name)).unionByName(temporal.row_viewport(rows))
        for u in d["uniques"]:
            self._unique(active, u)
        return counts["_n"]

    def _condition(self, df: DataFrame, name: str, where: A.Bool) -> Column:
        from strataflow.plans.compiler import Compiler, Expressions, Scope, Semantics

        alias = df.select(*(F.col(c).alias(f"{name}.{c}") for c in df.columns))
        return Expressions(Compiler(self.spark), alias, Scope(tables={name: df}), Semantics("ansi")).condition(where)

    def _split(self, name: str, where: A.Bool) -> tuple[DataFrame, Column]:
        """All versions, with dotted names, and which of them a change concerns."""
        df = self.read(name)
        dotted = df.select(*(F.col(c).alias(f"{name}.{c}") for c in df.columns))
        hit = F.coalesce(self._condition(df, name, where), F.lit(False)) & F.col(f"`{name}._valid_until`").isNull() & (F.col(f"`{name}._group_id`") == self.group)
        return dotted, hit

    def _plain(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(c.removeprefix(f"{name}.")) for c in df.columns))

    def update(self, name: str, assignments: dict[str, A.Expr], where: A.Bool, now: int) -> int:
        """Close the rows' versions and open new ones; returns how many."""
        d = self.definition(name)
        by_name = {c["name"]: c for c in d["columns"]}
        if set(assignments) - set(by_name):
            raise ConstraintError(f"unknown columns {sorted(set(assignments) - set(by_name))}")
        if not all(isinstance(v, (A.Literal, A.NodeRef)) for v in assignments.values()):
            raise ConstraintError("SET takes literals")
        dotted, hit = self._split(name, where)
        old = self._plain(dotted.where(hit), name)
        # a row has one open version, so its number makes the new version's: no order over all rows is needed
        new = old.withColumn("_version_id", (F.col("_row_id") + d["next_version"]).cast("long"))
        new = new.withColumn("_valid_from", F.lit(now).cast("long")).withColumn("_created_at", F.lit(now).cast("long"))
        for n, v in assignments.items():
            new = new.withColumn(n, F.lit(self._literal(v, by_name[n])).cast(by_name[n]["type"]))
        for c in (c["name"] for c in d["columns"] if c["not_null"]):
            if not new.where(F.col(c).isNull()).isEmpty():
                raise ConstraintError(f"{c} must not be null")
        if set(assignments) & {c for u in d["uniques"] for c in u}:
            others = temporal.row_viewport(self._plain(dotted.where(~hit), name))
            for u in d["uniques"]:
                self._unique(others.unionByName(temporal.row_viewport(new)), u)
        n = new.count()
        if n:
            d["next_version"] += d["next_row"]
            self._change(name, d, new, self._closings(old, now))
        return n

    @staticmethod
    def _closings(old: DataFrame, now: int) -> DataFrame:
        return old.select("_version_id", F.lit(now).cast("long").alias("_valid_until"))

    def delete(self, name: str, where: A.Bool, now: int) -> int:
        """Close the rows' versions; returns how many."""
        d = self.definition(name)
        dotted, hit = self._split(name, where)
        old = self._plain(dotted.where(hit), name)
        n = old.count()
        if n:
            self._change(name, d, closings=self._closings(old, now))
        return n

    # ---- maintenance

    def compact(self, name: str, now: int, keep: int = temporal.WEEK) -> None:
        """Merge all parts, without versions that ended longer ago than ``keep``."""
        d = self.definition(name)
        self._replace(name, d, temporal.compact(self.read(name), now, keep))

    def merge_nodes(self, name: str, mapping: DataFrame) -> None:
        """Point node references at survivors: ``mapping`` has columns absorbed, survivor."""
        d = self.definition(name)
        rows = self.read(name)
        for c in (c["name"] for c in d["columns"] if c["node"] or c["declared"] == "noderef"):
            m = mapping.select(F.col("absorbed").alias("_a"), F.col("survivor").alias("_s"))
            rows = rows.join(m, F.col(c) == F.col("_a"), "left").withColumn(c, F.coalesce("_s", c)).drop("_a", "_s")
        self._replace(name, d, rows)

    def stats(self, name: str) -> DataFrame:
        """Per group: versions, active rows, and distinct values of each indexed column."""
        d = self.definition(name)
        indexed = sorted({c for u in [*d["uniques"], *d["indexes"].values()] for c in u})
        return self.read(name).groupBy("_group_id").agg(
            F.count("*").alias("versions"), F.sum(F.when(F.col("_valid_until").isNull(), 1).otherwise(0)).alias("active"), *(F.count_distinct(c).alias(f"distinct_{c}") for c in indexed)
        )

    def scan(self, name: str, when: str = "active", as_of: int | None = None, offset: int = 0, limit: int = 1000) -> DataFrame:
        """A page of rows in order of row and version."""
        kind = "point" if as_of is not None else when
        return temporal.row_viewport(self.read(name), kind, as_of).orderBy("_row_id", "_version_id").offset(offset).limit(min(limit, 10_000))

    def by_node(self, name: str, column: str, node: int) -> DataFrame:
        return temporal.row_viewport(self.read(name)).where(F.col(column) == node)
