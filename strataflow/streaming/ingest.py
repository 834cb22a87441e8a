"""Event ingest: JSON requests, of a batch or a stream, become events, facts and ledger entries.

A request is a JSON text with a ``kind``: simple, full, state_change or transaction. What a kind requires and a
request lacks makes it ``rejected``, with a reason; nothing fails the batch. All of it is map-only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUEST = (
    "kind STRING, event_id BIGINT, agent_id STRING, session_id STRING, ts BIGINT, event_type STRING, action STRING, outcome STRING, data MAP<STRING,STRING>, goals ARRAY<STRING>, "
    "env ARRAY<STRING>, chain ARRAY<BIGINT>, entity STRING, category STRING, new_state STRING, old_state STRING, payer STRING, payee STRING, amount DOUBLE, currency STRING, description STRING"
)
#: What each kind of request must carry.
REQUIRED = {"simple": ("agent_id", "action"), "full": ("event_id", "agent_id", "event_type"), "state_change": ("entity", "new_state"), "transaction": ("payer", "payee", "amount")}


def requests(raw: DataFrame, body: str = "body", received: Column | None = None) -> DataFrame:
    """Parsed requests with ``reason``, null where a request is accepted. ``received``: the time for those without one."""
    r = raw.select(F.from_json(body, REQUEST).alias("r"), (received if received is not None else F.lit(None)).cast("long").alias("_now")).select("r.*", "_now")
    r = r.withColumn("ts", F.coalesce("ts", "_now")).drop("_now")
    reason = F.when(F.col("kind").isNull() | ~F.col("kind").isin(list(REQUIRED)), F.lit("unknown kind"))
    for kind, fields in REQUIRED.items():
        for f in fields:
            reason = reason.when((F.col("kind") == kind) & F.col(f).isNull(), F.lit(f"{kind} needs {f}"))
    reason = reason.when((F.col("kind") == "transaction") & (F.col("amount") <= 0), F.lit("the amount must be positive")).when(F.col("ts").isNull(), F.lit("no time"))
    return r.withColumn("reason", reason)


def _identity(r: DataFrame) -> Column:
    """The request's event_id, else a hash of what it says, so that a repeated request is the same event."""
    said = F.xxhash64("kind", "agent_id", "ts", "event_type", "action", "entity", "category", "new_state", "payer", "payee", "amount", "description")
    return F.coalesce("event_id", said)


def events(parsed: DataFrame) -> DataFrame:
    """Accepted requests as events: event_id, agent_id, session_id, ts, event_type, outcome, goals, env, chain, data."""
    ok = parsed.where("reason is null")
    kind = F.when(F.col("kind") == "state_change", F.lit("StateChange")).when(F.col("kind") == "transaction", F.lit("Transaction")).otherwise(F.coalesce("event_type", F.lit("Action")))
    who = F.coalesce("agent_id", "entity", "payer")
    none = F.array().cast("array<string>")
    return ok.select(
        _identity(ok).alias("event_id"), who.alias("agent_id"), "session_id", "ts", kind.alias("event_type"), "outcome", F.coalesce("goals", none).alias("goals"), F.coalesce("env", none).alias("env"),
        F.coalesce("chain", F.array().cast("array<long>")).alias("chain"), F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"),
    )


def state_changes(parsed: DataFrame) -> DataFrame:
    """Facts of state changes: entity, category, target, valid_from, old_state."""
    r = parsed.where("reason is null and kind = 'state_change'")
    return r.select("entity", F.coalesce("category", F.lit("state")).alias("category"), F.col("new_state").alias("target"), F.col("ts").alias("valid_from"), "old_state")


def ledger_entries(parsed: DataFrame) -> DataFrame:
    """Both sides of transactions: key (payer and payee, in order), a, b, ts, amount, direction, description, currency."""
    r = parsed.where("reason is null and kind = 'transaction'")
    key = F.concat_ws(":", F.least("payer", "payee"), F.greatest("payer", "payee"))
    direction = F.when(F.col("payer") < F.col("payee"), "Credit").otherwise("Debit")
    return r.select(key.alias("key"), F.least("payer", "payee").alias("a"), F.greatest("payer", "payee").alias("b"), "ts", "amount", direction.alias("direction"), "description", F.coalesce("currency", F.lit("USD")).alias("currency"))


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("kind", "event_id", "reason")


def read_requests(spark, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of files with one JSON request a line, as (body)."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "body")
