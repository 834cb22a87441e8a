r"""Secret scans by rules and by a battery of randomness tests [native].

Rules give the base spans (assign, access, hex). The battery adds spans of kind ``random``: tokens
``[A-Za-z0-9+/_=-]{24,}`` whose characters pass for draws from their inferred alphabet.

Battery. The encoding is inferred from the characters (hex, base32, alphanumeric, base64); a token
without a digit, or of one letter or digit only, is no candidate. Codes are positions in the
alphabet. Three tests of uniform draws give p-values: chi-squared of the character counts
(Wilson-Hilferty), runs above and below the alphabet's middle, and lag-1 serial correlation. The
combined p-value is three times the least (Bonferroni), 1 at most.

False-discovery control. Random strings are the null; a rejection says "ordinary text". In each
stratum (encoding, power-of-two length band) Benjamini-Hochberg at level ``q`` rejects, so at most a
share q of the dismissed tokens is expected to be random; what is not rejected becomes a span.
Strata keep short tokens, with little power, from borrowing the long ones' evidence, and
MIN_LENGTH drops lengths at which the battery has none. P-values are counted on a fixed logarithmic
grid, so the control needs one row per (stratum, grid cell), a bounded table, and no sort of all tokens.

A null text counts as empty and has no spans. Positions are code points, ends exclusive. Ties in
the order of spans go by the kinds' order, then by the end. Repeated rows and extra columns pass
through; helper columns begin with ``_sf_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm import scratch

# Fixed values of the base rules. Letters of the first are spelled in both cases, as ASCII only.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})$"
# Greedy runs shorter than the floor can hold no longer match, so the floor may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 24
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
ALPHABETS = {
    "hexl": "0123456789abcdef",
    "hexu": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-",
}
GRID = 64  # cells per factor of e; p below e**-40 falls into the last
LAST_CELL = 40 * GRID


def _let(value: Column, use) -> Column:
    """Name a value, so that it is evaluated once."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<kind, start, end, value>> of leftmost non-overlapping matches that ``keep`` admits.

    The gaps between matches come from split, the matches from regexp_extract_all; running lengths
    of both give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

    def add(s: Column, pair: Column) -> Column:
        start = s["at"] + pair["g"]
        end = start + F.char_length(pair["m"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["m"].alias("value")))
        kept = one if keep is None else F.when(keep(pair["m"]), one).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))
        return F.struct(end.alias("at"), F.concat(s["out"], kept).alias("out"))

    def build(f: Column) -> Column:
        pairs = F.zip_with(f, F.slice(gaps, F.lit(1), F.size(f)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.aggregate(pairs, zero, add, lambda s: s["out"])

    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), _let(found, build)).otherwise(empty)


def normal_tail(z: Column) -> Column:
    """P(|Z| > z) by a rational approximation with an error below 2e-7."""

    def tail(x: Column, t: Column) -> Column:
        poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), poly * F.exp(-x * x)))

    return _let(F.abs(z) / F.lit(2.0**0.5), lambda x: _let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x), lambda t: tail(x, t)))


def _encoding(body: Column) -> Column:
    """Name of the alphabet; null when the token is no candidate."""
    return (
        F.when(~body.rlike("[0-9]") | ~body.rlike("[A-Za-z]"), F.lit(None).cast("string"))
        .when(body.rlike("^[0-9a-f]+$"), "hexl")
        .when(body.rlike("^[0-9A-F]+$"), "hexu")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def _p_value(codes: Column, k: Column) -> Column:
    """Combined p-value of the three tests, for an array of codes from 0 to k - 1.

    Values that a formula uses twice are named, else the plan holds, and computes, a copy for each use.
    """
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))

    def chi_squared(n: Column, k: Column) -> Column:
        counts = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda x: x == c)).cast("double"))
        chi = total(counts, lambda c: c * c) * k / n - n
        v = F.lit(2.0) / (F.lit(9.0) * (k - 1))
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1.0 / 3)) - (1 - v)) / F.sqrt(v)
        return _let(z_chi, lambda z: _let(normal_tail(z) / 2, lambda half: F.when(z > 0, half).otherwise(1 - half)))

    def runs_test(n: Column, k: Column, pairs: Column) -> Column:
        runs = 1 + total(pairs, lambda x: F.when((x["a"] * 2 >= k) == (x["b"] * 2 >= k), 0.0).otherwise(1.0))
        spread = lambda expected: (expected - 1) * (expected - 2) / (n - 1)
        p = lambda expected: _let(spread(expected), lambda s: F.when(s > 0, normal_tail((runs - expected) / F.sqrt(s))).otherwise(F.lit(0.0)))
        return _let(total(codes, lambda c: F.when(c * 2 >= k, 1.0).otherwise(0.0)), lambda above: _let(2 * above * (n - above) / n + 1, p))

    def serial_test(n: Column, k: Column, pairs: Column) -> Column:
        mean = (k - 1) / 2
        variance = (k * k - 1) / 12
        return normal_tail(total(pairs, lambda x: (x["a"] - mean) * (x["b"] - mean)) / (variance * F.sqrt(n - 1)))

    def combined(n: Column, k: Column) -> Column:
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        least = _let(pairs, lambda both: F.least(chi_squared(n, k), runs_test(n, k, both), serial_test(n, k, both)))
        return F.least(F.lit(1.0), F.lit(3.0) * least)

    return _let(F.size(codes).cast("double"), lambda n: _let(k, lambda k: combined(n, k)))


def randomness(value: Column) -> Column:
    """struct<encoding, band, cell> of a token: alphabet, length band, grid cell of the p-value."""

    def inferred(body: Column) -> Column:
        def named(encoding: Column) -> Column:
            letters = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), F.coalesce(encoding, F.lit("base64")))
            at = F.filter(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(letters, c) - 1), lambda x: x >= 0)

            def tested(codes: Column) -> Column:
                p = F.when(encoding.isNotNull() & (F.size(codes) >= MIN_LENGTH), _p_value(codes, F.char_length(letters).cast("double")))
                cell = F.least(F.lit(LAST_CELL), F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * GRID)).cast("int")
                return F.struct(encoding.alias("encoding"), F.floor(F.log2(F.size(codes).cast("double") + 0.5)).cast("int").alias("band"), cell.alias("cell"))

            return _let(at, tested)

        return _let(_encoding(body), named)

    return _let(F.regexp_replace(value, "=+$", ""), inferred)


def rejected_from(tested: DataFrame, q: float) -> DataFrame:
    """encoding, band, _sf_from: from that grid cell on (smaller p-values), Benjamini-Hochberg rejects."""
    cells = tested.groupBy("encoding", "band", "cell").count()
    strata = Window.partitionBy("encoding", "band")
    smaller = strata.orderBy(F.col("cell").desc())
    ranked = cells.withColumn("rank", F.sum("count").over(smaller)).withColumn("m", F.sum("count").over(strata))
    largest_p = F.exp(-F.col("cell") / F.lit(float(GRID)))
    return ranked.where(largest_p <= F.lit(q) * F.col("rank") / F.col("m")).groupBy("encoding", "band").agg(F.min("cell").alias("_sf_from"))


def _plain(a: Column) -> Column:
    return F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _base(text: Column) -> Column:
    return F.concat(
        _plain(spans(text, ASSIGN, "assign", lambda m: m.rlike(ASSIGN_VALUE))),
        _plain(spans(text, ACCESS, "access")),
        _plain(spans(text, HEX, "hex")),
    )


def _candidates(text: Column) -> Column:
    """Spans that the battery can judge, with their tests."""
    tested = F.transform(
        spans(text, TOKEN, "random"),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), randomness(s["value"]).alias("test")),
    )
    return F.filter(tested, lambda c: c["test"]["cell"].isNotNull())


def _limits(candidates: DataFrame, q: float) -> DataFrame:
    """One row: _sf_limits, a map with an entry per stratum, at most 5 alphabets x 31 length bands."""
    tested = candidates.select(F.explode("candidates.test").alias("t")).select("t.encoding", "t.band", "t.cell")
    entry = F.struct(F.concat_ws(":", "encoding", "band"), "_sf_from")
    return rejected_from(tested, q).agg(F.map_from_entries(F.collect_list(entry)).alias("_sf_limits")).withColumn("_sf_one", F.lit(1))


def _judged(base: Column, candidates: Column) -> Column:
    """Base spans and those candidates that the control leaves, in order."""
    limit = lambda c: F.col("_sf_limits")[F.concat_ws(":", c["test"]["encoding"], c["test"]["band"])]
    stays = lambda c: c["test"]["cell"] < F.coalesce(limit(c), F.lit(LAST_CELL + 1))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    found = F.concat(base, _plain(F.filter(candidates, stays)))
    in_order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return _plain(in_order)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", q: float = 0.05) -> DataFrame:
    """id and ``secrets`` array<struct<kind, start, end>>, one row per row of ``docs``.

    The scan's spans, without the texts, are written once; the control and the result read them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    scanned = scratch.cut(docs.select(F.col(id_col), _base(t).alias("base"), _candidates(t).alias("candidates"), F.lit(1).alias("_sf_one")), "secrets", files=scratch.tasks(docs))
    joined = scanned.join(F.broadcast(_limits(scanned, q)), "_sf_one")
    return joined.select(id_col, _judged(F.col("base"), F.col("candidates")).alias("secrets"))


def notation(secrets: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(F.lit(0), x["start"] - s["at"]))
        fresh = (x["start"] >= s["at"]) & ((x["start"] > s["at"]) | (s["out"] == "") | ~F.endswith(s["out"], F.lit(mark)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(secrets, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(secrets) > 0, done).otherwise(text)


def redact_documents(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; columns, order of columns and row count stay.

    The control needs the tests' counts only, so the texts are read twice and never shuffled.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    limits = _limits(docs.select(_candidates(t).alias("candidates")), q)
    out = docs.withColumn("_sf_one", F.lit(1)).join(F.broadcast(limits), "_sf_one").withColumn("_sf_spans", _judged(_base(t), _candidates(t)))
    found = F.size("_sf_spans") > 0
    out = out.withColumn("text", redact(F.col("text"), F.col("_sf_spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
