"""Secrets in texts: certain findings by pattern, and weak parts that only count beside their complement.

Three kinds are certain: `assign` (a named value), `access` (an access key id) and
`hex` (a long hexadecimal run). Four kinds are weak: `id` (a named account or
client), `secret` (a named value too short or too unusual for `assign`), `token` (a
bare mixed run of letters and digits) and `endpoint` (an address). A weak part is
reported only where the other part of a credential stands within `REACH` code
points of it in the same scope, a block of lines between blank lines:

    an access id or `id`   with   a secret of any kind (`assign`, `hex`, `secret`, `token`)
    an `endpoint`          with   a named secret (`assign`, `secret`)

and only if it does not overlap a certain finding of another kind (an endpoint may).

Texts are searched inside their row. Only texts that hold both sides of a link go
on: their parts and scopes are rows, and parts meet their scope, then each other, by
interval joins over bins of `BIN` code points. Texts are named by 128 bits, and
copies of a text go on once; no key has more rows than a bin has room for parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_folder

#: Code points between two parts of one credential, and the width of a bin.
REACH, BIN = 200, 256
#: Copies of the findings of a text, for the rows of a text that fills a third of the table.
SALTS = 16

# What the certain findings are.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: A named value of any visible characters but quotes, commas, semicolons and angle brackets.
_VALUE = r"""["']?\x20*[:=]\x20*["']?([^\x00-\x20"',;<>\x7F]+)"""
ID = r"(?i)(?:access_?key_?id|key_?id|client_?id|account|user_?name|user|login)" + _VALUE
SECRET = r"(?i)(?:pwd|passphrase|password|passwd|pass|secret_?(?:access_?)?key|private_?key|credential|secret|token|api_?key)" + _VALUE
TOKEN = r"[A-Za-z0-9+/]{20,}"
ENDPOINT = r"""(?i)(?:(?:https?|s?ftp|ssh|s3|jdbc|mysql|postgres(?:ql)?|mongodb|redis|amqps?)://|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)[^\x00-\x20"',;<>\x7F]+"""
BREAK = r"\n[\x20\x09\x0D]*\n"

#: Kinds in the order that equal starts take.
KINDS = ["assign", "access", "hex", "id", "secret", "token", "endpoint"]
CERTAIN = KINDS[:3]
PART = "kind:int,start:int,end:int"
NONE = f"array<struct<{PART}>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(lengths: Column, block: int = 64) -> Column:
    """For each element of an array of lengths, the sum of those before it, without a pass per element."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def each(s: Column) -> Column:
        return F.transform(
            s["of"],
            lambda _, i: F.get(s["base"], F.floor(i / block).cast("int"))
            + total(F.slice(s["of"], (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))),
        )

    def bases(s: Column) -> Column:
        ends = F.aggregate(
            F.sequence(F.lit(0), F.floor(F.size(s) / block).cast("int")),
            F.array(F.lit(0)),
            lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(s, b * block + 1, F.lit(block))))),
        )
        return F.struct(s.alias("of"), ends.alias("base"))

    return let(let(lengths, bases), each)


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches of `pattern` whose text `keep` accepts, as an array of (kind, start, end) in code points."""

    def placed(s: Column) -> Column:
        # A match and the piece of text before it are one step.
        steps = F.zip_with(s["gaps"], s["found"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))

        def shaped(b: Column) -> Column:
            all_ = F.transform(
                s["found"],
                lambda m, i: F.struct(
                    F.lit(kind).alias("kind"), (F.get(b, i) + F.length(F.get(s["gaps"], i))).alias("start"),
                    F.get(b, i + 1).alias("end"), m.alias("text"),
                ),
            )
            kept = F.filter(all_, lambda p: keep(p["text"])) if keep else all_
            return F.transform(kept, lambda p: p.dropFields("text"))

        return let(before(steps), shaped)

    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(NONE))


def _kind(name: str) -> int:
    return KINDS.index(name)


def _certain(text: Column) -> Column:
    return F.concat(
        spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST),
        spans(text, ACCESS, 1),
        spans(text, HEX, 2),
    )


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


def _weak(text: Column) -> Column:
    return F.concat(
        spans(text, ID, _kind("id")), spans(text, SECRET, _kind("secret")), spans(text, TOKEN, _kind("token"), _mixed),
        spans(text, ENDPOINT, _kind("endpoint")),
    )


def _has(parts: Column, *kinds: str) -> Column:
    return F.exists(parts, lambda p: p["kind"].isin([_kind(k) for k in kinds]))


def _complement(a: Column, b: Column) -> Column:
    """Whether parts of kinds `a` and `b` make a credential together."""

    def of(x: Column, *kinds: str) -> Column:
        return x.isin([_kind(k) for k in kinds])

    def one_way(x: Column, y: Column) -> Column:
        ids = of(x, "access", "id") & of(y, "assign", "hex", "secret", "token")
        return ids | (of(x, "endpoint") & of(y, "assign", "secret"))

    return one_way(a, b) | one_way(b, a)


def _bins(low: Column, high: Column) -> Column:
    """The bins of the half-open interval from `low` to `high`."""
    first = F.floor(low / BIN).cast("int")
    return F.explode(F.sequence(first, F.greatest(first, F.floor((high - 1) / BIN).cast("int"))))


def linked(texts: DataFrame) -> DataFrame:
    """`k1`, `k2`, `kind`, `start`, `end` of the weak parts to report, of distinct texts (`k1`, `k2`, `parts`, `breaks`, `n`)."""
    key = ["k1", "k2"]
    parts = texts.select(*key, F.explode("parts").alias("p")).select(*key, "p.*")
    # Scope i runs from the end of break i to the start of break i + 1.
    limits = F.concat(
        F.array(F.lit(0)), F.transform("breaks", lambda b: b["start"]), F.array(F.col("n") + 1)
    )
    scopes = texts.select(*key, limits.alias("at"))
    scopes = scopes.select(*key, F.posexplode(F.slice("at", F.lit(1), F.size("at") - 1)).alias("scope", "low"), F.col("at"))
    scopes = scopes.select(*key, "scope", "low", F.get("at", F.col("scope") + 1).alias("high")).where("high > low")
    scopes = scopes.select("*", _bins(F.col("low"), F.col("high")).alias("bin"))
    parts = parts.withColumn("bin", F.floor(F.col("start") / BIN).cast("int"))
    placed = parts.join(scopes, [*key, "bin"]).where("low <= start and start < high").select(*key, "scope", "kind", "start", "end")

    a = placed.where(F.col("kind") >= len(CERTAIN))
    a = a.select("*", _bins(F.col("start") - REACH, F.col("end") + REACH + 1).alias("bin"))
    b = placed.select(*key, "scope", F.col("kind").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    b = b.select("*", _bins(F.col("s"), F.col("e")).alias("bin"))
    met = a.join(b, [*key, "scope", "bin"])
    gap = F.greatest("start", "s") - F.least("end", "e")
    covers = (F.col("k") < len(CERTAIN)) & (gap < 0) & (F.col("kind") != _kind("endpoint"))
    links = _complement(F.col("kind"), F.col("k")) & (gap <= REACH)
    found = met.groupBy(*key, "kind", "start", "end").agg(F.max(covers).alias("covered"), F.max(links).alias("linked"))
    return found.where("linked and not covered").drop("covered", "linked")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `findings` of every row: structs of `kind`, `start`, `end` (code points, end exclusive) and `certain`.

    Findings are ordered by start, then as `KINDS` lists them. A null or empty text has none. Repeated rows and rows of
    one id are rows of the result each; other columns take no part. A text of any length is searched whole.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    rows = rows.select(
        "id", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"), _certain(F.col("t")).alias("base"),
        _weak(F.col("t")).alias("weak"), spans(F.col("t"), BREAK, 0).alias("breaks"), F.length("t").alias("n"),
    )
    every = F.concat("base", "weak")
    asked = (F.size("weak") > 0) & (
        (_has(every, "access", "id") & _has(every, "assign", "hex", "secret", "token"))
        | (_has(every, "endpoint") & _has(every, "assign", "secret"))
    )
    none = F.array().cast(NONE)
    rows = rows.select(
        "id", "k1", "k2", "base", "n", asked.alias("asked"), F.when(asked, F.col("weak")).otherwise(none).alias("weak"),
        F.when(asked, F.col("breaks")).otherwise(none).alias("breaks"),
    )
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, k1 bigint, k2 bigint, base {NONE}, n int, asked boolean, weak {NONE}, breaks {NONE}"
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(kind).parquet(f"{folder}/rows")

    first = F.first(F.struct(F.concat("base", "weak").alias("parts"), "breaks", "n")).alias("x")
    more = linked(rows.where("asked").groupBy("k1", "k2").agg(first).select("k1", "k2", "x.*"))
    more = more.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    more.write.parquet(f"{folder}/linked")
    more = spark.read.schema(f"k1 bigint, k2 bigint, more {NONE}").parquet(f"{folder}/linked")
    more = more.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = rows.where("asked").select("id", "k1", "k2", "base", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    beside = left.join(more, ["k1", "k2", "salt"], "left").select("id", F.concat("base", F.coalesce("more", none)).alias("all"))
    out = rows.where("not asked").select("id", F.col("base").alias("all")).union(beside)
    ordered = F.array_sort(F.transform("all", lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))))
    named = F.transform(
        ordered,
        lambda p: F.struct(
            F.get(F.array(*[F.lit(k) for k in KINDS]), p["kind"]).alias("kind"), p["start"].alias("start"), p["end"].alias("end"),
            (p["kind"] < len(CERTAIN)).alias("certain"),
        ),
    )
    return out.select(F.col("id").alias(id_col), named.alias("findings"))


def joined(findings: Column) -> Column:
    """`kind:start:end` of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
