"""Soft-membership mixing of domains to target weights, with DataFrame functions only.

A naive Bayes classifier over hashed words, counted on a labelled table, gives
every document its probability of each domain. A document of rate r adds r times
its tokens times these probabilities to the domains. The rates are the
nonnegative solution of the weighted least squares between the domains' expected
tokens and their targets, found by projected gradient steps that start from rate
one:

    r <- max(0, r - sum_d p_d * (S_d - T_d) / N_d)

with S the expected tokens at the present rates, T the targets and N the tokens
at rate one. The weights 1/N bound the curvature by one, so unit steps never
overshoot. Documents of equal membership take equal steps; memberships are
rounded to 1/256, so the steps run over the table of distinct memberships with
their tokens, which Spark sums once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable

BUCKETS = 4096
#: Labelled documents the classifier is counted on, at most.
SAMPLE_DOCS = 5000
#: A text counts as this many words of evidence at most, which keeps memberships soft.
EVIDENCE = 4
ROUND = 256
MOST_DOMAINS = 64
STEPS, CLOSE = 80, 1e-4


@dataclass
class Mix:
    """Log-odds of words by domain, the shares of the domains, and the gradient steps that give the rates."""

    domains: list[str]
    prior: list[float]
    weights: list[list[float]]
    targets: dict[str, float] = field(default_factory=dict)
    totals: list[float] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)


def _buckets(text: str) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit_domains(docs: DataFrame, labelled: DataFrame, text_col: str = "text", id_col: str = "doc_id", domain_col: str = "domain") -> Mix:
    """The classifier from `labelled` (`id_col`, `domain_col`); null ids and domains are left out.

    Collects one number for each word bucket and domain. Without a label there is one domain, "all".
    """
    known = labelled.select(F.col(id_col).alias("k"), F.col(domain_col).cast("string").alias("domain")).dropna()
    known = known.groupBy("k").agg(F.min("domain").alias("domain"))
    some = known.orderBy(F.xxhash64("k"), "k").limit(SAMPLE_DOCS)
    words = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(some), "k")
    words = words.select("domain", F.explode(_buckets("t")).alias("bucket"))
    docs_in = {r["domain"]: r["n"] for r in some.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if len(docs_in) > MOST_DOMAINS:
        raise ValueError(f"{len(docs_in)} domains; a mixture has at most {MOST_DOMAINS}")
    domains = sorted(docs_in)
    if not domains:
        return Mix(["all"], [0.0], [[0.0] * BUCKETS])
    counts = {(r["domain"], r["bucket"]): r["n"] for r in words.groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()}
    size = {d: sum(counts.get((d, b), 0) for b in range(BUCKETS)) + BUCKETS for d in domains}
    share = [[(counts.get((d, b), 0) + 1) / size[d] for b in range(BUCKETS)] for d in domains]
    mean = [sum(row[b] for row in share) / len(domains) for b in range(BUCKETS)]
    weights = [[round(math.log(row[b] / mean[b]), 6) for b in range(BUCKETS)] for row in share]
    total = sum(docs_in.values())
    return Mix(domains, [math.log(docs_in[d] / total) for d in domains], weights)


def _total(buckets: str, weights: list[float]) -> Column:
    # One string for the list: a literal of thousands of numbers takes as many calls to build.
    weight = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(weight, b))


def with_membership(docs: DataFrame, mix: Mix, text_col: str = "text") -> DataFrame:
    """`docs` with `_mx_tokens` and `_mx_p`, the rounded probability of each domain in order; a null text has none."""
    rows = docs.withColumn("_mx_words", _buckets(text_col)).withColumn("_mx_tokens", F.size("_mx_words").cast("bigint"))
    scale = F.lit(1.0) / F.greatest(F.lit(1.0), F.col("_mx_tokens") / F.lit(float(EVIDENCE)))
    odds = []
    for prior, row in zip(mix.prior, mix.weights, strict=True):
        odds.append(F.lit(prior) + _total("_mx_words", row) * scale)
    rows = rows.withColumn("_mx_odds", F.array(*odds)).drop("_mx_words")
    rows = rows.withColumn("_mx_top", F.array_max("_mx_odds"))
    exps = F.transform("_mx_odds", lambda o: F.exp(o - F.col("_mx_top")))
    rows = rows.withColumn("_mx_exp", exps)
    rows = rows.withColumn("_mx_sum", F.aggregate("_mx_exp", F.lit(0.0), lambda s, e: s + e))
    p = F.transform("_mx_exp", lambda e: F.round(e / F.col("_mx_sum") * ROUND) / ROUND)
    return rows.withColumn("_mx_p", p).drop("_mx_odds", "_mx_top", "_mx_exp", "_mx_sum")


def _dot(p: Column, step: Column, n: int) -> Column:
    out = F.lit(0.0)
    for d in range(n):
        out = out + F.get(p, F.lit(d)) * F.get(step, F.lit(d))
    return out


def rate(mix: Mix, p: Column) -> Column:
    """The rate after all steps of a document of membership `p`."""
    if not mix.steps:
        return F.lit(1.0)
    n = len(mix.domains)
    steps = F.array(*[F.lit(s) for s in mix.steps])
    return F.aggregate(steps, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - _dot(p, s, n)))


def fit_rates(docs: DataFrame, mix: Mix, targets: dict[str, float] | None = None, temper: float = 0.7, text_col: str = "text") -> Mix:
    """The steps that bring the domains' expected tokens to `targets` (shares of all tokens).

    Without targets a domain's share is its present share to the power `temper`, scaled to one. One small job a step;
    it ends when every domain is within `CLOSE` of its target or after `STEPS`. No tokens: all rates are one.
    """
    n = len(mix.domains)
    members = with_membership(docs.select(text_col), mix, text_col).groupBy("_mx_p").agg(F.sum("_mx_tokens").alias("tokens"))
    members = durable(members.where("tokens > 0"))

    def expected(r: Column) -> list[float]:
        sums = [F.sum(r * F.col("tokens") * F.get("_mx_p", F.lit(d))) for d in range(n)]
        return [float(v or 0) for v in members.agg(*[s.alias(f"d{k}") for k, s in enumerate(sums)]).first()]

    now = expected(F.lit(1.0))
    total = sum(now)
    mix.totals, mix.steps = now, []
    if not total:
        mix.targets = dict.fromkeys(mix.domains, 0.0)
        return mix
    if targets is None:
        powered = [(v / total) ** temper for v in now]
        targets = {d: v / sum(powered) for d, v in zip(mix.domains, powered, strict=True)}
    mix.targets = {d: targets.get(d, 0.0) * total for d in mix.domains}
    goal, base = [mix.targets[d] for d in mix.domains], [max(v, 1.0) for v in now]
    while len(mix.steps) < STEPS:
        if all(abs(s - t) <= CLOSE * max(t, 1.0) for s, t in zip(now, goal, strict=True)):
            break
        mix.steps.append([(s - t) / b for s, t, b in zip(now, goal, base, strict=True)])
        now = expected(rate(mix, F.col("_mx_p")))
    return mix


def with_rates(docs: DataFrame, mix: Mix, text_col: str = "text") -> DataFrame:
    """`docs` with `tokens`, `domain` (the likeliest), `membership` (its probability) and `rate`; such columns are replaced."""
    added = ("tokens", "domain", "membership", "rate")
    kept = [c for c in docs.columns if c not in added]
    rows = with_membership(docs.select(*kept), mix, text_col)
    best = F.array_max("_mx_p")
    return rows.select(
        *kept, F.col("_mx_tokens").alias("tokens"),
        F.get(F.array(*[F.lit(d) for d in mix.domains]), (F.array_position("_mx_p", best) - 1).cast("int")).alias("domain"),
        best.alias("membership"), rate(mix, F.col("_mx_p")).alias("rate"),
    )


def mixed(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as often as its rate says: the whole part, and once more with the probability of the rest.

    The draw is a hash of id and text, so a row decides alike wherever it is computed. Same columns as `docs`.
    """
    named = {c: f"_mx_in_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(v) for c, v in named.items()])
    rows = with_rates(rows, mix, named[text_col])
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col(named[id_col]), F.col(named[text_col])), F.lit(1 << 20)) / float(1 << 20)
    # The partition's number, times zero, keeps the optimizer from moving the filter below, with a copy of the whole
    # classifier for every use of a column, to the scan.
    times = F.floor(F.col("rate") + draw).cast("int") + F.spark_partition_id() * 0
    rows = rows.withColumn("_mx_times", times).where("_mx_times > 0")
    rows = rows.withColumn("_mx_time", F.explode(F.sequence(F.lit(1), F.col("_mx_times"))))
    return rows.select(*[F.col(v).alias(c) for c, v in named.items()])
