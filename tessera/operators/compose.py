"""Compositions of parts by event and register: prevalence, log-ratios, exact tests, variants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import logit, r6, ratio, sign_test_p


def prevalence(df: DataFrame, categories: DataFrame, label: str = "label", keys: tuple[str, ...] = ("event", "register")) -> DataFrame:
    """``(keys..., category, n_category, n_total, n_assigned, p_all, p_assigned)`` with explicit zeros.

    Noise (-1) stays in the denominator of ``p_all`` and leaves that of ``p_assigned``.
    """
    by = list(keys)
    counts = df.groupBy(*by, F.col(label).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    # one entry a category: a map of bounded size replaces a second pass over the counts
    whole = counts.groupBy(*by).agg(F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(F.col("category") != -1, F.col("n"))), F.lit(0)).alias("n_assigned"), F.map_from_entries(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "n")))).alias("counted"))
    full = whole.crossJoin(F.broadcast(categories.select("category")))  # categories are a bounded list
    out = full.withColumn("n_category", F.coalesce(F.try_element_at("counted", F.col("category")), F.lit(0))).drop("counted")
    return out.withColumn("p_all", ratio(F.col("n_category"), F.col("n_total"))).withColumn("p_assigned", ratio(F.col("n_category"), F.col("n_assigned")))


def by_register(df: DataFrame, keys: list[str], values: list[str], registers: tuple[str, str] = ("HIGHLIGHT", "FULL_RACE")) -> DataFrame:
    """One row a key with columns ``<value>_<register>``; keys without both registers go.

    Conditional maxima in one grouped pass; no self join.
    """
    out = df.groupBy(*keys).agg(*[F.max(F.when(F.col("register") == r, F.col(v))).alias(f"{v}_{r}") for v in values for r in registers], F.countDistinct("register").alias("__n"))
    return out.filter(F.col("__n") == 2).drop("__n")


def event_deltas(prev: DataFrame) -> DataFrame:
    """Primary less second register of both shares, by event and category."""
    wide = by_register(prev, ["event", "category"], ["p_all", "p_assigned"])
    return wide.select("event", "category", *[(F.col(f"{v}_HIGHLIGHT") - F.col(f"{v}_FULL_RACE")).alias(f"delta_{v}") for v in ("p_all", "p_assigned")])


def summarise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, quartiles, extremes, signs and exact sign test of a value over events."""
    x = F.col(value)
    q = F.percentile(value, [0.25, 0.5, 0.75])
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count_if(x < 0).alias("n_negative"), F.count_if(x > 0).alias("n_positive"))
    g = g.withColumn("sign_p", sign_test_p(F.col("n_negative"), F.col("n_positive"), F.col("n")))
    return g.select(*keys, "n", *[r6(c).alias(c) for c in ("mean", "sd")], *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(("q1", "median", "q3"))], r6("lowest").alias("lowest"), r6("highest").alias("highest"), "n_negative", "n_positive", r6("sign_p").alias("sign_p"))


def leave_one_out(df: DataFrame, keys: list[str], value: str, unit: str = "event") -> DataFrame:
    """Median of the value with each unit left out, and its sign.

    Units are few by design (they are the inferential sample); each group is one array.
    """
    held = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(value).alias("x"))).alias("xs"))
    left = held.select(*keys, F.explode("xs").alias("o"), "xs").select(*keys, F.col("o.u").alias("omitted"), F.array_sort(F.transform(F.filter("xs", lambda s: s.u != F.col("o.u")), lambda s: s.x)).alias("r"))
    n = F.size("r")
    mid = F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, F.element_at("r", ((n + 1) / 2).cast("int"))).otherwise((F.try_element_at("r", F.greatest(F.lit(1), (n / 2).cast("int"))) + F.try_element_at("r", (n / 2 + 1).cast("int"))) / 2)
    return left.select(*keys, "omitted", mid.alias("median")).withColumn("sign", F.signum("median").cast("int"))


def zero_replaced(df: DataFrame, keys: list[str], n: str = "n", delta: float = 0.5) -> DataFrame:
    """Adds ``p``: parts with Bayes-multiplicative replacement of zeros, and ``n_zero``.

    A zero becomes delta / N, others shrink so that parts sum to one; no count at all gives
    equal parts, all of them counted as zeros.
    """
    w = Window.partitionBy(*keys)
    total, zeros, parts = F.sum(n).over(w), F.count_if(F.col(n) == 0).over(w), F.count(F.lit(1)).over(w)
    t = total.cast("double")
    value = F.when(total == 0, 1.0 / parts).when(F.col(n) == 0, F.try_divide(F.lit(delta), t)).otherwise(F.try_divide(F.col(n), t) * (1 - zeros * F.try_divide(F.lit(delta), t)))
    raw = df.withColumn("__v", value).withColumn("n_zero", zeros.cast("long"))
    return raw.withColumn("p", F.col("__v") / F.sum("__v").over(w)).drop("__v")


def clr(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Adds ``clr``: log part less the mean log part."""
    return df.withColumn("clr", F.log(p) - F.avg(F.log(p)).over(Window.partitionBy(*keys)))


def ilr_balance(part: Column, p: Column, numerator: list[str], denominator: list[str]) -> Column:
    """Aggregate expression of one balance of a sequential binary partition."""
    r, s = len(numerator), len(denominator)
    scale = math.sqrt(r * s / (r + s))
    return F.lit(scale) * (F.avg(F.when(part.isin(numerator), F.log(p))) - F.avg(F.when(part.isin(denominator), F.log(p))))


#: The demonstration's balances, fixed before looking at data.
def balances(domains: tuple[str, ...]) -> dict[str, tuple[list[str], list[str]]]:
    return {f"b{k + 1}": ([domains[k]], list(domains[k + 1 :])) for k in range(len(domains) - 1)}


def domain_counts(df: DataFrame, domains: tuple[str, ...], keys: list[str]) -> DataFrame:
    """``(keys..., domain, n)`` with zeros, in one pass; rows whose domain is null leave the composition."""
    wide = df.groupBy(*keys).agg(*[F.count_if(F.col("domain") == d).alias(f"__{k}") for k, d in enumerate(domains)])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"__{k}").alias("n")) for k, d in enumerate(domains)])).alias("x")
    return wide.select(*keys, rows).select(*keys, "x.*")


def representation(df: DataFrame, keys: list[str], domains: tuple[str, ...], primary: str) -> DataFrame:
    """``(keys..., raw, logit, clr, b1, b2 ...)`` of the primary domain from ``(keys..., domain, n, p)``."""
    withclr = clr(df, keys)
    w = ratio(F.sum(F.when(F.col("domain") == primary, F.col("n"))), F.sum("n"))
    one = F.max(F.when(F.col("domain") == primary, F.col("p")))
    agg = [w.alias("raw"), logit(one).alias("logit"), F.max(F.when(F.col("domain") == primary, F.col("clr"))).alias("clr")]
    agg += [ilr_balance(F.col("domain"), F.col("p"), num, den).alias(name) for name, (num, den) in balances(domains).items()]
    return withclr.groupBy(*keys).agg(*agg)


def representation_deltas(rep: DataFrame, keys: list[str]) -> DataFrame:
    """Long ``(keys..., representation, delta)`` of primary less second register."""
    values = [c for c in rep.columns if c not in (*keys, "register")]
    wide = by_register(rep, keys, values)
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("representation"), (F.col(f"{v}_HIGHLIGHT") - F.col(f"{v}_FULL_RACE")).alias("delta")) for v in values])).alias("x")
    return wide.select(*keys, rows).select(*keys, "x.*")


def variant_maps(base: DataFrame, moves: DataFrame) -> DataFrame:
    """``(variant, category, domain)``: the map itself and each variant with its moves applied, in one relation.

    ``moves(variant, category, domain)``; a null domain takes the category out.
    """
    variants = moves.select("variant").distinct()
    full = base.crossJoin(F.broadcast(variants)).join(moves.select("variant", "category", F.col("domain").alias("to"), F.lit(True).alias("moved")), ["variant", "category"], "left")
    return full.select("variant", "category", F.when(F.col("moved"), F.col("to")).otherwise(F.col("domain")).alias("domain")).unionByName(base.select(F.lit("base").alias("variant"), "category", "domain"))
