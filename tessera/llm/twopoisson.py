"""How distinctive a term is for a record: a two-Poisson mixture per term.

A term's occurrence counts over all records of a collection are modelled as a mixture of
an elite Poisson (records the term is about) and a background Poisson.  The mixture is
fitted by expectation-maximisation on the histogram of the term's counts, never on the
records themselves, so a term in a billion records costs as much as its distinct counts.
The posterior probability of the elite component scores each occurrence count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import strip_ws, terms
from tessera.plans.lineage import Workspace
from tessera.sources.tables import one_delivery, single_deliveries

FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("share", "elite_rate", "base_rate")])


def fit_two_poisson(counts: list[np.ndarray], records: list[np.ndarray], n_records: np.ndarray, rounds: int = 25, prior: float = 1.0) -> np.ndarray:
    """Rows ``(share, elite_rate, base_rate)`` for histograms of positive counts.

    ``counts[i]`` and ``records[i]`` are term i's distinct counts and the records that have
    them; the records left of ``n_records[i]`` have none.  The start sets the elite rate to
    the mean over holders and the base rate far below the overall mean, then takes
    ``rounds`` steps, all terms at once.  The elite rate has a gamma prior of mean 1 that
    weighs ``prior`` records: a record about a term names it about once at least.  The
    share has a beta prior that expects ``2 * prior`` elite records.  The priors decide
    only where counts are all 0 or 1 and cannot tell two rates apart: there the fewer
    records hold a term, the likelier each of them is elite.
    """
    m = len(counts)
    if not m:
        return np.zeros((0, 3))
    size = np.array([len(c) for c in counts])
    seg = np.repeat(np.arange(m), size)
    k, w = np.concatenate(counts).astype(float), np.concatenate(records).astype(float)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    add = lambda x: np.add.reduceat(x, starts)
    held, mass = add(w), add(w * k)
    n = np.maximum(np.asarray(n_records, float), held)
    zero = n - held
    elite = mass / held
    base = np.maximum(mass / n * 0.1, 1e-12)
    share = np.clip(held / n, 1e-12, 1 - 1e-9)
    for _ in range(rounds):
        e, b, s = elite[seg], base[seg], share[seg]
        la, lb = np.log(s) - e + k * np.log(e), np.log1p(-s) - b + k * np.log(b)
        r = w / (1 + np.exp(np.clip(lb - la, -700, 700)))
        z = zero / (1 + np.exp(np.clip(np.log1p(-share) - base - np.log(share) + elite, -700, 700)))
        a = add(r) + z
        hits = add(r * k)
        share = np.clip((a + 2 * prior) / (2 * n), 1e-12, 1 - 1e-9)
        elite = (hits + prior) / (a + prior)
        base = np.clip((mass - hits) / np.maximum(n - a, 1e-12), 1e-12, None)
        swap = base > elite
        elite, base, share = np.where(swap, base, elite), np.where(swap, elite, base), np.where(swap, 1 - share, share)
    return np.stack([share, elite, base], axis=1)


@F.pandas_udf(FIT)
def _fit(hist: pd.Series, n_records: pd.Series) -> pd.DataFrame:
    counts = [np.array([x["tf"] for x in h]) for h in hist]
    records = [np.array([x["n"] for x in h]) for h in hist]
    return pd.DataFrame(fit_two_poisson(counts, records, n_records.to_numpy()), columns=FIT.names)


def score_terms(occurrences: DataFrame, n_records: DataFrame) -> DataFrame:
    """Score every ``(record_kind, record_key, term, tf)``.

    ``n_records`` is ``(record_kind, n_records)``, one row a kind.  Adds the fitted ``share,
    elite_rate, base_rate``, ``elite_probability`` (posterior that the record is elite for
    the term at its count) and ``score``, that probability times the log of how many times
    rarer the term is than a term of every record.  One shuffle builds histograms by term
    (pre-aggregated), one joins the fits back; a term in very many records is split by
    adaptive skew handling because each of its rows needs only the term's three numbers.
    """
    by_count = occurrences.groupBy("record_kind", "term", "tf").agg(F.count(F.lit(1)).alias("n"))
    hist = by_count.groupBy("record_kind", "term").agg(F.collect_list(F.struct("tf", "n")).alias("hist"))
    fits = hist.join(F.broadcast(n_records), "record_kind").select("record_kind", "term", _fit("hist", "n_records").alias("f"), F.log1p(F.col("n_records") / F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x.n)).alias("rarity")).select("record_kind", "term", "f.*", "rarity")
    elite = F.log("share") - F.col("elite_rate") + F.col("tf") * F.log("elite_rate")
    base = F.log(1 - F.col("share")) - F.col("base_rate") + F.col("tf") * F.log("base_rate")
    scored = occurrences.join(fits, ["record_kind", "term"]).withColumn("elite_probability", 1 / (1 + F.exp(F.least(F.lit(700.0), base - elite))))
    return scored.withColumn("score", F.col("elite_probability") * F.col("rarity")).drop("rarity")


def session_terms(corpus: DataFrame) -> DataFrame:
    """``(record_kind, record_key, term, tf, n_rows)``: terms of each session's sentences.

    ``n_rows`` counts the session's distinct sentences with the term.  Sentences without a
    session come out under a null key: they are no record, but rows that hold the term.
    """
    rows = single_deliveries(corpus.select("sentence_id", "session", "text"), "sentence_id").filter(F.col("text").isNotNull())
    words = rows.select("session", terms(F.col("text")).alias("w"))
    once = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("row")))
    every = F.transform("w", lambda x: F.struct(x.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("row")))
    listed = words.select("session", F.explode(F.concat(once, every)).alias("t"))
    return listed.groupBy("session", F.col("t.term").alias("term")).agg(F.sum("t.tf").cast("long").alias("tf"), F.sum("t.row").cast("long").alias("n_rows")).select(F.lit("corpus").alias("record_kind"), F.col("session").alias("record_key"), "term", "tf", "n_rows")


def cluster_terms(clusters: DataFrame) -> DataFrame:
    """``(record_kind, record_key, term, tf, n_rows)``: the listed terms of each cluster.

    Terms stand between commas or semicolons, trimmed and lower-cased, empty parts left
    out.  ``tf`` counts how often a list names the term; ``n_rows`` is 1.  Clusters with a
    null run or number have no key and are left out; null lists have no term.
    """
    rows = one_delivery(clusters.select("run_id", "p1_cluster", "p1_top_terms"), "run_id", "p1_cluster").filter("run_id is not null and p1_cluster is not null")
    key = F.concat_ws(":", "run_id", F.col("p1_cluster").cast("string"))
    parts = rows.select(key.alias("record_key"), F.explode(F.split("p1_top_terms", "[,;]")).alias("raw"))
    cleaned = parts.select("record_key", F.lower(strip_ws(F.col("raw"))).alias("term")).filter("term <> ''")
    return cleaned.groupBy("record_key", "term").agg(F.count(F.lit(1)).alias("tf")).select(F.lit("cluster").alias("record_kind"), "record_key", "term", "tf", F.lit(1).cast("long").alias("n_rows"))


def term_distinctiveness(corpus: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every term of every session and cluster with its score and the counts behind it.

    Columns: ``record_kind, record_key, term, tf, n_rows, rows_total, share, elite_rate,
    base_rate, elite_probability, score``.  ``rows_total`` is the number of sentences (kind ``corpus``) or of
    clusters (kind ``cluster``) that hold the term.  Empty tables give no rows.
    """
    ws = Workspace(corpus.sparkSession, "twopoisson")
    held = ws.write(session_terms(corpus).unionByName(cluster_terms(clusters)), "occurrences")
    totals = held.groupBy("record_kind", "term").agg(F.sum("n_rows").alias("rows_total"))
    keyed = held.filter(F.col("record_key").isNotNull())
    n_records = keyed.groupBy("record_kind").agg(F.countDistinct("record_key").alias("n_records"))
    return score_terms(keyed, n_records).join(totals, ["record_kind", "term"])


def characteristic_terms(scored: DataFrame, least_rows: int = 6, least_share: float = 0.5, most_clusters: int = 4, session_elite: float = 0.5, cluster_elite: float = 0.05) -> DataFrame:
    """``(record_kind, record_key, term)`` of the scored terms that belong to their record.

    Candidates are the terms the mixture deems elite for the record: a posterior of at
    least ``session_elite`` where counts tell rates apart, ``cluster_elite`` in lists, whose
    0/1 counts leave posteriors low.  Of these, a session keeps those in ``least_rows`` or more of its
    rows which are at least ``least_share`` of all rows with the term; a cluster keeps
    those that at most ``most_clusters`` clusters list.
    """
    session = (F.col("record_kind") == "corpus") & (F.col("n_rows") >= least_rows) & (F.col("n_rows") >= least_share * F.col("rows_total"))
    cluster = (F.col("record_kind") == "cluster") & (F.col("rows_total") <= most_clusters)
    elite = F.when(F.col("record_kind") == "corpus", session_elite).otherwise(cluster_elite)
    return scored.filter((F.col("elite_probability") >= elite) & (session | cluster)).select("record_kind", "record_key", "term")
