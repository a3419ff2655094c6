"""Vocabulary, incidence and enrichment of terms by category, on long relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exact import hypergeom_tail
from tessera.functions.math import r6, ratio
from tessera.functions.text import terms
from tessera.operators.ordering import benjamini_hochberg, benjamini_hochberg_within
from tessera.plans.lineage import Workspace


def grams(text: Column, stop: tuple[str, ...] = (), max_n: int = 2) -> Column:
    """1..n-grams of a text; placeholders become spaces and stop words go before grams are formed."""
    words = terms(F.regexp_replace(text, r"<(PERSON|TEAM|PLACE)>", " "))
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words

    def runs(n: int) -> Column:
        at = F.when(F.size(kept) >= n, F.sequence(F.lit(1), F.size(kept) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(kept, i, n), " "))

    return F.concat(kept, *[runs(n) for n in range(2, max_n + 1)]) if max_n > 1 else kept


def occurrences(df: DataFrame, stop: tuple[str, ...] = (), max_n: int = 2, keep: tuple[str, ...] = ("sentence_id", "label")) -> DataFrame:
    """``(keep..., term)`` for every occurrence."""
    return df.select(*keep, F.explode(grams(F.col("text"), stop, max_n)).alias("term"))


def vocabulary(occ: DataFrame, min_df: int = 3, max_features: int = 6000, doc: str = "sentence_id") -> DataFrame:
    """``(term, df_term, tf)``: terms of ``min_df`` documents or more, the ``max_features`` most frequent, ties alphabetical.

    The cut is a top-k over aggregated terms, which Spark takes per partition and merges.
    """
    per_doc = occ.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("c"))
    counted = per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df_term"), F.sum("c").alias("tf")).filter(F.col("df_term") >= min_df)
    return counted.orderBy(F.desc("tf"), "term").limit(max_features)


def incidence(occ: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = ("sentence_id", "label")) -> DataFrame:
    """Distinct ``(keys..., term)`` of vocabulary terms."""
    return occ.join(vocab.select("term"), "term", "left_semi").select(*keys, "term").distinct()


def term_counts(docs: DataFrame, inc: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., term, label, n_docs, df_term, n_cluster, k_in)`` for every term and category, zeros included.

    Documents and frequencies count noise; only the categories exclude it.
    """
    by = by or []
    sizes = docs.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n_cluster"))
    total = sizes.groupBy(*by).agg(F.sum("n_cluster").alias("n_docs")) if by else sizes.agg(F.sum("n_cluster").alias("n_docs"))
    k = inc.groupBy(*by, "term", "label").agg(F.count(F.lit(1)).alias("k_in"))
    df_term = k.groupBy(*by, "term").agg(F.sum("k_in").alias("df_term"))
    cats = sizes.filter(F.col("label") != -1)
    # vocabulary times categories is the test family itself; categories are some dozens
    full = df_term.join(F.broadcast(cats), by) if by else df_term.crossJoin(F.broadcast(cats))
    full = full.join(F.broadcast(total), by) if by else full.crossJoin(F.broadcast(total))
    return full.join(k, [*by, "term", "label"], "left").withColumn("k_in", F.coalesce("k_in", F.lit(0)).cast("long"))


def enrichment(counts: DataFrame, q: float = 0.05) -> DataFrame:
    """Adds expected count, exact hypergeometric p, and one step-up family over all pairs."""
    ws = Workspace(counts.sparkSession, "enrichment")
    tested = ws.write(counts.withColumn("expected", F.bround(ratio(F.col("n_cluster") * F.col("df_term"), F.col("n_docs")), 3)).withColumn("p", hypergeom_tail(F.col("k_in"), F.col("n_docs"), F.col("df_term"), F.col("n_cluster"))), "tested")
    return benjamini_hochberg(tested, "p", q)


def enrichment_screen(counts: DataFrame, q: float = 0.05) -> DataFrame:
    """Enriched unigrams of each category, one family for each category."""
    tested = counts.filter(~F.col("term").contains(" ")).withColumn("p", hypergeom_tail(F.col("k_in"), F.col("n_docs"), F.col("df_term"), F.col("n_cluster")))
    return benjamini_hochberg_within(tested, ["label"], "p", q).groupBy("label").agg(F.count_if("rejected").alias("n_enriched"))


def enrichment_summary(enriched: DataFrame, docs: DataFrame) -> DataFrame:
    """Size, enriched terms and share of bigrams of each category."""
    sizes = docs.filter("label <> -1").groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    hits = enriched.filter("rejected").groupBy("label").agg(F.count(F.lit(1)).alias("n_enriched"), F.avg(F.col("term").contains(" ").cast("int")).alias("bigram_share"))
    return sizes.join(hits, "label", "left").select("label", "size", F.coalesce("n_enriched", F.lit(0)).alias("n_enriched"), r6(F.coalesce("bigram_share", F.lit(0.0))).alias("bigram_share"))


def top_terms(enriched: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.bround(F.log10(F.greatest("p", F.lit(1e-290))), 6), "term")
    return enriched.filter("rejected").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def dedupe_keywords(words: Column, most: int = 4) -> Column:
    """Greedy choice in order: a word goes if it is part of a chosen one or a chosen one is part of it."""
    start = F.array().cast("array<string>")
    return F.aggregate(words, start, lambda acc, t: F.when((F.size(acc) < most) & ~F.exists(acc, lambda c: F.contains(c, t) | F.contains(t, c)), F.concat(acc, F.array(t))).otherwise(acc))


def term_weights(counts: DataFrame) -> DataFrame:
    """Share of a category's documents that hold the term."""
    return counts.withColumn("weight", ratio(F.col("k_in"), F.col("n_cluster")))


def weighted_jaccard(weights: DataFrame, other: DataFrame) -> DataFrame:
    """``(h, f, similarity)`` = sum of minima over sum of maxima of two weighted term sets.

    Sparse form: minima come from shared terms only, maxima are both totals less the minima;
    sets without a shared term have 0.
    """
    a, b = weights.select(F.col("label").alias("h"), "term", F.col("weight").alias("wa")), other.select(F.col("label").alias("f"), "term", F.col("weight").alias("wb"))
    ta, tb = a.groupBy("h").agg(F.sum("wa").alias("ta")), b.groupBy("f").agg(F.sum("wb").alias("tb"))
    mins = a.join(b, "term").groupBy("h", "f").agg(F.sum(F.least("wa", "wb")).alias("m"))
    # every pair of categories has a row, so the result itself is that product
    shared = F.coalesce("m", F.lit(0.0))
    return ta.crossJoin(tb).join(mins, ["h", "f"], "left").select("h", "f", F.coalesce(ratio(shared, F.col("ta") + F.col("tb") - shared), F.lit(0.0)).alias("similarity"))


def heldout_replication(train: DataFrame, test: DataFrame, q: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Two-stage replication of enriched terms by category.

    Stage one rejects over all training pairs; stage two corrects the held-out p-values of
    the rejected pairs alone.  ``strict``: rejected again; ``lenient``: positive deviation and
    p < .10; ``direction``: positive deviation.  A category passes with half of its terms
    strict and half in direction; one without training terms has null rates and fails.  With
    ``by``, counts carry these run keys and every run has families of its own, each of which
    one task orders (categories times vocabulary).
    """
    by = by or []
    ws = Workspace(train.sparkSession, "replication")
    tail = hypergeom_tail(F.col("k_in"), F.col("n_docs"), F.col("df_term"), F.col("n_cluster"))
    if by:
        first = benjamini_hochberg_within(ws.write(train.withColumn("p", tail), "tested"), by, "p", q)
    else:
        first = enrichment(train, q)
    first = first.filter("rejected").select(*by, "label", "term")
    z_var = F.col("expected_x") * (1 - F.col("df_term") / F.col("n_docs")) * (F.col("n_docs") - F.col("n_cluster")) / F.greatest(F.col("n_docs") - 1, F.lit(1))
    held = test.join(first, [*by, "label", "term"]).withColumn("p", tail)
    held = held.withColumn("expected_x", F.col("n_cluster") * F.col("df_term") / F.col("n_docs")).withColumn("z", (F.col("k_in") - F.col("expected_x")) / F.sqrt(F.greatest(z_var, F.lit(1e-12))))
    held = ws.write(held, "held")
    nested = benjamini_hochberg_within(held, by, "p", q) if by else benjamini_hochberg(held, "p", q)
    rated = nested.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if("rejected").alias("n_strict"), F.count_if((F.col("z") > 0) & (F.col("p") < 0.10)).alias("n_lenient"), F.count_if(F.col("z") > 0).alias("n_direction"))
    cats = train.select(*by, "label").distinct().join(rated, [*by, "label"], "left")
    rates = cats.select(*by, "label", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), *[ratio(F.col(f"n_{k}"), F.col("n_terms")).alias(k) for k in ("strict", "lenient", "direction")])
    return rates.withColumn("passes", F.coalesce((F.col("strict") >= 0.5) & (F.col("direction") >= 0.5), F.lit(False))).withColumn("score", F.when(F.col("strict").isNotNull() & F.col("direction").isNotNull(), F.least("strict", "direction")))


def replication_by_run(docs: DataFrame, labels: DataFrame, run: list[str], stop: tuple[str, ...] = (), min_df: int = 3, max_features: int = 6000, q: float = 0.05) -> DataFrame:
    """``heldout_replication`` of every run of ``labels (run..., id, train, label)`` over the texts of ``docs (id, text)``.

    Each run's vocabulary is that of its own training texts.  Texts are cut into terms once,
    whatever the number of runs.
    """
    ws = Workspace(docs.sparkSession, "runs")
    terms_of = ws.write(occurrences(docs, stop, 2, ("id",)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("c")), "terms")
    held = ws.write(labels.join(terms_of, "id"), "incidence")
    counted = held.filter("train").groupBy(*run, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("tf")).filter(F.col("df") >= min_df)
    order = Window.partitionBy(*run).orderBy(F.desc("tf"), "term")
    vocab = ws.write(counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_features).select(*run, "term"), "vocabulary")
    inc = ws.write(held.join(vocab, [*run, "term"]).select(*run, "id", "train", "label", "term"), "known")
    train, test = (ws.write(term_counts(labels.filter(part), inc.filter(part), run), "counts") for part in ("train", "not train"))
    return heldout_replication(train, test, q, run)


def tfidf(counts: DataFrame, n_docs: Column, df_term: Column, tf: Column) -> DataFrame:
    """Adds ``tfidf`` = tf times smooth inverse document frequency, scaled to unit length by label."""
    raw = counts.withColumn("__x", tf * (F.log((1 + n_docs) / (1 + df_term)) + 1))
    w = Window.partitionBy("label")
    return raw.withColumn("tfidf", F.col("__x") / F.sqrt(F.sum(F.col("__x") * F.col("__x")).over(w))).drop("__x")


def npmi_coherence(inc: DataFrame, tops: DataFrame, n_docs: int) -> DataFrame:
    """Mean normalised pointwise mutual information over the pairs of each category's top terms.

    Only documents that hold a top term are joined, and pairs are counted by category.
    """
    flat = tops.select("label", "term")
    docs = inc.select("sentence_id", "term").distinct().join(flat.select("term").distinct(), "term", "left_semi")
    df_term = docs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    pairs = flat.join(flat.select("label", F.col("term").alias("term2")), "label").filter("term < term2")
    other = docs.select("sentence_id", F.col("term").alias("term2"))
    needed = pairs.select("term", "term2").distinct()
    together = needed.join(docs, "term").join(other, ["sentence_id", "term2"]).groupBy("term", "term2").agg(F.count(F.lit(1)).alias("n12"))
    j = pairs.join(together, ["term", "term2"], "left").join(df_term.withColumnRenamed("n", "n1"), "term").join(df_term.select(F.col("term").alias("term2"), F.col("n").alias("n2")), "term2")
    p12 = F.col("n12") / n_docs
    value = F.when(F.col("n12").isNull(), -1.0).when(F.col("n12") == n_docs, 1.0).otherwise(F.log(p12 / ((F.col("n1") / n_docs) * (F.col("n2") / n_docs))) / -F.log(p12))
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(value).alias("npmi"))
