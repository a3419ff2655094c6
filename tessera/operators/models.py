"""Projection, clustering and replicate experiments around the array kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import DEGENERATE_ALIGNED, DEGENERATE_NOISE, resample_degenerate, sweep_degenerate
from tessera.operators import kernels as K

#: Rows a density or hierarchy kernel is fitted on at most; every further row is predicted.
FIT_ROWS = 20_000
#: The same for the judges other than k-means, whose kernels hold full tables of distances.
JUDGE_ROWS = 3000


class Encoder(Protocol):
    """Anything that adds a ``vec`` column to sentences; precomputed vectors are the default."""

    def __call__(self, sentences: DataFrame) -> DataFrame: ...


def precomputed(vectors: DataFrame, key: str = "sentence_id") -> Encoder:
    """Vectors looked up by key, with the check that every sentence has one."""

    def encode(sentences: DataFrame) -> DataFrame:
        missing = sentences.join(vectors.select(key), key, "left_anti").limit(1).count()
        if missing:
            raise ValueError("some sentences have no archived vector")
        return sentences.join(vectors, key)

    return encode


def hashed_encoder(dim: int = 64, text_col: str = "text") -> Encoder:
    """Deterministic fallback: signed feature hashing of terms, scaled to unit length."""
    import zlib

    @F.pandas_udf("array<double>")
    def embed(words: pd.Series) -> pd.Series:
        seen: dict[str, tuple[int, float]] = {}
        out = []
        for ws in words:
            v = np.zeros(dim)
            for w in ws:
                if w not in seen:
                    h = zlib.crc32(w.encode())
                    seen[w] = ((h >> 1) % dim, 1.0 if h & 1 else -1.0)
                k, s = seen[w]
                v[k] += s
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    from tessera.functions.text import terms

    return lambda sentences: sentences.withColumn("vec", embed(terms(F.col(text_col))))


def project(df: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """Adds ``proj array<double>``: principal components, fitted on all rows in one aggregation.

    Stands for the manifold projection, which no distributed realisation reproduces; signs
    are fixed so that each component's largest loading is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(df.select(array_to_vector(F.col(vec)).alias("__v")))
    signs = [1.0 if c[np.abs(c).argmax()] >= 0 else -1.0 for c in model.pc.toArray().T]
    out = model.transform(df.withColumn("__v", array_to_vector(F.col(vec)))).withColumn("__a", vector_to_array("__p"))
    return out.withColumn("proj", F.array(*[F.col("__a")[i] * signs[i] for i in range(k)])).drop("__v", "__p", "__a")


def _fit_rows(df: DataFrame, id_col: str, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ids and projections to fit on: all rows, or the ``limit`` first in hash order where there are more."""
    n = df.count()
    rows = df.select(id_col, "proj") if n <= limit else df.select(id_col, "proj").orderBy(F.xxhash64(F.lit("fit"), id_col), id_col).limit(limit)
    pdf = rows.toPandas().sort_values(id_col)
    return pdf[id_col].to_numpy(), np.array(pdf["proj"].tolist(), float) if len(pdf) else np.zeros((0, 1)), n > limit


def density_partition(df: DataFrame, smallest: int, id_col: str = "id", limit: int = FIT_ROWS) -> DataFrame:
    """``(id, label)`` of rows with ``proj``: density clusters, noise -1.

    The hierarchy is fitted on at most ``limit`` rows; every row then gets the label of the
    nearest fitted row by mutual reachability (fitted rows keep their own).
    """
    spark = df.sparkSession
    ids, x, more = _fit_rows(df, id_col, limit)
    labels, info = K.density_clusters(x, smallest)
    if not more:
        return spark.createDataFrame(pd.DataFrame({id_col: ids, "label": labels.astype("int32")}), f"`{id_col}` bigint, label int")
    fitted = spark.sparkContext.broadcast((ids, x, labels, info["core"]))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f_ids, f_x, f_labels, f_core = fitted.value
        own = dict(zip(f_ids.tolist(), f_labels.tolist()))
        for pdf in batches:
            got = K.predict_density(f_x, f_labels, f_core, np.array(pdf["proj"].tolist(), float), smallest)
            yield pd.DataFrame({id_col: pdf[id_col], "label": [own.get(i, g) for i, g in zip(pdf[id_col].tolist(), got.tolist())]})

    return df.select(id_col, "proj").mapInPandas(predict, f"`{id_col}` bigint, label int")


def granularity_sweep(df: DataFrame, sizes: list[int], id_col: str = "id", limit: int = FIT_ROWS) -> DataFrame:
    """``(mcs, n_clusters, noise, largest, dbcv, degenerate, n_fit, n_rows)``: one task for each setting over the shared fit rows.

    All figures are those of the ``n_fit`` rows fitted on, out of ``n_rows``.
    """
    spark = df.sparkSession
    _, x, _ = _fit_rows(df, id_col, limit)
    n_rows = df.count()
    shared = spark.sparkContext.broadcast(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m in pdf["mcs"]:
                labels, info = K.density_clusters(shared.value, int(m))
                sizes_ = np.bincount(labels[labels >= 0]) if (labels >= 0).any() else np.array([0])
                noise, k = float((labels < 0).mean()), int((sizes_ > 0).sum())
                rows.append((int(m), k, noise, int(sizes_.max()), K.relative_validity(info["tree"], labels), sweep_degenerate(k, noise), len(labels), n_rows))
            yield pd.DataFrame(rows, columns=["mcs", "n_clusters", "noise", "largest", "dbcv", "degenerate", "n_fit", "n_rows"])

    settings = spark.createDataFrame([(m,) for m in sizes], "mcs int").repartition(len(sizes), "mcs")
    return settings.mapInPandas(run, "mcs int, n_clusters int, noise double, largest int, dbcv double, degenerate boolean, n_fit int, n_rows bigint")


def kmeans_best(df: DataFrame, k: int, restarts: int = 10, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``(id, label)`` of the best of several k-means runs by training cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(id_col, array_to_vector("proj").alias("features")).cache()
    models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="label").fit(data) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return best.transform(data).select(id_col, F.col("label").cast("int").alias("label"))


def judge_partitions(df: DataFrame, k: int, smallest: int, id_col: str = "id", limit: int = FIT_ROWS) -> DataFrame:
    """``(judge, id, label)`` of alternative models: Ward, OPTICS, neighbour-graph communities, k-means.

    All but k-means are fitted on at most ``JUDGE_ROWS`` rows; every further row gets the label
    of the nearest fitted row, so all judges label all rows.
    """
    spark = df.sparkSession
    ids, x, more = _fit_rows(df, id_col, min(limit, JUDGE_ROWS))
    shared = spark.sparkContext.broadcast(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for judge in pdf["judge"]:
                x = shared.value
                if judge == "ward":
                    labels = K.ward(x, k)
                elif judge == "optics":
                    labels = K.optics(x, max(5, smallest // 3))
                else:
                    near = np.argsort(K.pairwise(x), axis=1, kind="stable")[:, 1:16]
                    labels = K.louvain(len(x), np.array([(a, b, 1.0) for a, bs in enumerate(near) for b in bs if a < b]))
                yield pd.DataFrame({"judge": judge, id_col: ids, "label": labels.astype("int32")})

    names = spark.createDataFrame([("ward",), ("optics",), ("communities",)], "judge string").repartition(3, "judge")
    alt = names.mapInPandas(run, f"judge string, `{id_col}` bigint, label int")
    if more:
        # the labels of the fit rows, at most JUDGE_ROWS for each judge
        pdf = alt.toPandas().sort_values(["judge", id_col])
        fitted = spark.sparkContext.broadcast((ids, x, {j: g["label"].to_numpy() for j, g in pdf.groupby("judge")}))

        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f_ids, f_x, f_labels = fitted.value
            own = {i: k for k, i in enumerate(f_ids.tolist())}
            for pdf in batches:
                new, here = np.array(pdf["proj"].tolist(), float), pdf[id_col].to_numpy()
                for at in range(0, len(here), 1024):
                    part = here[at : at + 1024]
                    near = K.pairwise(new[at : at + 1024], f_x).argmin(1)
                    near = np.array([own.get(i, k) for i, k in zip(part.tolist(), near.tolist())])
                    for judge, labels in f_labels.items():
                        yield pd.DataFrame({"judge": judge, id_col: part, "label": labels[near].astype("int32")})

        alt = df.select(id_col, "proj").mapInPandas(predict, f"judge string, `{id_col}` bigint, label int")
    return alt.unionByName(kmeans_best(df, k, id_col=id_col).select(F.lit("kmeans").alias("judge"), id_col, "label"))


def _best_jaccard(ref: np.ndarray, got: np.ndarray, labels: list[int]) -> list[tuple[float, int]]:
    out = []
    for c in labels:
        mine = ref == c
        best = (0.0, -1)
        for g in np.unique(got[(got >= 0) & mine]):
            both = int((mine & (got == g)).sum())
            j = both / (mine.sum() + (got == g).sum() - both)
            if j > best[0]:
                best = (j, int(g))
        out.append(best)
    return out


def _replicates(spark, n: int):
    return spark.range(n).select(F.col("id").cast("int").alias("replicate")).repartition(min(n, 64), "replicate")


_REPLICATE = "replicate int, category int, jaccard double, matched int, status string, n_fit int, n_rows bigint"


def _experiment(df: DataFrame, partition: DataFrame, replicates: int, body: Callable, id_col: str, limit: int) -> DataFrame:
    """Replicates as rows: each task repeats ``body`` over the broadcast fit rows (bounded by ``limit``).

    ``n_fit`` of ``n_rows`` rows take part.
    """
    spark = df.sparkSession
    n_rows = df.count()
    ids, x, _ = _fit_rows(df, id_col, limit)
    known = {r[id_col]: r["label"] for r in partition.join(spark.createDataFrame(pd.DataFrame({id_col: ids})), id_col).collect()}
    ref = np.array([known.get(i, -1) for i in ids.tolist()])
    shared = spark.sparkContext.broadcast((x, ref))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, ref = shared.value
            cats = sorted(set(ref.tolist()) - {-1})
            for r in pdf["replicate"]:
                rows = body(int(r), x, ref, cats)
                yield pd.DataFrame([(int(r), c, j, m, s, len(x), n_rows) for c, (j, m, s) in zip(cats, rows)], columns=["replicate", "category", "jaccard", "matched", "status", "n_fit", "n_rows"])

    return _replicates(spark, replicates).mapInPandas(run, _REPLICATE)


def resampling_stability(df: DataFrame, partition: DataFrame, smallest: int, replicates: int = 30, share: float = 0.8, seed: int = 42, id_col: str = "id", limit: int = 5000, least_clusters: int = 10) -> DataFrame:
    """Best Jaccard of each category when the rows are subsampled and clustered again.

    A replicate with too few clusters or hardly any noise is degenerate: its values stay, its status says so.
    Replicate r draws from generator ``[seed, r]``, so a longer roster begins with a shorter one.
    """

    def body(r, x, ref, cats):
        rng = np.random.default_rng([seed, r])
        take = np.sort(rng.choice(len(x), int(round(share * len(x))), replace=False))
        got, _ = K.density_clusters(x[take], smallest)
        status = "degenerate" if resample_degenerate(len(set(got.tolist()) - {-1}), float((got < 0).mean()), least_clusters) else "ok"
        return [(j, m, status) for j, m in _best_jaccard(ref[take], got, cats)]

    return _experiment(df, partition, replicates, body, id_col, limit)


def geometry_separability(df: DataFrame, partition: DataFrame, per_category: int = 15, replicates: int = 100, seed: int = 42, id_col: str = "id", limit: int = 5000) -> DataFrame:
    """Best Jaccard when equally many rows of each category are grouped by Ward into as many groups."""

    def body(r, x, ref, cats):
        rng = np.random.default_rng([seed, r])
        take = np.concatenate([rng.choice(np.nonzero(ref == c)[0], min(per_category, int((ref == c).sum())), replace=False) for c in cats]) if cats else np.zeros(0, int)
        got = K.ward(x[take], len(cats)) if len(take) else np.zeros(0, int)
        return [(j, m, "ok") for j, m in _best_jaccard(ref[take], got, cats)]

    return _experiment(df, partition, replicates, body, id_col, limit)


def _refit(x: np.ndarray, ref: np.ndarray, ses: np.ndarray, seed: int, mcs: int, train_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """One run: training rows, table of categories by clusters, labels of all rows, and the cluster aligned to each category's place.

    Clusters are fitted on the training sessions and aligned by the assignment of greatest
    overlap; all other rows are predicted.
    """
    names, cats = np.array(sorted(set(ses.tolist()))), sorted(set(ref.tolist()) - {-1})
    train = np.isin(ses, np.random.default_rng(seed).choice(names, int(round(train_share * len(names))), replace=False))
    got, info = K.density_clusters(x[train], mcs)
    k = got.max() + 1 if len(got) else 0
    table = np.array([[((ref[train] == c) & (got == g)).sum() for g in range(k)] for c in cats]) if k and cats else np.zeros((len(cats), 0))
    pairs = {a: b for a, b in K.hungarian(table.astype(float)) if table[a, b] > 0} if table.size else {}
    raw = np.full(len(x), -1)
    raw[train] = got
    if train.any() and not train.all():
        raw[~train] = K.predict_density(x[train], got, info["core"], x[~train], mcs)
    return train, table, raw, pairs


def _fit_table(df: DataFrame, partition: DataFrame, id_col: str, session: str, limit: int):
    """Ids, projections, reference labels and sessions of at most ``limit`` rows in hash order, and the number of all."""
    pdf = df.select(id_col, "proj", session).orderBy(F.xxhash64(id_col), id_col).limit(limit).join(partition, id_col).toPandas().sort_values(id_col)
    return pdf[id_col].to_numpy(), np.array(pdf["proj"].tolist(), float), pdf["label"].to_numpy(), pdf[session].to_numpy(), df.count()


def _grid(spark, seeds: int, sizes: list[int]) -> DataFrame:
    grid = spark.range(seeds).select(F.col("id").cast("int").alias("seed"), F.explode(F.array(*[F.lit(m) for m in sizes])).alias("mcs"))
    return grid.repartition(min(64, seeds * len(sizes)))


def factorial(df: DataFrame, partition: DataFrame, seeds: int, sizes: list[int], id_col: str = "id", session: str = "session", train_share: float = 0.7, limit: int = 5000) -> DataFrame:
    """Refit on training sessions, align by greatest overlap, predict the rest: one row a run and category.

    Columns: ``seed, mcs, category, reconstructed, overlap, held_share, n_fit, n_rows``; a category
    without an aligned cluster is not reconstructed and has null, never 0.
    """
    spark = df.sparkSession
    _, *held, n_rows = _fit_table(df, partition, id_col, session, limit)
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in batches:
            x, ref, ses = shared.value
            cats = sorted(set(ref.tolist()) - {-1})
            for s, m in zip(chunk["seed"], chunk["mcs"]):
                train, table, raw, pairs = _refit(x, ref, ses, int(s), int(m), train_share)
                rows = []
                for a, c in enumerate(cats):
                    mine = (ref == c) & ~train
                    share = float((raw[mine] == pairs[a]).mean()) if a in pairs and mine.any() else None
                    rows.append((int(s), int(m), c, a in pairs, float(table[a, pairs[a]] / max(1, ((ref == c) & train).sum())) if a in pairs else None, share, len(x), n_rows))
                yield pd.DataFrame(rows, columns=["seed", "mcs", "category", "reconstructed", "overlap", "held_share", "n_fit", "n_rows"])

    return _grid(spark, seeds, sizes).mapInPandas(run, "seed int, mcs int, category int, reconstructed boolean, overlap double, held_share double, n_fit int, n_rows bigint")


def factorial_labels(df: DataFrame, partition: DataFrame, seeds: int, sizes: list[int], id_col: str = "id", session: str = "session", train_share: float = 0.7, limit: int = 5000) -> DataFrame:
    """``(seed, mcs, id, train, label)`` of every run of ``factorial``: its labels under the names of the categories they are aligned to, else -1."""
    spark = df.sparkSession
    *held, _ = _fit_table(df, partition, id_col, session, limit)
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in batches:
            ids, x, ref, ses = shared.value
            cats = sorted(set(ref.tolist()) - {-1})
            for s, m in zip(chunk["seed"], chunk["mcs"]):
                train, _, raw, pairs = _refit(x, ref, ses, int(s), int(m), train_share)
                label = np.full(len(x), -1)
                for a, g in pairs.items():
                    label[raw == g] = cats[a]
                yield pd.DataFrame({"seed": int(s), "mcs": int(m), "id": ids, "train": train, "label": label})

    return _grid(spark, seeds, sizes).mapInPandas(run, "seed int, mcs int, id bigint, train boolean, label int")


def replication_runs(labels: DataFrame, rates: DataFrame, run: list[str], categories: int) -> DataFrame:
    """One row a run: aligned categories, training noise, degeneracy, categories without estimate, and passes.

    ``labels`` are those of ``factorial_labels``, ``rates`` those of ``replication_by_run``.
    """
    inside = labels.filter("train").groupBy(*run).agg(
        F.countDistinct(F.when(F.col("label") != -1, F.col("label"))).alias("aligned"), F.count(F.lit(1)).alias("train_total"), F.count_if(F.col("label") != -1).alias("train_assigned")
    )
    passed = rates.groupBy(*run).agg(F.count_if("passes").alias("n_pass"), F.count_if(F.col("strict").isNotNull()).alias("n_estimated"))
    noise = 1 - F.col("train_assigned") / F.col("train_total")
    out = inside.join(passed, run, "left").withColumn("noise", F.round(noise, 6))
    degenerate = (F.col("aligned") < DEGENERATE_ALIGNED) | (noise < DEGENERATE_NOISE)
    return out.withColumn("degenerate", degenerate).withColumn("n_pass", F.coalesce("n_pass", F.lit(0))).withColumn("n_not_reconstructed", F.lit(categories) - F.coalesce("n_estimated", F.lit(0))).drop("n_estimated")


def replication_margins(rates: DataFrame, runs: DataFrame, run: list[str], threshold: float = 0.5) -> DataFrame:
    """``(label, n, median_margin, min_margin, max_margin, n_within_0_05)`` of the viable runs' distance to the pass threshold."""
    margin = F.least(F.col("strict"), F.col("direction")) - threshold
    alive = rates.filter("strict is not null and direction is not null").join(runs.filter("not degenerate").select(*run), run).withColumn("m", margin)
    return alive.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.percentile("m", 0.5).alias("median_margin"), F.min("m").alias("min_margin"), F.max("m").alias("max_margin"), F.count_if(F.abs("m") <= 0.05).alias("n_within_0_05"))


def best_mapping(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels ``b`` renamed to those of ``a`` by the assignment of greatest overlap; -1 for labels left over."""
    table = np.array([[((a == i) & (b == j)).sum() for j in range(b.max() + 1)] for i in range(a.max() + 1)], float)
    names = {j: i for i, j in K.hungarian(table)}
    return np.array([names.get(int(v), -1) for v in b])


def agreement_by_chance(n: int, k: int, trials: int = 2000, seed: int = 42) -> float:
    """Mean agreement, under the best renaming, of two labelings drawn at random from ``k`` labels each."""
    if not n:
        return 0.0
    rng = np.random.default_rng(seed)
    drawn = ((rng.integers(0, k, n), rng.integers(0, k, n)) for _ in range(trials))
    return float(np.mean([(best_mapping(a, b) == a).mean() for a, b in drawn]))


def category_groups(cents: DataFrame, k: int = 4, edge: float = 0.5, trials: int = 2000, seed: int = 42) -> DataFrame:
    """``(label, ward, louvain, louvain_as_ward, agreement, chance)`` of the categories' centroids (some dozens).

    Louvain groups are renamed to Ward groups by the assignment of greatest overlap; ``chance``
    is the mean agreement of as many random labelings.
    """
    pdf = cents.select("label", "vec").toPandas().sort_values("label")
    x, n = np.array(pdf["vec"].tolist(), float), len(pdf)
    w = K.ward(x, k)
    sim = x @ x.T
    graph = [(a, b, sim[a, b]) for a in range(n) for b in range(a + 1, n) if sim[a, b] >= edge]
    lv = K.louvain(n, np.array(graph) if graph else np.zeros((0, 3)))

    renamed = best_mapping(w, lv)
    chance = agreement_by_chance(n, k, trials, seed)
    rows = [(int(c), int(a), int(b), int(r), float((renamed == w).mean()), chance) for c, a, b, r in zip(pdf["label"], w, lv, renamed)]
    return cents.sparkSession.createDataFrame(rows, "label int, ward int, louvain int, louvain_as_ward int, agreement double, chance double")


def ward_cut_profile(cents: DataFrame, cuts: tuple[int, ...] = (2, 3, 4, 5, 6, 8, 10)) -> DataFrame:
    """Group sizes of Ward's tree at several cuts; cuts of as many groups as categories are left out."""
    pdf = cents.select("label", "vec").toPandas().sort_values("label")
    x = np.array(pdf["vec"].tolist(), float)
    merges = K.ward_merges(x)
    rows = [(k, sorted(np.bincount(K.cut(merges, len(x), k)).tolist(), reverse=True)) for k in cuts if k < len(x)]
    return cents.sparkSession.createDataFrame(rows, "k int, sizes array<int>")


def subgroups(df: DataFrame, k: int = 3, fit_rows: int = 2000, id_col: str = "id") -> DataFrame:
    """``(label, id, sub)``: Ward's ``k`` groups within each category of ``(id, label, proj)``.

    The tree of a category is fitted on its first ``fit_rows`` rows in hash order, which
    bounds what a task holds; every row then joins the group whose mean is nearest.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(F.xxhash64(F.lit("fit"), id_col), id_col)
    fit = df.select("label", id_col, "proj").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= fit_rows).drop("rn")

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        x = np.array(pdf["proj"].tolist(), float)
        got = K.ward(x, k)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "sub": np.arange(got.max() + 1), "mu": [x[got == g].mean(0).tolist() for g in range(got.max() + 1)]})

    centres = fit.groupBy("label").applyInPandas(means, "label int, sub int, mu array<double>")
    packed = centres.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("sub", "mu"))).alias("cs"))
    far = F.transform("cs", lambda c: F.struct(F.aggregate(F.zip_with("proj", c["mu"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"), c["sub"].alias("sub")))
    return df.join(packed, "label").select("label", id_col, F.array_min(far)["sub"].alias("sub"))
