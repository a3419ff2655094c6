"""Similarity clusters of millions of records: parallel pivot correlation clustering.

A record is a set of keys, two records are similar when they share one, and records of
equal keys are one profile.  In rounds, every open profile whose hash is the smallest among
its open neighbours becomes a pivot and absorbs the neighbours that see no smaller pivot.
Neighbourhoods are never listed: a round aggregates minima by key and joins them back, so
its cost is that of the keys, not of the pairs, and a key in very many profiles is
pre-aggregated.

Each cluster is then described by its medoid, the member whose keys most members share.
Medoids are clustered by another run of the same rounds; the pivots that remain share no
key with each other, so every profile compares itself with at most one of them a key when
it moves to the closest.

What sentences share is learned from all of them.  Telling of the same incident means
agreeing on so many particulars that chance does not explain it: a particular is a word
or a phrase few sentences hold, and three of them are a key if fewer than a given number
of pairs of sentences would share all three by chance.  A theme is a pair of neighbouring
telling words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.plans.lineage import Workspace
from tessera.sources.tables import single_deliveries

#: A placeholder, a word with its apostrophes and hyphens, or a mark.
TOKEN = r"<\w+>|[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Words and marks of a text in lower case, genitive endings off."""
    plain = F.regexp_replace(F.lower(text), r"(?<=[\p{L}\p{N}])['’]s(?![\p{L}\p{N}])", "")
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _worded(x: Column) -> Column:
    return x.rlike(r"^\p{L}")


def particulars(ws: Workspace, rows: DataFrame, most_share: float = 0.006, phrase_share: float = 0.0005, reach: int = 16) -> tuple[DataFrame, int]:
    """``(id, at, stretch, word, weight)``: the particulars of records ``(id, text)``, in the order of the text, and the number of records.

    A particular is a word that ``most_share`` of the records or fewer hold, in two records at
    least, or two frequent words that are found together: in ``phrase_share`` to ``most_share``
    of the records, and a fifth of those with the rarer word.  Particulars without another word
    or mark between stand in one ``stretch``, as do words that are found together.  ``weight``
    is the negative logarithm of the share of records with the particular.  A word said again
    within ``reach`` particulars counts once.
    """
    spark = rows.sparkSession
    words = ws.write(rows.select("id", tokens(F.col("text")).alias("w")), "words")
    total = max(1, words.count())
    held = words.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # with the words of an average record, at most that many over the share can pass each of the filters
    known = ws.write(held.filter((F.col("n") >= phrase_share * total) & _worded(F.col("word"))), "frequent")
    two = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.element_at("w", i + 2).alias("b")))
    pairs = words.select(F.explode(F.array_distinct(two)).alias("p")).select("p.*").filter(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.filter(F.col("n") >= phrase_share * total).join(known.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(known.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    common = {r["word"] for r in known.filter(F.col("n") > 0.05 * total).select("word").collect()}
    frequent = {r["word"] for r in known.filter(F.col("n") > most_share * total).select("word").collect()}
    together = {(r["a"], r["b"]): r["n"] for r in pairs.filter("5 * n >= least(n_a, n_b)").collect() if r["a"] not in common and r["b"] not in common}
    shared = spark.sparkContext.broadcast((frequent, together, most_share * total))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, bound, most = shared.value
        number: dict[str, int] = {}
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            out = []
            for row, found in enumerate(batch.column(1).to_pylist()):
                stretch, last, at, prev, seen = 0, False, 0, "", {}
                for x in found:
                    if x == prev:
                        continue  # said again at once
                    joined = bound.get((prev, x), 0)
                    telling = x[0].isalpha() and x not in often
                    stretch += not (joined or last and telling)
                    said = [x] if telling else [f"{prev} {x}"] if 0 < joined <= most and not last else []
                    for word in said:
                        if at - seen.get(word, -reach) >= reach:
                            h = number.get(word)
                            if h is None:
                                if len(number) > 500_000:
                                    number.clear()
                                h = number[word] = _hash(word)
                            seen[word] = at
                            out.append((row, at, stretch, h))
                            at += 1
                    prev, last = x, telling
            got = np.array(out, np.int64).reshape(-1, 4)
            rest = [pa.array(got[:, 1].astype(np.int32)), pa.array(got[:, 2].astype(np.int32)), pa.array(got[:, 3])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(got[:, 0])), *rest], names=["id", "at", "stretch", "word"])

    id_type = rows.schema["id"].dataType.simpleString()
    found = ws.write(words.mapInArrow(read, f"id {id_type}, at int, stretch int, word bigint"), "found")
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2) & (F.col("n") <= most_share * total))
    return found.join(counted, "word").select("id", "at", "stretch", "word", (F.lit(math.log(total)) - F.log("n")).alias("weight")), total


def agreement_keys(found: DataFrame, total: int, expected: float, reach: int = 16) -> DataFrame:
    """``(id, keys)``: hashes of every three particulars of a record that tell by their agreement.

    They come from three stretches, no further than ``reach`` particulars apart, and of all
    pairs of ``total`` records fewer than ``expected`` would share them by chance.
    """
    least = 2 * math.log(max(1, total)) - math.log(2 * expected)
    u = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "stretch", "word", "weight"))).alias("u"))

    def apart(x: Column, y: Column) -> Column:
        return (x["stretch"] != y["stretch"]) & (x["word"] != y["word"])

    def third(x: Column, y: Column, rest: Column) -> Column:
        fit = F.filter(rest, lambda z: apart(x, z) & apart(y, z) & (x["weight"] + y["weight"] + z["weight"] >= least))
        return F.transform(fit, lambda z: F.xxhash64(F.array_sort(F.array(x["word"], y["word"], z["word"]))))

    def second(x: Column, near: Column) -> Column:
        return F.flatten(F.transform(near, lambda y, j: F.when(apart(x, y), third(x, y, F.slice(near, j + 2, reach))).otherwise(F.array().cast("array<bigint>"))))

    keys = F.flatten(F.transform("u", lambda x, i: second(x, F.slice("u", i + 2, reach))))
    return u.select("id", F.array_distinct(keys).alias("keys")).filter(F.size("keys") > 0)


def incident_keys(corpus: DataFrame, expected: float = 6.0, most_share: float = 0.006) -> DataFrame:
    """``(sentence_id, keys array<bigint>)`` of the sentences that agree with another one beyond chance."""
    ws = Workspace(corpus.sparkSession, "incidents")
    rows = single_deliveries(corpus.select("sentence_id", "text").filter("sentence_id is not null and text is not null"), "sentence_id").withColumnRenamed("sentence_id", "id")
    found, total = particulars(ws, rows, most_share)
    keys = ws.write(agreement_keys(found, total, expected).select("id", F.explode("keys").alias("key")), "keys")
    again = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return keys.join(again, "key").groupBy(F.col("id").alias("sentence_id")).agg(F.array_sort(F.collect_list("key")).alias("keys"))


def pivot_rounds(ws: Workspace, profiles: DataFrame) -> DataFrame:
    """``(pid, pivot)`` of profiles ``(pid bigint, key bigint)``, a row a key; a pivot's own row names itself.

    The order of pivots is the hash of ``pid``, so the result depends on the data alone.  A
    profile without keys has one row with a null.  Rounds grow with the logarithm of the
    profiles; they go on until every profile has its pivot.
    """
    open_ = ws.write(profiles.select("pid", F.xxhash64(F.lit("pivot"), "pid").alias("rank"), "key"), "open")
    done = []
    while not open_.isEmpty():
        least = open_.filter("key is not null").groupBy("key").agg(F.min("rank").alias("least"))
        seen = open_.join(least, "key", "left").groupBy("pid", "rank").agg(F.min("least").alias("least"))
        pivots = ws.write(seen.filter("least is null or least = rank").select(F.col("pid").alias("pivot"), "rank"), "pivots")
        by_key = open_.join(pivots, "rank").filter("key is not null").groupBy("key").agg(F.min(F.struct("rank", "pivot")).alias("chosen"))
        near = open_.join(by_key, "key").groupBy("pid").agg(F.min("chosen").alias("chosen")).select("pid", "chosen.pivot")
        alone = pivots.select(F.col("pivot").alias("pid"), "pivot")
        assigned = ws.write(near.join(alone, "pid", "left_anti").unionByName(alone), "assigned")
        done.append(assigned)
        rest = ws.write(open_.join(assigned, "pid", "left_anti"), "open")
        ws.drop(open_)
        open_ = rest
    if not done:
        return open_.select("pid", F.col("pid").alias("pivot"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return ws.write(out, "clusters")


def pivot_clusters(records: DataFrame, id_col: str) -> DataFrame:
    """``(id, cluster, agreement)`` of records ``(id, keys array<bigint>)``; similar records share a key.

    ``cluster`` is the number of one of its profiles, ``agreement`` the number of times the
    cluster's records hold the keys of this one, so the medoid has the highest.  A record
    that shares no key stands with records of equal keys alone.  Keys must be sorted and
    distinct; a record of null or empty keys gives no row.
    """
    ws = Workspace(records.sparkSession, "pivot")
    held = ws.write(records.filter(F.size("keys") > 0).select(id_col, "keys", F.xxhash64("keys").alias("pid")), "records")
    profiles = ws.write(held.groupBy("pid").agg(F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("n")), "profiles")
    keyed = ws.write(profiles.select("pid", "n", F.explode("keys").alias("key")), "keyed")
    first = pivot_rounds(ws, keyed.select("pid", "key"))

    def agreement(clusters: DataFrame) -> DataFrame:
        """``(pid, pivot, agreement)``: how often a profile's keys are held in its cluster."""
        members = keyed.join(clusters, "pid")
        count = members.groupBy("pivot", "key").agg(F.sum("n").alias("held"))
        return members.join(count, ["pivot", "key"]).groupBy("pid", "pivot").agg(F.sum("held").alias("agreement"))

    best = F.max(F.struct("agreement", (-F.col("pid")).alias("minus"))).alias("best")
    medoids = ws.write(agreement(first).groupBy("pivot").agg(best).select("pivot", (-F.col("best.minus")).alias("pid")), "medoids")
    merged = pivot_rounds(ws, keyed.join(medoids, "pid").select("pid", "key"))
    # pivots of the last rounds share no key, so each key of a profile meets one of them at most
    tops = keyed.join(merged.filter("pid = pivot").select("pid"), "pid").select("key", F.col("pid").alias("top"))
    met = keyed.join(tops, "key").groupBy("pid", "top").agg(F.count(F.lit(1)).alias("met"))
    closest = met.groupBy("pid").agg(F.max(F.struct("met", (-F.col("top")).alias("minus"))).alias("best")).select("pid", (-F.col("best.minus")).alias("closest"))
    whole = medoids.select(F.col("pivot"), F.col("pid").alias("medoid")).join(merged.select(F.col("pid").alias("medoid"), F.col("pivot").alias("whole")), "medoid").select("pivot", "whole")
    final = first.join(whole, "pivot").join(closest, "pid", "left").select("pid", F.coalesce("closest", "whole").alias("pivot"))
    final = ws.write(agreement(ws.write(final, "final")), "described")
    return held.join(final, "pid").select(id_col, F.col("pivot").alias("cluster"), "agreement")


def same_incident(corpus: DataFrame, expected: float = 6.0, most_share: float = 0.006) -> DataFrame:
    """``(sentence_id_a, sentence_id_b)``: sentences of one cluster that agree on three particulars beyond chance.

    Smaller id first; repeated deliveries count once.  Rows with a null id or text are in no
    pair; an empty table gives none.  In a small corpus (some thousand sentences) few
    agreements are beyond chance, so little is found there.
    """
    ws = Workspace(corpus.sparkSession, "pairs")
    records = ws.write(incident_keys(corpus, expected, most_share), "records")
    found = pivot_clusters(records, "sentence_id").select("sentence_id", "cluster")
    held = ws.write(records.join(found, "sentence_id").select("sentence_id", "cluster", F.explode("keys").alias("key")), "members")
    a, b = (held.select(F.col("sentence_id").alias(f"sentence_id_{x}"), "cluster", "key") for x in "ab")
    return a.join(b, ["cluster", "key"]).filter("sentence_id_a < sentence_id_b").select("sentence_id_a", "sentence_id_b").distinct()


def theme_keys(corpus: DataFrame, least_share: float = 0.0005, most_share: float = 0.05) -> DataFrame:
    """``(sentence_id, keys)``: hashes of the pairs of neighbouring words that tell what a sentence says.

    Names, numbers and words of at most ``least_share`` of all sentences are passed over, as are
    words of more than ``most_share``; what is left, in the order of the text, is what the
    sentence says, whoever it says it of.  Where that leaves no pair, rare words count too, and
    where there is none then, the lower-cased text as a whole, white space unified.  Null texts
    have no row.
    """
    ws = Workspace(corpus.sparkSession, "themes")
    rows = single_deliveries(corpus.select("sentence_id", "text").filter("sentence_id is not null and text is not null"), "sentence_id")
    words = ws.write(rows.select("sentence_id", terms(F.col("text")).alias("w"), F.xxhash64(F.regexp_replace(F.lower(F.trim("text")), r"(?U)\s+", " ")).alias("whole")), "words")
    total = words.count()
    # with the words of an average sentence, at most that many over the share can pass
    held = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least_share * total)
    frequent = held.select("term", (F.col("n") > most_share * total).alias("common")).collect()
    common = frozenset(r["term"] for r in frequent if r["common"])
    telling = frozenset(r["term"] for r in frequent if not r["common"] and not r["term"].isnumeric())
    shared = corpus.sparkSession.sparkContext.broadcast((telling, common))

    @F.pandas_udf("array<bigint>")
    def neighbours(w: pd.Series, whole: pd.Series) -> pd.Series:
        keep, passed = shared.value
        out = []
        for said, all_ in zip(w, whole):
            t = [x for x in said if x in keep]
            if len(t) < 2:
                t = [x for x in said if x not in passed and not x.isnumeric()]
            out.append(sorted({_hash(f"{a} {b}") for a, b in zip(t, t[1:])}) or [all_])
        return pd.Series(out)

    return words.select("sentence_id", neighbours("w", "whole").alias("keys"))


def theme_clusters(corpus: DataFrame, typical: int = 3) -> DataFrame:
    """``(cluster, size, n_sessions, typical)``: groups of sentences that say the same, with their most typical sentences.

    Sentences that share a pair of telling words may be grouped; ``typical`` are the ids of the
    sentences whose pairs most of the group shares, ties by id.
    """
    clusters = pivot_clusters(theme_keys(corpus), "sentence_id")
    sessions = single_deliveries(corpus.select("sentence_id", "session").filter("sentence_id is not null"), "sentence_id")
    joined = Workspace(corpus.sparkSession, "typical").write(clusters.join(sessions, "sentence_id"), "joined")
    size = joined.groupBy("cluster", "session").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.sum("n").alias("size"), F.count("session").alias("n_sessions"))
    # a filter on a rank keeps the first few a task before anything is shuffled
    order = Window.partitionBy("cluster").orderBy(F.desc("agreement"), "sentence_id")
    ranked = joined.select("cluster", "sentence_id", F.row_number().over(order).alias("r")).filter(F.col("r") <= typical)
    first = ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "sentence_id"))), lambda x: x["sentence_id"]).alias("typical"))
    return size.join(first, "cluster").select("cluster", "size", "n_sessions", "typical")
