"""Sentence corpora: loading, masking, provenance, checks, pairing of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.math import r6, ratio
from tessera.functions.text import strip_ws, token_count
from tessera.operators.ordering import positional_ids

#: Fields that are carried along where the input has them (fixed values).
PROVENANCE = ("video_id", "video_url", "video_title", "channel", "upload_date", "series", "license_spdx")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, with the missing names, if a mandatory column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def load_sentences(df: DataFrame, order: list[str], text_field: str = "text", session_field: str = "session", min_tokens: int = 1, head: int | None = None) -> DataFrame:
    """Strip, count tokens, drop short sentences, number the rest 0, 1, 2 ... in ``order``.

    A missing session column or value becomes ``all``; null texts go; provenance fields are
    kept where present.  ``head`` keeps the first rows before numbering (a feature for trials).
    """
    require_columns(df, text_field)
    session = F.coalesce(F.col(session_field), F.lit("all")) if session_field in df.columns else F.lit("all")
    out = df.withColumn("text", strip_ws(F.col(text_field))).filter(F.col("text").isNotNull())
    out = out.withColumn("session", session).withColumn("token_count", token_count(F.col("text"))).filter(F.col("token_count") >= min_tokens)
    if head is not None:
        out = out.orderBy(*order).limit(head)
    carried = [c for c in PROVENANCE if c in df.columns and c not in order]
    numbered = positional_ids(out.select(*dict.fromkeys([*order, "session", "text", "token_count", *carried])), order, "position")
    return numbered


def provenance_table(df: DataFrame, meta: list[str]) -> DataFrame:
    """Sentences and share of the corpus for each session, with its (constant) metadata."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.groupBy("session").agg(F.count(F.lit(1)).alias("n"), *[F.min(m).alias(m) for m in meta])
    return rows.crossJoin(F.broadcast(total)).withColumn("pct", F.bround(100 * ratio(F.col("n"), F.col("total")), 1)).drop("total")


#: Classes that leave a placeholder; names of any other class leave a space.
ENTITY_CLASSES = ("PERSON", "TEAM", "PLACE")


def mask_expression(text: Column, patterns: list[tuple[str, str]], classes: tuple[str, ...] = ENTITY_CLASSES) -> Column:
    """Masking by a short list of (variant, class), as nested replacements in the JVM.

    Longest variants first, stable among equals; case-insensitive at word boundaries with a
    trailing possessive; a class outside ``classes`` leaves a space; white space is squeezed
    at the end.
    """
    out = text
    for variant, cls in sorted((p for p in patterns if len(p[0]) >= 2), key=lambda p: -len(p[0])):
        escaped = "".join("\\" + c if not c.isalnum() and c != " " else c for c in variant)
        out = F.regexp_replace(out, rf"(?iu)\b{escaped}\b('s)?", f"<{cls}>" if cls in classes else " ")
    return strip_ws(F.regexp_replace(out, r"(?U)\s+", " "))


def mask_sentences(df: DataFrame, gazetteer: DataFrame, id_col: str = "sentence_id", text_col: str = "text", max_variants: int = 200_000, classes: tuple[str, ...] = ENTITY_CLASSES) -> DataFrame:
    """Adds ``masked``: names of the gazetteer replaced by their class, or by a space if it is not among ``classes``.

    The variants are compiled into automata of at most ``max_variants`` entries; a larger
    gazetteer is applied in that many variants at a time, longest first, so what is
    broadcast stays bounded.  The longest variant that matches at a place wins, as when
    variants are replaced one by one from the longest on; what an earlier variant put in
    is not read again.
    """
    spark = df.sparkSession
    cls = F.upper(F.trim("category"))
    variants = gazetteer.filter("category is not null").select(cls.alias("cls"), F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>"))))).alias("v"))
    lower = F.lower(F.regexp_replace(strip_ws(F.col("v")), r"(?U)\s+", " "))
    variants = variants.select("cls", lower.alias("v")).filter(F.length("v") >= 2).groupBy("v").agg(F.min("cls").alias("cls"))
    n = variants.count()
    slices = max(1, -(-n // max_variants))
    if slices > 1:
        ranked = positional_ids(variants.withColumn("minus", -F.length("v")), ["minus", "v"], "at")
        variants = ranked.withColumn("slice", F.floor(F.col("at") / max_variants)).drop("minus", "at")
    out = df.withColumn("masked", F.col(text_col))
    schema = out.schema
    for k in range(slices):
        part = variants.filter(F.col("slice") == k).drop("slice") if slices > 1 else variants
        table = spark.sparkContext.broadcast([(r["v"], r["cls"]) for r in part.select("v", "cls").collect()])

        def run(batches: Iterator[pd.DataFrame], table=table, last=k == slices - 1) -> Iterator[pd.DataFrame]:
            mask = compile_masker(table.value, classes, last=last)
            for pdf in batches:
                yield pdf.assign(masked=pdf["masked"].map(lambda t: mask(t) if isinstance(t, str) else None))

        out = out.mapInPandas(run, schema)
    return out


#: Stands for a placeholder between two passes of the automaton: private-use characters no variant holds.
_HELD = 0xE000


def compile_masker(variants: list[tuple[str, str]], classes: tuple[str, ...] = ENTITY_CLASSES, last: bool = True):
    """Function that masks one text by an automaton over lower-cased text.

    A letter whose lower case is longer stays as it is, so places in both texts agree.  Until
    the ``last`` pass placeholders are single characters that nothing matches.
    """
    import ahocorasick

    held = {c: chr(_HELD + k) for k, c in enumerate(classes)}
    shown = {_HELD + k: f"<{c}>" for k, c in enumerate(classes)}
    auto = ahocorasick.Automaton()
    for v, cls in variants:
        auto.add_word(v, (len(v), held.get(cls, "")))
    auto.make_automaton()

    def word(c: str) -> bool:
        return c.isalnum() or c == "_"

    def mask(text: str) -> str:
        squeezed = " ".join(text.split())
        low = squeezed.lower()
        if len(low) != len(squeezed):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in squeezed)
        found = []
        for end, (size, label) in auto.iter(low) if len(auto) else ():
            start = end - size + 1
            if (start == 0 or not (word(low[start - 1]) and word(low[start]))) and (end + 1 == len(low) or not (word(low[end]) and word(low[end + 1]))):
                found.append((-size, start, end + 1, label))
        taken = bytearray(len(low))
        spans = []
        for _, a, b, label in sorted(found):
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                spans.append((a, b + 2 if low[b : b + 2] == "'s" and (b + 2 == len(low) or not word(low[b + 2])) else b, label))
        parts, at = [], 0
        for a, b, label in sorted(spans):
            parts += [squeezed[at:a], label or " "]
            at = b
        out = " ".join(("".join(parts) + squeezed[at:]).split())
        return out.translate(shown) if last else out

    return mask


def mask_entities(df: DataFrame, find: Callable[[str], list[tuple[int, int, str]]], text_col: str = "text") -> DataFrame:
    """Adds ``masked`` by a recogniser that gives ``(start, end, class)`` spans of a text; off unless one is passed.

    Spans are put in from the right, so earlier places stay valid; a span that holds a ``<``
    (a placeholder already there) is left alone, as is one that overlaps a span to its right.
    """

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if isinstance(text, str):
                end = len(text)
                for a, b, cls in sorted(find(text), reverse=True):
                    if a < b <= end and "<" not in text[a:b]:
                        text = f"{text[:a]}<{cls}>{text[b:]}"
                        end = a
                text = " ".join(text.split())
            out.append(text)
        return pd.Series(out, dtype=object)

    return df.withColumn("masked", run(text_col))


def masking_report(df: DataFrame, masked: str = "masked", classes: tuple[str, ...] = ("PERSON", "TEAM", "PLACE")) -> DataFrame:
    """Sentences and occurrences of each placeholder; ``any`` counts texts with a ``<`` at all."""
    kinds = F.explode(F.array(*[F.lit(f"<{c}>") for c in classes], F.lit("any"))).alias("placeholder")
    looked = F.when(F.col("placeholder") == "any", "<").otherwise(F.col("placeholder"))
    times = (F.length(masked) - F.length(F.replace(F.col(masked), looked, F.lit("")))) / F.length(looked)
    return df.select(masked, kinds).select("placeholder", times.cast("long").alias("t")).groupBy("placeholder").agg(F.count_if(F.col("t") > 0).alias("n_sentences"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_occurrences"))


def source_hashes(df: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    return df.select(id_col, F.sha2("text", 256).alias("source_text_hash"))


def verify_cache(source: DataFrame, cached: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """One row: counts by which a cached relation ``(id, masked, source_text_hash)`` differs from its source."""
    s = source.select(F.col(id_col).alias("sid"), F.sha2("text", 256).alias("h"))
    c = cached.select(F.col(id_col).alias("cid"), "masked", F.col("source_text_hash").alias("ch"))
    j = s.join(c, F.col("sid") == F.col("cid"), "full")
    return j.agg(
        F.count("sid").alias("n_source"), F.count("cid").alias("n_cached"), F.countDistinct("cid").alias("n_unique"), F.count_if(F.col("cid").isNull()).alias("n_missing"),
        F.count_if(F.col("sid").isNull()).alias("n_unknown"), F.count_if(F.col("cid").isNotNull() & F.col("masked").isNull()).alias("n_null"), F.count_if(F.col("h") != F.col("ch")).alias("n_stale"),
    )


def segment_text(text: Column, least_tokens: int = 4) -> Column:
    """Sentences of a text: split after . ! ? before a capital, short ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s*(?=[A-Z])"), lambda s: F.trim(s)), lambda s: F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")) >= least_tokens)


def segment_cut(df: DataFrame, start: str, ends: list[str], session: str = "session", order: str = "sentence_id") -> DataFrame:
    """``(session, first, last, tier)``: from the first start cue to the first end cue of the best tier after it.

    Without a start cue the segment begins with the session; without an end cue it ends with
    it and ``tier`` is null.  One grouped pass finds the starts, one the ends.
    """
    starts = df.groupBy(session).agg(F.coalesce(F.min(F.when(F.col("text").rlike(start), F.col(order))), F.min(order)).alias("first"), F.max(order).alias("end"))
    later = df.join(starts, session).filter(F.col(order) > F.col("first"))
    cues = [F.min(F.when(F.col("text").rlike(e), F.col(order))).alias(f"e{k}") for k, e in enumerate(ends)]
    found = starts.join(later.groupBy(session).agg(*cues), session, "left")
    last = F.coalesce(*[F.col(f"e{k}") for k in range(len(ends))], F.col("end"))
    tier = F.coalesce(*[F.when(F.col(f"e{k}").isNotNull(), k + 1) for k in range(len(ends))])
    return found.select(session, "first", last.alias("last"), tier.cast("int").alias("tier"))


def event_key(name: Column) -> Column:
    """Lower case, every ``_gp`` dropped."""
    return F.replace(F.lower(name), F.lit("_gp"), F.lit(""))


def pair_events(primary: DataFrame, second: DataFrame, aliases: DataFrame) -> DataFrame:
    """Match second-register sessions to primary ones on the normalised key, else by an alias whose target exists.

    ``primary(session)``, ``second(session)``, ``aliases(key, target)``; gives ``session,
    primary_session, match_type`` with ``exact``, ``alias`` or ``none``.
    """
    p = primary.select(F.col("session").alias("primary_session"), event_key(F.col("session")).alias("k"))
    a = aliases.join(p, F.col("target") == F.col("k")).select(F.col("key").alias("ak"), F.col("primary_session").alias("by_alias"))
    s = second.select("session", event_key(F.col("session")).alias("k2"))
    j = s.join(p, F.col("k2") == F.col("k"), "left").join(a, F.col("k2") == F.col("ak"), "left")
    match = F.when(F.col("primary_session").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("none")
    return j.select("session", F.coalesce("primary_session", "by_alias").alias("primary_session"), match.alias("match_type"))


def register_checks(sentences: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(check, ok, detail)``: named conditions a pair of registers must meet."""
    s = sessions.select(F.col("session").alias("k"), "register")
    j = sentences.join(s, F.col("session") == F.col("k"), "left")
    one = j.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sentence_id").alias("ids"), F.count_if(F.col("k").isNull()).alias("orphans"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"), F.countDistinct("register").alias("registers"))
    checks = [("has_rows", F.col("n") > 0, F.col("n")), ("unique_ids", F.col("n") == F.col("ids"), F.col("ids")), ("known_sessions", F.col("orphans") == 0, F.col("orphans")), ("no_blank_text", F.col("blank") == 0, F.col("blank")), ("two_registers", F.col("registers") == 2, F.col("registers"))]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), v.cast("long").alias("detail")) for n, ok, v in checks])).alias("c")).select("c.*")


def corpus_summary(df: DataFrame) -> DataFrame:
    """Sentences, sessions, and mean, smallest and largest number of sentences a session."""
    per = df.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"))
    return per.agg(F.sum("n").alias("n_sentences"), F.count(F.lit(1)).alias("n_sessions"), F.sum("t").alias("n_tokens"), r6(F.avg("n")).alias("mean_sentences"), F.min("n").alias("min_sentences"), F.max("n").alias("max_sentences"))
