"""How the test tables stand for the domain's relations, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import one_delivery, table


class Family:
    """Queries of one operator family with their SQL counterparts."""

    def __init__(self):
        self.QUERIES: dict = {}
        self.ORACLES: dict = {}

    def add(self, sql: str | None = None):
        def register(f):
            self.QUERIES[f.__name__] = f
            if sql is not None:
                self.ORACLES[f.__name__] = sql
            return f

        return register


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``(id, session, label, vec)``: embedded documents; every seventh one counts as noise."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    label = F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label"))
    return e.join(docs, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), F.coalesce("source", F.lit("all")).alias("session"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


V_SQL = """v AS (SELECT e.vec_id AS id, coalesce(d.source, 'all') AS session, (CASE WHEN e.vec_id % 7 = 0 THEN -1 ELSE e.label END)::INTEGER AS label, e.embedding::DOUBLE[] AS vec FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""
C_SQL = V_SQL + """, cm AS (SELECT label, p, avg(vec[p]) AS m FROM (SELECT label, vec, unnest(generate_series(1, len(vec))) AS p FROM v WHERE label <> -1) GROUP BY label, p),
c0 AS (SELECT label, list(m ORDER BY p) AS mu FROM cm GROUP BY label),
c AS (SELECT label, list_transform(mu, lambda x: x / sqrt(list_dot_product(mu, mu))) AS vec, mu FROM c0)"""
N_SQL = C_SQL + """, n AS (SELECT * FROM (SELECT v.id, v.session, v.label, v.vec, c.label AS nearest, list_dot_product(v.vec, c.vec) AS cosine, row_number() OVER (PARTITION BY v.id ORDER BY list_dot_product(v.vec, c.vec) DESC, c.label) AS rn FROM v, c) WHERE rn = 1)"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """``(sentence_id, session, series, text, token_count, label)``: each sentence once, with text and session.

    The category is given by the sentence's length, which goes with what is said; every
    length that is a multiple of ten is noise (-1).
    """
    c = one_delivery(table(spark, d, "corpus"), "sentence_id").filter("text is not null and session is not null")
    return c.select("sentence_id", "session", F.coalesce("series", F.lit("none")).alias("series"), "text", "token_count", (F.col("token_count") % 10 - 1).cast("int").alias("label"))


S_SQL = """s AS (SELECT sentence_id, session, coalesce(series, 'none') AS series, text, token_count, (token_count % 10 - 1)::INTEGER AS label FROM (SELECT DISTINCT ON (sentence_id) * FROM corpus) WHERE text IS NOT NULL AND session IS NOT NULL)"""


def registered(spark: SparkSession, d: str) -> DataFrame:
    """``(sentence_id, event, register, label, session)``: sentences of known sessions; the series is the event."""
    s = one_delivery(table(spark, d, "sessions").select("video_id", "register"), "video_id").filter("register is not null and video_id is not null")
    return sentences(spark, d).join(s, F.col("session") == F.col("video_id")).select("sentence_id", F.col("series").alias("event"), "register", "label", "session")


R_SQL = S_SQL + """, ss AS (SELECT DISTINCT ON (video_id) video_id, register FROM sessions WHERE register IS NOT NULL AND video_id IS NOT NULL),
r AS (SELECT sentence_id, series AS event, register, label, session FROM s JOIN ss ON session = video_id)"""

#: Categories of the demonstration partition and the domain each belongs to.
DOMAINS = ("Alpha", "Beta", "Gamma", "Delta")
DOMAIN_SQL = "(CASE label % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' WHEN 2 THEN 'Gamma' ELSE 'Delta' END)"


def domain_of(label) -> F.Column:
    m = label % 4
    return F.when(m == 0, "Alpha").when(m == 1, "Beta").when(m == 2, "Gamma").otherwise("Delta")


STOP = ("the", "of", "to", "in", "on", "at", "and", "is", "for", "by", "as", "after", "with", "are", "it", "that", "this", "from", "an", "be")
STOP_SQL = "['" + "', '".join(STOP) + "']"
