"""Files the pipeline reads and writes, with explicit schemas and fingerprints."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "video_id", "race_id", "video_url", "video_title", "channel", "upload_date", "series", "license_spdx")])
GAZETTEER = T.StructType(
    [
        T.StructField("entries", T.ArrayType(T.StructType([
            T.StructField("canonical", T.StringType()), T.StructField("category", T.StringType()), T.StructField("variants", T.ArrayType(T.StringType())),
            T.StructField("total_freq", T.IntegerType()), T.StructField("source", T.StringType()),
        ])))
    ]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = SENTENCE) -> DataFrame:
    """JSON lines under an explicit schema; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, a JSON list, or ``{session: [text or record]}``; adds ``session`` and, for bare strings, ``idx``.

    The form is told from the extension and the first character; a large input should be
    JSON lines, the other forms are single documents.
    """
    if path.endswith(".jsonl"):
        df = read_jsonl(spark, path)
        return df.withColumn("session", F.coalesce("video_id", "race_id", F.lit("all"))).withColumn("idx", F.lit(None).cast("int"))
    whole = spark.read.text(path, wholetext=True)
    head = whole.select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    if head["c"] == "[":
        df = whole.select(F.explode(F.from_json("value", T.ArrayType(SENTENCE))).alias("r")).select("r.*")
        return df.withColumn("session", F.coalesce("video_id", "race_id", F.lit("all"))).withColumn("idx", F.lit(None).cast("int"))
    # values are strings in either case: a record comes as its JSON text
    items = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("session", "items")).select("session", F.posexplode("items").alias("idx", "item"))
    record = F.from_json("item", SENTENCE)
    is_record = F.col("item").startswith("{")
    cols = [F.coalesce(F.when(is_record, record["text"]), F.when(~is_record, F.col("item"))).alias("text")] + [F.when(is_record, record[n]).alias(n) for n in SENTENCE.names if n != "text"]
    return items.select(*cols, "session", F.when(~is_record, F.col("idx")).alias("idx"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a gazetteer document; an absent file is an empty gazetteer."""
    entry = GAZETTEER["entries"].dataType.elementType
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], entry)
    return spark.read.schema(GAZETTEER).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan by extension: parquet, orc, csv (needs a schema), json lines."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "csv":
        if schema is None:
            raise ValueError("a csv scan needs a schema; inference reads the data twice and guesses")
        return spark.read.csv(path, header=True, schema=schema)
    if kind in ("json", "jsonl"):
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"no reader for {path}")


def write_any(df: DataFrame, path: str, single: bool = False) -> str:
    """Write by extension, arrays and maps as JSON text in csv; ``single`` asks for one file (report tables only)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    out = df.coalesce(1) if single else df
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if isinstance(t.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c, t in ((f.name, f) for f in df.schema.fields)]
        out.select(*flat).write.mode("overwrite").csv(path, header=True)
    elif kind in ("json", "jsonl"):
        out.write.mode("overwrite").json(path)
    elif kind in ("parquet", "orc"):
        out.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"no writer for {path}")
    return path


def fingerprint(df: DataFrame) -> str:
    """Order-free hash of a table's rows: their count and the sum of their hashes."""
    one = df.select(F.xxhash64(*[F.to_json(c) if isinstance(f.dataType, (T.MapType,)) else F.col(c) for c, f in ((f.name, f) for f in df.schema.fields)]).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s")).first()
    return f"{one['n']}-{one['s'] or 0}"


def require_fingerprint(df: DataFrame, expected: str) -> DataFrame:
    """Fail closed if a table is not the one an analysis was fixed on."""
    got = fingerprint(df)
    if got != expected:
        raise ValueError(f"table fingerprint {got} is not the expected {expected}")
    return df


def cached(spark: SparkSession, folder: str, name: str, config: dict, inputs: list[DataFrame], compute) -> DataFrame:
    """Read-through table keyed by configuration and by the content of its inputs.

    The path holds a digest of both, so changed inputs never meet an old table, and a
    sidecar states what was hashed.
    """
    import hashlib

    identity = {"config": config, "inputs": [fingerprint(d) for d in inputs]}
    digest = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{digest}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        compute().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(json.dumps(identity, sort_keys=True),)], "identity string").coalesce(1).write.mode("overwrite").text(f"{path}.identity")
    return spark.read.parquet(path)


def markdown(df: DataFrame, most: int = 500) -> str:
    """A report table as Markdown; refuses tables that are no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table instead")
    cells = lambda r: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |"
    return "\n".join([cells(df.columns), "|" + "---|" * len(df.columns), *map(cells, rows)])


def latex(df: DataFrame, most: int = 500) -> str:
    """A report table as LaTeX with column widths in proportion to their longest cell."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table instead")
    text = [[("" if v is None else str(v)).translate(str.maketrans({c: "\\" + c for c in "&%$#_{}"})) for v in r] for r in rows]
    width = [max([len(c), *(len(r[k]) for r in text)]) for k, c in enumerate(df.columns)]
    share = [w / sum(width) for w in width]
    spec = "".join(f"p{{{s:.2f}\\linewidth}}" for s in share)
    head = " & ".join(c.replace("_", "\\_") for c in df.columns)
    return "\n".join([f"\\begin{{tabular}}{{{spec}}}", head + " \\\\ \\hline", *(" & ".join(r) + " \\\\" for r in text), "\\end{tabular}"])


class Outputs:
    """Registry of written tables: one artefact, one write, one name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.written = spark, folder.rstrip("/"), {}

    def put(self, name: str, df: DataFrame, kind: str = "parquet") -> str:
        if name in self.written:
            raise ValueError(f"{name} was written already")
        self.written[name] = write_any(df, f"{self.folder}/{name}.{kind}", single=kind == "csv")
        return self.written[name]

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame([("table", n, p) for n, p in sorted(self.written.items())], "kind string, name string, path string")
