"""Frequency of every distinct value or term: recursive radix spilling over DuckDB.

Map side: each task aggregates its own batches (value, occurrences, rows) in DuckDB, so a
value crosses the network once per task that holds it, however hot it is.  The partial
counts are partitioned by the leading bits of the value's hash.  Reduce side: a task
writes the partials it receives to disk as they come, partitioned by the next hash bits;
a partition larger than the budget is split by further bits, recursively; each leaf is
aggregated by DuckDB, which spills what does not fit its memory limit.  No step holds all
values, and no value's rows ever meet in one place before they are pre-aggregated.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import terms
from tessera.plans.lineage import Workspace
from tessera.sources.tables import single_deliveries

PARTIAL = T.StructType(
    [
        T.StructField("radix", T.IntegerType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("field_value", T.StringType()),
        T.StructField("occurrences", T.LongType()),
        T.StructField("n_rows", T.LongType()),
    ]
)
#: Pseudo-field that carries the number of rows through the same aggregation.
ALL_ROWS = "\x00rows"
_BITS = 4  # a level of the recursion splits sixteen ways


def _duck(memory_mb: int, scratch: str):
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": scratch, "preserve_insertion_order": False})


def _scratch(folder: str) -> str:
    """A folder of this task below the shared one (another file system than a local one gets Spark's local dirs)."""
    base = folder.removeprefix("file://") if folder.startswith(("file://", "/")) else os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
    path = os.path.join(base, f"radix-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _map_side(folder: str, memory_mb: int, flush_rows: int):
    """Partial counts of one task's rows."""

    def count(con, lists: list[tuple[str, pa.Array, pa.Array]], n: int) -> pa.Table:
        parts = [f"select '{ALL_ROWS}' field_name, '' field_value, {n}::bigint occurrences, {n}::bigint n_rows"]
        for k, (field, row, value) in enumerate(lists):
            con.register(f"f{k}", pa.table({"r": row, "v": value}))
            parts.append(f"select '{field}', v, sum(c)::bigint, count(*) from (select r, v, count(*) c from f{k} group by r, v) group by v")
        return con.sql(" union all ".join(parts)).to_arrow_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = _scratch(folder)
        try:
            con, held, n_held, base = _duck(memory_mb, scratch), [], 0, 0
            fields: list[str] = []
            pending: dict[str, list[tuple[pa.Array, pa.Array]]] = {}

            def flush() -> Iterator[pa.RecordBatch]:
                table = count(con, [(f, pa.chunked_array([x[0] for x in p]), pa.chunked_array([x[1] for x in p])) for f, p in pending.items() if p], base)
                con.register("part", table)
                done = con.sql("select (hash(field_value) >> 48)::int radix, field_name, field_value, occurrences, n_rows from part").to_arrow_table()
                yield from done.cast(_arrow_schema(PARTIAL)).to_batches(max_chunksize=50_000)

            for batch in batches:
                fields = fields or batch.schema.names
                for name in fields:
                    col = batch.column(name)
                    if pa.types.is_list(col.type):
                        row, value = pc.list_parent_indices(col), pc.list_flatten(col)
                    else:
                        keep = pc.is_valid(col)
                        row, value = pc.filter(pa.array(range(len(col)), pa.int64()), keep), pc.filter(col, keep)
                    pending.setdefault(name, []).append((pc.add(pc.cast(row, pa.int64()), base), value))
                    n_held += len(value)
                base += batch.num_rows
                if n_held >= flush_rows:
                    yield from flush()
                    pending, n_held, base = {}, 0, 0
            if base:
                yield from flush()
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    return run


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def _reduce_side(folder: str, memory_mb: int, leaf_bytes: int):
    """Final counts of one radix partition."""
    out = pa.schema([("field_name", pa.string()), ("field_value", pa.string()), ("occurrences", pa.int64()), ("n_rows", pa.int64())])

    def split(con, source: str, level: int, into: str) -> list[str]:
        """Write a relation's rows by the hash bits of ``level``; returns the folders."""
        os.makedirs(into, exist_ok=True)
        shift = 48 - _BITS * (level + 1)
        con.execute(f"copy (select *, ((hash(field_value) >> {shift}) & {(1 << _BITS) - 1})::int b from {source}) to '{into}' (format parquet, partition_by (b), overwrite_or_ignore, file_extension 'parquet', filename_pattern 'p{{uuid}}')")
        return sorted(os.path.join(into, d) for d in os.listdir(into))

    def leaves(con, folder: str, level: int) -> Iterator[str]:
        size = sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f.endswith(".parquet"))
        if size <= leaf_bytes or _BITS * (level + 2) > 48:
            yield folder
            return
        cols = "field_name, field_value, occurrences, n_rows"
        for sub in split(con, f"(select {cols} from read_parquet('{folder}/*.parquet', hive_partitioning=false))", level + 1, folder + "-s"):
            yield from leaves(con, sub, level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = _scratch(folder)
        try:
            con, held, size, spilled = _duck(memory_mb, scratch), [], 0, []
            total = "select field_name, field_value, sum(occurrences)::bigint occurrences, sum(n_rows)::bigint n_rows from {} group by all"

            def spill() -> None:
                con.register("held", pa.Table.from_batches(held).drop_columns(["radix"]))
                spilled[:] = split(con, "held", 0, os.path.join(scratch, "l0"))

            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size > leaf_bytes:
                    spill()
                    held, size = [], 0
            if not spilled:
                if held:
                    con.register("held", pa.Table.from_batches(held))
                    yield from con.sql(total.format("held")).to_arrow_table().cast(out).to_batches(max_chunksize=50_000)
                return
            if held:
                spill()
                held = []
            for top in spilled:
                for leaf in leaves(con, top, 0):
                    found = con.sql(total.format(f"read_parquet('{leaf}/*.parquet', hive_partitioning=false)"))
                    yield from found.to_arrow_table().cast(out).to_batches(max_chunksize=50_000)
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    return run


def count_values(df: DataFrame, fields: list[str], partitions: int | None = None, memory_mb: int = 256, leaf_mb: int = 64, flush_rows: int = 3_000_000) -> DataFrame:
    """``(field_name, field_value, occurrences, n_rows)`` of every distinct value.

    ``fields`` are string columns (one value a row, null has none) or array<string>
    columns (any number of values, repeats count as occurrences but once as a row).
    A row of the pseudo-field ``ALL_ROWS`` carries the number of rows.  Empty strings are
    values.  An empty table gives no row.  Columns not named are not read.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "radix")
    partial = df.select(*fields).mapInArrow(_map_side(ws.root, memory_mb, flush_rows), PARTIAL)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    final = T.StructType(PARTIAL.fields[1:])
    counted = partial.repartition(n, "radix").mapInArrow(_reduce_side(ws.root, memory_mb, leaf_mb << 20), final)
    return ws.write(counted, "counts")


def term_frequency(corpus: DataFrame, text_col: str = "text", value_cols: tuple[str, ...] = ("session",), key: str = "sentence_id", rare_rows: int = 2, common_terms: float = 0.115, common_values: float = 0.05) -> DataFrame:
    """Counts and marks of every term of ``text_col`` and every value of ``value_cols``.

    Columns: ``field_name, field_value, occurrences bigint, n_rows bigint, mark``.  ``mark``
    is ``rare`` in at most ``rare_rows`` rows, ``common`` in more than the given share of all
    rows (``common_terms`` for terms, ``common_values`` for values), else null; a value that
    is both (tiny tables) is rare.  A row is one logical ``key``; rows with a null key each
    count.  Null texts and values have no term, but count in the share's denominator.
    """
    rows = single_deliveries(corpus.select(key, text_col, *value_cols), key)
    counts = count_values(rows.select(terms(F.col(text_col)).alias(text_col), *value_cols), [text_col, *value_cols])
    total = counts.filter(F.col("field_name") == ALL_ROWS).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_all"))
    limit = F.when(F.col("field_name") == text_col, F.lit(common_terms)).otherwise(F.lit(common_values))
    mark = F.when(F.col("n_rows") <= rare_rows, "rare").when(F.col("n_rows") > limit * F.col("n_all"), "common")
    return counts.filter(F.col("field_name") != ALL_ROWS).crossJoin(F.broadcast(total)).select("field_name", "field_value", "occurrences", "n_rows", mark.alias("mark"))


def marked_values(frequencies: DataFrame) -> DataFrame:
    """``(field_name, field_value, mark)`` of the values that are too rare or too common."""
    return frequencies.filter(F.col("mark").isNotNull()).select("field_name", "field_value", "mark")
