"""Reading and writing traces and tables; every reader prunes columns and pushes filters where its format can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A trace event; ``args`` stays JSON text and is read by path.
EVENT = T.StructType([
    T.StructField("ph", T.StringType()), T.StructField("name", T.StringType()), T.StructField("cat", T.StringType()), T.StructField("pid", T.LongType()),
    T.StructField("tid", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("dur", T.LongType()), T.StructField("args", T.StringType()),
])
PHASES = {"events": ["X"], "counters": ["C"], "metadata": ["M"], "any": None}


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its file name's ending: parquet, orc, csv, json lines (plain or gzip), text, or arrow."""
    base = path.removesuffix(".gz")
    if base.endswith((".json", ".jsonl", ".ndjson", ".pfw")):
        return read_trace(spark, path) if schema is None else spark.read.schema(schema).json(path)
    if base.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if base.endswith(".orc"):
        return spark.read.orc(path)
    if base.endswith((".arrow", ".ipc", ".feather")):
        return read_arrow(spark, path)
    if base.endswith(".txt"):
        return spark.read.text(path)
    return spark.read.parquet(path)


def read_trace(spark: SparkSession, paths: str | list[str], phase: str = "any") -> DataFrame:
    """Trace events from files or folders of JSON lines, plain or gzip, searched recursively.

    Lines that are not events (brackets, broken records) are dropped; a value of
    another type reads null.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    event = F.from_json(F.rtrim("value", F.lit(", \t\r")), EVENT)
    out = lines.select(event.alias("e")).where("e.name is not null").select("e.*")
    return out.where(F.col("ph").isin(*PHASES[phase])) if PHASES[phase] else out


def read_lines(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows (line, value) of one text file, numbered from 0, in the range [start, stop)."""
    from pyspark.sql import Window

    rows = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    parts = rows.select(F.shiftright("_id", 33).alias("_p"), "_id", "value")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col("_p").alias("_q"), (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_o"))  # a row for each split
    out = parts.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).select((F.col("_o") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("line"), "value")
    out = out.where(F.col("line") >= start)
    return out.where(F.col("line") < stop) if stop is not None else out


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files: bytes are read by Spark, so any store will do, and decoded in Arrow batches."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path)
    head = files.select("content").limit(1).collect()
    if not head:
        raise ValueError(f"no file at {path}")
    schema = pa.ipc.open_file(pa.BufferReader(head[0][0])).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                with pa.ipc.open_file(pa.BufferReader(raw.as_buffer())) as f:
                    for i in range(f.num_record_batches):
                        yield f.get_batch(i)

    return files.select("content").mapInArrow(run, from_arrow_schema(schema))


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_trace(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Events as gzip JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).option("compression", "gzip").text(path)


def write_counters(aggregated: DataFrame, path: str, time: str, name: str, metrics: list[str], mode: str = "errorifexists") -> None:
    """Aggregate rows as counter events."""
    args = F.struct(*metrics)
    rows = aggregated.select(F.lit("C").alias("ph"), F.col(name).cast("string").alias("name"), F.col(time).cast("bigint").alias("ts"), args.alias("args"))
    write_trace(rows, path, mode)


class Materialized:
    """Query results kept as tables and found again by their plan."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, df: DataFrame) -> str:
        """Expression ids and plan numbers differ between equal plans; they are left out of the key."""
        import hashlib
        import re

        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        return f"{self.root}/mv-{hashlib.sha256(re.sub(r'#[0-9]+L?', '#', plan).encode()).hexdigest()[:24]}"

    def get(self, df: DataFrame) -> DataFrame:
        path = self.path(df)
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
