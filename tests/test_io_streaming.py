from __future__ import annotations

import gzip
import json

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.sources import io
from tessera.sources.provider import register
from tessera.streaming import windows as stream


def test_trace_round_trip(spark, tmp_path):
    events = [{"ph": "X", "name": "read", "cat": "POSIX", "pid": 1, "tid": 2, "ts": i, "dur": 5, "args": {"ret": i}} for i in range(10)]
    raw = tmp_path / "in" / "deep"
    raw.mkdir(parents=True)
    with gzip.open(raw / "a.pfw.gz", "wt") as f:
        f.write("[\n" + "\n".join(json.dumps(e) + "," for e in events) + '\n{"ph": "M", "name": "FH"}\nbroken {\n]')
    df = io.read_trace(spark, str(tmp_path / "in"))
    assert df.count() == 11 and io.read_trace(spark, str(tmp_path / "in"), "events").count() == 10
    assert df.where("ph = 'X'").select(F.get_json_object("args", "$.ret").cast("int").alias("r")).agg(F.sum("r")).first()[0] == 45
    io.write_trace(df.where("ph = 'X'"), str(tmp_path / "out"))
    assert io.read_trace(spark, str(tmp_path / "out")).count() == 10
    io.write_counters(df.where("ph = 'X'").groupBy("name").agg(F.min("ts").alias("t"), F.count(F.lit(1)).alias("n")), str(tmp_path / "c"), "t", "name", ["n"])
    assert io.read_trace(spark, str(tmp_path / "c"), "counters").count() == 1


def test_tables_by_name(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id * 2 as v")
    for fmt in ("csv", "orc", "parquet", "json"):
        options = {"header": True} if fmt == "csv" else {}
        io.write(df, str(tmp_path / f"t.{fmt}"), fmt, **options)
    assert io.read(spark, str(tmp_path / "t.csv")).agg(F.sum("v")).first()[0] == 380
    assert io.read(spark, str(tmp_path / "t.orc")).count() == 20
    assert io.read(spark, str(tmp_path / "t.json"), "id long, v long").agg(F.sum("v")).first()[0] == 380


def test_arrow_files(spark, tmp_path):
    for k in range(2):
        t = pa.table({"a": [k, k + 1], "b": ["x", None]})
        with pa.ipc.new_file(str(tmp_path / f"{k}.arrow"), t.schema) as w:
            w.write_table(t)
    got = sorted((tuple(r) for r in io.read_arrow(spark, f"{tmp_path}/*.arrow").collect()), key=str)
    assert got == [(0, "x"), (1, "x"), (1, None), (2, None)]


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"l{i}" for i in range(30)))
    assert [tuple(r) for r in io.read_lines(spark, str(tmp_path / "a.txt"), 10, 12).orderBy("line").collect()] == [(10, "l10"), (11, "l11")]


def test_provider(spark):
    class Numbers:  # pickled by value, as it is not in a module that workers import
        def schema(self):
            return "n long, square long"

        def parts(self):
            return [0, 10]

        def scan(self, columns, part):
            import pyarrow as pa

            t = pa.table({"n": list(range(part, part + 10)), "square": [i * i for i in range(part, part + 10)]}).select(columns)
            yield from t.to_batches()

    register(spark, "numbers", Numbers())
    df = spark.read.format("numbers").load()
    assert df.agg(F.sum("square")).first()[0] == sum(i * i for i in range(20))


def test_provider_filters(spark):
    class Squares:
        pushdown = True

        def schema(self):
            return "n long, square long"

        def parts(self):
            return [0, 10]

        def scan(self, columns, part, filters):
            import pyarrow as pa

            low = max([v for op, c, v in filters if (op, c) == (">=", "n")], default=0)
            keep = [i for i in range(part, part + 10) if i >= low]
            # What is not asked for shows that the hint arrived.
            t = pa.table({"n": keep, "square": [i * i if low else -1 for i in keep]}).select(columns)
            yield from t.to_batches()

    register(spark, "squares", Squares())
    df = spark.read.format("squares").load()
    assert {r["square"] for r in df.collect()} == {-1}
    assert sorted(r["square"] for r in df.where("n >= 8 and n % 2 = 0").collect()) == [i * i for i in range(8, 20, 2)]


def test_materialized(spark, tmp_path, sf_dir):
    store = io.Materialized(spark, str(tmp_path / "mv"))
    make = lambda: spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count()
    assert store.path(make()) == store.path(make())
    assert store.get(make()).count() == store.get(make()).count() == make().count()


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    src = stream.tail(spark, str(tmp_path / "in"), events.schema)
    stream.run_once(stream.bucketed(src, "ts", "6 hours", keys=["event_type"], n=F.count(F.lit(1))), "buckets", "complete")
    want = events.groupBy(F.window("ts", "6 hours"), "event_type").count()
    assert spark.table("buckets").agg(F.sum("n")).first()[0] == events.count() and spark.table("buckets").count() == want.count()
    stream.run_once(stream.distinct(src, "ts", ["user_id"], "30 days"), "firsts")
    assert spark.table("firsts").count() == events.select("user_id").distinct().count()
    stream.run_once(stream.busy(src.withColumn("d", (F.col("value") * 1_000_000).cast("bigint")), "ts", "d", "1 day", ["event_type"]), "busy", "complete")
    assert spark.table("busy").where("busy <= 0").count() == 0
    stream.run_once(stream.sessions(src, "ts", "1 hour", ["user_id"], n=F.count(F.lit(1))), "sessions")
    assert spark.table("sessions").count() > 0
