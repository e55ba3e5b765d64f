"""Whole-frame access: labels, positions, rows and renderings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import table as T
from tessera.frame import Frame
from tessera.series import Series

ROWS = [(3, "b", None), (1, "a", 10), (2, None, 30), (4, "b", 20)]


@pytest.fixture(scope="module")
def frame(spark):
    return Frame(spark.createDataFrame(ROWS, "i long, k string, v long").repartition(3), ["i"])


def test_columns(spark, frame):
    assert T.set_axis(frame, ["x", "y", "z"]).order == ["x"] and T.rename_axis(frame, "j").columns == ["j", "k", "v"]
    assert T.insert(frame, 1, "n", F.col("v") + 1).columns == ["i", "n", "k", "v"]
    with pytest.raises(ValueError):
        T.insert(frame, 0, "k", 1)
    column, rest = T.pop(frame, "v")
    assert column.columns == ["i", "v"] and rest.columns == ["i", "k"]
    assert [n for n, _ in T.items(frame)] == T.keys(frame) == [c.columns[0] for c in T.get_columns(frame)]
    assert T.get_column_index(frame, "v") == 2 and T.to_series(frame, 1).columns == ["k"] and T.axes(frame) == (["i"], ["i", "k", "v"])
    assert not T.is_empty(frame) and T.empty(Frame(frame.df.limit(0))) and T.copy(frame).order == ["i"] and T.ndim(frame) == 2
    assert T.rows(T.from_records(spark, [(1, "x")], "a int, b string")) == [(1, "x")]
    assert T.sort_index(frame, False, axis=1).columns == ["v", "k", "i"]


def test_positions(frame):
    assert T.rows(T.xs(frame, 4)) == [("b", 20)]
    assert [r["i"] for r in T.sort_index(frame, False).df.collect()] == [4, 3, 2, 1]
    assert (T.first_valid_index(frame, "k"), T.last_valid_index(frame, "v")) == (1, 4)
    assert T.first_valid_index(frame.filter(F.col("i") > 9), "v") is None
    assert T.rows(T.argsort(frame, "v")) == [(0, 0), (1, 3), (2, 1), (3, 2)]
    assert T.is_sorted(frame, "i") and not T.is_sorted(frame, "v")
    assert T.rows(T.groups(frame, ["k"])) == [("a", 0), (None, 1), ("b", 2), ("b", 3)]
    parts = T.partition_by(frame, "k", as_dict=True)
    assert list(parts) == [("a",), ("b",), (None,)] and len(T.rows(parts["b",])) == 2
    with pytest.raises(ValueError):
        T.partition_by(frame, "k", most=2)
    assert T.row(frame, 1) == (2, None, 30) and T.row(frame, -1, named=True)["v"] == 20 and T.item(frame, 0, "v") == 10
    with pytest.raises(IndexError):
        T.row(frame, 4)
    assert T.squeeze(Frame(frame.df.agg(F.sum("v")))) == 60 == T.item(Frame(frame.df.agg(F.sum("v")))) and T.squeeze(frame) is frame


def test_cells(frame):
    assert [r["v"] for r in T.to_dicts(T.applymap(frame, lambda c: F.coalesce(c.cast("string"), F.lit("-"))))] == ["10", "30", "-", "20"]
    other = frame.filter(F.col("i") > 2)
    assert [r[1:] for r in T.rows(T.combine(frame.select("i", "v"), other.select("i", "v"), lambda a, b: F.coalesce(b, a)))] == [(3, 10), (4, 20), (3, None), (4, 20)]


def test_rows_and_renderings(frame):
    ordered = [(1, "a", 10), (2, None, 30), (3, "b", None), (4, "b", 20)]
    assert list(T.iter_rows(frame)) == ordered and T.to_dicts(frame)[0] == {"i": 1, "k": "a", "v": 10}
    assert [n for n, _ in T.iterrows(frame)] == [0, 1, 2, 3] and next(T.itertuples(frame)).k == "a"
    assert T.to_numpy(frame).shape == (4, 3) and T.to_records(frame)["i"].tolist() == [1, 2, 3, 4]
    assert T.to_string(frame, 2).splitlines()[1].split() == ["1", "a", "10"]
    assert T.to_markdown(frame).splitlines()[1] == "|-|-|-|" and "<td>null</td>" in T.to_html(frame)
    assert T.rows(T.info(frame)) == [("i", "bigint", 4), ("k", "string", 3), ("v", "bigint", 3)]
    assert T.memory_usage(frame) > 0 and T.swapaxes(frame.select("i", "v"), "i").df.count() == 1


def test_text_places(spark):
    df = spark.createDataFrame([("abcabc",)], "t string")
    assert df.select(Series("t").str.rindex("bc")).first()[0] == 4
    with pytest.raises(Exception, match="substring not found"):
        df.select(Series("t").str.rindex("x")).collect()
