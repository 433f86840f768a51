"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from arbora.sources import results, tables, text


def test_counted_text(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("  2 3\n" + "".join(f"  {i}.5   {-i}e0 \n" for i in range(5)))
    rows = text.read_counted_text(spark, str(p)).orderBy("row_id").collect()
    assert [r["label"] for r in rows] == [1, 1, 0, 0, 0]
    assert rows[3]["x"] == [3.5, -3.0] and [r["row_id"] for r in rows] == [0, 1, 2, 3, 4]
    p.write_text("2 2\n1 2\n")
    with pytest.raises(ValueError, match="1 rows"):
        text.read_counted_text(spark, str(p))


def test_lines_of_several_files_and_blocks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    n = 0
    for f, k in (("a", 3), ("b", 5000), ("c", 70)):
        (tmp_path / "d" / f"{f}.txt").write_text("".join(f"line {n + i}\n" for i in range(k)))
        n += k
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.numbered_lines(spark, f"{tmp_path}/d").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == n and all(r["value"] == f"line {r['line']}" for r in got)


def test_read_contexts(spark, tmp_path):
    spark.createDataFrame([(1, 0.5, 2, 1), (2, None, 3, 0)], "id int, a double, b int, y int").write.parquet(f"{tmp_path}/t")
    df = tables.read_contexts(spark, f"{tmp_path}/t", ["a", "b"], "y", "id")
    assert {tuple([r["row_id"], tuple(r["x"]), r["label"]]) for r in df.collect()} == {(1, (0.5, 2.0), 1), (2, (None, 3.0), 0)}
    plan = df.select("label")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<y:int>" in plan
    assert tables.read_contexts(spark, f"{tmp_path}/gone", ["a"], missing_ok=True) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_contexts(spark, f"{tmp_path}/gone", ["a"]).count()


def test_union_and_results(spark, tmp_path):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    u = tables.union_splits({"train": a, "val": None, "test": a.drop("y")})
    assert sorted((r["split"], r["y"]) for r in u.collect()) == [("test", None), ("train", 2)] or u.count() == 2
    with pytest.raises(ValueError):
        tables.union_splits({"train": None})
    for kind in ("csv", "parquet"):
        results.write_results(u.select("x", "split"), f"{tmp_path}/{kind}", ["split", "x"], ["split"], kind)
        back = results.read_results(spark, f"{tmp_path}/{kind}", "split string, x int", kind)
        assert back.columns == ["split", "x"] and back.count() == 2
    assert results.append_results(back, back).count() == 4 and results.append_results(None, back) is back


def test_checkpoints_are_idempotent(spark, tmp_path):
    df = spark.range(5)
    for b in (0, 1, 1, 0):
        results.append_checkpoints(df.withColumn("v", F.lit(b)), f"{tmp_path}/c", b)
    assert spark.read.parquet(f"{tmp_path}/c").count() == 10


def test_counted_text_is_written_in_parts(spark, tmp_path, monkeypatch):
    from arbora.plans import catalogue

    monkeypatch.setattr(catalogue, "PART_LINES", 500, raising=False)
    monkeypatch.setattr(catalogue, "_scratch", lambda spark, name: f"{tmp_path}/{name}")
    found = catalogue.s2_read_counted_text(spark, "/root/testdata/sf0.001").collect()
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert {r["label"]: r["n"] for r in found} == {r["label"]: r["count"] for r in li.groupBy((F.col("l_returnflag") == "N").cast("int").alias("label")).count().collect()}
    parts = spark.read.text(f"{tmp_path}/counted/parts").groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 2000


def test_lines_are_numbered_without_sorting_them(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id as string)").repartition(3).write.text(f"{tmp_path}/d")
    plan = text.numbered_lines(spark, f"{tmp_path}/d")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "row_number" not in plan
