import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from blackspot.plans.hotspots import run_batch, run_evaluation
from blackspot.runtime import shared_folder
from blackspot.sources import readers, urls, writers
from blackspot.sources.crash_view import crash_view
from blackspot.sources.schema import CRASH_COLUMNS, centroid_schema


def test_urls(spark):
    df = spark.createDataFrame([("s3://data/raw/a.csv",), ("s3a://data//x",), ("https://h/p",)], "u string")
    got = df.select(urls.bucket(F.col("u")).alias("b"), urls.object_key(F.col("u")).alias("k"), urls.to_s3a(F.col("u")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("data", "raw/a.csv", "s3a://data/raw/a.csv"), ("data", "x", "s3a://data//x"), ("h", "p", "https://h/p")]


def test_urls_with_odd_characters(spark):
    df = spark.createDataFrame([("s3://my_bucket/a b/x#1?y=2.csv",), ("S3A://b.c/k\nl",), ("http://h/p?q#f",), ("no address",), ("s3:/one",), (None,), ("",)], "u string")
    got = df.select(urls.bucket(F.col("u")).alias("b"), urls.object_key(F.col("u")).alias("k")).collect()
    assert [tuple(r) for r in got] == [("my_bucket", "a b/x#1?y=2.csv"), ("b.c", "k\nl"), ("h", "p")] + [(None, None)] * 4


def test_files_with_different_headers(spark, tmp_path):
    rows = {c: "0" for c in CRASH_COLUMNS} | {"Latitude": "29.5", "Longitude": "-98.5", "Crash_Date": "1/2/2022", "Crash_Fatal_Fl": "N"}
    write = lambda name, head, **values: (tmp_path / name).write_text(",".join(head) + "\n" + ",".join((rows | {"X": "x"} | values)[c] for c in head) + "\n")
    write("a.csv", CRASH_COLUMNS, Crash_ID="1", Death_Cnt="1.0")
    write("b.csv", CRASH_COLUMNS[::-1], Crash_ID="2", Death_Cnt="0.5")
    write("c.csv", ["X", *sorted(CRASH_COLUMNS)], Crash_ID="9007199254740993", Latitude="Infinity")
    got = {r.Crash_ID: r for r in readers.read_crashes(spark, str(tmp_path)).collect()}
    assert [(got[i].Death_Cnt, got[i].Latitude) for i in (1, 2, 9007199254740993)] == [(1, 29.5), (None, 29.5), (0, None)]
    mixed = readers.read_csv_directory(spark, str(tmp_path), centroid_schema("Crash_ID"))
    assert mixed.columns == centroid_schema("Crash_ID").names and mixed.filter("fatality_rate is null").count() == 3


def test_typed_columns(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("a.csv", "a,b,c,d,e,f,g.h\n1,1, 7 ,1/31/2020,007,,1d\n-2,, ,2/29/2021,x,,2\n")
    write("b.csv", "c,b,a,d,big\n3,2.5e1,+4,,9223372036854775807\n,.5,5,12/1/1999,-9223372036854775809\n")
    read = readers.read_typed(spark, str(tmp_path))
    assert dict(read.dtypes) == {"a": "bigint", "b": "double", "c": "bigint", "d": "string", "e": "string", "f": "string", "g.h": "string", "big": "string"}
    got = {r.a: r for r in read.collect()}  # 2/29/2021 is no date, so d is text
    assert (got[1].b, got[1].c, got[1].e, got[-2].b, got[-2].c, got[4].c, got[5].b) == (1.0, 7, "007", None, None, 3, 0.5)
    write("b.csv", "d\n3/1/2021\n")
    write("a.csv", "d,e\n1/31/2020,\n,1\n")
    read = readers.read_typed(spark, str(tmp_path))
    assert dict(read.dtypes) == {"d": "date", "e": "bigint"}
    assert sorted(str(r.d) for r in read.collect()) == ["2020-01-31", "2021-03-01", "None"]
    write("a.csv", "d,e\n")
    write("b.csv", "d\n")
    assert dict(readers.read_typed(spark, str(tmp_path)).dtypes) == {"d": "string", "e": "string"}
    with pytest.raises(ValueError):
        readers.read_typed(spark, str(tmp_path), pathGlobFilter="*.none")


def test_only_files_of_a_region_are_opened(spark, crashes, tmp_path):
    from blackspot.operators.regions import Region, region_counts
    from blackspot.sources import laid_out
    rows = crashes([29 + (i * 7 % 100) / 50 for i in range(3000)] + [31.5] * 500, [-99 + (i % 97) / 50 for i in range(3000)] + [-98.5] * 500)
    rows = rows.withColumn("Latitude", F.when(F.col("Crash_ID") % 50 != 7, F.col("Latitude")))
    laid_out.write_laid_out(rows, str(tmp_path / "t"), 32)
    boxes = [Region("a", 29.1, 29.2, -98.9, -98.8), Region("b", 31.5, 31.5, -98.5, -98.5), Region("none", 10, 11, 10, 11)]
    near = laid_out.read_near_regions(spark, str(tmp_path / "t"), boxes)
    every = spark.read.parquet(str(tmp_path / "t" / laid_out.ROWS))
    assert every.count() == rows.count() and 0 < len(near.inputFiles()) < len(every.inputFiles()) / 2
    assert sorted(region_counts(near, boxes).collect()) == sorted(region_counts(rows, boxes).collect())
    for some in ([], boxes[2:]):
        assert laid_out.read_near_regions(spark, str(tmp_path / "t"), some).collect() == []
    many = [Region(str(i), 29 + i / 100, 29.005 + i / 100, -99, -98.9) for i in range(200)]
    assert len(laid_out.fewer(many)) <= laid_out.MOST_BOXES
    near = laid_out.read_near_regions(spark, str(tmp_path / "t"), many)
    assert sorted(region_counts(near, many).collect()) == sorted(region_counts(rows, many).collect())


def test_scratch_tables_go_with_their_rounds(spark):
    from pathlib import Path
    from blackspot.clustering.components import components
    from blackspot.runtime import cut, forget
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*")) if folder.exists() else set()
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(path).count() == 301
    assert len(set(folder.glob("*")) - before) == 1
    table = cut(path)
    forget(table)
    assert len(set(folder.glob("*")) - before) == 1


def test_shared_folder_is_the_configured_one(spark):
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir") in shared_folder(spark)


def test_crash_ids_of_all_keys(spark, tmp_path):
    """The id in 64-bit integers equals the one in wide integers, and rows with keys beyond its room still have one."""
    keys = [(1, 2, 3, 4), (7200000, 100, 50, 7), (800000000000, 10 ** 14, 10 ** 12, 7), (0, 0, 0, 0), (-5, 7, 3, 1), (5, -7, 3, 1),
            (900000000000000, 3, 5, 2), (5, 10 ** 17, 9, 3), (5, 3, 10 ** 15, 3), (None, 3, 4, 5), (3, 4, None, 5), (599999, 19999, 999, 6)]
    dates = [datetime(1995, 3, 17), datetime(1998, 12, 1), datetime(1985, 2, 3), None]
    rows = [(*k, d) for k in keys for d in dates]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")

    def by_hand(o, p, s, n, d):
        if None in (o, p, s, d):
            return None
        whole = (((o * 10 + n) * 1000003 + p) * 1000003 + s) * 4000 + (d.year - 1990) * 372 + d.month * 31 + d.day
        return int(math.copysign(1, whole)) * (abs(whole) % (2 ** 61 - 1))

    got = [r[0] for r in crash_view(spark, str(tmp_path)).select("Crash_ID").collect()]
    assert sorted(got, key=str) == sorted([by_hand(*r) for r in rows], key=str)
    plan = crash_view(spark, str(tmp_path)).select("Crash_ID")._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in plan


def test_crash_csv_by_header(spark, tmp_path):
    head = ["Extra"] + CRASH_COLUMNS[::-1]
    (tmp_path / "c.csv").write_text(",".join(head) + "\nx,1,0,0,0,0,0,0,-98.5,29.5,1/2/2022,N,7\nx,zz,0,0,0,0,0,0,bad,29.5,1/2/2022,N,8\n")
    got = readers.read_crashes(spark, str(tmp_path)).orderBy("Crash_ID").collect()
    assert got[0].asDict()["Longitude"] == -98.5 and got[0].Death_Cnt == 1
    assert got[1].Longitude is None and got[1].Death_Cnt is None and list(got[0].asDict()) == CRASH_COLUMNS
    assert "Extra" in readers.read_crashes(spark, str(tmp_path), all_columns=True).columns
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_crashes(spark, str(tmp_path / "sub"))


def test_directory_union_skips_other_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("c,centroid_latitude,centroid_longitude,fatality_rate\n1,30,-100,0.5\n")
    (tmp_path / "b.csv").write_text("c,centroid_latitude,centroid_longitude,fatality_rate\n2,31,-101,\n")
    (tmp_path / "notes.txt").write_text("no\n")
    got = readers.read_csv_directory(spark, str(tmp_path), centroid_schema("c")).orderBy("c").collect()
    assert [(r.c, r.fatality_rate) for r in got] == [(1, .5), (2, None)]
    with pytest.raises(ValueError):
        readers.union_by_name([])


def test_partitioned_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "r0"), (2, "r1"), (3, "r0")], "id int, region string")
    writers.write_partitioned(df, str(tmp_path / "r"), "region", "csv")
    assert {p.name for p in (tmp_path / "r").glob("region=*")} == {"region=r0", "region=r1"}


def test_batch_then_evaluation(spark, tmp_path):
    lines = [",".join(CRASH_COLUMNS)]
    for i in range(600):
        lines.append(f"{i},N,1/2/2022,{30 + (i % 2) * .5 + i * 1e-5:.6f},{-100 - i * 1e-5:.6f},0,0,0,0,0,0,{int(i % 8 == 0)}")
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    run_batch(spark, str(tmp_path / "in.csv"), str(tmp_path / "cents"))
    run_evaluation(spark, str(tmp_path / "cents"), str(tmp_path / "maps"), range(1, 3), 50)
    cents = readers.read_csv_directory(spark, str(tmp_path / "cents"), centroid_schema("kmeans_cluster"))
    assert cents.count() == 2
    near = spark.read.json(str(tmp_path / "maps" / "rank=1"))
    assert near.count() == 2 and set(r.color_hex for r in near.collect()) == {"#ff0000", "#008000"}
