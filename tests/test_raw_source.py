"""The raw_volume data source: byte ranges, pushed filters, the sink's checks, and the stream."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.sources import raw_source as RAW
from fieldspark.sources import volumes as VOL

DIMS = (5, 4, 6)
OPTIONS = {"dims": "5,4,6", "channels": "vel:2,temp", "slab_bytes": str(5 * 4 * 4 * 2 * 2)}  # two layers a slab


def put(folder, t, cut=0):
    a = np.arange(5 * 4 * 6 * 2, dtype=np.float32) + 1000 * t
    a.tofile(folder / f"vel-{t}.raw")
    (a[: 5 * 4 * 6 - cut] + 0.5).tofile(folder / f"temp-{t}.raw")


def test_a_task_reads_a_slab_and_filters_leave_slabs_out(spark, tmp_path):
    for t in (0, 1, 2):
        put(tmp_path, t)
    RAW.register(spark)
    df = spark.read.format("raw_volume").options(**OPTIONS).load(f"{tmp_path}/%s-%d.raw")
    assert df.rdd.getNumPartitions() == 9 and df.count() == 3 * 120
    some = df.where("t = 1 and z in (0, 5)")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 40
    assert df.where("t > 0 and t < 2 and z >= 1 and z < 3").rdd.getNumPartitions() == 1
    assert df.where("z > 99").count() == 0
    row = df.where("t = 2 and z = 3 and y = 1 and x = 4").first()
    at = (3 * 4 + 1) * 5 + 4
    assert (row.vel0, row.vel1, row.temp) == (2000 + 2 * at, 2001 + 2 * at, 2000.5 + at)
    reader = RAW.RawReader(RAW.Layout.of(OPTIONS | {"path": f"{tmp_path}/%s-%d.raw"}))
    list(reader.pushFilters([RAW.In(("t",), (1, 2)), RAW.EqualTo(("t",), 2), RAW.GreaterThan(("z",), 1), RAW.LessThanOrEqual(("z",), 4), RAW.EqualTo(("x",), 3)]))
    assert [(p.t, p.z0, p.z1) for p in reader.partitions()] == [(2, 2, 4), (2, 4, 5)]


def test_short_files_and_bad_options_are_errors(spark, tmp_path):
    put(tmp_path, 0, cut=7)
    RAW.register(spark)
    with pytest.raises(Exception, match="ends before layer"):
        spark.read.format("raw_volume").options(**OPTIONS, tmax="0").load(f"{tmp_path}/%s-%d.raw").count()
    assert spark.read.format("raw_volume").options(**OPTIONS).load(f"{tmp_path}/%s-%d.raw").count() == 0  # no step is there in full
    with pytest.raises(Exception, match="needs dims"):
        spark.read.format("raw_volume").options(channels="u").load("x").count()


def test_sink_writes_what_the_source_reads(spark, tmp_path):
    rows = VOL.synth_vortex(spark, *DIMS, jitter=0.5, nt=2).withColumnsRenamed({"u": "vel0", "v": "vel1"}).repartition(7)
    mask = f"file://{tmp_path}/out/%s/%03d.raw"
    RAW.write_raw(rows, mask, DIMS, ["vel:2", "temp"])
    assert sorted(p.name for p in (tmp_path / "out" / "vel").iterdir()) == ["000.raw", "001.raw"]
    back = VOL.read_raw(spark, mask, DIMS, ["vel:2", "temp"], 0, 1)
    pick = lambda df: sorted(map(tuple, df.select("t", "x", "y", "z", *[F.col(c).cast("float") for c in ("vel0", "vel1", "temp")]).collect()))
    assert pick(back) == pick(rows)
    for bad in (rows.where("x <> 2"), rows.unionByName(rows.where("x = 1 and t = 1"))):
        with pytest.raises(Exception, match="cells"):
            RAW.write_raw(bad, f"{tmp_path}/bad/%s-%d.raw", DIMS, ["vel:2", "temp"])
    assert not any(p.name.endswith(".raw") for p in (tmp_path / "bad").iterdir())


def test_steps_stream_in_order_once_they_are_whole(spark, tmp_path):
    RAW.register(spark)
    source = spark.readStream.format("raw_volume").options(**OPTIONS).load(f"{tmp_path}/%s-%d.raw")
    seen = []

    def run():
        q = source.writeStream.foreachBatch(lambda b, n: seen.append(sorted((r.t, r["count"]) for r in b.groupBy("t").count().collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    put(tmp_path, 0)
    put(tmp_path, 1, cut=3)
    put(tmp_path, 2)
    run()
    put(tmp_path, 1)
    run()
    run()
    assert [b for b in seen if b] == [[(0, 120)], [(1, 120), (2, 120)]]


def test_points_file_round_trip(spark, tmp_path):
    points = spark.range(1000).selectExpr("id as pid", "id * 0.5 as x", "id * 2.0 as y", "double(-id) as z").repartition(5)
    VOL.write_points(points, f"{tmp_path}/p/points.raw")
    back = VOL.read_points(spark, f"file:{tmp_path}/p/points.raw", 3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, points.selectExpr("pid", "double(x)", "double(y)", "z").collect()))
