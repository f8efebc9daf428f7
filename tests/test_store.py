"""The brick store: pruned reads, appends, versions, broken writes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo
from fieldspark.operators import bricks as B
from fieldspark.operators import iso, stencil
from fieldspark.operators.select import prune_iso
from fieldspark.sources import store
from fieldspark.sources import volumes as VOL

INFO = VolumeInfo(10, 12, 9, 2, brick=4, overlap=1)


@pytest.fixture(scope="module")
def volume(spark):
    rows = VOL.synth_vortex(spark, 10, 12, 9, jitter=0.3, nt=2)
    return rows.withColumns({c: F.round(c, 3) for c in ("u", "v", "w")}).withColumn("temp", F.col("x") * 1.0 + F.col("y") * 0.25 + F.col("z") * 0.5 + F.col("t")).cache()


@pytest.fixture(scope="module")
def kept(spark, volume, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("store") / "v")
    store.create(spark, at, INFO)
    store.append(volume, INFO, at, ["u", "v", "w", "temp"], file_bytes=1500)
    return at


def tuples(df, cols=("t", "x", "y", "z", "u", "temp")):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_morton_numbers_interleave_bits(spark):
    rows = spark.range(5 * 6 * 5).select((F.col("id") % 5).alias("bx"), F.expr("id div 5 % 6").alias("by"), F.expr("id div 30").alias("bz"))
    info = VolumeInfo(10, 12, 9, brick=4, overlap=1)
    for r in rows.withColumn("m", store.morton(info)).collect():
        assert r.m == sum(((r[c] >> k) & 1) << (3 * k + d) for k in range(3) for d, c in enumerate(("bx", "by", "bz")))


def test_whole_read(spark, volume, kept):
    assert store.described(spark, kept).nt == 2
    assert tuples(store.read(spark, kept)) == tuples(volume)
    assert tuples(store.read(spark, kept, steps=[1])) == tuples(volume.where("t = 1"))
    names = store.read(spark, kept).select(F.input_file_name()).distinct().count()
    assert names > 10  # many files a step


def test_pruned_read_opens_fewer_files(spark, volume, kept):
    live = prune_iso(store.directory(spark, kept), "temp", 3.2)
    got = store.read(spark, kept, live, ghosts=1)
    opened = {r[0] for r in got.select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in store.read(spark, kept).select(F.input_file_name()).distinct().collect()}
    assert opened < every and len(opened) < 0.9 * len(every)
    few = store.read(spark, kept, store.directory(spark, kept).where("bx = 0 and by = 0 and bz = 0 and t = 0"))
    assert few.count() == INFO.core**3 and few.select(F.input_file_name()).distinct().count() == 1
    assert store.read(spark, kept, live.where("false")).count() == 0


@pytest.mark.parametrize("periodic", [False, True])
@pytest.mark.parametrize("halo", [1, 2])
def test_ghost_layers_by_brute_force(spark, periodic, halo):
    info = VolumeInfo(8, 12, 8, 1, brick=4, overlap=1, periodic=periodic)
    rows = VOL.synth_vortex(spark, 8, 12, 8)
    picked = {(0, 0, 0, 0), (0, 3, 5, 2), (0, 1, 2, 2)}
    got = B.with_ghosts(rows, spark.createDataFrame(sorted(picked), "t int, bx int, by int, bz int"), info, halo).collect()
    want = {}
    for _, bx, by, bz in picked:
        for x in range(bx * 2 - halo, bx * 2 + 2 + halo):
            for y in range(by * 2 - halo, by * 2 + 2 + halo):
                for z in range(bz * 2 - halo, bz * 2 + 2 + halo):
                    c = (x % 8, y % 12, z % 8) if periodic else (x, y, z)
                    if 0 <= c[0] < 8 and 0 <= c[1] < 12 and 0 <= c[2] < 8:
                        own = (x // 2, y // 2, z // 2) == (bx, by, bz)
                        want[c] = want.get(c, True) and not own
    assert {(r.x, r.y, r.z): r.is_halo for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        B.with_ghosts(rows, rows, info, 3)


def test_stencils_on_surviving_bricks_are_those_of_the_whole(spark, volume, kept):
    live = prune_iso(store.directory(spark, kept), "temp", 3.2)
    assert 0 < live.count() < store.directory(spark, kept).where("measure = 'temp'").count()
    part = store.read(spark, kept, live, ghosts=1)
    for axis in "xyz":
        whole = tuples(iso.iso_crossings(volume, "temp", 3.2, axis), [*stencil.PENCIL[axis], "iso", "at", "enters", "hit"])
        assert whole and tuples(iso.iso_crossings(part, "temp", 3.2, axis), [*stencil.PENCIL[axis], "iso", "at", "enters", "hit"]) == whole
    cols = ["t", "x", "y", "z", *[f"j{r}{c}" for r in range(3) for c in range(3)]]
    core = stencil.jacobian(part, size=INFO.size).where("not is_halo")
    whole = stencil.jacobian(volume).join(core.select("t", "x", "y", "z"), ["t", "x", "y", "z"])
    assert tuples(core, cols) == tuples(whole, cols) and core.count() > 0


def test_appends_are_checked_and_count_steps(spark, volume, tmp_path):
    at = str(tmp_path / "v")
    store.create(spark, at, INFO)
    one = volume.where("t = 0")
    assert store.append(one, INFO, at, ["u", "temp"]) == {0: 1080}
    assert store.described(spark, at).nt == 1
    with pytest.raises(ValueError, match="nx differs"):
        store.append(one, VolumeInfo(4, 12, 9, 1, brick=4, overlap=1), at, ["u", "temp"])
    with pytest.raises(ValueError, match="outside"):
        store.append(one.withColumn("t", F.lit(5)).withColumn("x", F.col("x") + 1), INFO, at, ["u", "temp"])
    with pytest.raises(ValueError, match="twice"):
        store.append(one.withColumn("t", F.lit(5)).withColumn("x", F.lit(1)), INFO, at, ["u", "temp"])
    with pytest.raises(ValueError, match="columns"):
        store.append(volume.where("t = 1"), INFO, at, ["u"])
    with pytest.raises(ValueError, match="already"):
        store.append(volume, INFO, at, ["u", "temp"])
    assert store.described(spark, at).nt == 1
    assert store.append(volume, INFO, at, ["u", "temp"], again="refuse") == {1: 1080}
    assert store.described(spark, at).nt == 2 and tuples(store.read(spark, at)) == tuples(volume)
    store.append(one.withColumn("u", F.lit(7.0)), INFO, at, ["u", "temp"], again="replace")
    assert tuples(store.read(spark, at, steps=[1])) == tuples(volume.where("t = 1"))
    assert store.read(spark, at, steps=[0]).where("u = 7").count() == 1080 == store.read(spark, at, steps=[0]).count()
    assert store.directory(spark, at).where("t = 0 and measure = 'u' and vmin = 7 and vmax = 7").count() == store.directory(spark, at).where("t = 0 and measure = 'u'").count()
    assert store.vacuum(spark, at) == 2 and tuples(store.read(spark, at, steps=[1])) == tuples(volume.where("t = 1"))  # the replaced step, and that of the refused cells


def test_unpublished_files_are_not_seen(spark, volume, tmp_path, monkeypatch):
    at = str(tmp_path / "v")
    store.create(spark, at, INFO)
    store.append(volume.where("t = 0"), INFO, at, ["u", "temp"])

    def broken(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(store.Files, "publish", broken)
        with pytest.raises(OSError):
            store.append(volume.where("t = 1"), INFO, at, ["u", "temp"])
    assert store.described(spark, at).nt == 1 and tuples(store.read(spark, at)) == tuples(volume.where("t = 0"))
    store.append(volume.where("t = 1"), INFO, at, ["u", "temp"])
    assert tuples(store.read(spark, at)) == tuples(volume)
    names = [json.loads((tmp_path / "v" / "manifest" / f"{t}.json").read_text())["step"] for t in (0, 1)]
    assert len(set(names)) == 2
