"""Facts of analytic fields, kernels, schemes and round trips."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo, expand_masks, resolve_spacing
from fieldspark.functions.kernels import KERNELS
from fieldspark.functions.schemes import SCHEMES, advance, bezier, scheme_info
from fieldspark.operators import bricks as B
from fieldspark.operators import lines as L
from fieldspark.operators import measures as M
from fieldspark.operators import quantize as Q
from fieldspark.operators import sampling, seeds, stats, stencil
from fieldspark.operators import trace as TR
from fieldspark.sources import volumes as VOL

INFO = VolumeInfo(8, 8, 8, 1, brick=4, overlap=1)


@pytest.fixture(scope="module")
def vortex(spark):
    return VOL.synth_vortex(spark, 8, 8, 8).cache()


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_kernel_weights_sum_to_one(name):
    t = np.linspace(0, 0.999, 50)
    assert np.allclose(sum(KERNELS[name].weights(t)), 1.0, atol=1e-9)
    if KERNELS[name].derivative:
        assert np.allclose(sum(KERNELS[name].derivative(t)), 0.0, atol=1e-12)


@pytest.mark.parametrize("name", ["linear", "catrom", "lagrange4", "lagrange6", "lagrange8", "lagrange16"])
def test_kernels_reproduce_lines(name):
    t, k = np.linspace(0, 0.99, 20), KERNELS[name]
    assert np.allclose(sum(w * (3.0 * o + 1) for w, o in zip(k.weights(t), k.offsets, strict=True)), 3.0 * t + 1, atol=1e-7)


@pytest.mark.parametrize("name", sorted(SCHEMES))
def test_schemes_follow_a_circle(name):
    f = lambda p, t: np.stack([-p[:, 1], p[:, 0], np.zeros(len(p))], 1)
    pos, time, dt = np.array([[1.0, 0.0, 0.0]]), np.zeros(1), np.full(1, 0.01)
    vel = f(pos, time)
    while time[0] < 1.0 - 1e-12:
        s = advance(name, f, pos, time, vel, np.minimum(dt, 1.0 - time), 1e-6, 1e-4, 0.1)
        pos, time, vel, dt = s.pos, s.time, s.vel, s.dt if scheme_info(name)["adaptive"] else dt
    order = {"euler": 2e-2, "heun": 1e-4}.get(name, 1e-5)
    assert np.allclose(pos, [[np.cos(1.0), np.sin(1.0), 0.0]], atol=order)


def test_dense_output_meets_the_ends():
    f = lambda p, t: np.stack([-p[:, 1], p[:, 0], np.zeros(len(p))], 1)
    pos = np.array([[1.0, 0.0, 0.0]])
    s = advance("dopri5", f, pos, np.zeros(1), f(pos, None), np.full(1, 0.2), 1e-3, 1e-4, 1.0, True)
    assert np.allclose(bezier(s.coeffs, 0.0), pos) and np.allclose(bezier(s.coeffs, 1.0), s.pos)
    assert np.allclose(bezier(s.coeffs, 0.5), [[np.cos(0.1), np.sin(0.1), 0]], atol=1e-5)


def test_rigid_vortex(vortex):
    h = 2.0 / 8
    df = M.prepare(vortex, ["vorticity", "q_hunt", "lambda2"], (h, h, h)).where("x between 1 and 6 and y between 1 and 6")
    for name, want in (("vorticity", 2.0), ("q_hunt", 1.0), ("square_rotation", 1.0), ("strain_production", 0.0), ("square_rate_of_strain", 0.0), ("lambda2", -1.0)):
        got = [r[0] for r in M.with_measure(df, name, out="m").select("m").collect()]
        assert np.allclose(got, want, atol=1e-6), name


def test_eigensystem_agrees_with_numpy(spark):
    r = np.random.default_rng(1)
    a = r.standard_normal((40, 3, 3))
    pdf = pd.DataFrame({f"j{i}{k}": a[:, i, k] for i in range(3) for k in range(3)} | {"n": range(40)})
    got = M.with_eigensystem(spark.createDataFrame(pdf)).orderBy("n").toPandas()
    for n in range(40):
        m = np.triu(a[n]) + np.triu(a[n], 1).T
        e = np.linalg.eigvalsh(m)[::-1]
        assert np.allclose(got.loc[n, ["e1", "e2", "e3"]].to_numpy(float), e, atol=1e-9)
        v = got.loc[n, ["e2x", "e2y", "e2z"]].to_numpy(float)
        assert np.allclose(m @ v, e[1] * v, atol=1e-6)


@pytest.mark.parametrize("boundary", ["clamp", "periodic"])
def test_bricks_give_the_same_jacobian(spark, vortex, boundary):
    info = VolumeInfo(8, 8, 8, 1, brick=4, overlap=1, periodic=boundary == "periodic")
    a = stencil.jacobian(vortex, boundary=boundary).select("x", "y", "z", "j01", "j10", "j22").orderBy("x", "y", "z").toPandas()
    b = stencil.jacobian_by_brick(vortex, info).select("x", "y", "z", "j01", "j10", "j22").orderBy("x", "y", "z").toPandas()
    assert np.allclose(a.to_numpy(float), b.to_numpy(float))


def test_pack_unpack_is_identity(vortex):
    rows = B.with_halo(vortex, INFO)
    back = B.unpack_bricks(B.pack_bricks(rows, ["u", "v"]), ["u", "v"])
    cols = ["t", "bx", "by", "bz", "gx", "gy", "gz", "u", "v"]
    assert back.select(cols).exceptAll(rows.select(cols)).count() == 0 and back.count() == rows.count()


def test_merged_statistics(vortex):
    whole = stats.finish_stats(stats.stats_state(vortex, ["u"], ["t"])).first()
    parts = [stats.stats_state(vortex.where(c), ["u"], ["t"]) for c in ("x < 3", "x >= 3")]
    merged = stats.finish_stats(stats.merge_stats(*parts, ["t"])).first()
    assert merged["n"] == whole["n"] and abs(merged["var"] - whole["var"]) < 1e-12


def test_quantisation_errors(vortex):
    u = Q.quantize(vortex, "u", 0.1).agg(F.max(F.abs(F.col("u_r") - F.col("u")))).first()[0]
    z = Q.quantize(vortex, "u", 0.1, "deadzone").agg(F.max(F.abs(F.col("u_r") - F.col("u")))).first()[0]
    assert u <= 0.05 + 1e-12 and z < 0.1


@pytest.mark.parametrize("kind,tol", [("cdf97", 1e-4), ("cdf53", 1e-12), ("haar", 1e-12)])
def test_wavelet_round_trip(vortex, kind, tol):
    v = vortex.withColumn("u", F.col("u") + F.col("x") * F.col("x") * 0.1)
    back = Q.inverse_wavelet(Q.wavelet(v, "u", "x", kind), "x", kind)
    assert back.join(v, ["t", "x", "y", "z"]).agg(F.max(F.abs(F.col("c") - F.col("u")))).first()[0] < tol


def test_stream_lines_keep_their_radius_whatever_the_bricks(spark, vortex):
    seeds_ = spark.createDataFrame([(k, 1.0 + k, 0.5, 0.0) for k in range(4)], "pid long, x double, y double, z double")
    ends = []
    for brick, overlap in ((8, 2), (16, 4)):
        info = VolumeInfo(8, 8, 8, 1, brick=brick, overlap=overlap)
        v, state = TR.trace_stream(vortex, info, seeds_, scheme="rk4", dt=0.05, max_age=6.0, max_len=10_000)
        got = v.withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).groupBy("line_id").agg(F.max("r") - F.min("r")).collect()
        assert all(r[1] < 1e-3 for r in got)
        ends.append(state.select("line_id", "x", "y", "status").orderBy("line_id").toPandas())
    assert np.allclose(ends[0][["x", "y"]], ends[1][["x", "y"]], atol=1e-9) and set(ends[0]["status"]) == {"old"}


def test_ftle_of_a_saddle(spark):
    a = 0.3
    x = lambda c: 2.0 * F.col(c) + 1.0 - 8.0
    cells = VOL.synth_vortex(spark, 8, 8, 8).select("t", "x", "y", "z", (a * x("x") / 2).alias("u"), (-a * x("y") / 2).alias("v"), F.lit(0.0).alias("w"))
    got = TR.ftle(cells, VolumeInfo(8, 8, 8, 1, brick=16, overlap=4), 4, ((-2.0, -2.0, 0.0), (4.0, 4.0, 0.0)), 0.5, (0.1, 0.1, 0.1), 1.0, scheme="rk4", dt=0.02).toPandas()
    assert np.allclose(got["ftle"], a, atol=1e-3)


def test_constant_field_flows_out_of_one_side(spark):
    cells = VOL.synth_vortex(spark, 8, 8, 8).select("t", "x", "y", "z", F.lit(1.0).alias("u"), F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    unit = seeds.seed_random(spark, 20, ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)))
    flow = TR.flow_graph(cells, VolumeInfo(8, 8, 8, 1, brick=8, overlap=2), unit, 0.1, 60)
    got = {r["dir"]: r["f"] for r in flow.groupBy("dir").agg(F.avg("freq").alias("f")).collect()}
    assert got[3] == pytest.approx(1.0) and sum(got.values()) == pytest.approx(1.0)


def test_sampling_ways_agree(spark, vortex):
    pts = spark.range(50).select(F.col("id").alias("pid"), F.lit(0).alias("t"), *[(1.0 + (F.col("id") * k % 37) / 7.0).alias(f"g{a}") for a, k in zip("xyz", (1, 3, 5), strict=True)])
    a = sampling.sample(pts, vortex, INFO, "lagrange6").orderBy("pid").toPandas()
    b = sampling.sample_by_brick(pts, vortex, INFO, "lagrange6").orderBy("pid").toPandas()
    assert np.allclose(a, b)


def test_time_in_cell_keeps_its_outside_timer():
    s = (0, 0.0, 0.0, 0, 0.0)
    for cell in (1, 2, 1, 2):
        s = L.cell_step(s, cell, 1.0, 1.5)
    assert s[0] == 2 and s[1] == 2.0


def test_raw_files_and_points(spark, tmp_path):
    a = np.arange(2 * 3 * 4 * 2, dtype=np.float32)
    for t in (0, 2):
        (a + t).tofile(tmp_path / f"vel{t:03d}.raw")
    got = VOL.read_raw(spark, str(tmp_path / "%s%03d.raw"), (4, 3, 2), ["vel:2"], 0, 2, 2, slab_bytes=1).orderBy("t", "z", "y", "x").toPandas()
    assert got["vel1"].tolist() == a[1::2].tolist() + (a[1::2] + 2).tolist()
    np.arange(9, dtype=np.float32).tofile(tmp_path / "p.raw")
    assert VOL.read_points(spark, str(tmp_path / "p.raw"), 2).orderBy("pid").toPandas()["y"].tolist() == [3, 4, 5]


def test_description():
    assert resolve_spacing((4, 8, 8)) == (0.25,) * 3 and resolve_spacing((4, 8, 8), domain=(1.0, 2.0, 4.0)) == (0.25, 0.25, 0.5)
    assert expand_masks("a_%s_%02d", ["v:3"], 1, 1) == [(1, "v", 3, "a_v_01")]
    with pytest.raises(ValueError):
        B.assert_appendable(INFO, VolumeInfo(8, 8, 4))
    with pytest.raises(ValueError):
        VolumeInfo(8, 8, 8, brick=6).check()


def test_seed_function_in_sql(spark):
    seeds.register_seed_functions(spark)
    assert spark.sql("select * from grid_seeds(4, 0.0, 0.0, 0.0, 1.0, 1.0)").count() == 4


def test_thinned_lines_by_hand(spark):
    rows = [(i, k, 0.1 * k * (i + 1), 0.0, 0.0, float(k)) for i in range(6) for k in range(40)]
    v = spark.createDataFrame(rows, "line_id long, seq int, x double, y double, z double, time double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {(r.line_id, r.seq) for r in TR.thin_vertices(v, 0.75, 1e9).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for i in range(6):
        last = None
        for k in range(40):
            if last is None or k == 39 or 0.1 * k * (i + 1) - last >= 0.75:
                want.add((i, k))
                last = 0.1 * k * (i + 1)
    assert got == want


def test_particles_go_on_after_an_exit_whatever_the_batches(spark, tmp_path):
    from fieldspark.streaming import streams

    info = VolumeInfo(8, 8, 8)
    one = np.ones(8**3)
    field = pd.DataFrame([{"t": 0, "bx": 0, "by": 0, "bz": 0, "nx": 8, "ny": 8, "nz": 8, "ox": 0, "oy": 0, "oz": 0, "u": 40.0 * one, "v": 0 * one, "w": 0 * one}])
    # ids of ticks don't follow their times
    ticks = pd.DataFrame([(p, (k * 7) % 23, 0.01 + 0.01 * (k % 5), pd.Timestamp("2024-01-01") + pd.Timedelta(k, "s")) for k in range(23) for p in range(4)], columns=["pid", "tick", "dt", "ts"])

    def run(files: int, life: float) -> dict:
        at = f"{tmp_path}/{files}-{life}"
        rows = spark.createDataFrame(ticks)
        for k in range(files):
            rows.where((F.unix_timestamp("ts") - int(ticks["ts"].min().timestamp())) * files / 23 - k >= 0).where((F.unix_timestamp("ts") - int(ticks["ts"].min().timestamp())) * files / 23 - k < 1).coalesce(1).write.mode("append").parquet(at)
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
        last = {}
        out = streams.stream_particles(source, field, info, seed_box=((0.0, 0.0, 0.0), (0.1, 0.1, 0.1)), life=life)
        out.writeStream.outputMode("update").foreachBatch(lambda b, n: last.update({r.pid: r for r in b.collect()})).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination()
        return {p: (r.alive, *np.round([r.x, r.y, r.z, r.time], 9).tolist()) for p, r in last.items()}

    for life in (1e9, 0.2):
        assert run(1, life) == run(3, life) == run(23, life)


@pytest.mark.parametrize("keep,want", [(None, {1: 2.0, 2: 3.0}), (7200.0, {1: 1.0, 2: 1.0})])
def test_late_visits_are_left_out_and_silent_particles_forgotten(spark, tmp_path, keep, want):
    from fieldspark.streaming import streams

    files = [
        [(1, 1, 5, 1.0, "2024-01-20 00:00:00"), (2, 1, 5, 1.0, "2024-01-20 00:00:00")],
        [(1, 2, 5, 5.0, "2024-01-10 00:00:00"), (2, 2, 5, 1.0, "2024-01-21 00:00:00")],  # the first is ten days late
        [(1, 3, 5, 1.0, "2024-01-25 00:00:00")],
        [(2, 3, 5, 1.0, "2024-01-25 01:00:00")],
    ]
    at = f"{tmp_path}/{keep}"
    for rows in files:
        df = spark.createDataFrame(rows, "pid long, seq int, region long, dt double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(at)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    last = {}
    out = streams.stream_time_in_cell(source, 0.5, "1 hour", keep=keep)
    out.writeStream.outputMode("update").foreachBatch(lambda b, n: last.update({r.pid: r.time_in_cell for r in b.collect()})).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination()
    assert last == want


@pytest.mark.parametrize("k", [-9, -3, -1, 0, 2, 9])
def test_periodic_neighbours_by_index(spark, k):
    cells = spark.createDataFrame([(0, x, y, 0, None if x == 2 else 10.0 * x + y) for x in range(5) for y in range(2)], "t int, x int, y int, z int, u double")
    got = {(r.x, r.y): r.n for r in stencil.shift(cells, "u", "x", k, "periodic", "n").collect()}
    assert got == {(x, y): None if (x + k) % 5 == 2 else 10.0 * ((x + k) % 5) + y for x in range(5) for y in range(2)}


def test_dense_vertices_have_the_curves_velocity_and_normal(spark, vortex):
    start = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 0.3, 0.2, 0.1)], "pid long, x double, y double, z double")
    info = VolumeInfo(8, 8, 8, 1, brick=8, overlap=2)
    made = dict(scheme="dopri5", dt=0.02, tol=10.0, dt_max=0.3, max_age=3.0, dense=True, normals=True, pos_diff=0.01, time_diff=1e9)
    v, ends = TR.trace_stream(vortex, info, start, **made)
    rows = v.toPandas().sort_values(["line_id", "seq"])
    for _, line in rows.groupby("line_id"):
        at, time = line[["x", "y", "z"]].to_numpy(), line["time"].to_numpy()
        vel, nrm = line[["vel_x", "vel_y", "vel_z"]].to_numpy(), line[["nrm_x", "nrm_y", "nrm_z"]].to_numpy()
        assert line["seq"].tolist() == list(range(len(line))) and len(line) > 6
        slope = (at[2:] - at[:-2]) / (time[2:] - time[:-2])[:, None]
        assert np.abs(slope - vel[1:-1]).max() < 0.1 * np.abs(vel).max()
        assert np.allclose((vel * nrm).sum(1), 0, atol=1e-9) and np.allclose(np.linalg.norm(nrm, axis=1), 1)
    short = TR.trace_stream(vortex, info, start, **(made | {"max_len": 5}))[0].groupBy("line_id").count().collect()
    assert all(r["count"] == 5 for r in short)


def test_lines_on_their_way_are_an_error(spark, vortex):
    start = spark.createDataFrame([(1, 0.5, 0.0, 0.0)], "pid long, x double, y double, z double")
    with pytest.raises(RuntimeError, match="rounds"):
        TR.trace_stream(vortex, VolumeInfo(8, 8, 8, 1, brick=4, overlap=1), start, scheme="rk4", dt=0.1, max_age=60.0, max_len=10**6, rounds=1)


def test_prefix_sums_and_trace_statistics(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5)], "k string, i int, s int")
    assert sorted(r.prefix for r in stats.prefix_sum(rows, ["k"], ["i"], "s").collect()) == [2, 5, 5]
    assert sorted(r.prefix for r in stats.prefix_sum(rows, ["k"], ["i"], "s", exclusive=True).collect()) == [0, 0, 2]
    for run in (1, 2):
        VOL.write_trace_stats(rows.where(f"i = {run}"), f"{tmp_path}/stats", run=run, scheme="rk4")
    got = VOL.read_stats(spark, f"{tmp_path}/stats", "run int, scheme string, k string, i int, s int")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "rk4", "a", 1, 2), (1, "rk4", "b", 1, 5), (2, "rk4", "a", 2, 3)]
