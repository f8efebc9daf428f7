"""Queries on traces, sources and streams over the volume derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldspark.functions import info as I
from fieldspark.functions.session import shared
from fieldspark.operators import bricks as B
from fieldspark.operators import lines as L
from fieldspark.operators import seeds, stats
from fieldspark.operators import trace as TR
from fieldspark.plans.catalog import BOX, G, P, V, VIS, XYZ, _axis_sql, _EIG, _FROM_AXES, _gradient_sql, _HM, _LONG, _ST, _STC, _TIC, _U, query, rounded, rr
from fieldspark.plans.fixtures import CHANNELS, INFO, grid, grid_points, r6, regions, table, vertices, visits, world_points
from fieldspark.plans.sweep import spaced, sweep_table, trace_sweep
from fieldspark.plans.trace_sql import AXES, CH, SEEDS, VMAX, WORLD, ctes, trace, velocity
from fieldspark.sources import volumes as VOL
from fieldspark.streaming import streams

#: Two bricks per axis, with ghost cells enough for the kernels used here.
TRACE = I.VolumeInfo(nx=8, ny=8, nz=8, nt=2, brick=8, overlap=2)
ENDS = ["x", "y", "z", "time"]


def _seeds(s, d) -> DataFrame:
    return world_points(s, d).select("pid", "x", "y", "z")


def _frozen(s, d) -> DataFrame:
    return grid(s, d).where("t = 0")


def _ends(df: DataFrame) -> DataFrame:
    return df.select("line_id", "status", "steps_total", "steps_accepted", *[r6(c).alias(c) for c in ENDS])


@query("adv1_euler_step", f"WITH {G}, {P}, {', '.join(_axis_sql('linear', a) for a in 'xyz')}, v AS (SELECT pid,sum(wx*wy*wz*u) u,sum(wx*wy*wz*v) v,sum(wx*wy*wz*w) w FROM p JOIN ax ON p_x=pid JOIN ay ON p_y=pid JOIN az ON p_z=pid JOIN g ON g.t=p.t AND g.x=ix AND g.y=iy AND g.z=iz GROUP BY pid) SELECT pid,p.t,{rr('px+0.5+0.01*u', 'gx')},{rr('py+0.5+0.01*v', 'gy')},{rr('pz+0.5+0.01*w', 'gz')} FROM p JOIN v USING (pid)")
def _(s, d):
    return rounded(TR.euler_step(grid_points(s, d).select("pid", "t", "gx", "gy", "gz"), grid(s, d), INFO, 0.01), ["pid", "t"], ["gx", "gy", "gz"])


_ENDS = "SELECT id line_id,status,total steps_total,took steps_accepted," + ",".join(rr(f"2*g{a}-8", a) for a in AXES) + "," + rr("time", '"time"')
_LAST = f"{_ENDS} FROM tr WHERE status<>'active'"

for _k, _scheme in enumerate(["euler", "heun", "rk3", "rk4", "bs32", "rkf34", "rkf45", "rkf54", "dopri5"], 1):
    query(f"adv{_k}_trace_{_scheme}", f"{ctes(trace(_scheme, 0.005, 0.05, tol=0.5, dt_max=0.02))} {_LAST}")(lambda s, d, scheme=_scheme: _ends(TR.trace_stream(_frozen(s, d), TRACE, _seeds(s, d), scheme=scheme, dt=0.005, dt_max=0.02, tol=0.5, max_age=0.05)[1]))


def _frames_sql() -> str:
    """Normals carried along each line: at first across the velocity and the axis it has least of, then kept across it."""
    at = velocity("SELECT * FROM tr, fld", {a: f"g{a}" for a in AXES}, 0, "catrom")
    vx = f"vx AS MATERIALIZED (SELECT id,n,gx,gy,gz,time,k0u u,k0v v,k0w w FROM ({at}))"
    x_least, y_least = "abs(u)<=abs(v) AND abs(u)<=abs(w)", "abs(v)<=abs(w)"
    pick = lambda a, b, c: f"CASE WHEN {x_least} THEN {a} WHEN {y_least} THEN {b} ELSE {c} END"
    first = f"SELECT *,{pick('0', '-w', 'v')} a,{pick('w', '0', '-u')} b,{pick('-v', 'u', '0')} c FROM vx WHERE n=0"
    unit = "a/sqrt(a*a+b*b+c*c) nx,b/sqrt(a*a+b*b+c*c) ny,c/sqrt(a*a+b*b+c*c) nz"
    own = "(u*u+v*v+w*w)"
    along = "(nx*u+ny*v+nz*w)"  # (v x n) x v is n times v squared, less v times n.v
    step = f"SELECT *,nx*{own}-u*{along} a,ny*{own}-v*{along} b,nz*{own}-w*{along} c FROM (SELECT vx.*,nx,ny,nz FROM fr JOIN vx ON vx.id=fr.id AND vx.n=fr.n+1)"
    return f"{vx}, fr AS (SELECT id,n,gx,gy,gz,time,{unit} FROM ({first}) UNION ALL SELECT id,n,gx,gy,gz,time,{unit} FROM ({step}))"


_FRAMES = ",".join([*[rr(f"2*g{a}-8", a) for a in AXES], rr("time", '"time"'), *[rr(f"n{a}", f"nrm_{a}") for a in AXES]])


@query("trc1_stream_lines", f"{ctes(trace('rk4', 0.005, 0.04, kernel='catrom'), _frames_sql())} SELECT id line_id,n seq,{_FRAMES} FROM fr")
def _(s, d):
    return rounded(TR.trace_stream(_frozen(s, d), TRACE, _seeds(s, d), scheme="rk4", kernel="catrom", dt=0.005, max_age=0.04, normals=True)[0], ["line_id", "seq"], ["x", "y", "z", "time", "nrm_x", "nrm_y", "nrm_z"])


def _thin_sql() -> str:
    """The last vertex kept goes along each line; a vertex far from it, in place or time, is kept, and so are both ends."""
    far = "4*(pow(v.gx-lx,2)+pow(v.gy-ly,2)+pow(v.gz-lz,2))>=0.25 OR v.time-lt>=0.02"
    last = ",".join(f"CASE WHEN far THEN {a} ELSE {b} END" for a, b in (("gx", "lx"), ("gy", "ly"), ("gz", "lz"), ("time", "lt")))
    step = f"SELECT v.id,v.n,v.gx,v.gy,v.gz,v.time,lx,ly,lz,lt,{far} far FROM th JOIN tr v ON v.id=th.id AND v.n=th.n+1"
    return f"th AS (SELECT id,n,gx,gy,gz,time,gx lx,gy ly,gz lz,time lt,true kept FROM tr WHERE n=0 UNION ALL SELECT id,n,gx,gy,gz,time,{last},far FROM ({step}))"


@query("trc2_thinned_lines", f"{ctes(trace('rk4', 0.005, 0.04), _thin_sql())} SELECT id line_id,n seq,{rr('2*gx-8', 'x')} FROM th QUALIFY kept OR n=max(n) OVER (PARTITION BY id)")
def _(s, d):
    v = TR.trace_stream(_frozen(s, d), TRACE, _seeds(s, d), scheme="rk4", dt=0.005, max_age=0.04)[0]
    return TR.thin_vertices(v, 0.5, 0.02).select("line_id", "seq", r6("x").alias("x"))


@query("trc3_dense_lines")
def _(s, d):
    return rounded(TR.trace_stream(_frozen(s, d), TRACE, _seeds(s, d), scheme="dopri5", dt=0.01, tol=1.0, dt_max=0.02, max_age=0.04, dense=True, normals=True, pos_diff=0.25, time_diff=1.0)[0], ["line_id", "seq"], ["x", "y", "z", "time", "vel_x", "vel_y", "vel_z", "nrm_x", "nrm_y", "nrm_z"])


@query("trc4_path_lines", f"{ctes(trace('rk4', 0.01, 0.1, path=True))} {_LAST}")
def _(s, d):
    return _ends(TR.trace_path(grid(s, d), TRACE, _seeds(s, d), scheme="rk4", dt=0.01, max_age=0.1)[1])


@query("trc5_particles", f"{ctes(trace('rk4', 0.01, 0.03, most=None, slow=5.0))} SELECT pid,x,y,z,\"time\" FROM (SELECT id pid," + ",".join(rr(f"2*g{a}-8", a) for a in AXES) + "," + rr("time", '"time"') + " FROM tr WHERE status='old')")
def _(s, d):
    return rounded(TR.step_particles(_seeds(s, d), _frozen(s, d), TRACE, 0.01, 3, 5.0), ["pid"], ["x", "y", "z", "time"])


@query("trc6_end_points", f"{ctes(trace('rk4', 0.01, 0.04, most=None))} SELECT line_id pid,status,x,y,z,\"time\" FROM ({_LAST})")
def _(s, d):
    return TR.advect_points(_seeds(s, d), _frozen(s, d), TRACE, 0.04, scheme="rk4", dt=0.01).select("pid", "status", *[r6(c).alias(c) for c in ENDS])


_FTLE_SEEDS = "seed AS (SELECT CAST((a.i*r+b.i)*6+k AS BIGINT) id," + ",".join(f"({p})/2+4 g{a}" for a, p in zip(AXES, ("-6.0+12.0*a.i/r+dx", "-6.0+12.0*b.i/r+dy", "dz"), strict=True)) + " FROM (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) r FROM customer) n,(SELECT unnest(range(CAST(floor(sqrt(count(*))) AS BIGINT))) i FROM customer) a,(SELECT unnest(range(CAST(floor(sqrt(count(*))) AS BIGINT))) i FROM customer) b,(VALUES (0,-0.1,0.0,0.0),(1,0.1,0.0,0.0),(2,0.0,-0.1,0.0),(3,0.0,0.1,0.0),(4,0.0,0.0,-0.1),(5,0.0,0.0,0.1)) q(k,dx,dy,dz))"
_FLOW_MAP = "fm AS (SELECT id//6 cell,max(time) age," + ",".join(f"sum(CASE id%6 WHEN {2 * c + 1} THEN 2*g{a} WHEN {2 * c} THEN -2*g{a} ELSE 0 END)/0.2 m{r}{c}" for r, a in enumerate(AXES) for c in range(3)) + " FROM tr WHERE status<>'active' GROUP BY 1)"
_GRAM = "m0 AS (SELECT cell,age," + ",".join("+".join(f"m{r}{i}*m{r}{k}" for r in range(3)) + f" {n}" for n, i, k in zip("abcdef", (0, 1, 2, 0, 0, 1), (0, 1, 2, 1, 2, 2), strict=True)) + " FROM fm)"


@query("trc7_ftle", f"{ctes(trace('rk4', 0.005, 0.03, most=None), _FLOW_MAP, _GRAM, _EIG, seeds=_FTLE_SEEDS)} SELECT CAST(cell//r AS INT) gx,CAST(cell%r AS INT) gy,{rr('CASE WHEN age>0 THEN ln(sqrt(greatest(hi,1e-30)))/age ELSE 0.0 END', 'ftle')} FROM e4,(SELECT CAST(floor(sqrt(count(*))) AS BIGINT) r FROM customer)")
def _(s, d):
    res = I.isqrt(table(s, d, "customer").count())
    return rounded(TR.ftle(_frozen(s, d), TRACE, res, BOX, 0.0, (0.1, 0.1, 0.1), 0.03, scheme="rk4", dt=0.005), ["gx", "gy"], ["ftle"])


_VP = "p AS (SELECT line_id*1000000+seq pid,line_id,seq,x/2+3.5 px,y/2+3.5 py,z/2+3.5 pz,0 t FROM vx)"
_V0 = V.replace("p AS", "p0 AS", 1).replace("FROM p)", "FROM p0)")


@query("trc9_enriched_vertices", f"WITH {_V0}, {G}, {_VP}, {_gradient_sql('catrom', 'u v temp')}, {', '.join(_axis_sql('catrom', a) for a in 'xyz')}, s0 AS (SELECT pid,sum(wx*wy*wz*u) u,sum(wx*wy*wz*temp) temp {_FROM_AXES}) SELECT line_id,seq,{rr('u', 'u')},{rr('temp', 'temp')},{rr('du_x', 'j00')},{rr('dv_z', 'j12')},{rr('dtemp_x', 'grad_temp_x')} FROM p JOIN s0 USING (pid) JOIN sx USING (pid) JOIN sz USING (pid)")
def _(s, d):
    v = vertices(s, d).select("line_id", "seq", "x", "y", "z", "time")
    return rounded(TR.enrich_vertices(v, grid(s, d), INFO), ["line_id", "seq"], ["u", "temp", "j00", "j12", "grad_temp_x"])


@query("trc10_limited_steps", f"{ctes(VMAX, trace('euler', 0.02, 0.04, limit_step=True))} {_LAST}")
def _(s, d):
    return _ends(TR.trace_stream(_frozen(s, d), TRACE, _seeds(s, d), scheme="euler", dt=0.02, max_age=0.04, limit_step=True, lines_a_task=2000)[1])


@query("trj7_trace_stats", f"{ctes(trace('dopri5', 0.005, 0.04, tol=0.5, dt_max=0.02))} SELECT count(*) lines,CAST(sum(total) AS BIGINT) steps_total,CAST(sum(took) AS BIGINT) steps_accepted,CAST(sum(6*total) AS BIGINT) evaluations,count_if(status='old') old,count_if(status='left') \"left\",count_if(status='long') long,count_if(status NOT IN ('old','left','long')) other FROM tr WHERE status<>'active'")
def _(s, d):
    return TR.trace_stats(TR.trace_stream(_frozen(s, d), TRACE, _seeds(s, d), scheme="dopri5", dt=0.005, dt_max=0.02, tol=0.5, max_age=0.04)[1], "dopri5")


def _flow_sql(source: str, steps: int) -> str:
    """Each brick's particles, the same in all, held to their brick; the share that leaves through each side."""
    unit = ",".join(f"{_U('i', 1, k)} r{a}" for k, a in enumerate(AXES))
    brick = ",".join(f"{e} e{a}" for a, e in zip(AXES, ("b%2", "(b//2)%2", "b//4"), strict=True))
    places = ",".join(f"4*e{a}+4*r{a} g{a}" for a in AXES)
    seed = f"unit AS (SELECT i,{unit} FROM (SELECT row_number() OVER ()-1 i FROM {source})), seed AS (SELECT CAST(b*1000000+i AS BIGINT) id,{places} FROM unit,(SELECT b,{brick} FROM range(8) r(b)))"
    sides = [f"g{a}<4*e{a}" for a in AXES] + [f"g{a}>4*e{a}+4" for a in AXES]
    wide = "wide AS (SELECT ex,ey,ez," + ",".join(f"avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END) d{k}" for k, x in enumerate(sides)) + " FROM tr WHERE status<>'active' GROUP BY 1,2,3)"
    rows = " UNION ALL ".join(f'SELECT ex bx,ey "by",ez bz,{k} dir,{rr(f"d{k}", "freq")} FROM wide' for k in range(6))
    return f"{ctes(trace('rk4', 0.01, 0.01 * steps, most=None, hold=True), wide, seeds=seed)} {rows}"


@query("trj8_flow_graph", _flow_sql("customer", 8))
def _(s, d):
    n = table(s, d, "customer").count()
    unit = seeds.seed_random(s, n, ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)))
    return rounded(TR.flow_graph(_frozen(s, d), TRACE, unit, 0.01, 8), ["bx", "by", "bz", "dir"], ["freq"])


@query("swp1_sweep_table", "WITH s(scheme,ad) AS (VALUES ('rk4',false),('dopri5',true)), q AS (SELECT DISTINCT CAST(c_custkey%5 AS INT) quality FROM customer) SELECT scheme,kernel,quality," + rr("CASE WHEN ad THEN 0.001 ELSE 0.001*pow(8.0,quality/4.0) END", "dt") + "," + rr("CASE WHEN ad THEN 0.01*pow(100.0,quality/4.0) ELSE 0.01 END", "tol") + " FROM s,(VALUES ('linear'),('catrom')) k(kernel),q")
def _(s, d):
    return rounded(sweep_table(table(s, d, "customer").select((F.col("c_custkey") % 5).alias("quality")).distinct(), ["rk4", "dopri5"], ["linear", "catrom"], 5, (0.001, 0.008), (0.01, 1.0)), ["scheme", "kernel", "quality"], ["dt", "tol"])


_SWEEP = [(sc, dt) for sc in ("euler", "rk4") for dt in (0.0025, 0.01)]


@query("swp1_trace_sweep", ctes(*[trace(sc, dt, 0.02, name=f"tr{k}") for k, (sc, dt) in enumerate(_SWEEP)]) + " " + " UNION ALL ".join(f"SELECT {k} run,line_id,status,x,y,z,\"time\" FROM ({_ENDS} FROM tr{k} WHERE status<>'active')" for k in range(len(_SWEEP))))
def _(s, d):
    runs = [TR.TraceParams(scheme=sc, dt=dt, max_age=0.02, tol=0.5, dt_max=0.02) for sc in ("euler", "rk4") for dt in spaced(0.0025, 0.01, 2)]
    out = trace_sweep(_frozen(s, d), TRACE, _seeds(s, d), runs)
    return out.select("run", "line_id", "status", *[r6(c).alias(c) for c in ENDS])


# ---------------------------------------------------------------- sources and sinks


def _folder(s) -> str:
    return f"{shared(s)}/fieldspark-{uuid.uuid4().hex}"


@query("src4_5_volume_table", f"WITH {G} SELECT t,x,y,z,u,temp FROM g")
def _(s, d):
    at = _folder(s)
    VOL.write_volume(grid(s, d), INFO, at)
    return VOL.read_volume(s, at)[0].select(F.col("t").cast("int").alias("t"), "x", "y", "z", "u", "temp")


@query("src6_raw_export", f"WITH {G} SELECT t,x,y,z,{rr('CAST(u AS FLOAT)::DOUBLE', 'u')},{rr('CAST(temp AS FLOAT)::DOUBLE', 'temp')} FROM g")
def _(s, d):
    rows = B.with_halo(grid(s, d), INFO, "clamp")
    return rounded(VOL.unpack_raw(VOL.export_raw(rows, INFO, _folder(s), ["u", "temp"]), INFO, ["u", "temp"]), list(XYZ), ["u", "temp"])


@query("src7_stats_csv", f"WITH {G}, {_LONG} SELECT t,channel,count(*) n,{rr('avg(v)', 'avg')} FROM c GROUP BY t,channel")
def _(s, d):
    at = _folder(s)
    VOL.write_stats(rounded(stats.stats(grid(s, d), CHANNELS, ["t"]), ["t", "channel", "n"], ["avg"]), at)
    return VOL.read_stats(s, at, "t int, channel string, n bigint, avg double")


@query("src8_line_set", f"WITH {V} SELECT CAST(3 AS BIGINT) line_id,seq,x FROM vx")
def _(s, d):
    at = _folder(s)
    VOL.write_lines(vertices(s, d), at)
    return VOL.read_lines(s, at, 3).select("line_id", "seq", "x")


@query("src9_flow_graph", _flow_sql("supplier", 2))
def _(s, d):
    at = _folder(s)
    unit = seeds.seed_random(s, table(s, d, "supplier").count(), ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)))
    VOL.write_flow_graph(TR.flow_graph(_frozen(s, d), TRACE, unit, 0.01, 2), at)
    return rounded(VOL.read_flow_graph(s, at, TRACE), ["bx", "by", "bz", "dir"], ["freq"])


@query("src11_regions", "SELECT s_nationkey tx, CAST(max(s_suppkey%16) AS INT) ty, CAST(count(*) AS BIGINT) region FROM supplier GROUP BY 1")
def _(s, d):
    rows = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("tx")).agg(F.max(F.col("s_suppkey") % 16).alias("ty"), F.count("*").alias("region"))
    return VOL.read_regions(rows)


# ---------------------------------------------------------------- streams


def _stream(s, df: DataFrame, files: int) -> DataFrame:
    """A frame as a stream of Parquet files, one for each trigger."""
    at = _folder(s)
    if "ts" in df.columns:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    order = next(F.col(c).cast("timestamp").cast("double") if c == "ts" else F.col(c).cast("double") for c in ("ts", "seq", "t") if c in df.columns)
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.lit(files - 1), F.floor((order - low) / max(high - low, 1e-9) * files))
    for k in range(files):  # one after the other: a stream takes files in the order of their times
        df.where(part == k).coalesce(1).write.mode("append").parquet(at)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(at)


def _collect(s, df: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The last row of each key after the stream has ended; batches are numbered tables in the shared folder."""
    at = _folder(s)
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/batch={n}")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = s.read.schema(StructType([*df.schema.fields, StructField("_batch", LongType())])).parquet(f"{at}/out")
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "_batch").alias("r"))
    return last.select(*keys, "r.*")


@query("str1_ingest", f"WITH {G}, {_LONG} SELECT t,channel,{_ST} FROM c GROUP BY t,channel")
def _(s, d):
    at = _folder(s)
    streams.stream_ingest(_stream(s, grid(s, d), 2), INFO, at, CHANNELS, f"{at}/state").awaitTermination()
    return rounded(stats.finish_stats(streams.ingested_stats(s, at)), ["t", "channel", "n", "orig_bytes"], _STC)


@query("str2_particles")
def _(s, d):
    packed = B.pack_bricks(B.with_halo(_frozen(s, d), I.VolumeInfo(8, 8, 8, brick=16, overlap=4), halo=2), ["u", "v", "w"]).toPandas()  # one small brick
    ticks = table(s, d, "events").select((F.col("user_id") % 64).alias("pid"), F.col("event_id").alias("tick"), ((F.col("event_id") % 4 + 1) / 1000.0).alias("dt"), "ts")
    out = streams.stream_particles(_stream(s, ticks, 3), packed, I.VolumeInfo(8, 8, 8), seed_box=BOX)
    return _collect(s, out, ["pid"]).select("pid", "alive", *[r6(c).alias(c) for c in ("x", "y", "z", "time")])


@query("str3_time_in_cell", f"{_TIC} SELECT pid,own current_cell,ins time_in_cell,lng longest_cell,most longest_time FROM st QUALIFY row_number() OVER (PARTITION BY pid ORDER BY seq DESC)=1")
def _(s, d):
    return _collect(s, streams.stream_time_in_cell(_stream(s, visits(s, d), 3), 0.6, "30 days"), ["pid"])


@query("str4_heat_map", f"WITH {V} SELECT gx,gy,gz,cnt FROM ({_HM('0')})")
def _(s, d):
    return _collect(s, streams.stream_heat_map(_stream(s, vertices(s, d), 3), INFO, (8, 8, 8)), ["gx", "gy", "gz"])


@query("str4_5_windowed_heat_map", f"WITH {P} SELECT strftime(ts, '%Y-%m-%d') AS ymd,CAST(trunc(px/7.01*8) AS INT) gx,count(*) cnt FROM p JOIN events ON event_id=pid GROUP BY 1,2")
def _(s, d):
    rows = table(s, d, "events").select("ts", ((F.col("event_id") % 701) / 100.0 * 16.0 / 7.01 - 8.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    out = streams.stream_heat_map(_stream(s, rows, 3), INFO, (8, 8, 8), "1 day", "30 days")
    done = _collect(s, out.select(F.col("window.start").alias("start"), "gx", "gy", "gz", "cnt"), ["start", "gx", "gy", "gz"])
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("ymd"), "gx", "cnt")


@query("trj10_progress", f"{ctes(trace('rk4', 0.005, 0.03))} SELECT {rr('avg(least(1.0,greatest(len/64,time/0.03)))', 'progress')} FROM tr WHERE status<>'active'")
def _(s, d):
    return rounded(TR.trace_progress(TR.trace_stream(_frozen(s, d), TRACE, _seeds(s, d), scheme="rk4", dt=0.005, max_age=0.03)[1], 64, 0.03), [], ["progress"])


@query("src13_vortex", "WITH n AS (SELECT CAST(CAST(floor(sqrt(count(*))) AS BIGINT) AS INT) n FROM customer), a AS (SELECT CAST(i AS INT) i FROM (SELECT unnest(range(CAST(floor(sqrt(count(*))) AS BIGINT))) i FROM customer)) SELECT 0 t,x.i x,y.i y,z.i z," + rr("-(2*(y.i+0.5)/n-1)", "u") + "," + rr("2*(x.i+0.5)/n-1", "v") + ",0.0 w FROM a x,a y,a z,n")
def _(s, d):
    n = I.isqrt(table(s, d, "customer").count())
    return rounded(VOL.synth_vortex(s, n, n, n), ["t", "x", "y", "z"], ["u", "v", "w"])


__all__ = ["VIS", "XYZ", "L", "regions"]
