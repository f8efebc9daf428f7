"""Queries on parts of volumes: stores, pruned reads, gaps, ingest in pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import tensor as T
from fieldspark.functions.session import shared
from fieldspark.operators import bricks as B
from fieldspark.operators import iso as ISO
from fieldspark.operators import quantize as Q
from fieldspark.operators import select as S
from fieldspark.operators import ranges, seeds, smoothing, stats, stencil
from fieldspark.operators.trace import TraceParams
from fieldspark.plans.catalog import _B3, _BR, _C0, _C4, _CR, _LONG, _ST, _STC, _U, G, J, ORACLES, WP, query, rounded, rr
from fieldspark.plans.fixtures import CHANNELS, INFO, grid, r6, table, world_points
from fieldspark.plans.trace_sql import FIELD, velocity
from fieldspark.plans.traces import TRACE, _stream
from fieldspark.sources import raw_source as RAW
from fieldspark.sources import store
from fieldspark.sources import volumes as VOL
from fieldspark.streaming import particles as PS
from fieldspark.streaming import streams

ISO_VALUE = 100.0
#: A measure that grows along z, so that an iso value lies in few bricks.
GM = f"{G}, gm AS (SELECT *, u+20.0*z m FROM g)"
_LIVE = f"""b0 AS (SELECT DISTINCT t,{_BR} FROM g), live AS (SELECT b0.t,bx,"by",bz FROM b0 JOIN gm ON gm.t=b0.t AND x BETWEEN 2*bx-1 AND 2*bx+2 AND y BETWEEN 2*"by"-1 AND 2*"by"+2 AND z BETWEEN 2*bz-1 AND 2*bz+2 GROUP BY ALL HAVING min(m)<={ISO_VALUE} AND max(m)>={ISO_VALUE})""".replace("GROUP BY ALL", 'GROUP BY b0.t,bx,"by",bz')
_IN_LIVE = '(t,x//2,y//2,z//2) IN (SELECT (t,bx,"by",bz) FROM live)'


def folder(s) -> str:
    return f"{shared(s)}/fieldspark-{uuid.uuid4().hex}"


def measured(s, d) -> DataFrame:
    return grid(s, d).withColumn("m", F.col("u") + 20.0 * F.col("z"))


def stored(s, d) -> str:
    """A store of 16 files a step."""
    at = folder(s)
    store.create(s, at, INFO)
    store.append(measured(s, d), INFO, at, ["u", "v", "w", "m"], file_bytes=1024)
    return at


@query("src4_pruned_read", f"""WITH {GM}, {_LIVE}, c AS (SELECT *,{_BR} FROM gm WHERE {_IN_LIVE}) SELECT t,x,y,z,{rr('m', 'm')},CAST(((bx&1)|(("by"&1)<<1)|((bz&1)<<2)|((bx>>1)<<3)|(("by">>1)<<4)|((bz>>1)<<5))>>2 AS INT) file FROM c""")
def _(s, d):
    at = stored(s, d)
    cells = store.read(s, at, S.prune_iso(store.directory(s, at), "m", ISO_VALUE))
    return cells.select("t", "x", "y", "z", r6("m").alias("m"), F.regexp_extract(F.input_file_name(), r"/store_part=(\d+)/", 1).cast("int").alias("file"))


@query("brk6_directory", f"""WITH {GM}, {_LIVE} SELECT live.t,live.bx,live."by",live.bz,CAST(count(*) AS BIGINT) cells,{rr('min(m)', 'least')} FROM live JOIN (SELECT *,{_BR} FROM gm) c ON c.t=live.t AND c.bx=live.bx AND c."by"=live."by" AND c.bz=live.bz GROUP BY 1,2,3,4""")
def _(s, d):
    at = stored(s, d)
    live = S.prune_iso(store.directory(s, at), "m", ISO_VALUE)
    inner = store.read(s, at).groupBy("t", "bx", "by", "bz").agg(F.min("m").alias("least"))
    return rounded(live.join(inner, ["t", "bx", "by", "bz"]), ["t", "bx", "by", "bz", "cells"], ["least"])


@query("iso2_pruned_crossings", f"WITH {GM}, src AS (SELECT * FROM gm), c AS ({_CR('m', str(ISO_VALUE))}) SELECT t,x,y,{rr('at_', 'at')},enters FROM c")
def _(s, d):
    at = stored(s, d)
    part = store.read(s, at, S.prune_iso(store.directory(s, at), "m", ISO_VALUE), ghosts=1)
    return ISO.iso_crossings(part, "m", ISO_VALUE, "z").select("t", "x", "y", r6("at").alias("at"), "enters")


@query("iso3_pruned_first_hit", f"WITH {GM}, src AS (SELECT * FROM gm), c AS ({_CR('m', str(ISO_VALUE))}) SELECT t,x,y,{rr('min(at_)', 'depth')} FROM c GROUP BY t,x,y")
def _(s, d):
    at = stored(s, d)
    part = store.read(s, at, S.prune_iso(store.directory(s, at), "m", ISO_VALUE), ghosts=1)
    return rounded(ISO.first_hit(part, "m", ISO_VALUE, "z"), ["t", "x", "y"], ["depth"])


@query("drv2_pruned_jacobian", f"WITH {J}, gm AS (SELECT *, u+20.0*z m FROM g), {_LIVE} SELECT t,x,y,z,{rr('j00', 'j00')},{rr('j02', 'j02')},{rr('j11', 'j11')},{rr('j20', 'j20')} FROM j WHERE {_IN_LIVE}")
def _(s, d):
    at = stored(s, d)
    part = store.read(s, at, S.prune_iso(store.directory(s, at), "m", ISO_VALUE), ghosts=1)
    return rounded(stencil.jacobian(part, size=INFO.size).where("not is_halo"), ["t", "x", "y", "z"], ["j00", "j02", "j11", "j20"])


_HOLES = f"WITH {G}, h AS (SELECT * FROM g WHERE (x+2*y+3*z)%5<>0)"


@query("drv1_gaps", f"{_HOLES} SELECT h.t,h.x,h.y,h.z,{rr('(CASE WHEN h.x=7 THEN h.u ELSE a.u END-CASE WHEN h.x=0 THEN h.u ELSE b.u END)/2', 'dx')},{rr('c.u', 'far')},{rr('p.u', 'wrapped')} FROM h LEFT JOIN h a ON a.t=h.t AND a.y=h.y AND a.z=h.z AND a.x=h.x+1 LEFT JOIN h b ON b.t=h.t AND b.y=h.y AND b.z=h.z AND b.x=h.x-1 LEFT JOIN h c ON c.t=h.t AND c.y=h.y AND c.x=h.x AND c.z=h.z+3 LEFT JOIN h p ON p.t=h.t AND p.x=h.x AND p.z=h.z AND p.y=(h.y+6)%8")
def _(s, d):
    h = grid(s, d).where("(x + 2 * y + 3 * z) % 5 <> 0")
    h = stencil.derivative(h, "u", "x", size=INFO.nx, out="dx")
    h = stencil.shift(h, "u", "z", 3, "null", "far")
    return rounded(stencil.shift(h, "u", "y", -2, "periodic", "wrapped", size=INFO.ny), ["t", "x", "y", "z"], ["dx", "far", "wrapped"])


@query("win6_gaps", f"{_HOLES} SELECT h.t,h.x,h.y,h.z FROM h JOIN h b ON b.t=h.t AND b.y=h.y AND b.z=h.z AND b.x=h.x-1 WHERE (h.u>=25)<>(b.u>=25)")
def _(s, d):
    h = grid(s, d).where("(x + 2 * y + 3 * z) % 5 <> 0").withColumn("in", F.col("u") >= 25)
    return ISO.transitions(h, "in", "x").select("t", "x", "y", "z")


@query("src5_append", f"WITH {G}, r AS (SELECT t,u+1.0 u FROM g WHERE t=0 UNION ALL SELECT t,u FROM g WHERE t=1 UNION ALL SELECT 2,u*2.0 FROM g WHERE t=1) SELECT t,3 nt,CAST(count(*) AS BIGINT) cells,{rr('min(u)', 'least')},{rr('max(u)', 'most')} FROM r GROUP BY t")
def _(s, d):
    at, g = folder(s), grid(s, d)
    store.create(s, at, INFO)
    store.append(g, INFO, at, CHANNELS)
    store.append(g.where("t = 1").withColumns({"t": F.lit(2), "u": F.col("u") * 2.0}), INFO, at, CHANNELS)
    store.append(g.withColumn("u", F.lit(-1.0)), INFO, at, CHANNELS, again="refuse")
    store.append(g.where("t = 0").withColumn("u", F.col("u") + 1.0), INFO, at, CHANNELS, again="replace")
    cells, info = VOL.read_volume(s, at)
    return rounded(cells.groupBy("t").agg(F.count("*").alias("cells"), F.min("u").alias("least"), F.max("u").alias("most")).withColumn("nt", F.lit(info.nt)), ["t", "nt", "cells"], ["least", "most"])


@query("str1_again", f"WITH {G}, {_LONG} SELECT t,channel,{_ST} FROM c GROUP BY t,channel")
def _(s, d):
    """Step 0 comes in two halves, step 1 with the second, then step 0 again, and a half of step 1."""
    at, g = folder(s), grid(s, d)
    again = g.where("t = 0 and z < 4").withColumn("seq", F.lit(0)).unionByName(g.where("t = 1 or z >= 4").withColumn("seq", F.lit(1)))
    again = again.unionByName(g.where("t = 0").withColumn("seq", F.lit(2))).unionByName(g.where("t = 1 and z < 4").withColumn("seq", F.lit(3)))
    streams.stream_ingest(_stream(s, again, 4), INFO, at, CHANNELS, f"{at}-state").awaitTermination()
    cells = VOL.read_volume(s, at)[0]
    own = rounded(stats.finish_stats(streams.ingested_stats(s, at)), ["t", "channel", "n", "orig_bytes"], _STC)
    whole = stats.stats(cells, CHANNELS, ["t"]).select("t", "channel", F.col("n").alias("whole"))
    return own.join(whole, ["t", "channel"]).where("n = whole").drop("whole")




@query("brk8_appendable", "SELECT p_partkey, CASE WHEN p_size%3=0 THEN 'nx' WHEN p_size%5=0 THEN 'hz' WHEN p_partkey%7=0 THEN 'periodic' WHEN p_size%2=0 THEN 'brick' END differs FROM part")
def _(s, d):
    size, odd = F.col("p_size"), lambda n, a, b: F.when(F.col("p_size") % n == 0, a).otherwise(b)
    infos = table(s, d, "part").select("p_partkey", odd(3, 9, INFO.nx).alias("nx"), F.lit(INFO.ny).alias("ny"), F.lit(INFO.nz).alias("nz"), F.lit(INFO.hx).alias("hx"), F.lit(INFO.hy).alias("hy"), odd(5, 0.5, INFO.hz).alias("hz"), F.lit(INFO.dt).alias("dt"), (F.col("p_partkey") % 7 == 0).alias("periodic"), F.when(size % 2 == 0, 8).otherwise(INFO.brick).alias("brick"), F.lit(INFO.overlap).alias("overlap"))
    return B.appendable(infos, INFO).select("p_partkey", "differs")


@query("prj13_affine", f"WITH {WP} SELECT pid,{rr('0.5*x-2.0*y+0.25*z+3.0', 'x')},{rr('x+y+z-1.0', 'y')},{rr('-0.125*z+0.5', 'z')},{rr('0.5*x-2.0*y+0.25*z', 'dx')},{rr('x+y+z', 'dy')},{rr('-0.125*z', 'dz')} FROM wp")
def _(s, d):
    m = [[0.5, -2.0, 0.25, 3.0], [1.0, 1.0, 1.0, -1.0], [0.0, 0.0, -0.125, 0.5]]
    v = tuple(F.col(a) for a in "xyz")
    rows = world_points(s, d).select("pid", *[c.alias(a) for a, c in zip("xyz", T.transform_pos(v, m), strict=True)], *[c.alias(f"d{a}") for a, c in zip("xyz", T.transform_dir(v, m), strict=True)])
    return rounded(rows, ["pid"], ["x", "y", "z", "dx", "dy", "dz"])


_CLAMPED = "h AS (SELECT b.t,b.bx,b.\"by\",b.bz,g.u,g.temp FROM (SELECT DISTINCT t,bx,\"by\",bz FROM (SELECT t," + _BR + " FROM g)) b, (VALUES (-1),(0),(1),(2)) i(i),(VALUES (-1),(0),(1),(2)) j(j),(VALUES (-1),(0),(1),(2)) k(k), g WHERE g.t=b.t AND g.x=least(7,greatest(0,2*b.bx+i)) AND g.y=least(7,greatest(0,2*b.\"by\"+j)) AND g.z=least(7,greatest(0,2*b.bz+k)))"


@query("sta1_with_ghosts", f"WITH {G}, {_CLAMPED}, c AS (SELECT t,bx,\"by\",bz,'u' channel,u v FROM h UNION ALL SELECT t,bx,\"by\",bz,'temp',temp FROM h) SELECT t,bx,\"by\",bz,channel,{_ST} FROM c GROUP BY 1,2,3,4,5")
def _(s, d):
    return rounded(stats.brick_stats(grid(s, d), INFO, ["u", "temp"], include_halo=True), ["t", "bx", "by", "bz", "channel", "n", "orig_bytes"], _STC)


@query("src12_trace_stats", f"WITH {G}, k AS (SELECT 'first' run,* FROM g WHERE t=0 UNION ALL SELECT 'second',* FROM g WHERE t=1) SELECT run,t,count(*) n,{rr('max(u)', 'most')} FROM k GROUP BY 1,2")
def _(s, d):
    """Statistics of two runs, added up in one folder of text files."""
    at = folder(s)
    rows = rounded(grid(s, d).groupBy("t").agg(F.count("*").alias("n"), F.max("u").alias("most")), ["t", "n"], ["most"])
    for run, t in (("first", 0), ("second", 1)):
        VOL.write_trace_stats(rows.where(F.col("t") == t), at, run=run)
    return VOL.read_stats(s, at, "run string, t int, n bigint, most double")


# ---------------------------------------------------------------- raw files


_FLOATS = ",".join(f"{rr(f'CAST({c} AS FLOAT)::DOUBLE', o)}" for c, o in (("u", "velocity0"), ("v", "velocity1"), ("w", "velocity2"), ("temp", "temp")))
_DIMS, _FILES = (8, 8, 8), ["velocity:3", "temp"]


def _raw(s, d) -> str:
    mask = f"{folder(s)}/%s-%04d.raw"
    RAW.write_raw(grid(s, d).withColumnsRenamed({"u": "velocity0", "v": "velocity1", "w": "velocity2"}), mask, _DIMS, _FILES)
    return mask


def _as_double(df: DataFrame) -> DataFrame:
    names = ["velocity0", "velocity1", "velocity2", "temp"]
    return rounded(df.withColumns({c: F.col(c).cast("double") for c in names}), ["t", "x", "y", "z"], names)


@query("src1_raw_files", f"WITH {G} SELECT t,x,y,z,{_FLOATS} FROM g")
def _(s, d):
    return _as_double(VOL.read_raw(s, _raw(s, d), _DIMS, _FILES, 0, 1, slab_bytes=2048))


@query("src1_raw_slabs", f"WITH {G} SELECT t,x,y,z,{_FLOATS} FROM g WHERE t=1 AND z BETWEEN 2 AND 4 AND x<5")
def _(s, d):
    return _as_double(VOL.read_raw(s, _raw(s, d), _DIMS, _FILES, 0, 1, slab_bytes=2048).where("t = 1 and z >= 2 and z <= 4 and x < 5"))


@query("src1_raw_stream", f"WITH {G}, gf AS (SELECT t,x,y,z,{','.join(f'CAST({c} AS FLOAT)::DOUBLE {c}' for c in CHANNELS)} FROM g), {_LONG.replace('FROM g', 'FROM gf')} SELECT t,channel,{_ST} FROM c GROUP BY t,channel")
def _(s, d):
    """Raw steps as a stream, ingested into a brick store."""
    mask, at = _raw(s, d), folder(s)
    source = RAW.register(s).readStream.format("raw_volume").options(dims="8,8,8", channels=",".join(_FILES)).load(mask)
    named = source.withColumnsRenamed({"velocity0": "u", "velocity1": "v", "velocity2": "w"})
    streams.stream_ingest(named, INFO, at, CHANNELS, f"{at}-state").awaitTermination()
    return rounded(stats.finish_stats(streams.ingested_stats(s, at)), ["t", "channel", "n", "orig_bytes"], _STC)


@query("src10_points", f"WITH {WP} SELECT pid,CAST(x AS FLOAT)::DOUBLE x,CAST(y AS FLOAT)::DOUBLE y,CAST(z AS FLOAT)::DOUBLE z FROM wp")
def _(s, d):
    at = f"{folder(s)}/points.raw"
    VOL.write_points(world_points(s, d), at)
    return VOL.read_points(s, at)


# ---------------------------------------------------------------- long series, rays, pyramids, boxes

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_ALL = "a AS (SELECT *, CAST(floor(l_quantity/10) AS BIGINT)%3 s FROM lineitem)"


def _series(s, d) -> DataFrame:
    """All of lineitem as one series of symbols."""
    return table(s, d, "lineitem").select(*_LINE, (Q.quantized(F.col("l_quantity"), 10.0, "deadzone") % 3).alias("s"))


@query("agg5_one_key", f"WITH {_ALL} SELECT l_orderkey,l_linenumber,l_partkey,CAST(sum(s) OVER (ORDER BY {','.join(_LINE)} ROWS UNBOUNDED PRECEDING) AS BIGINT) prefix FROM a")
def _(s, d):
    return stats.prefix_sum(_series(s, d), [], _LINE, "s", blocks=16).select("l_orderkey", "l_linenumber", "l_partkey", "prefix")


@query("agg5_few_keys", f"WITH {_ALL} SELECT l_returnflag,l_orderkey,l_linenumber,l_partkey,CAST(coalesce(sum(s) OVER (PARTITION BY l_returnflag ORDER BY {','.join(_LINE)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) prefix FROM a")
def _(s, d):
    rows = table(s, d, "lineitem").select("l_returnflag", *_LINE, (Q.quantized(F.col("l_quantity"), 10.0, "deadzone") % 3).alias("s"))
    return stats.prefix_sum(rows, ["l_returnflag"], _LINE, "s", exclusive=True, blocks=16).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "prefix")


_ONE_RUN = f"{_ALL}, k AS (SELECT *, sum(CASE WHEN s<>0 THEN 1 ELSE 0 END) OVER (ORDER BY {','.join(_LINE)} ROWS UNBOUNDED PRECEDING)-CASE WHEN s<>0 THEN 1 ELSE 0 END run FROM a), zr AS (SELECT CAST(run AS BIGINT) run, CAST(sum(CASE WHEN s=0 THEN 1 ELSE 0 END) AS BIGINT) zeros, max(CASE WHEN s<>0 THEN s END) s FROM k GROUP BY 1)"


@query("win7_one_key", f"WITH {_ONE_RUN} SELECT * FROM zr")
def _(s, d):
    return Q.zero_runs(_series(s, d), "s", [], _LINE, blocks=16).select("run", "zeros", "s")


@query("qnt7_one_key", f"WITH {_ONE_RUN} SELECT zeros,count(*) runs FROM zr GROUP BY 1")
def _(s, d):
    return Q.zero_run_stats(_series(s, d), "s", [], _LINE, blocks=16)


@query("qnt8_all", f"WITH {_ALL}, h AS (SELECT s,count(*) c FROM a GROUP BY 1), q AS (SELECT *,sum(c) OVER () n FROM h) SELECT CAST(sum(c) AS BIGINT) n,{rr('sum(-c*log2(c/n))/8', 'bytes')} FROM q")
def _(s, d):
    return rounded(Q.coded_size(_series(s, d), "s", []), ["n"], ["bytes"])


def _shaded(s, d) -> DataFrame:
    return ISO.emission_absorption(ISO.transfer(grid(s, d), "u", 20.0, 30.7, _C0, _C4), 0.5)


for _name, _clip in (("iso9_by_bricks", None), ("iso10_by_bricks", (2, 5))):
    query(_name, ORACLES["iso10_clipped" if _clip else "iso9_composite"])(lambda s, d, clip=_clip: rounded(ISO.composite_bricks(_shaded(s, d), "z", INFO.core, clip), ["t", "x", "y"], list("rgba")))


@query("win5_by_bricks", ORACLES["win5_transmittance"])
def _(s, d):
    return rounded(ISO.with_transmittance(grid(s, d), F.col("v") / 20.0, "z", INFO.core), ["t", "x", "y", "z"], ["pass"])


@query("flt3_four_radii", f"WITH {G}, " + ", ".join(_B3(r, f"r{r}") for r in (1, 2, 4, 8)) + " " + " UNION ALL ".join(f"SELECT {k} \"level\",t,x,y,z,{rr('u', 'u')} FROM {src}" for k, src in enumerate(["g", "f3r1", "f3r2", "f3r4", "f3r8"])))
def _(s, d):
    return rounded(smoothing.filter_pyramid(grid(s, d), ["u"], [1, 2, 4, 8]), ["level", "t", "x", "y", "z"], ["u"])


#: A box for each order: of all sizes from a hundredth to a fifth of the volume.
_BOXES = "bx AS (SELECT o_orderkey box, (o_orderkey*37%1600)/100.0-8 lo_x, (o_custkey*53%1600)/100.0-8 lo_y, (o_orderkey*11%1600)/100.0-8 lo_z, 0.16*(1+o_orderkey%20) sx, 0.08*(1+o_custkey%20) sy, 0.32*(1+o_orderkey%7) sz FROM orders)"


@query("jon6_order_boxes", f"WITH {WP}, {_BOXES} SELECT box,count(*) n,CAST(sum(pid) AS BIGINT) pids FROM wp JOIN bx ON x>=lo_x AND x<lo_x+sx AND y>=lo_y AND y<lo_y+sy AND z>=lo_z AND z<lo_z+sz GROUP BY 1")
def _(s, d):
    o, k, c = table(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    low = o.select(k.alias("box"), ((k * 37 % 1600) / 100.0 - 8).alias("lo_x"), ((c * 53 % 1600) / 100.0 - 8).alias("lo_y"), ((k * 11 % 1600) / 100.0 - 8).alias("lo_z"), (0.16 * (1 + k % 20)).alias("sx"), (0.08 * (1 + c % 20)).alias("sy"), (0.32 * (1 + k % 7)).alias("sz"))
    boxes = low.withColumns({f"hi_{a}": F.col(f"lo_{a}") + F.col(f"s{a}") for a in "xyz"}).drop("sx", "sy", "sz")
    return ranges.sums_in_boxes(world_points(s, d), boxes, "box", ["pid"]).withColumnRenamed("pid", "pids")


# ---------------------------------------------------------------- particles

_RATE, _SLOTS, _DT = 2.0, 6, 0.0002
_TICKS = "date_trunc('hour', ts)"
#: Ticks by hour, the clock's emissions, and the steps of the particles of the last emissions.
_CLOCK = f"""tk AS MATERIALIZED (SELECT row_number() OVER (ORDER BY hour)-1 k, n/1000.0 dt FROM (SELECT {_TICKS} AS hour, count(*)*(1+count(*)%7) n FROM events GROUP BY 1)),
em AS (SELECT CAST(-1 AS BIGINT) k, CAST(0.0 AS DOUBLE) now, CAST(-1e9 AS DOUBLE) last, CAST(0 AS BIGINT) n UNION ALL SELECT tk.k, now+dt, CASE WHEN now+dt-last>1.0/{_RATE} THEN now+dt ELSE last END, n+CASE WHEN now+dt-last>1.0/{_RATE} THEN 1 ELSE 0 END FROM em JOIN tk ON tk.k=em.k+1),
born AS (SELECT n-1 emission, min(k) k FROM em WHERE n>0 GROUP BY n), lately AS (SELECT * FROM born WHERE emission>(SELECT max(emission) FROM born)-{_SLOTS}),
hs AS MATERIALIZED (SELECT list({_DT}*100*least(dt,0.1) ORDER BY k) hs FROM tk)"""
_EMITTED = "seed AS (SELECT CAST(emission*1000000000000+line AS BIGINT) id, emission, k+1 k, " + ",".join(f"4*{_U('(emission*(SELECT count(*) FROM customer)+line)', 1, n)}+2 g{a}" for n, a in enumerate("xyz")) + " FROM lately, (SELECT row_number() OVER ()-1 line FROM customer))"


def _moved_sql() -> str:
    one = velocity("SELECT pt.*, fld.*, hs FROM pt, fld, hs WHERE alive AND k<len(hs)", {a: f"g{a}" for a in "xyz"}, 0, "linear")
    heun = velocity(one, {a: f"g{a}+hs[k+1]*k0{f}" for a, f in zip("xyz", "uvw", strict=True)}, 1, "linear")
    new = ",".join(f"CASE WHEN slow THEN g{a} ELSE g{a}+hs[k+1]/2*(k0{f}+k1{f}) END g{a}" for a, f in zip("xyz", "uvw", strict=True))
    step = f"SELECT id,emission,k+1 k,age+hs[k+1] age,{new},slow FROM (SELECT *, 4*(k0u*k0u+k0v*k0v+k0w*k0w)<2500.0 slow FROM ({heun}))"
    out = " OR ".join(f"abs(2*g{a}-8)>8" for a in "xyz")
    return f"pt AS (SELECT id,emission,k,CAST(0.0 AS DOUBLE) age,gx,gy,gz,true alive FROM seed UNION ALL SELECT id,emission,k,age,gx,gy,gz,NOT (slow OR {out}) FROM ({step}))"


@query("str2_particle_system", f"WITH RECURSIVE {FIELD}, {_CLOCK}, {_EMITTED}, {_moved_sql()} SELECT id line_id,CAST(emission AS BIGINT) emission,CAST(emission%{_SLOTS} AS INT) slot,{rr('2*gx-8', 'x')},{rr('2*gy-8', 'y')},{rr('2*gz-8', 'z')},{rr('age', 'age')} FROM pt, hs WHERE alive AND k=len(hs)")
def _(s, d):
    """Particles from as many lines as there are customers, over eight bricks, by a clock of an hour's events a tick."""
    at = folder(s)
    n = table(s, d, "customer").count()
    hours = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("n"))
    ticks = hours.select("ts", F.unix_timestamp("ts").alias("tick"), (F.col("n") * (1 + F.col("n") % 7) / 1000.0).alias("dt"))
    p = TraceParams(scheme="heun", kernel="linear", dt=_DT, min_velocity=50.0)
    box = ((-4.0, -4.0, -4.0), (8.0, 8.0, 8.0))
    q = PS.stream_particle_system(_stream(s, ticks, 3), grid(s, d).where("t = 0"), TRACE, lambda first, k: seeds.emissions(s, n, box, first, k, True), at, f"{at}-state", p, _RATE, _SLOTS)
    q.awaitTermination()
    return rounded(PS.particles(s, at), ["line_id", "emission", "slot"], ["x", "y", "z", "age"])
