"""All registered queries of the grid operators, and their SQL for another engine."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.functions import info as I
from fieldspark.functions import tensor as T
from fieldspark.functions.kernels import KERNELS
from fieldspark.operators import bricks as B
from fieldspark.operators import iso as ISO
from fieldspark.operators import lines as L
from fieldspark.operators import measures as M
from fieldspark.operators import quantize as Q
from fieldspark.operators import sampling, seeds, select as S, smoothing, stats, stencil
from fieldspark.plans.fixtures import CHANNELS, INFO, grid, grid_info, grid_points, lattice, points, r6, regions, table, vertices, visits, world_points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------- SQL parts


def rr(x: str, name: str | None = None) -> str:
    return f"floor(({x})*1e6+0.5001)/1e6+0.0" + (f" AS {name}" if name else "")


G = """raw AS (SELECT CAST(l_linenumber % 2 AS INT) t, CAST(l_orderkey % 8 AS INT) x, CAST(l_partkey % 8 AS INT) y, CAST(l_suppkey % 8 AS INT) z,
 SUM(l_quantity) su, SUM(FLOOR(l_discount*100+0.5)) sv, SUM(FLOOR(l_tax*100+0.5)) sw, SUM(CAST(l_linenumber AS DOUBLE)) st, COUNT(*) n FROM lineitem GROUP BY 1,2,3,4),
g AS (SELECT c.t, c.x, c.y, c.z, coalesce(su/n,0.0) u, coalesce(sv/n,0.0) v, coalesce(sw/n,0.0) w, coalesce(st/n,0.0) temp
 FROM (SELECT CAST(i//512 AS INT) t, CAST(i%8 AS INT) x, CAST((i//8)%8 AS INT) y, CAST((i//64)%8 AS INT) z FROM range(1024) r(i)) c LEFT JOIN raw USING (t,x,y,z))"""
WINDOWS = "WINDOW wx AS (PARTITION BY t,y,z ORDER BY x), wy AS (PARTITION BY t,x,z ORDER BY y), wz AS (PARTITION BY t,x,y ORDER BY z)"
_d = lambda f, a, k=2.0: f"(coalesce(lead({f}) OVER w{a}, {f}) - coalesce(lag({f}) OVER w{a}, {f}))/{k}"
J = f"{G}, j AS (SELECT *, " + ", ".join(f"{_d(f, a)} AS j{r}{c}" for r, f in enumerate("uvw") for c, a in enumerate("xyz")) + ", " + ", ".join(f"{_d('temp', a)} AS gt{a}" for a in "xyz") + f" FROM g {WINDOWS})"
P = """p AS (SELECT event_id pid, (event_id % 701)/100.0 px, (user_id*7 % 701)/100.0 py, (event_id*3 % 701)/100.0 pz, CAST(event_id % 2 AS INT) t, (event_id % 8)/8.0 "time" FROM events)"""
WP = f"""{P}, wp AS (SELECT pid, px*2.0-8.0 x, py*2.0-8.0 y, pz*2.0-8.0 z, t, "time" FROM p)"""
V = f"""{WP}, s AS (SELECT event_id, user_id line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) seq FROM events),
vx AS (SELECT line_id, seq, x, y, z, seq/4.0 "time", t FROM s JOIN wp ON event_id = pid)"""
REG = "reg AS (SELECT CAST(i%16 AS INT) tx, CAST(i//16 AS INT) ty, CAST(1+((i%16)//4+4*((i//16)//4))%5 AS BIGINT) region FROM range(256) r(i))"
LAT = "lat AS (SELECT CAST(i%4 AS INT) bx, CAST((i//4)%4 AS INT) by_, CAST(i//16 AS INT) bz FROM range(64) r(i))"
VIS = "vis AS (SELECT user_id pid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) seq, CAST(event_id*7%5+1 AS BIGINT) region, (event_id%4+1)/4.0 dt FROM events)"
CH = ("u", "v", "w", "temp")
XYZ = ("t", "x", "y", "z")


def rounded(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


def bricked(s: SparkSession, d: str) -> DataFrame:
    return B.assign_bricks(grid(s, d), INFO)


# ---------------------------------------------------------------- flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bricks hold strong vortices (Q above a value), and their statistics?"""
    volume = M.with_measure(M.prepare(grid(spark, sf_dir), ["q_hunt"]), "q_hunt")
    meta = B.brick_meta(volume, INFO, ["q_hunt"])
    strong = S.prune_iso(meta, "q_hunt", 1.0)
    cells = S.in_bricks(B.assign_bricks(volume, INFO), strong)
    out = stats.stats(cells, ["q_hunt", "u", "temp"], ["t", "bx", "by", "bz"])
    return out.select("t", "bx", "by", "bz", "channel", "n", *[r6(c).alias(c) for c in ("vmin", "vmax", "avg", "var")])


_QH = "0.5*((j01-j10)*(j01-j10)/2+(j02-j20)*(j02-j20)/2+(j12-j21)*(j12-j21)/2 - (j00*j00+j11*j11+j22*j22+(j01+j10)*(j01+j10)/2+(j02+j20)*(j02+j20)/2+(j12+j21)*(j12+j21)/2))"
_BR = 'CAST(floor(x/2) AS INT) bx, CAST(floor(y/2) AS INT) "by", CAST(floor(z/2) AS INT) bz'
query(
    "flagship_strong_vortices",
    f"""WITH {J}, q AS (SELECT t, {_BR}, {_QH} q_hunt, u, temp FROM j), m AS (SELECT t,bx,"by",bz FROM q GROUP BY ALL HAVING min(q_hunt)<=1.0 AND max(q_hunt)>=1.0),
c AS (SELECT t,bx,"by",bz,'q_hunt' channel,q_hunt v FROM q UNION ALL SELECT t,bx,"by",bz,'u',u FROM q UNION ALL SELECT t,bx,"by",bz,'temp',temp FROM q)
SELECT t,bx,"by",bz,channel,count(*) n,{rr('min(v)', 'vmin')},{rr('max(v)', 'vmax')},{rr('avg(v)', 'avg')},{rr('var_pop(v)', 'var')} FROM c JOIN m USING (t,bx,"by",bz) GROUP BY t,bx,"by",bz,channel""",
)(flagship)

# ---------------------------------------------------------------- projections


@query("src3_timesteps", "SELECT CAST(l_linenumber AS INT) t, l_orderkey, CAST((l_linenumber-1)//2+10 AS INT) t_out FROM lineitem WHERE l_linenumber BETWEEN 1 AND 6 AND (l_linenumber-1)%2=0")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_linenumber").alias("t"), "l_orderkey")
    return I.select_timesteps(li, 1, 6, 2, 10).select("t", "l_orderkey", "t_out")


@query("prj1_brick_linear", f'WITH {G} SELECT t,x,y,z, CAST(floor(x/2)+4*(floor(y/2)+4*floor(z/2)) AS INT) lin FROM g')
def _(s, d):
    return bricked(s, d).select(*XYZ, I.brick_linear(INFO).alias("lin"))


@query("prj2_brick_spatial", f'WITH {G}, l AS (SELECT t,x,y,z, CAST(floor(x/2)+4*(floor(y/2)+4*floor(z/2)) AS INT) lin FROM g) SELECT t,x,y,z, CAST(lin%4 AS INT) bx, CAST((lin//4)%4 AS INT) "by", CAST(lin//16 AS INT) bz FROM l')
def _(s, d):
    return bricked(s, d).withColumn("lin", I.brick_linear(INFO)).select(*XYZ, *I.brick_spatial(INFO))


@query("prj5_brick_box", f'WITH {G} SELECT DISTINCT {_BR}, -8.0+4.0*floor(x/2) lo_x, -8.0+4.0*floor(y/2) lo_y, -8.0+4.0*floor(z/2) lo_z, least(-4.0+4.0*floor(x/2),8.0) hi_x, least(-4.0+4.0*floor(y/2),8.0) hi_y, least(-4.0+4.0*floor(z/2),8.0) hi_z FROM g')
def _(s, d):
    return I.with_brick_box(bricked(s, d).select("bx", "by", "bz").distinct(), INFO)


@query("prj6_brick_of", f'WITH {WP} SELECT pid, CAST(floor((x+8)/4) AS INT) bx, CAST(floor((y+8)/4) AS INT) "by", CAST(floor((z+8)/4) AS INT) bz FROM wp')
def _(s, d):
    return I.with_brick_of(world_points(s, d), INFO).select("pid", "bx", "by", "bz")


@query("prj7_inside_domain", f"WITH {WP} SELECT pid FROM wp WHERE x*1.5 BETWEEN -8 AND 8 AND y*1.5 BETWEEN -8 AND 8 AND z*1.5 BETWEEN -8 AND 8")
def _(s, d):
    return I.inside_domain(world_points(s, d).select("pid", *[(F.col(a) * 1.5).alias(a) for a in "xyz"]), INFO).select("pid")


@query("prj8_world_to_grid", f"WITH {WP} SELECT pid, {rr('(x+8)/2', 'gx')}, {rr('(y+8)/2', 'gy')}, {rr('(z+8)/2', 'gz')}, {rr('2.0*(x+8)/2', 'sx')} FROM wp")
def _(s, d):
    out = I.world_to_grid(world_points(s, d), INFO)
    return rounded(out.withColumn("sx", F.col("gx") * I.velocity_scale(INFO)[0]), ["pid"], ["gx", "gy", "gz", "sx"])


@query("prj9_timestep", f'WITH {P} SELECT pid, CAST(floor("time"/0.25) AS INT) a, CAST(floor("time"/0.25)+1 AS INT) b, CAST(floor("time"/0.25+0.5) AS INT) c FROM p')
def _(s, d):
    i = I.VolumeInfo(8, 8, 8, 4, dt=0.25)
    out = points(s, d)
    for how, name in (("floor", "a"), ("ceil", "b"), ("nearest", "c")):
        out = I.with_timestep(out, i, how).withColumnRenamed("step", name)
    return out.select("pid", "a", "b", "c")


# ---------------------------------------------------------------- selection


@query("sel1_clip_box", f"WITH {WP} SELECT pid FROM wp WHERE x BETWEEN -4 AND 2 AND y BETWEEN -6 AND 5 AND z BETWEEN 0 AND 4")
def _(s, d):
    return S.clip_box(world_points(s, d), (-4, -6, 0), (2, 5, 4)).select("pid")


@query("sel2_clip_planes", f"""WITH {G}, b AS (SELECT DISTINCT {_BR} FROM g), k AS (SELECT *, -8.0+4*bx lx, -4.0+4*bx hx, -8.0+4*"by" ly, -4.0+4*"by" hy, -8.0+4*bz lz, -4.0+4*bz hz FROM b)
SELECT bx,"by",bz FROM k WHERE greatest(lx,hx)+greatest(0.5*ly,0.5*hy)-1.0>0 AND greatest(-lz,-hz)+2.0>0""")
def _(s, d):
    boxes = I.with_brick_box(bricked(s, d).select("bx", "by", "bz").distinct(), INFO)
    return S.clip_planes(boxes, [(1.0, 0.5, 0.0, -1.0), (0.0, 0.0, -1.0, 2.0)]).select("bx", "by", "bz")


@query("sel3_prune_iso", f"""WITH {J}, q AS (SELECT t,{_BR},{_QH} q FROM j) SELECT t,bx,"by",bz,'q_hunt' measure,{rr('min(q)', 'vmin')},{rr('max(q)', 'vmax')} FROM q GROUP BY ALL HAVING least(-0.5*min(q),-0.5*max(q))<=3 AND greatest(-0.5*min(q),-0.5*max(q))>=3""".replace("GROUP BY ALL", 'GROUP BY t,bx,"by",bz'))
def _(s, d):
    volume = M.with_measure(M.prepare(grid(s, d), ["q_hunt"]), "q_hunt")
    return rounded(S.prune_iso(B.brick_meta(volume, INFO, ["q_hunt"]), "q_hunt", 3.0, -0.5), ["t", "bx", "by", "bz", "measure"], ["vmin", "vmax"])


@query("sel4_slice", f"WITH {G} SELECT t,x,y,z,u, 'mid' side FROM g WHERE z=3 UNION ALL SELECT t,x,y,z,u, CASE WHEN z<4 THEN 'below' ELSE 'above' END FROM g")
def _(s, d):
    g = grid(s, d)
    mid = S.slice_at(g, "z", 3).withColumn("side", F.lit("mid"))
    return mid.unionByName(S.split_by_plane(g, "z", 4)).select(*XYZ, "u", "side")


@query("sel5_drop_slow", f"WITH {G} SELECT t,x,y,z FROM g WHERE u*u+v*v+w*w>=26.0*26.0")
def _(s, d):
    return S.drop_slow(grid(s, d), 26.0).select(*XYZ)


_TX = "CAST(least(15,greatest(0,floor((x+8)/16*16))) AS INT)", "CAST(least(15,greatest(0,floor((1-(y+8)/16)*16))) AS INT)"


@query("sel6_filter_region", f"WITH {WP}, {REG} SELECT pid, region FROM (SELECT *, {_TX[0]} tx, {_TX[1]} ty FROM wp) JOIN reg USING (tx,ty) WHERE region IN (2,5)")
def _(s, d):
    return S.filter_region(world_points(s, d), regions(s), [2, 5], INFO, 16, 16).select("pid", "region")


@query("sel7_mask", f"WITH {G} SELECT t,x,y,z, CASE WHEN temp>=3.5 THEN u ELSE 0.0 END u, CASE WHEN temp>=3.5 THEN v ELSE 0.0 END v FROM g")
def _(s, d):
    return S.mask_by_measure(grid(s, d), "temp", 3.5, ["u", "v"]).select(*XYZ, "u", "v")


# ---------------------------------------------------------------- bricks


@query("brk1_assign", f"WITH {G} SELECT t,x,y,z,{_BR} FROM g")
def _(s, d):
    return bricked(s, d).select(*XYZ, "bx", "by", "bz")


@query("brk2_sizes", f'WITH {G}, b AS (SELECT DISTINCT {_BR} FROM g) SELECT bx,"by",bz, CAST(least(4,7-2*bx+2) AS INT) nx, CAST(least(4,8-2*"by"+2) AS INT) ny, CAST(least(4,8-2*bz+2) AS INT) nz FROM b')
def _(s, d):
    cut_info = I.VolumeInfo(7, 8, 8, 2)
    return B.brick_sizes(bricked(s, d).select("bx", "by", "bz").distinct(), cut_info)


_GH = lambda place: f"""WITH {G}, o AS (SELECT CAST(i AS INT) o FROM range(-1,3) r(i)), k AS (SELECT CAST(i AS INT) b FROM range(4) r(i)),
tgt AS (SELECT bx.b bx, b2.b "by", b3.b bz, 2*bx.b+ox.o gx, 2*b2.b+oy.o gy, 2*b3.b+oz.o gz FROM k bx, k b2, k b3, o ox, o oy, o oz)
SELECT t,bx,"by",bz,gx,gy,gz,u,(gx<2*bx OR gx>=2*bx+2 OR gy<2*"by" OR gy>=2*"by"+2 OR gz<2*bz OR gz>=2*bz+2) is_halo FROM tgt JOIN g ON {place}"""  # noqa: E731


@query("brk3_halo_clamp", _GH("x=least(7,greatest(0,gx)) AND y=least(7,greatest(0,gy)) AND z=least(7,greatest(0,gz))"))
def _(s, d):
    return B.with_halo(grid(s, d), INFO, "clamp").select("t", "bx", "by", "bz", "gx", "gy", "gz", "u", "is_halo")


@query("brk4_halo_periodic", _GH("x=(gx+8)%8 AND y=(gy+8)%8 AND z=(gz+8)%8"))
def _(s, d):
    return B.with_halo(grid(s, d), INFO, "periodic").select("t", "bx", "by", "bz", "gx", "gy", "gz", "u", "is_halo")


@query("brk5_pack_unpack", f"WITH {G} SELECT t,{_BR},x gx,y gy,z gz,u,temp FROM g")
def _(s, d):
    rows = bricked(s, d).withColumnsRenamed({"x": "gx", "y": "gy", "z": "gz"})
    return B.unpack_bricks(B.pack_bricks(rows, ["u", "temp"]), ["u", "temp"])


@query("brk6_meta", f"""WITH {G}, c AS (SELECT t,{_BR},'velocity' measure, sqrt(u*u+v*v+w*w) v FROM g UNION ALL SELECT t,{_BR},'temperature',temp FROM g) SELECT t,bx,"by",bz,measure,{rr('min(v)', 'vmin')},{rr('max(v)', 'vmax')} FROM c GROUP BY t,bx,"by",bz,measure""")
def _(s, d):
    g = M.with_measure(M.with_measure(grid(s, d), "velocity"), "temperature")
    return rounded(B.brick_meta(g, INFO, ["velocity", "temperature"]), ["t", "bx", "by", "bz", "measure"], ["vmin", "vmax"])


_NB = f"""WITH {G}, b AS (SELECT DISTINCT {_BR} FROM g), dd AS (SELECT * FROM (VALUES (0,-1,0,0),(1,0,-1,0),(2,0,0,-1),(3,1,0,0),(4,0,1,0),(5,0,0,1)) q(dir,dx,dy,dz))"""


@query("brk7_neighbors", f'{_NB} SELECT bx,"by",bz,dir,bx+dx nbx,"by"+dy nby,bz+dz nbz FROM b,dd WHERE bx+dx BETWEEN 0 AND 3 AND "by"+dy BETWEEN 0 AND 3 AND bz+dz BETWEEN 0 AND 3')
def _(s, d):
    return B.brick_neighbors(bricked(s, d).select("bx", "by", "bz").distinct(), INFO)


@query("brk9_distance", f"""WITH {G}, b AS (SELECT DISTINCT {_BR} FROM g) SELECT bx,"by",bz,{rr('sqrt(pow(-6.0+4*bx-1,2)+pow(-6.0+4*"by"-2,2)+pow(-6.0+4*bz+3,2))', 'distance')} FROM b""")
def _(s, d):
    return rounded(B.order_by_distance(bricked(s, d).select("bx", "by", "bz").distinct(), INFO, (1.0, 2.0, -3.0)), ["bx", "by", "bz"], ["distance"])


# ---------------------------------------------------------------- joins

_PB = f'{WP}, pb AS (SELECT *, CAST(floor((x+8)/4) AS INT) bx, CAST(floor((y+8)/4) AS INT) "by", CAST(floor((z+8)/4) AS INT) bz FROM wp)'
_MB = f'mb AS (SELECT t,{_BR}, max(u) vmax FROM g GROUP BY ALL)'.replace("GROUP BY ALL", "GROUP BY 1,2,3,4")


def _brick_max(s, d):
    return bricked(s, d).groupBy("t", "bx", "by", "bz").agg(F.max("u").alias("vmax"))


@query("jon1_bricks", f'WITH {G}, {_PB}, {_MB} SELECT pid, {rr("vmax", "vmax")} FROM pb JOIN mb USING (t,bx,"by",bz)')
def _(s, d):
    return rounded(S.join_bricks(I.with_brick_of(world_points(s, d), INFO), _brick_max(s, d), INFO), ["pid"], ["vmax"])


@query("jon2_bricks_time", f'WITH {G}, {_PB}, {_MB} SELECT pid, mb.t, {rr("vmax", "vmax")} FROM pb JOIN mb ON pb.bx=mb.bx AND pb."by"=mb."by" AND pb.bz=mb.bz AND mb.t IN (floor(pb."time"), floor(pb."time")+1)')
def _(s, d):
    return rounded(S.join_bricks(I.with_brick_of(world_points(s, d).drop("t"), INFO), _brick_max(s, d), INFO, "floor_ceil"), ["pid", "t"], ["vmax"])


@query("jon3_neighbours", f"WITH {G}, o(ox,oy,oz) AS (VALUES (1,0,0),(0,-1,1),(2,2,2)) SELECT a.t,a.x,a.y,a.z,ox,oy,oz,b.u nb_u FROM g a, o, g b WHERE b.t=a.t AND b.x=a.x+ox AND b.y=a.y+oy AND b.z=a.z+oz")
def _(s, d):
    return stencil.neighbours(grid(s, d), [(1, 0, 0), (0, -1, 1), (2, 2, 2)], ["u"])


@query("jon4_lookup", f"WITH {WP}, {REG} SELECT pid, region FROM (SELECT *, {_TX[0]} tx, {_TX[1]} ty FROM wp) LEFT JOIN reg USING (tx,ty)")
def _(s, d):
    tx, ty = S.region_place(INFO, 16, 16)
    return S.lookup(world_points(s, d).withColumns({"tx": tx, "ty": ty}), regions(s), ["tx", "ty"]).select("pid", "region")


for _name, _keep, _op in (("jon5_semi", True, ">="), ("jon5_anti", False, "<")):
    query(_name, f'WITH {G}, {_MB} SELECT t,x,y,z FROM (SELECT t,x,y,z,{_BR} FROM g) JOIN mb USING (t,bx,"by",bz) WHERE vmax{_op}30')(lambda s, d, keep=_keep: S.in_bricks(bricked(s, d), _brick_max(s, d).where("vmax >= 30"), keep).select(*XYZ))


@query("jon6_boxes", f'WITH {_PB} SELECT pid,bx,"by",bz FROM pb')
def _(s, d):
    return S.points_in_boxes(world_points(s, d), I.with_brick_box(lattice(s), INFO)).select("pid", "bx", "by", "bz")


@query("jon7_cross", f'WITH {G}, b AS (SELECT DISTINCT {_BR} FROM g) SELECT bx,"by",bz,n_nationkey slot FROM b, nation')
def _(s, d):
    return S.cross_bricks(table(s, d, "nation").select(F.col("n_nationkey").alias("slot")), bricked(s, d).select("bx", "by", "bz").distinct())


@query("jon8_pair_levels", f"WITH {G} SELECT t,x,y,z,{rr('u', 'u')},{rr('sum(u) OVER (PARTITION BY t,y,z ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)/3.0', 'coarse_u')} FROM g")
def _(s, d):
    g = grid(s, d)
    return rounded(S.pair_levels(g, smoothing.box_filter_axis(g, ["u"], "x", 1), ["u"]), list(XYZ), ["u", "coarse_u"])


# ---------------------------------------------------------------- statistics

_LONG = "c AS (" + " UNION ALL ".join(f"SELECT t,{_BR},'{c}' channel,{c} v FROM g" for c in CH) + ")"
_ST = f"count(*) n, count(*)*4 orig_bytes, {rr('min(v)', 'vmin')}, {rr('max(v)', 'vmax')}, {rr('max(v)-min(v)', 'vrange')}, {rr('avg(v)', 'avg')}, {rr('var_pop(v)', 'var')}"
_STC = ["vmin", "vmax", "vrange", "avg", "var"]


@query("sta1_5_stats", f'WITH {G}, {_LONG} SELECT t,bx,"by",bz,channel,{_ST},{rr("sum(5.0)/8", "comp_bytes")},{rr("5.0", "bits_per_elem")},{rr("32/5.0", "compression_rate")} FROM c GROUP BY t,bx,"by",bz,channel')
def _(s, d):
    out = stats.stats(bricked(s, d).withColumn("bits", F.lit(5.0)), CHANNELS, ["t", "bx", "by", "bz"], "bits")
    return rounded(out, ["t", "bx", "by", "bz", "channel", "n", "orig_bytes"], [*_STC, "comp_bytes", "bits_per_elem", "compression_rate"])


_REC = f"""e AS (SELECT t, channel, v, r, abs(r-v) e, CASE WHEN abs(v)>0.01 THEN abs(r-v)/abs(v) END q FROM (SELECT t,channel,v, (CASE WHEN v<0 THEN ceil(v/0.3-0.5) ELSE floor(v/0.3+0.5) END)*0.3 r FROM c))"""


@query(
    "sta6_11_recon",
    f"""WITH {G}, {_LONG}, {_REC} SELECT t,channel,count(*) n,{rr('min(r)', 'r_vmin')},{rr('max(r)', 'r_vmax')},{rr('max(r)-min(r)', 'r_vrange')},{rr('avg(r)', 'r_avg')},{rr('var_pop(r)', 'r_var')},{rr('avg(e)', 'avg_abs')},{rr('max(e)', 'max_abs')},{rr('sqrt(avg(e*e))', 'rms')},
{rr('avg(q)', 'avg_rel')},{rr('max(q)', 'max_rel')},count(q) n_rel,{rr('20*log10(sqrt(var_pop(v))/sqrt(avg(e*e)))', 'snr')},{rr('20*log10(sqrt(max(v)-min(v))/sqrt(avg(e*e)))', 'psnr')} FROM e GROUP BY t,channel""",
)
def _(s, d):
    g = grid(s, d)
    for c in CHANNELS:
        g = Q.quantize(g, c, 0.3)
    out = stats.recon_stats(g, {c: f"{c}_r" for c in CHANNELS}, ["t"])
    return rounded(out, ["t", "channel", "n", "n_rel"], ["r_vmin", "r_vmax", "r_vrange", "r_avg", "r_var", "avg_abs", "max_abs", "rms", "avg_rel", "max_rel", "snr", "psnr"])


@query(
    "sta12_rollup",
    f"""WITH {G}, {_LONG} SELECT 'brick' "level",t,bx,"by",bz,channel,{_ST} FROM c GROUP BY t,bx,"by",bz,channel UNION ALL SELECT 'timestep',t,NULL,NULL,NULL,channel,{_ST} FROM c GROUP BY t,channel UNION ALL SELECT 'global',NULL,NULL,NULL,NULL,channel,{_ST} FROM c GROUP BY channel
UNION ALL SELECT 'brick',t,bx,"by",bz,'all',{_ST} FROM c GROUP BY t,bx,"by",bz UNION ALL SELECT 'timestep',t,NULL,NULL,NULL,'all',{_ST} FROM c GROUP BY t UNION ALL SELECT 'global',NULL,NULL,NULL,NULL,'all',{_ST} FROM c""",
)
def _(s, d):
    out = stats.stats_rollup(bricked(s, d), CHANNELS)
    return rounded(out, ["level", "t", "bx", "by", "bz", "channel", "n", "orig_bytes"], _STC)


@query("sta14_merge", f"WITH {G}, {_LONG} SELECT t,channel,{_ST} FROM c GROUP BY t,channel")
def _(s, d):
    g = grid(s, d)
    a, b = (stats.stats_state(g.where(c), CHANNELS, ["t"]) for c in ("x < 3", "x >= 3"))
    return rounded(stats.finish_stats(stats.merge_stats(a, b, ["t"])), ["t", "channel", "n", "orig_bytes"], _STC)


@query("sta13_common_step", "SELECT CASE WHEN count(DISTINCT floor(l_discount*100+0.5))=1 THEN max(floor(l_discount*100+0.5)) ELSE -1.0 END q FROM lineitem")
def _(s, d):
    return stats.common_quant_step(table(s, d, "lineitem").select(F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("q")))


@query("agg1_min_max", f'WITH {G}, {_LONG} SELECT bx,"by",bz,channel,{rr("min(v)", "vmin")},{rr("max(v)", "vmax")} FROM c GROUP BY bx,"by",bz,channel')
def _(s, d):
    return rounded(stats.measure_min_max(bricked(s, d), CHANNELS, ["bx", "by", "bz"]), ["bx", "by", "bz", "channel"], ["vmin", "vmax"])


@query("agg2_max_abs", f"WITH {J} SELECT t,{rr('max(abs(j00))', 'max_abs_j00')} FROM j GROUP BY t")
def _(s, d):
    return rounded(stats.max_abs(stencil.jacobian(grid(s, d)), "j00", ["t"]), ["t"], ["max_abs_j00"])


@query("agg3_histogram", "SELECT l_returnflag, CAST(floor(l_extendedprice/1000+0.5) AS BIGINT) s, count(*) cnt FROM lineitem GROUP BY 1,2")
def _(s, d):
    li = table(s, d, "lineitem").select("l_returnflag", Q.quantized(F.col("l_extendedprice"), 1000.0).alias("s"))
    return stats.histogram(li, "s", ["l_returnflag"])


@query("agg4_reduce", "SELECT l_linenumber, sum(l_quantity) sum_l_quantity, max(l_quantity) max_l_quantity, count(*) FILTER (l_quantity<>0) count_if_l_quantity FROM lineitem GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem")
    out = stats.reduce(li, "l_quantity", "sum", ["l_linenumber"])
    for op in ("max", "count_if"):
        out = out.join(stats.reduce(li, "l_quantity", op, ["l_linenumber"]), "l_linenumber")
    return out


_RUNS = "r AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity/10) AS BIGINT)%3 s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) i FROM lineitem)"


def _symbols(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(s, d, "lineitem").select("l_orderkey", (Q.quantized(F.col("l_quantity"), 10.0, "deadzone") % 3).alias("s"), F.row_number().over(w).cast("long").alias("i"))


@query("agg5_prefix_sum", f"WITH {_RUNS} SELECT l_orderkey,i,CAST(sum(s) OVER (PARTITION BY l_orderkey ORDER BY i) AS BIGINT) prefix FROM r")
def _(s, d):
    return stats.prefix_sum(_symbols(s, d), ["l_orderkey"], ["i"], "s").select("l_orderkey", "i", "prefix")


@query("agg6_points_per_brick", f'WITH {_PB} SELECT bx,"by",bz,count(*) n_points,min("time") first_time FROM pb GROUP BY bx,"by",bz')
def _(s, d):
    return stats.points_per_brick(I.with_brick_of(world_points(s, d), INFO))


@query("agg7_bricks_touched", f'WITH {V} SELECT line_id,count(*) visits,count(DISTINCT (floor((x+8)/4),floor((y+8)/4),floor((z+8)/4))) bricks,count(DISTINCT (floor((x+8)/4),floor((y+8)/4),floor((z+8)/4)))*1024 bytes FROM vx GROUP BY line_id')
def _(s, d):
    return stats.bricks_touched(I.with_brick_of(vertices(s, d), INFO), 1024)


# ---------------------------------------------------------------- windows, order, sets


@query("win1_shift", f"WITH {G} SELECT t,x,y,z,coalesce(lead(u) OVER wx, last_value(u) OVER (PARTITION BY t,y,z ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) u_next, (SELECT b.u FROM g b WHERE b.t=g.t AND b.x=g.x AND b.z=g.z AND b.y=(g.y+6)%8) u_wrap FROM g WINDOW wx AS (PARTITION BY t,y,z ORDER BY x)")
def _(s, d):
    out = stencil.shift(grid(s, d), "u", "x", 1, "clamp", "u_next")
    return stencil.shift(out, "u", "y", -2, "periodic", "u_wrap").select(*XYZ, "u_next", "u_wrap")


@query("win2_moving_sum", f"WITH {G} SELECT t,x,y,z,{rr('sum(u) OVER (PARTITION BY t,x,y ORDER BY z ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'sum_u')} FROM g")
def _(s, d):
    return rounded(stencil.moving_sum(grid(s, d), "u", "z", 2), list(XYZ), ["sum_u"])


_LG = lambda a: f"lag({a}) OVER l"


@query("win3_step_lengths", f"""WITH {V} SELECT line_id,seq,{rr(f"sqrt((x-{_LG('x')})*(x-{_LG('x')})+(y-{_LG('y')})*(y-{_LG('y')})+(z-{_LG('z')})*(z-{_LG('z')}))", 'step_length')},"time"-lag("time") OVER l step_time FROM vx WINDOW l AS (PARTITION BY line_id ORDER BY seq)""")
def _(s, d):
    return L.step_lengths(vertices(s, d)).select("line_id", "seq", r6("step_length").alias("step_length"), "step_time")


@query("win5_transmittance", f"WITH {G} SELECT t,x,y,z,{rr('coalesce(exp(sum(ln(1-v/20)) OVER (PARTITION BY t,x,y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),1.0)', 'pass')} FROM g")
def _(s, d):
    return grid(s, d).select(*XYZ, r6(ISO.transmittance(F.col("v") / 20.0, "z")).alias("pass"))


@query("win6_transitions", f"WITH {G} SELECT t,x,y,z FROM (SELECT *, lag(u>=25) OVER (PARTITION BY t,y,z ORDER BY x) b FROM g) WHERE b<>(u>=25)")
def _(s, d):
    return ISO.transitions(ISO.classify_iso(grid(s, d), "u", 25.0), "inside", "x").select(*XYZ)


_ZR = f"{_RUNS}, k AS (SELECT *, sum(CASE WHEN s<>0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i)-CASE WHEN s<>0 THEN 1 ELSE 0 END run FROM r), zr AS (SELECT l_orderkey, CAST(run AS BIGINT) run, CAST(sum(CASE WHEN s=0 THEN 1 ELSE 0 END) AS BIGINT) zeros, max(CASE WHEN s<>0 THEN s END) s FROM k GROUP BY 1,2)"


@query("win7_zero_runs", f"WITH {_ZR} SELECT * FROM zr")
def _(s, d):
    return Q.zero_runs(_symbols(s, d), "s", ["l_orderkey"], ["i"])


@query("srt1_depth", f"WITH {WP} SELECT pid,{rr('-(0.5*x-0.25*y+z+1)', 'depth')} FROM wp")
def _(s, d):
    return rounded(S.depth_sort(world_points(s, d), (0.5, -0.25, 1.0, 1.0)), ["pid"], ["depth"])


@query("srt2_top_bricks", f'WITH {_PB} SELECT bx,"by",bz,CAST(count(*) AS DOUBLE) score FROM pb GROUP BY 1,2,3 ORDER BY 4 DESC,3,2,1 LIMIT 5')
def _(s, d):
    return L.top_bricks(stats.points_per_brick(I.with_brick_of(world_points(s, d), INFO)).select("bx", "by", "bz", F.col("n_points").cast("double").alias("score")), 5)


@query("srt5_cap_lines", f"WITH {V} SELECT line_id,seq,x FROM vx WHERE seq<=7")
def _(s, d):
    return L.cap_lines(vertices(s, d), 7).select("line_id", "seq", "x")


@query("set1_append", f"WITH {G} SELECT t,x,y,z,u FROM g UNION ALL SELECT CAST(t+2 AS INT),x,y,z,u FROM g")
def _(s, d):
    g = grid(s, d)
    return B.append_timesteps(g, g, INFO, INFO).select(*XYZ, "u")


@query("set2_union_lines", f"WITH {V} SELECT line_id,seq,0 line_set FROM vx UNION ALL SELECT CAST(7 AS BIGINT),seq,1 FROM vx WHERE line_id%2=0")
def _(s, d):
    v = vertices(s, d)
    return L.union_lines(v, v.where("line_id % 2 = 0").withColumn("line_id", F.lit(7).cast("long"))).select("line_id", "seq", "line_set")


_HM = lambda ch, where="": f"SELECT {ch} channel,CAST(trunc((x+8)/16*8) AS INT) gx,CAST(trunc((y+8)/16*8) AS INT) gy,CAST(trunc((z+8)/16*8) AS INT) gz,count(*) cnt FROM vx {where} GROUP BY 1,2,3,4"


@query("set3_sync_channels", f"WITH {V}, h AS ({_HM('line_id%5')}) SELECT channel,gx,gy,gz,cnt FROM h WHERE channel IN (1,2) UNION ALL SELECT 9,NULL,NULL,NULL,0")
def _(s, d):
    v = vertices(s, d).withColumn("c", F.col("line_id") % 5)
    return S.sync_channels(L.heat_map(v, INFO, channel="c"), s.createDataFrame([(1,), (2,), (9,)], "channel long"))


# ---------------------------------------------------------------- derivatives and measures


@query("drv1_derivative", f"WITH {G} SELECT t,x,y,z,{rr(_d('u', 'x', 1.0), 'a')},{rr('((SELECT b.u FROM g b WHERE b.t=g.t AND b.x=g.x AND b.z=g.z AND b.y=(g.y+1)%8)-(SELECT b.u FROM g b WHERE b.t=g.t AND b.x=g.x AND b.z=g.z AND b.y=(g.y+7)%8))/2', 'b')} FROM g {WINDOWS}")
def _(s, d):
    out = stencil.derivative(grid(s, d), "u", "x", 0.5, out="a")
    return rounded(stencil.derivative(out, "u", "y", 1.0, "periodic", out="b"), list(XYZ), ["a", "b"])


_JC = [f"j{r}{c}" for r in range(3) for c in range(3)]
_SJ = f"WITH {J} SELECT t,x,y,z," + ",".join(rr(c, c) for c in _JC) + " FROM j"


@query("drv2_jacobian", _SJ)
def _(s, d):
    return rounded(stencil.jacobian(grid(s, d)), list(XYZ), _JC)


@query("drv2_jacobian_by_brick", _SJ)
def _(s, d):
    return rounded(stencil.jacobian_by_brick(grid(s, d), INFO), list(XYZ), _JC)


@query("drv3_gradient", f"WITH {J} SELECT t,x,y,z," + ",".join(rr(f"gt{a}", f"grad_temp_{a}") for a in "xyz") + " FROM j")
def _(s, d):
    return rounded(stencil.gradient(grid(s, d), "temp"), list(XYZ), [f"grad_temp_{a}" for a in "xyz"])


@query("drv6_measure_gradient", f"WITH {J}, n AS (SELECT *, sqrt(gtx*gtx+gty*gty+gtz*gtz) n FROM j) SELECT t,x,y,z," + ",".join(rr(f"gt{a}/nullif(n,0)", f"n_{a}") for a in "xyz") + " FROM n")
def _(s, d):
    return rounded(stencil.measure_gradient(grid(s, d), "temp"), list(XYZ), ["n_x", "n_y", "n_z"])


@query("drv7_strain", f"WITH {J} SELECT t,x,y,z," + ",".join(rr(f"(j{r}{c}+j{c}{r})/2", f"s{r}{c}") for r in range(3) for c in range(3)) + " FROM j")
def _(s, d):
    return rounded(T.with_strain(stencil.jacobian(grid(s, d))), list(XYZ), [f"s{r}{c}" for r in range(3) for c in range(3)])


@query("drv8_spin", f"WITH {J} SELECT t,x,y,z," + ",".join(rr(f"(j{r}{c}-j{c}{r})/2", f"o{r}{c}") for r in range(3) for c in range(3)) + " FROM j")
def _(s, d):
    return rounded(T.with_spin(stencil.jacobian(grid(s, d))), list(XYZ), [f"o{r}{c}" for r in range(3) for c in range(3)])


_s = lambda r, c: f"((j{r}{c}+j{c}{r})/2)"
_o = lambda r, c: f"((j{r}{c}-j{c}{r})/2)"
_ss = lambda r, c: "(" + "+".join(f"{_s(r, k)}*{_s(k, c)}" for k in range(3)) + ")"
_oo = lambda r, c: "(" + "+".join(f"{_o(r, k)}*{_o(k, c)}" for k in range(3)) + ")"
_w = ("(j21-j12)", "(j02-j20)", "(j10-j01)")
_tr = lambda f: "(" + "+".join(f(k, k) for k in range(3)) + ")"
_det = "(j00*(j11*j22-j12*j21)-j01*(j10*j22-j12*j20)+j02*(j10*j21-j11*j20))"
_K = 1.0 / math.sqrt(7e5 * 0.7)
_hc = [f"({c}*temp-{_K!r}*gt{a})" for c, a in zip("uvw", "xyz", strict=True)]
MEASURE_SQL = {
    "velocity": "sqrt(u*u+v*v+w*w)",
    "velocity_z": "w",
    "temperature": "temp",
    "vorticity": f"sqrt({'+'.join(f'{a}*{a}' for a in _w)})",
    "q_hunt": _QH,
    "delta_chong": f"pow((-0.5*({_tr(_ss)}+{_tr(_oo)}))/3,3)+pow({_det}/2,2)",
    "enstrophy_production": "+".join(f"{_w[a]}*{_s(a, b)}*{_w[b]}" for a in range(3) for b in range(3)),
    "strain_production": "+".join(f"{_s(a, b)}*{_s(b, c)}*{_s(c, a)}" for a in range(3) for b in range(3) for c in range(3)),
    "square_rotation": f"-0.5*{_tr(_oo)}",
    "square_rate_of_strain": _tr(_ss),
    "trace_jjt": "+".join(f"{c}*{c}" for c in _JC),
    "heat_current": f"sqrt({'+'.join(f'{c}*{c}' for c in _hc)})",
    "heat_current_x": _hc[0],
    "heat_current_y": _hc[1],
    "heat_current_z": _hc[2],
    "heat_current_alignment": f"coalesce(({'+'.join(f'{c}*{a}' for c, a in zip(_hc, 'uvw', strict=True))})/nullif(sqrt({'+'.join(f'{c}*{c}' for c in _hc)})*sqrt(u*u+v*v+w*w),0),0.0)",
}
for _n, _name in enumerate(["velocity", "velocity_z", "temperature", "vorticity", "lambda2", "q_hunt", "delta_chong", "enstrophy_production", "strain_production", "square_rotation", "square_rate_of_strain", "trace_jjt", "pva", "eigensystem", "heat_current", "heat_current_x", "heat_current_y", "heat_current_z", "heat_current_alignment"], 1):
    if _name == "eigensystem":
        continue
    _sql = MEASURE_SQL.get(_name)
    query(f"mea{_n}_{_name}", f"WITH {J} SELECT t,x,y,z,{rr(_sql, 'm')} FROM j" if _sql else None)(lambda s, d, name=_name: M.with_measure(M.prepare(grid(s, d), [name]), name, out="m").select(*XYZ, r6("m").alias("m")))

# the middle eigenvalue and the eigenvalues by the trigonometric form, written out for a symmetric matrix a b c d e f
_EIG = """e1 AS (SELECT *, (a+b+c)/3 mean FROM m0), e2 AS (SELECT *, sqrt(((a-mean)*(a-mean)+(b-mean)*(b-mean)+(c-mean)*(c-mean)+2*(d*d+e*e+f*f))/6) p FROM e1),
e3 AS (SELECT *, acos(least(1.0,greatest(-1.0,coalesce((((a-mean)*((b-mean)*(c-mean)-f*f)-d*(d*(c-mean)-f*e)+e*(d*f-(b-mean)*e))/2)/nullif(p*p*p,0),1.0))))/3 phi FROM e2),
e4 AS (SELECT *, mean+2*p*cos(phi) hi, mean+2*p*cos(phi+2*pi()/3) lo FROM e3)"""
ORACLES["mea5_lambda2"] = f"WITH {J}, m0 AS (SELECT t,x,y,z,{_ss(0, 0)}+{_oo(0, 0)} a,{_ss(1, 1)}+{_oo(1, 1)} b,{_ss(2, 2)}+{_oo(2, 2)} c,{_ss(0, 1)}+{_oo(0, 1)} d,{_ss(0, 2)}+{_oo(0, 2)} e,{_ss(1, 2)}+{_oo(1, 2)} f FROM j), {_EIG} SELECT t,x,y,z,{rr('3*mean-hi-lo', 'm')} FROM e4"

# the vector of the middle eigenvalue: the longest cross product of two rows of the matrix less the value
_CROSS = lambda p, q: (f"({p[1]}*{q[2]}-{p[2]}*{q[1]})", f"({p[2]}*{q[0]}-{p[0]}*{q[2]})", f"({p[0]}*{q[1]}-{p[1]}*{q[0]})")
_ROWS = (("(a-l)", "d", "e"), ("d", "(b-l)", "f"), ("e", "f", "(c-l)"))
_TRIES = [_CROSS(_ROWS[i], _ROWS[k]) for i, k in ((0, 1), (0, 2), (1, 2))]
_SIZES = ", ".join("+".join(f"{v}*{v}" for v in t) + f" n{k}" for k, t in enumerate(_TRIES))
_DOTS = ", ".join(f"abs({'+'.join(f'{v}*{o}' for v, o in zip(t, _w, strict=True))}) d{k}" for k, t in enumerate(_TRIES))
ORACLES["mea13_pva"] = f"WITH {J}, m0 AS (SELECT *,j00 a,j11 b,j22 c,j01 d,j02 e,j12 f FROM j), {_EIG}, e5 AS (SELECT *,3*mean-hi-lo l FROM e4), e6 AS (SELECT t,x,y,z,{_SIZES},{_DOTS} FROM e5), e7 AS (SELECT *,greatest(n0,n1,n2) n FROM e6) SELECT t,x,y,z,{rr('CASE WHEN n>0 THEN CASE WHEN n0>=n THEN d0 WHEN n1>=n THEN d1 ELSE d2 END/sqrt(n) ELSE 0.0 END', 'm')} FROM e7"


@query("mea14_eigensystem", f"WITH {J}, m0 AS (SELECT t,x,y,z,j00 a,j11 b,j22 c,j01 d,j02 e,j12 f FROM j), {_EIG} SELECT t,x,y,z,{rr('hi', 'e1')},{rr('3*mean-hi-lo', 'e2')},{rr('lo', 'e3')} FROM e4")
def _(s, d):
    return rounded(M.with_eigensystem(stencil.jacobian(grid(s, d))), list(XYZ), ["e1", "e2", "e3"])


@query("mea24_on_vertices", f"WITH {V} SELECT line_id,seq,{rr('sqrt(x*x+y*y+z*z)', 'm')} FROM vx")
def _(s, d):
    v = vertices(s, d).withColumns({"u": F.col("x"), "v": F.col("y"), "w": F.col("z")})
    return M.with_measure(v, "velocity", out="m").select("line_id", "seq", r6("m").alias("m"))


# ---------------------------------------------------------------- interpolation


def _lagrange_sql(n: int, t: str) -> list[str]:
    places = range(1 - n // 2, n // 2 + 1)
    return ["*".join(f"(({t}-({k}))/({i - k}.0))" for k in places if k != i) for i in places]


def _weights_sql(kernel: str, t: str) -> list[str]:
    if kernel == "linear":
        return [f"(1-{t})", t]
    if kernel == "bspline":
        return [f"pow(1-{t},3)/6", f"(4-6*{t}*{t}+3*{t}*{t}*{t})/6", f"(4-6*pow(1-{t},2)+3*pow(1-{t},3))/6", f"pow({t},3)/6"]
    if kernel.startswith("catrom"):
        return [f"0.5*(-pow({t},3)+2*{t}*{t}-{t})", f"0.5*(3*pow({t},3)-5*{t}*{t}+2)", f"0.5*(-3*pow({t},3)+4*{t}*{t}+{t})", f"0.5*(pow({t},3)-{t}*{t})"]
    return _lagrange_sql(int(kernel.removeprefix("lagrange")), t)


def _axis_sql(kernel: str, a: str, shift: float = 0.0, weights: list[str] | None = None) -> str:
    q = f"(p{a}-{shift})"
    weights = weights or _weights_sql(kernel, f"({q}-floor({q}))")
    parts = [f"SELECT pid p_{a}, CAST(least(7,greatest(0,floor({q})+({o}))) AS INT) i{a}, {w} w{a} FROM p" for o, w in zip(KERNELS[kernel].offsets, weights, strict=True)]
    return f"a{a} AS (" + " UNION ALL ".join(parts) + ")"


_FROM_AXES = "FROM p JOIN ax ON p_x=pid JOIN ay ON p_y=pid JOIN az ON p_z=pid JOIN g ON g.t=p.t AND g.x=ix AND g.y=iy AND g.z=iz GROUP BY pid"


def _staggered_sql() -> str:
    """Each component from a lattice half a cell further along its own axis."""
    parts = []
    for c, own in zip("uvw", "xyz", strict=True):
        axes = ", ".join(_axis_sql("catrom", a, 0.5 * (a == own)) for a in "xyz")
        parts.append(f"r{c} AS (WITH {axes} SELECT pid,sum(wx*wy*wz*{c}) {c} {_FROM_AXES})")
    return f"WITH {G}, {P}, {', '.join(parts)} SELECT pid,{rr('u', 'u')},{rr('v', 'v')},{rr('w', 'w')} FROM ru JOIN rv USING (pid) JOIN rw USING (pid)"


def _slope_sql(kernel: str, t: str) -> list[str]:
    if kernel == "bspline":
        return [f"-0.5*pow(1-{t},2)", f"1.5*{t}*{t}-2*{t}", f"2*(1-{t})-1.5*pow(1-{t},2)", f"0.5*{t}*{t}"]
    return [f"-1.5*{t}*{t}+2*{t}-0.5", f"4.5*{t}*{t}-5*{t}", f"-4.5*{t}*{t}+4*{t}+0.5", f"1.5*{t}*{t}-{t}"]


def _gradient_sql(kernel: str, channels: str) -> str:
    """CTEs sx, sy, sz: pid and the derivatives of channels along an axis, d<channel>_<axis>."""
    parts = []
    for own in "xyz":
        axes = [_axis_sql(kernel, a, weights=_slope_sql(kernel, f"(p{a}-floor(p{a}))") if a == own else None) for a in "xyz"]
        sums = ",".join(f"sum(wx*wy*wz*{c}) d{c}_{own}" for c in channels.split())
        parts.append(f"s{own} AS (WITH {', '.join(axes)} SELECT pid,{sums} {_FROM_AXES})")
    return ", ".join(parts)


def _sample_sql(kernel: str) -> str:
    axes = ", ".join(_axis_sql(kernel, a) for a in "xyz")
    return f"WITH {G}, {P}, {axes} SELECT pid," + ",".join(rr(f"sum(wx*wy*wz*{c})", c) for c in "uvw") + " FROM p JOIN ax ON p_x=pid JOIN ay ON p_y=pid JOIN az ON p_z=pid JOIN g ON g.t=p.t AND g.x=ix AND g.y=iy AND g.z=iz GROUP BY pid"


for _n, _k in enumerate(["linear", "bspline", "catrom", "catrom_staggered", "lagrange4", "lagrange6", "lagrange8"], 1):
    query(f"int{_n}_{_k}", _staggered_sql() if _k == "catrom_staggered" else _sample_sql(_k))(lambda s, d, k=_k: rounded(sampling.sample(grid_points(s, d), grid(s, d), INFO, k), ["pid"], ["u", "v", "w"]))


@query("int8_lagrange16", _sample_sql("lagrange16"))
def _(s, d):
    return rounded(sampling.sample_by_brick(grid_points(s, d), grid(s, d), I.VolumeInfo(8, 8, 8, 2, brick=8, overlap=2), "lagrange16"), ["pid"], ["u", "v", "w"])


@query("int9_time", f'WITH {G}, {P}, {", ".join(_axis_sql("linear", a) for a in "xyz")} SELECT pid,' + ",".join(rr(f"sum(wx*wy*wz*CASE WHEN g.t=0 THEN 1-\"time\" ELSE \"time\" END*{c})", c) for c in "uvw") + " FROM p JOIN ax ON p_x=pid JOIN ay ON p_y=pid JOIN az ON p_z=pid JOIN g ON g.x=ix AND g.y=iy AND g.z=iz GROUP BY pid")
def _(s, d):
    return rounded(sampling.sample(grid_points(s, d), grid(s, d), INFO, "linear", time="time"), ["pid"], ["u", "v", "w"])


for _n, _k in ((4, "bspline"), (5, "catrom")):
    query(f"drv{_n}_{_k}", f"WITH {G}, {P}, {_gradient_sql(_k, 'u')} SELECT pid,{rr('du_x', 'du_dx')},{rr('du_y', 'du_dy')},{rr('du_z', 'du_dz')} FROM sx JOIN sy USING (pid) JOIN sz USING (pid)")(lambda s, d, k=_k: rounded(sampling.derivative_at(grid_points(s, d), grid(s, d), INFO, k, ("u",)), ["pid"], ["du_dx", "du_dy", "du_dz"]))

# ---------------------------------------------------------------- filters

_BX = lambda src, a, r: f"sum({src}) OVER (PARTITION BY t,{','.join(b for b in 'xyz' if b != a)} ORDER BY {a} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)/{2 * r + 1}.0"
_B3 = lambda r, n="": f"f1{n} AS (SELECT t,x,y,z,{_BX('u', 'x', r)} u FROM g), f2{n} AS (SELECT t,x,y,z,{_BX('u', 'y', r)} u FROM f1{n}), f3{n} AS (SELECT t,x,y,z,{_BX('u', 'z', r)} u FROM f2{n})"


@query("flt1_box_axis", f"WITH {G}, w AS (SELECT *, {_BX('u', 'x', 2)} a, avg(u) OVER (PARTITION BY t,x,z ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) b, (sum(u) OVER (PARTITION BY t,x,y ORDER BY z ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)+greatest(0,2-z)*first_value(u) OVER q+greatest(0,z-5)*last_value(u) OVER q)/5.0 c FROM g WINDOW q AS (PARTITION BY t,x,y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT t,x,y,z,{rr('a', 'a')},{rr('b', 'b')},{rr('c', 'c')} FROM w")
def _(s, d):
    g = grid(s, d).select(*XYZ, *[F.col("u").alias(c) for c in "abc"])
    for c, axis, edge in (("a", "x", "zero"), ("b", "y", "shrink"), ("c", "z", "clamp")):
        g = smoothing.box_filter_axis(g, [c], axis, 2, edge)
    return rounded(g, list(XYZ), ["a", "b", "c"])


@query("flt2_box", f"WITH {G}, {_B3(1)} SELECT t,x,y,z,{rr('u', 'u')} FROM f3")
def _(s, d):
    return rounded(smoothing.box_filter(grid(s, d), ["u"], 1), list(XYZ), ["u"])


@query("flt3_4_pyramid", f"WITH {G}, {_B3(1, 'a')}, {_B3(2, 'b')} SELECT 0 \"level\",t,x,y,z,{rr('u', 'u')} FROM g UNION ALL SELECT 1,t,x,y,z,{rr('u', 'u')} FROM f3a UNION ALL SELECT 2,t,x,y,z,{rr('u', 'u')} FROM f3b UNION ALL SELECT 12,t,x,y,z,{rr('u', 'u')} FROM f3b")
def _(s, d):
    p = smoothing.filter_pyramid(grid(s, d), ["u"], [1, 2, 0])
    picked = smoothing.select_level(p, 2).withColumn("level", F.lit(12))
    return rounded(p.unionByName(picked), ["level", *XYZ], ["u"])


# ---------------------------------------------------------------- quantisation

_DJ = f"{J}, q AS (SELECT t,x,y,z,j00 v FROM j)"
_UQ = "CAST(CASE WHEN v<0 THEN ceil(v/0.7-0.5) ELSE floor(v/0.7+0.5) END AS BIGINT)"
_DQ = "CAST(trunc(v/0.7) AS BIGINT)"


def _signal(s, d):
    return stencil.jacobian(grid(s, d)).select(*XYZ, F.col("j00").alias("v"))


@query("qnt1_uniform", f"WITH {_DJ} SELECT t,x,y,z,{_UQ} v_q,{rr(f'{_UQ}*0.7', 'v_r')} FROM q")
def _(s, d):
    return Q.quantize(_signal(s, d), "v", 0.7).select(*XYZ, "v_q", r6("v_r").alias("v_r"))


@query("qnt2_deadzone", f"WITH {_DJ} SELECT t,x,y,z,{_DQ} v_q,{rr(f'({_DQ}+0.5*sign({_DQ}))*0.7', 'v_r')} FROM q")
def _(s, d):
    return Q.quantize(_signal(s, d), "v", 0.7, "deadzone").select(*XYZ, "v_q", r6("v_r").alias("v_r"))


@query("qnt3_symbols", f"WITH {_DJ} SELECT t,x,y,z,CAST(2*abs({_UQ})-CASE WHEN {_UQ}<0 THEN 1 ELSE 0 END AS BIGINT) v_q_s,{_UQ} back FROM q")
def _(s, d):
    out = Q.to_symbols(Q.quantize(_signal(s, d), "v", 0.7), "v_q")
    return out.select(*XYZ, "v_q_s", Q.from_symbols(F.col("v_q_s")).alias("back"))


@query("qnt4_bytes", f"WITH {_DJ} SELECT t,x,y,z,CAST(floor(greatest(0,least(255,v*20+128.5))) AS INT) v_q8,floor(greatest(0,least(255,v*20+128.5)))-128.0 v_r8 FROM q")
def _(s, d):
    return Q.quantize8(_signal(s, d).withColumn("v", F.col("v") * 20), "v").select(*XYZ, "v_q8", "v_r8")


@query("qnt5_report", f"WITH {_DJ}, e AS (SELECT t,v,abs({_DQ}*0.7+0.35*sign({_DQ})-v) e FROM q) SELECT t,'v' channel,{rr('sqrt(avg(e*e))', 'rms')},{rr('max(e)', 'max_abs')} FROM e GROUP BY t")
def _(s, d):
    return rounded(Q.quantize_report(_signal(s, d), {"v": 0.7}, "deadzone", ["t"]), ["t", "channel"], ["rms", "max_abs"])


@query("qnt6_residual", f"WITH {_DJ}, k AS (SELECT *,{_UQ}-coalesce(lag({_UQ}) OVER (PARTITION BY t,y,z ORDER BY x),0) r FROM q) SELECT t,x,y,z,CAST(2*abs(r)-CASE WHEN r<0 THEN 1 ELSE 0 END AS BIGINT) v_d FROM k")
def _(s, d):
    return Q.residual_symbols(_signal(s, d), "v", "x", 0.7).select(*XYZ, "v_d")


@query("qnt7_zero_run_stats", f"WITH {_ZR} SELECT zeros,count(*) runs FROM zr GROUP BY 1")
def _(s, d):
    return Q.zero_run_stats(_symbols(s, d), "s", ["l_orderkey"], ["i"])


@query("qnt8_coded_size", "WITH h AS (SELECT l_returnflag,CAST(floor(l_quantity/10) AS BIGINT) s,count(*) c FROM lineitem GROUP BY 1,2), t AS (SELECT *,sum(c) OVER (PARTITION BY l_returnflag) n FROM h) SELECT l_returnflag,CAST(sum(c) AS BIGINT) n," + rr("sum(-c*log2(c/n))/8", "bytes") + " FROM t GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem").select("l_returnflag", Q.quantized(F.col("l_quantity"), 10.0, "deadzone").alias("s"))
    return Q.coded_size(li, "s", ["l_returnflag"]).select("l_returnflag", "n", r6("bytes").alias("bytes"))


@query("qnt9_haar", f"WITH {G} SELECT t,y,z,'low' band,CAST(a.x//2 AS INT) i,{rr('(a.u+b.u)/2', 'c')} FROM g a JOIN g b USING (t,y,z) WHERE a.x%2=0 AND b.x=a.x+1 UNION ALL SELECT t,y,z,'high',CAST(a.x//2 AS INT),{rr('(b.u-a.u)/2')} FROM g a JOIN g b USING (t,y,z) WHERE a.x%2=0 AND b.x=a.x+1")
def _(s, d):
    return rounded(Q.wavelet(grid(s, d), "u", "x", "haar"), ["t", "y", "z", "band", "i"], ["c"])


def _level_sql(src: str, i: str, c: str, n: int, name: str) -> str:
    """One level of the wavelet along x over pencils of n cells: mirrored taps, joined to the cells they reach."""
    low, high = Q.FILTERS["cdf97"]["analysis"]
    taps = ",".join(f"({k - len(low) // 2},{a!r},{b!r})" for k, (a, b) in enumerate(zip(low, high, strict=True)))
    at = f"CASE WHEN abs(o.{i}+k)>={n} THEN {2 * (n - 1)}-abs(o.{i}+k) ELSE abs(o.{i}+k) END"
    return f"{name} AS (SELECT o.t,o.y,o.z,CASE WHEN o.{i}%2=0 THEN 'low' ELSE 'high' END band,CAST(o.{i}//2 AS INT) i,sum(CASE WHEN o.{i}%2=0 THEN lo ELSE hi END*q.{c}) c FROM {src} o, (VALUES {taps}) k(k,lo,hi), {src} q WHERE q.t=o.t AND q.y=o.y AND q.z=o.z AND q.{i}={at} GROUP BY o.t,o.y,o.z,o.{i})"


_LEVELS = f"{_level_sql('g', 'x', 'u', 8, 'w1')}, l1 AS (SELECT * FROM w1 WHERE band='low'), {_level_sql('l1', 'i', 'c', 4, 'w2')}, lv AS (SELECT 1 AS level,* FROM w1 WHERE band='high' UNION ALL SELECT 2,* FROM w2)"


@query("qnt9_cdf97_levels", f"WITH {G}, {_LEVELS} SELECT t,y,z,band,i,{rr('c', 'c')},level,CAST(trunc(c*pow(2,level)/0.5) AS BIGINT) q FROM lv")
def _(s, d):
    return rounded(Q.wavelet_levels(grid(s, d), "u", "x", 2, 0.5), ["t", "y", "z", "band", "i", "level", "q"], ["c"])


@query("qnt10_round_trip", f"WITH {G} SELECT t,x,y,z,{rr('u', 'c')} FROM g")
def _(s, d):
    back = Q.inverse_wavelet(Q.wavelet(grid(s, d), "u", "x", "cdf53"), "x", "cdf53")
    return rounded(back, list(XYZ), ["c"])


@query("qnt10_band_energy", f"WITH {G}, {_LEVELS} SELECT level,band,count(*) n,{rr('sum(c*c)', 'energy')} FROM lv GROUP BY 1,2")
def _(s, d):
    return rounded(Q.band_energy(Q.wavelet_levels(grid(s, d), "u", "x", 2, 0.5)), ["level", "band", "n"], ["energy"])


# ---------------------------------------------------------------- iso and compositing

_CR = lambda m, iso: f"SELECT t,x,y,{iso} iso,z-1+({iso}-a)/(m-a) at_,(m>={iso}) enters FROM (SELECT *,{m} m,lag({m}) OVER (PARTITION BY t,x,y ORDER BY z) a FROM src) WHERE a IS NOT NULL AND (a>={iso})<>(m>={iso})"
_C1 = "src AS (SELECT * FROM g)"


@query("iso1_classify", f"WITH {G} SELECT t,x,y,z,(-0.5*u>=-12.0) inside FROM g")
def _(s, d):
    return ISO.classify_iso(grid(s, d), "u", -12.0, -0.5).select(*XYZ, "inside")


@query("iso2_crossings", f"WITH {G}, {_C1}, c AS ({_CR('u', '25.0')}) SELECT t,x,y,{rr('at_', 'at')},enters FROM c")
def _(s, d):
    return ISO.iso_crossings(grid(s, d), "u", 25.0, "z").select("t", "x", "y", r6("at").alias("at"), "enters")


@query("iso3_first_hit", f"WITH {G}, {_C1}, c AS ({_CR('u', '25.0')}) SELECT t,x,y,{rr('min(at_)', 'depth')} FROM c GROUP BY t,x,y")
def _(s, d):
    return rounded(ISO.first_hit(grid(s, d), "u", 25.0, "z"), ["t", "x", "y"], ["depth"])


@query("iso4_two_values", f"WITH {G}, {_C1}, c AS ({_CR('u', '25.0')} UNION ALL {_CR('u', '27.0')}) SELECT t,x,y,iso,{rr('at_', 'at')},CAST(row_number() OVER (PARTITION BY t,x,y ORDER BY at_,iso) AS INT) hit FROM c".replace("25.0 iso", "CAST(25.0 AS DOUBLE) iso").replace("27.0 iso", "CAST(27.0 AS DOUBLE) iso"))
def _(s, d):
    return ISO.iso_crossings(grid(s, d), "u", [25.0, 27.0], "z").select("t", "x", "y", "iso", r6("at").alias("at"), "hit")


@query("iso5_pair", f"WITH {G}, {_B3(1)}, src AS (SELECT g.t,g.x,g.y,g.z,g.u,f3.u cu FROM g JOIN f3 USING (t,x,y,z)), c AS (SELECT *,'fine' surface FROM ({_CR('u', '25.0')}) UNION ALL SELECT *,'coarse' FROM ({_CR('cu', '20.0')})) SELECT t,x,y,surface,{rr('at_', 'at')} FROM c")
def _(s, d):
    g = grid(s, d)
    return ISO.iso_pair(g, "u", 25.0, smoothing.box_filter(g, ["u"], 1), "u", 20.0, "z").select("t", "x", "y", "surface", r6("at").alias("at"))


@query("iso6_cascade", f"WITH {G}, {_B3(1)} SELECT g.t,g.x,g.y,g.z FROM g JOIN f3 USING (t,x,y,z) WHERE g.u>=25 AND f3.u>=20")
def _(s, d):
    g = grid(s, d)
    return ISO.iso_cascade([g, smoothing.box_filter(g, ["u"], 1)], "u", [25.0, 20.0]).select(*XYZ)


_TF = "t4 AS (SELECT t,x,y,z,least(1.0,greatest(0.0,(u-20)/10.7)) f FROM g), c4 AS (SELECT t,x,y,z,0.1+f*0.8 r,0.2+f*0.1 gr,0.9-f*0.9 b,0.05+f*0.55 a FROM t4)"
_C0, _C4 = (0.1, 0.2, 0.9, 0.05), (0.9, 0.3, 0.0, 0.6)
_EA = "ea AS (SELECT t,x,y,z,r*a*0.5*exp(-a*0.25) r,gr*a*0.5*exp(-a*0.25) gr,b*a*0.5*exp(-a*0.25) b,1-exp(-a*0.5) a FROM c4)"


@query("iso7_transfer", f"WITH {G}, {_TF} SELECT t,x,y,z,{rr('r', 'r')},{rr('gr', 'g')},{rr('b', 'b')},{rr('a', 'a')} FROM c4")
def _(s, d):
    return rounded(ISO.transfer(grid(s, d), "u", 20.0, 30.7, _C0, _C4), list(XYZ), list("rgba"))


@query("iso8_emission", f"WITH {G}, {_TF}, {_EA} SELECT t,x,y,z,{rr('r', 'r')},{rr('gr', 'g')},{rr('b', 'b')},{rr('a', 'a')} FROM ea")
def _(s, d):
    return rounded(ISO.emission_absorption(ISO.transfer(grid(s, d), "u", 20.0, 30.7, _C0, _C4), 0.5), list(XYZ), list("rgba"))


for _name, _where, _clip in (("iso9_composite", "", None), ("iso10_clipped", "WHERE z BETWEEN 2 AND 5", (2, 5))):
    query(_name, f"WITH {G}, {_TF}, {_EA}, k AS (SELECT *, coalesce(exp(sum(ln(1-a)) OVER (PARTITION BY t,x,y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),1.0) p FROM ea {_where}) SELECT t,x,y," + ",".join(rr(f"sum(p*{c})", n) for c, n in (("r", "r"), ("gr", "g"), ("b", "b"), ("a", "a"))) + " FROM k GROUP BY t,x,y")(
        lambda s, d, clip=_clip: rounded(ISO.composite(ISO.emission_absorption(ISO.transfer(grid(s, d), "u", 20.0, 30.7, _C0, _C4), 0.5), "z", clip), ["t", "x", "y"], list("rgba"))
    )


@query("iso11_colors", f"""WITH {V} SELECT line_id,seq,{rr('line_id%1024/1024.0', 'a')},{rr('least(1.0,"time"/3.0)', 'b')} FROM vx""")
def _(s, d):
    v = ISO.color_lines(vertices(s, d), "line").withColumnRenamed("color", "a")
    return rounded(ISO.color_lines(v, "age", 3.0).withColumnRenamed("color", "b"), ["line_id", "seq"], ["a", "b"])


# ---------------------------------------------------------------- seeds

BOX = ((-6.0, -6.0, -6.0), (12.0, 12.0, 12.0))
_U = lambda key, seed, k: f"(((({{0}}*48271+1013)%2147483647*69621+1013)%2147483647*40014+1013)%2147483647/2147483647.0)".format(f"(({key}*48271+{seed}*69621+{k}*16807+12345)%2147483647)")


def _n(s, d, name="supplier") -> int:
    return table(s, d, name).count()


@query("sed1_random", f"SELECT s_suppkey pid," + ",".join(rr(f"-6.0+12.0*{_U('s_suppkey', 1, k)}", a) for k, a in enumerate("xyz")) + " FROM supplier")
def _(s, d):
    rows = seeds._placed(table(s, d, "supplier").select(F.col("s_suppkey").alias("pid")), F.col("pid"), BOX, 1)
    return rounded(rows, ["pid"], ["x", "y", "z"])


_SG = "m AS (SELECT count(*) n, floor(sqrt(count(*))) k FROM customer)"


@query("sed2_grid", f"WITH {_SG} SELECT CAST(i AS BIGINT) pid,{rr('-6.0+12.0*(i%k)/k', 'x')},{rr('-6.0+12.0*floor(i/k)/k', 'y')},-6.0 z FROM (SELECT row_number() OVER ()-1 i FROM customer), m")
def _(s, d):
    return seeds.seed_grid(s, _n(s, d, "customer"), BOX).select("pid", r6("x").alias("x"), r6("y").alias("y"), "z")


@query("sed3_ftle", "WITH n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) r FROM customer), g AS (SELECT a.i gx,b.i gy,r FROM n,(SELECT unnest(range(CAST(floor(sqrt(count(*))) AS BIGINT))) i FROM customer) a,(SELECT unnest(range(CAST(floor(sqrt(count(*))) AS BIGINT))) i FROM customer) b), k AS (SELECT * FROM (VALUES (0,-0.1,0.0,0.0),(1,0.1,0.0,0.0),(2,0.0,-0.2,0.0),(3,0.0,0.2,0.0),(4,0.0,0.0,-0.3),(5,0.0,0.0,0.3)) q(k,dx,dy,dz)) SELECT CAST((gx*r+gy)*6+k AS BIGINT) pid," + rr("-6.0+12.0*gx/r+dx", "x") + "," + rr("-6.0+12.0*gy/r+dy", "y") + "," + rr("1.5+dz", "z") + " FROM g,k")
def _(s, d):
    return rounded(seeds.seed_ftle(s, I.isqrt(_n(s, d, "customer")), BOX, 1.5, (0.1, 0.2, 0.3)), ["pid"], ["x", "y", "z"])


@query("sed4_regions", f"WITH {REG}, d AS (SELECT i pid,a.a attempt," + ",".join(f"-6.0+12.0*{_U('(i*20+a.a)', 1, k)} {a}" for k, a in enumerate("xyz")) + f" FROM (SELECT row_number() OVER ()-1 i FROM supplier), range(20) a(a)), h AS (SELECT pid,attempt,x,y,z FROM (SELECT *,{_TX[0]} tx,{_TX[1]} ty FROM d) JOIN reg USING (tx,ty) WHERE region IN (2,5) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY attempt)=1) SELECT d.pid," + ",".join(rr(f"coalesce(h.{a},17.0)", a) for a in "xyz") + " FROM d LEFT JOIN h USING (pid) WHERE d.attempt=0")
def _(s, d):
    return rounded(seeds.seed_regions(s, _n(s, d), BOX, regions(s), [2, 5], INFO, 16, 16), ["pid"], ["x", "y", "z"])


@query("sed5_emissions", f"SELECT CAST(e*n+i AS BIGINT) pid,CAST(e AS INT) emission," + ",".join(rr(f"-6.0+12.0*{_U('i', 1, k)}", a) for k, a in enumerate("xyz")) + " FROM (SELECT row_number() OVER ()-1 i, count(*) OVER () n FROM supplier), range(3) r(e)")
def _(s, d):
    return rounded(seeds.emit_seeds(s, _n(s, d), BOX, 3, False), ["pid", "emission"], ["x", "y", "z"])


# ---------------------------------------------------------------- trajectories


@query("trj1_segments", f"WITH {V} SELECT line_id,seq,x x0,lead(x) OVER l x1,z z0,lead(z) OVER l z1 FROM vx QUALIFY lead(x) OVER l IS NOT NULL WINDOW l AS (PARTITION BY line_id ORDER BY seq)".replace("QUALIFY lead(x) OVER l IS NOT NULL WINDOW l AS (PARTITION BY line_id ORDER BY seq)", "WINDOW l AS (PARTITION BY line_id ORDER BY seq) QUALIFY lead(x) OVER l IS NOT NULL"))
def _(s, d):
    return L.segments(vertices(s, d)).select("line_id", "seq", "x0", "x1", "z0", "z1")


@query("trj2_heat_map", f"WITH {V} {_HM('CAST(0 AS BIGINT)')}")
def _(s, d):
    return L.heat_map(vertices(s, d), INFO)


@query("trj2_heat_map_segments", f"WITH {V}, e AS (SELECT *, CASE WHEN lag(x) OVER l IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(x) OVER l IS NULL THEN 0 ELSE 1 END wt FROM vx WINDOW l AS (PARTITION BY line_id ORDER BY seq)) SELECT CAST(0 AS BIGINT) channel,CAST(trunc((x+8)/16*8) AS INT) gx,CAST(trunc((y+8)/16*8) AS INT) gy,CAST(trunc((z+8)/16*8) AS INT) gz,CAST(sum(wt) AS BIGINT) cnt FROM e WHERE wt>0 GROUP BY 1,2,3,4")
def _(s, d):
    return L.heat_map(vertices(s, d), INFO, "segment_end")


_H5 = f"WITH {V}, h AS ({_HM('line_id%5')})"
for _mode, _sql in (("max", "max(cnt)"), ("mean", "(SELECT avg(m) FROM (SELECT avg(cnt) m FROM h GROUP BY channel))"), ("median", "(SELECT avg(greatest(m,1)) FROM (SELECT channel, min(cnt) m FROM (SELECT channel,cnt,row_number() OVER (PARTITION BY channel ORDER BY cnt) r,count(*) OVER (PARTITION BY channel) n FROM h) WHERE r>floor(n/2) GROUP BY channel))")):
    _scale = "(SELECT max(cnt) FROM h)" if _mode == "max" else _sql
    query(f"trj4_normalize_{_mode}", f"{_H5} SELECT channel,gx,gy,gz,{rr(f'cnt/{_scale}', 'value')} FROM h")(lambda s, d, m=_mode: rounded(L.normalize_heat_map(L.heat_map(vertices(s, d).withColumn("c", F.col("line_id") % 5), INFO, channel="c"), m), ["channel", "gx", "gy", "gz"], ["value"]))

_TIC = f"""WITH RECURSIVE {VIS}, st AS (SELECT pid,seq,region own,dt ins,CAST(0.0 AS DOUBLE) outs,region lng,dt most FROM vis WHERE seq=1
UNION ALL SELECT pid,seq,own,ins,outs,CASE WHEN ins>most THEN own ELSE lng END,greatest(ins,most) FROM (SELECT v.pid,v.seq,
 CASE WHEN s.own<>v.region AND s.outs+v.dt>0.6 THEN v.region ELSE s.own END own, CASE WHEN s.own=v.region THEN s.ins+v.dt WHEN s.outs+v.dt>0.6 THEN s.outs+v.dt ELSE s.ins END ins,
 CASE WHEN s.own=v.region THEN s.outs WHEN s.outs+v.dt>0.6 THEN 0.0 ELSE s.outs+v.dt END outs, s.lng, s.most FROM st s JOIN vis v ON v.pid=s.pid AND v.seq=s.seq+1))"""


@query("trj5_time_in_cell", f"{_TIC} SELECT pid,seq,own current_cell,ins time_in_cell,lng longest_cell,most longest_time FROM st")
def _(s, d):
    return L.time_in_cell(visits(s, d), 0.6)


for _n2, _name, _col in ((20, "current_cell", "own"), (21, "longest_cell", "lng"), (22, "time_in_current_cell", "ins")):
    query(f"mea{_n2}_{_name}", f"{_TIC} SELECT pid,seq,CAST({_col} AS DOUBLE) m FROM st")(lambda s, d, name=_name: M.with_measure(L.time_in_cell(visits(s, d), 0.6), name, out="m").select("pid", "seq", "m"))


@query("trj6_heat_by_region", f"WITH {V}, {REG}, e AS (SELECT vx.*, region FROM (SELECT *, {_TX[0]} tx, {_TX[1]} ty FROM vx) vx JOIN reg USING (tx,ty) WHERE region IN (1,3)) SELECT region channel,CAST(trunc((x+8)/16*8) AS INT) gx,CAST(trunc((y+8)/16*8) AS INT) gy,CAST(trunc((z+8)/16*8) AS INT) gz,count(*) cnt FROM e GROUP BY 1,2,3,4")
def _(s, d):
    v = vertices(s, d).withColumns({"sx": F.col("x"), "sy": F.col("y")})
    return L.heat_map_by_region(v, INFO, regions(s), [1, 3], 16, 16)


_NS = f"""WITH {_PB}, n AS (SELECT bx,"by" b2,bz,CAST(count(*) AS DOUBLE) n FROM pb GROUP BY 1,2,3), dd AS (SELECT * FROM (VALUES (-1,0,0),(0,-1,0),(0,0,-1),(1,0,0),(0,1,0),(0,0,1)) q(dx,dy,dz)),
k AS (SELECT n.bx,n.b2,n.bz,n.n,coalesce(m.n,0) nb,(n.bx+dx)%2=0 here FROM n JOIN dd ON n.bx+dx BETWEEN 0 AND 3 AND n.b2+dy BETWEEN 0 AND 3 AND n.bz+dz BETWEEN 0 AND 3 LEFT JOIN n m ON m.bx=n.bx+dx AND m.b2=n.b2+dy AND m.bz=n.bz+dz)"""


@query("trj9_neighbour_score", f"""{_NS} SELECT bx,b2 "by",bz,{rr('max(n)+0.1*sum(CASE WHEN here THEN (n+nb)/6 ELSE 0 END)-0.2*sum(CASE WHEN here THEN 0 ELSE nb/6 END)', 'score')} FROM k GROUP BY bx,b2,bz""")
def _(s, d):
    n = stats.points_per_brick(I.with_brick_of(world_points(s, d), INFO)).select("bx", "by", "bz", F.col("n_points").alias("n"))
    return rounded(L.neighbour_score(n, INFO, lattice(s).where("bx % 2 = 0"), None, 0.1, 0.2), ["bx", "by", "bz"], ["score"])


from fieldspark.plans import parts, traces  # noqa: E402, F401  (registers the queries on traces, streams and parts of volumes)
