"""Queries of components, distances, contours, walks, particles, meshes, files and the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import aggregates as ag
from ..operators import catalogue as ca
from ..operators import joins as jo
from ..operators import mesh as me
from ..operators import particles as pt
from ..operators import regions as rg
from ..operators import scalar as sc
from ..sources import formats
from ..volume import POINT, embedding_blocks, embedding_voxels, linear_decode, map_volumes, read, to_voxels
from .registry import SQL, query, r6, vox_sql
from .summaries import BAND, PART, argmin_join, particles

#: Reachable pairs of face-connected voxels of one label, and components numbered in raster order.
REACH = """ed as (select a.vec_id, a.z * 16 + a.y * 4 + a.x as i, b.z * 16 + b.y * 4 + b.x as j from {0} a join {0} b on a.vec_id = b.vec_id and a.lab = b.lab and a.lab <> 0 and abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
rc(vec_id, i, j) as (select vec_id, z * 16 + y * 4 + x, z * 16 + y * 4 + x from {0} where lab <> 0 union select r.vec_id, r.i, e.j from rc r join ed e on r.vec_id = e.vec_id and r.j = e.i),
ro as (select vec_id, i, min(j) as root from rc group by vec_id, i),
cc as (select v.vec_id, v.z, v.y, v.x, v.lab, ro.root, count(*) over (partition by v.vec_id, ro.root) as size from {0} v join ro on v.vec_id = ro.vec_id and v.z * 16 + v.y * 4 + v.x = ro.i)"""


def recursive(body: str, view: str = "vox", *more: str) -> str:
    return vox_sql(body, *more, REACH.format(view)).replace("with ", "with recursive ", 1)


def label_blocks(spark, sf):
    v = lambda a, b: F.transform("data", lambda x: F.when(x > a, 1.0).otherwise(0.0)) if b is None else None
    lab = F.transform("data", lambda x: F.when(x > 0.05, 3.0).when(x > 0, 2.0).when(x > -0.05, 1.0).otherwise(0.0))
    return embedding_blocks(spark, sf).withColumns({"lab": lab, "gt": v(0.0, None), "seeds": F.transform("data", lambda x: F.when(x > 0.25, 2.0).when(x < -0.25, 1.0).otherwise(0.0)), "mask": F.transform("data", lambda x: F.when(x > -0.1, 1.0).otherwise(0.0))})


def ones(blocks, value):
    return to_voxels(blocks, value=value)


@query("connected_components_6", recursive("select vec_id, z, y, x, dense_rank() over (partition by vec_id order by root)::bigint as component from cc"))
def connected_components(spark, sf):
    return ones(rg.components(label_blocks(spark, sf), "lab"), "component").where("component > 0")


@query("connected_components_large", recursive("select vec_id, z, y, x, lab, dense_rank() over (partition by vec_id order by root)::int as component from cc"))
def connected_components_large(spark, sf):
    return rg.components_large(embedding_voxels(spark, sf).where("lab <> 0").select(*POINT, "lab"), "lab", edge=2).select(*POINT, "lab", "component")


@query("clean", recursive("select vec_id, z, y, x, (case when size > 0.5 * most then lab else 0 end)::bigint as lab from (select *, max(size) over (partition by vec_id, lab) as most from cc) union all select vec_id, z, y, x, 0 from vox where lab = 0"))
def clean(spark, sf):
    return ones(rg.clean(label_blocks(spark, sf), 0.5, "lab"), "lab")


@query("clean_fast", recursive("select v.vec_id, v.z, v.y, v.x, (cc.root is not null and cc.root = b.root)::bigint as keep from g v left join cc using (vec_id, z, y, x) left join (select vec_id, arg_min(root, (-size, root)) as root from cc group by vec_id) b on v.vec_id = b.vec_id", "g", "g as (select vec_id, z, y, x, gt as lab from vox)"))
def clean_fast(spark, sf):
    return ones(rg.clean_fast(label_blocks(spark, sf), "gt"), "keep")


HOLE = "g as (select vec_id, z, y, x, 1 - gt as lab from vox)"


@query("fill_fast", recursive("select v.vec_id, v.z, v.y, v.x, (1 - v.lab + coalesce(h.inside, 0))::bigint as filled from g v left join (select *, (min(case when z in (0, 3) or y in (0, 3) or x in (0, 3) then 0 else 1 end) over (partition by vec_id, root)) as inside from cc) h using (vec_id, z, y, x)", "g", HOLE))
def fill_fast(spark, sf):
    return ones(rg.fill_fast(label_blocks(spark, sf), "gt"), "filled")


@query("fill", recursive("select v.vec_id, v.z, v.y, v.x, (case when 1 - v.lab = 1 or h.inside = 1 and h.size <= 0.1 * n.n then 1 else 0 end)::bigint as lab from g v left join (select *, (min(case when z in (0, 3) or y in (0, 3) or x in (0, 3) then 0 else 1 end) over (partition by vec_id, root)) as inside from cc) h using (vec_id, z, y, x) join (select vec_id, sum(1 - lab) as n from g group by vec_id) n on n.vec_id = v.vec_id", "g", HOLE))
def fill(spark, sf):
    return ones(rg.fill(label_blocks(spark, sf), 0.1, "gt"), "lab")


@query("cleaned_filled")
def cleaned_filled(spark, sf):
    return ones(rg.cleaned_filled(label_blocks(spark, sf), 0.3, "lab"), "lab")


@query("min_size_filter_components", recursive("select v.vec_id, v.z, v.y, v.x, (case when cc.size >= 5 then v.lab else 0 end)::bigint as lab from g v left join cc using (vec_id, z, y, x)", "g", "g as (select vec_id, z, y, x, gt as lab from vox)"))
def min_size_filter(spark, sf):
    return ones(rg.at_least(label_blocks(spark, sf), 5, "gt"), "lab")


@query("largest_component", recursive("select vec_id, arg_min(root, (-size, root))::int as root, max(size)::bigint as size from cc group by vec_id", "g", "g as (select vec_id, z, y, x, gt as lab from vox)"))
def largest_component(spark, sf):
    comp = ones(rg.components(label_blocks(spark, sf), "gt"), "component").where("component > 0")
    sizes = comp.groupBy("vec_id", "component").agg(F.count("*").alias("size"), F.min(F.col("z") * 16 + F.col("y") * 4 + F.col("x")).alias("root"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("size"), "root")
    return sizes.withColumn("n", F.row_number().over(w)).where("n = 1").select("vec_id", "root", "size")


#: The operators above on volumes cut into blocks of two voxels, which are settled between them: the same SQL.
EDGE = 2
query("connected_components_blocks", SQL["connected_components_6"])(lambda spark, sf: ones(rg.components(label_blocks(spark, sf), "lab", EDGE), "component").where("component > 0"))
query("clean_blocks", SQL["clean"])(lambda spark, sf: ones(rg.clean(label_blocks(spark, sf), 0.5, "lab", EDGE), "lab"))
query("clean_fast_blocks", SQL["clean_fast"])(lambda spark, sf: ones(rg.clean_fast(label_blocks(spark, sf), "gt", EDGE), "keep"))
query("fill_blocks", SQL["fill"])(lambda spark, sf: ones(rg.fill(label_blocks(spark, sf), 0.1, "gt", EDGE), "lab"))
query("fill_fast_blocks", SQL["fill_fast"])(lambda spark, sf: ones(rg.fill_fast(label_blocks(spark, sf), "gt", EDGE), "filled"))
query("min_size_filter_blocks", SQL["min_size_filter_components"])(lambda spark, sf: ones(rg.at_least(label_blocks(spark, sf), 5, "gt", EDGE), "lab"))

#: In a box without obstacles the chamfer distance of two voxels has a closed form.
CHAMFER = "pr as (select a.vec_id, a.z, a.y, a.x, list_sort([abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)]) as d from vox a left join (select * from vox where gt > 0) b using (vec_id))"
CHAMFER_SQL = vox_sql("select vec_id, z, y, x, round(min(d[1] * sqrt(3::double) + (d[2] - d[1]) * sqrt(2::double) + (d[3] - d[2])), 6) as d from pr group by all", CHAMFER)


@query("chamfer_distance_blocks", CHAMFER_SQL)
def chamfer_distance_blocks(spark, sf):
    return ones(rg.chamfer(label_blocks(spark, sf), "gt", edge=EDGE), "d").select(*POINT, F.when(F.col("d") < 1e9, r6("d")).alias("d"))


query("geodesic_distance_blocks")(lambda spark, sf: ones(rg.geodesic(label_blocks(spark, sf), 0.5, edge=EDGE), "d").select(*POINT, F.when(F.col("d") < 1e9, r6("d")).alias("d")))
query("geodesic_segment_blocks")(lambda spark, sf: ones(rg.geodesic_segment(label_blocks(spark, sf), 0.5, edge=EDGE), "lab"))
query("nearest_index_blocks")(lambda spark, sf: ones(rg.nearest_label(label_blocks(spark, sf), edge=EDGE), "lab"))


@query("chamfer_distance", CHAMFER_SQL)
def chamfer_distance(spark, sf):
    return ones(rg.chamfer(label_blocks(spark, sf), "gt"), "d").select(*POINT, F.when(F.col("d") < 1e9, r6("d")).alias("d"))


@query("geodesic_distance")
def geodesic_distance(spark, sf):
    return ones(rg.geodesic(label_blocks(spark, sf), 0.5), "d").select(*POINT, F.when(F.col("d") < 1e9, r6("d")).alias("d"))


@query("geodesic_segment")
def geodesic_segment(spark, sf):
    return ones(rg.geodesic_segment(label_blocks(spark, sf), 0.5), "lab")


@query("nearest_index_propagation")
def nearest_index_propagation(spark, sf):
    return ones(rg.nearest_label(label_blocks(spark, sf)), "lab")


@query("nearest_seed_join", vox_sql("select a.vec_id, a.z, a.y, a.x, arg_min(s.lab, ((a.z - s.z) * (a.z - s.z) + (a.y - s.y) * (a.y - s.y) + (a.x - s.x) * (a.x - s.x), s.lab))::int as lab from vox a join (select vec_id, z, y, x, case when v > 0.25::double then 2 else 1 end as lab from vox where abs(v) > 0.25::double) s using (vec_id) group by a.vec_id, a.z, a.y, a.x"))
def nearest_seed_join(spark, sf):
    vox = embedding_voxels(spark, sf)
    return jo.nearest(vox, vox.where("abs(v) > 0.25D").select(*POINT, F.when(F.col("v") > 0.25, 2).otherwise(1).alias("lab")), "lab").drop("d2")


@query("random_walk_hits")
def random_walk_hits(spark, sf):
    return rg.random_walk_hits(label_blocks(spark, sf), labels="seeds")


@query("random_walk_allaxis")
def random_walk_allaxis(spark, sf):
    return rg.random_walk_hits(label_blocks(spark, sf), labels="seeds", axes=(0, 1, 2))


@query("random_walk_large")
def random_walk_large(spark, sf):
    return rg.random_walk_hits(label_blocks(spark, sf), labels="seeds", adaptive=True)


@query("random_walk_large_allaxis")
def random_walk_large_allaxis(spark, sf):
    return rg.random_walk_hits(label_blocks(spark, sf), labels="seeds", axes=(0, 1, 2), adaptive=True)


@query("smart_interpolation")
def smart_interpolation(spark, sf):
    return rg.smart_interpolation(label_blocks(spark, sf), labels="seeds")


@query("curvature_flow_smooth")
def curvature_flow(spark, sf):
    return ones(rg.curvature_flow(embedding_blocks(spark, sf), 5), "v").select(*POINT, r6("v").alias("v"))


EVOLVE = """me as (select vec_id, gt, avg(v) as m from vox group by all),
ca as (select a.vec_id, a.z, a.y, a.x, b.gt as lab, abs(a.v - m) as d, (case when a.z = b.z and a.y = b.y and a.x = b.x then 0 else 1 end) as far
  from vox a join vox b on a.vec_id = b.vec_id and abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 join me on me.vec_id = a.vec_id and me.gt = b.gt)"""


@query("acwe_evolution", vox_sql("select vec_id, z, y, x, arg_min(lab, (round(d, 12), far))::bigint as lab from ca group by vec_id, z, y, x", EVOLVE))
def acwe_evolution(spark, sf):
    return ones(rg.evolve(label_blocks(spark, sf), 1.0, "gt"), "lab")


@query("acwe_morph_curvature")
def acwe_morph(spark, sf):
    return ones(rg.smooth_masks(label_blocks(spark, sf), 2, "gt"), "lab")


@query("active_contour")
def active_contour(spark, sf):
    return ones(rg.active_contour(label_blocks(spark, sf), 3, 1, 1.0, "gt"), "lab")


@query("refinement", vox_sql("select vec_id, z, y, x, (case when p1 > p0 then 1 else 0 end)::int as lab from (select v.*, coalesce(exp(-((v - m1) * (v - m1)) / (2 * s1 * s1)) / s1, 0) as p1, coalesce(exp(-((v - m0) * (v - m0)) / (2 * s0 * s0)) / s0, 0) as p0 from vox v join (select vec_id, z, avg(v) filter (gt = 1) as m1, greatest(stddev_pop(v) filter (gt = 1), 1.0) as s1, avg(v) filter (gt = 0) as m0, greatest(stddev_pop(v) filter (gt = 0), 1.0) as s0 from vox group by all) using (vec_id, z))"))
def refinement(spark, sf):
    vox = embedding_voxels(spark, sf)
    side = lambda k: F.when(F.col("gt") == k, F.col("v"))
    stats = vox.groupBy("vec_id", "z").agg(*(f.alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg(side(k))), ("s", F.greatest(F.stddev_pop(side(k)), F.lit(1.0))))))
    p = lambda k: F.coalesce(F.exp(-((F.col("v") - F.col(f"m{k}")) ** 2) / (2 * F.col(f"s{k}") ** 2)) / F.col(f"s{k}"), F.lit(0.0))
    return vox.join(stats, ["vec_id", "z"]).select(*POINT, F.when(p(1) > p(0), 1).otherwise(0).alias("lab"))


@query("label_particles")
def label_particles(spark, sf):
    blocks = label_blocks(spark, sf).withColumn("boundary", F.transform("data", lambda x: F.when(F.abs(x) < 0.01, 1.0).otherwise(0.0)))
    return ones(rg.label_particles(blocks, 3), "lab")


@query("remove_container")
def remove_container(spark, sf):
    return ones(rg.remove_container(label_blocks(spark, sf), "gt", width=1), "v")


@query("resize_cubic")
def resize_cubic(spark, sf):
    return ones(rg.resize(embedding_blocks(spark, sf), (6, 6, 6)), "v").select(*POINT, r6("v").alias("v"))


@query("rotate_resample", vox_sql("select a.vec_id, a.z, a.y, a.x, b.gt::bigint as gt from vox a join vox b on a.vec_id = b.vec_id and b.z = a.z and b.y = a.x and b.x = 3 - a.y"))
def rotate_resample(spark, sf):
    import numpy as np

    turn = arrays.rotation(np.pi / 2, 0, 0)
    return ones(map_volumes(label_blocks(spark, sf), lambda a: arrays.rotate_mask(a, turn).astype(np.int64), ("gt",), "array<bigint>"), "gt")


def _pairs(spark, sf):
    """Each volume of even number with the next one, which stands for its match in another scan."""
    b = label_blocks(spark, sf).select("vec_id", "gt", F.floor(F.col("vec_id") / 2).alias("pair"))
    even, odd = b.where("vec_id % 2 = 0"), b.where("vec_id % 2 = 1")
    return even.select("pair", F.col("vec_id").alias("id_a"), F.col("gt").alias("a")).join(odd.select("pair", F.col("vec_id").alias("id_b"), F.col("gt").alias("b")), "pair")


@query("rotation_grid_search")
def rotation_grid_search(spark, sf):
    return rg.rotation_search(_pairs(spark, sf))


@query("rotation_dice")
def rotation_dice(spark, sf):
    return rg.rotation_search(_pairs(spark, sf)).select("id_a", "id_b", "dice")


@query("majority_vote", recursive("select v.vec_id, v.z, v.y, v.x, (cc.root is not null and cc.root = b.root)::bigint as keep from g v left join cc using (vec_id, z, y, x) left join (select vec_id, arg_min(root, (-size, root)) as root from cc group by vec_id) b on v.vec_id = b.vec_id", "g", "g as (select vec_id // 3 as vec_id, z, y, x, (sum(gt) >= 2)::int as lab from vox group by vec_id // 3, z, y, x having count(*) = 3)"))
def majority_vote(spark, sf):
    rows = label_blocks(spark, sf).withColumn("group", F.floor(F.col("vec_id") / 3)).groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "gt"))), lambda s: s["gt"]).alias("votes"))
    won = rg.majority_votes(rows.where(F.size("votes") == 3).select(F.col("group").alias("vec_id"), "votes"))
    return won.select("vec_id", F.posexplode("data").alias("p", "keep")).select("vec_id", *linear_decode(F.col("p"), F.lit(4), F.lit(4)), "keep")


@query("match_components", vox_sql("select component, count(*)::bigint as n from (select a as component, b from (select a, arg_min(b, (cost, b)) as b from (select a, b, round(abs(level_a - level_b), 6) as cost from bd) group by a)) t where b in (select b from (select a, arg_min(b, (cost, b)) as b from (select a, b, round(abs(level_a - level_b), 6) as cost from bd) group by a) group by b having count(*) = 1) group by component", PART, BAND).replace("count(*)::bigint as n from (select a as component, b", "(count(*) + 1)::bigint as n from (select a as component, b"))
def match_components(spark, sf):
    edges = argmin_join(spark, sf).select(F.lit(0).alias("scan_a"), "a", F.lit(1).alias("scan_b"), "b", F.lit(0.95).alias("dice"))
    return pt.match_components(edges).groupBy((F.col("component") % (1 << 40)).alias("component")).agg(F.count("*").alias("n"))


@query("sort_mappings_by_detections", "select component, n as n_scans, row_number() over (order by n desc, component)::int as nth from (" + SQL["match_components"] + ")")
def sort_mappings(spark, sf):
    edges = argmin_join(spark, sf).select(F.lit(0).alias("scan_a"), "a", F.lit(1).alias("scan_b"), "b", F.lit(0.95).alias("dice"))
    return pt.sort_mappings(pt.match_components(edges))


MATCHED = "nt as (select scan, particle, row_number() over (partition by scan order by size, particle) as nth from pa where scan < 3)"
SIDE = "(select x.particle as {2}, y.particle as {3} from nt x join nt y using (nth) where x.scan = {0} and y.scan = {1} and nth % {4} <> 0)"


@query("match_mappings_v1", vox_sql("select p0, p1, coalesce(p2, p2c) as p2 from " + SIDE.format(0, 1, "p0", "p1", 2) + " ab full join " + SIDE.format(1, 2, "p1", "p2", 4) + " bc using (p1) full join " + SIDE.format(0, 2, "p0", "p2c", 3) + " ac using (p0) where not (p2 is not null and p2c is not null and p2 <> p2c)", PART, MATCHED))
def match_mappings(spark, sf):
    p = particles(spark, sf).where("scan < 3").withColumn("nth", F.row_number().over(Window.partitionBy("scan").orderBy("size", "particle")))
    one = lambda s, c: p.where(F.col("scan") == s).select("nth", F.col("particle").alias(c))
    edges = None
    for s, t in ((0, 1), (1, 2), (0, 2)):
        e = one(s, "a").join(one(t, "b"), "nth").select(F.lit(s).alias("scan_a"), "a", F.lit(t).alias("scan_b"), "b", F.when(F.col("nth") % (s + t + 1) == 0, 0.5).otherwise(0.95).alias("dice"))
        edges = e if edges is None else edges.unionByName(e)
    return pt.pairwise_mappings(edges, (0, 1, 2))


QUADS = " union all ".join(f"select vec_id, z, y, x, lab, {i} as axis, {s} as side from (select *, coalesce({'lag' if s < 0 else 'lead'}(lab) over (partition by vec_id, {rest} order by {a}), 0) as o from vox) where lab <> 0 and o <> lab" for i, (a, rest) in enumerate((("z", "y, x"), ("y", "z, x"), ("x", "z, y"))) for s in (-1, 1))


@query("mesh_surface", vox_sql("select vec_id, lab, count(*)::bigint as n_faces, sum(case axis when 0 then 2.0 when 1 then 1.5 else 3.0 end)::double as area from (" + QUADS + ") group by all"))
def mesh_surface(spark, sf):
    return me.surface_area(embedding_voxels(spark, sf), (1.0, 2.0, 1.5))


@query("marching_cubes_mesh")
def mesh_triangles(spark, sf):
    return me.triangles(embedding_voxels(spark, sf).select(*POINT, "gt"), label="gt").select("vec_id", "attribute", "p0", "p1", "p2")


# formats: each query encodes every volume, decodes the bytes and returns what came back -----------------


def _round_trip(spark, sf, there, back):
    import hashlib

    import numpy as np

    from ..volume import map_rows

    def run(batch):
        out = {k: [] for k in ("vec_id", "n_bytes", "same", "total")}
        for i in range(batch.num_rows):
            a = np.asarray(batch.column("lab")[i].values).reshape(4, 4, 4).astype(np.uint8)
            data = there(formats.Volume(a, (1.0, 2.0, 1.5)))
            got = back(data)
            for k, v in zip(out, (batch.column("vec_id")[i].as_py(), len(data), hashlib.sha1(got.tobytes()).digest() == hashlib.sha1(a.tobytes()).digest(), int(got.sum()))):
                out[k].append(v)
        return out

    return map_rows(label_blocks(spark, sf).select("vec_id", "lab"), "vec_id bigint, n_bytes bigint, same boolean, total bigint", run).select("vec_id", "same", "total")


_SUMS = vox_sql("select vec_id, true as same, sum(lab)::bigint as total from vox group by vec_id")
for _name, _there, _back in (
    ("amira_rle", lambda v: formats.encode_amira(v, "HxByteRLE"), lambda d: formats.decode_amira(d)[0].data),
    ("amira_zip", lambda v: formats.encode_amira(v, "HxZip"), lambda d: formats.decode_amira(d)[0].data),
    ("amira_raw", lambda v: formats.encode_amira(v, ""), lambda d: formats.decode_amira(d)[0].data),
    ("nrrd", formats.encode_nrrd, lambda d: formats.decode_nrrd(d).data),
    ("mha", formats.encode_mha, lambda d: formats.decode_mha(d).data),
    ("nifti", formats.encode_nifti, lambda d: formats.decode_nifti(d).data),
    ("tiff", formats.encode_tiff, lambda d: formats.decode_tiff(d).data),
    ("npy", formats.encode_npy, lambda d: formats.decode_npy(d).data),
):
    query(f"sink_scan_{_name}", _SUMS)(lambda spark, sf, there=_there, back=_back: _round_trip(spark, sf, there, back))


@query("amira_header_rewrite", "select 'define Lattice 8 6 5' as lattice, 'BoundingBox 0 7 0 5 0 8' as box")
def amira_header(spark, sf):
    text = formats.encode_amira(formats.Volume(__import__("numpy").zeros((2, 2, 2), "u1")), "").decode("latin-1")
    new = spark.createDataFrame([(formats.rewrite_amira_header(text, (5, 6, 8), (1.0, 1.0, 2.0)),)], "t string")
    return new.select(F.regexp_extract("t", r"(define Lattice [0-9 ]+[0-9])", 1).alias("lattice"), F.regexp_extract("t", r"(BoundingBox [0-9 ]+[0-9])", 1).alias("box"))


@query("scan_slicer_segmentation", "select * from (values (0, 1, 'bone', 2), (0, 2, 'skin', 1), (1, 1, 'air', 3)) t(layer, label_value, segment, new_label)")
def slicer_segmentation(spark, sf):
    from ..sources.volumes import slicer_segments

    header = {"Segment0_Name": " Bone", "Segment0_Layer": "0", "Segment0_LabelValue": "1", "Segment1_Name": "Skin", "Segment1_Layer": "0", "Segment1_LabelValue": "2", "Segment2_Name": "AIR ", "Segment2_Layer": "1", "Segment2_LabelValue": "1", "space": "x"}
    return slicer_segments(spark.createDataFrame([(header,)], "header map<string,string>"), ["skin", "bone", "air"])


@query("image_cli", vox_sql("select a.vec_id, a.z, a.y, a.x, floor(avg(b.u8))::int as smooth from u a join u b on a.vec_id = b.vec_id and abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all", "u as (select *, floor((v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0) * 255)::int as u8 from vox window w as (partition by vec_id))"))
def image_cli(spark, sf):
    from ..operators.stencil import box_mean

    return box_mean(sc.to_uint8(embedding_voxels(spark, sf)), "u8").select(*POINT, F.floor("smooth").cast("int").alias("smooth"))


# catalogue over the business tables ------------------------------------------------------------------


@query("catalogue_search", "select s_suppkey, s_name from supplier where s_name ilike '%7%' order by s_name limit 20")
def catalogue_search(spark, sf):
    return ca.search(read(spark, sf, "supplier"), "7", ["s_name"], "s_name", 20).select("s_suppkey", "s_name")


@query("catalogue_fk_joins", "select n_name, count(*)::bigint as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = (select min(r_name) from region) group by n_name")
def catalogue_fk_joins(spark, sf):
    region = read(spark, sf, "region")
    first = region.agg(F.min("r_name").alias("r_name"))
    nations = read(spark, sf, "nation").join(region.join(first, "r_name", "left_semi"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return read(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("permission_check", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def permission_check(spark, sf):
    grants = read(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return ca.permitted(read(spark, sf, "orders"), grants, ["o_custkey"]).select("o_orderkey")


@query("list_uploads", "select o_orderkey from orders where o_custkey in (1, 2, 3, 5, 8) and o_orderstatus = 'O'")
def list_uploads(spark, sf):
    return read(spark, sf, "orders").where(F.col("o_custkey").isin(1, 2, 3, 5, 8) & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("one_active_repair", "select event_id, (case when active > 0 and row_number() over (partition by user_id order by active desc, event_id) = 1 then 1 else 0 end)::int as active from (select *, (value > 50)::int as active from events)")
def one_active(spark, sf):
    rows = read(spark, sf, "events").select("event_id", "user_id", (F.col("value") > 50).cast("int").alias("active"))
    return ca.one_active(rows, ["user_id"], "active", "event_id").select("event_id", "active")


@query("project_readiness", "select l_orderkey from (select l_orderkey, case when l_linenumber = 1 then 'image' else 'label' end as kind, case when l_returnflag = 'N' then 0 else 1 end as status from lineitem) group by l_orderkey having count(*) = 2 and count(*) filter (kind = 'image' and status = 0) = 1 and count(*) filter (kind = 'label') = 1")
def project_readiness(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, "image").otherwise("label").alias("kind"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("status"))
    return ca.ready_projects(rows, "l_orderkey", "kind", "status")


@query("queue_routing", "select case when o_totalprice > 150000 then 'large' else 'small' end as queue, count(*)::bigint as n from orders group by 1")
def queue_routing(spark, sf):
    return read(spark, sf, "orders").groupBy(ca.queue_for(F.col("o_totalprice"), 150000).alias("queue")).agg(F.count("*").alias("n"))


@query("stalled_jobs", "select event_id from events where event_type = (select min(event_type) from events) and epoch((select max(ts) from events) - ts) > 864000")
def stalled_jobs(spark, sf):
    events = read(spark, sf, "events")
    ends = F.broadcast(events.agg(F.max("ts").alias("__now"), F.min("event_type").alias("__kind")))  # one row
    return ca.stalled(events.crossJoin(ends), F.col("event_type") == F.col("__kind"), "ts", F.col("__now"), 864000).select("event_id")


@query("storage_accounting", "select user_id, round(sum(value), 4) as used, sum(value) > 500 as over from events group by 1")
def storage_accounting(spark, sf):
    return ca.storage(read(spark, sf, "events"), "user_id", F.col("value"), 500.0).withColumn("used", F.round("used", 4))


@query("history_merge", "select o_orderkey, (case when o_orderkey % 7 = 0 then 1 else 0 end)::int as state from orders")
def history_merge(spark, sf):
    old = read(spark, sf, "orders").select("o_orderkey", F.lit(0).alias("state"))
    return ca.merge_rows(old, old.where("o_orderkey % 7 = 0").withColumn("state", F.lit(1)), ["o_orderkey"])


@query("elapsed_time", "select event_id, case when s >= 3600 then (s // 3600) || ' h ' || (s % 3600 // 60) || ' min ' || (s % 60) || ' sec' when s >= 60 then (s // 60) || ' min ' || (s % 60) || ' sec' else s || ' sec' end as elapsed from (select event_id, floor(value * 100)::bigint as s from events)")
def elapsed_time(spark, sf):
    return read(spark, sf, "events").select("event_id", ca.elapsed(F.floor(F.col("value") * 100)).alias("elapsed"))


@query("sha256_id", "select c_custkey, sha256(c_name) as id from customer")
def sha256_id(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("id"))


@query("header_keys", "select event_id, (props->>'k')::int as k from events")
def header_keys(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("event_windows", "select (time_bucket(interval '1 hour', ts))::varchar as start, event_type, count(*)::bigint as n from events group by all")
def event_windows(spark, sf):
    from ..streaming.jobs import job_counts

    return job_counts(read(spark, sf, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("match_counts", vox_sql("select scan, count(*)::bigint as n, sum(size)::bigint as total from pa group by scan", PART))
def match_counts(spark, sf):
    return particles(spark, sf).groupBy("scan").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


@query("smooth_uncertainty_mean", vox_sql("select vec_id, round(avg(v), 6) as v from vox group by vec_id"))
def uncertainty_mean(spark, sf):
    return ag.region_mean(embedding_voxels(spark, sf).withColumn("one", F.lit(1)), "one").select("vec_id", r6("mean").alias("v"))
