"""Queries of projections, selections and patches over the voxel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scalar as sc
from ..operators import selection as se
from ..operators import stencil as st
from ..volume import AT, KEY, POINT, embedding_voxels, linear_decode, linear_id, read
from .registry import FAC, SHAPE, faces_sql, query, r6, vox_sql

U8 = "u as (select *, floor((v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0) * 255)::int as u8 from vox window w as (partition by vec_id))"


@query("to_uint8", vox_sql("select vec_id, z, y, x, u8 from u", U8))
def to_uint8(spark, sf):
    return sc.to_uint8(embedding_voxels(spark, sf)).select(*POINT, "u8")


@query("scale_0_255_float", vox_sql("select vec_id, z, y, x, round((v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0) * 255, 6) as scaled from vox window w as (partition by vec_id)"))
def scale_float(spark, sf):
    return sc.scale_range(embedding_voxels(spark, sf), 255).select(*POINT, r6("scaled").alias("scaled"))


@query("minmax_01", vox_sql("select vec_id, z, y, x, round((v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0), 6) as scaled from vox window w as (partition by vec_id)"))
def minmax(spark, sf):
    return sc.scale_range(embedding_voxels(spark, sf)).select(*POINT, r6("scaled").alias("scaled"))


@query("zscore_match", vox_sql("select vec_id, z, y, x, round(greatest(0, least(1, coalesce((v - avg(v) over w) / nullif(stddev_pop(v) over w, 0), 0) * 0.2 + 0.5)), 6)::double as matched from vox window w as (partition by vec_id)"))
def zscore(spark, sf):
    return sc.zscore_match(embedding_voxels(spark, sf), 0.5, 0.2).select(*POINT, r6("matched").alias("matched"))


@query("patch_normalize", vox_sql("select vec_id, z, y, x, round((v - avg(v) over w) / greatest(stddev_pop(v) over w, 1e-6), 6) as norm from vox window w as (partition by vec_id)"))
def patch_normalize(spark, sf):
    return sc.patch_normalize(embedding_voxels(spark, sf)).select(*POINT, r6("norm").alias("norm"))


@query("welford_mean_std", vox_sql("select vec_id, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from vox group by vec_id"))
def mean_std(spark, sf):
    return sc.mean_std(embedding_voxels(spark, sf)).select("vec_id", r6("mean").alias("mean"), r6("std").alias("std"))


@query("rgb2gray", vox_sql("select vec_id, z, y, x, trunc(u8 * 0.2989::double + (255 - u8) * 0.587::double + ((u8 * 7) % 256) * 0.114::double)::int as gray from u", U8))
def rgb2gray(spark, sf):
    u = F.col("u8")
    return sc.to_uint8(embedding_voxels(spark, sf)).select(*POINT, sc.rgb2gray(u, 255 - u, u * 7 % 256).alias("gray"))


@query("color_to_gray", vox_sql("""select vec_id, z, y, x, (case when g = (select arg_min(g, (-n, g)) from (select g, count(*) as n from c where vec_id = o.vec_id group by g)) then 0 else g end)::int as gray from c o""", U8, "c as (select vec_id, z, y, x, floor(0.299::double * u8 + 0.587::double * (255 - u8) + 0.114::double * ((u8 * 7) % 256))::int as g from u)"))
def color_to_gray(spark, sf):
    u = F.col("u8")
    g = F.floor(F.lit(0.299) * u + F.lit(0.587) * (255 - u) + F.lit(0.114) * (u * 7 % 256)).cast("int")
    return sc.drop_background(sc.to_uint8(embedding_voxels(spark, sf)).select(*POINT, g.alias("gray")), "gray").select(*POINT, "gray")


@query("drop_background", vox_sql("select vec_id, z, y, x, (case when lab = (select arg_min(lab, (-n, lab)) from b where vec_id = o.vec_id) then 0 else lab end)::int as lab from vox o", "b as (select vec_id, lab, count(*) as n from vox group by all)"))
def drop_background(spark, sf):
    return sc.drop_background(embedding_voxels(spark, sf)).select(*POINT, "lab")


HIST = "h as (select vec_id, u8, count(*)::bigint as n from u where u8 > 0 group by vec_id, u8), hc as (select *, (sum(n) over (partition by vec_id order by u8))::bigint as cum, sum(n) over (partition by vec_id) as total from h)"


@query("hist_cumsum", vox_sql("select vec_id, u8, n, cum from hc", U8, HIST))
def hist_cumsum(spark, sf):
    return sc.histogram(sc.to_uint8(embedding_voxels(spark, sf)), "u8").select("vec_id", "u8", "n", "cum")


@query("percentile_hist", vox_sql("select vec_id, min(u8) filter (cum / total::double >= 0.05) as q_low, min(u8) filter (cum / total::double >= 0.95) as q_high from hc group by vec_id", U8, HIST))
def percentile_hist(spark, sf):
    return sc.histogram_quantiles(sc.to_uint8(embedding_voxels(spark, sf)), "u8", 0.05, 0.95)


@query("contrast", vox_sql("""select vec_id, z, y, x, floor((c - min(c) over w) / nullif(max(c) over w - min(c) over w, 0) * 255)::int as contrast
  from (select u.*, greatest(q_low, least(q_high, u8))::double as c from u join (select vec_id, min(u8) filter (cum / total::double >= 0.05) as q_low, min(u8) filter (cum / total::double >= 0.95) as q_high from hc group by vec_id) using (vec_id)) window w as (partition by vec_id)""", U8, HIST))
def contrast(spark, sf):
    return sc.contrast(sc.to_uint8(embedding_voxels(spark, sf)), "u8", 0.05, 0.95).select(*POINT, "contrast")


@query("binarize", vox_sql("select vec_id, z, y, x, case when v < 0.05::double then 0.0::double when v > 0 then 1.0::double else v end as b from vox"))
def binarize(spark, sf):
    return embedding_voxels(spark, sf).select(*POINT, sc.binarize(F.col("v"), 0.05).alias("b"))


@query("mask_apply", vox_sql("select vec_id, z, y, x, (case when v < 0 then 0 else lab end)::int as lab from vox"))
def mask_apply(spark, sf):
    vox = embedding_voxels(spark, sf)
    return sc.mask_apply(vox.select(*POINT, "lab"), vox.where("v < 0"), "lab").select(*POINT, "lab")


@query("softmax", "with e as (select vec_id, [x::double for x in embedding] as a from embeddings), m as (select vec_id, [exp(x - list_max(a)) for x in a] as s from e) select vec_id, generate_subscripts(s, 1)::int - 1 as i, round(unnest(s) / list_sum(s), 6) as p from m")
def softmax(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.posexplode(sc.softmax(F.col("embedding").cast("array<double>"))).alias("i", "p"))
    return rows.select("vec_id", "i", r6("p").alias("p"))


@query("scale_probabilities", vox_sql("select vec_id, z, y, x, k, round(p / greatest(1.0, sum(p) over (partition by vec_id, z, y, x)), 6) as p from q", "q as (select vec_id, z, y, x, k, abs(v) * k as p from vox, (values (1), (2), (3)) t(k))"))
def scale_probabilities(spark, sf):
    rows = embedding_voxels(spark, sf).select(*POINT, F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"), F.abs("v").alias("a")).withColumn("p", F.col("a") * F.col("k"))
    return sc.scale_probabilities(rows).select(*POINT, "k", r6("p").alias("p"))


@query("crop", vox_sql("select vec_id, (z - 1)::int as z, (y - 1)::int as y, x, v from vox where z in (1, 2) and y in (1, 2) and x < 3"))
def crop(spark, sf):
    return sc.crop(embedding_voxels(spark, sf).select(*POINT, "v"), (1, 1, 0), (3, 3, 3))


@query("embed", vox_sql("select g.vec_id, a.i::int as z, b.i::int as y, c.i::int as x, coalesce(v, 0.0::double) as v from (select distinct vec_id from vox) g, range(4) a(i), range(4) b(i), range(4) c(i) left join (select vec_id, z, y, x, v from vox where z in (1, 2) and y in (1, 2) and x < 3) o on o.vec_id = g.vec_id and o.z = a.i and o.y = b.i and o.x = c.i"))
def embed(spark, sf):
    return sc.embed(sc.crop(embedding_voxels(spark, sf).select(*POINT, "v"), (1, 1, 0), (3, 3, 3)), (1, 1, 0), SHAPE)


@query("pad_constant", vox_sql("select g.vec_id, a.i::int as z, b.i::int as y, c.i::int as x, coalesce(v, 0.0::double) as v from (select distinct vec_id from vox) g, range(6) a(i), range(6) b(i), range(6) c(i) left join vox o on o.vec_id = g.vec_id and o.z + 1 = a.i and o.y + 1 = b.i and o.x + 1 = c.i"))
def pad_constant(spark, sf):
    return sc.embed(embedding_voxels(spark, sf).select(*POINT, "v"), (1, 1, 1), (6, 6, 6))


@query("ghost_mirror_pad", vox_sql("select vec_id, a.i::int as z, b.i::int as y, x, v from vox, range(6) a(i), range(5) b(i) where z = least(a.i, 7 - a.i) and y = least(b.i, 7 - b.i)"))
def ghost_mirror_pad(spark, sf):
    return sc.mirror_pad(embedding_voxels(spark, sf).select(*POINT, "v"), SHAPE, (6, 5, 4))


@query("orient_unify", vox_sql("select vec_id, x as z, (3 - z)::int as y, y as x, v from vox"))
def orient_unify(spark, sf):
    return sc.orient(embedding_voxels(spark, sf).select(*POINT, "v"), ("x", "z", "y"), (False, True, False), SHAPE)


@query("orient_restore", vox_sql("select vec_id, z, y, x, v from vox"))
def orient_restore(spark, sf):
    there = orient_unify(spark, sf)
    return sc.orient(there, ("y", "x", "z"), (True, False, False), SHAPE)


@query("flip_honeybee", vox_sql("select vec_id, (3 - z)::int as z, y, (3 - x)::int as x, v from vox"))
def flip_honeybee(spark, sf):
    return sc.orient(embedding_voxels(spark, sf).select(*POINT, "v"), ("z", "y", "x"), (True, False, True), SHAPE)


@query("linear_id", vox_sql("select vec_id, ((z * 4 + y) * 4 + x)::int as id, z, y, x from vox"))
def linear_ids(spark, sf):
    rows = embedding_voxels(spark, sf).select("vec_id", linear_id(*map(F.col, AT), F.lit(4), F.lit(4)).alias("id"))
    return rows.select("vec_id", "id", *linear_decode(F.col("id"), F.lit(4), F.lit(4)))


@query("position_channel", vox_sql("select vec_id, z, y, x, ((z - 2.0) * (z - 2.0) + (y - 2.0) * (y - 2.0) + (x - 2.0) * (x - 2.0))::double as d2 from vox"))
def position_channel(spark, sf):
    return embedding_voxels(spark, sf).select(*POINT, sc.position_channel(SHAPE).alias("d2"))


@query("resize_image", vox_sql("select vec_id, (z // 2)::int as z, (y // 2)::int as y, (x // 2)::int as x, round(avg(v), 6) as v from vox group by all"))
def resize_image(spark, sf):
    return sc.area_resize(embedding_voxels(spark, sf), 2).select(*POINT, r6("v").alias("v"))


@query("resize_labels", vox_sql("select vec_id, (z // 2)::int as z, (y // 2)::int as y, (x // 2)::int as x, (case when min(gt) = max(gt) then max(gt) else 0 end)::int as gt from vox group by all"))
def resize_labels(spark, sf):
    return sc.resize_labels(embedding_voxels(spark, sf), 2, "gt")


@query("zoom_nearest", vox_sql("select vec_id, a.i::int as z, b.i::int as y, c.i::int as x, lab from vox, range(6) a(i), range(6) b(i), range(6) c(i) where z = round_even(a.i * (3.0::double / 5.0::double), 0) and y = round_even(b.i * (3.0::double / 5.0::double), 0) and x = round_even(c.i * (3.0::double / 5.0::double), 0)"))
def zoom_nearest(spark, sf):
    return sc.zoom_nearest(embedding_voxels(spark, sf).select(*POINT, "lab"), SHAPE, (6, 6, 6))


@query("upscale_label_nearest", vox_sql("select vec_id, a.i::int as z, b.i::int as y, c.i::int as x, lab from vox, range(6) a(i), range(6) b(i), range(6) c(i) where a.i >= floor(z * 1.5) and a.i < floor((z + 1) * 1.5) and b.i >= floor(y * 1.5) and b.i < floor((y + 1) * 1.5) and c.i >= floor(x * 1.5) and c.i < floor((x + 1) * 1.5)"))
def upscale(spark, sf):
    return sc.upscale_labels(embedding_voxels(spark, sf).select(*POINT, "lab"), 1.5, (6, 6, 6))


@query("only_labels", vox_sql("select vec_id, z, y, x, (case when lab in (1, 3) then lab else 0 end)::int as lab from vox"))
def only_labels(spark, sf):
    return se.only_labels(embedding_voxels(spark, sf).select(*POINT, "lab"), "1,3")


@query("ignore_labels", vox_sql("select vec_id, z, y, x, (case when lab in (1, 3) then 0 else lab end)::int as lab from vox"))
def ignore_labels(spark, sf):
    return se.ignore_labels(embedding_voxels(spark, sf).select(*POINT, "lab"), "1,3")


@query("labelled_slices", vox_sql("select distinct vec_id, z from vox where v > 0.2::double"))
def labelled_slices(spark, sf):
    return se.labelled_slices(embedding_voxels(spark, sf).withColumn("lab", (F.col("v") > 0.2).cast("int")))


@query("labelled_slices_sampled", vox_sql("select vec_id, min(z)::int as z from vox where lab <> 0 group by vec_id union all select a.vec_id, min(b.z)::int from (select vec_id, min(z) as z from vox where lab <> 0 group by vec_id) a join (select distinct vec_id, z from vox where lab <> 0) b on a.vec_id = b.vec_id and b.z >= a.z + 2 group by a.vec_id"))
def labelled_slices_sampled(spark, sf):
    return se.labelled_slices_sampled(embedding_voxels(spark, sf), jump=2)


ALLAXIS = "a1 as (select vec_id, z, y, x, case when lab <> coalesce(lag(lab) over w, 0) and lab <> coalesce(lead(lab) over w, 0) then 0 else lab end as lab from vox window w as (partition by vec_id, z, x order by y)), a2 as (select vec_id, z, y, x, case when lab <> coalesce(lag(lab) over w, 0) and lab <> coalesce(lead(lab) over w, 0) then 0 else lab end as lab from a1 window w as (partition by vec_id, z, y order by x))"


@query("labelled_slices_allaxis", vox_sql("select distinct vec_id, z from a2 where lab <> 0", ALLAXIS))
def labelled_slices_allaxis(spark, sf):
    return se.labelled_slices_allaxis(embedding_voxels(spark, sf))


@query("adjacent_slice_check", vox_sql("select distinct a.vec_id, a.z from vox a join vox b on a.vec_id = b.vec_id and b.z = a.z - 1 and b.v > 0.2::double where a.v > 0.2::double"))
def adjacent(spark, sf):
    return se.adjacent_slices(embedding_voxels(spark, sf).withColumn("lab", (F.col("v") > 0.2).cast("int")))


@query("slice_adjacency", vox_sql("select vec_id, z, (z - lag(z) over (partition by vec_id order by z))::int as gap from (select distinct vec_id, z from vox where v > 0.2::double)"))
def slice_adjacency(spark, sf):
    from pyspark.sql import Window

    rows = se.labelled_slices(embedding_voxels(spark, sf).withColumn("lab", (F.col("v") > 0.2).cast("int")))
    return rows.withColumn("gap", F.col("z") - F.lag("z").over(Window.partitionBy("vec_id").orderBy("z")))


@query("patch_ids", "select vec_id, (a.i * 16 + b.i * 4 + c.i)::int as patch_id, a.i::int as pz, b.i::int as py, c.i::int as px from embeddings, range(0, 3, 2) a(i), range(0, 3, 2) b(i), range(0, 3, 2) c(i)")
def patch_ids(spark, sf):
    return se.patch_grid(read(spark, sf, "embeddings"), SHAPE, 2, 2).select("vec_id", "patch_id", "pz", "py", "px")


PATCH = """pa as (select vec_id, (a.i * 16 + b.i * 4 + c.i)::int as patch_id, min(lab) as low, max(lab) as high, max(lab) filter (z = a.i + 1 and y = b.i + 1 and x = c.i + 1) as centre,
  count(*) filter (lab > 0) as n_labelled, count(*) filter (lab < 0) as n_padding, count(distinct lab) filter (lab > 0) as n_labels
  from vox, range(3) a(i), range(3) b(i), range(3) c(i) where z between a.i and a.i + 1 and y between b.i and b.i + 1 and x between c.i and c.i + 1 group by vec_id, a.i, b.i, c.i)"""


def _stats(spark, sf):
    return se.patch_stats(embedding_voxels(spark, sf).select(*POINT, "lab"), SHAPE, 2, 1)


@query("patch_select_separation", vox_sql("select vec_id, patch_id from pa where centre > 0 and (low <> centre or high <> centre)", PATCH))
def patch_select_separation(spark, sf):
    return se.select_separation(_stats(spark, sf)).select("vec_id", "patch_id")


@query("patch_select_refinement", vox_sql("select vec_id, patch_id from pa where low <> centre or high <> centre", PATCH))
def patch_select_refinement(spark, sf):
    return se.select_refinement(_stats(spark, sf)).select("vec_id", "patch_id")


@query("patch_select_mask", vox_sql("select vec_id, patch_id from pa where n_labelled > 0", PATCH))
def patch_select_mask(spark, sf):
    return se.select_mask(_stats(spark, sf)).select("vec_id", "patch_id")


@query("patch_select_padding", vox_sql("select vec_id, (a.i * 16 + b.i * 4 + c.i)::int as patch_id from vox, range(3) a(i), range(3) b(i), range(3) c(i) where z between a.i and a.i + 1 and y between b.i and b.i + 1 and x between c.i and c.i + 1 group by vec_id, a.i, b.i, c.i having min(case when v < (-0.2)::double then -1 else lab end) >= 0"))
def patch_select_padding(spark, sf):
    rows = embedding_voxels(spark, sf).select(*POINT, F.when(F.col("v") < -0.2, -1).otherwise(F.col("lab")).alias("lab"))
    return se.drop_padding(se.patch_stats(rows, SHAPE, 2, 1)).select("vec_id", "patch_id")


@query("fg_bg_split", vox_sql("select vec_id, patch_id, centre > 0 and n_labels > 1 as foreground from pa", PATCH))
def fg_bg_split(spark, sf):
    return se.split_foreground(_stats(spark, sf), "separation").select("vec_id", "patch_id", "foreground")


@query("crop_vector_label", vox_sql("select vec_id, 1 as axis, z as k, (case when max(v) > 0.2::double then 1 else -1 end)::int as mark from vox group by vec_id, z union all select vec_id, 2, y, (case when max(v) > 0.2::double then 2 else -2 end)::int from vox group by vec_id, y union all select vec_id, 3, x, (case when max(v) > 0.2::double then 3 else -3 end)::int from vox group by vec_id, x"))
def crop_vector_label(spark, sf):
    return se.crop_vector(embedding_voxels(spark, sf).withColumn("lab", (F.col("v") > 0.2).cast("int")))


@query("crop_run_filter", "with f as (select user_id, event_id, row_number() over (partition by user_id order by event_id)::int as k, (value > 30)::int as hit from events), i as (select *, k - row_number() over (partition by user_id, hit order by k) as run from f) select user_id, k, (case when hit > 0 and count(*) over (partition by user_id, hit, run) < 2 then 0 else hit end)::int as hit from i")
def crop_run_filter(spark, sf):
    from pyspark.sql import Window

    rows = read(spark, sf, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("k"), (F.col("value") > 30).cast("int").alias("hit"))
    return se.clear_short_runs(rows, ["user_id"], "k", "hit", 2).select("user_id", "k", "hit")


@query("crop_extent", vox_sql("select vec_id, greatest(0, min(z) filter (v > 0.2::double) - 1)::int as first, least(3, max(z) filter (v > 0.2::double) + 1)::int as last from vox group by vec_id having count(*) filter (v > 0.2::double) > 0"))
def crop_extent(spark, sf):
    rows = embedding_voxels(spark, sf).select("vec_id", "z", (F.col("v") > 0.2).cast("int").alias("hit")).where("hit > 0")
    return se.crop_extent(rows, KEY, "z", "hit", 1, 4)


@query("balance_resample", None)
def balance_resample(spark, sf):
    return se.balance(fg_bg_split(spark, sf).withColumn("id", F.concat_ws(":", "vec_id", "patch_id")), "foreground", "id").select("vec_id", "patch_id", "foreground", "copy")


@query("separation_target", vox_sql("select vec_id, z, y, x, (lab = max(lab) filter (z = 2 and y = 2 and x = 2) over (partition by vec_id))::int as target from vox"))
def separation_target(spark, sf):
    from pyspark.sql import Window

    vox = embedding_voxels(spark, sf)
    centre = F.max(F.when((F.col("z") == 2) & (F.col("y") == 2) & (F.col("x") == 2), F.col("lab"))).over(Window.partitionBy("vec_id"))
    return vox.select(*POINT, (F.col("lab") == centre).cast("int").alias("target"))


@query("face_gradient", vox_sql("select vec_id, z, y, x, round(coalesce(zp - v, 0.0), 6)::double as gz, round(coalesce(yp - v, 0.0), 6)::double as gy, round(coalesce(xp - v, 0.0), 6)::double as gx from f", faces_sql("v", "f")))
def face_gradient(spark, sf):
    return st.face_gradient(embedding_voxels(spark, sf)).select(*POINT, *(r6(f"g{a}").alias(f"g{a}") for a in AT))


@query("boundary_faces", vox_sql("select vec_id, z, y, x, ((z between 1 and 2 and y between 1 and 2 and x between 1 and 2) and (zm <> lab or zp <> lab or ym <> lab or yp <> lab or xm <> lab or xp <> lab))::int as boundary from fac", FAC))
def boundary_faces(spark, sf):
    return st.boundary_faces(embedding_voxels(spark, sf), SHAPE).select(*POINT, "boundary")
