"""Queries of further formats, cropping, augmentation and corrections."""

from __future__ import annotations

import io
import tarfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import mesh as me
from ..operators import patches as pt
from ..operators import regions as rg
from ..operators import scalar as sc
from ..operators import selection as se
from ..operators import stencil as st
from ..sources import formats
from ..sources.volumes import unique_name
from ..volume import POINT, embedding_voxels, map_rows, map_volumes, read, to_voxels
from .regions import _pairs, _round_trip, _SUMS, label_blocks, recursive
from .registry import DIFFERS, FAC, INSIDE, SHAPE, query, r6, vox_sql
from .summaries import ASSD, SURF


def _through_zarr(volume):
    files = formats.encode_zarr(volume, (3, 3, 3))
    return b"".join(len(k).to_bytes(2, "big") + k.encode() + len(v).to_bytes(4, "big") + v for k, v in files.items())


def _from_zarr(data):
    import json

    files, at = {}, 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 2], "big")
        name = data[at + 2 : at + 2 + n].decode()
        m = int.from_bytes(data[at + 2 + n : at + 6 + n], "big")
        files[name] = data[at + 6 + n : at + 6 + n + m]
        at += 6 + n + m
    meta = json.loads(files.pop(".zarray"))
    out = np.zeros(meta["shape"], meta["dtype"])
    for name, raw in files.items():
        corner, part = formats.decode_zarr_chunk(meta, name, raw)
        out[tuple(slice(c, c + n) for c, n in zip(corner, part.shape))] = part
    return out


def _to_tar(volume):
    body, out = formats.encode_nrrd(volume), io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("v.nrrd")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def _from_tar(data):
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        m = t.getmembers()[0]
        return formats.decode(m.name, t.extractfile(m).read()).data


for _name, _there, _back in (
    ("mrc", lambda v: formats.encode_mrc(formats.Volume(v.data.astype("i1"), v.spacing)), lambda d: formats.decode_mrc(d).data.astype("u1")),
    ("zarr", _through_zarr, _from_zarr),
    ("tar", _to_tar, _from_tar),
    ("png_slices", lambda v: b"".join(len(p).to_bytes(4, "big") + p for p in map(formats.encode_png, v.data)), lambda d: _from_pngs(d)),
    ("bz2", lambda v: __import__("bz2").compress(formats.encode_nrrd(v)), lambda d: formats.decode("v.nrrd.bz2", d).data),
    ("zlib_raw", lambda v: zlib.compress(v.data.tobytes()), lambda d: np.frombuffer(zlib.decompress(d), "u1")),
):
    query(f"sink_scan_{_name}", _SUMS)(lambda spark, sf, there=_there, back=_back: _round_trip(spark, sf, there, back))


def _from_pngs(data):
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        out.append(formats.decode_png(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return np.stack(out)


@query("sink_mesh_stl", vox_sql("select vec_id, (2 * count(*))::bigint as n_triangles from (" + " union all ".join(f"select vec_id from (select *, coalesce({f}(gt) over (partition by vec_id, {rest} order by {a}), 0) as o from vox) where gt <> 0 and o <> gt" for a, rest in (("z", "y, x"), ("y", "z, x"), ("x", "z, y")) for f in ("lag", "lead")) + ") group by vec_id"))
def sink_mesh_stl(spark, sf):
    files = me.stl_files(me.triangles(embedding_voxels(spark, sf).select(*POINT, "gt"), label="gt"))
    return map_rows(files, "vec_id bigint, n_triangles bigint", lambda b: {"vec_id": b.column("vec_id"), "n_triangles": [len(formats.decode_stl(x)[0]) for x in b.column("content").to_pylist()]})


@query("tiff_info", vox_sql("select vec_id, 4 as nz, 4 as ny, 4 as nx, 'u1' as dtype from vox group by vec_id"))
def tiff_info(spark, sf):
    def run(batch):
        got = [formats.tiff_info(formats.encode_tiff(formats.Volume(np.asarray(batch.column("lab")[i].values).reshape(SHAPE).astype("u1")))) for i in range(batch.num_rows)]
        return {"vec_id": batch.column("vec_id"), **{k: [g[0][j] for g in got] for j, k in enumerate(("nz", "ny", "nx"))}, "dtype": [g[1] for g in got]}

    return map_rows(label_blocks(spark, sf).select("vec_id", "lab"), "vec_id bigint, nz int, ny int, nx int, dtype string", run)


@query("auto_crop", vox_sql("select vec_id, greatest(0, min(z) - 1)::int as first, least(3, max(z) + 1)::int as last from (select vec_id, z, count(*) over (partition by vec_id, run) as n from (select vec_id, z, z - row_number() over (partition by vec_id order by z) as run from (select distinct vec_id, z from vox where v > 0.2::double))) where n >= 2 group by vec_id"))
def auto_crop(spark, sf):
    vox = embedding_voxels(spark, sf).withColumn("lab", (F.col("v") > 0.2).cast("int"))
    marks = se.crop_vector(vox).where("axis = 1").withColumn("hit", (F.col("mark") > 0).cast("int"))
    kept = se.clear_short_runs(marks, ["vec_id"], "k", "hit", 2).where("hit > 0")
    return se.crop_extent(kept, ["vec_id"], "k", "hit", 1, 4)


@query("augment_flip_swap", vox_sql("select vec_id, y as z, (3 - z)::int as y, x, v from vox"))
def augment(spark, sf):
    return sc.orient(embedding_voxels(spark, sf).select(*POINT, "v"), ("y", "z", "x"), (False, True, False), SHAPE)


#: Angles about z, y and x of the turned patches.
TURN_2D, TURN_3D = (0.5, 0.0, 0.0), (0.5, 0.3, -0.7)


def _turned_sql(angles: tuple[float, float, float]) -> str:
    m = arrays.rotation(*angles)
    place = [" + ".join(f"({float(m[i, j])!r})::double * ({c} - 2)" for j, c in enumerate("zyx")) + " + 2" for i in range(3)]
    at = lambda value, kind, steps: f"{value}[1 + " + " + ".join(f"{n} * greatest(0, least(3, {kind}(s{c}) + {k}))::int" for n, c, k in zip((16, 4, 1), "zyx", steps)) + "]"
    weight = lambda c, k: f"(s{c} - floor(s{c}))" if k else f"(1 - s{c} + floor(s{c}))"
    corners = [f"{' * '.join(weight(c, k) for c, k in zip('zyx', s))} * {at('vs', 'floor', s)}" for s in np.ndindex(2, 2, 2)]
    views = ["a as (select vec_id, list(v order by z, y, x) as vs, list(lab order by z, y, x) as ls from vox group by vec_id)", f"s as (select vec_id, z, y, x, vs, ls, {', '.join(f'{e} as s{c}' for c, e in zip('zyx', place))} from vox join a using (vec_id))"]
    return vox_sql(f"select vec_id, z, y, x, round({' + '.join(corners)}, 6) as v, {at('ls', 'round', (0, 0, 0))}::int as lab from s", *views)


def _turned(spark, sf, angles):
    blocks = label_blocks(spark, sf)
    image = to_voxels(pt.augment_rotation(blocks, *angles), value="v").withColumn("v", r6("v"))
    label = to_voxels(pt.augment_rotation(blocks, *angles, column="lab", labels=True), value="lab").withColumn("lab", F.col("lab").cast("int"))
    return image.join(label, POINT)


for _name, _angles in (("augment_rotate2d", TURN_2D), ("augment_rotate3d", TURN_3D)):
    query(_name, _turned_sql(_angles))(lambda spark, sf, angles=_angles: _turned(spark, sf, angles))


@query("correct_match")
def correct_match(spark, sf):
    turn = arrays.rotation(0, 0, 0)

    def run(batch):
        cubes = [[np.asarray(batch.column(k)[i].values).reshape(SHAPE) for k in ("a", "b")] for i in range(batch.num_rows)]
        return {"id_a": batch.column("id_a"), "id_b": batch.column("id_b"), "data": [arrays.transplant(a, b, turn).ravel() for a, b in cubes]}

    return map_rows(_pairs(spark, sf).select("id_a", "id_b", "a", "b"), "id_a bigint, id_b bigint, data array<bigint>", run)


@query("boundary_training_labels", recursive(f"select f.vec_id, f.z, f.y, f.x, ({INSIDE.replace('z ', 'f.z ', 1).replace('y ', 'f.y ', 1).replace('x ', 'f.x ', 1)} and ({DIFFERS.replace('<> lab', '<> f.lab')}))::int as boundary, (coalesce(cc.size, 0) >= 3)::bigint as ignore from fac f left join cc using (vec_id, z, y, x)", "g", FAC, "g as (select vec_id, z, y, x, (v > (-0.1)::double and gt = 0)::int as lab from vox)"))
def boundary_training_labels(spark, sf):
    """Channels: the border of labels, and what of the mask belongs to components of at least three voxels outside them."""
    border = st.boundary_faces(embedding_voxels(spark, sf), SHAPE).select(*POINT, "boundary")
    rest = map_volumes(label_blocks(spark, sf), lambda m, g: arrays.at_least((m != 0) & (g == 0), 3), ("mask", "gt"), "array<bigint>")
    return border.join(to_voxels(rest, value="ignore"), POINT)


@query("unique_path", "select * from (values ('a/b.tif', 'a/b-1.tif'), ('c.nii.gz', 'c.nii.gz')) t(path, name)")
def unique_path(spark, sf):
    return spark.createDataFrame([(p, unique_name(p, {"a/b.tif"})) for p in ("a/b.tif", "c.nii.gz")], "path string, name string")


@query("sink_csv_history", "select o_orderstatus || ',' || count(*) as line from orders group by o_orderstatus")
def csv_history(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.to_csv(F.struct("o_orderstatus", "n")).alias("line"))


@query("predict_patches")
def predict_patches(spark, sf):
    """Patches through a model function, here a logistic one, and their overlaps added: the interface of external models."""
    from ..operators.patches import predict

    return predict(embedding_voxels(spark, sf), SHAPE, 2, 1, lambda cubes: np.stack([1 / (1 + np.exp(10 * cubes)), 1 / (1 + np.exp(-10 * cubes))], 1))


@query("assd_blocks", vox_sql("select vec_id, round(sum(d), 6) as total, count(*)::bigint as n, round(max(d) * max(d))::int as hausdorff2 from (select * from d1 union all select * from d2) group by vec_id", *SURF, ASSD))
def assd_blocks(spark, sf):
    blocks = label_blocks(spark, sf).withColumn("res", F.transform("data", lambda x: F.when(x > 0.05, 1.0).otherwise(0.0)))
    return rg.surface_distances(blocks, "gt", "res").withColumn("total", r6("total"))
