"""Volume formats: round trips, broken input, files by way of Spark."""

import io
import tarfile
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox.sources import formats as fm
from stratavox.sources import volumes as vo
from stratavox.volume import embedding_blocks, to_blocks, to_voxels

R = np.random.default_rng(3)
TYPES = {".am": ("u1", "i2", "u2", "i4", "f4", "f8"), ".nrrd": ("u1", "i2", "u4", "f4", "f8"), ".mha": ("u1", "i2", "f4", "i8"), ".nii": ("u1", "i2", "f4"), ".nii.gz": ("u2",), ".tif": ("u1", "u2", "i4", "f4", "f8"), ".mrc": ("i1", "i2", "f4", "u2"), ".npy": ("u1", "f8"), ".nc": ("u1", "i1", "i2", "i4", "f4", "f8")}


@pytest.mark.parametrize("kind, dtype", [(k, t) for k, ts in TYPES.items() for t in ts])
def test_round_trip(kind, dtype):
    a = (R.random((3, 5, 7)) * 100).astype(dtype)
    got = fm.decode(f"x{kind}", fm.ENCODERS[kind](fm.Volume(a, (0.5, 1.0, 2.0))))
    assert got.data.shape == a.shape and (got.data == a).all()
    if kind not in (".tif", ".npy"):
        assert np.allclose(got.spacing, (0.5, 1.0, 2.0))


@pytest.mark.parametrize("encoding", ["HxByteRLE", ""])
def test_amira_data_that_begin_like_white_space(encoding):
    """The data begin right behind the line of their mark, whatever bytes they begin with: a first run of 10 is a line feed."""
    for first in range(1, 65):
        a = np.r_[np.full(first, 3), np.arange(64 - first) % 2].astype("u1").reshape(4, 4, 4)
        a = a if encoding else np.where(a == 3, first, 10).astype("u1")
        assert (fm.decode_amira(fm.encode_amira(fm.Volume(a, (1.0, 2.0, 1.5)), encoding))[0].data == a).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 300)), max_size=20))
def test_rle(runs):
    data = b"".join(bytes([v]) * n for v, n in runs)
    assert fm.rle_decode(fm.rle_encode(data), len(data)) == data


def test_rle_cut_short():
    with pytest.raises(ValueError):
        fm.rle_decode(b"\x05", 9)


def test_amira_ascii_and_header():
    text = b"# AmiraMesh 3D ASCII 2.0\n\ndefine Lattice 2 2 1\n\nParameters {\n BoundingBox 0 1 0 3 0 1,\n}\n\nLattice { float Data } @1\n\n@1\n1 2.5\n3 4\n"
    got = fm.decode_amira(text)[0]
    assert got.data.tolist() == [[[1.0, 2.5], [3.0, 4.0]]] and got.spacing == (1.0, 3.0, 1.0)
    new = fm.rewrite_amira_header(got.header["amira"], (5, 6, 7), (1, 1, 2))
    assert "define Lattice 7 6 5" in new and "BoundingBox 0 6 0 5 0 8" in new


def test_amira_tree():
    text = """# AmiraMesh BINARY-LITTLE-ENDIAN 2.1
define Lattice 4 3 2
define Points 7
Parameters {
    Materials {
        Exterior { Id 1 }
        "Left lobe" {
            Color 0.8 0.25 1,
            Id 2
        }
    }
    Content "4x3x2 byte, uniform coordinates",
    BoundingBox 0 3 0 2 0 1,
    CoordType "uniform"
}
Lattice { byte Labels } @1
"""
    got = fm.parse_amira_tree(text)
    assert got["define"] == {"Lattice": [4, 3, 2], "Points": [7]}
    assert got["Parameters"]["Materials"] == {"Exterior": {"Id": 1}, "Left lobe": {"Color": [0.8, 0.25, 1], "Id": 2}}
    assert got["Parameters"]["BoundingBox"] == [0, 3, 0, 2, 0, 1] and got["Parameters"]["CoordType"] == "uniform"
    assert fm.parse_amira_tree(fm.encode_amira(fm.Volume(np.zeros((2, 3, 4), "u1"))).split(b"\n@1\n")[0].decode())["define"]["Lattice"] == [4, 3, 2]


def test_netcdf_golden_bytes():
    """A file put together by hand after the classic format's grammar, version 1: a 1-D variable, then one of three axes."""
    name = lambda s: len(s).to_bytes(4, "big") + s.encode() + b"\0" * (-len(s) % 4)
    n = lambda *v: b"".join(x.to_bytes(4, "big") for x in v)
    head = b"CDF\x01" + n(0) + n(10, 3) + name("zdim") + n(2) + name("y") + n(1) + name("x") + n(3) + n(12, 1) + name("title") + n(2, 2) + b"ab\0\0"
    first = name("x") + n(1, 2) + n(0, 0) + n(5, 12)
    second = name("tomo") + n(3, 0, 1, 2) + n(0, 0) + n(3, 12)
    start = len(head) + 8 + len(first) + 4 + len(second) + 4
    data = head + n(11, 2) + first + n(start) + second + n(start + 12) + np.array([1, 2, 3], ">f4").tobytes() + np.array([1, -2, 3, 4, 5, 600], ">i2").tobytes()
    got = fm.decode("scan.nc", data)
    assert got.data.tolist() == [[[1, -2, 3]], [[4, 5, 600]]] and got.header == {"name": "tomo"}


def test_golden_pairs():
    head = b"ObjectType = Image\nNDims = 3\nBinaryData = True\nBinaryDataByteOrderMSB = True\nDimSize = 3 1 2\nElementSpacing = 1 2 3\nElementType = MET_SHORT\nElementDataFile = a.raw\n"
    got = fm.decode_mhd(head, np.array([1, -2, 3, 4, 5, 600], ">i2").tobytes())
    assert got.data.tolist() == [[[1, -2, 3]], [[4, 5, 600]]] and got.spacing == (1.0, 2.0, 3.0)
    a = (R.random((2, 3, 4)) * 100).astype("i2")
    head, body = fm.encode_nifti_pair(fm.Volume(a))
    assert head[344:348] == b"ni1\0" and len(head) == 348 and body == a.tobytes()
    assert (fm.decode_nifti_pair(head, body).data == a).all()


def test_pairs_meet_and_lone_headers_raise(spark, tmp_path):
    a = (R.random((3, 4, 5)) * 100).astype("u1")
    for kind, (head, body) in ((".mhd", fm.encode_mhd(fm.Volume(a), "v.raw")), (".hdr", fm.encode_nifti_pair(fm.Volume(a)))):
        folder = tmp_path / kind[1:]
        folder.mkdir()
        (folder / f"v{kind}").write_bytes(head)
        with pytest.raises(Exception, match="no body beside it"):
            vo.read_volumes(spark, f"file://{folder}").collect()
        (folder / f"v{fm.PAIRS[kind][0][0]}").write_bytes(body)
        rows = vo.read_volumes(spark, f"file://{folder}").collect()
        assert len(rows) == 1 and rows[0].data == a.ravel().tolist()


def test_other_stores_are_not_written_as_local_files(spark):
    with pytest.raises(ValueError, match="mounted"):
        vo.write_files(spark.createDataFrame([("a", bytearray(b"x"))], "n string, content binary"), "hdfs://host/a", F.col("n"))


@pytest.mark.parametrize("kind", list(fm.DECODERS))
def test_rejects(kind):
    with pytest.raises(Exception):
        fm.DECODERS[kind](b"nothing of the kind" * 40)


def test_unknown_ending():
    with pytest.raises(ValueError):
        fm.decode("x.docx", b"")


def test_png_and_stl():
    grey, colour = R.integers(0, 255, (5, 6), dtype=np.uint8), R.integers(0, 255, (4, 3, 3), dtype=np.uint8)
    assert (fm.decode_png(fm.encode_png(grey)) == grey).all() and (fm.decode_png(fm.encode_png(colour)) == colour).all()
    t = R.random((10, 3, 3)).astype("f4")
    p, a = fm.decode_stl(fm.encode_stl(t, np.arange(10)))
    assert (p == t).all() and a.tolist() == list(range(10))


def test_tiff_pages_and_info():
    a = R.integers(0, 9, (6, 4, 5)).astype("u2")
    data = fm.encode_tiff(fm.Volume(a))
    assert fm.tiff_info(data) == ((6, 4, 5), "u2") and (fm.decode_tiff(data, 2, 4).data == a[2:4]).all()


def test_files_by_spark(spark, tmp_path):
    a = R.integers(0, 9, (6, 5, 4)).astype("u1")
    for name, kind in (("a", ".nrrd"), ("b", ".tif"), ("c", ".am")):
        (tmp_path / f"{name}{kind}").write_bytes(fm.ENCODERS[kind](fm.Volume(a)))
    rows = vo.read_volumes(spark, str(tmp_path), edge=3)
    assert rows.count() == 3 * 2 * 2 * 2
    total = {r[0][-1]: r[1] for r in rows.select(F.regexp_extract("path", r"(.)\.\w+$", 1).alias("n"), F.aggregate("data", F.lit(0.0), lambda s, v: s + v).alias("t")).groupBy("n").agg(F.sum("t")).collect()}
    assert total == {k: float(a.sum()) for k in "abc"}
    part = vo.read_volumes(spark, str(tmp_path / "b.tif"), 64, (1, 3)).collect()
    assert [(r.z0, r.nz) for r in part] == [(1, 2)] and np.array_equal(np.array(part[0].data).reshape(2, 5, 4), a[1:3])
    info = vo.volume_info(spark, str(tmp_path)).collect()
    assert [(r.nz, r.ny, r.nx, r.dtype) for r in info] == [(6, 5, 4, "u1")]


def test_archives_and_slices(spark, tmp_path):
    a = R.integers(0, 9, (2, 3, 4)).astype("u1")
    body = fm.encode_nrrd(fm.Volume(a))
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        info = tarfile.TarInfo("in/v.nrrd")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("v.nrrd", body)
    for name in ("x.tar", "y.zip"):
        assert np.array_equal(vo.read_tar(spark, str(tmp_path / name)).first().data, a.ravel())
    folder = tmp_path / "slices"
    folder.mkdir()
    for i in (1, 2, 10):
        (folder / f"s{i}.png").write_bytes(fm.encode_png(np.full((2, 2), i, np.uint8)))
    rows = vo.read_slices(spark, str(folder)).orderBy("z").collect()
    assert [r.data[0] for r in rows] == [1, 2, 10]


def test_writers(spark, sf, tmp_path):
    blocks = embedding_blocks(spark, sf).where("vec_id < 3").withColumn("data", F.transform("data", lambda v: F.floor(v * 50 + 100).cast("double")))
    vo.write_volumes(blocks, str(tmp_path / "v"), ".nrrd")
    back = to_voxels(vo.read_volumes(spark, str(tmp_path / "v")).withColumn("vec_id", F.regexp_extract("path", r"(\d+)\.nrrd", 1).cast("bigint")))
    assert back.exceptAll(to_voxels(blocks)).isEmpty() and back.count() == 192
    one = to_blocks(to_voxels(blocks).where("vec_id = 1"), edge=2)
    vo.write_zarr(one, str(tmp_path / "z7"), (4, 4, 4), 2)
    got = to_voxels(vo.read_zarr(spark, str(tmp_path / "z7")).withColumn("vec_id", F.lit(1).cast("bigint")))
    assert got.exceptAll(to_voxels(blocks).where("vec_id = 1")).isEmpty()
    vo.write_slices(blocks, str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("*/*.png"))) == 12


def test_names():
    assert vo.unique_name("a/b.tif", {"a/b.tif", "a/b-1.tif"}) == "a/b-2.tif"
    assert len(vo.unique_name("x" * 200 + ".nii.gz", set())) == 107
