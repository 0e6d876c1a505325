"""Operators on hand-made volumes, and streams."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import arrays as ar
from stratavox.operators import graph, mesh, regions, selection
from stratavox.operators import stencil as sten
from stratavox.operators.aggregates import dice_global
from stratavox.operators.catalogue import search
from stratavox.operators.joins import band_join
from stratavox.volume import embedding_voxels, to_blocks, to_voxels


def volume(spark, a, vec_id=0, name="lab"):
    kind = "int" if a.dtype.kind in "iu" else "double"
    rows = [(vec_id, *map(int, p), a[tuple(p)].item()) for p in np.argwhere(np.ones(a.shape, bool))]
    return spark.createDataFrame(rows, f"vec_id bigint, z int, y int, x int, {name} {kind}")


def array(rows, shape, name):
    out = np.zeros(shape)
    for r in rows.collect():
        out[r.z, r.y, r.x] = r[name]
    return out


@pytest.mark.parametrize("edge", [2, 3, 16])
def test_components_over_blocks(spark, edge):
    a = np.random.default_rng(edge).integers(0, 3, (6, 5, 7))
    got = array(regions.components_large(volume(spark, a).where("lab <> 0"), "lab", edge), a.shape, "component")
    assert (got == ar.components(a)).all()


def test_blocks_with_halo(spark):
    a = np.arange(60.0).reshape(3, 4, 5)
    blocks = to_blocks(volume(spark, a, name="v"), edge=2, halo=1)
    seen = {(r.z0, r.y0, r.x0): (r.nz, r.ny, r.nx) for r in blocks.collect()}
    assert seen[0, 0, 0] == (3, 3, 3) and len(seen) == 2 * 2 * 3
    assert to_voxels(to_blocks(volume(spark, a, name="v"), edge=2)).exceptAll(volume(spark, a, name="v")).isEmpty()


def test_walks_do_not_depend_on_blocks(spark):
    image, labels = np.random.default_rng(1).random((4, 4, 4)) * 50, np.zeros((4, 4, 4), int)
    labels[1, 1, 1], labels[2, 3, 2] = 1, 2
    rows = [(0, 0, 0, 0, 4, 4, 4, image.ravel().tolist(), labels.ravel().astype(float).tolist(), *core) for core in ((0, 2, 0, 4, 0, 4), (2, 4, 0, 4, 0, 4))]
    schema = "vec_id bigint, z0 int, y0 int, x0 int, nz int, ny int, nx int, data array<double>, labels array<double>, c0 int, c1 int, c2 int, c3 int, c4 int, c5 int"
    two = spark.createDataFrame(rows, schema)
    one = two.limit(1).drop(*(f"c{i}" for i in range(6)))
    run = lambda b: {(r.z, r.y, r.x, r.label): r.h for r in regions.random_walk_hits(b, 3, 40).collect()}
    assert run(two) == run(one)


def test_interpolation_of_a_phantom(spark):
    z, y, x = np.indices((12, 12, 12))
    truth = np.where((z - 6) ** 2 + (y - 6) ** 2 + (x - 6) ** 2 <= 16, 2, 1)
    image = np.where(truth == 2, 200.0, 50.0) + np.random.default_rng(0).normal(0, 5, truth.shape)
    seeds = np.where(z % 4 == 2, truth, 0)
    row = [(0, 0, 0, 0, 12, 12, 12, image.ravel().tolist(), seeds.ravel().astype(float).tolist())]
    blocks = spark.createDataFrame(row, "vec_id bigint, z0 int, y0 int, x0 int, nz int, ny int, nx int, data array<double>, labels array<double>")
    got = array(regions.smart_interpolation(blocks, 4, 150), truth.shape, "label")
    both = (got == 2) & (truth == 2)
    assert 2 * both.sum() / ((got == 2).sum() + (truth == 2).sum()) > 0.9


def test_graph_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r.node: r.component for r in graph.graph_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 103: 100}
    assert graph.graph_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_band_join_is_exact(spark):
    sizes = [1, 2, 9, 10, 11, 12, 99, 100, 101, 110, 111, 5000, 5400, 5600]
    a = spark.createDataFrame([(s,) for s in sizes], "size_a bigint")
    b = spark.createDataFrame([(s,) for s in sizes], "size_b bigint")
    got = {(r.size_a, r.size_b) for r in band_join(a, b).collect()}
    assert got == {(s, t) for s in sizes for t in sizes if 0.9 * s < t < 1.1 * s}


@pytest.mark.parametrize("edge", [1, 2, 64])
def test_nearest_by_definition(spark, edge):
    """Cells of any edge find the nearest voxel and the least payload of equals; volumes without one have no row."""
    from stratavox.operators.joins import nearest

    r = np.random.default_rng(edge)
    a = [(v, *map(int, p)) for v in range(3) for p in r.integers(0, 23, (40, 3))]
    b = [(v, *map(int, p), int(r.integers(0, 5))) for v in range(2) for p in r.integers(0, 23, (6, 3))]
    got = nearest(spark.createDataFrame(a, "vec_id bigint, z int, y int, x int"), spark.createDataFrame(b, "vec_id bigint, z int, y int, x int, lab int"), "lab", edge).collect()
    want = {p: min((sum((i - j) ** 2 for i, j in zip(p[1:], q[1:4])), q[4]) for q in b if q[0] == p[0]) for p in a if p[0] < 2}
    assert {(x.vec_id, x.z, x.y, x.x): (x.d2, x.lab) for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["assd", "assd_label", "min_distance_join", "nearest_seed_join"])
def test_nearest_voxels_are_not_broadcast(name, spark, sf):
    """Spark takes exploded voxels for few rows: with its default threshold the driver would gather them."""
    from stratavox.plans import catalogue

    assert "Broadcast" not in catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_box_most_is_the_self_join(spark, sf, duck):
    """Gaps, repeated voxels and tile borders count as in the join; nothing is joined or broadcast."""
    r = np.random.default_rng(3)
    rows = [(int(r.integers(0, 2)), *map(int, r.integers(61, 67, 3)), int(r.integers(0, 9))) for _ in range(150)]
    got = sten.box_most(spark.createDataFrame(rows, "vec_id bigint, z int, y int, x int, lab int"), "lab")
    near = lambda p: [q for q in rows if q[0] == p[0] and max(abs(i - j) for i, j in zip(p[1:4], q[1:4])) <= 1]
    assert len({p[:4] for p in rows}) < len(rows)
    assert {tuple(x) for x in got.collect()} == {(*p[:4], len(near(p)) * sum(q[:4] == p[:4] for q in rows), max(q[4] for q in near(p))) for p in rows}
    from stratavox.plans import catalogue

    plan = catalogue.queries()["stencil_self_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["geodesic", "nearest"])
def test_blocks_of_one_shape_are_relaxed_at_once(name):
    """Kernels take many blocks in one call, with the same results as one by one."""
    r = np.random.default_rng(11)
    seeds, image, where = r.integers(0, 3, (40, 3, 4, 2)) * (r.random((40, 3, 4, 2)) < 0.2), r.random((40, 3, 4, 2)), r.random((40, 3, 4, 2)) < 0.7
    cost = {"geodesic": lambda a: ar.geodesic_cost(a, 0.4), "nearest": lambda a: lambda s: np.sqrt(sum(map(abs, s)))}[name]
    got = ar.propagate(seeds, cost(image), where=where)
    one = [ar.propagate(s, cost(i), where=w) for s, i, w in zip(seeds, image, where)]
    assert (got[0] == np.array([d for d, _ in one])).all() and (got[1] == np.array([l for _, l in one])).all()


def test_segments_of_one_shape_are_relaxed_at_once():
    """Labels of the nearest seed by geodesic distance: many blocks in one call give what segmenting each gives."""
    r = np.random.default_rng(12)
    seeds, image = r.integers(0, 3, (30, 4, 3, 3)) * (r.random((30, 4, 3, 3)) < 0.2), r.random((30, 4, 3, 3))
    got = ar.propagate(seeds, ar.geodesic_cost(image, 0.5))[1]
    assert all((g == ar.geodesic_segment(i, s, 0.5)).all() for g, i, s in zip(got, image, seeds))


def test_stalled_to_the_microsecond(spark):
    from stratavox.operators.catalogue import stalled

    at = ["2024-01-20 00:00:00.9", "2024-01-20 00:00:00.9000001", "2024-01-20 00:00:00.2", "2024-01-20 00:00:01.1"]
    for kind in ("timestamp_ntz", "timestamp"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "id int, t string").select("id", F.col("t").cast(kind).alias("ts"))
        got = stalled(rows, F.lit(True), "ts", F.lit("2024-01-30 00:00:00.9").cast(kind), 864000)
        assert [r.id for r in got.collect()] == [2]


def test_ranks_of_the_whole_table(spark):
    from stratavox.operators.aggregates import ranked

    rows = spark.range(0, 5000, 1, 7).withColumn("k", F.col("id") * 7919 % 5003)
    got = ranked(rows, "nth", "k").collect()
    assert [x.nth for x in sorted(got, key=lambda x: x.k)] == list(range(1, 5001))


def test_labels_lists():
    assert selection.parse_labels("ALL") is None and selection.parse_labels("none") == [] and selection.parse_labels("1, 2,") == [1, 2]
    with pytest.raises(ValueError):
        selection.parse_labels("1,x")


def test_empty_dice_is_null(spark):
    rows = spark.createDataFrame([(0, 0, 0)], "vec_id bigint, gt int, res int")
    assert dice_global(rows).first().dice is None


def test_gaussian_keeps_the_sum(spark):
    a = np.zeros((5, 5, 5))
    a[2, 2, 2] = 1
    got = array(sten.gaussian(volume(spark, a, name="v"), "v"), a.shape, "blur")
    assert np.isclose(got.sum(), 1) and got[2, 2, 2] == got.max()


def test_mesh_is_closed(spark):
    a = np.zeros((3, 3, 3), int)
    a[1, 1, 1] = 5
    t = mesh.triangles(volume(spark, a), (1.0, 2.0, 3.0))
    rows = t.collect()
    assert len(rows) == 12 and {r.attribute for r in rows} == {1}
    p = np.array([[[q.x, q.y, q.z] for q in (r.p0, r.p1, r.p2)] for r in rows])
    volume_of = np.einsum("ij,ij->i", p[:, 0], np.cross(p[:, 1], p[:, 2])).sum() / 6
    assert np.isclose(volume_of, 6.0)
    assert len(bytes(mesh.stl_files(t).first().content)) == 84 + 12 * 50


def test_search_escapes(spark):
    rows = spark.createDataFrame([("a%b",), ("axb",)], "name string")
    assert [r.name for r in search(rows, "A%B", ["name"], "name").collect()] == ["a%b"]


def test_one_shuffle_for_all_stencils(spark, sf):
    rows = sten.with_faces(embedding_voxels(spark, sf).select("vec_id", "z", "y", "x", "lab"), "lab")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [[c.split("#")[0].strip() for c in x.split(", ")] for x in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan.split("== Initial Plan ==")[-1])]


def test_no_shuffle_by_volume_alone(spark, sf):
    rows = embedding_voxels(spark, sf).select("vec_id", "z", "y", "x", "lab", "v")
    for df in (sten.with_faces(rows, "lab"), sten.face_gradient(rows), sten.central_gradient(rows, "v"), sten.box_mean(rows), sten.gaussian(rows, "v"), mesh.surface_quads(rows)):
        found = exchanges(df)
        assert found and all(len(keys) > 2 for keys in found), found


@pytest.mark.parametrize("edge", [2, 3])
def test_stencils_over_tiles(spark, edge, monkeypatch):
    """Tiles of 2 and 3 voxels give what one tile gives."""
    from stratavox import volume as vol

    a = np.random.default_rng(2).integers(0, 3, (5, 4, 7))
    rows = volume(spark, a).withColumn("v", F.col("lab").cast("double"))
    runs = lambda: [sorted(map(tuple, f(rows).collect())) for f in (lambda r: sten.gradient_faces(r), lambda r: sten.box_mean(r).withColumn("smooth", F.round("smooth", 9)), lambda r: sten.face_gradient(r), lambda r: sten.surface(r.withColumn("m", (F.col("lab") > 1).cast("int")), "m"), lambda r: mesh.surface_quads(r))]
    want = runs()
    monkeypatch.setattr(vol.by_tile, "__defaults__", (1, edge))
    assert runs() == want


def test_gaussian_by_definition(spark):
    a = np.random.default_rng(4).random((3, 11, 6))
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    want = a
    for axis in range(3):
        pad = np.pad(want, [(4, 4) if i == axis else (0, 0) for i in range(3)], mode="symmetric")
        want = sum(w * np.take(pad, range(j, j + a.shape[axis]), axis) for j, w in enumerate(k / k.sum()))
    assert np.allclose(array(sten.gaussian(volume(spark, a, name="v"), "v"), a.shape, "blur"), want)


def whole_block(spark, **columns):
    shape = next(iter(columns.values())).shape
    fields = ", ".join(f"{c} array<double>" for c in columns)
    row = [(0, 0, 0, 0, *shape, *(a.ravel().astype(float).tolist() for a in columns.values()))]
    return spark.createDataFrame(row, f"vec_id bigint, z0 int, y0 int, x0 int, nz int, ny int, nx int, {fields}")


REGIONS = {
    "components": lambda b, e: regions.components(b, "lab", e), "clean": lambda b, e: regions.clean(b, 0.3, "lab", e), "fill": lambda b, e: regions.fill(b, 0.5, "lab", e), "largest": lambda b, e: regions.clean_fast(b, "mask", e),
    "fill_all": lambda b, e: regions.fill_fast(b, "mask", e), "at_least": lambda b, e: regions.at_least(b, 4, "mask", e), "cleaned_filled": lambda b, e: regions.cleaned_filled(b, 0.3, "lab", e), "chamfer": lambda b, e: regions.chamfer(b, "seeds", edge=e),
    "geodesic": lambda b, e: regions.geodesic(b, 0.5, edge=e), "segment": lambda b, e: regions.geodesic_segment(b, 0.5, edge=e), "nearest": lambda b, e: regions.nearest_label(b, edge=e),
}


@pytest.mark.parametrize("name", REGIONS)
def test_regions_over_blocks(spark, name):
    """Volumes cut into blocks of 2 and 3 voxels give what whole ones give; without an edge cut volumes raise."""
    from stratavox.operators import tiled

    r = np.random.default_rng(11)
    lab = np.where(r.random((4, 5, 7)) < 0.75, r.integers(1, 3, (4, 5, 7)), 0)
    lab[1:4, 1:4, 1:4] = 1
    lab[2, 2, 2] = 0
    mask = (r.random(lab.shape) < 0.7).astype(int)
    seeds = np.where(r.random(lab.shape) < 0.04, r.integers(1, 3, lab.shape), 0)
    seeds[0, 0, 0] = 1
    blocks = whole_block(spark, lab=lab, mask=mask, seeds=seeds, data=r.random(lab.shape) * 3)
    run = lambda b, e: array(to_voxels(REGIONS[name](b, e), value="v"), lab.shape, "v")
    want = run(blocks, None)
    for edge in (2, 3):
        assert np.allclose(run(blocks, edge), want), edge
    with pytest.raises(Exception, match="whole volumes"):
        run(tiled.cut(blocks, 3, ("lab", "mask", "seeds", "data")), None)


def test_streams(spark, tmp_path):
    from stratavox.streaming import jobs

    rows = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "run", i, 1.0) for i, h in enumerate((1, 1, 2))], "ts string, event_type string, user_id bigint, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, out in (("counts", jobs.job_counts(stream)), ("sessions", jobs.sessions(stream))):
        q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "counts")).agg(F.sum("n")).first()[0] == 2
    assert sorted(r.n for r in jobs.job_counts(rows).collect()) == [1, 2]


def test_rotation_queries_use_all_passes(spark, monkeypatch):
    """Both queries find a turn by 30 degrees, which no grid of 90 or 45 degrees holds."""
    from stratavox.functions import arrays
    from stratavox.plans import regions as plans

    a = np.random.default_rng(7).random((4, 4, 4)) < 0.5
    b = arrays.rotate_mask(a, arrays.rotation(np.radians(30), 0, 0))
    assert arrays.search_rotation(a, b, 90.0, (45.0,))[0] < 0.9
    pair = spark.createDataFrame([(0, 1, a.ravel().astype(float).tolist(), b.ravel().astype(float).tolist())], "id_a bigint, id_b bigint, a array<double>, b array<double>")
    monkeypatch.setattr(plans, "_pairs", lambda *_: pair)
    assert plans.rotation_grid_search(spark, "").first().dice == 1
    assert plans.rotation_dice(spark, "").first().dice == 1


def test_walk_queries_reach_every_voxel(spark, sf):
    """Every voxel of a volume with seeds is hit and labelled, and hits are those of 10 walks of 4000 steps a seed."""
    from pyspark.sql import functions as F
    from stratavox.functions import arrays
    from stratavox.plans import regions as plans

    seeded = plans.label_blocks(spark, sf).where("vec_id < 100").where(F.exists("seeds", lambda x: x > 0)).select("vec_id", "data", "seeds").collect()
    got = {}
    for r in plans.random_walk_hits(spark, sf).where("vec_id < 100").collect():
        got.setdefault(r.vec_id, {})[r.z, r.y, r.x, r.label] = r.h
    for r in seeded[:3]:
        image, seeds = (np.array(c).reshape(4, 4, 4) for c in (r.data, r.seeds))
        for k in np.unique(seeds[seeds > 0]):
            h = arrays.random_walks(image, seeds, int(k), 10, 4000)
            assert all(got[r.vec_id].get((*at, int(k)), 0) == n for at, n in np.ndenumerate(h))
    labelled = plans.smart_interpolation(spark, sf).where("vec_id < 100").groupBy("vec_id").count().collect()
    assert len(seeded) > 50 and {r.vec_id: r["count"] for r in labelled} == {r.vec_id: 64 for r in seeded}


def test_shells_are_not_broadcast(spark, monkeypatch):
    """Spark takes shells for few rows: with its default threshold the driver would gather them."""
    from stratavox.operators import tiled

    plans, real = [], tiled.written
    monkeypatch.setattr(tiled, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    seeds = np.zeros((4, 4, 4))
    seeds[0, 0, 0] = 1
    regions.chamfer(whole_block(spark, seeds=seeds), "seeds", edge=2).collect()
    assert len(plans) > 2 and all("Broadcast" not in p for p in plans)


def shells_told(spark, monkeypatch, query, **columns):
    """What a query on one whole volume gives by blocks of two, and the origins of the blocks that were told something, by round."""
    from stratavox.operators import tiled

    told, real = [], tiled._shells
    monkeypatch.setattr(tiled, "_shells", lambda *a: told.append([(r.z0, r.y0, r.x0) for r in real(*a).select("z0", "y0", "x0").collect()]) or real(*a))
    shape = next(iter(columns.values())).shape
    return array(to_voxels(query(whole_block(spark, **columns), 2), value="v"), shape, "v"), told


def test_nearest_blocks_tell_those_they_may_better(spark, monkeypatch):
    """The seed's block tells the seven others, these each other but not the seed's block, and all is settled."""
    seeds = np.zeros((4, 4, 4))
    seeds[0, 0, 0] = 2
    got, told = shells_told(spark, monkeypatch, REGIONS["nearest"], seeds=seeds, mask=np.ones(seeds.shape))
    assert (got == 2).all() and [len(t) for t in told] == [7, 42] and (0, 0, 0) not in told[0] + told[1]


def test_rims_are_read_and_not_relaxed():
    """Blocks with a rim of told distances: the same as relaxing the rim along and holding it."""
    r = np.random.default_rng(13)
    shape = (50, 5, 4, 6)
    lab, image, where = r.integers(1, 4, shape) * (r.random(shape) < 0.3), r.random(shape), np.zeros(shape, bool)
    core = (slice(None), *[slice(1, -1)] * 3)
    where[core] = r.random(where[core].shape) < 0.8
    start = np.where(lab != 0, r.random(shape), np.inf)
    for lam, cost in ((None, lambda s: np.sqrt(sum(map(abs, s)))), (0.4, ar.geodesic_cost(image, 0.4))):
        want = ar.propagate(lab, cost, where=where, start=start)
        dist, got = start.copy(), lab.copy()
        ar.relax_inside(dist, got, where[core], image, lam)
        assert np.allclose(dist, want[0]) and (got == want[1]).all()


def test_segments_without_seeds_tell_nothing(spark, monkeypatch):
    got, told = shells_told(spark, monkeypatch, REGIONS["segment"], seeds=np.zeros((4, 4, 4)), data=np.ones((4, 4, 4)))
    assert (got == 0).all() and not told


def test_chamfer_shells_stay_in_the_volume(spark, monkeypatch):
    """No shell is made for a block that does not exist, also where a volume ends at a multiple of the edge."""
    got, told = shells_told(spark, monkeypatch, REGIONS["chamfer"], seeds=np.ones((4, 4, 4)))
    assert (got == 0).all() and len(told) == 1 and len(told[0]) == 56 and set(told[0]) == {(z, y, x) for z in (0, 2) for y in (0, 2) for x in (0, 2)}
