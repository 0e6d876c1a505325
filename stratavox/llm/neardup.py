"""Near-duplicate groups by HyperMinHash registers.

A document's set of word shingles is hashed into buckets; each bucket's register keeps the leading
zeros of its least hash and the mantissa bits after them, 16 bits in all.  So that every register of
a small set is filled, each shingle enters with 2**k hashes, k by size class; the Jaccard similarity
of such expanded sets is that of the sets.  Documents near the edge of a size class get a sketch in
the next class too, so any two similar documents share a class.  Bands of five registers give
candidate groups, a collision-corrected estimate drops what is far below the threshold, and full sets
decide: with 40 bands a pair at similarity 0.8 goes unseen with probability 1e-7.

Equal sets are one class from the start, so exact copies cost nothing further.  A candidate group is
never expanded into its pairs: its members are compared with its hub, the member that meets most
others, and components are made.  Members of hubs that then still lie in several components are looked
at again, by the differences to their hub: two of them can only be similar if their differences meet
in their rarest elements, which finds every link that is left and skips what a group has in common.

Edge cases, all defined: a null or empty text, or one of white space, has no shingles and links with
nothing; a text of fewer words than a shingle is one shingle; rows with equal doc_id count as one
document; a null doc_id links with nothing, has a null component and is kept; an empty table gives an
empty result; other columns are not read (``keep_first`` carries them along).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .components import components
from .substrings import M1, window_hashes, word_hashes

BANDS, BAND_ROWS = 40, 5
BUCKETS = BANDS * BAND_ROWS
MANTISSA = 10
EMPTY = -1
#: Expanded elements that a sketch has at least, so that a bucket is empty once in 300,000 times.
FULL = BUCKETS * 12
#: Marks of nodes at most, 8 MB of bits, and how many of them are put together in one row.
MARKS, BLOCK = 1 << 26, 1 << 15


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z are lower-cased."""
    words = word_hashes((text or "").encode("utf-8", "replace").lower().split())
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return window_hashes(words, len(words), M1) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, width, M1))


def size_classes(n: int, threshold: float) -> list[int]:
    """The class k of a set of n (it enters with 2**k hashes), and the next one if a larger partner may be there."""
    def k(x: float) -> int:
        return max(0, int(np.ceil(np.log2(FULL / x))))

    return sorted({k(n), k(n / threshold)})


def registers(hashes: np.ndarray, k: int) -> np.ndarray:
    """HyperMinHash registers of a set in size class k, as signed 16-bit numbers; -1 where a bucket is empty."""
    step = np.arange(1 << k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (hashes[:, None] + step[None, :]).ravel()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bucket = ((x >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    value = ((x * np.uint64(BUCKETS)) >> np.uint64(11)).astype(np.int64)  # 53 bits of the place in the bucket
    least = np.full(BUCKETS, 1 << 53, np.int64)
    np.minimum.at(least, bucket.astype(np.int64), value)
    empty = least == 1 << 53
    least = np.maximum(least, 1)
    length = np.frexp(least.astype(np.float64))[1]
    zeros = 53 - length
    mantissa = np.where(length > MANTISSA, least >> np.maximum(length - 1 - MANTISSA, 0), least << np.maximum(MANTISSA + 1 - length, 0)) & ((1 << MANTISSA) - 1)
    out = np.minimum(zeros, 31) << MANTISSA | mantissa
    return np.where(empty, EMPTY, out).astype(np.int16)


def features(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the set's hash) and the sketches of every row."""

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            sizes, ids, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sketches.append([{"k": k, "registers": registers(found, k)} for k in size_classes(len(found), threshold)] if len(found) else None)
            return {"doc_id": batch.column("doc_id"), "n_shingles": sizes, "set_id": ids, "sketches": sketches}

        return kernel

    return map_batches(docs.select("doc_id", "text"), "doc_id bigint, n_shingles bigint, set_id binary, sketches array<struct<k: int, registers: array<smallint>>>", make)


def band_groups(classes: DataFrame) -> DataFrame:
    """(key, nid, n, members) of band groups with at least two classes; stored."""
    sketch = classes.select("nid", "n", F.explode("sketches").alias("s"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.col("s.k"), b, F.slice(F.col("s.registers"), b * BAND_ROWS + 1, BAND_ROWS)))
    keys = sketch.select("nid", "n", F.explode(bands).alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return stored(keys.join(several.select(F.col("key").alias("again"), "members"), F.col("key") == F.col("again")).select("key", "nid", "n", "members"), "bands")


def estimate(a: str, b: str, na: str, nb: str, k: str):
    """Jaccard estimate from two register arrays, corrected for registers that agree by chance."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(None)).otherwise((x == y).cast("int")))
    both = F.filter(both, lambda x: x.isNotNull())
    share = F.aggregate(both, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(both), F.lit(1))

    def at(n: str, z):
        load = F.col(n) * F.pow(F.lit(2.0), F.col(k)) / BUCKETS
        return F.exp(-load * F.pow(F.lit(2.0), -z - 1)) - F.exp(-load * F.pow(F.lit(2.0), -z))

    chance = F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(0.0), lambda s, z: s + at(na, z) * at(nb, z)) / (1 << MANTISSA)
    return (share - chance) / (1 - chance)


def node_marks(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of marks and a bit for each: set where the hash of a node falls; at most ``MARKS`` bits come to the driver.

    There are 32 to 64 marks a node as long as ``MARKS`` allows it, so 2 or 3 other documents in 100 fall on a node's mark.
    """
    marks = min(MARKS, max(BLOCK, 1 << (32 * max(1, nodes.count()) - 1).bit_length()))
    at = nodes.select(F.pmod(F.xxhash64("nid"), F.lit(marks)).alias("mark")).withColumn("block", F.expr(f"mark div {BLOCK}")).repartition("block")
    bits = np.zeros((marks // BLOCK, BLOCK // 8), np.uint8)
    for block, found in at.groupBy("block").agg(F.bitmap_construct_agg(F.col("mark") % BLOCK)).collect():
        bits[block] = np.frombuffer(found, np.uint8)
    return marks, bits.ravel()


def set_table(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(nid, set) of the documents that some band group holds, and of the few whose id falls on a mark of one; stored.

    No text is shuffled or sorted: most texts are in no group, and marks tell that where they are read.
    What joins the table asks for nodes only, so sets of other documents are never met.
    """
    marks, bits = node_marks(nodes)

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            at = batch.column("mark").to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)))
            return {"nid": batch.column("nid"), "set": [shingle_set(t, width).view(np.int64) for t in batch.column("text").to_pylist()]}

        return kernel

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("nid"), "text")
    return stored(map_batches(rows.withColumn("mark", F.pmod(F.xxhash64("nid"), F.lit(marks))), "nid bigint, set array<bigint>", make), "sets")


def confirm(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, slack: float) -> DataFrame:
    """Of (a, b) the links whose full sets reach the threshold; estimates far below it spare the reading of sets.

    The estimate from 200 registers deviates by 0.028 at similarity 0.8, so ``slack`` is six deviations.
    """
    one = lambda c: sketches.select(F.col("nid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketches").alias(f"s_{c}"))
    near = pairs.join(one("a"), "a").join(one("b"), "b")
    # of a class that both have a sketch in; two similar texts have one
    near = near.withColumn("x", F.try_element_at(F.filter("s_a", lambda x: F.exists("s_b", lambda y: y["k"] == x["k"])), F.lit(1))).where("x is not null")
    near = near.withColumn("y", F.element_at(F.filter("s_b", lambda y: y["k"] == F.col("x.k")), 1))
    near = near.where(estimate("x.registers", "y.registers", "n_a", "n_b", "x.k") >= percent / 100 - slack).select("a", "b").distinct()
    full = lambda c: sets.select(F.col("nid").alias(c), F.col("set").alias(f"s_{c}"))
    both = near.join(full("a"), "a").join(full("b"), "b")
    # row by row in the JVM: no batch of long sets is built anywhere
    both = both.select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).alias("shared"))
    return both.where(f"100L * shared >= {percent} * (n_a + n_b - shared)").select("a", "b")


def differences(star: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, nid, label, n, n_hub, added, gone): what each member has beyond its hub and what it lacks; stored.

    Full sets are read once, here; everything after works on these short rows.
    """
    own = star.join(sets.select("nid", F.col("set").alias("own")), "nid")
    both = own.join(sets.select(F.col("nid").alias("hub"), F.col("set").alias("other")), "hub")
    sizes = [F.size("own").cast("bigint").alias("n"), F.size("other").cast("bigint").alias("n_hub")]
    return stored(both.select("hub", "nid", "label", *sizes, F.array_except("own", "other").alias("added"), F.array_except("other", "own").alias("gone")), "differences")


def rare_pairs(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of members of one hub with different labels that can reach the threshold.

    ``star`` has hub, nid and label.  Let D be the difference of a member's set to its hub's.  Two members
    of which one is not linked with the hub can reach similarity t only if their differences share
    enough, and then they meet among the first elements of each in any common order: about half of D
    where the other one is not linked, (1 - t) n / t + 1 elements where the other one is.  What the hub
    lacks comes first, rare shingles before common ones, so changes of a text's own meet nothing.
    Shingles that no other member has, and the sizes, bound what two differences share from above.
    An element whose members all have one label can link nothing new and is left out of the join.
    """
    full = differences(star, sets)
    rows = full.select("hub", "nid", "label", F.explode("added").alias("element"))
    often = rows.groupBy("hub", "element").agg(F.count("*").cast("int").alias("often")).where("often > 1")
    common = rows.join(often, ["hub", "element"]).groupBy("hub", "nid").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("common"))
    full = full.select("hub", "nid", "label", "n", "n_hub", F.size("added").cast("bigint").alias("n_added"), "gone").join(common, ["hub", "nid"], "left")
    full = full.withColumn("common", F.coalesce(F.col("common.element"), F.array().cast("array<bigint>")))  # rare ones first
    full = full.withColumns({"more": F.size("common").cast("bigint"), "less": F.size("gone").cast("bigint")}).withColumn("alone", F.col("n_added") - F.col("more"))
    full = full.withColumns({"d": F.expr("more + alone + less"), "linked": F.expr(f"100 * (n - more - alone) >= {percent} * (n + less)")})
    # what D shares at least with that of a similar member, if the one or the other is not linked
    least = F.greatest(F.lit(1), F.ceil((F.col("d") * (100 + percent) - (100 - percent) * (F.col("n") - F.col("n_hub"))) / F.lit(2.0 * (100 + percent))))
    full = full.withColumn("short", F.col("d") - least + 1)
    room = F.when(F.col("linked"), F.col("short")).otherwise(F.greatest("short", F.least(F.col("d"), F.expr(f"n * {100 - percent} div {percent} + 1"))))
    # shingles of no other member come first and meet nothing
    first = F.slice(F.concat("common", "gone"), F.lit(1), F.greatest(F.lit(0), room - F.col("alone")).cast("int"))
    full = full.select("hub", "nid", "label", "n", "d", "more", "less", "linked", F.greatest(F.lit(0), F.col("short") - F.col("alone")).alias("narrow"), F.posexplode(first).alias("k", "element"))
    first = stored(full.withColumn("wide", F.col("k") >= F.col("narrow")).drop("k", "narrow"), "prefixes")
    # elements at which two components meet; the others can add no link
    between = first.groupBy("hub", "element").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("hub", "element")
    first = stored(first.join(between, ["hub", "element"]), "meeting")
    one = lambda c: first.select(F.col("hub").alias(f"h_{c}"), F.col("nid").alias(c), F.col("label").alias(f"l_{c}"), F.col("n").alias(f"n_{c}"), F.col("element").alias(f"e_{c}"), *(F.col(x).alias(f"{x}_{c}") for x in ("d", "more", "less", "linked", "wide")))
    # what two differences can share at most, against what similarity t needs them to share
    enough = f"{2 * (100 + percent)} * (least(more_a, more_b) + least(less_a, less_b)) >= {100 + percent} * (d_a + d_b) - {100 - percent} * (n_a + n_b)"
    meets = f"(linked_a or linked_b or not (wide_a or wide_b)) and {enough} and h_a = h_b and e_a = e_b and l_a <> l_b and a > b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    return one("a").join(one("b"), F.expr(meets)).select("a", "b").distinct()


def link_labels(docs: DataFrame, classes: DataFrame, width: int, percent: int, slack: float) -> DataFrame | None:
    """(node, label) of every class that is linked with another one; None if there is no candidate."""
    groups = band_groups(classes)
    if groups.isEmpty():
        return None
    nodes = groups.select("nid").distinct()
    sketches = stored(classes.join(nodes, "nid", "left_semi").select("nid", "n", "sketches"), "sketches")
    sets = set_table(docs, nodes, width)
    # the hub of a group is the member that meets most others over all its groups: the original of a family
    score = groups.groupBy("nid").agg(F.sum("members").alias("score"))
    hub = groups.join(score, "nid").groupBy("key").agg(F.max_by(F.struct("nid", "n"), F.struct(F.col("score"), -F.col("nid"))).alias("h"))
    hub = hub.select(F.col("key").alias("hub_key"), F.col("h.nid").alias("hub"), F.col("h.n").alias("hub_n"))
    star = groups.join(hub, F.col("key") == F.col("hub_key")).where("nid <> hub").select("nid", "n", "hub", "hub_n").distinct()
    star = stored(star, "star")
    pair = [F.greatest("nid", "hub").alias("a"), F.least("nid", "hub").alias("b")]
    tried = star.where(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(*pair).distinct()
    links = stored(confirm(tried, sketches, sets, percent, slack), "confirmed")
    labels = stored(components(links), "labels")
    tagged = star.select("nid", "hub").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    still = tagged.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("hub").alias("open_hub"))
    star = stored(tagged.join(still, F.col("hub") == F.col("open_hub")).select("hub", "nid", "label"), "star")
    if star.isEmpty():
        return labels
    new = stored(rare_pairs(star, sets, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = stored(confirm(new, sketches, sets, percent, slack), "confirmed")
    return labels if more.isEmpty() else components(links.unionByName(more))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, slack: float = 0.17) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (one document of a component)."""
    rows = stored(features(docs, width, percent / 100), "features")
    classes = rows.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("nid"), F.first("n_shingles").alias("n"), F.first("sketches").alias("sketches"))
    classes = stored(classes, "classes")
    # rows of one doc_id are one document, so its classes belong together
    shared = rows.where("set_id is not null and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("set_id").alias("sets")).where("sets > 1").select("doc_id")
    ids = classes.select("set_id", "nid")
    if not shared.isEmpty():
        extra = rows.where("set_id is not null").join(shared, "doc_id", "left_semi").join(ids, "set_id").select(F.col("doc_id").alias("a"), F.col("nid").alias("b"))
        tied = components(extra.unionByName(classes.select(F.col("nid").alias("a"), F.col("nid").alias("b"))))
        ids = stored(ids.join(tied.select(F.col("node").alias("nid"), "label"), "nid", "left").select("set_id", F.coalesce("label", "nid").alias("nid")), "ids")
    labels = link_labels(docs, classes, width, percent, slack)
    if labels is not None:
        if not shared.isEmpty():
            was = classes.select("set_id", F.col("nid").alias("a")).join(ids.select("set_id", F.col("nid").alias("b")), "set_id").select("a", "b")
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(was))
        ids = ids.join(labels.select(F.col("node").alias("nid"), "label"), "nid", "left").select("set_id", F.coalesce("label", "nid").alias("nid"))
    ids = stored(ids.select(F.col("set_id").alias("own"), F.col("nid").alias("found")), "ids")
    out = rows.select("doc_id", "n_shingles", "set_id").join(ids, F.col("set_id") == F.col("own"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the least of its group."""
    gone = near_groups(docs, **options).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.distinct(), F.col("doc_id") == F.col("__gone"), "left_anti")


def groups_sql(width: int = 4, percent: int = 80) -> str:
    return f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []::varchar[]) as words from documents),
s as (select distinct doc_id, words[i : i + {width - 1}] as g from d, unnest(range(1, greatest(len(words) - {width - 2}, case when len(words) > 0 then 2 else 1 end))) as u(i)),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= {percent} * (x.n + y.n - shared)),
l as (select a as x, b as y from e union all select b, a from e),
r(node, other) as (select doc_id, doc_id from d union select r.node, l.y from r join l on r.other = l.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept
from d left join n using (doc_id) join r on r.node = d.doc_id group by d.doc_id, n.n
"""
