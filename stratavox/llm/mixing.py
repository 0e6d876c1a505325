"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Each source's documents are put in hash order and cut into blocks of equal tokens.  Golden-ratio
points, mapped through the cumulative targets, give every slot of the schedule its source; slots are
ranked within their source, and the k-th slot takes the source's k-th block, going round the source
for at most ``max_epochs`` rounds.  A source that has met its target passes over its further slots,
and its last slot is cut to the target.  What a source takes is what its slots take: nothing is added
behind the schedule.

All running sums go over buckets of the hash order first and then within a bucket, so that a source
that holds any share of the rows is spread over many tasks.  Windows without a bucket see one row a
source, or one a bucket or chunk of a source.

Edge cases, all defined: a null source is a source of its own, last in order; null or empty texts
have size 0 and are taken 0 times; repeated rows each get their own share; rows without an id are
placed by their texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Fractional part of the golden ratio, and of 2**20 times it.
GOLDEN = (math.sqrt(5) - 1) / 2
GOLDEN_20 = math.fmod(GOLDEN * (1 << 20), 1.0)
#: Equal parts of the unit interval that slots and source intervals meet in.
CELLS = 4096
#: Slots ranked together.
CHUNK = 8192


def hash_order(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of the id as text and the text's md5: the shuffled order of a source's documents, one id or many."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("bigint")


def point(i: Column) -> Column:
    """The i-th golden-ratio point; split so that large i keep their precision."""
    high, low = F.floor(i / F.lit(1 << 20)).cast("double"), (i % F.lit(1 << 20)).cast("double")
    x = high * F.lit(GOLDEN_20)
    x = x - F.floor(x) + (low + F.lit(1.0)) * F.lit(GOLDEN)
    return x - F.floor(x)


def row_key() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull())


def sized_rows(docs: DataFrame, bucket_rows: int, keyed: bool) -> DataFrame:
    """doc_id, source key, size, hash order and bucket of every row, stored once."""
    rows = stored(
        docs.select(
            "doc_id",
            # null sorts last: its key begins with 1, all others with 0
            F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("skey"),
            F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            hash_order(F.col("doc_id"), F.col("text")).alias("h"),
            (row_key() if keyed else F.lit(0).cast("bigint")).alias("key"),
        ),
        "mix-rows",
    )
    bits = max(0, math.ceil(math.log2(max(1, rows.count() / bucket_rows))))
    return rows.withColumn("bucket", F.shiftright(F.col("h"), 60 - bits))


def source_targets(sums: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """Per source: weight, size and target; one row a source goes through a single window.

    Filling up to caps: in order of cap/weight a source is capped if its fair part of what earlier
    caps leave is above its cap; the others share the rest by weight.
    """
    by_key = Window.orderBy("skey")
    per = sums.groupBy("skey").agg(F.sum("bucket_size").cast("bigint").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest", F.sum("weight").over(onward))
    per = per.withColumn("capped", F.col("left").cast("double") * F.col("weight") > F.col("cap").cast("double") * F.col("rest"))
    free = F.when(~F.col("capped"), F.col("weight"))
    per = per.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(Window.partitionBy()), F.lit(0)))
    per = per.withColumn("rest", F.sum(free).over(Window.partitionBy()))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("left").cast("double") / F.col("rest").cast("double") * F.col("weight"))
    return per.select("skey", "source_size", "weight", target.alias("target"))


def quotas(targets: DataFrame, block_tokens: int) -> DataFrame:
    """Per source: words to take, blocks a round, slots it needs and where its last slot is cut."""
    q = targets.withColumn("words", F.floor(F.col("target") + 0.5).cast("bigint"))
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.col("words") % F.col("source_size")).otherwise(F.lit(0))
    q = q.withColumn("rounds", whole.cast("bigint")).withColumn("rest_words", rest.cast("bigint"))
    q = q.withColumn("blocks", F.expr(f"(source_size + {block_tokens - 1}) div {block_tokens}"))
    return q.withColumn("need", F.expr(f"rounds * blocks + (rest_words + {block_tokens - 1}) div {block_tokens}"))


def points_needed(n: int) -> int:
    """Points after which every interval of length k/n holds k of them.

    Among N golden-ratio points no gap is wider than 2.62/N, so each n-th of the unit interval is met
    within 2.62 n points.
    """
    return 27 * n // 10 + 4


def schedule(quota: DataFrame, block_tokens: int) -> DataFrame:
    """The slots of the mix: slot, skey, epoch, block and ``cut`` (words of the block to take, null: all)."""
    spark = quota.sparkSession
    quota = quota.where("need > 0")
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = quota.withColumn("high", F.sum("need").over(upto)).withColumn("low", F.col("high") - F.col("need"))
    n = int(quota.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0])
    spans = spans.select("skey", "blocks", "need", "rounds", "rest_words", (F.col("low") / F.lit(max(1, n))).alias("low"), (F.col("high") / F.lit(max(1, n))).alias("high"))
    first, last = F.floor(F.col("low") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("high") * CELLS))
    cells = spans.withColumn("cell", F.explode(F.sequence(first, last)))
    slots = spark.range(points_needed(n)).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = slots.join(cells, "cell").where("u >= low and u < high").withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    slots = slots.select("slot", "chunk", "skey", "blocks", "need", "rounds", "rest_words")
    counts = slots.groupBy("skey", "chunk").agg(F.count("*").alias("in_chunk"))
    counts = counts.withColumn("earlier", F.coalesce(F.sum("in_chunk").over(Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = slots.withColumn("rank", F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(counts.select("skey", "chunk", "earlier"), ["skey", "chunk"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    # a source that has what it needs passes over the rest of its points
    out = ranked.where("rank < need").withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    cut = F.when((F.col("epoch") == F.col("rounds")) & ((F.col("block") + 1) * block_tokens > F.col("rest_words")), F.col("rest_words") - F.col("block") * block_tokens)
    return out.select("slot", "skey", "epoch", "block", cut.alias("cut"))


def mix(docs: DataFrame, block_tokens: int = 1024, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), bucket_rows: int = 4096, keyed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted) and first_slot.

    ``first_slot`` is the slot of the schedule that brings the row's first word, null where nothing is taken.  With
    ``keyed`` there are ``key``, which tells rows of one doc_id apart, ``start``, the row's place in its source, and
    ``slots``, the slot of each of its copies.
    """
    rows = sized_rows(docs, bucket_rows, keyed)
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").cast("bigint").alias("bucket_size"))
    targets = source_targets(sums, max_epochs, weights)
    quota = quotas(targets, block_tokens)
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    starts = starts.join(targets, "skey").select("skey", "bucket", "before", "source_size", "target")
    within = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "key")
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rn", F.row_number().over(within))
    placed = placed.join(starts, ["skey", "bucket"]).withColumn("start", F.col("before") + F.col("inner"))
    # a document's pieces in the blocks of its source
    b = block_tokens
    pieces = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).otherwise(F.array(F.lit(-1).cast("bigint")))))
    pieces = pieces.withColumn("from", F.greatest(F.lit(0), F.col("start") - F.col("block") * b)).withColumn("to", F.least(F.lit(b), F.col("start") + F.col("size") - F.col("block") * b))
    copies = [f"slot_{k}" for k in range(max_epochs + 1)]
    takes = schedule(quota, b).groupBy("skey", "block").agg(
        F.sum(F.when(F.col("cut").isNull(), 1).otherwise(0)).alias("times"), F.max("cut").alias("cut"), *(F.min(F.when(F.col("epoch") == k, F.col("slot"))).alias(c) for k, c in enumerate(copies))
    )
    got = pieces.join(takes, ["skey", "block"], "left")
    part = F.coalesce(F.col("times"), F.lit(0)) * (F.col("to") - F.col("from")) + F.greatest(F.lit(0), F.least(F.col("to"), F.coalesce("cut", F.lit(0))) - F.col("from"))
    part = F.when(F.col("block") < 0, F.lit(0)).otherwise(part)
    leads = F.col("block") == F.expr(f"start div {b}")  # a copy comes in the slot of its first piece
    out = got.groupBy("skey", "bucket", "rn").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "key", "start", "size", "source_size", "target")), F.sum(part).cast("bigint").alias("taken"), *(F.min(F.when(leads, F.col(c))).alias(c) for c in copies)
    )
    out = out.withColumn("first_slot", F.when(F.col("taken") > 0, F.col(copies[0])))
    return out.select("doc_id", *(["key", "start", F.array(*copies).alias("slots")] if keyed else []), "size", "source_size", "target", "taken", "first_slot")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, columns of ``docs``, in the order of the schedule: whole copies of each row, and of what is left the first words.

    A copy stands in the slot that brings its first word, rows of one slot in the order of their source.  Rows that share
    id, text and source are numbered to meet their shares one by one; all others go straight to theirs.  A cut copy has
    its words joined by one space and, where there is ``n_chars``, its own count.
    """
    own = "__mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    col = lambda name: F.col(f"{own}{name}")
    plan = mix(docs, keyed=True, **options).select("doc_id", *(F.col(c).alias(f"{own}{c}") for c in ("key", "start", "slots", "size", "taken"))).withColumnRenamed("doc_id", f"{own}id")
    same = Window.partitionBy(f"{own}id", f"{own}key")
    plan = plan.withColumn(f"{own}nth", F.row_number().over(same.orderBy(F.desc(f"{own}taken"), f"{own}start"))).withColumn(f"{own}rows", F.count("*").over(same))
    plan = stored(plan.where(col("taken") > 0), "mix-plan")
    # texts that stand in one row only are not moved to be numbered
    repeated = stored(plan.where((col("rows") > 1) & (col("nth") == 1)).select(f"{own}id", f"{own}key"), "mix-repeated")
    rows = docs.withColumn(f"{own}own", row_key())
    single = rows.withColumn(f"{own}n", F.lit(1))
    if not repeated.isEmpty():
        is_repeated = F.col("doc_id").eqNullSafe(col("id")) & (col("own") == col("key"))
        numbered = rows.join(repeated, is_repeated, "left_semi").withColumn(f"{own}n", F.row_number().over(Window.partitionBy("doc_id", f"{own}own").orderBy(f"{own}own")))
        single = single.join(repeated, is_repeated, "left_anti").unionByName(numbered)
    rows = single.join(plan, F.col("doc_id").eqNullSafe(col("id")) & (col("own") == col("key")) & (col("n") == col("nth")))
    copies = F.expr(f"transform(sequence(0L, ({own}taken - 1) div {own}size), i -> least({own}size, {own}taken - i * {own}size))")
    rows = rows.select(*docs.columns, *(f"{own}{c}" for c in ("start", "slots", "size")), F.posexplode(copies).alias(f"{own}copy", f"{own}words"))
    cut = col("words") < col("size")
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), col("words").cast("int")), " ")).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    rows = rows.orderBy(F.get(col("slots"), col("copy")), col("start"))
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def mix_sql(max_epochs: int = 3, block_tokens: int = 1024) -> str:
    """The same rows as ``mix`` in DuckDB SQL: a document's part of its source's ring, and its place in the schedule."""
    b = block_tokens
    return f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight,
             {max_epochs} * source_size as cap, (sum(source_size) over ())::bigint as total from s),
c as (select *, total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as room,
             sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as rest from w),
k as (select *, room::double * weight > cap::double * rest as capped from c),
t as (select source, source_size, case when capped then cap::double else
             (total - coalesce(sum(case when capped then cap end) over (), 0))::double / (sum(case when not capped then weight end) over ())::double * weight end as target from k),
r as (select *, floor(target + 0.5)::bigint as words from t),
q as (select *, (source_size + {b - 1}) // {b} as blocks,
             case when source_size > 0 then words // source_size * ((source_size + {b - 1}) // {b}) + (words % source_size + {b - 1}) // {b} else 0 end as need from r),
i as (select *, (sum(need) over (order by source nulls last rows unbounded preceding))::bigint as high, (sum(need) over ())::bigint as n from q),
g as (select slot, slot // 1048576 as a, slot % 1048576 as l from range((select 27 * coalesce(max(n), 0) // 10 + 4 from i)) as x(slot)),
m as (select slot, a * '{GOLDEN_20!r}'::double as x, (l + 1.0::double) * '{GOLDEN!r}'::double as y from g),
u as (select slot, x - floor(x) + y as z from m),
o as (select source, slot, row_number() over (partition by source order by slot) - 1 as rank
      from (select slot, z - floor(z) as pt from u) join i on pt >= (high - need)::double / n and pt < high::double / n where need > 0),
p as (select d.doc_id, d.source, d.size, r.source_size, r.target, r.words,
             (coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0))::bigint as start
      from d join r on d.source is not distinct from r.source),
e as (select *, case when size = 0 then 0 else (words // source_size) * size + greatest(0, least(start + size, words % source_size) - start) end::bigint as taken from p)
select doc_id, size, source_size, target, taken, case when taken > 0 then slot end as first_slot
from e left join o on e.source is not distinct from o.source and o.rank = e.start // {b}
"""
