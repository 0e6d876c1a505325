"""Best-fit packing by bin completion over the histogram of piece lengths.

Documents become token pieces of at most ``capacity`` tokens.  Packing works on how many pieces of
each length there are - at most ``capacity`` numbers, whatever the size of the corpus - by a branch
and bound: around the largest piece left, undominated fillings are enumerated, filling wastes are
bounded by what the best solution so far allows, and best-fit decreasing gives the first incumbent.
A chosen filling is applied as often as the counts allow.  Pieces then find their sequence from
their rank among the pieces of their length; ranks are prefix sums over tasks.

Edge cases, all defined: a null or empty text is the single id 0; texts of any length are cut, whole;
repeated rows are packed each; an empty table gives an empty result; a null doc_id is kept as null;
other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored

SPECIAL = "<|endoftext|>"
CAPACITY = 2048


@lru_cache(maxsize=2)
def _fast(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _exact(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def token_ids(text: str | None, json_path: str, ranks_path: str) -> list[int]:
    """The ids of ``json_path``'s tokenizer without added special tokens, then id 0.

    The rank file holds the same vocabulary and gives the same ids several times faster; only a text
    that spells the special token goes through the tokenizer file itself, which knows it.
    """
    text = text or ""
    if SPECIAL in text:
        return [*_exact(json_path).encode(text, add_special_tokens=False).ids, 0]
    return [*_fast(ranks_path).encode_ordinary(text), 0]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a shorter first one where n is not a multiple."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of every document, with the task that made them and their rank there among equal lengths."""
    json_path, ranks_path = paths or default_paths()

    def make():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        counts = [0] * (capacity + 1)

        def kernel(batch: pa.RecordBatch) -> dict:
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank", "ids")
            cols: dict[str, list] = {k: [] for k in names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array(token_ids(text, json_path, ranks_path), "<u4")
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (doc_id, piece, start, length, zlib.crc32(own.tobytes()), part, counts[length], own.astype(np.int32) if keep_ids else None)
                    counts[length] += 1
                    for c, v in zip(cols.values(), row):
                        c.append(v)
            return cols

        return kernel

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local_rank bigint"
    return map_batches(docs.select("doc_id", "text"), schema + (", ids array<int>" if keep_ids else ""), make, rows=64)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths, how often) of its sequences."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        filling, room = [], capacity
        used: dict[int, int] = {}
        while True:
            fit = max((k for k, v in left.items() if k <= room and v > used.get(k, 0)), default=0)
            if not fit:
                break
            n = min(room // fit, left[fit] - used.get(fit, 0))
            used[fit] = used.get(fit, 0) + n
            filling += [fit] * n
            room -= fit * n
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((tuple(filling), times))
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and with pieces over half that cannot share."""
    best = -(-sum(k * v for k, v in counts.items()) // capacity)
    ks = sorted(counts)
    for t in {k for k in ks if 2 * k <= capacity} | {0}:
        alone = sum(counts[k] for k in ks if k > capacity - t)
        mid = [(k, counts[k]) for k in ks if 2 * k > capacity and k <= capacity - t]
        small = sum(k * counts[k] for k in ks if t <= k and 2 * k <= capacity)
        room = sum((capacity - k) * n for k, n in mid)
        best = max(best, alone + sum(n for _, n in mid) + max(0, -(-(small - room) // capacity)))
    return best


def fillings(left: dict[int, int], lengths: list[int], room: int, waste: int, most: int, nodes: int) -> list[tuple[int, tuple[int, ...]]]:
    """Up to ``most`` undominated fillings of ``room`` that waste at most ``waste``, least waste first.

    ``lengths`` holds the lengths left in falling order.  A filling is dominated if a piece left still
    fits, or if one of its pieces can be changed for a larger one within the waste.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [nodes]
    small = lengths[-1] if lengths else 0

    def undominated(chosen: list[int], rest: int) -> bool:
        if not rest:
            return True
        for k in lengths:
            spare = left[k] - chosen.count(k)
            if spare > 0 and (k <= rest or any(0 < k - x <= rest for x in set(chosen))):
                return False
        return True

    def search(at: int, rest: int, chosen: list[int]) -> bool:
        budget[0] -= 1
        if rest < small or at >= len(lengths):
            if rest <= waste and undominated(chosen, rest):
                found.append((rest, tuple(chosen)))
            return len(found) >= most and not found[-1][0] or budget[0] <= 0
        if rest in left and left[rest] > chosen.count(rest):
            found.append((0, (*chosen, rest)))
            if len(found) >= most or budget[0] <= 0:
                return True
        closed = False
        for i in range(at, len(lengths)):
            k = lengths[i]
            if k < rest and left[k] > chosen.count(k):
                closed = True
                chosen.append(k)
                done = search(i, rest - k, chosen)
                chosen.pop()
                if done:
                    return True
        if not closed and rest <= waste and undominated(chosen, rest):
            found.append((rest, tuple(chosen)))
        return budget[0] <= 0

    search(0, room, [])
    once = sorted(set(found), key=lambda x: (x[0], tuple(-k for k in x[1])))
    return once[:most]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, branch: int = 3, nodes: int = 20_000, filling_nodes: int = 600) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often) of as few sequences as the search finds; best-fit where it finds none better."""
    best = best_fit(counts, capacity)
    n_best, floor = sum(n for _, n in best), lower_bound(counts, capacity)
    if n_best <= floor:
        return best
    total = sum(k * v for k, v in counts.items())
    left = {k: v for k, v in counts.items() if v > 0}
    stack: list[dict] = []
    made, wasted = 0, 0

    def undo(step: dict) -> None:
        nonlocal made, wasted
        for k in step["lengths"]:
            left[k] = left.get(k, 0) + step["times"]
        made -= step["times"]
        wasted -= step["waste"] * step["times"]

    while nodes > 0:
        nodes -= 1
        if not left:
            if made < n_best:
                best, n_best = [(s["lengths"], s["times"]) for s in stack], made
            options = []
            if n_best <= floor:
                break
        else:
            top = max(left)
            left[top] -= 1
            if not left[top]:
                del left[top]
            # a solution better than the incumbent has this much waste in all
            spare = (n_best - 1) * capacity - total - wasted
            lengths = sorted((k for k in left if k <= capacity - top), reverse=True)
            options = fillings(left, lengths, capacity - top, min(spare, capacity - top), branch, filling_nodes) if spare >= 0 else []
            if not options and spare >= 0:
                filling, room = [], capacity - top
                for k in lengths:
                    n = min(room // k, left[k])
                    filling += [k] * n
                    room -= n * k
                options = [(room, tuple(filling))] if room <= spare else []
            left[top] = left.get(top, 0) + 1
            options = [(w, (top, *f)) for w, f in options][::-1]
        while not options:
            if not stack:
                return best
            step = stack.pop()
            undo(step)
            options = step["options"]
        waste, lengths_used = options.pop()
        times = min(left[k] // lengths_used.count(k) for k in set(lengths_used))
        if waste:
            times = min(times, max(1, ((n_best - 1) * capacity - total - wasted) // waste))
        for k in lengths_used:
            left[k] -= times
            if not left[k]:
                del left[k]
        made += times
        wasted += waste * times
        stack.append({"lengths": lengths_used, "times": times, "waste": waste, "options": options})
    return best


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length rows (first rank, first sequence, pieces a sequence, first offset), in order of rank."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for k in sorted(set(lengths), reverse=True):
            n = lengths.count(k)
            rows.setdefault(k, []).append((ranks.get(k, 0), sequence, n, offset))
            ranks[k] = ranks.get(k, 0) + n * times
            offset += n * k
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, paths: tuple[str, str] | None = None, **search) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    Two constants besides, for the gap of the search: ``n_sequences`` of this packing and ``least_sequences``
    that any packing needs at least.
    """
    pieces = stored(token_pieces(docs, capacity, keep_ids, paths), "pieces")
    counts = pieces.groupBy("length", "part").agg((F.max("local_rank") + 1).alias("n"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    plan = bin_completion(histogram, capacity, **search)
    n_sequences, least_sequences = sum(n for _, n in plan), lower_bound(histogram, capacity)
    table = slots_of(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("earlier"))
    ranked = pieces.join(counts, ["length", "part"])
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = ranked.select(*fields, (F.col("local_rank") + F.col("earlier")).alias("rank"))

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for k in np.unique(lengths):
                at = np.flatnonzero(lengths == k)
                rows = table[int(k)]
                found = rows[np.searchsorted(rows[:, 0], ranks[at], "right") - 1]
                inner = ranks[at] - found[:, 0]
                sequence[at] = found[:, 1] + inner // found[:, 2]
                offset[at] = found[:, 3] + inner % found[:, 2] * k
            return {**{f: batch.column(f) for f in fields}, "sequence_id": pa.array(sequence), "offset": pa.array(offset)}

        return kernel

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if keep_ids else "")
    out = map_batches(ranked, schema, make, rows=10_000)
    return out.withColumns({"n_sequences": F.lit(n_sequences).cast("bigint"), "least_sequences": F.lit(least_sequences).cast("bigint")})
