"""Substring deduplication by difference-cover anchors.

A window is ``window`` consecutive words.  With the cover {0, 1, 3, 9} modulo 13 any shift between
two equal windows of 20 words leaves a position in both that lies on the cover, and the 8 words from
there are inside both windows.  So only 8-word anchors at cover positions are hashed (4 of 13): first
the anchors that occur twice are found, then windows around them are extended to 20 words, hashed
with 80 bits and those of the part, and each one that has an earlier occurrence is removed.

Hashes travel in packed blocks, one for each part of the hash space and task.  Hashes that repeat
inside a task are settled there and one of them stands for the task, so a passage in a third of all
documents puts one entry a task, not one a document, into a part.

Edge cases, all defined: a null or empty text has no words and keeps the empty text; texts of any
length are read whole; a null doc_id counts as the smallest; rows with equal doc_id and text are one
occurrence, so neither goes for the other's sake; rows with equal doc_id (or none) and other texts are
documents of their own, in order of the 64-bit hashes of their texts; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: The perfect difference set of order 3: its differences give every residue modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
S29 = np.uint64(29)
#: Bytes of text a part of the hash space stands for: about 1.3 million anchors, 60 MB while it is searched.
PART_BYTES = 24 << 20
#: Stands for a null doc_id: the smallest number.
NO_ID = -(1 << 63)


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * multiplier
        out ^= out >> S29
    return out


def anchor_width(window: int) -> int:
    return window - PERIOD + 1


def cover_positions(n_words: int, window: int) -> np.ndarray:
    """Anchor positions of a text: on the cover and with a whole anchor after them."""
    if n_words < window:
        return np.zeros(0, np.int64)
    at = np.arange(n_words - anchor_width(window) + 1)
    return at[np.isin(at % PERIOD, COVER)]


class _Blocks:
    """Keys of a task's windows, dealt into packed blocks by part; repeats inside the task are settled.

    A block holds texts (did, tag, number of keys) and per key the position, ``width`` bytes of hash.
    Tags tell texts of one did apart; where all are 0 none is stored.
    One occurrence of each key, the first, stands for the task; rows with ``part`` < 0 hold positions
    that need no further search: in ``all_repeats`` mode every occurrence of a repeated key, else every
    one but the first.
    """

    def __init__(self, parts: int, width: int, all_repeats: bool, full: int = 1 << 21):
        self.parts, self.width, self.all_repeats, self.full = parts, width, all_repeats, full
        self.texts: list[tuple[int, int]] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, did: int, tag: int, pos: np.ndarray, key: np.ndarray, check: np.ndarray) -> bool:
        self.held.append((np.full(len(pos), len(self.texts), np.int64), pos.astype(np.int64), key, check))
        self.texts.append((did, tag))
        self.n += len(pos)
        return self.n >= self.full

    def _rows(self, part: np.ndarray, text: np.ndarray, pos: np.ndarray, raw: np.ndarray | None) -> pa.RecordBatch:
        """Rows of one block each; the arrays are in order of part, then text."""
        did, tag = (np.array(x, np.int64) for x in zip(*self.texts))
        cols: dict[str, list] = {f.name: [] for f in BLOCK}
        edges = np.flatnonzero(np.diff(part)) + 1
        for low, high in zip([0, *edges], [*edges, len(part)]):
            if low == high:
                continue
            starts = np.flatnonzero(np.diff(text[low:high], prepend=-1))
            own = text[low:high][starts]
            wide = bool(pos[low:high].max() > 0xFFFF)
            values = (
                int(part[low]), did[own].tobytes(), tag_bytes(tag[own]), np.diff(starts, append=high - low).astype("<u4").tobytes(),
                wide, pos[low:high].astype("<u4" if wide else "<u2").tobytes(), b"" if raw is None else raw[low:high].tobytes(),
            )
            for c, v in zip(cols.values(), values):
                c.append(v)
        return pa.RecordBatch.from_pydict(cols, schema=BLOCK)

    def flush(self):
        if not self.n:
            return
        text, pos, key, check = (np.concatenate(x) for x in zip(*self.held))
        did, tag = (np.array(x, np.int64)[text] for x in zip(*self.texts))
        by = np.lexsort((pos, tag, did, check, key))
        same = (key[by][1:] == key[by][:-1]) & (check[by][1:] == check[by][:-1])
        first = np.concatenate([[True], ~same])
        at = np.cumsum(first) - 1
        lead = by[first][at]  # of each sorted row, the first row with its key
        tie = (did[by] == did[lead]) & (tag[by] == tag[lead]) & (pos[by] == pos[lead])
        settled = np.bincount(at)[at] > 1 if self.all_repeats else ~tie
        sent = first if self.all_repeats else tie
        part = ((key >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)
        for chosen, known in ((by[sent], False), (by[settled], True)):
            if not len(chosen):
                continue
            own = -1 - text[chosen] % self.parts if known else part[chosen]
            chosen = chosen[np.lexsort((pos[chosen], text[chosen], own))]
            own = -1 - text[chosen] % self.parts if known else part[chosen]
            raw = None
            if not known:
                raw = np.concatenate([key[chosen].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], check[chosen].astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)[:, : self.width]
            yield self._rows(own, text[chosen], pos[chosen], np.ascontiguousarray(raw) if raw is not None else None)
        self.texts, self.held, self.n = [], [], 0


BLOCK = pa.schema([("part", pa.int32()), ("did", pa.binary()), ("tag", pa.binary()), ("n", pa.binary()), ("wide", pa.bool_()), ("pos", pa.binary()), ("keys", pa.binary())])
BLOCK_DDL = "part int, did binary, tag binary, n binary, wide boolean, pos binary, keys binary"
PLACES = pa.schema([("home", pa.int32()), *list(BLOCK)[1:-1]])
TEXTS = pa.schema([("did", pa.int64()), ("tag", pa.int64()), ("pos", pa.list_(pa.int32()))])


def tag_bytes(tag: np.ndarray) -> bytes:
    return tag.astype("<i8").tobytes() if tag.any() else b""


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """did, tag and position of every entry of packed rows."""
    out: tuple[list, list, list] = ([], [], [])
    for did, tag, n, wide, pos in zip(*(table.column(k).to_pylist() for k in ("did", "tag", "n", "wide", "pos"))):
        n = np.frombuffer(n, "<u4")
        out[0].append(np.repeat(np.frombuffer(did, np.int64), n))
        out[1].append(np.repeat(np.frombuffer(tag, "<i8") if tag else np.zeros(len(n), np.int64), n))
        out[2].append(np.frombuffer(pos, "<u4" if wide else "<u2").astype(np.int64))
    return tuple(map(np.concatenate, out))


def _pack_homes(did: np.ndarray, tag: np.ndarray, pos: np.ndarray, homes: int) -> pa.Table:
    """Positions packed by the home of their text, one row a home."""
    with np.errstate(over="ignore"):
        mixed = (did.view(np.uint64) * M2 ^ tag.view(np.uint64)) * M1
    home = ((mixed >> np.uint64(33)) % np.uint64(homes)).astype(np.int64)
    by = np.lexsort((pos, tag, did, home))
    did, tag, pos, home = did[by], tag[by], pos[by], home[by]
    rows = []
    edges = np.flatnonzero(np.diff(home)) + 1
    for low, high in zip([0, *edges], [*edges, len(home)]):
        if low == high:
            continue
        d, t, q = did[low:high], tag[low:high], pos[low:high]
        starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
        wide = bool(q.max() > 0xFFFF)
        rows.append({
            "home": int(home[low]), "did": d[starts].tobytes(), "tag": tag_bytes(t[starts]), "n": np.diff(starts, append=high - low).astype("<u4").tobytes(),
            "wide": wide, "pos": q.astype("<u4" if wide else "<u2").tobytes(),
        })
    return pa.Table.from_pylist(rows, schema=PLACES)


def _search(blocks: DataFrame, width: int, all_repeats: bool, parts: int, name: str) -> DataFrame:
    """(did, tag, ``name``): positions of repeated keys, or of those that have an earlier occurrence, by text."""

    def find(table: pa.Table) -> pa.Table:
        did, tag, pos = _unpack(table)
        if table.column("part")[0].as_py() < 0:
            return _pack_homes(did, tag, pos, parts)
        raw = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("keys").to_pylist()]).reshape(-1, width)
        wide = np.zeros((len(raw), 16), np.uint8)
        wide[:, :6], wide[:, 8 : 8 + width - 6] = raw[:, :6], raw[:, 6:]
        key, check = wide.view("<u8").T
        by = np.lexsort((pos, tag, did, check, key))
        same = (key[by][1:] == key[by][:-1]) & (check[by][1:] == check[by][:-1])
        first = np.concatenate([[True], ~same])
        at = np.cumsum(first) - 1
        if all_repeats:
            hit = by[np.bincount(at)[at] > 1]
        else:
            lead = by[first][at]
            hit = by[(did[by] != did[lead]) | (tag[by] != tag[lead]) | (pos[by] != pos[lead])]
        return _pack_homes(did[hit], tag[hit], pos[hit], parts)

    def by_text(table: pa.Table) -> pa.Table:
        did, tag, pos = _unpack(table)
        by = np.lexsort((pos, tag, did))
        did, tag, pos = did[by], tag[by], pos[by]
        starts = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (tag[1:] != tag[:-1])]))
        offsets = pa.array(np.append(starts, len(did)).astype(np.int32))
        return pa.Table.from_arrays([pa.array(did[starts]), pa.array(tag[starts]), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32)))], schema=TEXTS)

    # as many tasks as parts, so that what one of them reads does not grow with the corpus
    found = blocks.repartition(parts, "part").groupBy("part").applyInArrow(find, "home int, did binary, tag binary, n binary, wide boolean, pos binary")
    return found.repartition(parts, "home").groupBy("home").applyInArrow(by_text, "did bigint, tag bigint, pos array<int>").withColumnRenamed("pos", name)


def repeated_anchors(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """did, tag and ``positions`` of the anchors that occur at least twice anywhere."""
    width = anchor_width(window)

    def run(batches):
        blocks = _Blocks(parts, 6, True)
        for batch in batches:
            for did, tag, text in zip(*(batch.column(k).to_pylist() for k in ("did", "tag", "text"))):
                words = (text or "").encode("utf-8", "replace").split()
                pos = cover_positions(len(words), window)
                if len(pos) and blocks.add(did, tag, pos, window_hashes(word_hashes(words), width, M1)[pos], np.zeros(len(pos), np.uint64)):
                    yield from blocks.flush()
        yield from blocks.flush()

    return _search(docs.select("did", "tag", "text").mapInArrow(run, BLOCK_DDL), 6, True, parts, "positions")


def later_windows(docs: DataFrame, positions: DataFrame, window: int, parts: int) -> DataFrame:
    """did, tag and ``starts`` of windows whose words also start earlier; only windows around repeated anchors are hashed."""
    width = anchor_width(window)

    def run(batches):
        blocks = _Blocks(parts, 10, False)
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in ("did", "tag", "text"))
            for i, (did, tag, text) in enumerate(zip(*columns)):
                words = word_hashes((text or "").encode("utf-8", "replace").split())
                n = len(words) - window + 1
                at = np.unique(np.asarray(batch.column("positions")[i].values))
                cover = np.zeros(n + 1, np.int64)  # windows that hold a repeated anchor
                np.add.at(cover, np.clip(at - (window - width), 0, n), 1)
                np.add.at(cover, np.clip(at + 1, 0, n), -1)
                pos = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                if blocks.add(did, tag, pos, window_hashes(words, window, M1)[pos], window_hashes(words, window, M2)[pos] >> np.uint64(32)):
                    yield from blocks.flush()
        yield from blocks.flush()

    rows = docs.join(positions, ["did", "tag"]).select("did", "tag", "text", "positions")
    return _search(rows.mapInArrow(run, BLOCK_DDL), 10, False, parts, "starts")


def remove_repeats(docs: DataFrame, window: int = 20, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and kept_text on request)."""
    docs = docs.select("text", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"))
    unique = docs.groupBy("did").count().where("count > 1").isEmpty()
    docs = docs.withColumn("tag", F.lit(0).cast("bigint") if unique else F.xxhash64("text"))
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    positions = repeated_anchors(docs, window, parts)
    starts = later_windows(docs, positions, window, parts)

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                n, gone = len(words), 0
                if batch.column("starts")[i].is_valid:
                    at = np.unique(np.asarray(batch.column("starts")[i].values))
                    cover = np.zeros(n + 1, np.int64)
                    cover[at] += 1
                    np.add.at(cover, at + window, -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    gone = n - int(stay.sum())
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                kept = b" ".join(words)
                for c, v in zip(cols.values(), (n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None)):
                    c.append(v)
            return {"doc_id": pa.array([None if x == NO_ID else x for x in batch.column("did").to_pylist()], pa.int64()), **cols}

        return kernel

    rows = docs.join(starts, ["did", "tag"], "left").select("did", "text", "starts")
    return map_batches(rows, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else ""), make)


def repeats_sql(window: int = 20) -> str:
    return f"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []::varchar[]) as words from documents),
w as (select doc_id, s, words[s : s + {window - 1}] as seq from d, unnest(range(1, len(words) - {window - 2})) as u(s)),
f as (select seq, min((doc_id, s)) as first from w group by seq having count(*) > 1),
r as (select w.doc_id, w.s from w join f using (seq) where (w.doc_id, w.s) > f.first),
g as (select distinct doc_id, p from r, unnest(range(s, s + {window})) as u(p)),
n as (select doc_id, len(words) as n_words, words from d),
k as (select n.doc_id, p, words[p] as word from n, unnest(range(1, n_words + 1)) as u(p)),
j as (select k.doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n_kept from k left join g using (doc_id, p) where g.p is null group by k.doc_id)
select n.doc_id, n.n_words::bigint as n_words, (n.n_words - coalesce(n_kept, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from n left join j using (doc_id)
"""
