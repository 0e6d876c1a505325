"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line of a text becomes a set of binary features (symbol share, capitals, table bars, length,
repetition).  A two-state chain, fitted on labelled documents whose lines inherit the document's
quality label, is decoded by Viterbi; the share of words on content lines decides retention,
after the plain base rules.

Edge cases, all defined: a null or empty text has no words, fails the base rules and is not kept;
texts of any length are read whole (time linear in lines, windows sorted); repeated rows get equal
results; an empty table gives an empty result; without labelled rows the chain is neutral and keeps
what the base rules keep; columns other than ``doc_id`` and ``text`` are never read here.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, held_out, map_batches

SYMBOLS = b"#*$%&|<>"
N_FEATURES = 26
#: Lines in a training segment; longer texts are cut into several segments for fitting only.
SEGMENT = 64
#: Documents that the chain is fitted on, at most, and segments of one of them.
MAX_TRAIN_DOCS, MAX_SEGMENTS = 3000, 4
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS, DIGITS = UPPER + UPPER.lower(), b"0123456789"


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words covered by windows of ``window`` words that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    ids *= np.uint64(0xBF58476D1CE4E5B9)
    ids ^= ids >> np.uint64(32)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + ids[k : k + n]
        h ^= h >> np.uint64(31)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, h)
    hit = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == h)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines that have a word)."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    word_chars = len(text or "") - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words), lines


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def line_features(lines: list[bytes]) -> tuple[list[list[int]], list[int]]:
    """Active feature numbers and the number of words of each line."""
    out, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        n, size = len(words), max(1, len(line))
        if line.isascii():
            capitals, letters, digits = (size - len(line.translate(None, x)) for x in (UPPER, LETTERS, DIGITS))
        else:
            text = line.decode("utf-8", "replace")
            capitals, letters, digits = (sum(map(test, text)) for test in (str.isupper, str.isalpha, str.isdigit))
        active = [0]
        active.append(1 + _level((size - len(line.translate(None, SYMBOLS))) / size, (1e-9, 0.02, 0.06, 0.12)))
        active.append(6 + _level(capitals / (letters or 1), (0.02, 0.1, 0.3, 0.6)))
        active.append(11 + _level(n, (2, 4, 8, 20)))
        active.append(16 + _level(len(set(words)) / max(1, n), (0.4, 0.6, 0.8)))
        active.append(20 + _level(line.count(b"!") / max(1, n), (0.05, 0.5)))
        if line in seen:
            active.append(23)
        if digits / size > 0.2:
            active.append(24)
        if line.rstrip(WHITE)[-1:] in (b".", b"!", b"?", b":", b";"):
            active.append(25)
        seen.add(line)
        out.append(active)
        sizes.append(n)
    return out, sizes


class ChainCRF:
    """Two states, 0 boilerplate and 1 content: emission weights (features x 2) and transitions (2 x 2)."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros((N_FEATURES, 2)) if emission is None else emission
        self.transition = np.zeros((2, 2)) if transition is None else transition

    def viterbi(self, features: list[list[int]]) -> list[int]:
        """The most likely states; ties go to content."""
        if not features:
            return []
        e, t = self.emission.tolist(), self.transition.tolist()
        back, a, b = [], 0.0, 0.0
        for i, active in enumerate(features):
            s0 = sum(e[k][0] for k in active)
            s1 = sum(e[k][1] for k in active)
            if i:
                from0 = (a + t[0][0], b + t[1][0])
                from1 = (a + t[0][1], b + t[1][1])
                back.append((int(from0[1] >= from0[0]), int(from1[1] >= from1[0])))
                a, b = max(from0) + s0, max(from1) + s1
            else:
                a, b = s0, s1
        states = [int(b >= a)]
        for step in reversed(back):
            states.append(step[states[-1]])
        return states[::-1]

    def objective(self, x: np.ndarray, mask: np.ndarray, gold: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted conditional log-likelihood of segments whose lines all have one state, less the ridge; its gradients.

        ``x`` (segments, lines, features), ``mask`` tells lines from padding, ``weight`` is that of a line.
        """
        n, longest = mask.shape
        em, tr = x @ self.emission, self.transition
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for j in range(1, longest):
            step = np.logaddexp(alpha[:, j - 1, 0, None] + tr[0], alpha[:, j - 1, 1, None] + tr[1]) + em[:, j]
            alpha[:, j] = np.where(mask[:, j, None], step, alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            nxt = em[:, j + 1] + beta[:, j + 1]
            step = np.logaddexp(tr[:, 0] + nxt[:, 0, None], tr[:, 1] + nxt[:, 1, None])
            beta[:, j] = np.where(mask[:, j + 1, None], step, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        lines, own = mask.sum(1), np.arange(n)
        path = (em[own, :, gold] * mask).sum(1) + (lines - 1) * tr[gold, gold]
        value = float(weight @ (path - z)) - l2 / 2 * float((self.emission**2).sum() + (tr**2).sum())
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        diff = (np.eye(2)[gold][:, None, :] * mask[:, :, None] - p) * weight[:, None, None]
        g_em = np.tensordot(x, diff, ((0, 1), (0, 1))) - l2 * self.emission
        seen, both = np.zeros((2, 2)), mask[:, 1:]
        np.add.at(seen, (gold, gold), (lines - 1) * weight)
        pair = np.exp(alpha[:, :-1, :, None] + tr + (em + beta)[:, 1:, None, :] - z[:, None, None, None]) * (both * weight[:, None])[:, :, None, None]
        return value, g_em, seen - pair.sum((0, 1)) - l2 * tr

    @classmethod
    def fit(cls, rows: Iterable[tuple[int, list[list[int]]]], rounds: int = 80, l2: float = 1e-3, settled: float = 1e-4) -> ChainCRF:
        """Gradient ascent until the value grows by less than ``settled`` of itself in a round; rows are (label, line features)."""
        segments = [(y, f[i : i + SEGMENT]) for y, f in rows for i in range(0, len(f), SEGMENT)]
        if not segments or len({y for y, _ in segments}) < 2:
            return cls()
        n, longest = len(segments), max(len(f) for _, f in segments)
        x = np.zeros((n, longest, N_FEATURES), np.float32)
        mask = np.zeros((n, longest), bool)
        gold = np.array([y for y, _ in segments])
        for i, (_, f) in enumerate(segments):
            mask[i, : len(f)] = True
            for j, active in enumerate(f):
                x[i, j, active] = 1
        # both labels weigh the same, whatever their share of the sample
        weight = np.where(gold == 1, 0.5 / max(1, mask[gold == 1].sum()), 0.5 / max(1, mask[gold == 0].sum()))
        model, moments, before = cls(), [np.zeros((N_FEATURES, 2)), np.zeros((2, 2))], -np.inf
        for _ in range(rounds):
            value, *gradients = model.objective(x, mask, gold, weight, l2)
            if abs(value - before) < settled * abs(value):
                break
            before = value
            for k, g in enumerate(gradients):
                moments[k] += g * g
                (model.emission, model.transition)[k][...] += 0.4 * g / (np.sqrt(moments[k]) + 1e-8)
        return model


def segments_of(features: list, most: int = MAX_SEGMENTS) -> list:
    """All lines of a short text; of a long one ``most`` whole segments, spread evenly over it."""
    n = -(-len(features) // SEGMENT)
    if n <= most:
        return features
    return [f for k in range(most) for f in features[k * (n - 1) // (most - 1) * SEGMENT :][:SEGMENT]]


def fit_chain(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> ChainCRF:
    """Fit on at most ``max_docs`` labelled documents outside the held-out fold, chosen by hash, and ``MAX_SEGMENTS`` segments of each.

    Only the active feature numbers of these segments' lines reach the driver.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            found = [segments_of(line_features(base_counts(t)[5])[0]) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "features": found}

        return kernel

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    got = map_batches(rows, "doc_id bigint, quality int, features array<array<int>>", make, rows=64).collect()
    once = {r.doc_id: r for r in sorted(got, key=lambda r: (r.doc_id, r.quality, len(r.features)))}
    return ChainCRF.fit([(int(r.quality > 0), r.features) for r in once.values() if r.features])


def score_quality(docs: DataFrame, model: ChainCRF, min_words: int = 20, max_repeat_percent: int = 30, min_content_share: float = 0.5) -> DataFrame:
    """Per row: doc_id, base counts, base_failed, content_share, n_content_lines and kept."""

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_content_lines", "content_share", "kept")}
            for text in batch.column("text").to_pylist():
                n, chars, symbols, dups, repeats, lines = base_counts(text)
                failed = n < min_words or 100 * repeats > max_repeat_percent * n
                features, sizes = line_features(lines)
                states = model.viterbi(features)
                share = sum(s for s, y in zip(sizes, states) if y) / n if n else 0.0
                values = (n, chars, symbols, dups, repeats, failed, sum(states), share, not failed and share >= min_content_share)
                for c, v in zip(cols.values(), values):
                    c.append(v)
            return {"doc_id": batch.column("doc_id"), **cols}

        return kernel

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_content_lines bigint, content_share double, kept boolean"
    return map_batches(docs.select("doc_id", "text"), schema, make)


def filter_quality(docs: DataFrame, model: ChainCRF, min_words: int = 20, max_repeat_percent: int = 30, min_content_share: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules and the chain keep; runs in place, without a join."""

    def keeps(text: str | None) -> bool:
        n, _, _, _, repeats, lines = base_counts(text)
        if n < min_words or 100 * repeats > max_repeat_percent * n:
            return False
        features, sizes = line_features(lines)
        return sum(s for s, y in zip(sizes, model.viterbi(features)) if y) / n >= min_content_share

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                # text by text, so that no list of all of them is held
                yield some.filter(pa.array([keeps(t.as_py()) for t in some.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
