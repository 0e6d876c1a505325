"""Language identification in two steps: the family first, then languages within it.

Texts become L2-normalised square roots of hashed letter n-gram counts (one to three letters, word
edges included).  One-against-rest linear support vector machines choose the family; one-versus-one
machines between the languages of that family vote, and margins break ties.  Families of well-known
codes are fixed values; any other code joins the family of its nearest centroid if that is close,
else it is a family of its own.

Edge cases, all defined: a null text or one without a letter is ``und`` with score 0; texts are read
whole; ties go to the code that sorts first; repeated rows get equal results; an empty table gives an
empty result; with no labelled rows everything is ``und``; only doc_id and text are read to predict.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_batches

DIM = 1 << 13
#: Labelled documents a language that the machines are fitted on, at most.
MAX_PER_LANGUAGE = 300
#: Parts of a language that are ranked on their own before the whole is.
PARTS = 16
#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point of the basic plane, 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-case letters of a text with one 0 between and around words; empty without a letter."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    high = raw > 0xFFFF
    codes = _letters()[np.where(high, 0, raw)]
    if high.any():
        for c in np.unique(raw[high]):
            if chr(c).isalpha():
                codes[raw == c] = c
    if not codes.any():
        return np.zeros(0, np.uint32)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    stay = np.ones(len(codes), bool)
    stay[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[stay]


def ngram_features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the n-grams of one to three codes."""
    x = codes.astype(np.uint64) + np.uint64(1)
    one = x[x > 1] * np.uint64(0x9E3779B97F4A7C15)
    two = (x[:-1] * np.uint64(0x2545F4914F6CDD1D) ^ x[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = ((x[:-2] * np.uint64(0x2545F4914F6CDD1D) ^ x[1:-1]) * np.uint64(0x2545F4914F6CDD1D) ^ x[2:]) * np.uint64(0xD6E8FEB86659FD93)
    counts = np.bincount((np.concatenate([one, two, three]) >> np.uint64(51)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    return at, values / np.linalg.norm(values)


#: A row of features: buckets and their values.
Sparse = tuple[np.ndarray, np.ndarray]


def fit_svm(x: list[Sparse], y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss) by dual coordinate descent; last is the bias."""
    n = len(y)
    squares = [float(v @ v) + 1 for _, v in x]
    alpha, w = np.zeros(n), np.zeros(DIM + 1)
    rng = np.random.default_rng(seed)
    upper = c * n / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            at, v = x[i]
            g = y[i] * (v @ w[at] + w[-1]) - 1
            new = min(max(alpha[i] - g / squares[i], 0.0), upper[i])
            d = (new - alpha[i]) * y[i]
            if d:
                w[at] += d * v
                w[-1] += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    rest: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = letter_codes(text)
        if not len(codes) or not self.families:
            return "und", 0.0
        at, v = ngram_features(codes)
        margin = lambda w: float(v @ w[at] + w[-1])
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            m = np.array([margin(self.rest[f]) for f in self.families])
            family = self.families[int(m.argmax())]
            e = np.exp(2 * (m - m.max()))
            sure = float(1 / e.sum())
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], sure
        votes, total = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            m = margin(self.pairs[a, b])
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
        best = max(langs, key=lambda x: (votes[x], total[x]))  # the first of equals
        least = min(margin(self.pairs[a, b]) * (1 if a == best else -1) for a, b in combinations(langs, 2) if best in (a, b))
        return best, sure / (1 + float(np.exp(-2 * least)))


def group_families(centroids: dict[str, np.ndarray], near: float = 0.6) -> dict[str, list[str]]:
    """Languages by family, both in order."""
    known = {code: f for f, codes in FAMILIES.items() for code in codes}
    out: dict[str, list[str]] = {}
    for lang in sorted(centroids):
        if lang in known:
            out.setdefault(known[lang], []).append(lang)
    for lang in sorted(set(centroids) - set(known)):
        close = max(((float(centroids[lang] @ centroids[x]), f) for f, langs in out.items() for x in langs if x in known), default=(0.0, ""))
        out.setdefault(close[1] if close[0] >= near else lang, []).append(lang)
    return {f: sorted(out[f]) for f in sorted(out)}


def fit_languages(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """rows: (language, buckets, values)."""
    if not rows:
        return LanguageModel()
    x = [(at, v) for _, at, v in rows]
    lang = np.array([r[0] for r in rows])
    centroids = {}
    for code in sorted(set(lang)):
        total = np.zeros(DIM)
        for i in np.flatnonzero(lang == code):
            total[x[i][0]] += x[i][1]
        centroids[code] = total / max(1e-9, float(np.linalg.norm(total)))
    members = group_families(centroids)
    family_of = {code: f for f, codes in members.items() for code in codes}
    family = np.array([family_of[code] for code in lang])
    model = LanguageModel(list(members), members)
    if len(members) > 1:
        model.rest = {f: fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in members}
    for langs in members.values():
        for a, b in combinations(langs, 2):
            own = np.flatnonzero((lang == a) | (lang == b))
            model.pairs[a, b] = fit_svm([x[i] for i in own], np.where(lang[own] == a, 1.0, -1.0))
    return model


def sample_and_fit(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` documents of each language outside the held-out fold, chosen by hash.

    Whole texts give the features; each text of more than 40 words also gives those of 12 of its words,
    so that short texts are learned too.  Only n-gram counts of the sample reach the driver.
    """
    chosen = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang").distinct()
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):  # parts of a language first, so that a common one is ranked by many tasks
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    chosen = chosen.select(F.col("doc_id").alias("own_id"), F.col("lang").alias("own"))

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = {"doc_id": [], "lang": [], "at": [], "v": []}
            for doc, lang, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "lang", "text"))):
                words = (text or "").split()
                short = [" ".join(words[len(words) // 3 :][:12])] if len(words) > 40 else []
                for part in [text, *short]:
                    codes = letter_codes(part)
                    if len(codes):
                        at, v = ngram_features(codes)
                        for c, value in zip(cols.values(), (doc, lang, at.astype(np.int32), v.astype(np.float32))):
                            c.append(value)
            return cols

        return kernel

    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), (F.col("lang") == F.col("own")) & (F.col("doc_id") == F.col("own_id"))).select("doc_id", "lang", "text")
    got = map_batches(rows, "doc_id bigint, lang string, at array<int>, v array<float>", make, rows=64).toArrow()
    doc, lang = got.column("doc_id").to_pylist(), got.column("lang").to_pylist()
    at, v = got.column("at").combine_chunks(), got.column("v").combine_chunks()
    rows = [(lang[i], np.asarray(at[i].values), np.asarray(v[i].values)) for i in range(len(doc))]
    order = sorted(range(len(rows)), key=lambda i: (doc[i], lang[i], len(rows[i][1]), rows[i][1][:4].tolist()))
    return fit_languages([rows[i] for i in order])


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score."""

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return kernel

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return map_batches(rows, "doc_id bigint, held_out boolean, lang_pred string, score double", make)
