"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes (insult, threat, target, negation, report, quote, plain) with weights.  Small
transducers - reported speech, negation, target, threat, wish of harm - each rewrite the class string
of a text; they are composed with one that weighs what they write into one machine, whose arcs give
each insult or threat its factor.  A clause's score is the sum of its words' weights times the factors
of their arcs, so the same word counts more when aimed at someone and less when negated or reported.
Targets count before and after an insult; reported speech goes on behind a colon to the end of the
sentence, and between quotation marks over as many sentences as they hold.  A logistic curve over the
strongest clause and the sum of the clauses gives the score.

Insults are the fixed list below and words learned from labelled texts: those that stand in many
unrelated toxic texts and next to none of the others.  Near copies of one text count once.  How many
texts a word needs, and the factors of the arcs, are chosen by two folds of the training rows.

Edge cases, all defined: a null or empty text has no clause and gets the score of such texts; texts
are read whole; repeated rows get equal results; an empty table gives an empty result; without labels
of both kinds the fixed list and a fixed curve are used; only doc_id and text are read to score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches

#: Labelled documents that are learned from, at most.
MAX_TRAIN_DOCS = 12_000
#: Words of each class in English, French, German and Spanish.
INSULTS = (
    "bastard clown coward creep cretin disgusting dumb fool freak garbage idiot imbecile jerk loser moron pathetic pig scum stupid trash vermin worthless "
    "abruti connard crétin débile idiote imbécile minable ordure pourriture salaud "
    "abschaum arschloch blödmann dummkopf idiotin mistkerl trottel versager "
    "basura cabrón cobarde escoria estúpida estúpido idiota imbécil inútil payaso"
).split()
THREATS = "attack beat burn crush destroy hurt kill murder punch shoot stab strangle tuer frapper détruire töten umbringen schlagen matar golpear destruir".split()
PASSIVES = "attacked beaten burned burnt crushed destroyed hanged hurt killed murdered punched shot stabbed strangled".split()
HATES = "despise detest hate loathe".split()
TARGETS = "he her him she their them they thou you your yours u il elle ils toi tu vous er sie du dich dir ihr él ella ellos tú usted ustedes vosotros".split()
NEGATIONS = "ain't cannot can't don't isn't neither never no none nor not without aucun jamais ne ni pas kein keine nicht nie niemals jamás ni ninguno nunca tampoco".split()
REPORTS = "alleged call called calls claimed claims quote quoted quotes reported reports said say says shouted told wrote a-t-il dit disait sagte sagt schrieb dijo dice escribió".split()

PLAIN, INSULT, THREAT, PASSIVE, HATE, BE, TARGET, NEGATION, REPORT, QUOTE, COLON, STOP, BREAK = "xitphbynrqcs/"
#: What the transducers write, and the factor that the last of them puts on its arc before any is learned: a bare,
#: aimed, negated and reported insult (and a target behind one); a bare, aimed, negated and reported threat; an aimed wish of harm; aimed hate.
FACTORS = {"i": 1.0, "I": 1.5, "j": 0.3, "k": 0.4, "a": 0.5, "t": 0.2, "T": 1.5, "u": 0.1, "v": 0.4, "P": 1.0, "H": 0.6}
ENDS = (COLON, STOP, BREAK)

WORD_RE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
TOKEN_RE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?;:\n]|[\"“”«»]")
MARKS = {".": STOP, "!": STOP, "?": STOP, ";": STOP, ":": COLON, "\n": BREAK} | dict.fromkeys('"“”«»', QUOTE)


class Transducer:
    """A deterministic weighted letter transducer: ``step(state, symbol)`` gives (state, symbol, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def run(self, symbols: str) -> tuple[str, list[float]]:
        """What it writes, and the weight of each arc."""
        state, out, weights = self.start, [], []
        for s in symbols:
            state, s, w = self.step(state, s)
            out.append(s)
            weights.append(w)
        return "".join(out), weights

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads; weights multiply; arcs are built as they are met."""
        arcs: dict = {}

        def step(state, symbol):
            got = arcs.get((state, symbol))
            if got is None:
                left, middle, w = self.step(state[0], symbol)
                right, out, v = other.step(state[1], middle)
                got = arcs[state, symbol] = ((left, right), out, w * v)
            return got

        return Transducer((self.start, other.start), step)


def _within(trigger: str, marks: dict[str, str], reach: int) -> Transducer:
    """Rewrites by ``marks`` what follows ``trigger`` within ``reach`` words of a clause."""

    def step(left: int, s: str):
        if s == trigger:
            return reach, s, 1.0
        if s in ENDS:
            return 0, s, 1.0
        return max(0, left - 1), marks.get(s, s) if left else s, 1.0

    return Transducer(0, step)


def _reported() -> Transducer:
    """After a word of reporting, the rest of the sentence is reported, behind a colon too; between quotation marks all
    is, over sentences.  A line break ends both."""
    marks = {INSULT: "k", THREAT: "v", PASSIVE: PLAIN, HATE: PLAIN}

    def step(state, s: str):
        told, quoted = state
        if s == QUOTE:
            return (told, not quoted), s, 1.0
        if s == REPORT:
            return (True, quoted), s, 1.0
        if s == BREAK:
            return (False, False), s, 1.0
        if s == STOP:
            return (False, quoted), s, 1.0
        return state, marks.get(s, s) if told or quoted else s, 1.0

    return Transducer((False, False), step)


def _behind(sources: dict[str, str], reach: int) -> Transducer:
    """A target that follows one of ``sources`` within ``reach`` words is written as its mark, once for each of them."""

    def step(state, s: str):
        left, mark = state
        if s in sources:
            return (reach, sources[s]), s, 1.0
        if s in ENDS:
            return (0, ""), s, 1.0
        if s == TARGET and left:
            return (0, ""), mark, 1.0
        return (max(0, left - 1), mark) if left > 1 else (0, ""), s, 1.0

    return Transducer((0, ""), step)


def _wished() -> Transducer:
    """Harm that a target is to suffer: target, then "be", then a passive, a few words apart."""

    def step(state, s: str):
        stage, left = state
        if s in ENDS:
            return (0, 0), s, 1.0
        if s == TARGET:
            return (1, 5), s, 1.0
        if s == BE and stage == 1 and left:
            return (2, 3), s, 1.0
        if s == PASSIVE and stage == 2 and left:
            return (0, 0), "P", 1.0
        return (stage, left - 1) if left > 1 else (0, 0), s, 1.0

    return Transducer((0, 0), step)


def _weighed(factors: dict[str, float]) -> Transducer:
    """One state; its arcs carry the factors, and 0 for what is no mark."""
    return Transducer(0, lambda state, s: (0, s, factors.get(s, 0.0)))


def grammar(factors: dict[str, float] = FACTORS, reach: int = 4) -> Transducer:
    """Reported speech, negation, wishes of harm, targets before and behind, and the weighing of what they write, composed."""
    negated = _within(NEGATION, {INSULT: "j", THREAT: "u", PASSIVE: PLAIN, HATE: PLAIN}, 3)
    aimed = _within(TARGET, {INSULT: "I"}, reach)
    behind = _behind({INSULT: "a", THREAT: "T", HATE: "H"}, reach)
    return _reported().then(negated).then(_wished()).then(aimed).then(behind).then(_weighed(factors))


@dataclass
class ToxicityModel:
    #: Weight of each insult; fixed ones weigh 1 at least.
    insults: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))
    #: Intercept, and factors of the strongest clause and of the capped sum of clauses.
    curve: tuple[float, float, float] = (-3.0, 3.0, 1.0)
    #: Factors on the arcs of the machine.
    factors: dict[str, float] = field(default_factory=lambda: dict(FACTORS))

    def __post_init__(self):
        classes = ((PASSIVES, PASSIVE), (HATES, HATE), (("be",), BE), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (self.insults, INSULT))
        self.classes = {w: c for names, c in classes for w in names}
        self.triggers = frozenset((*self.insults, *THREATS, *PASSIVES, *HATES))
        self.machine = grammar(self.factors)

    def scan(self, text: str | None) -> Iterator[list[tuple[str, float, float]]]:
        """Per clause with a mark: (mark, weight of the word, weight of the arc) of each."""
        low = (text or "").lower()
        if self.triggers.isdisjoint(WORD_RE.findall(low)):
            return
        here, last, state, step = [], 1.0, self.machine.start, self.machine.step
        for token in TOKEN_RE.findall(low):
            symbol = MARKS.get(token) or self.classes.get(token, PLAIN)
            state, mark, arc = step(state, symbol)
            if mark in ENDS:
                if here:
                    yield here
                    here = []
            elif mark in FACTORS:
                if symbol == INSULT:
                    last = self.insults[token]
                # a target behind an insult stands for that insult
                here.append((mark, last if mark == "a" or symbol == INSULT else 1.0, arc))
        if here:
            yield here

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that hold a mark: weights of words times weights of arcs."""
        return [sum(word * arc for _, word, arc in x) for x in self.scan(text)]

    def marked(self, text: str | None) -> list[dict[str, float]]:
        """Per clause with a mark: how much weight of words each mark has."""
        out = []
        for x in self.scan(text):
            out.append({})
            for mark, word, _ in x:
                out[-1][mark] = out[-1].get(mark, 0.0) + word
        return out

    def weigh(self, found: list[dict[str, float]]) -> list[float]:
        return [sum(w * self.factors[m] for m, w in x.items()) for x in found]

    @staticmethod
    def measure(found: list[float]) -> tuple[float, float]:
        return (min(4.0, max(found)), min(4.0, math.log1p(sum(found)))) if found else (0.0, 0.0)

    def score(self, found: list[float]) -> float:
        """The score of a text from its clauses."""
        top, total = self.measure(found)
        z = self.curve[0] + self.curve[1] * top + self.curve[2] * total
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_curve(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Logistic regression with a small ridge by Newton steps; factors are not let below 0."""
    x = np.array([(1.0, a, b) for a, b, _ in rows])
    y = np.array([r[2] for r in rows], float)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
    return float(w[0]), float(max(0.0, w[1])), float(max(0.0, w[2]))


def log_loss(rows: list[tuple[float, float, int]], curve: tuple[float, float, float]) -> float:
    x = np.array([(1.0, a, b) for a, b, _ in rows])
    z = np.clip(x @ np.array(curve), -30, 30) * np.where(np.array([r[2] for r in rows]) > 0, 1, -1)
    return float(np.logaddexp(0, -z).sum())


def fit_factors(texts: list[tuple[int, list[dict[str, float]], int]], steps: tuple[float, ...] = (0.5, 2.0), least: int = 20) -> dict[str, float]:
    """Factors of the arcs, one after the other, each changed where the curve of one fold then loses less on the other.

    ``texts``: (fold, marks of the clauses, toxic).  A mark that fewer than ``least`` texts have keeps its factor, and a
    factor moves only if the loss falls by one unit at least.
    """
    marks = list(FACTORS)
    held = {m: sum(any(m in x for x in found) for _, found, _ in texts) for m in marks}
    fold, toxic = np.array([t[0] for t in texts]), np.array([t[2] for t in texts])
    clauses = np.array([[x.get(m, 0.0) for m in marks] for _, found, _ in texts for x in found]).reshape(-1, len(marks))
    owner = np.repeat(np.arange(len(texts)), [len(found) for _, found, _ in texts])

    def loss(factors: dict[str, float]) -> float:
        scores = clauses @ np.array([factors[m] for m in marks])
        top, total = np.zeros(len(texts)), np.zeros(len(texts))
        np.maximum.at(top, owner, scores)
        np.add.at(total, owner, scores)
        rows = list(zip(np.minimum(4.0, top).tolist(), np.minimum(4.0, np.log1p(total)).tolist(), toxic.tolist()))
        parts = [[r for r, f in zip(rows, fold) if f == k] for k in (0, 1)]
        if any(len({r[2] for r in part}) < 2 for part in parts):
            return 0.0
        return sum(log_loss(parts[1 - k], fit_curve(parts[k])) for k in (0, 1))

    best, now = loss(FACTORS), dict(FACTORS)
    for m in marks:
        if held[m] >= least:
            for s in steps:
                trial = {**now, m: FACTORS[m] * s}
                got = loss(trial)
                if got < best - 1.0:
                    best, now = got, trial
    return now


def learned(words: list, sizes: dict[tuple[bool, int], int], shares: tuple[float, ...], least: int) -> dict[str, float]:
    """Log odds of the words that are learned as insults.

    ``words``: (word, texts by (toxic, fold)); the share of the toxic sample that a word needs is the one whose words,
    taken from one fold, stand in most toxic texts of the other for five times as few clean ones.
    """

    def odds(bad: int, good: int, n_bad: int, n_good: int) -> float:
        return math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))

    total = {y: sizes.get((y, 0), 0) + sizes.get((y, 1), 0) for y in (True, False)}

    def gain(share: float) -> float:
        out = 0.0
        for k in (0, 1):
            n_bad, n_good = (sizes.get((y, k), 0) for y in (True, False))
            m_bad, m_good = (max(1, sizes.get((y, 1 - k), 0)) for y in (True, False))
            for _, c in words:
                if c[True, k] >= max(least / 2, share * n_bad) and odds(c[True, k], c[False, k], n_bad, n_good) > 2.5:
                    out += c[True, 1 - k] / m_bad - 5 * c[False, 1 - k] / m_good
        return out

    share = max(shares, key=lambda s: (round(gain(s), 9), s))
    out = {}
    for word, c in words:
        bad, good = c[True, 0] + c[True, 1], c[False, 0] + c[False, 1]
        value = odds(bad, good, total[True], total[False])
        if bad >= max(least, share * total[True]) and value > 2.5:
            out[word] = value
    return out


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, least: int = 4, shares: tuple[float, ...] = (0.0025, 0.005, 0.01)) -> ToxicityModel:
    """Learn words, factors and the curve from at most ``max_docs`` labelled documents outside the held-out fold.

    Half of the sample at most is of either label, chosen by hash.  A word's count is that of the
    different least word hashes of the texts that hold it, which near copies share; a learned word has
    ``least`` toxic ones, and a share of the toxic sample that folds of the sample choose.  Only words with
    ``least / 2`` toxic texts in one fold reach the driver, which the sample bounds.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    take = lambda y: usable.where(F.col("toxic") > 0 if y else F.col("toxic") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2)
    chosen = take(1).unionByName(take(0)).select(F.col("doc_id").alias("own"), "toxic", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("fold"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("own")).select("doc_id", "text", "toxic", "fold")

    def words():
        def kernel(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = {"word": [], "family": [], "toxic": []}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = set(WORD_RE.findall((text or "").lower()))
                if found:
                    family = min(xxhash.xxh3_64_intdigest(w) for w in found) >> 1
                    cols["word"] += found
                    cols["family"] += [family] * len(found)
                    cols["toxic"] += [toxic] * len(found)
            return cols

        return kernel

    counted = map_batches(rows, "word string, family bigint, toxic int", words, rows=128)
    # copies of one text belong to one fold
    counted = counted.groupBy("word", "family").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("clean"), F.pmod(F.xxhash64("family"), F.lit(2)).alias("fold"))
    kinds = {(y, k): f"{'bad' if y else 'good'}_{k}" for y in (True, False) for k in (0, 1)}
    counted = counted.groupBy("word").agg(*(F.sum(F.when((F.col("toxic") > 0 if y else F.col("clean") <= 0) & (F.col("fold") == k), 1).otherwise(0)).alias(c) for (y, k), c in kinds.items()))
    sizes = {(bool(r[0]), r[1]): r[2] for r in chosen.groupBy(F.col("toxic") > 0, "fold").count().collect()}
    if len({y for y, _ in sizes}) < 2:
        return ToxicityModel()
    total = lambda y: sizes.get((y, 0), 0) + sizes.get((y, 1), 0)
    found = counted.where((F.greatest("bad_0", "bad_1") >= least / 2) & ((F.col("bad_0") + F.col("bad_1")) * total(False) > (F.col("good_0") + F.col("good_1")) * total(True))).orderBy("word").collect()
    best = learned([(r.word, {k: r[c] for k, c in kinds.items()}) for r in found], sizes, shares, least)
    insults = dict.fromkeys(INSULTS, 1.0) | {w: max(1.0, v / 3) if w in INSULTS else v / 3 for w, v in best.items()}
    for word in (*NEGATIONS, *REPORTS, *TARGETS, *THREATS, *PASSIVES, *HATES, "be"):
        insults.pop(word, None)
    model = ToxicityModel(insults)

    def measured():
        def kernel(batch: pa.RecordBatch) -> dict:
            found = []
            for text in batch.column("text").to_pylist():
                # equal clauses of a text are sent once, with their number
                once: dict[tuple, int] = {}
                for x in model.marked(text):
                    key = tuple(sorted(x.items()))
                    once[key] = once.get(key, 0) + 1
                found.append([{"marks": "".join(m for m, _ in k), "weights": [w for _, w in k], "times": n} for k, n in once.items()])
            return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "fold": batch.column("fold"), "found": found}

        return kernel

    got = map_batches(rows, "doc_id bigint, toxic int, fold int, found array<struct<marks: string, weights: array<double>, times: int>>", measured, rows=64).collect()
    texts = [(r.fold, [dict(zip(x.marks, x.weights)) for x in r.found for _ in range(x.times)], int(r.toxic > 0)) for r in sorted(got, key=lambda r: (r.doc_id, len(r.found)))]
    if not texts:
        return model
    model = ToxicityModel(insults, factors=fit_factors(texts))
    return ToxicityModel(insults, fit_curve([(*model.measure(model.weigh(found)), y) for _, found, y in texts]), model.factors)


def score_texts(docs: DataFrame, model: ToxicityModel, cut: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted and the number of clauses that matched."""

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = {"score": [], "predicted": [], "n_clauses": []}
            for text in batch.column("text").to_pylist():
                found = model.clauses(text)
                score = model.score(found)
                for c, v in zip(cols.values(), (score, int(score >= cut), len(found))):
                    c.append(v)
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), **cols}

        return kernel

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return map_batches(rows, "doc_id bigint, held_out boolean, score double, predicted int, n_clauses int", make)
