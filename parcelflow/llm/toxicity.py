"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

``fold`` lower-cases, replaces homoglyphs and undoes digit substitutions, and sets words apart by single
blanks. Lexicon entries are whole words (blank on both sides) and word beginnings (blank before), with
weights learnt from labelled rows: log-odds less their standard error. Entries inside an exception phrase do not
count. A text's sum of weights, alone and divided by its length's root, goes through a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a model is fitted on, at most.
FIT_ROWS = 24_000
PREFIXES = (4, 5, 6)
#: An entry stands in so many toxic texts of the sample at least, and in so large a share of them; its weight is at least
#: ``MIN_LOG_ODDS``.
MIN_TOXIC, MIN_TOXIC_SHARE, MIN_LOG_ODDS = 3, 1 / 250, 1.0
THRESHOLD = 0.3
#: What a toxic text counts in the curve's fit, so that ``THRESHOLD`` lies where most of them are above it.
TOXIC_WEIGHT = 3.0

#: Look-alike letters of other scripts, and the digits and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ⅼ": "l", "ⅰ": "i", "ｌ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)} | _INVISIBLE
_SUBSTITUTE = {ord(k): v for k, v in SUBSTITUTES.items()}
_MIXED = re.compile(r"(?<![^\W_])(?=[\w@$!|]*[^\W\d_])(?=[\w@$!|]*[0134578@$!|])[\w@$|][\w@$!|]*[\w@$|]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """`` word word ... `` in lower case, without look-alikes, and with digits inside words read as letters."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if re.search(r"[0134578@$!|]", text):
        text = _MIXED.sub(lambda m: m[0].translate(_SUBSTITUTE), text)
    return f" {' '.join(_WORD.findall(text))} "


def terms(folded: str) -> set[str]:
    """The entries that a folded text offers: its words, and the beginnings of longer ones."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in PREFIXES:
        found.update(f" {w[:n]}" for w in words if len(w) > n)
    return found


@dataclass
class Lexicon:
    """A fitted model; small, so that it goes to tasks with their code."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._automaton = None

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            own = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                own.add_word(entry, (len(entry), weight, entry))
            for phrase in self.exceptions:
                own.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, None))
            if len(own):
                own.make_automaton()
            self._automaton = own
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, entry) of the heaviest entry of each word that no exception phrase covers."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, int, float, str]] = {}
        covers: list[tuple[int, int]] = []
        for last, (size, weight, entry) in self.automaton.iter(folded):
            start = last + 1 - size
            if entry is None:
                covers.append((start, last + 1))
            elif start not in best or weight > best[start][2]:
                best[start] = (start, last + 1, weight, entry)
        found, covers, reach, i = [best[s] for s in sorted(best)], sorted(covers), -1, 0
        free = []
        for h in found:  # both in order of their starts: the cover that reaches farthest so far decides
            while i < len(covers) and covers[i][0] <= h[0]:
                reach, i = max(reach, covers[i][1]), i + 1
            if h[1] > reach:
                free.append(h)
        return free

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        return _features(folded, self.hits(folded))

    def curved(self, x: float, y: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))

    def score(self, text: str | None) -> float:
        return self.curved(*self.features(text))


def _features(folded: str, hits: list[tuple]) -> tuple[float, float]:
    total = sum(h[2] for h in hits)
    return math.log1p(total), math.log1p(total / math.sqrt(max(1, folded.count(" ") - 1)))


def sample_labels(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` of the labelled identifiers (doc_id, toxic): all, or those whose hash falls below the share that
    gives nine tenths of the bound. No sort, and no text is read for it."""
    known = labels.filter(F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n = known.count()
    if n <= rows:
        return known
    step = 1 << 30
    return known.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(step)) < int(0.9 * rows / n * step)).limit(rows)


def _distinct(labelled: DataFrame) -> DataFrame:
    """(h, text, toxic) of the distinct labelled texts; one that has both labels is toxic."""
    text = F.coalesce("text", F.lit(""))
    hashed = labelled.filter(F.col("toxic").isNotNull()).select(F.xxhash64(F.lit(11), text).alias("h"), text.alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    return hashed.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def _summed(rows: DataFrame, offer) -> DataFrame:
    """(term, toxic, clean): documents of each kind that offer a term; counted in each task before the shuffle."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in common.batches(stream):
            for text, label in zip(b["text"], b["toxic"]):
                (toxic if label else clean).update(offer(fold(text)))
        keys = list(toxic.keys() | clean.keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], ["term", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, weight: float = TOXIC_WEIGHT) -> tuple[float, float, float]:
    """A ridge logistic fit by Newton steps, halved where they would lose ground; rows of label 1 count ``weight`` times."""
    design, w = np.column_stack([np.ones(len(x)), x]), np.array([-2.0, 0.0, 0.0])
    penalty, counts = np.diag([1e-3, 0.05, 0.05]), np.where(y > 0, weight, 1.0)

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float(counts @ (np.logaddexp(0, z) - y * z) + v @ penalty @ v / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (counts * p * (1 - p))[:, None]) + penalty
        step, size = np.linalg.solve(hessian, design.T @ (counts * (p - y)) + penalty @ w), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return tuple(float(v) for v in w)


def fit(labelled: DataFrame) -> Lexicon:
    """A lexicon from labelled texts (text, toxic), as many as ``sample_labels`` leaves. Three quarters of the distinct
    texts give the weights and phrases, the rest the curve. The sample's bound also bounds the lexicon, whose
    entries stand in ``MIN_TOXIC`` of its toxic texts at least, and in ``MIN_TOXIC_SHARE`` of them; none is cut off. Without both labels: an empty lexicon, whose
    score is constant."""
    common.small_batches(labelled.sparkSession)
    sample = common.checkpointed(_distinct(labelled.select("text", "toxic")))
    learn, tune = sample.filter(F.pmod("h", F.lit(4)) != 3), sample.filter(F.pmod("h", F.lit(4)) == 3)
    sizes = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({})
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    least = max(MIN_TOXIC, int(sizes[1] * MIN_TOXIC_SHARE))
    found = _summed(learn, terms).filter(F.col("toxic") >= least).withColumn("weight", odds - error).filter(F.col("weight") >= MIN_LOG_ODDS).collect()
    lexicon = Lexicon({r.term: r.weight for r in sorted(found)})

    def phrases(folded: str) -> set[str]:
        near = set()
        for start, end, _, _ in lexicon.hits(folded):
            stop = folded.find(" ", start + 1)
            after, before = folded.find(" ", stop + 1), folded.rfind(" ", 0, start)
            if after > 0:
                near.add(folded[start + 1 : after])
            if before >= 0:
                near.add(folded[before + 1 : stop])
        return near

    if found:
        benign = _summed(learn, phrases).filter((F.col("clean") >= 3) & (F.col("toxic") == 0)).collect()
        lexicon = Lexicon(lexicon.weights, sorted(r.term for r in benign))

    def measure(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            rows = [lexicon.features(t) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), pa.array(b["toxic"], pa.int32())], ["a", "b", "toxic"])

    points = tune.select("text", "toxic").mapInArrow(measure, "a double, b double, toxic int").collect()  # a part of the bounded sample
    if len({p.toxic for p in points}) == 2:
        lexicon.curve = _logistic(np.array([(p.a, p.b) for p in points]), np.array([p.toxic for p in points], float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1), ``predicted``, ``n_hits`` and the heaviest ``entry``, where
    the rows lie. Null and empty texts score as texts without hits; rows that repeat score alike; an empty table has no
    rows; columns of these four names are replaced. The time is in proportion to a text's length, however long it is."""
    common.small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for text in batch.column(at).to_pylist():
                folded = fold(text)
                hits = lexicon.hits(folded)
                p = lexicon.curved(*_features(folded, hits))
                rows.append((p, int(p >= threshold), len(hits), max(hits, key=lambda h: h[2])[3].strip() if hits else None))
            more = [pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.float64(), pa.int32(), pa.int32(), pa.string()])]
            keep = [i for i, n in enumerate(names) if n not in _ADDED]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + more, [names[i] for i in keep] + list(_ADDED))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in _ADDED)
    return docs.mapInArrow(one, kept + ", score double, predicted int, n_hits int, entry string")


_ADDED = ("score", "predicted", "n_hits", "entry")


def held_out(doc_id: str = "doc_id") -> "F.Column":
    """Rows that no model may learn from: crc32 of the identifier's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_from_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from a bounded sample of the labelled documents that are not held out. The sample's identifiers, ``rows``
    at most, are broadcast, so that the documents are scanned and not shuffled."""
    known = sample_labels(labels.filter(~held_out()), rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
