"""Quality by nearest-neighbour voting in a latent space.

A text is a bag of terms: its words, its tokens' *forms* (letters as ``a`` and ``A``, digits as ``0``, signs as they are) and
how much it repeats itself. Terms are hashed to a fixed number of dimensions, weighted by log frequency and rarity, and
the three kinds of a text get a fixed share of its length each. A truncated singular value decomposition of a bounded
sample of labelled texts gives the latent axes. The sample's latent vectors go to every task with their labels; there
blocks of documents are multiplied with all of them, exactly, and the nearest vote with a power of their cosines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import held_out

#: Labelled texts that a model is fitted on, at most: what tasks get is this times ``AXES``.
FIT_ROWS = 6_000
#: Dimensions of words, forms and repetition before the decomposition, and each kind's share of a text's squared length.
DIMENSIONS, SHARES = (1024, 512, 64), (0.2, 0.5, 0.3)
AXES = 48
NEIGHBOURS, POWER = 25, 8
THRESHOLD = 0.7
#: Documents of a block, and tokens whose terms a worker keeps (both bound memory and change no result).
BLOCK, MEMO = 512, 300_000

_OFFSETS = (0, DIMENSIONS[0], DIMENSIONS[0] + DIMENSIONS[1], sum(DIMENSIONS))
_PLAIN = re.compile(r"[a-z]+[.,;:]?")
_memo: dict[str, tuple[int, int]] = {}


def form(token: str) -> str:
    """``Aa***`` for ``Some***``: runs of letters and digits as one sign, other signs as they are, up to three alike."""
    signs = "".join("0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in token)
    return re.sub(r"(.)\1{2,}", r"\1\1\1", re.sub(r"([aA0])\1+", r"\1", signs))[:24]


def _slot(kind: int, term: str) -> int:
    return _OFFSETS[kind] + xxhash.xxh64_intdigest(term.encode("utf-8", "replace"), kind) % DIMENSIONS[kind]


def _token(token: str) -> tuple[int, int]:
    known = _memo.get(token)
    if known is None:
        if len(_memo) > MEMO:
            _memo.clear()
        word = re.sub(r"\W+", "", token).lower()
        known = (_slot(0, word), _slot(1, form(token)))
        if len(token) < 64:
            _memo[token] = known
    return known


def _level(share: float) -> int:
    return min(7, int(share * 8))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of a whole text's terms; without words its only term says so."""
    text = text or ""
    tokens = text.split()
    if not tokens:
        return np.array([_slot(2, "empty")]), np.ones(1)
    seen = Counter(tokens)
    slots, counts = [], []
    for token, n in seen.items():
        slots += _token(token)
        counts += (n, n)
    lines = text.split("\n")
    threes = len(set(zip(tokens, tokens[1:], tokens[2:]))) / max(1, len(tokens) - 2)
    size = min(12, int(math.log2(len(tokens))))
    repeats = [f"three {_level(threes)}", f"most {_level(max(seen.values()) / len(tokens))}", f"lines {_level(len(set(lines)) / len(lines))}", f"own {size} {_level(len(seen) / len(tokens))}", f"size {size // 2}"]
    slots += [_slot(2, r) for r in repeats]
    counts += [1] * len(repeats)
    return np.array(slots), np.array(counts, float)


@dataclass
class Neighbours:
    """A fitted model: rarity by dimension, latent axes, the sample's latent vectors (unit length) and labels, the curve."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)

    def latent(self, texts: list[str | None]) -> np.ndarray:
        return _unit(weigh([bag(t) for t in texts], self.rarity) @ self.axes)

    def votes(self, vectors: np.ndarray, own: int | None = None) -> np.ndarray:
        """The share of label 1 among the nearest of the sample, by their cosines with each of it. ``own``: the vectors are
        the sample's from that place on, and none votes for itself."""
        near = vectors @ self.vectors.T
        if own is not None:
            near[np.arange(len(near)), own + np.arange(len(near))] = -1
        k = min(NEIGHBOURS, near.shape[1] - (own is not None))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6).astype(float) ** POWER
        return (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(texts), 0.5)
        return self.curved(self.votes(self.latent(texts)))

    def curved(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * (2 * votes - 1))))


def weigh(bags: list[tuple[np.ndarray, np.ndarray]], rarity: np.ndarray | None) -> np.ndarray:
    """A dense row for each bag: log counts by rarity, each kind of unit length times its share."""
    rows = np.zeros((len(bags), _OFFSETS[-1]), np.float32)
    for row, (slots, counts) in zip(rows, bags):
        row += np.bincount(slots, counts, _OFFSETS[-1]).astype(np.float32)
    np.log1p(rows, out=rows)
    if rarity is not None:
        rows *= rarity
    for kind, share in enumerate(SHARES):
        part = rows[:, _OFFSETS[kind] : _OFFSETS[kind + 1]]
        part *= math.sqrt(share) / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return rows


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(h, text, quality) of at most ``rows`` labelled texts that are not held out, each distinct text once (with both
    labels: the lower); all, or those with the least hashes of their identifiers."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = known.distinct().orderBy(F.xxhash64(F.lit(12), "doc_id"), "doc_id", "quality").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy(F.xxhash64(F.lit(12), "text").alias("h")).agg(F.first("text").alias("text"), F.min("quality").alias("quality"))


def fit(labelled: DataFrame) -> Neighbours:
    """A model from labelled texts (h, text, quality), as ``sample`` bounds them. Tasks make the bags; the bags, some
    hundred numbers for each text, are decomposed by the driver. Without both labels the score is 0.5 everywhere."""
    common.small_batches(labelled.sparkSession)

    def bags_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            found = []
            for slots, counts in map(bag, b["text"]):  # one entry for each dimension, at most ``DIMENSIONS`` in all
                summed = np.bincount(slots, counts, _OFFSETS[-1])
                at = np.flatnonzero(summed)
                found.append((at, summed[at]))
            yield pa.RecordBatch.from_arrays([pa.array(b["h"], pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int16())), pa.array([f[1] for f in found], pa.list_(pa.float32())), pa.array(b["quality"], pa.int32())], ["h", "slots", "counts", "quality"])

    rows = labelled.mapInArrow(bags_of, "h long, slots array<smallint>, counts array<float>, quality int").toArrow()
    order = np.argsort(rows["h"].to_numpy(), kind="stable")
    labels = rows["quality"].to_numpy()[order].astype(float)
    if len(set(labels.tolist())) < 2:
        return Neighbours(np.ones(_OFFSETS[-1], np.float32), np.zeros((_OFFSETS[-1], 1), np.float32), np.zeros((0, 1), np.float32), labels[:0])
    slots, counts = (rows[c].combine_chunks() for c in ("slots", "counts"))
    bags = [(slots[int(i)].values.to_numpy().astype(np.int64), counts[int(i)].values.to_numpy()) for i in order]
    plain = weigh(bags, None)
    rarity = (np.log((1 + len(bags)) / (1 + (plain > 0).sum(axis=0))) + 0.1).astype(np.float32)
    table = weigh(bags, rarity)
    values, vectors = np.linalg.eigh((table.T @ table).astype(float))
    axes = vectors[:, ::-1][:, : min(AXES, len(bags))].astype(np.float32)
    model = Neighbours(rarity, axes, _unit(table @ axes), labels)
    own = [model.votes(model.vectors[i : i + BLOCK], i) for i in range(0, len(labels), BLOCK)]
    model.curve = _curve(np.concatenate(own), labels)
    return model


def _curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The slope is fixed; the point of equal odds between both labels' votes, each label counting as much as the other, is
    put at ``THRESHOLD``."""
    grid = np.linspace(0.02, 0.98, 97)
    right = [((votes[labels > 0] >= g).mean() + (votes[labels < 1] < g).mean()) for g in grid]
    at = float(grid[np.flatnonzero(np.isclose(right, max(right)))].mean())
    slope = 4.0
    return math.log(THRESHOLD / (1 - THRESHOLD)) - slope * (2 * at - 1), slope


def score(docs: DataFrame, model: Neighbours, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every whole text, where the rows lie. Null and empty texts are alike and are
    scored as any other; rows that repeat score alike; an empty table has no rows; other columns are ignored, whatever
    their names. The time is in proportion to a text's length, however long it is."""
    common.small_batches(docs.sparkSession)

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            for i in range(0, len(b["text"]), BLOCK):
                p = model.score(b["text"][i : i + BLOCK])
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"][i : i + BLOCK], pa.int64()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(one, "doc_id long, score double, predicted int")
