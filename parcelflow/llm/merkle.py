"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into sections (at blank lines), paragraphs (at line ends) and leaves (at sentence marks, and
after ``LEAF_CHARS`` characters at the latest). The pieces, one after another, are the text. A leaf's hash
is that of its bytes, a node's that of its children's hashes and kind. Equal roots mean equal texts;
below unequal ones only differing branches are compared, down to the leaves that were edited.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAF_CHARS = 64
_SECTION = re.compile(r".+?(?:\n[^\S\n]*(?:\n[^\S\n]*)+|\Z)", re.S)
_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
_LEAF = re.compile(rf"[^.!?]{{0,{LEAF_CHARS - 1}}}(?:[.!?]+\s?|[^.!?])", re.S)

Node = tuple  # (hash, chars, children or None)


def _digest(kind: bytes, parts: list[bytes]) -> bytes:
    return hashlib.blake2b(kind + b"".join(parts), digest_size=16).digest()


def _leaves(paragraph: str) -> list[Node]:
    own = hashlib.blake2b
    return [(own(b"L" + piece.encode("utf-8", "replace"), digest_size=16).digest(), len(piece), None) for piece in _LEAF.findall(paragraph)]


def _node(kind: bytes, children: list[Node]) -> Node:
    return _digest(kind, [c[0] for c in children]), sum(c[1] for c in children), children


def tree(text: str | None) -> Node:
    """The tree of a text; its hash is the root. Null is as empty."""
    text = text or ""
    sections = _SECTION.findall(text) if "\n" in text else [text] if text else []
    return _node(b"R", [_node(b"S", [_node(b"P", _leaves(p)) for p in _PARAGRAPH.findall(s)]) for s in sections])


def shared_chars(a: list[Node], b: list[Node]) -> int:
    """Characters in branches that both sides have, wherever they stand; only differing branches are opened."""
    spare = Counter(n[0] for n in b)
    common_chars, rest = 0, []
    for n in a:
        if spare[n[0]] > 0:
            spare[n[0]] -= 1
            common_chars += n[1]
        else:
            rest.append(n)
    if rest and rest[0][2] is not None:
        other = []
        for n in b:
            if spare[n[0]] > 0:
                spare[n[0]] -= 1
                other.append(n)
        below = lambda nodes: [c for n in nodes for c in n[2]]
        if other:
            common_chars += shared_chars(below(rest), below(other))
    return common_chars


def likeness(a: Node, b: Node) -> float:
    """0 to 1: the characters in common branches against those of both texts; 1 for equal roots alone."""
    if a[0] == b[0]:
        return 1.0
    return 2 * shared_chars(a[2], b[2]) / (a[1] + b[1]) if a[1] + b[1] else 1.0


def edits(a: Node, b: Node) -> list[tuple[int, int, int, int]]:
    """Spans (from, to in a; from, to in b) around differing branches, top down by position: equal branches at
    either end are skipped without being opened."""
    if a[0] == b[0]:
        return []

    def walk(x: list[Node], y: list[Node], i: int, j: int) -> tuple[int, int, int, int]:
        while x and y and x[0][0] == y[0][0]:
            i, j, x, y = i + x[0][1], j + y[0][1], x[1:], y[1:]
        while x and y and x[-1][0] == y[-1][0]:
            x, y = x[:-1], y[:-1]
        if len(x) == 1 and len(y) == 1 and x[0][2] is not None:
            return walk(x[0][2], y[0][2], i, j)
        return i, i + sum(n[1] for n in x), j, j + sum(n[1] for n in y)

    return [walk(a[2], b[2], 0, 0)]


def stored_tree(tree_: Node) -> bytes:
    """A tree as bytes: the numbers of sections, paragraphs and leaves (4 bytes each), the paragraphs of each section, the
    leaves of each paragraph and the characters of each leaf (4 bytes each, little-endian), and the hashes of the leaves.
    All other hashes follow from these."""
    sections = tree_[2]
    paragraphs = [p for s in sections for p in s[2]]
    leaves = [leaf for p in paragraphs for leaf in p[2]]
    counts = [len(sections), len(paragraphs), len(leaves), *(len(s[2]) for s in sections), *(len(p[2]) for p in paragraphs), *(leaf[1] for leaf in leaves)]
    return np.array(counts, "<u4").tobytes() + b"".join([leaf[0] for leaf in leaves])


def read_tree(raw: bytes) -> Node:
    """The tree that ``stored_tree`` wrote."""
    n = np.frombuffer(raw, "<u4", 3).tolist()
    counts = np.frombuffer(raw, "<u4", sum(n), 12).tolist()
    hashes = raw[12 + 4 * sum(n) :]
    leaves = iter([(hashes[16 * i : 16 * i + 16], chars, None) for i, chars in enumerate(counts[n[0] + n[1] :])])
    paragraphs = iter([_node(b"P", [next(leaves) for _ in range(k)]) for k in counts[n[0] : n[0] + n[1]]])
    return _node(b"R", [_node(b"S", [next(paragraphs) for _ in range(k)]) for k in counts[: n[0]]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, root, n_sections, n_paragraphs and n_leaves of every whole text, where it lies."""
    common.small_batches(docs.sparkSession)

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            trees = [tree(t) for t in b["text"]]
            counts = [(t[1], len(t[2]), sum(len(s[2]) for s in t[2]), sum(len(p[2]) for s in t[2] for p in s[2])) for t in trees]
            yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array([t[0].hex() for t in trees], pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4))], ["doc_id", "root", "n_chars", "n_sections", "n_paragraphs", "n_leaves"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(one, "doc_id long, root string, n_chars long, n_sections long, n_paragraphs long, n_leaves long")


def with_successor(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (doc_id, text, guest) dealt to ranges of doc_id and sorted within them, each range followed by the
    first row of the next one (guest = 1), the last by the first of all. One shuffle of the texts; what the
    driver sees is an identifier for each range."""
    spark = docs.sparkSession
    n = parts or common.partitions(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = sorted(set(common.range_bounds(own.select("doc_id"), "doc_id", n)))
    place = common.range_id("doc_id", bounds)
    first = own.select("doc_id", place.alias("part")).groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    used = sorted((r.part, None if r.nulls else r.first_id) for r in first.collect())  # an identifier for each range
    # the last range hosts the first row of all; a row for each range, so that the side to broadcast is bounded
    hosts = spark.createDataFrame([(used[i][1], used[i - 1][0]) for i in range(len(used))], "first_id long, host int")
    placed = own.select("doc_id", "text", place.cast("int").alias("part")).join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    spot = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    spots = F.when(F.col("host").isNull(), F.array(spot(F.col("part"), 0))).otherwise(F.array(spot(F.col("part"), 0), spot(F.col("host"), 1)))
    dealt = placed.select("doc_id", "text", F.explode(spots).alias("to")).select("doc_id", "text", "to.guest", "to.part")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).select("doc_id", "text", "guest")


def compare_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document against an edited text and against the next document in order of doc_id.

    The edited text is the document with its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next one's. Null text is empty; a null doc_id comes before all others; rows that repeat a
    doc_id follow one another in order of text; the only row of a table is its own successor. An empty table: no rows.
    Other columns are ignored. ``fingerprint`` is the root's hash, equal for equal texts alone; ``tree`` and
    ``edited_tree`` hold what lies below it (see ``stored_tree``), so that ``likeness`` of what ``read_tree`` makes of them
    gives near_edited, and that of two rows' trees near_next. A task holds two texts and three trees at a time.
    """
    common.small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_from", "edit_to", "tree", "edited_tree"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def against(doc_id: int | None, text: str, own: Node, following: str, other: Node) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = tree(edited)
        spans = edits(own, changed)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[0].hex(), changed[0].hex(), likeness(own, changed), likeness(own, other), *(spans[0][:2] if spans else (None, None)), stored_tree(own), stored_tree(changed)

    def slide(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in common.batches(stream):
            for doc_id, text, guest in zip(b["doc_id"], b["text"], b["guest"]):
                if held is not None and held[3]:
                    break  # a later guest with the same identifier
                here = (doc_id, text or "", tree(text), guest)
                if held is not None:
                    rows.append(against(*held[:3], *here[1:3]))
                held = here
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []

    return with_successor(docs, parts).mapInArrow(slide, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_from long, edit_to long, tree binary, edited_tree binary")
