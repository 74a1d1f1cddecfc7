"""Suffix arrays by linear grouping, and the removal of repeated byte strings that builds on them.

``suffix_array`` sorts the suffixes of a sequence of numbers in two phases. The first gathers suffixes by their
Lyndon prefixes: groups are taken in descending order; the previous-smaller pointer of each member names the
suffix whose prefix the group's prefix lengthens, and these move to new groups right behind their old ones.
The second walks the groups in ascending order and emits each group's suffixes in the order in which their
successors come; no ranks are renamed and nothing recurses.

``remove_repeats`` finds every byte that a string of ``length`` bytes covers which also starts elsewhere:

1. Every start of such a string belongs to one *anchor*: the place of the smallest hash of ``KGRAM`` bytes in the
   string (the last of equals), which depends on the string alone. Starts with one anchor are neighbours, a *run*.
   Equal strings have equal k-grams at equal places, so that only runs whose k-grams are equal can hold them.
2. Runs are counted by k-gram and by the hash of all the bytes that they cover. A run of which there is another
   copy is repeated as a whole. What is left, where a k-gram repeats but its surroundings differ, is a small part.
3. For that part the bytes are fetched. A k-gram's runs are cut, on a grid that its anchor fixes, to blocks; one
   suffix array over the blocks of many k-grams gives the longest repeat at each block. Starts whose inner blocks
   do not repeat are free, and those whose covering blocks repeat are not; for the others, where a string's ends cut
   a block, an exact comparison of the strings' bytes (by 64-bit hashes of each) follows.

With ``words``, strings of so many words are removed as well, whatever their bytes: the same search goes over symbols of
``WORD`` bytes, the words' hashes, in place of symbols of one byte. The byte search then only follows strings of fewer words.

A k-gram with more than ``GROUP_RUNS`` differing runs is dealt again by halves: the starts of a half share more
bytes, which join the key, until groups are small or a run is a single start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Words of a passage that counts as repeated beside the bytes that are removed.
PASSAGE_WORDS = 51
KGRAM = 160
#: Blocks in a string of the length that is sought.
BLOCKS = 12
#: Differing runs of one key that one task sorts together.
GROUP_RUNS = 4_000
#: Blocks in one suffix array, unless one key has more.
BATCH_BLOCKS = 150_000
#: Symbols of a text that are hashed at a time (texts may be longer).
SEGMENT = 4 << 20
#: Bytes that stand for a word.
WORD = 8


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes of ``text`` in ascending order; a suffix comes before those that it begins."""
    n = len(text)
    if n == 0:
        return []
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    symbols = sorted(by_symbol)
    members = [by_symbol[s] for s in symbols]
    number = {s: g for g, s in enumerate(symbols)}
    group = [number[s] for s in text]
    below = list(range(-1, len(symbols) - 1))  # the next lower and the next higher group of each
    above = [*range(1, len(symbols)), -1]
    unset = -2
    smaller = [unset] * n  # previous-smaller pointers; -1: none
    g, lowest = len(symbols) - 1, 0
    while g >= 0:
        own = members[g]
        if len(own) > 1:
            own = sorted(i for i in own if group[i] == g)
        elif own and group[own[0]] != g:
            own = []
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and smaller[p] != unset:  # as large or larger: its own pointer leads on
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        members[g] = own
        if times:
            most = max(times.values())
            levels: list[list[int]] = [[] for _ in range(most + 1)]
            for p, k in times.items():
                levels[k].append(p)
            for k in range(most, 0, -1):  # more repeats of the prefix make a larger suffix: those are placed first
                new: dict[int, int] = {}
                for p in levels[k]:
                    old = group[p]
                    to = new.get(old)
                    if to is None:
                        to = new[old] = len(members)
                        members.append([])
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = to
                        if up >= 0:
                            below[up] = to
                    members[to].append(p)
                    group[p] = to
        lowest = g
        g = below[g]
    slot, at, g = [0] * len(members), 0, lowest
    while g >= 0:
        slot[g] = at
        at += len(members[g])
        g = above[g]
    order, placed = [0] * n, bytearray(n)
    for i in range(-1, n):  # -1: the empty suffix, before all others
        j = (order[i] if i >= 0 else n) - 1
        while j >= 0 and not placed[j]:  # the suffixes whose next smaller one this is
            own_group = group[j]
            order[slot[own_group]] = j
            slot[own_group] += 1
            placed[j] = 1
            j = smaller[j]
    return order


def neighbour_repeats(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position the longest common prefix, ``most`` at most, with the suffixes next to it in order. The last
    symbol of each string in ``text`` must be its own."""
    a, b = order[:-1], order[1:]
    common_prefix = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    for t in range(most):
        live = live[text[a[live] + t] == text[b[live] + t]]
        if not len(live):
            break
        common_prefix[live] = t + 1
    out = np.zeros(len(text), np.int32)
    np.maximum.at(out, a, common_prefix)
    np.maximum.at(out, b, common_prefix)
    return out


# ------------------------------------------------------------------- hashing

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(400).integers(1, 1 << 63, 256).astype(np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """64-bit hashes of any substrings of some bytes, taken as symbols of ``unit`` bytes; equal for equal substrings."""

    def __init__(self, raw: bytes, unit: int = 1):
        values = _BYTE[np.frombuffer(raw, np.uint8)] if unit == 1 else _mixed(np.frombuffer(raw, "<u8"))
        up, self.down = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


# --------------------------------------------------------------------- words

_WORDS = re.compile(rb"\S+")


def plain_bytes(text: str | None) -> bytes:
    return (text or "").encode()


def word_bytes(text: str | None) -> bytes:
    """``WORD`` bytes for each word of a text."""
    words = (text or "").encode().split()
    known = common.memo("words", common.MEMO_WORDS)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_digest(w, 51)
    return b"".join([known[w] for w in words])


def word_ranges(raw: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The bytes (from, to) of ``raw`` under the strings of ``words`` words of each span: those that start at its first
    word and the n - 1 that follow."""
    at = [m.span() for m in _WORDS.finditer(raw)]
    return [(at[s][0], at[s + n + words - 2][1]) for s, n in spans]


def few_words(raw: np.ndarray, length: int, words: int) -> np.ndarray:
    """For each string of ``length`` bytes of ``raw`` whether it holds fewer than ``words`` words that blanks enclose in it
    (it may be said of a string that holds just as many); the answer depends on the string alone."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~blank[1:] & blank[:-1], out=begins[2:])  # begins[i]: words that begin behind a blank, before byte i
    return begins[length:] - begins[1 : len(begins) - length + 1] - 1 < words


# ------------------------------------------------------------------- anchors

_LOW = np.uint64((1 << 24) - 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    m = len(values)
    padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: m - width + 1], before[width - 1 : m])


def runs_of(texts: list[bytes], length: int = LENGTH, kgram: int = KGRAM, fewer: int = 0, unit: int = 1) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor's distance, key, hash of the run's bytes) of every run in some texts; with
    ``fewer``, of those runs only where a string has fewer words."""
    width = length - kgram + 1
    raw = b"".join(texts)
    sizes = np.array([len(t) // unit for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    if len(raw) < length * unit:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    hashes = Hashes(raw, unit)
    gram = hashes.every(kgram)
    at = np.arange(len(gram), dtype=np.uint64)
    least = _sliding_least((gram & ~_LOW) | (_LOW - at), width)  # the last of equals, as positions count down
    owner = np.full(len(least), -1, np.int64)
    for i in np.flatnonzero(sizes >= length):
        owner[begins[i] : begins[i] + sizes[i] - length + 1] = i
    cut = np.flatnonzero((least[1:] != least[:-1]) | (owner[1:] != owner[:-1])) + 1
    first = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(least)]])
    kept = owner[first] >= 0
    if fewer:
        kept &= np.logical_or.reduceat(few_words(np.frombuffer(raw, np.uint8), length, fewer), first)
    first, end = first[kept], end[kept]
    anchor = (_LOW - (least[first] & _LOW)).astype(np.int64)
    number = (end - first).astype(np.uint64)
    whole = _mixed(hashes.at(first, end - 1 + length) + number * np.uint64(0x9E3779B97F4A7C15) + (anchor - first).astype(np.uint64))
    text = owner[first]
    return text, first - begins[text], end - first, anchor - first, gram[anchor].view(np.int64), whole.view(np.int64)


_RUN = "uid long, s long, n int, off int, key long, whole long"


def runs(keyed: DataFrame, length: int = LENGTH, kgram: int = KGRAM, encode: Callable[[str | None], bytes] = plain_bytes, fewer: int = 0, unit: int = 1) -> DataFrame:
    """Every run of the texts of ``keyed`` (uid, text), where they lie: a row for about (length - kgram) / 2 symbols."""
    common.small_batches(keyed.sparkSession)
    names = [f.split()[0] for f in _RUN.split(", ")]

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        froms: list[int] = []
        texts: list[bytes] = []
        held = 0

        def emit() -> pa.RecordBatch:
            text, s, n, off, key, whole = runs_of(texts, length, kgram, fewer, unit)
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[text]), pa.array(s + np.array(froms, np.int64)[text]), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(key), pa.array(whole)], names)

        for b in common.batches(stream):
            for uid, text in zip(b["uid"], b["text"]):
                raw = encode(text)
                for at in range(0, len(raw) // unit - length + 1, SEGMENT):
                    part = raw[at * unit : (at + SEGMENT + length - 1) * unit]
                    ids.append(uid)
                    froms.append(at)
                    texts.append(part)
                    held += len(part)
                    if held >= 1 << 18:
                        yield emit()
                        ids, froms, texts, held = [], [], [], 0
        if texts:
            yield emit()

    return keyed.select("uid", "text").mapInArrow(one, _RUN)


# ------------------------------------------------------------ differing runs


def block_symbols(length: int) -> int:
    return max(1, length // BLOCKS)


def repeated_starts(key: np.ndarray, n: np.ndarray, off: np.ndarray, blobs: list[bytes], length: int = LENGTH, unit: int = 1) -> list[np.ndarray]:
    """For each run (its bytes, the number of its starts and its anchor's distance) which of its starts begin a string
    that also begins at another start of these runs."""
    rows, block = len(blobs), block_symbols(length)
    sizes = np.array([len(b) // unit for b in blobs], np.int64)
    begins = np.cumsum(sizes) - sizes
    hashes = Hashes(b"".join(blobs), unit)
    grid = off.astype(np.int64) % block
    blocks = (sizes - grid) // block
    base = np.cumsum(blocks + 1) - blocks - 1  # each run's blocks, then a symbol of its own
    row = np.repeat(np.arange(rows), blocks)
    place = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begins[row] + grid[row] + block * place
    text = np.empty(int((blocks + 1).sum()), np.int64)
    text[base + blocks] = np.arange(rows)
    text[base[row] + place] = rows + np.unique(hashes.at(at, at + block), return_inverse=True)[1]
    order = np.array(suffix_array(text.tolist()), np.int64)
    repeat = neighbour_repeats(text, order, length // block + 2)

    starts = n.astype(np.int64)
    r = np.repeat(np.arange(rows), starts)
    p = np.arange(len(r)) - np.repeat(np.cumsum(starts) - starts, starts)
    rel = p - grid[r]
    inner_from, inner_to = -(-rel // block), (rel + length) // block
    cover_from, cover_to = rel // block, -(-(rel + length) // block)
    may = repeat[base[r] + inner_from] >= inner_to - inner_from
    inside = (cover_from >= 0) & (cover_to <= blocks[r])
    sure = inside & (repeat[base[r] + np.where(inside, cover_from, 0)] >= cover_to - cover_from)
    found = np.zeros(len(r), bool)
    c = np.flatnonzero(may)  # an exact comparison; starts that are sure take part as partners
    strings = hashes.at(begins[r[c]] + p[c], begins[r[c]] + p[c] + length)
    _, which, times = np.unique(strings, return_inverse=True, return_counts=True)
    found[c] = times[which] > 1
    return np.split(found | sure, np.cumsum(starts)[:-1])


_OPEN = "key long, uid long, s long, n int, off int, low int, high int, known boolean, bytes binary"


def _fetch(keyed: DataFrame, wanted: DataFrame, length: int, kgram: int, encode: Callable[[str | None], bytes] = plain_bytes, unit: int = 1) -> DataFrame:
    """The bytes of runs (key, uid, s, n, off, known), out of the texts of ``keyed``."""
    per_text = wanted.groupBy("uid").agg(F.collect_list(F.struct("key", "s", "n", "off", "known")).alias("runs"))
    joined = keyed.select("uid", "text").join(per_text, "uid")
    names = [f.split()[0] for f in _OPEN.split(", ")]

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            for uid, text, own in zip(b["uid"], b["text"], b["runs"]):
                raw = encode(text)
                rows = [(r["key"], uid, r["s"], r["n"], r["off"], 0, length - kgram, r["known"], raw[r["s"] * unit : (r["s"] + r["n"] + length - 1) * unit]) for r in own]
                yield _open_batch(rows, names)

    return joined.mapInArrow(one, _OPEN)


def _open_batch(rows: list[tuple], names: list[str] | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names or [f.split()[0] for f in _OPEN.split(", ")])


def _halved(open_runs: DataFrame, length: int, unit: int) -> DataFrame:
    """Each run in two: starts in the nearer and in the farther half of their distances to the anchor. The bytes that
    all strings of a half share join its key."""

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            rows = []
            for key, uid, s, n, off, low, high, known, raw in zip(*(b[f.split()[0]] for f in _OPEN.split(", "))):
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    a, z = max(lo, off - n + 1), min(hi, off)  # distances that this run has there
                    if a > z:
                        continue
                    at = off - z  # the first start of the part
                    shared = raw[(off - lo) * unit : (off - hi + length) * unit]
                    own = int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=f"{key}:{lo}:{hi}".encode()).digest(), "little", signed=True)
                    rows.append((own, uid, s + at, z - a + 1, z, lo, hi, known, raw[at * unit : (at + z - a + length) * unit]))
            yield _open_batch(rows)

    return open_runs.mapInArrow(one, _OPEN)


def _sorted_out(open_runs: DataFrame, length: int, unit: int) -> DataFrame:
    """(uid, s, n): the repeated starts among differing runs, by one suffix array for many keys."""
    spark = open_runs.sparkSession

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts(np.array([r[0] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), [r[8] for r in rows], length, unit)
        out = []
        for r, hit in zip(rows, found):
            if not r[7] and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                out += [(r[1], r[2] + int(a), int(z - a)) for a, z in edge.reshape(-1, 2)]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32()])], ["uid", "s", "n"])

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in common.batches(stream):
            for r in zip(*(b[f.split()[0]] for f in _OPEN.split(", "))):
                if size >= BATCH_BLOCKS and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[8]) // (unit * block_symbols(length)) + 1
        if rows:
            yield solve(rows)

    dealt = open_runs.repartition(common.partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(scan, "uid long, s long, n int")


def repeats(keyed: DataFrame, length: int = LENGTH, kgram: int | None = None, group_runs: int = GROUP_RUNS, encode: Callable[[str | None], bytes] = plain_bytes, fewer: int = 0, unit: int = 1) -> DataFrame:
    """(uid, s, n): n neighbouring starts, from symbol s on, of strings of ``length`` symbols that also start elsewhere in
    the texts of ``keyed`` (uid, text), as ``encode`` makes symbols of ``unit`` bytes of them. Spans may overlap or repeat. With ``fewer``,
    strings of as many words or more may be missing."""
    kgram = kgram or max(1, length * KGRAM // LENGTH)
    found = common.stored(runs(keyed, length, kgram, encode, fewer, unit), "runs")
    # stored, so that both sides of the join are plain exchanges and a hot key's rows can be split among tasks
    twice = common.stored(found.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"), "twice")
    shared = common.checkpointed(found.join(twice, "key"))
    counts = common.checkpointed(shared.groupBy("key", "whole").agg(F.count("*").alias("c"), F.min(F.struct("uid", "s", "n", "off")).alias("first")))
    spans = [shared.join(counts.filter("c > 1").select("key", "whole"), ["key", "whole"]).select("uid", "s", "n")]
    per_key = counts.groupBy("key").agg(F.count("*").alias("differing"), F.min("c").alias("least")).filter("differing > 1 and least = 1")
    wanted = common.checkpointed(counts.join(per_key.select("key", "differing"), "key").select("key", "first.*", (F.col("c") > 1).alias("known"), "differing"))
    if wanted.isEmpty():
        return spans[0]
    bytes_of = common.stored(_fetch(keyed, wanted, length, kgram, encode, unit), "open")
    large = wanted.filter(F.col("differing") > group_runs).select("key").distinct()
    if large.isEmpty():
        return spans[0].unionByName(_sorted_out(bytes_of, length, unit))
    ready = [bytes_of.join(large, "key", "left_anti")]
    rest = bytes_of.join(large, "key", "left_semi")
    while True:
        part = _halved(rest, length, unit).withColumn("whole", F.xxhash64("bytes"))
        part = common.stored(part, "halves")
        counts = part.groupBy("key", "whole").agg(F.count("*").alias("c"), F.min(F.struct("uid", "s", "n", "off", "low", "high", "known", "bytes")).alias("first"))
        counts = common.checkpointed(counts)
        again = counts.filter("c > 1").select("key", "whole")
        spans.append(part.filter("not known").join(again, ["key", "whole"]).select("uid", "s", "n"))
        sizes = counts.groupBy("key").agg(F.count("*").alias("differing"), F.min("c").alias("least")).filter("differing > 1 and least = 1")
        rows = counts.join(sizes.select("key", "differing"), "key").select("key", "first.uid", "first.s", "first.n", "first.off", "first.low", "first.high", (F.col("first.known") | (F.col("c") > 1)).alias("known"), "first.bytes", "differing")
        rows = common.checkpointed(rows)
        more = (F.col("differing") > group_runs) & (F.col("low") < F.col("high"))
        ready.append(rows.filter(~more).drop("differing"))
        rest = rows.filter(more).drop("differing")
        if rest.isEmpty():
            break
    for r in ready:
        spans.append(_sorted_out(r, length, unit))
    out = spans[0]
    for more_spans in spans[1:]:
        out = out.unionByName(more_spans)
    return out


# ------------------------------------------------------------------ removal


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (from, to) that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            if z > out[-1][1]:
                out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, kgram: int | None = None, group_runs: int = GROUP_RUNS, words: int = 0, passages: int = 0) -> DataFrame:
    """All columns of ``docs`` but for ``text``, and n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` also keeps
    ``text``, what is left of it (characters that a cut breaks are left out of the text, not of the digest).

    Null text: as empty in the figures, null as text. Texts shorter than ``length`` stay whole. Rows that repeat are
    documents of their own, so that each repeats the other. An empty table: no rows. Columns of these names are
    replaced. With ``words``, strings of so many words (between blanks of any kind) that stand elsewhere go too, from the
    first word's first byte to the last word's last; strings of ``length`` bytes go by their bytes if they hold fewer.
    With ``passages`` nothing more goes, but n_passage_bytes says how many bytes such strings of so many words cover.
    """
    if words and passages:
        raise ValueError("strings of words are removed or counted, not both")
    common.small_batches(docs.sparkSession)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passage_bytes"] * bool(passages)
    docs = docs.select([f"`{c}`" for c in docs.columns if c not in made])
    uid, bytes_, words_ = common.spare(docs, "uid", "spans", "word_spans")
    keyed = docs.withColumn(uid, F.xxhash64("doc_id", "text"))
    texts_of = keyed.select(F.col(uid).alias("uid"), "text")
    found = repeats(texts_of, length, kgram, group_runs, fewer=words).withColumn("by_words", F.lit(False))
    in_words = words or passages
    if in_words:
        by_words = repeats(texts_of, in_words, None, group_runs, word_bytes, unit=WORD)
        found = found.unionByName(by_words.withColumn("by_words", F.lit(True)))
    own_spans = lambda which: F.collect_set(F.when(which, F.struct("s", "n")))
    per_text = found.groupBy(F.col("uid").alias(uid)).agg(own_spans(~F.col("by_words")).alias(bytes_), own_spans(F.col("by_words")).alias(words_))
    joined = keyed.join(per_text, uid, "left")
    kept = [f for f in docs.schema.fields if f.name != "text" or with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * bool(passages)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in made)])

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            where = {n: i for i, n in enumerate(batch.schema.names)}
            rows, texts = [], []
            for text, spans, word_spans in zip(*(batch.column(where[c]).to_pylist() for c in ("text", bytes_, words_))):
                raw = (text or "").encode()
                ranges = [(x["s"], x["s"] + x["n"] + length - 1) for x in spans or []]
                by_words = word_ranges(raw, [(x["s"], x["n"]) for x in word_spans], in_words) if word_spans else []
                gone = merged(ranges + by_words if words else ranges)
                left, at = [], 0
                for a, z in gone:
                    left.append(raw[at:a])
                    at = z
                left = b"".join([*left, raw[at:]]) if gone else raw
                counted = (sum(z - a for a, z in merged(by_words)),) * bool(passages)
                rows.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *counted))
                if with_text:
                    texts.append(text if not gone else left.decode("utf-8", "ignore"))
            own = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(where[f.name]) for f in kept]
            more = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(own + more, [f.name for f in kept] + made)

    return joined.mapInArrow(cut, schema)
