"""SentencePiece encoding and decoding over a relational lattice.

A text is escaped (blanks become the word mark, one mark is put before it) and cut into words: a run of marks and
what follows it, however long. Words are cut once more between characters that no piece has next to
one another, which no path can bridge: what is left are the *parts*.

1. Texts belong to *blocks*, so many rows of a file, which are the same whichever way files are split and however often
   they are scanned. Where the texts lie, each block's distinct parts are written down.
2. The parts of all blocks are made distinct. Their substrings of bounded length are exploded and equi-joined to the piece
   table; the edges that match are grouped by part, and a higher-order ``aggregate`` folds them to the path of greatest
   total score (Viterbi). Characters without a piece become their bytes' pieces. The few parts of more than ``PART_CHARS``
   characters are folded by the same rule where the texts lie, with the last positions as state.
3. A join takes the paths back to the blocks, in the shared folder. Where the texts lie, a block's paths are laid out along
   its texts. Decoding joins the pieces' strings and undoes the escape.

Where the texts lie, a batch is worked on as Arrow arrays: its words are made distinct, these are cut, and the paths of the
parts are taken into the words' and these into the texts' by their numbers.

The vocabulary file at hand is a BPE model, whose merges may cut a word otherwise than the path of greatest score
over the same pieces; the tests hold results against a brute-force search of that path, and against the exact text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Longer parts are not exploded; their path is found one character after another.
PART_CHARS = 64
#: Rows of a file that make a block.
BLOCK_ROWS = 1 << 14
#: Parts that a task holds at a time.
HELD_PARTS = 600_000
#: Rows (block, part) that one task joins; their distinct parts, fewer, are those whose edges it groups.
TASK_ROWS = 100_000
#: A byte's piece scores less than any other by this.
BYTE_PENALTY = 10.0

_WORDS = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")


def words(text: str | None) -> list[str]:
    """The words of an escaped text; one after another they are that text."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def bare_words(text: str | None) -> list[str]:
    """The words without the one mark that each begins with."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and MARK not in text:
        return text.split(" ")  # single blanks are just the marks between words
    return [w[1:] for w in words(text)]


def _reordered(plain: pa.Array, odd: np.ndarray, more: pa.Array) -> pa.Array:
    """``plain`` with the rows where ``odd`` holds replaced by those of ``more``, in order."""
    order = np.arange(len(plain))
    order[odd] = len(plain) + np.arange(len(more))
    return pa.concat_arrays([plain, more]).take(pa.array(order))


def split(texts: pa.Array) -> pa.ListArray:
    """``bare_words`` of each text."""
    tests = [pc.equal(texts, ""), pc.starts_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)]
    odd = pc.fill_null(reduce(pc.or_, tests), False)
    plain = pc.split_pattern(texts, " ")
    if not pc.any(odd).as_py():
        return plain
    more = pa.array([bare_words(t) for t in texts.filter(odd).to_pylist()], plain.type)
    return _reordered(plain, odd.to_numpy(zero_copy_only=False), more)


def marked(bare: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(MARK, bare, "")


def _ordinary(own) -> Iterator[int]:
    return (i for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i)))


class Cutter:
    """Cuts words between neighbours that stand in no piece, and finds the path through long parts."""

    def __init__(self, model: str):
        own = _model(model)
        strings = (own.id_to_piece(i) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i)))
        pairs = {p[i : i + 2] for p in strings for i in range(len(p) - 1)}
        letters = sorted(set("".join(pairs)))
        self.letter, self.n_letters = np.zeros(0x110000, np.int32), len(letters) + 1  # 0: a character of no pair
        self.letter[[ord(a) for a in letters]] = np.arange(1, self.n_letters)
        self.joined = np.zeros(self.n_letters**2 // 8 + 1, np.uint8)  # a bit for each two letters
        for a, z in pairs:
            i = int(self.letter[ord(a)]) * self.n_letters + int(self.letter[ord(z)])
            self.joined[i >> 3] |= 1 << (i & 7)
        self.table = {own.id_to_piece(i): (round(float(own.get_score(i)), 6), i) for i in _ordinary(own)}
        self.longest = max(map(len, self.table))
        self.byte_score = min(float(own.get_score(i)) for _, i in self.table.values()) - BYTE_PENALTY
        self.byte_ids = byte_ids(model)

    def cut(self, words_: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of some words that are not empty, one after another, and how many each word has."""
        if not len(words_):
            return words_, np.zeros(0, np.int64)
        _, offsets, data = words_.buffers()
        bounds = np.frombuffer(offsets, np.int32)[words_.offset : words_.offset + len(words_) + 1]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        letter = self.letter[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")]
        starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte at which each character begins
        last = np.searchsorted(starts, bounds[1:] - bounds[0]) - 1
        pair = letter[:-1].astype(np.int64) * self.n_letters + letter[1:]
        ends = np.append((self.joined[pair >> 3] >> (pair & 7).astype(np.uint8) & 1) == 0, True)
        ends[last] = True
        counts = np.diff(np.cumsum(ends)[last], prepend=0)
        stops = np.append(0, starts[np.flatnonzero(ends) + 1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(stops) - 1, pa.py_buffer(stops), pa.py_buffer(raw.tobytes())), counts

    def parts(self, words_: list[str]) -> tuple[list[str], np.ndarray]:
        """``cut`` of a list."""
        parts, counts = self.cut(pa.array(words_, pa.string()))
        return parts.to_pylist(), counts

    def path(self, part: str) -> bytes:
        """The ids (little-endian, 32 bits) of the path of ``viterbi`` through a part of any length: scores of the last
        positions, and for each position the last piece's length and id."""
        best, size, piece_id = [0.0] * (self.longest + 1), array("h", [0]), array("i", [0])
        for z in range(1, len(part) + 1):
            found = (-np.inf, 0, 0)
            for a in range(max(0, z - self.longest), z):
                if piece := self.table.get(part[a:z]):
                    found = max(found, (best[a % (self.longest + 1)] + piece[0], a, piece[1]))
            if part[z - 1] not in self.table:
                found = max(found, (best[(z - 1) % (self.longest + 1)] + self.byte_score * len(part[z - 1].encode()), z - 1, -1))
            best[z % (self.longest + 1)] = found[0]
            size.append(z - found[1])
            piece_id.append(found[2])
        ids, z = array("i"), len(part)
        while z:
            a, i = z - size[z], piece_id[z]
            ids.extend([i] if i >= 0 else [self.byte_ids[b] for b in reversed(part[a:z].encode())])
            z = a
        return np.array(ids[::-1], "<u4").tobytes()


_CUTTERS: dict[str, Cutter] = {}


def cutter(model: str) -> Cutter:
    if model not in _CUTTERS:
        _CUTTERS[model] = Cutter(model)
    return _CUTTERS[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score) of the model's ordinary pieces: as many rows as the vocabulary has, whatever the input."""
    own = _model(path)
    return spark.createDataFrame([(own.id_to_piece(i), i, float(own.get_score(i))) for i in _ordinary(own)], "piece string, id int, score double")


def byte_ids(path: str) -> list[int]:
    """The ids of the pieces of the 256 bytes."""
    own = _model(path)
    found = {int(own.id_to_piece(i)[3:5], 16): i for i in range(own.get_piece_size()) if own.is_byte(i)}
    return [found[b] for b in range(256)]


# ------------------------------------------------------------------- lattice


def viterbi(words_table: DataFrame, pieces: DataFrame, bytes_: list[int], scores: list[float], longest: int, lowest: float) -> DataFrame:
    """(word, ids): the path of greatest score through each word of a table of distinct ones; among equals the one whose
    last piece is the shortest, then the one before it, and so on.

    Substrings are exploded in the partition that holds the word and joined to the piece table there (it is broadcast:
    its size is the vocabulary's); grouping by word needs no second shuffle. An edge is one number, end (from bit 48),
    start (from bit 40) and identifier + 1 (0: the character's bytes), so that groups stay small; ``scores`` is by
    identifier.
    """
    size = F.length("word")
    start = words_table.select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("a"))
    cut = start.select("word", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("a")))).alias("n"))
    parts = cut.select("word", "a", "n", F.expr("substring(word, a + 1, n)").alias("piece"))
    joined = parts.join(F.broadcast(pieces.select("piece", "id")), "piece", "left").filter("id is not null or n = 1")
    edge = joined.select("word", F.expr("shiftleft(cast(a + n as bigint), 48) | shiftleft(cast(a as bigint), 40) | coalesce(id + 1, 0)").alias("edge"))
    grouped = edge.groupBy("word").agg(F.collect_list("edge").alias("edges"))
    json = lambda values, kind: f"from_json('{[round(v, 6) for v in values]}', 'array<{kind}>')"  # noqa: E731 (folded to one constant)
    fold = f"""
      aggregate(sequence(1, length(word)), array(struct(cast(0 as double) as score, cast(array() as array<int>) as ids)),
        (best, z) -> concat(best, transform(
          array(array_max(transform(filter(edges, e -> shiftright(e, 48) = z), e -> struct(
            best[cast(shiftright(e, 40) & 255 as int)].score + coalesce(get({json(scores, "double")}, cast(e & 4294967295 as int) - 1), {lowest - BYTE_PENALTY!r} * octet_length(substring(word, z, 1))) as score,
            cast(shiftright(e, 40) & 255 as int) as a, cast(e & 4294967295 as int) - 1 as id)))),
          w -> struct(w.score as score, concat(best[w.a].ids, case when w.id >= 0 then array(w.id) else
            transform(sequence(1, octet_length(substring(word, z, 1))), i -> element_at({json(bytes_, "int")}, cast(conv(substring(hex(encode(substring(word, z, 1), 'utf-8')), 2 * i - 1, 2), 16, 10) as int) + 1)) end) as ids))),
        best -> element_at(best, -1).ids)"""
    return grouped.select("word", F.expr(fold).alias("ids"))


def paths(distinct: DataFrame, model: str, tasks: int) -> DataFrame:
    """(word, ids) of distinct parts."""
    own, pieces = _model(model), piece_table(distinct.sparkSession, model)
    limits = pieces.agg(F.max(F.length("piece")).alias("longest"), F.min("score").alias("lowest")).first()
    scores = [float(own.get_score(i)) for i in range(own.get_piece_size())]
    return viterbi(distinct.repartition(tasks, "word"), pieces, byte_ids(model), scores, limits.longest, limits.lowest)


# -------------------------------------------------------------------- blocks


def _blocks(docs: DataFrame, rows: int) -> DataFrame:
    """(block, doc_id, text) of a scan of Parquet files."""
    place = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / rows))
    return docs.select(place.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _runs(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows): the batches, cut where another block begins."""
    for b in stream:
        block = b.column("block").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        yield from ((int(block[i]), b.slice(i, z - i)) for i, z in zip(bounds, bounds[1:]) if z > i)


def _parts_of(blocked: DataFrame, model: str) -> DataFrame:
    """(block, word): the parts of each block that are not too long to explode, each once or a few times."""

    def distinct(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, at = cutter(model), pa.array([], pa.string()), None

        def emit() -> Iterator[pa.RecordBatch]:
            found = held.take(pc.sort_indices(held))
            for i in range(0, len(found), 1 << 15):
                part = found.slice(i, 1 << 15)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at, np.int64)), part], ["block", "word"])

        for block, rows in _runs(stream):
            if block != at or len(held) > HELD_PARTS:
                yield from emit()
                held, at = held[:0], block
            found = own.cut(marked(split(rows.column("text")).values.unique()))[0].unique()
            held = pa.concat_arrays([held, found.filter(pc.less_equal(pc.utf8_length(found), PART_CHARS))]).unique()
        yield from emit()

    return blocked.select("block", "text").mapInArrow(distinct, "block long, word string")


class _Table:
    """The paths of a block's parts."""

    def __init__(self, own: Cutter, uri: str):
        self.own, self.uri, self.parts, self.ids = own, uri, pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        fs, root = common.filesystem(uri)
        if fs.get_file_info(root).type == common.pafs.FileType.NotFound:  # a block without words, or of long parts only; else ``paths`` raises
            return
        found = pq.read_table(root, filesystem=fs, columns=["word", "ids"], partitioning=None)
        self.parts, self.ids = found.column("word").combine_chunks(), found.column("ids").combine_chunks().cast(self.ids.type)

    def paths(self, words_: pa.Array) -> pa.ListArray:
        """The ids of each word. Only longer parts than are exploded have no stored path; a lost or unfinished table is an error."""
        parts, counts = self.own.cut(words_)
        coded = parts.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.parts)
        ids = self.ids.take(at)
        if at.null_count:
            long = coded.dictionary.filter(at.is_null()).to_pylist()
            if least := [len(p) for p in long if len(p) <= PART_CHARS]:
                raise LookupError(f"{self.uri} has no path of a part of {least[0]} characters: the table of paths is not whole")
            more = pa.array([np.frombuffer(self.own.path(p), "<i4") for p in long], ids.type)
            ids = _reordered(ids, at.is_null().to_numpy(zero_copy_only=False), more)
        ids = ids.take(coded.indices)
        bounds = ids.offsets.to_numpy()[np.append(0, np.cumsum(counts))]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids.values)


def encode(docs: DataFrame, model: str, from_files: bool = False, with_ids: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256, round_trip and, ``with_ids``,
    ids of every whole text. Null and empty texts have no pieces. Rows that repeat are documents of their own; other
    columns are ignored, whatever their names. An empty table: no rows. A text that holds the word mark itself decodes
    with blanks there, as the format has it, and ``round_trip`` says so. ``from_files``: ``docs`` is a plain scan of Parquet
    files that stay as they are; other frames are written to the shared folder first.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    if not from_files:
        docs = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "texts")
    blocked = _blocks(docs, block_rows)
    parts = common.stored(_parts_of(blocked, model), "parts")
    tasks = max(common.partitions(spark), -(-parts.count() // TASK_ROWS))
    found = parts.repartition(tasks, "word").join(paths(parts.select("word").distinct(), model, tasks), "word").select("block", "word", "ids")
    path = common.shared_path(spark, "paths")
    # a task's groups are few and small, so that they may stay in its hash table; beyond this Spark sorts and spills
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(TASK_ROWS))
    try:
        found.repartition(common.partitions(spark), "block").sortWithinPartitions("block").write.partitionBy("block").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids
    spelled = spelling(model)

    def lay_out(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, strings, table, at = cutter(model), pa.array(spelled, pa.binary()), None, None
        for block, rows in _runs(stream):
            if table is None or block != at:
                table, at = _Table(own, f"{path}/block={block}"), block
            texts = rows.column("text")
            found = split(texts)
            coded = found.values.dictionary_encode()
            paths_ = table.paths(marked(coded.dictionary)).take(coded.indices)
            bounds = paths_.offsets.to_numpy()[found.offsets.to_numpy()]
            raw, back = memoryview(paths_.values.to_numpy().astype("<u4", copy=False)).cast("B"), decoded(paths_.values, bounds, strings)
            out = [(zlib.crc32(raw[4 * a : 4 * z]), hashlib.sha256(own_).hexdigest(), own_ == (text or "").encode()) for a, z, own_, text in zip(bounds.tolist(), bounds[1:].tolist(), back, texts.to_pylist())]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds[2:5])]
            ids = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), paths_.values)] * with_ids
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), *columns, *ids], names)

    return blocked.mapInArrow(lay_out, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)


def spelling(model: str) -> list[bytes]:
    """The UTF-8 bytes of each id, the word mark as a blank."""
    own = _model(model)
    return [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) or own.is_unknown(i) else own.id_to_piece(i).replace(MARK, " ").encode() for i in range(own.get_piece_size())]


def decoded(ids: pa.Array, bounds: np.ndarray, spelled: pa.Array) -> Iterator[bytes]:
    """The texts of some ids, one between each two bounds, in UTF-8, without the mark that was put before each; bytes that
    are none become U+FFFD."""
    found = spelled.take(ids)
    data, at = memoryview(found.buffers()[2] or b""), found.buffers()[1]
    at = np.frombuffer(at, np.int32)[bounds].tolist() if len(ids) else [0] * len(bounds)
    for a, z in zip(at, at[1:]):
        raw = bytes(data[a + 1 : z])
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        yield raw
