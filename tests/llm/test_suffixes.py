import hashlib
import random
from collections import Counter

import pytest

from parcelflow.llm import suffixes


def brute(texts: list[bytes], length: int) -> list[tuple]:
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("symbols", [1, 2, 4])
def test_suffix_array_sorts(symbols):
    draw = random.Random(symbols)
    for _ in range(300):
        x = [draw.randrange(symbols) for _ in range(draw.randrange(40))]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def corpus(seed: int) -> list[str | None]:
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, base = line(30), line(80)
    texts: list[str | None] = [None, "", "x", "ab" * 150, "a" * 140, base, base, base + "z"]
    for i in range(25):
        texts.append(line(draw.randint(0, 30)) + (passage[draw.randrange(20) : draw.randrange(60, 140)] if i % 2 else "") + line(draw.randint(0, 40)))
    for _ in range(12):  # near copies
        words = base.split()
        words[draw.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts.append("ab" * 40 + line(5) + "ab" * 40)
    return texts


@pytest.mark.parametrize("group_runs", [4000, 2])
def test_removal_against_brute_force(spark, group_runs):
    texts = corpus(3)
    rows = [(i, t, "s", 5) for i, t in enumerate(texts)] + [(90, texts[9], "s", 5), (90, texts[9], "s", 5), (None, texts[10], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, spans int")
    got = suffixes.remove_repeats(docs, length=40, kgram=16, group_runs=group_runs).collect()
    want = brute([(t or "").encode() for _, t, *_ in rows], 40)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, want))
    assert any(w[1] for w in want) and any(not w[1] for w in want)


def test_text_column_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" * 50 + "abc"), (2, "y"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(docs, length=20, with_text=True, kgram=8).collect()}
    assert got == {1: "abc", 2: "y", 3: None}
    assert suffixes.remove_repeats(docs.limit(0), length=20, kgram=8).collect() == []


def test_passages_of_51_short_words_and_of_400_bytes(spark):
    draw = random.Random(12)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    prose = lambda n, size=5: " ".join(word(size) for _ in range(n))
    short, fifty, long_words, unbroken = prose(51, 3), prose(50, 3), prose(25, 20), word(450)
    rows = [(2 * i + k, f"{prose(70)} {p} {prose(70)}") for i, p in enumerate((short, fifty, long_words, unbroken)) for k in range(2)]
    rows.append((8, f"{prose(30)}\n" + short.replace(" ", "\n", 9)))  # other blanks between the same words
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True, words=51).collect()}
    assert len(got) == 9
    for k in range(2):
        a, z = rows[k][1].split(short)
        assert got[k] == a + z
        assert got[2 + k] == rows[2 + k][1]
        assert long_words not in got[4 + k] and len(got[4 + k]) <= len(rows[4 + k][1]) - len(long_words)
        assert unbroken not in got[6 + k]
    assert got[8] == rows[8][1][: rows[8][1].index("\n") + 1]


def test_words_against_brute_force(spark):
    draw = random.Random(13)
    base = [f"w{draw.randrange(10**4)}" for _ in range(90)]
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 40))) for _ in range(12)]
    for _ in range(15):
        a = draw.randrange(60)
        texts.append(" ".join([*(str(draw.randrange(9**9)) for _ in range(draw.randint(0, 9))), *base[a : a + draw.randint(5, 30)], str(draw.random())]))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=10**6, with_text=True, words=9).collect()}
    count = Counter(tuple(t.split()[i : i + 9]) for t in texts for i in range(len(t.split()) - 8))
    for i, t in rows:
        own = t.split()
        gone = {j for s in range(len(own) - 8) if count[tuple(own[s : s + 9])] > 1 for j in range(s, s + 9)}
        assert got[i].split() == [w for j, w in enumerate(own) if j not in gone]
    assert max(count.values()) > 1


def test_passages_are_counted_and_stay(spark):
    draw = random.Random(14)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long_passage = prose(12), prose(40)
    texts = [f"{prose(20)} {passage} {prose(9)}", f"{passage}\n{prose(5)}", prose(60), None, "", f"{long_passage} {prose(3)} {passage[:30]}", f"{prose(2)} {long_passage}"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_passage_bytes int")
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, length=100, passages=12).collect()}
    plain = {r.doc_id: r for r in suffixes.remove_repeats(docs, length=100).collect()}
    whole = [t or "" for t in texts]
    assert [got[i].n_passage_bytes for i in range(7)] == [len(passage), len(passage), 0, 0, 0, len(long_passage), len(long_passage)]
    for i, t in enumerate(whole):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (plain[i].n_bytes, plain[i].n_removed, plain[i].n_spans, plain[i].kept_sha256)
        assert got[i].n_bytes == len(t.encode())
    assert got[0].n_removed == 0 < got[5].n_removed


def test_a_text_beyond_one_segment(spark):
    draw = random.Random(15)
    hexes = lambda n: draw.randbytes(n // 2).hex()
    passage = hexes(1000)
    long = hexes(suffixes.SEGMENT - 500) + passage + hexes(3000)  # over the border of two segments
    docs = spark.createDataFrame([(1, long), (2, hexes(700) + passage), (3, hexes(900))], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, with_text=True).collect()}
    assert got[1].text == long.replace(passage, "") and (got[1].n_removed, got[1].n_spans) == (1000, 1)
    assert got[2].n_removed == 1000 and got[3].n_removed == 0


def test_columns_of_the_user_stay(spark):
    names = ["uid", "spans", "word_spans", "_uid", "by_words"]
    docs = spark.createDataFrame([(i, "ab" * 300, *(f"{n} {i}" for n in names)) for i in range(2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for r in suffixes.remove_repeats(docs, with_text=True, words=51).collect():
        assert [r[n] for n in names] == [f"{n} {r.doc_id}" for n in names] and r.n_removed == 600
