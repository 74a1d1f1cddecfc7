import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from parcelflow.llm import merkle

TEXTS = st.lists(st.sampled_from(["a", "b.", "\n", "\n\n", " \n \n", "word ", "é!", "x" * 70, "? "]), max_size=25).map("".join)


def spelled(node) -> int:
    return node[1] if node[2] is None else sum(spelled(c) for c in node[2])


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_roots_tell_equality_and_edits_cover_the_difference(a, b):
    x, y = merkle.tree(a), merkle.tree(b)
    assert spelled(x) == x[1] == len(a) and (x[0] == y[0]) == (a == b)
    assert 0 <= merkle.likeness(x, y) <= 1 and (merkle.likeness(x, x) == 1)
    spans = merkle.edits(x, y)
    if a == b:
        assert spans == []
    else:
        (i, j, k, m), *_ = spans
        assert a[:i] == b[:k] and a[j:] == b[m:]


def test_edited_texts_against_their_rule(spark):
    rows = [(5, "abcdef"), (1, None), (3, "x\n\ny" * 50), (3, "zz"), (9, ""), (-4, "last one is éé")]
    got = merkle.compare_edited(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int"), parts=3).collect()
    own = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(own):
        text, following = text or "", own[(i + 1) % len(own)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), merkle.tree(text)[0].hex(), merkle.tree(edited)[0].hex()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(want)


def test_one_row_null_identifier_and_none(spark):
    schema = "doc_id long, text string"
    assert merkle.compare_edited(spark.createDataFrame([(None, "ab")], schema)).first().near_next == 1.0
    assert merkle.compare_edited(spark.createDataFrame([], schema)).collect() == []
    counts = merkle.fingerprints(spark.createDataFrame([(1, "a. b.\nc\n\nd")], schema)).first()
    assert (counts.n_chars, counts.n_sections, counts.n_paragraphs) == (10, 2, 4)


def alike_by_hand(a: str, b: str) -> float:
    """Likeness from the pieces' own texts, without hashes: whole sections first, then paragraphs and leaves of what is left."""

    def sections(t):
        return merkle._SECTION.findall(t) if "\n" in t else [t] if t else []

    def match(x, y, cut):
        rest, shared = list(y), 0
        left = []
        for piece in x:
            if piece in rest:
                rest.remove(piece)
                shared += len(piece)
            else:
                left.append(piece)
        if cut and left and rest:
            shared += match([p for s in left for p in cut[0](s)], [p for s in rest for p in cut[0](s)], cut[1:])
        return shared

    if a == b:
        return 1.0
    return 2 * match(sections(a), sections(b), [merkle._PARAGRAPH.findall, merkle._LEAF.findall]) / (len(a) + len(b))


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_likeness_by_hand_and_from_the_stored_tree(a, b):
    x, y = merkle.tree(a), merkle.tree(b)
    assert merkle.read_tree(merkle.stored_tree(x)) == x
    assert merkle.likeness(merkle.read_tree(merkle.stored_tree(x)), y) == merkle.likeness(x, y) == alike_by_hand(a, b)


def test_any_number_of_partitions(spark):
    rows = [(i * 7 % 5000, f"text {i}.\nsecond {i % 9}") for i in range(600)] + [(None, "n"), (None, "m"), (40, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(merkle.compare_edited(docs, parts=2).collect(), key=str)
    assert len(few) == len(rows)
    assert sorted(merkle.compare_edited(docs, parts=500).collect(), key=str) == few
    for r in few[:200]:
        assert merkle.likeness(merkle.read_tree(r.tree), merkle.read_tree(r.edited_tree)) == r.near_edited
        assert merkle.read_tree(r.tree)[0].hex() == r.fingerprint


def test_a_very_long_text(spark):
    long = "A sentence of some words. " * 40_000
    got = {r.doc_id: r for r in merkle.compare_edited(spark.createDataFrame([(1, long), (2, "short"), (3, "x" * 1_000_000)], "doc_id long, text string")).collect()}
    assert got[1].n_chars == len(long) and got[1].edited_sha256 == hashlib.sha256((long[: len(long) - len(long) // 2] + "short").encode()).hexdigest()
    assert got[3].near_next == 0.0 and 0 < got[1].near_edited < 1
