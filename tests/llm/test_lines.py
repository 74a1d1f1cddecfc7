from parcelflow.llm import lines

SITES = 12


def brute(rows, least):
    split = [(d, s, i, raw, raw.strip(" \t\r\f\v")) for d, t, s in rows for i, raw in enumerate((t or "").split("\n"))]
    sites: dict = {}
    for _, s, _, _, line in split:
        if line and s is not None:
            sites.setdefault(line, set()).add(s)
    wide = {line for line, own in sites.items() if len(own) >= least}
    first: dict = {}
    for d, _, i, _, line in sorted(split, key=lambda x: (x[0], x[2])):
        first.setdefault(line, (d, i))
    out = {}
    for d, t, _ in rows:
        kept = [raw for dd, _, i, raw, line in split if dd == d and not (line in wide and first[line] != (d, i))]
        out[d] = None if t is None else "\n".join(kept)
    return out


def test_against_brute_force(spark):
    rows = [(i, f"own {i}\n menu \nfooter {i % 3}\n\nshort", f"s{i % SITES}") for i in range(24)]
    rows += [(50, None, "s1"), (51, "", "s2"), (52, "menu\nmenu\n", None), (53, " \n", "s3")]
    rows.append((60, "x\n" + "\n".join(f"footer {i % 3}" for i in range(2000)) + "\nlast", "s4"))  # many lines go from one text
    docs = spark.createDataFrame([(*r, 9, "r", "d") for r in rows], "doc_id long, text string, source string, n_lines int, row string, drop string")
    for least in (2, 10, SITES, SITES + 1):
        found = lines.clean(docs, min_sites=least).collect()
        assert {r.doc_id: r.text for r in found} == brute(rows, least), least
        assert {(r.row, r.drop) for r in found} == {("r", "d")} and found[0].n_lines != 9


def test_null_source_counts_for_nothing_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x", None), (2, "x", None)], "doc_id long, text string, source string")
    assert {r.text for r in lines.clean(docs, min_sites=1).collect()} == {"x"}
    assert lines.clean(docs.limit(0)).collect() == []
