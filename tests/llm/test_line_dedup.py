import random

from glyphsift.llm.line_dedup import line_dedup


def brute(docs, min_words):
    """For every run of lines with enough words: all but its first place go."""
    seqs, raws = {}, {}
    for d, text in docs:
        own = [(i, " ".join(x.split())) for i, x in enumerate(text.split("\n"))]
        raws[d], seqs[d] = text.split("\n"), [(i, x) for i, x in own if x]
    gone, first = set(), {}
    for d in sorted(seqs):
        for s in range(len(seqs[d])):
            for e in range(s + 1, len(seqs[d]) + 1):
                run = tuple(x for _, x in seqs[d][s:e])
                if sum(len(x.split(" ")) for x in run) >= min_words and first.setdefault(run, (d, s)) != (d, s):
                    gone |= {(d, i) for i, _ in seqs[d][s:e]}
    return {d: "\n".join(x for i, x in enumerate(raws[d]) if (d, i) not in gone) for d in raws}


def test_against_brute_force(make_docs):
    rng = random.Random(0)
    for words in (3, 6, 9):
        lines = [" ".join(rng.choice("abc") + str(i) for i in range(rng.randint(1, 4))) for _ in range(5)] + ["", "  "]
        docs = [(d, "\n".join(rng.choice(lines) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 14)))) for d in range(40)]
        got = {r.doc_id: r.text for r in line_dedup(make_docs(docs), min_words=words).collect()}
        assert got == brute(docs, words)


def test_a_long_passage_goes_but_short_lines_and_first_copies_stay(make_docs, prose):
    passage = prose("p", 60)
    docs = [(i, f"All rights reserved.\n{prose(i)}\n{passage}\n{prose(i + 100)}") for i in range(6)] + [(7, prose(7))]
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup(make_docs(docs)).collect()}
    assert got[0][0] == docs[0][1] and got[7][0] == docs[6][1]
    for i in range(1, 6):
        assert got[i] == ((want := f"All rights reserved.\n{prose(i)}\n{prose(i + 100)}"), len(want))


def test_copies_within_a_document_and_whole_copies(make_docs, prose):
    line = prose("l", 55, 55)
    got = {r.doc_id: r.text for r in line_dedup(make_docs([(1, "\n".join([line] * 9)), (2, line), (3, prose(3))])).collect()}
    assert got == {1: line, 2: "", 3: prose(3)}
    kept = line_dedup(make_docs([(1, line), (2, line), (3, ""), (4, None)]), drop_emptied=True)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_odd_rows(odd_docs, spark):
    got = line_dedup(odd_docs)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[6] == [""] and len(by[5][0]) > 100_000
    assert by[4][0] and by[4][1]  # rows that repeat id and text are one document
    assert line_dedup(odd_docs.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a", 2, 3, 4, 5)], "doc_id long, text string, _d int, _t int, _p int, _C int")
    assert line_dedup(clash).collect() == clash.collect()


def test_one_line_in_every_document(make_docs, prose):
    hot = prose("hot", 60, 60)
    docs = [(i, f"}}\n{prose(i, 20)}\n{hot}\n}}\n}}") for i in range(300)]
    got = {r.doc_id: r.text for r in line_dedup(make_docs(docs)).collect()}
    assert got == {i: t if not i else t.replace(f"\n{hot}\n}}\n}}", "") for i, t in docs}


def test_text_ids_are_refused(spark):
    import pytest

    with pytest.raises(TypeError):
        line_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
