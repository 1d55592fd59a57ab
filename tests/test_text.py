import re
import statistics

import pytest
from pyspark.sql import functions as F

from glyphsift.functions import compare, phrases, text
from glyphsift.operators import stylometry as st

FENCED = "Hello world! This is a test. Here is a code block:\n```python\nx = 1. y = 2.\n```\nDone."


@pytest.fixture
def one(spark):
    def run(t, expr):
        return spark.createDataFrame([(t,)], "text string").select(expr.alias("x")).first().x

    return run


@pytest.mark.parametrize("t", ["été don't a-b", "-x- 'y' a--b _z_", "", "1st, 2nd; ½", "naïve-té’s"])
def test_words_as_in_python(one, t):
    assert one(t, text.word_list(F.col("text"))) == [w.lower() for w in re.findall(r"\b[\w'-]+\b", t)]


def test_sentences(one):
    assert len(one(FENCED, text.sentences(F.col("text")))) == 4
    assert one("```\nall. fenced.\n```", text.sentences(F.col("text"))) == []
    assert one("a\r\nb c", text.sentences(F.col("text"))) == ["a", "b", "c"]
    assert one("open fence\n```\nhidden", text.sentences(F.col("text"))) == ["open fence"]


def test_burstiness(one):
    def run(t):
        lengths = text.sentence_lengths(text.sentences(F.col("text")))
        return one(t, F.struct(*[c.alias(n) for c, n in zip(text.mean_and_cv(lengths), ("mean", "cv"))]))

    even = run("one two three four five. one two three four five. one two three four five.")
    assert (even["mean"], even.cv) == (5, 0)
    assert run("One sentence only.").cv is None and run("").cv is None
    bursty = run(f"Go. {'word ' * 40}end. Stop now.")
    assert bursty.cv == pytest.approx(statistics.stdev([1, 41, 2]) / statistics.mean([1, 41, 2]))


def test_moving_ttr():
    words = [f"w{i * i % 37}" for i in range(300)]
    windows = [len(set(words[i : i + 50])) / 50 for i in range(251)]
    assert st.moving_ttr(words) == pytest.approx(sum(windows) / 251)
    assert st.moving_ttr(["apple"] * 100) == pytest.approx(0.02) and st.moving_ttr([]) == 0
    assert st.moving_ttr([str(i) for i in range(100)]) == 1 and st.moving_ttr(["a", "a", "b"]) == pytest.approx(2 / 3)


def test_phrases(one):
    t = "Let us delve into a rich tapestry. Furthermore, it is important to note that this is a testament to the ever-evolving digital landscape in the fast-paced digital world."
    got = {m.phrase: m["count"] for m in one(t, phrases.matches(F.col("text")))}
    assert {"delve into", "rich tapestry", "furthermore,", "a testament to", "it is important/crucial to note", "in today's fast-paced world/landscape"} <= set(got)
    assert one("nothing of that kind", phrases.matches(F.col("text"))) == []
    assert one("Moreover, moreover. MOREOVER, x", phrases.weight(F.col("text"))) == 12


def test_scores(spark):
    ai = "Furthermore, we must delve into this rich tapestry here. Moreover, it is a testament to the power of many. Ultimately, the paradigm shift plays a pivotal role now. " * 4
    plain = "I went out. The weather that afternoon, which nobody on the hill had predicted with any confidence at all, turned ugly fast and drove us home. Rain! " * 5
    got = {r.id: r for r in st.stylometry(spark.createDataFrame([(1, ai), (2, plain), (3, "only nine words are in this very short text"), (4, None), (5, "```\n" + ai + "\n```")], "id int, text string")).collect()}
    assert got[1].score >= 0.7 and got[1].confidence_level in ("MEDIUM", "HIGH")
    assert got[2].score < 0.35 and got[2].status == "ok"
    assert (got[3].score, got[3].confidence_level, got[3].status, got[3].burstiness_cv) == (0, "CLEAN", "insufficient_length", None)
    assert got[4].score is None and got[4].confidence_level is None
    assert got[5].sentence_count == 0 and got[5].burstiness_cv is None and got[5].score <= got[1].score + 0.05


def test_measures_equal_the_columns(spark):
    odd = ["", "One. Two three!  Four?\nfive", FENCED, "open\n```\nhidden. words.", "a\r\nb. c\x85d", "Moreover, delve into it. Moreover we plays a key role. " * 9, "x. " * 70]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    t = F.col("text")
    mean, cv = text.mean_and_cv(text.sentence_lengths(text.sentences(t)))
    want = df.select(text.word_count(t), F.size(text.sentences(t)), phrases.weight(t), mean, cv).collect()
    got = df.select(st.text_measures("text").alias("m")).select("m.word_count", "m.sentence_count", "m.phrase_tenths", "m.mean_words", "m.cv").collect()
    for a, b in zip(want, got):
        assert tuple(a)[:4] == pytest.approx(tuple(b)[:4])
        assert (a[4] is None and (b[4] is None or b[4] != b[4])) or a[4] == pytest.approx(b[4])


def test_words_of_the_divergence_are_ascii(spark):
    rows = [("don_t stop café now", "don t stop caf now"), ("你好 世界", "再见 世界"), ("a b", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(compare.lexical_divergence(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [0.0, 0.0, None]


def test_comparison(spark):
    rows = [("", ""), ("a b", ""), ("word", "word"), ("a b c", "a b d"), ("x 12 y 7", "z 7"), ("see http://a.b/c", "see")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.q for r in df.select(compare.quality(F.col("a"), F.col("b")).alias("q")).collect()]
    assert [q.lexical_divergence for q in got[:3]] == [0, 1, 0] and got[3].lexical_divergence == pytest.approx(2 / 3)
    assert got[4].numbers_preserved == 0.5 and got[5].urls_preserved == 0 and got[0].numbers_preserved == 1
    cands = spark.createDataFrame([(1, 0, "a b c", "a b c"), (1, 1, "a b c", "x y z"), (1, 2, "a b c", "p q r"), (1, 3, "a b c", "l m n o p q r s t")], "k int, i int, a string, b string")
    assert compare.best_candidate(cands, "k", "i", "a", "b").first().i == 1


def test_best_effort(spark):
    kind = "k int, i int, passed boolean, detector_score double, divergence double"
    rows = [(1, 0, False, 3.0, 0.1), (1, 1, True, 9.0, 0.1), (1, 2, True, 5.0, 0.2), (2, 0, False, 3.0, 0.9), (2, 1, False, 2.0, 0.1), (2, 2, None, 2.0, 0.8), (3, 0, None, None, 0.2), (3, 1, None, None, 0.7), (3, 2, None, None, 0.7)]
    got = {r.k: r.i for r in compare.best_effort(spark.createDataFrame(rows, kind), "k", "i").collect()}
    assert got == {1: 2, 2: 2, 3: 1}
