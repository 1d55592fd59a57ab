import numpy as np
from pyspark.sql import functions as F

from glyphsift.llm.quality_rules import cascade_order, plan_cascade, quality_rules, quality_verdicts, rejected, rules


def test_each_rule(make_docs, prose):
    good = prose(1)
    bad = {
        2: " ", 3: " ".join(w + "###" for w in good.split()), 4: good.upper(), 5: " ".join([w for w in good.split() for _ in range(5)]),
        6: "\n".join(["one line", "two"] * 9), 7: "1 2 3 4 5 6 7 8 9 10 11 12 13",
    }
    got = {r.doc_id: r.kept for r in quality_verdicts(make_docs([(1, good), *bad.items(), (8, "Word."), (9, "short text with mail a@b.example")])).collect()}
    assert got == {1: True, 8: True, 9: True} | dict.fromkeys(bad, False)


def test_the_order_changes_nothing(make_docs, prose, spark):
    docs = make_docs([(i, prose(i) if i % 3 else prose(i).upper()) for i in range(30)])
    plan = plan_cascade(docs)
    assert sorted(n for n, *_ in plan) == sorted(rules(F.lit("")))
    order = [n for n, *_ in plan]
    ask = lambda o: [r[0] for r in docs.select(rejected(F.col("text"), o)).collect()]
    assert ask(order) == ask(order[::-1])


def test_odd_rows_and_clashing_columns(odd_docs, spark):
    kept = quality_rules(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 4, 4, 4, 5, 6, 7, 8]
    assert quality_rules(odd_docs.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "some good words", True, "x")], "doc_id long, text string, kept boolean, t string")
    assert quality_rules(clash).collect() == clash.collect()
    assert quality_verdicts(clash).columns == ["doc_id", "kept"]


def test_a_rule_is_placed_by_what_those_before_it_let_pass():
    hits = {"a": np.array([1, 1, 1, 0, 0, 0], bool), "b": np.array([1, 1, 0, 0, 0, 0], bool), "c": np.array([0, 0, 0, 1, 0, 0], bool)}
    assert [n for n, *_ in cascade_order({"a": 1.0, "b": 0.9, "c": 1.0}, hits)] == ["a", "c", "b"]
    assert [n for n, *_ in cascade_order({"a": 8.0, "b": 1.0, "c": 1.0}, hits)] == ["b", "c", "a"]
