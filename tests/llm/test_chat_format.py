import itertools
import random

import numpy as np

from glyphsift.llm.chat_format import ALIASES, _turns, chat_format, parse, parse_rendered, render, split_marker, train, transcripts, write_transcript

KIND = "conv_id long, turn long, role string, text string"


def conversations(prose, ids):
    rng, rows = random.Random(1), []
    for c in ids:
        roles = (["system"] if rng.random() < 0.2 else []) + ["user", "assistant"] * rng.randint(1, 5)
        for t, role in enumerate(roles):
            n = {"system": 8, "user": 20, "assistant": 90}[role] + rng.randint(0, 9)
            rows.append((c, t, role, prose(c * 100 + t, n, 30) + ("?" if role == "user" else ".")))
    return rows


def test_markers():
    assert split_marker("User: hi") == ("user", "hi")
    assert split_marker("**Assistant:** yes") == ("assistant", "yes")
    assert split_marker("[bot] yes") == ("assistant", "yes")
    assert split_marker("### Question:") == ("user", "")
    assert split_marker("Note: no role") == (None, "Note: no role")
    assert split_marker("") == (None, "")


def test_rendering_is_reversible():
    turns = [("user", "a <|end|> b\n<|user|>\nx"), ("assistant", "<\\|end|>"), ("system", "plain")]
    assert parse_rendered(render(turns)) == turns


def test_roles_of_unseen_conversations_are_recovered(spark, prose):
    model = train(spark.createDataFrame(conversations(prose, range(100)), KIND))
    right = total = dropped = 0
    by = {}
    for c, _, role, text in conversations(prose, range(200, 260)):
        by.setdefault(c, []).append((role, text))
    for c, turns in by.items():
        text, truth = write_transcript(str(c), turns)
        got = parse(model, text)
        dropped += sum(1 for r, t in turns if f"\n{t}" in text)
        for i, (role, t) in enumerate(turns):
            total += 1
            right += (role, t) in got
    assert dropped > 20 and right / total > 0.95


def test_odd_rows(spark, prose):
    rows = conversations(prose, range(20)) + [(None, 1, "user", "x"), (50, None, "user", "no turn"), (51, 1, None, "no role"), (52, 1, "robot", "unknown role"), (53, 1, "user", None), (53, 2, "user", " "), (54, 1, "user", "tie"), (54, 1, "user", "tie"), (55, 1, "user", "word " * 50_000)]
    df = spark.createDataFrame(rows, KIND)
    own = transcripts(df)
    assert {r.conv_id for r in own.collect()} == set(range(20)) | {50, 51, 52, 54, 55}
    model = train(df)
    got = {r.conv_id: r for r in chat_format(own, model).collect()}
    assert len(got) == 25 and got[55].chat.count("word") == 50_000
    assert all(set(r.roles) <= set(ALIASES.values()) and r.n_turns == len(r.roles) for r in got.values())
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, " \n", 3), (2, "no marker", 4)], "conv_id long, transcript string, chat int")
    found = sorted((r.conv_id or 0, r.n_turns, r.chat) for r in chat_format(odd, model).collect())
    assert found[0] == (0, 0, "") and found[1] == found[2] == (1, 0, "") and found[3][1] == 1
    empty = df.limit(0)
    assert chat_format(transcripts(empty), train(empty)).collect() == []
    assert _turns(df, "conv_id", "turn", "role", "text").count() == 25


def test_lines_that_only_look_marked_stay_whole(monkeypatch):
    from glyphsift.llm import chat_format as cf

    states = [cf.STATES.index(s) for s in [("user", True), ("user", False), ("assistant", True), ("assistant", False), ("user", True)]]
    monkeypatch.setattr(cf, "viterbi", lambda model, seen: states)
    text = "User: list them\na) first\nAnswer: 42\nContext: given\nAnswer: is it?"
    assert cf.parse(None, text) == [("user", "list them\na) first"), ("assistant", "42\nContext: given"), ("user", "Answer: is it?")]


def test_viterbi_against_all_paths():
    from glyphsift.llm import chat_format as cf

    rng = np.random.default_rng(5)
    n = len(cf.STATES)
    for length in (1, 2, 3, 4):
        model = cf.Model(rng.normal(size=n), rng.normal(size=(n, n)), tuple(rng.normal(size=(n, size)) for size in cf.SIZES))
        seen = np.stack([rng.integers(0, size, length) for size in cf.SIZES], axis=1)

        def weight(path):
            out = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return out + sum(model.emit[f][s, v] for s, row in zip(path, seen) for f, v in enumerate(row))

        best = max(itertools.product(range(n), repeat=length), key=weight)
        assert tuple(cf.viterbi(model, seen)) == best


def test_lines_inside_turns_of_a_trained_model(spark, prose):
    model = train(spark.createDataFrame(conversations(prose, range(100)), KIND))
    text = "User: what is it?\n\nAssistant: first words here and some more of them\n    indented = code\nand on it goes for a while with many words"
    got = parse(model, text)
    assert [r for r, _ in got] == ["user", "assistant"] and "\n    indented = code\n" in got[1][1]
    assert parse(model, "\n  \n    indented first\n\n")[0][1] == "    indented first"
