"""Chat formatting: a hidden Markov model recovers the roles of transcript lines, then turns are rendered canonically."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table

ROLES = ("system", "user", "assistant")
ALIASES = {
    "system": "system", "sys": "system", "instruction": "system", "context": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "customer": "user", "prompt": "user",
    "assistant": "assistant", "ai": "assistant", "a": "assistant", "answer": "assistant", "bot": "assistant", "model": "assistant", "agent": "assistant",
}
#: How transcripts of the conversations table mark speakers; a conversation's style follows its id.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "SYSTEM: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "### Context:\n", "user": "### Question:\n", "assistant": "### Answer:\n"},
    {"system": "[system] ", "user": "[user] ", "assistant": "[bot] "},
)
#: One turn in so many is without its marker in those transcripts.
UNMARKED = 6
#: The query's model learns from one conversation in so many, by the hash of its id; all are parsed.
LEARN_ONE_IN = 4
MARKER = re.compile(r"^\s*(?:#{1,6}\s*|\*\*|[\[<(]\|?)?([A-Za-z]{1,12})(?:\*\*)?\s*(?::\*\*|:|\|?[\])>]:?)\s*")
CONTROL = re.compile(r"<(\\*\|)")
STATES = tuple((r, begins) for r in ROLES for begins in (True, False))
#: Sizes of the features of a line: marker, after a blank line, length, question mark, blank, first line.
SIZES = (len(ROLES) + 1, 2, 8, 2, 2, 2)


def split_marker(line: str) -> tuple[str | None, str]:
    """The canonical role that a line's marker names, None without one, and the line without its marker."""
    found = MARKER.match(line)
    role = ALIASES.get(found[1].lower()) if found else None
    return (role, line[found.end() :]) if role else (None, line)


def features(lines: list[str]) -> tuple[np.ndarray, list[str]]:
    """The features of each line as small integers, and the lines without markers."""
    out, texts = np.zeros((len(lines), len(SIZES)), dtype=np.int64), []
    for i, line in enumerate(lines):
        role, rest = split_marker(line)
        texts.append(rest)
        words = rest.count(" ") + 1 if rest.strip() else 0
        out[i] = (
            ROLES.index(role) + 1 if role else 0,
            int(i > 0 and not lines[i - 1].strip()),
            min(7, int(words).bit_length()),
            int(rest.rstrip().endswith("?")),
            int(not line.strip()),
            int(i == 0),
        )
    return out, texts


@dataclass(frozen=True)
class Model:
    """Log probabilities: start by state, step from state to state, emission by feature, state and value."""

    start: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, ...]


def fit(counts: dict[str, np.ndarray]) -> Model:
    log = lambda x: np.log((x + 0.1) / (x + 0.1).sum(axis=-1, keepdims=True))
    return Model(log(counts["start"]), log(counts["step"]), tuple(log(counts[f"emit{f}"]) for f in range(len(SIZES))))


def viterbi(model: Model, seen: np.ndarray) -> np.ndarray:
    """The most probable states; of equals, the first."""
    score = sum(model.emit[f][:, seen[:, f]].T for f in range(len(SIZES)))
    best, back = model.start + score[0], np.zeros((len(seen), len(STATES)), dtype=np.int64)
    for i in range(1, len(seen)):
        ways = best[:, None] + model.step
        back[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + score[i]
    out = np.zeros(len(seen), dtype=np.int64)
    out[-1] = best.argmax()
    for i in range(len(seen) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _without_blank_ends(lines: list[str]) -> list[str]:
    worded = [i for i, line in enumerate(lines) if line.strip()]
    return lines[worded[0] : worded[-1] + 1] if worded else []


def parse(model: Model, text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a transcript. A turn begins where the model says so, or where the role changes.

    A marker goes only where it begins a turn of its role; elsewhere a line that looks marked is text and stays whole.
    Blank lines at a turn's ends go; all other white space stays.
    """
    lines = _without_blank_ends(re.split("\r\n|\r|\n", text))
    if not lines:
        return []
    seen, texts = features(lines)
    turns: list[tuple[str, list[str]]] = []
    for state, line, bare, marked in zip(viterbi(model, seen), lines, texts, seen[:, 0]):
        role, begins = STATES[state]
        begins = begins or not turns or turns[-1][0] != role
        if begins:
            turns.append((role, []))
        turns[-1][1].append(bare if begins and marked == ROLES.index(role) + 1 else line)
    return [(role, "\n".join(body)) for role, own in turns if (body := _without_blank_ends(own))]


def escape(text: str) -> str:
    """text with a backslash in anything that could read as a control token, so that rendering stays reversible."""
    return CONTROL.sub(r"<\\\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{escape(text)}\n<|end|>\n" for role, text in turns)


def parse_rendered(chat: str) -> list[tuple[str, str]]:
    """The turns of a rendered chat: the inverse of render()."""
    found = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", chat, re.S)
    return [(role, re.sub(r"<\\(\\*\|)", r"<\1", text)) for role, text in found]


def _turns(df: DataFrame, by: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(F.col(by).alias("_c"), F.struct(F.col(turn).alias("t"), F.lower(F.trim(F.col(role).cast("string"))).alias("r"), F.col(text).cast("string").alias("x")).alias("_t"))
    return rows.where(F.col("_c").isNotNull() & (F.length(F.trim(F.col("_t.x"))) > 0)).groupBy("_c").agg(F.array_sort(F.collect_list("_t")).alias("_t"))


def write_transcript(key: str, turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, bool]]]:
    """One text with the turns' markers in the key's style, some left out, and the true state of each line."""
    style = STYLES[sum(key.encode()) % len(STYLES)]
    lines, truth = [], []
    for i, (role, text) in enumerate(turns):
        known = ALIASES.get(role or "")
        drop = known is None or (i > 0 and (sum(key.encode()) * 7 + i * 5) % UNMARKED == 0)
        own = ((style[known] if not drop else "") + re.sub("\r\n|\r", "\n", text)).split("\n") + [""]
        lines += own
        truth += [(ROLES.index(known) if known else -1, j == 0) for j in range(len(own))]
    return "\n".join(lines), truth


def transcripts(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, transcript): each conversation's turns in order as one text with speaker markers, some left out.

    Turns without text are left out; ties in turn order by role, then text. A null or unknown role has no marker. Rows
    of a null conversation id belong to none and are left out.
    """

    @F.pandas_udf("string")
    def write(key: pd.Series, turns: pd.Series) -> pd.Series:
        return pd.Series([write_transcript(str(k), [(t["r"], t["x"]) for t in own])[0] for k, own in zip(key, turns)], dtype=object)

    return _turns(df, conv_col, turn_col, role_col, text_col).select(F.col("_c").alias(conv_col), write("_c", "_t").alias("transcript"))


def train(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """The model of all conversations with roles: counts are summed where the data are; only sums reach the driver."""
    names = {"start": (len(STATES),), "step": (len(STATES),) * 2} | {f"emit{f}": (len(STATES), n) for f, n in enumerate(SIZES)}

    def count(batches):
        total = {k: np.zeros(v) for k, v in names.items()}
        for pdf in batches:
            for key, own in zip(pdf["_c"], pdf["_t"]):
                text, truth = write_transcript(str(key), [(t["r"], t["x"]) for t in own])
                seen, _ = features(text.split("\n"))
                state = np.array([2 * r + (not b) if r >= 0 else -1 for r, b in truth])
                if state[0] >= 0:
                    total["start"][state[0]] += 1
                good = (state[:-1] >= 0) & (state[1:] >= 0)
                np.add.at(total["step"], (state[:-1][good], state[1:][good]), 1)
                for f in range(len(SIZES)):
                    np.add.at(total[f"emit{f}"], (state[state >= 0], seen[state >= 0, f]), 1)
        yield pd.DataFrame([(k, i, x) for k, v in total.items() for i, x in enumerate(v.ravel()) if x], columns=["k", "i", "n"]).astype({"k": str, "i": "int64", "n": "float64"})

    sums = _turns(df, conv_col, turn_col, role_col, text_col).mapInPandas(count, "k string, i long, n double").groupBy("k", "i").sum("n").collect()
    counts = {k: np.zeros(v) for k, v in names.items()}
    for k, i, n in sums:
        counts[k].ravel()[i] = n
    return fit(counts)


def chat_format(df: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "transcript") -> DataFrame:
    """One row (id, n_turns, roles, chat) for each transcript of df: its turns as the model parses them, rendered.

    A null or blank transcript has no turns and an empty chat. A text without any marker is parsed by its line features
    alone, and so is a turn whose speaker the markers don't know: every line gets one of the three roles. Control tokens
    in the text are escaped. Texts count whole; repeated rows and null ids stay as they are; other columns are ignored;
    an empty table gives no rows.
    """

    @F.pandas_udf("n_turns int, roles array<string>, chat string")
    def formatted(texts: pd.Series) -> pd.DataFrame:
        turns = [parse(model, t) if isinstance(t, str) else [] for t in texts]
        return pd.DataFrame({"n_turns": pd.Series([len(t) for t in turns], dtype="int32"), "roles": [[r for r, _ in t] for t in turns], "chat": pd.Series([render(t) for t in turns], dtype=object)})

    out = df.select(F.col(id_col).alias("_i"), formatted(F.col(text_col).cast("string")).alias("_f"))
    return out.select(F.col("_i").alias(id_col), "_f.n_turns", "_f.roles", "_f.chat")


def query(spark, sf_dir: str) -> DataFrame:
    """All conversations, as transcripts, parsed by a model that has seen the true roles of one in LEARN_ONE_IN."""
    conversations = table(spark, sf_dir, "conversations")
    learned = conversations.where(F.pmod(F.xxhash64("conv_id"), F.lit(LEARN_ONE_IN)) == 0)
    return chat_format(transcripts(conversations), train(learned if learned.head(1) else conversations))


def words_query(spark, sf_dir: str) -> DataFrame:
    """What SQL can check of it: that each conversation has its chat, and that the chat holds all words of its turns."""
    count = lambda t: F.regexp_count(t, F.lit("[^ \\t\\n\\r\\f]+"))
    rows = table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0)
    own = rows.groupBy("conv_id").agg(F.sum(count("text")).alias("words"))
    out = query(spark, sf_dir).join(own, "conv_id")
    return out.select("conv_id", "words", (count("chat") - 2 * F.col("n_turns") >= F.col("words")).alias("whole"), (F.col("n_turns") > 0).alias("has_turns"))


WORDS_ORACLE = r"""
select conv_id, sum(len(regexp_extract_all(text, '[^ \t\n\r\f]+')))::bigint words, true whole, true has_turns
from conversations where trim(text) <> '' and conv_id is not null group by conv_id"""
