r"""Transcript parsing by a hidden Markov model, and canonical turn rendering.

The hidden states of a transcript's lines are (role, whether the line opens a turn). Observed of a
line are its speaker marker (which word, in which style), whether it is blank, its length class, how
it ends and whether the line before was blank. Probabilities are smoothed counts over labelled
transcripts; Viterbi recovers the likeliest states, marker words are stripped where a turn opens, and
turns are rendered as `<|role|>` blocks.

In a rendered turn a backslash is doubled and `<|` becomes `<\|`, so no text can look like a marker
and `read_rendered` gives the turns back.

Defined results: null and empty transcripts have no turns and render as the empty text; without
training data all states are equally likely; repeated transcripts are parsed one by one; other
columns are kept, whatever their names; an empty table gives no rows. A row of `conversations`
without a conv_id is a conversation of its own, without an id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare

ROLES = ["system", "user", "assistant"]
#: (role, opens a turn)
STATES = [(r, o) for r in ROLES for o in (True, False)]
#: Words that name a speaker, by what they mostly stand for.
SPEAKERS = {"system": "system", "instruction": "system", "instructions": "system", "user": "user", "human": "user", "question": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "response": "assistant", "a": "assistant"}
_MARK = re.compile(r"^\s*(?:(?:\*\*|#{1,4}\s*|<\|(?:im_start\|>)?|\[)?(" + "|".join(sorted(SPEAKERS, key=len, reverse=True)) + r")(?:\*\*)?\s*(?:\|>|\]|:\*\*|:|$)(?:\*\*)?)[ \t]*", re.IGNORECASE)
TURN = "array<struct<role:string,text:string>>"


def marker(line: str) -> tuple[str, int]:
    """Role that the line's speaker marker stands for ('-' for none) and the marker's length."""
    m = _MARK.match(line)
    return (SPEAKERS[m[1].lower()], m.end()) if m else ("-", 0)


def observe(lines: list[str]) -> list[tuple[str, ...]]:
    """Features of every line."""
    out, blank_before = [], True
    for i, line in enumerate(lines):
        bare = line.strip()
        out.append((marker(line)[0], "first" if i == 0 else "blank" if blank_before else "text", str(min(6, len(bare).bit_length() // 2)), bare[-1] if bare and bare[-1] in "?.!:," else "-"))
        blank_before = not bare
    return out


def lines_of(turns: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """(state, line) of labelled turns, for training."""
    return [(STATES.index((role, j == 0)), line) for role, text in turns for j, line in enumerate(text.split("\n"))]


def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Transition and emission counts of labelled transcripts (`turns`: role, text)."""
    for pdf in batches:
        n: dict[tuple[str, int, str], int] = {}
        for turns in pdf["turns"]:
            labelled = lines_of([(t["role"], t["text"]) for t in turns if t["role"] in ROLES and t["text"] is not None])
            before = -1
            for (state, _), seen in zip(labelled, observe([line for _, line in labelled]), strict=True):
                for kind, value in [("next", str(before)), *((f"f{i}", v) for i, v in enumerate(seen))]:
                    n[kind, state, value] = n.get((kind, state, value), 0) + 1
                before = state
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "state", "value", "n"])


class Model:
    """Log probabilities from the (bounded) table of counts, with add-one smoothing."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        s = len(STATES)
        self.start, self.move = np.zeros(s), np.zeros((s, s))
        nxt = np.ones((s + 1, s))
        self.emit: list[dict[str, np.ndarray]] = []
        total = np.zeros(s)
        tables: dict[str, dict[str, np.ndarray]] = {}
        for kind, state, value, n in counts:
            if kind == "next":
                nxt[int(value), state] += n  # -1, the start, is the last row
                total[state] += n
            else:
                tables.setdefault(kind, {}).setdefault(value, np.zeros(s))[state] += n
        nxt[s, [i for i, (_, opens) in enumerate(STATES) if not opens]] = 1e-9
        # a line within a turn has the role of the line before it
        for i, (role, _) in enumerate(STATES):
            for j, (other, opens) in enumerate(STATES):
                if not opens and role != other:
                    nxt[i, j] = 1e-9
        logs = np.log(nxt / nxt.sum(axis=1, keepdims=True))
        self.move, self.start = logs[:s], logs[s]
        self.default = -np.log(total + 20)
        self.emit = [{v: np.log(c + 1) + self.default for v, c in tables.get(f"f{i}", {}).items()} for i in range(4)]

    def decode(self, lines: list[str]) -> list[int]:
        """Likeliest states by Viterbi."""
        back, score = [], self.start
        for i, seen in enumerate(observe(lines)):
            if i:
                paths = score[:, None] + self.move
                back.append(paths.argmax(axis=0))
                score = paths.max(axis=0)
            score = score + sum(self.emit[j].get(v, self.default) for j, v in enumerate(seen))
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def parse(self, transcript: str | None) -> list[tuple[str, str]]:
        """Turns (role, text); marker words go where they open a turn."""
        if not transcript:
            return []
        lines = transcript.split("\n")
        turns: list[tuple[str, list[str]]] = []
        for state, line in zip(self.decode(lines), lines, strict=True):
            role, opens = STATES[state]
            if opens or not turns:
                turns.append((role, [line[marker(line)[1] :]]))
            else:
                turns[-1][1].append(line)
        return [(role, "\n".join(text).strip()) for role, text in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form of turns."""
    safe = lambda text: text.replace("\\", "\\\\").replace("<|", "<\\|")
    return "\n".join(f"<|{role}|>\n{safe(text)}\n<|end|>" for role, text in turns)


def read_rendered(text: str) -> list[tuple[str, str]]:
    """The turns of a canonical form."""
    plain = lambda t: re.sub(r"\\(.)", r"\1", t)
    return [(m[1], plain(m[2])) for m in re.finditer(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>", text, re.DOTALL)]


def train(labelled: DataFrame) -> list[tuple[str, int, str, int]]:
    """Counts over all labelled transcripts (column turns); bounded by states times feature values."""
    found = labelled.select("turns").mapInPandas(count, "kind string, state int, value string, n long")
    return [tuple(r) for r in found.groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).orderBy("kind", "state", "value").collect()]


def parse(transcripts: DataFrame, counts: list[tuple[str, int, str, int]], out_col: str, text_col: str = "transcript") -> DataFrame:
    """`transcripts` with a struct of the recovered turns and the canonical rendering."""
    prepare(transcripts.sparkSession)
    shared = transcripts.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf(f"struct<turns:{TURN},rendered:string>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        for s in batches:
            rows = [model.parse(t) for t in s]
            yield pd.DataFrame({"turns": [[{"role": r, "text": t} for r, t in turns] for turns in rows], "rendered": [render(turns) for turns in rows]})

    return transcripts.withColumn(out_col, apply(column(text_col).cast("string")))


#: Ways in which `marked_turns` names the speakers, by number.
STYLES = [("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Instruction: "), ("### User\n", "### Assistant\n", "### System\n"), ("<|user|>\n", "<|assistant|>\n", "<|system|>\n"), ("**Q:** ", "**A:** ", "**Instructions:** "), ("", "", "")]


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, n_rows): the turns of each conversation in order, repeated rows once.

    A conversation is one training example and is held whole, like a document; no other group is: rows
    without a conv_id are grouped with equal rows only.
    """
    turn = F.struct("turn", "role", "text")
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return rows.groupBy("conv_id", own.alias("own")).agg(F.sort_array(F.collect_set(turn)).alias("turns")).drop("own")


def marked_turns(style, turns):
    """Column expression: turns whose texts begin with their speaker's marker in one of STYLES and,
    but for the last, end with a blank line."""
    table = F.array(*[F.array(*[F.lit(x) for x in s]) for s in STYLES])
    mark = lambda role: F.element_at(F.element_at(table, style + 1), F.when(role == "user", 1).when(role == "assistant", 2).otherwise(3))
    gap = lambda i: F.when(i < F.size(turns) - 1, "\n").otherwise("")
    return F.transform(turns, lambda t, i: F.struct(F.coalesce(t["role"], F.lit("-")).alias("role"), F.concat(mark(F.coalesce(t["role"], F.lit("-"))), F.coalesce(t["text"], F.lit("")), gap(i)).alias("text")))


def as_transcript(marked):
    return F.array_join(F.transform(marked, lambda t: t["text"]), "\n")
