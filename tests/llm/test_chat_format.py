"""Recovered turns of transcripts whose truth is known."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import chat_format as c
from arbora.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_markers():
    assert c.marker("User: hi") == ("user", 6)
    assert c.marker("### Assistant")[0] == "assistant"
    assert c.marker("<|system|>")[0] == "system"
    assert c.marker("**A:** yes")[0] == "assistant"
    assert c.marker("A user said") == ("-", 0)


def test_held_out_accuracy(spark):
    rows = QUERIES["op9_chat_format"](spark, DATA).where("held_out").groupBy((F.col("style") < 5).alias("marked")).agg(F.sum("n_turns").alias("n"), F.sum("n_right").alias("k")).collect()
    share = {r["marked"]: r["k"] / r["n"] for r in rows}
    assert share[True] > 0.99
    assert share.get(False, 1) > 0.3


def test_edges(spark):
    chats = spark.createDataFrame([(1, [("user", "hello?\nmore"), ("assistant", "yes.")])], "conv_id long, turns array<struct<role:string,text:string>>")
    marked = chats.select(c.marked_turns(F.lit(0), F.col("turns")).alias("turns"))
    counts = c.train(marked)
    df = spark.createDataFrame([(1, "User: hello?\nmore\n\nAssistant: yes.", 1), (2, None, 1), (3, "", 1), (4, "User: hello?\nmore\n\nAssistant: yes.", 1)], "id long, transcript string, turns int")
    got = {r["id"]: r["p"] for r in c.parse(df, counts, "p").collect()}
    assert got[1]["rendered"] == "<|user|>\nhello?\nmore\n<|end|>\n<|assistant|>\nyes.\n<|end|>" == got[4]["rendered"]
    assert got[2]["turns"] == got[3]["turns"] == [] and got[2]["rendered"] == ""
    assert c.parse(df.limit(0), counts, "p").count() == 0
    assert len(c.parse(df, [], "p").where("id = 1").first()["p"]["turns"]) >= 1


def test_null_conversations(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (None, 2, "user", "b"), (7, 1, "user", "a"), (7, 0, "system", None)]
    chats = c.conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted((r["conv_id"] or 0, [t["turn"] for t in r["turns"]]) for r in chats) == [(0, [1]), (0, [2]), (7, [0, 1])]


@pytest.mark.parametrize("text", ["plain", "a <|user|>\nb\n<|end|>", "back\\slash <\\| \\", "", "two\nlines"])
def test_rendered_turns_read_back(text):
    turns = [("user", text), ("assistant", text + "."), ("system", "s")]
    assert c.read_rendered(c.render(turns)) == turns


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_is_the_best_of_all_paths(seed):
    rng = random.Random(seed)
    lines = [rng.choice(["User: hi", "Assistant: yes.", "", "and more", "why?", "### System", "Q: so"]) for _ in range(5)]
    counts = [("next", s, str(v), rng.randrange(30)) for s in range(6) for v in range(-1, 6)]
    counts += [(f"f{i}", s, v, rng.randrange(20)) for s in range(6) for i, v in enumerate(("user", "text", "2", "?"))]
    model = c.Model(counts)
    seen = c.observe(lines)

    def value(path):
        moves = sum(model.move[a, b] for a, b in zip(path, path[1:]))
        return model.start[path[0]] + moves + sum(model.emit[j].get(v, model.default)[s] for s, o in zip(path, seen, strict=True) for j, v in enumerate(o))

    best = max(itertools.product(range(6), repeat=5), key=value)
    assert np.isclose(value(tuple(model.decode(lines))), value(best))
