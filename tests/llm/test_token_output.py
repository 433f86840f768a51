"""Exact round trip of token shards, and the permutation."""

import zlib

import numpy as np
import pytest

from arbora.llm import token_output as t


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_feistel(n):
    x = np.arange(n)
    y = t.feistel(x, n, 5)
    assert sorted(y.tolist()) == x.tolist()
    assert (t.feistel(y, n, 5, inverse=True) == x).all()
    if n > 100:
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.2 and (y != t.feistel(x, n, 6)).any()


def test_round_trip(spark, tmp_path):
    texts = ["", None, "Grüße, 世界! 🙂", "plain words here", "x" * 5000, "a b\n\nc\t" * 400, "same", "same"] + [f"text number {i} " * (i % 50) for i in range(200)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, slot int").repartition(3)
    rows, total = t.sequences(df, length=64)
    placed = t.place(rows, total, shard_rows=50)
    assert sorted(r["slot"] for r in placed.select("slot").collect()) == list(range(total))
    small, sample = t.packed(rows)
    report = {r["shard"]: r for r in t.write_shards(t.place(small, total, shard_rows=50), f"file://{tmp_path}/shards", sample).collect()}
    assert report == {r["shard"]: r for r in t.write_shards(placed, f"file://{tmp_path}/plain").collect()}
    assert sum(r["rows"] for r in report.values()) == total
    data = {s: (tmp_path / "shards" / f"shard-{s:06d}.bin").read_bytes() for s in report}
    for s, r in report.items():
        assert len(data[s]) == r["bytes"] == r["rows"] * 128 and zlib.crc32(data[s]) == r["crc32"]
    slots = t.feistel(np.arange(total), total, 9)
    flow = np.concatenate([t.read_sequence(data[s // 50], s % 50, 64) for s in slots.tolist()])
    ranks = t.load_ranks(t.VOCABULARY)
    codec = t.Codec(ranks)
    pieces = np.split(flow, np.flatnonzero(flow == codec.separator) + 1)
    found = sorted(codec.encoding.decode(p[:-1].tolist()) for p in pieces if len(p))
    want = sorted(x for x in texts if x is not None)
    assert [x for x in found if x] == [x for x in want if x]
    assert sum(r["n_docs"] for r in rows.collect()) == len(want)


def test_no_rows(spark):
    rows, total = t.sequences(spark.createDataFrame([], "doc_id long, text string"))
    assert total == 0 and t.place(rows, total).count() == 0


def test_query_writes_the_shards(spark):
    """Digests are those of the bytes at each slot's offset in the files that the query wrote."""
    import zlib
    from pathlib import Path

    from arbora.llm import queries
    from arbora.llm.common import ensure_checkpoint_dir

    where = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(where.glob("arbora_shards_*"))
    rows = queries.op4_token_output(spark, "/root/testdata/sf0.001").collect()
    (folder,) = set(where.glob("arbora_shards_*")) - before
    files = {int(f.stem[-6:]): f.read_bytes() for f in folder.glob("shard-*.bin")}
    stride = 2 * 1024
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and sum(map(len, files.values())) == len(rows) * stride
    for r in rows:
        assert r["slot"] == r["shard"] * 8192 + r["row"]
        assert zlib.crc32(files[r["shard"]][r["row"] * stride : (r["row"] + 1) * stride]) == r["tokens_crc32"]


def test_long_runs():
    """Very long runs of one kind decode to the same text."""
    codec = t.Codec(t.load_ranks(t.VOCABULARY))
    for text in (" " * 1_000_000 + "a", "b" * 1_000_000, "🙂" * 200_000, "\u3000" * 5000 + "x\x1c!" * 5000, "9" * 100_000 + "\n" * 100_000 + "b", "\n" * 500_000):
        ids = codec.encode(text.encode())
        assert ids[-1] == codec.separator and codec.encoding.decode(ids[:-1].tolist()) == text


def test_ids_are_those_of_the_whole_text():
    """URLs, scripts without spaces, long words and white space of any length: no cut changes an id."""
    codec, rng = t.Codec(t.load_ranks(t.VOCABULARY)), np.random.default_rng(1)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    spaces = [c * n + end for c in (" ", "\n", "\u3000", " \n\t", "\x85 ") for n in (1024, 1025, 3000) for end in ("a", "1", "!", "", "'s", " b")]
    texts = ["http://example.org/" + pick("abc123/-_=&?", 10_500), "漢字仮名交じり文" * 3000, pick("abcdefghij", 100_000), "plain words, as usual.\n\n  " * 900, *spaces, "w" + "x ".join(spaces) + "y"]
    for text in texts:
        assert codec.encode(text.encode())[:-1].tolist() == codec.encoding.encode_ordinary(text), text[:20]
    assert [(len(p), one) for p, one in t.cut_runs("a" + " " * 5000 + "b" + " " * 5000)] == [(1, False), (4999, True), (2, False), (5000, True), (0, False)]


def test_reader_goes_on_after_a_stop(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 40)) for i in range(150)], "doc_id long, text string").repartition(2)
    rows, total = t.sequences(df, length=32)
    t.write_shards(t.place(rows, total, shard_rows=20), f"file://{tmp_path}/s").collect()
    folder, whole = f"file://{tmp_path}/s", {}
    want = {r["slot"]: bytes(r["tokens"]) for r in t.place(rows, total, shard_rows=20).collect()}
    for start, stop in ((0, 7), (7, 20), (20, 55), (55, total)):
        reader = t.read_from(folder, start, 32, shard_rows=20, at_once=3)
        for slot, tokens in reader:
            whole[slot] = tokens.tobytes()
            if slot + 1 == stop:
                break
    assert whole == want and list(whole) == list(range(total))
    assert list(t.read_from(folder, total, 32, shard_rows=20)) == [] and list(t.read_from(folder, 10 * total, 32, shard_rows=20)) == []
    # a second attempt at a task leaves the same files
    t.write_shards(t.place(rows, total, shard_rows=20), folder).collect()
    assert {s: x.tobytes() for s, x in t.read_from(folder, 0, 32, shard_rows=20)} == want
