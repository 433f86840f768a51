"""Training-order materialisation of token IDs.

Texts are tokenised once; each input partition's tokens, with a separator after every document, are
cut into sequences of `length` tokens. Sequence number -> global slot is a keyed Feistel permutation
of the smallest even-bit domain, walked along its cycle until it falls below the number of
sequences. Slots are range-partitioned into shards of `shard_rows` sequences; a shard is its
sequences in slot order at a fixed stride, so a reader at slot s starts at byte
(s mod shard_rows) * stride of shard s div shard_rows, and any slot can be computed, not looked up.

The tokens are kept in Parquet until the shards are written; the exchange carries each sequence
compressed against a shared sample of sequences, as single sequences are too short to compress well.

Defined results: a null text has no tokens and no separator, an empty one only the separator; the
last sequence of a partition is filled up with separators; repeated rows are tokenised each; other
columns are not read, whatever their names; an empty table gives no sequence and no shard. Texts of any
length are tokenised as wholes: only very many white space characters in a row are handed on by
themselves, as the one piece that the pattern makes of them, which changes no token. How documents follow one another, and
so what a sequence holds, depends on how the input is split into partitions: another read of the
table with other split sizes makes other shards. Reading and resuming need only the shards.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .common import durable, prepare, shared_folder, utf8

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROUNDS = 4
#: White space characters in a row beyond which they are handed on by themselves.
RUN_CHARS = 1024
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(rf"[{_SPACE}]{{{RUN_CHARS + 1},}}")
#: Sequences that single sequences are compressed against.
SAMPLE_SEQUENCES = 64


def feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Permutation of 0 .. n - 1, element by element."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS).astype(np.uint64)

    def step(r: np.ndarray, k: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (r ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(32))) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        if inverse:
            for k in keys[::-1]:
                left, right = right ^ step(left, k), left
        else:
            for k in keys:
                left, right = right, left ^ step(right, k)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(x, dtype=np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def may_have_long_runs(text: str) -> bool:
    """Quick test without regular expressions: False only if no run of white space is over RUN_CHARS."""
    words = text.split()
    spare = len(text) - sum(map(len, words)) - len(words) + 1  # white space beyond one between words
    return spare > RUN_CHARS or any(c in text for c in "\x1c\x1d\x1e\x1f")  # these part words here, but not in _SPACE


def cut_runs(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts that are tokenised as the whole would be, and whether a part is one piece.

    White space that something follows is one piece up to its last character, which may belong to the
    next piece; at the end it is one piece. A very long run is handed on as that piece, as the pattern
    would step back over it character by character.
    """
    at = 0
    for run in _LONG_RUN.finditer(text) if may_have_long_runs(text) else ():
        stop = run.end() - (run.end() < len(text))
        yield text[at : run.start()], False
        yield text[run.start() : stop], True
        at = stop
    yield text[at:], False


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        new = lambda pattern: tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encoding, self._piece, self._new = new(PATTERN), None, new
        self.separator = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.separator < 1 << 16 else "<u4")

    def encode(self, text: bytes) -> np.ndarray:
        ids: list[int] = []
        for part, one in cut_runs(text.decode("utf-8", "replace")):
            if one and self._piece is None:
                self._piece = self._new(r"(?s).+")
            ids += (self._piece if one else self.encoding).encode_ordinary(part)
        return np.array([*ids, self.separator], dtype=self.dtype)


class Packer:
    """Compresses and restores single sequences with a sample of sequences as the common history."""

    def __init__(self, sample: bytes):
        shared = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if sample else None
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=shared, write_dict_id=False).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress


def sequences(docs: DataFrame, length: int = 1024, vocabulary: str = VOCABULARY, text_col: str = "text") -> tuple[DataFrame, int]:
    """(index, n_docs, n_tokens, tokens) of all sequences, and their number.

    The tokens are written once to the checkpoint folder; later steps read them there.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        held, size, ended, number = [], 0, 0, 0

        def pack(parts: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, ended, number
            flow = np.concatenate(parts) if parts else np.zeros(0, dtype=codec.dtype)
            whole = -(-len(flow) // length) if last else len(flow) // length
            padded = np.concatenate((flow[: whole * length], np.full(max(0, whole * length - len(flow)), codec.separator, dtype=codec.dtype)))
            rows = padded.reshape(whole, length)
            real = np.minimum(length, len(flow) - np.arange(whole) * length)
            docs_in = np.array([int((r[:k] == codec.separator).sum()) for r, k in zip(rows, real, strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + whole)), pa.array(docs_in), pa.array(real.astype(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["ordinal", "n_docs", "n_tokens", "tokens"])
            number += whole
            held = [flow[whole * length :]]
            size = len(held[0])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text is not None:
                    held.append(codec.encode(text))
                    size += len(held[-1])
                    if size >= 512 * length:
                        yield from pack(held, False)
        yield from pack(held, True)

    path = shared_folder(spark, "tokens")
    packed = docs.select(utf8(text_col).alias("t")).mapInArrow(cut, "ordinal long, n_docs long, n_tokens long, tokens binary")
    packed.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    stored = spark.read.parquet(path)
    # one number per input partition
    counts = sorted((r["part"], r["count"]) for r in stored.groupBy("part").count().collect())
    total, starts = 0, []
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, start long")
    return stored.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("ordinal")).alias("index"), "n_docs", "n_tokens", "tokens"), total


def place(rows: DataFrame, total: int, key: int = 9, shard_rows: int = 8192) -> DataFrame:
    """`rows` with slot, shard and row, each shard whole and in slot order in one partition."""

    @F.pandas_udf(LongType())
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))

    shards = max(1, -(-total // shard_rows))
    placed = rows.withColumn("slot", slot("index")).withColumn("shard", F.expr(f"cast(slot div {shard_rows} as int)")).withColumn("row", F.expr(f"cast(slot % {shard_rows} as int)"))
    return placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")


def packed(rows: DataFrame) -> tuple[DataFrame, bytes]:
    """`rows` with each sequence's tokens compressed, and the sample they are compressed against."""
    sample = b"".join(bytes(r[0]) for r in rows.select("tokens").limit(SAMPLE_SEQUENCES).collect())
    shared = rows.sparkSession.sparkContext.broadcast(sample)

    @F.pandas_udf(BinaryType())
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = Packer(shared.value)
        for s in batches:
            yield pd.Series([packer.pack(t) for t in s], dtype=object)

    return rows.withColumn("tokens", pack("tokens")), sample


def write_shards(placed: DataFrame, folder: str, sample: bytes | None = None) -> DataFrame:
    """Write `folder`/shard-NNNNNN.bin, sequences at a fixed stride; returns (shard, rows, bytes, crc32).

    `folder` is a URI that pyarrow can open on the executors; `sample` is given if the tokens come
    from `packed`. A shard is written under another name and then moved, so a task that is run again,
    or twice, leaves one whole file.
    """
    history = placed.sparkSession.sparkContext.broadcast(sample)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        unpack = bytes if history.value is None else Packer(history.value).unpack
        out, shard, rows, size, crc, done = None, None, 0, 0, 0, []

        def close() -> None:
            out.close()
            whole = f"{base}/shard-{shard:06d}.bin"
            try:
                store.move(part, whole)
            except OSError:  # some stores do not overwrite: another attempt at this task wrote the same bytes
                if store.get_file_info(whole).size != size:
                    raise
                store.delete_file(part)
            done.append((shard, rows, size, crc))

        for b in batches:
            for s, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != shard:
                    if out is not None:
                        close()
                    shard, rows, size, crc = s, 0, 0, 0
                    part = f"{base}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                tokens = unpack(tokens)
                out.write(tokens)
                rows, size, crc = rows + 1, size + len(tokens), zlib.crc32(tokens, crc)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(4)], names=["shard", "rows", "bytes", "crc32"])

    return durable(placed.select("shard", "tokens").mapInArrow(write, "shard long, rows long, bytes long, crc32 long"))


def read_digests(placed: DataFrame, folder: str, stride: int) -> DataFrame:
    """(slot, shard, row, n_docs, n_tokens, tokens_crc32): the CRC of each slot's bytes in the written shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        shard, source = None, None
        for b in batches:
            crcs = []
            for s, row in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s != shard:
                    if source is not None:
                        source.close()
                    shard, source = s, store.open_input_file(f"{base}/shard-{s:06d}.bin")
                tokens = source.read_at(stride, row * stride)
                if len(tokens) != stride:
                    raise RuntimeError(f"shard {s} ends before row {row}")
                crcs.append(zlib.crc32(tokens))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crcs, pa.int64())], names=[*b.schema.names, "tokens_crc32"])
        if source is not None:
            source.close()

    return placed.select("slot", "shard", "row", "n_docs", "n_tokens").mapInArrow(read, "slot long, shard int, row int, n_docs long, n_tokens long, tokens_crc32 long")


def read_sequence(data: bytes, row: int, length: int, dtype: str = "<u2") -> np.ndarray:
    """Sequence `row` of a shard's bytes."""
    stride = length * np.dtype(dtype).itemsize
    return np.frombuffer(data, dtype=dtype, count=length, offset=row * stride)


def read_from(folder: str, slot: int, length: int = 1024, dtype: str = "<u2", shard_rows: int = 8192, at_once: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens) in training order from any slot on, `at_once` sequences a read. A reader that was
    stopped goes on with the slot after its last one; nothing before is read again."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(dtype).itemsize
    while (info := store.get_file_info(f"{base}/shard-{slot // shard_rows:06d}.bin")).type == fs.FileType.File:
        rows = info.size // stride
        if slot % shard_rows >= rows:
            return
        with store.open_input_file(info.path) as source:
            for row in range(slot % shard_rows, rows, at_once):
                block = np.frombuffer(source.read_at(min(at_once, rows - row) * stride, row * stride), dtype=dtype).reshape(-1, length)
                for tokens in block:
                    yield slot, tokens
                    slot += 1
        if rows < shard_rows:
            return
