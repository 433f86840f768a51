"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.lineage import Scratch, durable, ensure_checkpoint_dir, remove_folder, shared_folder

#: Java and Python spelling of "a run of ASCII white space": 0x20 and 0x09-0x0D.
WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of one Arrow batch that Spark sends to a Python worker, at most.
BATCH_BYTES = 4 << 20
#: Rows of one batch that a Python stage sends back, at most.
BATCH_ROWS = 512


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "WHITE", "Scratch", "column", "columns", "crc_mod", "durable", "ensure_checkpoint_dir", "free_name", "hashable", "mix", "ngram_hashes", "prepare", "remove_folder", "shared_folder", "shuffled", "table", "utf8", "word_hashes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that long texts make short batches.

    The only session setting that the operators change, and never upwards; batches of narrow rows stay
    as they are.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower())
    if not size or not 0 < int(size[1]) << 10 * " kmgtp".index(size[2] or " ") <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def shuffled(df: DataFrame) -> DataFrame:
    """The table with the hint that its next join shuffles both sides.

    For rows that explode has made, or that compress well on disk: Spark takes a row's copies for one
    row and the size on disk for that in memory, and would send what is large through the driver.
    """
    return df.hint("merge")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have yet."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def hashable(df: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed and compared: maps as sorted entries or as JSON."""
    return [column(c) if "map<" not in kind else F.array_sort(F.map_entries(column(c))) if kind.count("map<") == 1 and kind.startswith("map<") else F.to_json(F.struct(column(c))) for c, kind in df.dtypes]


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32(id as text) mod `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(name: str) -> Column:
    """Whole text as UTF-8 bytes, so that Python workers need not decode it; null stays null."""
    return column(name).cast("string").cast("binary")


# ---------------------------------------------------------------------------
# Vectorised word hashing: whole texts as byte arrays, one 64-bit hash a word.

_PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_C = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, _PIECE + 1)
        _tables["p"] = _powers(int(_P), size)
        _tables["i"] = _powers(pow(int(_P), -1, 1 << 64), size)
    return _tables["p"], _tables["i"]


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising step of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of every white-space-delimited word of the byte array."""
    black = ~_WHITE[a]
    edge = np.diff(np.concatenate(([0], black.view(np.int8), [0])))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, inv = _power_tables(len(a) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], out=total[1:])
        h = (total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * _C
    return s, mix(h)


def _pieces(text: bytes) -> Iterator[bytes]:
    """Cuts at white space, of about _PIECE bytes; only a longer single word makes a larger one."""
    at = 0
    while len(text) - at > _PIECE:
        cut = at + _PIECE
        while cut < len(text) and not _WHITE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def word_hashes(texts: list[bytes | None], squash=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the number of words of each text.

    `squash`, if given, maps a byte array to (another byte array, kept positions) before words are
    hashed; white space must stay in place.
    """
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)

    def flush(group: list[tuple[int, bytes]]) -> None:
        if not group:
            return
        a = np.frombuffer(b"\n".join(t for _, t in group) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for _, t in group])
        if squash is not None:
            a, kept = squash(a)
            ends = np.searchsorted(kept, ends)
        s, h = _hash_words(a)
        hashes.append(h)
        np.add.at(counts, [i for i, _ in group], np.diff(np.searchsorted(s, ends), prepend=0))

    group: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text or b""):
            if size + len(piece) > _PIECE:
                flush(group)
                group, size = [], 0
            group.append((i, piece))
            size += len(piece) + 1
    flush(group)
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), counts


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes of one array (len(h) - n + 1 of them)."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _C + h[j : j + m]
    return mix(out)
