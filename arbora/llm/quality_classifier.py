"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL-Proximal.

Features of a text are the hashed unigrams and bigrams of its lower-cased words and of its words'
shapes (letters, digits and symbols by class, runs squeezed; a word equal to the one before it is a
shape of its own). A feature's value is its count divided by the number of words. A score is the
logistic of one sparse dot product a text.

Training uses at most `fit_rows` labelled documents, those with the least hash of their id. They are
dealt to `shards` trainers, each of which makes several passes of follow-the-regularised-leader
updates; the weights are averaged. Scoring reads every whole text.

Defined results: null and empty texts have no features and get the score of the bias; a document
with several labels takes the greatest; null labels and ids are not learnt from; without any label
the score is 0.5; very long texts are read whole, in pieces; repeated rows are scored one by one;
other columns are kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import column, columns, crc_mod, free_name, mix, prepare, utf8, word_hashes

#: Log2 of the number of weights.
BITS = 18
#: Documents to learn from, at most.
FIT_ROWS = 8_000
#: Bytes of text whose features are held at once.
GROUP_BYTES = 1 << 21

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[np.r_[ord("a") : ord("z") + 1, 128:256]] = ord("a")
_SHAPE[np.r_[ord("A") : ord("Z") + 1]] = ord("A")
_SHAPE[np.r_[ord("0") : ord("9") + 1]] = ord("0")
_SALT = [np.uint64(x) for x in (0x1F3D5B79, 0x2A4C6E81, 0x9B8D7F63, 0x5C3A1E0F)]


def _squeeze(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes with runs squeezed; white space is kept whole, so that texts keep their ends."""
    s = _SHAPE[a]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (s[1:] == 0x20) | ((s[1:] >= 0x09) & (s[1:] <= 0x0D))
    kept = np.flatnonzero(keep)
    return s[kept], kept


def _bucket(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + salt * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) weight indices of the words of all texts, and each text's number of words."""
    lower = [(t or b"").lower() for t in texts]
    words, n = word_hashes(lower)
    shapes, m = word_hashes(texts, _squeeze)
    assert (n == m).all()
    first = np.zeros(len(words), dtype=bool)
    starts = np.concatenate(([0], np.cumsum(n)))[:-1]
    first[starts[n > 0]] = True
    before = np.concatenate((words[:1], words[:-1]))
    before_shape = np.concatenate((shapes[:1], shapes[:-1]))
    same = (words == before) & ~first
    shapes = np.where(same, np.uint64(0xABCDEF0123456789), shapes)
    with np.errstate(over="ignore"):
        c = np.uint64(0xD6E8FEB86659FD93)
        pair = np.where(first, words, before * c + words)
        shape_pair = np.where(first, shapes, before_shape * c + shapes)
    return np.stack([_bucket(h, s) for h, s in zip((words, pair, shapes, shape_pair), _SALT, strict=True)], axis=1), n


def groups_of_bytes(texts: list[bytes | None], size: int = GROUP_BYTES) -> Iterator[list[bytes | None]]:
    """Consecutive texts of about `size` bytes together."""
    group: list[bytes | None] = []
    held = 0
    for t in texts:
        group.append(t)
        held += len(t or b"")
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def train_ftrl(texts: list[bytes | None], labels: list[int], passes: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.5) -> np.ndarray:
    """Weights (the last is the bias) by FTRL-Proximal with per-coordinate rates, one text at a time."""
    z, g2 = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rows = []
    for group in groups_of_bytes(texts):
        index, n = features(group)
        at = 0
        for k in n:
            ids, counts = np.unique(index[at : at + k], return_counts=True)
            rows.append((np.append(ids, 1 << BITS), np.append(counts / max(k, 1), 1.0)))
            at += k

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(g2[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(passes):
        for r in order.permutation(len(rows)):
            ids, x = rows[r]
            w = weights(ids)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[r]) * x
            sigma = (np.sqrt(g2[ids] + g * g) - np.sqrt(g2[ids])) / alpha
            z[ids] += g - sigma * w
            g2[ids] += g * g
    return weights(slice(None))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, shards: int = 4) -> np.ndarray:
    """Average weights of the trainers; `labels` holds the rows that may be learnt from."""
    prepare(docs.sparkSession)
    marks = labels.where(column(id_col).isNotNull() & column(label_col).isin(0, 1)).groupBy(column(id_col).alias("id")).agg(F.max(column(label_col)).alias("y"))
    order = F.xxhash64(F.col("id").cast("string"), F.lit(3))
    sample = marks.select("id", "y", order.alias("o")).orderBy("o", "id").limit(fit_rows)
    rows = docs.select(column(id_col).alias("id"), utf8(text_col).alias("t")).join(F.broadcast(sample), "id").withColumn("shard", F.pmod("o", F.lit(shards)))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "id"])
        w = train_ftrl(pdf["t"].tolist(), pdf["y"].astype(int).tolist())
        return pd.DataFrame({"n": [len(pdf)], "w": [w.astype("<f8").tobytes()]})

    trained = rows.groupBy("shard").applyInPandas(train, "n long, w binary").collect()
    if not trained:
        return np.zeros((1 << BITS) + 1)
    return np.average([np.frombuffer(r["w"], dtype="<f8") for r in trained], axis=0, weights=[r["n"] for r in trained])


def score_texts(texts: list[bytes | None], w: np.ndarray) -> np.ndarray:
    out = []
    for group in groups_of_bytes(texts):
        index, n = features(group)
        sums = np.concatenate(([0.0], np.cumsum(w[index].sum(axis=1))))
        ends = np.cumsum(n)
        out.append((sums[ends] - sums[ends - n]) / np.maximum(n, 1))
    return 1 / (1 + np.exp(-np.clip((np.concatenate(out) if out else np.zeros(0)) + w[-1], -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, out_col: str, text_col: str = "text") -> DataFrame:
    """`docs` with the probability of label 1; one pass without a shuffle, 2 MB of weights broadcast."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf(DoubleType())
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(score_texts(s.tolist(), shared.value))

    return docs.withColumn(out_col, apply(utf8(text_col)))


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 3) == 1


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns they came with."""
    p = free_name(docs, "quality_score")
    w = fit(docs, labels.where(~held_out()))
    return score(docs, w, p).where(F.col(p) >= threshold).select(*columns(docs))
