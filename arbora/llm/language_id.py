"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile lists a language's most frequent character n-grams (1 to 3 letters, word edges marked) in
order of frequency. A text is given the language to whose profile its own ranked list is nearest:
the sum over its n-grams of how far each is out of place, the profile length for one that is absent.

Profiles are learnt from about `fit_rows` texts of each language (a hash of the id decides which);
every whole text is then ranked and compared. Ties go to the language that sorts first.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if no
language can be learnt; null languages are not learnt from; very long texts are read whole, piece by piece; repeated
rows are predicted one by one; other columns are kept, whatever their names; an empty table gives no
rows. The table of learnt languages comes back to the driver, PROFILE codes for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, crc_mod, prepare, utf8
from .quality_classifier import groups_of_bytes

#: N-grams of a profile.
PROFILE = 300
#: Texts to learn a language from, about.
FIT_ROWS = 1_500
#: Characters of a piece of a long text, and codes that are held before they are added up.
PIECE, MERGE = 1 << 18, 1 << 20
UNKNOWN = "und"
_MAX = 0x110000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((not 0xD800 <= c <= 0xDFFF and chr(c).isalpha() for c in range(_MAX)), dtype=bool, count=_MAX))
    return _letters[0]


def grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams. A code holds up to three code points of 21 bits; every
    run of other characters is one blank, and the text begins and ends with one.

    A long text is counted piece by piece, each with the two code points before it, and what was
    counted is added up whenever it outgrows MERGE: what is held follows the number of different
    n-grams, not the text's length.
    """
    letters = (text or b"").decode("utf-8", "replace").lower()
    codes, counts, held, tail, found = [], [], 0, np.zeros(1, dtype=np.uint64), False
    for at in range(0, len(letters), PIECE):
        c = np.frombuffer(letters[at : at + PIECE].encode("utf-32-le"), dtype=np.uint32)
        letter = _is_letter()[c]
        found = found or bool(letter.any())
        c = np.concatenate((tail, np.where(letter, c, 0), [0] if at + PIECE >= len(letters) else [])).astype(np.uint64)
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c, old = c[keep], len(tail)
        one, two = c[old:], (c[old - 1 : -1] << np.uint64(21)) | c[old:]
        three = (c[max(old - 2, 0) : -2] << np.uint64(42)) | (c[max(old - 2, 0) + 1 : -1] << np.uint64(21)) | c[max(old - 2, 0) + 2 :]
        # lengths are told apart by the two top bits
        new = np.unique(np.concatenate((one[one != 0], two | np.uint64(1 << 63), three)), return_counts=True)
        codes.append(new[0])
        counts.append(new[1])
        held += len(new[0])
        tail = c[-2:]
        if held > MERGE:
            codes, counts = ([v] for v in _added(codes, counts))
            held = len(codes[0])
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return (codes[0], counts[0]) if len(codes) == 1 else _added(codes, counts)


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal codes, added up."""
    each, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(each), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return each, total


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The `size` most frequent codes; of equal counts the lower code comes first."""
    if len(codes) > 4 * size:
        bar = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= bar], counts[counts >= bar]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> its ranked n-gram codes; `docs` holds the rows that may be learnt from."""
    prepare(docs.sparkSession)
    usable = docs.select(column(id_col).alias("id"), column(lang_col).cast("string").alias("lang"), utf8(text_col).alias("t")).where("lang is not null and t is not null")
    rate = {r["lang"]: fit_rows / r["count"] for r in usable.groupBy("lang").count().collect()}
    if not rate:
        return {}
    share = F.create_map(*[F.lit(x) for pair in rate.items() for x in pair])
    place = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(11)) / F.lit(2.0**64) + 0.5
    sample = usable.where(place < F.element_at(share, F.col("lang"))).select("lang", "t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["t"]:
                found = [grams(t) for t in texts]
                codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([k for _, k in found]), minlength=len(codes))
                yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n.astype(np.int64)})

    totals = sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # codes are compared as unsigned numbers, as in `ranked`
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code") < 0, "code")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        out.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {lang: np.array([c for _, c in sorted(rows)], dtype=np.int64).view(np.uint64) for lang, rows in sorted(out.items())}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.langs])) if self.langs else np.zeros(0, dtype=np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)  # the last row: in no profile
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def nearest(self, text: bytes | None) -> tuple[str, float]:
        """Language and one minus the distance as a share of the greatest possible distance."""
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        r = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        out = np.where(r < 0, self.size, np.abs(r - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.langs[best], 1 - float(out[best]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], out_col: str, text_col: str = "text") -> DataFrame:
    """`docs` with a struct (lang, score); one pass without a shuffle, 300 codes a language broadcast."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("struct<lang:string,score:double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Profiles(shared.value)
        for s in batches:
            yield pd.DataFrame([model.nearest(t) for g in groups_of_bytes(s.tolist()) for t in g], columns=["lang", "score"])

    return docs.withColumn(out_col, apply(utf8(text_col)))


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 4) == 2
