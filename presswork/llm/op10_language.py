"""Language identification by rank-order profiles.

A text's letters in lower case, with runs of anything else as one space, give n-grams of 1 to 3 characters. The
profile of a language is the ``PROFILE`` most frequent n-grams of its training texts, in order; a text's own most
frequent n-grams are compared to each profile by the out-of-place distance: the sum of the differences in place,
``PROFILE`` for an n-gram that the profile lacks. The nearest language is predicted.

Only text and language of documents whose crc32(id as text) mod 3 is not 1 are learnt from. All of them count:
each task sums its n-grams by language, Spark sums the tasks' sums. What goes to the driver and back to the tasks
is the profiles, ``PROFILE`` n-grams for each language, in blocks of ``LANGUAGES`` languages: texts are compared to one
block after the other, and the nearest language so far is kept.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
learnt; equal counts are ordered by n-gram, equal distances by language; a null id is the empty text for crc32;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import small_batches, tidy

PROFILE, LANGUAGES, UNKNOWN = 400, 500, "und"
#: Documents of a lower score are in none of the languages.
LEAST = 0.3
#: Columns that are added to those of the documents.
PREDICTED, SCORED = "_rank_order_language", "_rank_order_score"
#: Characters that are counted at once.
PIECE = 1 << 18
_BITS = 21  # of a code point


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@cache
def _fold() -> np.ndarray:
    """Each code point's lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, each text with a space before and after, runs of spaces as one; the text of each."""
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    code = _fold()[raw]
    double = np.zeros(len(code), bool)
    double[1:] = (code[1:] == 32) & (code[:-1] == 32) & (text[1:] == text[:-1])
    return code[~double].astype(np.uint64), text[~double]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), ordered by text; an n-gram is its code points in 21 bits each."""
    code, text = _codes(texts)
    alphabet, dense = np.unique(code, return_inverse=True)  # few characters, so a text and an n-gram fit one number
    size = np.uint64(len(alphabet) + 1)
    dense = dense.astype(np.uint64) + np.uint64(1)
    owner = text.astype(np.uint64) * size**np.uint64(3)
    grams, lone = [owner + dense], code == 32
    for n in (2, 3):
        g = dense[: len(dense) - n + 1].copy()
        for k in range(1, n):
            g = g * size + dense[k : len(dense) - n + 1 + k]
        whole = text[: len(g)] == text[n - 1 :]
        grams.append((owner[: len(g)] + g)[whole])
    grams[0] = grams[0][~lone]
    every = np.concatenate(grams)
    every.sort()
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(every)]]))
    owner, rest = np.divmod(every[new], size ** np.uint64(3))
    gram = np.zeros(len(rest), np.uint64)
    letters = np.concatenate([[np.uint64(0)], alphabet])
    for k in range(3):
        rest, digit = np.divmod(rest, size)
        gram |= letters[digit.astype(np.int64)] << np.uint64(_BITS * k)
    return owner.astype(np.int64), gram.astype(np.int64), count


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about PIECE characters and at most 2^12 texts."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE or i - begin >= 4095 or i == len(texts) - 1:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


def learnt(rows: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place) of each language's profile, from rows (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for begin, texts in _pieces(batch.column("text").to_pylist()):
                owner, gram, n = counted(texts)
                own = langs[begin : begin + len(texts)][owner]
                for lang in set(own):
                    grams, at = np.unique(gram[own == lang], return_inverse=True)
                    sums = held.setdefault(lang, {})
                    for g, k in zip(grams.tolist(), np.bincount(at, n[own == lang]).astype(np.int64).tolist(), strict=True):
                        sums[g] = sums.get(g, 0) + k
                if sum(map(len, held.values())) > 1_000_000:
                    yield from out()
        yield from out()

    sums = rows.filter("text is not null and lang is not null").mapInArrow(tidy(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= size)
    return ranked.select("lang", "gram", "place")


def identified(docs: DataFrame, profiles: dict[str, dict[int, int]], columns: list[str], size: int = PROFILE, most: int = LANGUAGES) -> DataFrame:
    """The columns with prediction and score, 1 for the distance 0 and 0 for the greatest that there can be."""
    order, rows = sorted(profiles), docs
    for k in range(0, max(1, len(order)), most):
        rows = _compared(rows, {n: profiles[n] for n in order[k : k + most]}, columns if k == 0 else [c for c in rows.columns if c not in (PREDICTED, SCORED)], size, k > 0)
    return rows.select(*[F.col(f"`{c}`") for c in [*columns, PREDICTED, SCORED]])


def _compared(docs: DataFrame, profiles: dict[str, dict[int, int]], columns: list[str], size: int, again: bool) -> DataFrame:
    """The columns (and text) with the nearest of these languages, or the one of a block before if it is as near."""
    columns = [*columns, *([] if "text" in columns else ["text"])]
    names = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    places = np.array([[profiles[n].get(g, -1) for g in grams.tolist()] for n in names], np.int64).reshape(len(names), len(grams))
    schema = T.StructType([*[f for f in docs.schema if f.name in columns], T.StructField(PREDICTED, T.StringType()), T.StructField(SCORED, T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if again:
                found, scores = batch.column(PREDICTED).to_pylist(), batch.column(SCORED).to_numpy().copy()
            for begin, part in _pieces(texts) if names else ():
                owner, gram, n = counted(part)
                order = np.lexsort((gram, -n, owner))
                owner, gram = owner[order], gram[order]
                first = np.searchsorted(owner, np.arange(len(part)))
                place = np.arange(len(owner)) - first[owner] + 1
                owner, gram, place = owner[place <= size], gram[place <= size], place[place <= size]
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                known = grams[at] == gram
                far = np.empty((len(names), len(part)))
                for k in range(len(names)):
                    theirs = np.where(known, places[k][at], -1)
                    far[k] = np.bincount(owner, np.where(theirs < 0, size, np.minimum(np.abs(theirs - place), size)), len(part))
                of = np.bincount(owner, minlength=len(part))
                best = far.argmin(0)
                for i in np.flatnonzero(of):
                    score = 1 - far[best[i], i] / (of[i] * size)
                    if found[begin + i] == UNKNOWN or score > scores[begin + i]:
                        found[begin + i], scores[begin + i] = names[best[i]], score
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*columns, PREDICTED, SCORED])

    return docs.mapInArrow(tidy(judge), schema)


def profiles_of(docs: DataFrame, key: str = "doc_id", size: int = PROFILE) -> dict[str, dict[int, int]]:
    """The profiles, learnt from the rows that are not held out."""
    small_batches(docs.sparkSession)
    out: dict[str, dict[int, int]] = {}
    for r in learnt(docs.filter(~held_out(key)).select("text", "lang"), size).collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["place"]
    return out


def languages(docs: DataFrame, key: str = "doc_id", size: int = PROFILE) -> DataFrame:
    """key, held_out, lang_pred, score."""
    profiles = profiles_of(docs, key, size)
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), "text")
    return identified(rows, profiles, [key, "held_out"], size).withColumnsRenamed({PREDICTED: "lang_pred", SCORED: "score"})


def in_known_language(docs: DataFrame, key: str = "doc_id", least: float = LEAST, size: int = PROFILE) -> DataFrame:
    """The documents, without those whose language is unknown or whose score is under ``least``."""
    columns = list(docs.columns)
    return identified(docs, profiles_of(docs, key, size), columns, size).filter((F.col(PREDICTED) != UNKNOWN) & (F.col(SCORED) >= least)).select(*[F.col(f"`{c}`") for c in columns])
