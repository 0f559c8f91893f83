"""Helpers of the training-data operators: tables, text batches, hashed character grams."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the ``documents`` table, in order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Characters that separate words: space and code points 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def on_whole_rows(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage (docs, ...) -> rows of docs, for tables with any further columns.

    The stage gets the columns of ``documents`` that there are and the caller's whole row in one struct,
    ``__doc``, so no name of the caller's can meet one that the stage uses; the first of several columns
    of one name counts. The rows it returns get the caller's columns back, values, names and order.
    """
    @functools.wraps(stage)
    def run(docs: DataFrame, *rest: Any, **named: Any) -> DataFrame:
        names = docs.columns
        plain = docs.toDF(*[f"f{i}" for i in range(len(names))])
        read = [F.col(f"f{names.index(c)}").alias(c) for c in DOCUMENT_COLUMNS if c in names]
        kept = stage(plain.select(*read, F.struct(*plain.columns).alias("__doc")), *rest, **named)
        return kept.select(*[F.col("__doc")[f"f{i}"].alias(n) for i, n in enumerate(names)])

    return run


def unit_hash(*columns: Column | str, salt: str = "") -> Column:
    """A repeatable uniform number in [0, 1) from the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that the Python objects of few rows live at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


class Kept:
    """Answers of a pure function for recent strings, in bounded memory.

    Two generations: when the young one is full it becomes the old one, whose
    entries come back as they are asked for again, so common strings stay.
    """

    def __init__(self, compute: Callable[[str], Any], most: int, longest: int = 64) -> None:
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.compute, self.most, self.longest = compute, most // 2, longest

    def miss(self, key: str) -> Any:
        """The answer for a key that ``young`` lacks."""
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def all(self, keys: list[str]) -> list[Any]:
        get, miss, out = self.young.get, self.miss, []
        for key in keys:
            value = get(key)
            if value is None:
                value = miss(key)
                get = self.young.get
            out.append(value)
        return out


_CLASSES: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """True for each code point that is a letter; built once per worker."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _CLASSES


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeeze_letters(codes: np.ndarray) -> np.ndarray:
    """Letters as they are, each run of anything else as one space."""
    letter = letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, np.uint32(32))[keep]


def gram_counts(parts: list[np.ndarray], orders: tuple[int, ...], buckets: int,
                piece: int = 1 << 20) -> np.ndarray:
    """Hashed n-gram counts, a row per array of code points; ``buckets`` is a power of two.

    Whole arrays are counted: long ones in overlapping pieces, so that the
    working memory stays near ``piece`` code points. No n-gram spans two rows.
    """
    out = np.zeros((len(parts), buckets), np.float32)
    top, shift = max(orders), np.uint32(32 - int(buckets).bit_length() + 1)
    queue: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not queue:
            return
        codes = np.concatenate([p for _, p in queue])
        rows = np.repeat(np.arange(len(queue), dtype=np.int64), [len(p) for _, p in queue])
        sums = np.zeros(len(queue) * buckets, np.int64)
        for n in orders:
            if len(codes) < n:
                continue
            last = len(codes) - n + 1
            mixed = np.zeros(last, np.uint32)
            for k in range(n):
                mixed = (mixed ^ codes[k:last + k]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            mixed = (mixed * np.uint32(0x85EBCA77 + 2 * n)) >> shift
            inside = rows[:last] == rows[n - 1:]
            keys = rows[:last] * buckets + mixed
            sums += np.bincount(keys[inside], minlength=len(sums))
        for k, (row, _) in enumerate(queue):
            out[row] += sums[k * buckets:(k + 1) * buckets]
        queue.clear()
        held = 0

    def seam(codes: np.ndarray, start: int) -> np.ndarray:
        return codes[start:start + piece + top - 1]

    for row, codes in enumerate(parts):
        if len(codes) <= piece:
            queue.append((row, codes))
            held += len(codes)
        else:
            flush()
            for start in range(0, len(codes), piece):
                window = seam(codes, start)
                out[row] += _starts_below(window, piece, orders, buckets, shift)
            continue
        if held >= piece or len(queue) >= 256:
            flush()
    flush()
    return out


def _starts_below(window: np.ndarray, piece: int, orders: tuple[int, ...], buckets: int,
                  shift: np.uint32) -> np.ndarray:
    """Counts of the n-grams that start in the first ``piece`` places of a window."""
    sums = np.zeros(buckets, np.int64)
    for n in orders:
        last = min(piece, len(window) - n + 1)
        if last <= 0:
            continue
        mixed = np.zeros(last, np.uint32)
        for k in range(n):
            mixed = (mixed ^ window[k:last + k]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        mixed = (mixed * np.uint32(0x85EBCA77 + 2 * n)) >> shift
        sums += np.bincount(mixed, minlength=buckets)
    return sums
