"""Packing by minimum bin slack (operator 6).

Documents are cut into full windows and one rest. The rests are packed by length
alone: a histogram has at most one count for each length below the capacity, so
the plan is made from that many numbers whatever the corpus holds. A bitset
subset-sum finds the multiset of remaining lengths that fills a window closest
to capacity; it is used as often as its lengths last. Pieces then look up their
place by their rank among the pieces of their length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe_count import byte_symbols
from tidepanel.llm.shared import Kept, slices
from tidepanel.session import materialise

CAPACITY = 1024
END_ID = 0
KEPT_CHUNKS = 800_000
#: Fixed value: the split of the public byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class IdBytes:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    Texts are cut before each space that a non-space follows, where the
    byte-level pre-tokenizer always cuts too, and chunks' ids are kept in a
    bounded map. New chunks are merged by ``tiktoken`` on the ranks that the
    vocabulary file lists, which is faster than the file's own library and gives the same ids where ids
    are in merge order (checked here; else that library does it). A text that
    holds an added token's string goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile(r" (?!\S)")
        self.cuts = re.compile(r"(?= \S)")
        self.ranked = ranked_encoding(path)
        self.kept = Kept(self.chunk, KEPT_CHUNKS)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, text: str) -> bytes:
        if self.ranked is None:
            return self.whole(text)
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        if self.odd.search(text):
            chunks = self.cuts.split(text)
        else:
            chunks = text.split(" ")
            chunks[1:] = [" " + c for c in chunks[1:]]
        return b"".join(self.kept.all(chunks))


def ranked_encoding(path: str):
    """The vocabulary file's byte-level merges for ``tiktoken``; None if its ids aren't in merge order."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter = spec["model"], spec["pre_tokenizer"]
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = model["vocab"]
    made = [ids[a + b] for a, b in pairs]
    plain = (cutter["type"] == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
             and spec["normalizer"] is None and not model["ignore_merges"]
             and len(ids) == len(made) + 256 and made == sorted(made))
    if not plain:
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in ids.items()}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def encoder(path: str) -> IdBytes:
    """One for each vocabulary in a worker; its map serves the worker's later tasks too."""
    return IdBytes(path)


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id",
           capacity: int = CAPACITY) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens: full windows of each document and its rest."""
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole):
                rows, starts, lengths, sums, sizes = [], [], [], [], []
                for row, text_ in enumerate(batch.column(1).to_pylist()):
                    body = ids(text_) + end
                    size = len(body) // 4
                    for start in range(0, size, capacity):
                        part = body[4 * start:4 * (start + capacity)]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        sizes.append(size)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows, pa.int64())),
                         *[pa.array(c, pa.int64()) for c in (starts, lengths, sums, sizes)]],
                        names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(
        run, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of remaining lengths, the largest among them, that sums closest to the capacity.

    ``counts`` is not empty and its lengths are 1 to ``capacity``. Bit s of the set says that s can
    be reached; doubling takes in all copies of a length, and the sets before
    each length are kept to trace the counts back.
    """
    lengths = sorted(counts, reverse=True)
    base, mask = lengths[0], (1 << (capacity + 1)) - 1
    reach, steps = 1 << base, []
    for length in lengths:
        copies = min(counts[length] - (length == base), (capacity - base) // length)
        if copies <= 0:
            continue
        steps.append((length, copies, reach))
        width = 1
        while copies:
            width = min(width, copies)
            reach |= (reach << (length * width)) & mask
            copies -= width
            width *= 2
        if reach >> capacity:
            break
    at = reach.bit_length() - 1
    picked = {base: 1}
    for length, copies, before in reversed(steps):
        used = next(k for k in range(copies + 1) if at >= k * length and before >> (at - k * length) & 1)
        if used:
            picked[length] = picked.get(length, 0) + used
            at -= used * length
    return picked


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, copies a window, windows, first sequence, offset in it)."""
    left = {k: n for k, n in histogram.items() if n > 0}
    ranks = dict.fromkeys(left, 0)
    plan, sequence = [], 0
    while left:
        picked = fullest(left, capacity)
        windows = min(left[k] // n for k, n in picked.items())
        offset = 0
        for length in sorted(picked, reverse=True):
            n = picked[length]
            plan.append((length, ranks[length], n, windows, sequence, offset))
            ranks[length] += n * windows
            offset += n * length
            left[length] -= n * windows
            if not left[length]:
                del left[length]
        sequence += windows
    return plan


def pack(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id",
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence_id and offset; every token lies in one piece.

    A null or empty text has the end id alone. Repeated rows are packed each by
    itself. Ranks within a length come from buckets of its pieces, so a length
    that a third of all documents share is spread over tasks.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, vocabulary, text, key, capacity), "pieces")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)).cast("int")
    cut = cut.withColumn("__bucket", bucket)
    counts = materialise(cut.groupBy("length", "__bucket").agg(F.count("*").alias("n")), "lengths")
    upto = Window.partitionBy("length").orderBy("__bucket")
    firsts = counts.withColumn("first", F.sum("n").over(upto) - F.col("n")).drop("n")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, np.ndarray] = {}
    for row in plan_windows(histogram, capacity):
        by_length.setdefault(row[0], []).append(row[1:])
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}
    inside = Window.partitionBy("length", "__bucket").orderBy(key, "start", "ids_crc32", "doc_tokens")
    ranked = (cut.withColumn("__rank", F.row_number().over(inside) - 1)
              .join(firsts, ["length", "__bucket"])
              .select(key, "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("__rank") + F.col("first")).cast("long").alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rows = by_length[int(length)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                step = rank[at] - row[:, 0]
                sequence[at] = row[:, 3] + step // row[:, 1]
                offset[at] = row[:, 4] + step % row[:, 1] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = dict(docs.select(key).dtypes)[key]
    return ranked.mapInArrow(
        place, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
               "sequence_id bigint, offset bigint")
