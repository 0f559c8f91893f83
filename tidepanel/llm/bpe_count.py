"""Token counts by byte-pair merging with a heap and a linked list (operator 5).

A pre-token's count is its initial symbols less the merges done; identifiers are
never formed. Counts of white-space-free chunks are kept in a bounded map per
worker, so the merging itself runs once for each new chunk.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.shared import Kept, slices

#: Chunks whose counts a task keeps before it starts anew; a limit on memory only.
KEPT_CHUNKS = 800_000
LIMIT = 2048


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary, in byte order:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of a text as the vocabulary file's own library gives them.

    Takes BPE files of the ``tokenizers`` library with a split pattern, a
    byte-level alphabet and an end-of-word suffix. Added tokens inside a text
    count as one token each, as is the library's default.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = self.ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.suffix = model["end_of_word_suffix"] or ""
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.symbols = byte_symbols()
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self.kept = Kept(self.chunk, KEPT_CHUNKS)

    def merged(self, symbols: list[int]) -> int:
        """Symbols left after all merges, the lowest rank and then the leftmost first.

        A heap entry is a rank and a place; it is out of date where the symbol
        there and the next one no longer make that rank's pair.
        """
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        rank_of, made, left, low = self.ranks.get, self.made, size, (1 << 32) - 1
        heap = [rank << 32 | i for i in range(size - 1)
                if (rank := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & low
            j = after[i]
            if j >= size or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != entry >> 32:
                continue
            symbols[i], symbols[j] = made[entry >> 32], -1
            k = after[i] = after[j]
            left -= 1
            if k < size:
                before[k] = i
                rank = rank_of(symbols[i] << 32 | symbols[k])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | i)
            k = before[i]
            if k >= 0:
                rank = rank_of(symbols[k] << 32 | symbols[i])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | k)
        return left

    def chunk(self, chunk: str) -> int:
        """Tokens of text without white space."""
        if chunk.isascii():
            plain = chunk.lower()
        else:
            plain = "".join([c.lower() for c in unicodedata.normalize("NFC", chunk)])
        total, ids = 0, self.ids
        for word in self.pattern.findall(plain):
            symbols = [self.symbols[b] for b in word.encode()]
            symbols[-1] += self.suffix
            total += self.merged([ids[s] for s in symbols if s in ids])
        return total

    def plain(self, text: str) -> int:
        return sum(self.kept.all(self.space.split(text) if self.odd.search(text) else text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or "<|" not in text:
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@functools.cache
def counter(path: str) -> MergeCounter:
    """One for each vocabulary in a worker; its map serves the worker's later tasks too."""
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id",
                 limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of each row's whole text.

    A null or empty text has 0 bytes and 0 tokens. Each row is counted by
    itself, repeated rows too; no shuffle.
    """
    kind = dict(docs.select(key).dtypes)[key]
    rows = docs.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for whole in batches:
            for batch in slices(whole):
                counts = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts],
                                                 names=[key, "n_bytes", "n_tokens"])

    return (rows.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit))
