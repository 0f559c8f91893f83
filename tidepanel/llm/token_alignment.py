"""Alignment of two tokenizers over a corpus, with an identity map for the common case (operator 13).

An array gives, for each id of the first vocabulary, the id of the second with the same bytes.
A group of one token on each side whose ids this array links is exact: it is counted in a vector
of the vocabulary's length and never leaves its task as a row. Only links of irregular groups are
shuffled, as counts of id pairs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.bpe_count import byte_symbols
from tidepanel.llm.shared import slices
from tidepanel.llm.slack_packing import ranked_encoding
from tidepanel.session import materialise

#: A pair with over 1 / HOT_PAIRS of all irregular links is sent to every task, so at most HOT_PAIRS are.
HOT_PAIRS = 1 << 17
#: Distinct pairs a task holds before it sends their counts on.
HELD_PAIRS = 1 << 20


class Aligner:
    """Tokenizers A (byte-level BPE of ``tokenizers``) and B (``sentencepiece``) with their tables."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True
        self.ranked = ranked_encoding(path_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        names = self.library.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        p = self.pieces
        self.bytes_b = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i)
                        else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
        # a piece goes before a lone byte: that is what the library chooses where it has both
        by_bytes = {b: i for i, b in enumerate(self.bytes_b) if p.is_byte(i)}
        by_bytes |= {b: i for i, b in enumerate(self.bytes_b)
                     if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
        self.same = np.array([by_bytes.get(b, -1) for b in self.bytes_a], np.int64)
        self.size_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.names = np.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)
        self.exact = np.array([f"{a}|{b}" for a, b in enumerate(self.same)], object)

    def tokens(self, body: bytes | None) -> tuple[list[int], list[int]] | None:
        """Ids of both; None where a text is null, empty or not kept byte for byte by both."""
        if not body:
            return None
        try:
            text = body.decode()
        except UnicodeDecodeError:
            return None
        whole = b" " + body
        b = self.pieces.encode(text, num_threads=1)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        if self.ranked is None:
            a = self.library.encode(" " + text, add_special_tokens=False).ids
        else:
            a = self.ranked.encode_ordinary(" " + text)
        return (a, b) if b"".join(map(self.bytes_a.__getitem__, a)) == whole else None

    def align(self, bodies: list[bytes | None]) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, groups_sha256, its exact A ids and its irregular pairs.

        All texts are laid end to end. A stretch between two neighbouring token ends of either side lies in one
        token of each, and two tokens overlap in one such stretch, so the stretches are the links.
        """
        found = [self.tokens(b) for b in bodies]
        kept = [k for k, f in enumerate(found) if f is not None]
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not kept:
            return [none] * len(bodies)
        a = np.array([i for k in kept for i in found[k][0]], np.int64)
        b = np.array([i for k in kept for i in found[k][1]], np.int64)
        n_a, n_b = ([len(found[k][s]) for k in kept] for s in (0, 1))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.unique(np.concatenate((end_a, end_b)))
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        closes = (end_a[at_a] == cuts) & (end_b[at_b] == cuts)
        opens = np.concatenate(([True], closes[:-1]))
        left, right = a[at_a], b[at_b]
        exact = opens & closes & (self.same[left] == right)
        ends = end_a[np.cumsum(n_a) - 1]
        links = np.searchsorted(cuts, ends, side="right")
        last = np.flatnonzero(closes)
        first = np.flatnonzero(opens)
        groups = np.searchsorted(last, links)
        names = self.exact[left[last]]
        text_a, text_b = self.names[a], self.names[b]
        for g in np.flatnonzero(~exact[last]).tolist():
            i, j = first[g], last[g]
            names[g] = (",".join(text_a[at_a[i]:at_a[j] + 1]) + "|" + ",".join(text_b[at_b[i]:at_b[j] + 1]))
        out = [none] * len(bodies)
        low = low_group = 0
        for k, of, high, high_group in zip(range(len(kept)), kept, links.tolist(), groups.tolist()):
            one = exact[low:high]
            said = ";".join(names[low_group:high_group].tolist())
            odd = left[low:high][~one] << 32 | right[low:high][~one]
            out[of] = (n_a[k], n_b[k], high_group - low_group, high - low,
                       hashlib.sha256(said.encode()).hexdigest(), left[low:high][one], odd)
            low, low_group = high, high_group
        return out


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of vocabularies in a worker."""
    return Aligner(path_a, path_b)


def _counted(values: np.ndarray) -> bytes:
    """Distinct values and how often each occurs, as bytes."""
    own, times = np.unique(values, return_counts=True)
    return own.astype("<i8").tobytes() + times.astype("<i8").tobytes()


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, value and times of each entry of ``_counted`` bytes."""
    bodies = column.to_pylist()
    sizes = np.array([len(b) // 16 for b in bodies], np.int64)
    flat = np.frombuffer(b"".join(bodies), "<i8")
    row = np.repeat(np.arange(len(bodies)), sizes)
    at = np.arange(len(row)) + np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, flat[at], flat[at + np.repeat(sizes, sizes)]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, and the exact ids and irregular pairs with their times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b).align
        for whole in batches:
            for batch in slices(whole, 64):
                got = list(zip(*align(batch.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, pa.int64()) for c in got[:4]], pa.array(got[4], pa.string()),
                     *[pa.array([_counted(v) for v in c], pa.binary()) for c in got[5:]]],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "other"])

    kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]
    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("body")).mapInArrow(
        run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
             "same binary, other binary")


def pair_counts(rows: DataFrame, same: np.ndarray) -> DataFrame:
    """(pair, n, odd): links of each id pair (A << 32 | B) over the corpus, and how many of them are irregular.

    Exact links are summed in a vector a task; irregular ones in a bounded table, which is sent on when full.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.zeros(len(same), np.int64)
        pairs = times = np.zeros(0, np.int64)

        def sent(p: np.ndarray, n: np.ndarray, odd: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(n), pa.array(odd)], names=["pair", "n", "odd"])

        for whole in batches:
            for batch in slices(whole, 1024):
                _, ids, n = _read(batch.column(0))
                exact += np.bincount(ids, n, len(same)).astype(np.int64)
                _, more, n = _read(batch.column(1))
                pairs, place = np.unique(np.concatenate((pairs, more)), return_inverse=True)
                times = np.bincount(place, np.concatenate((times, n)), len(pairs)).astype(np.int64)
                if len(pairs) > HELD_PAIRS:
                    yield sent(pairs, times, times)
                    pairs = times = np.zeros(0, np.int64)
        yield sent(pairs, times, times)
        at = np.flatnonzero(exact)
        yield sent(at << 32 | same[at], exact[at], np.zeros(len(at), np.int64))

    return (rows.select("same", "other").mapInArrow(run, "pair bigint, n bigint, odd bigint")
            .groupBy("pair").agg(F.sum("n").alias("n"), F.sum("odd").alias("odd")))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
                     hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    A is given a space and the text, B the text (it adds the space); special strings are plain text.
    Rows whose text is null, empty or not kept byte for byte by either tokenizer have no tokens: zeros
    and an empty string. Whole texts are aligned, however long. n_best counts the links whose pair is
    the most frequent of its B id, ties included; count_sum adds the corpus-wide counts of the links.
    Repeated rows and null keys are rows like any other; an empty table gives no rows; further columns
    don't matter. Pairs that hold over 1 / ``hot_pairs`` of the irregular links are sent to all tasks,
    the rest meets its counts in a shuffle in which no pair is frequent.
    """
    spark, same = docs.sparkSession, aligner(path_a, path_b).same
    rows = materialise(aligned(docs, path_a, path_b, key, text).withColumn("row", F.monotonically_increasing_id()),
                       "aligned")
    counts = pair_counts(rows, same).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = materialise(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = materialise(counts.join(most, "b").select("pair", "n", "odd", (F.col("n") == F.col("most")).alias("best")),
                         "pairs")
    total = counts.agg(F.sum("odd")).first()[0] or 0
    hot = F.col("odd") * F.lit(hot_pairs).cast("long") > F.lit(total)
    a_of = F.shiftright("pair", 32)
    linked = spark.createDataFrame([(a, int(b)) for a, b in enumerate(same) if b >= 0], "a bigint, b bigint")
    # both are bounded: by the vocabulary, and by hot_pairs
    exact = counts.join(F.broadcast(linked.select((F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("pair"))),
                        "pair", "left_semi").select(a_of.alias("a"), "n", "best").collect()
    known = sorted(map(tuple, counts.where(hot).select("pair", "n", "best").collect()))
    exact_n, exact_best = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
    for a, n, best in exact:
        exact_n[a], exact_best[a] = n, best
    hot_pair, hot_n = (np.array([k[c] for k in known], np.int64) for c in (0, 1))
    hot_best = np.array([k[2] for k in known], bool)

    def is_hot(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(hot_pair, pairs)
        inside = np.minimum(at, max(len(hot_pair) - 1, 0))
        return (hot_pair[inside] == pairs if len(hot_pair) else np.zeros(len(pairs), bool)), inside

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over exact and hot links."""
        for whole in batches:
            for batch in slices(whole, 1024):
                best, total_n = np.zeros((2, batch.num_rows), np.int64)
                row, ids, n = _read(batch.column(1))
                np.add.at(best, row, n * exact_best[ids])
                np.add.at(total_n, row, n * exact_n[ids])
                row, pairs, n = _read(batch.column(2))
                inside, at = is_hot(pairs)
                np.add.at(best, row[inside], n[inside] * hot_best[at[inside]])
                np.add.at(total_n, row[inside], n[inside] * hot_n[at[inside]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(total_n)],
                                                 names=["row", "n_best", "count_sum"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows' links that are neither exact nor hot."""
        for whole in batches:
            for batch in slices(whole, 1024):
                row, pairs, n = _read(batch.column(1))
                cold = ~is_hot(pairs)[0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[cold])), pa.array(pairs[cold]), pa.array(n[cold])],
                    names=["row", "pair", "times"])

    sums = rows.select("row", "same", "other").mapInArrow(near, "row bigint, n_best bigint, count_sum bigint")
    cold = (rows.select("row", "other").mapInArrow(far, "row bigint, pair bigint, times bigint")
            .join(counts.where(~hot & (F.col("odd") > 0)), "pair"))
    cold = cold.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
                       (F.col("times") * F.col("n")).alias("count_sum"))
    sums = sums.unionByName(cold).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row").select(
        F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
