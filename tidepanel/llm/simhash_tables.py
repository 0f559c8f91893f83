"""Document fingerprints: weighted SimHash and permuted block tables (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.graph import components
from tidepanel.llm.hamming import near_roots
from tidepanel.llm.shared import slices
from tidepanel.session import materialise

BITS, TERM_WORDS, SEED = 128, 5, 42
RADIUS, BLOCK_BITS = 6, 16
#: Rows of a table's bucket above which it is split by a second block; not a limit on results.
BUCKET_ROWS = 4096


def run_hashes(words: list[bytes], size: int = TERM_WORDS) -> np.ndarray:
    """The 128-bit hash (n x 16 bytes) of each run of ``size`` words; fewer words make one run."""
    if not words:
        return np.zeros((0, 16), np.uint8)
    joined = b" ".join(words)
    digest = xxhash.xxh3_128_digest
    if len(words) <= size:
        return np.frombuffer(digest(joined, SEED), np.uint8).reshape(1, 16)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1:] - 1).tolist()
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)]),
                         np.uint8).reshape(-1, 16)


def term_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's terms: its runs of five words, and its single words (what short texts keep)."""
    digest = xxhash.xxh3_128_digest
    singles = np.frombuffer(b"".join([digest(w, 0) for w in words]), np.uint8).reshape(-1, 16)
    return run_hashes(words), singles


def vote(terms: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Signed votes of the distinct terms, each with weight 1 + ln(its count); no term: zeros."""
    if not len(terms[0]):
        return bytes(BITS // 8)
    votes = np.zeros(BITS)
    for hashes in terms:
        _, first, counts = np.unique(np.ascontiguousarray(hashes[:, :8]).view(np.uint64).ravel(),
                                     return_index=True, return_counts=True)
        weights = (1 + np.log(counts)).astype(np.float32)
        for k in range(0, len(first), 1 << 14):
            part = slice(k, k + (1 << 14))
            bits = np.unpackbits(hashes[first[part]], axis=1).astype(np.float32)
            votes += 2.0 * (weights[part] @ bits) - weights[part].sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by as many of the first code points of another."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def edited_hashes(own: tuple[np.ndarray, np.ndarray], text: str,
                  edited: str) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of the edited text; those before the edit are taken from the text's ``own``."""
    new = edited.encode().lower().split()
    kept = len(text) - len(text) // 3
    same = len(text[:kept].encode().split()) - TERM_WORDS
    if same <= 0 or len(own[0]) <= same or len(new) <= TERM_WORDS:
        return term_hashes(new)
    return tuple(np.concatenate((a[:same], b)) for a, b in zip(own, term_hashes(new[same:])))


def with_following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, bucket, guest) rows dealt and sorted so that each row's next one stands behind it.

    Order: descending key, nulls last, ties by text; the last row is followed by
    the first. Keys are cut into ranges; each text moves once, and only the rows
    at the head of a range are sent to the range before it too, as guests. The
    driver sees the largest key of each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.col("key").cast("double").alias("at")).where("at IS NOT NULL")
    cuts = ids.approxQuantile("at", [i / (8 * tasks) for i in range(1, 8 * tasks)], 0.002 / 8)
    splits = [-float("inf"), *sorted({*cuts, 0.0}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(
        rows.withColumn("at", F.coalesce(F.col("key").cast("double"), F.lit(0.0))))
    rows = rows.select("key", "text", F.when(F.col("key").isNull(), -1).otherwise(
        F.col("range")).cast("int").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.max("key").alias("head")).orderBy(F.desc("bucket")).collect()
    order = [h.bucket for h in heads]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    if not order:
        return rows.withColumn("guest", F.lit(0)).limit(0)
    known = F.create_map(*[F.lit(x) for h in heads for x in (h.bucket, h.head)])
    sent = F.create_map(*[F.lit(x) for b in order for x in (b, before[b])])
    at_head = F.col("key").eqNullSafe(F.element_at(known, F.col("bucket")))
    copies = F.when(at_head, F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")),
        F.struct(F.element_at(sent, F.col("bucket")).alias("bucket"), F.lit(1).alias("guest")))
    ).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))))
    dealt = rows.select("key", "text", F.explode(copies).alias("c")).select(
        "key", "text", "c.bucket", "c.guest")
    return dealt.repartition(tasks, "bucket").sortWithinPartitions(
        "bucket", "guest", F.col("key").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness and the next row's.

    A null text is empty; an empty one has the zero fingerprint and an empty
    edit. Repeated rows follow each other. A table of one row is followed by itself.
    """
    kind = dict(docs.select(key).dtypes)[key]
    schema = (f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: key, text, bucket, its term hashes and fingerprint
        out: list[tuple] = []
        for whole in batches:
            for batch in slices(whole):
                for own_key, body, bucket, guest in zip(*[c.to_pylist() for c in batch.columns]):
                    hashes = term_hashes(body.encode().lower().split())
                    mark = vote(hashes)
                    if last is not None and last[2] == bucket:
                        key_, text_, _, own, print_ = last
                        changed = edit(text_, body)
                        second = vote(edited_hashes(own, text_, changed))
                        out.append((key_, len(text_), hashlib.sha256(changed.encode()).hexdigest(),
                                    print_.hex(), second.hex(), likeness(print_, second),
                                    likeness(print_, mark)))
                    last = None if guest else (own_key, body, bucket, hashes, mark)
                if out:
                    yield _rows(out, names, batch.schema.field(0).type)
                    out = []

    return with_following(docs, key, text).mapInArrow(run, schema)


def _rows(out: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def block_table_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (hi, lo longs) -> (a, b) pairs of hex strings' hashes that join all within the radius.

    Table k holds the fingerprints by their k-th block of 16 bits, moved to the
    front. Fingerprints within the radius agree on two of the eight blocks at
    least, so the first seven tables hold every pair in some bucket. A bucket
    with more than BUCKET_ROWS rows is split by a second block, again without
    losing a pair. A bucket sends on a spanning star of each linked set.
    """
    blocks = BITS // BLOCK_BITS
    if radius > blocks - 2:
        raise ValueError(f"radius {radius} needs more than {blocks} blocks")

    def block(k: int):
        word = F.col("hi") if k < blocks // 2 else F.col("lo")
        shift = BLOCK_BITS * (k % (blocks // 2))
        return (F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))
                + F.lit(k << BLOCK_BITS).cast("long"))

    rows = distinct.select("node", "hi", "lo", F.array(*[block(k) for k in range(blocks)]).alias("blocks"))
    rows = rows.withColumn("first", F.explode(F.slice("blocks", 1, blocks - 1)))
    large = materialise(rows.groupBy("first").count().where(F.col("count") > BUCKET_ROWS).select("first"),
                        "large-buckets")
    small = rows.join(large, "first", "left_anti").withColumn("second", F.lit(-1).cast("long"))
    split = rows.join(large, "first").withColumn(
        "second", F.explode(F.filter("blocks", lambda x: x != F.col("first"))))
    columns = ["first", "second", "node", "hi", "lo"]

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of many buckets; a bucket that a batch cuts waits for its rest."""
        held = np.empty((0, len(columns)), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts, stops = np.append(0, new), np.append(new, len(rows))
            found: list[np.ndarray] = []
            for k in np.flatnonzero(stops - starts > 1):
                bucket = rows[starts[k]:stops[k]]
                roots = near_roots(np.ascontiguousarray(bucket[:, 3:]).view(np.uint64), radius)
                moved = roots != np.arange(len(roots))
                if moved.any():
                    found.append(np.column_stack((bucket[moved, 2], bucket[roots[moved], 2])))
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns])
            rows = np.concatenate((held, rows))
            last = (rows[:, :2] == rows[-1, :2]).all(axis=1) if len(rows) else np.empty(0, bool)
            held = rows[last]
            if not last.all():
                yield links(rows[~last])
        if len(held):
            yield links(held)

    dealt = small.select(columns).unionByName(split.select(columns)).repartition("first", "second")
    return dealt.sortWithinPartitions("first", "second", "node").mapInArrow(star, "a bigint, b bigint")


def near_classes(prints: DataFrame, fingerprint: str = "fingerprint", key: str = "doc_id") -> DataFrame:
    """fingerprint -> near_class, the smallest key reachable over fingerprints within the radius.

    One row for each distinct fingerprint. A node of the graph is the smallest
    key of a fingerprint; where keys are repeated or null, a hash of the
    fingerprint stands in, so unlike rows are never joined by their keys.
    """
    text = F.col(fingerprint)
    rows = prints.groupBy(fingerprint).agg(F.min(key).alias("least"))
    rows = rows.select(fingerprint, "least", F.xxhash64(text).alias("node"),
                       *[F.conv(F.substring(text, at, 8), 16, 10).cast("long").alias(n)
                         for at, n in ((1, "a"), (9, "b"), (17, "c"), (25, "d"))])
    rows = rows.select(fingerprint, "least", "node",
                       F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("hi"),
                       F.shiftleft("c", 32).bitwiseOR(F.col("d")).alias("lo"))
    rows = materialise(rows, "prints")
    labels = components(block_table_links(rows.select("node", "hi", "lo")))
    named = rows.join(labels, "node", "left").select(
        fingerprint, "least", F.coalesce("label", "node").alias("label"))
    named = materialise(named, "classes")
    least = named.groupBy("label").agg(F.min("least").alias("near_class"))
    return named.join(least, "label").select(fingerprint, "near_class")


def fingerprint_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``edited_fingerprints`` and the near class of each row's fingerprint."""
    rows = materialise(edited_fingerprints(docs, key, text), "edited")
    return rows.join(near_classes(rows, key=key), "fingerprint").select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next", "near_class")
