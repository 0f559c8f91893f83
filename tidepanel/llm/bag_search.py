"""Ranked lexical search over deduplicated bags of words (operator 11).

Documents are restricted to the items' vocabulary. Those with the same term frequencies and
the same length part m have the same score for every item, so they form a class: classes are
found by a hash, told apart by their whole content, scored once, and expanded to their members
only where they reach an item's best ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.shared import slices
from tidepanel.session import materialise

TOP = 10
#: Items and bytes of distinct item terms of a block; each block of items meets all documents.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 8 << 20
#: Postings that are scattered in one step, and classes of a dense score array.
STEP, SCORE_ROWS = 1 << 22, 512

#: A-Z to a-z; any other ASCII character that is neither a letter nor a digit to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term binary): the distinct terms of each item; rows with one id are one item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                own = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
                at = np.repeat(np.arange(len(own)), [len(o) for o in own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([t for o in own for t in o], pa.binary())],
                    names=["item", "term"])

    kind = dict(items.select(F.col(item).alias("item")).dtypes)["item"]
    return (items.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("body"))
            .mapInArrow(run, f"item {kind}, term binary").distinct())


class Vocabulary:
    """A block of items: its terms, and the items that hold each term (postings as one array)."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        names = sorted({t for _, t in rows})
        self.number = {t: k for k, t in enumerate(names)}
        held = sorted((self.number[t], i) for i, t in rows)
        self.items = np.array([i for _, i in held], np.int64)
        self.size = np.bincount(np.array([t for t, _ in held], np.int64), minlength=len(names))
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.n_items = max((i for i, _ in rows), default=-1) + 1


def _bags(docs: DataFrame, number: dict[bytes, int], key: str, text: str) -> DataFrame:
    """id, n (terms with repeats) and bag: term numbers ascending, then their frequencies, as 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for whole in batches:
            for batch in slices(whole):
                sizes, bags = [], []
                for body in batch.column(1).to_pylist():
                    words = terms(body)
                    found = np.array([k for k in map(get, words) if k is not None], np.int64)
                    own, tf = np.unique(found, return_counts=True)
                    sizes.append(len(words))
                    bags.append(np.concatenate((own, tf)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()),
                                                  pa.array(bags, pa.binary())], names=["id", "n", "bag"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body")).mapInArrow(
        run, "id bigint, n bigint, bag binary")


def _unpack(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of each entry of the bags."""
    sizes = np.array([len(b) // 8 for b in bags], np.int64)
    flat = np.frombuffer(b"".join(bags), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(bags)), sizes)
    at = np.arange(len(row)) + np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, flat[at], flat[at + np.repeat(sizes, sizes)]


def _statistics(bags: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term; a task sends on a row a term at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms + 2, np.int64)
        for whole in batches:
            for batch in slices(whole, 4096):
                n = batch.column(0).to_numpy(zero_copy_only=False)
                sums[n_terms] += np.count_nonzero(n)
                sums[n_terms + 1] += n.sum()
                sums[:n_terms] += np.bincount(_unpack(batch.column(1).to_pylist())[1], minlength=n_terms)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["term", "count"])

    rows = (bags.select("n", "bag").mapInArrow(run, "term bigint, count bigint")
            .groupBy("term").agg(F.sum("count").alias("count")).collect())
    sums = np.zeros(n_terms + 2, np.int64)
    for term, count in rows:
        sums[term] = count
    return int(sums[n_terms]), int(sums[n_terms + 1]), sums[:n_terms]


class Best:
    """The k best classes of each item so far: the highest score, then the smallest id (none last)."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.floor = k, np.zeros(n_items, np.int64)
        self.number = [np.zeros(0, np.int64)] * 4
        self.body = np.zeros(0, object)

    def take(self, scores: np.ndarray, least: np.ndarray, none: np.ndarray, body: np.ndarray) -> None:
        """``scores`` has a row per class and a column per item."""
        row, item = np.nonzero((scores > 0) & (scores >= self.floor))
        new = (item, scores[row, item], none[row].astype(np.int64), least[row])
        both = [np.concatenate(x) for x in zip(self.number, new)]
        bodies = np.concatenate((self.body, body[row]))
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        own = both[0][order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        kept = order[place < self.k]
        self.number, self.body = [x[kept] for x in both], bodies[kept]
        full = order[place == self.k - 1]
        self.floor[both[0][full]] = both[1][full]


def _scored(classes: DataFrame, words: Vocabulary, weight: np.ndarray, k: int) -> DataFrame:
    """Each task's k best classes of each item: item, score, least, m, bag."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(words.n_items, k)
        for whole in batches:
            for batch in slices(whole, SCORE_ROWS):
                least, m, bag = batch.columns
                bags, ms = bag.to_pylist(), m.to_numpy()
                row, term, tf = _unpack(bags)
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * ms[row]))
                fan = words.size[term]
                scores = np.zeros(len(bags) * words.n_items, np.int64)
                step = np.cumsum(fan) // STEP
                for s in range(int(step[-1]) + 1 if len(step) else 0):
                    of = np.arange(*np.searchsorted(step, (s, s + 1)))
                    wide = np.repeat(of, fan[of])
                    at = np.arange(len(wide)) - np.repeat(np.cumsum(fan[of]) - fan[of], fan[of])
                    item = words.items[words.start[term[wide]] + at]
                    np.add.at(scores, row[wide] * words.n_items + item, part[wide])
                body = np.empty(len(bags), object)
                body[:] = list(zip(ms.tolist(), bags))
                best.take(scores.reshape(len(bags), words.n_items),
                          least.fill_null(0).to_numpy(), least.is_null().to_numpy(zero_copy_only=False), body)
        item, score, none, ids = best.number
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(score), pa.array(ids, mask=none == 1),
             pa.array([m for m, _ in best.body], pa.int64()), pa.array([b for _, b in best.body], pa.binary())],
            names=["item", "score", "least", "m", "bag"])

    return classes.select("least", "m", "bag").mapInArrow(
        run, "item bigint, score bigint, least bigint, m bigint, bag binary")


def _class_hash() -> Column:
    return F.xxhash64("m", "bag").alias("h")


def _block(docs: DataFrame, rows: list[tuple[int, bytes]], k: int, key: str, text: str) -> DataFrame | None:
    """item (its number), rank, id, score for one block of items."""
    words = Vocabulary(rows)
    bags = materialise(_bags(docs, words.number, key, text), "bags")
    count, total, held = _statistics(bags, len(words.number))
    if not count:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in held], np.int64)
    wide = "decimal(38,0)"
    m = F.lit(10) + F.expr(f"CAST(90 AS {wide}) * n * CAST({count} AS decimal(18,0)) div CAST({total} AS {wide})")
    met = bags.where(F.octet_length("bag") > 0).select("id", m.cast("long").alias("m"), "bag").select(
        "id", "m", "bag", _class_hash())
    classes = met.groupBy("h", "m", "bag").agg(F.min("id").alias("least"))
    ahead = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("least").asc_nulls_last(), "bag", "m")
    chosen = (_scored(classes, words, weight, k).withColumn("place", F.row_number().over(ahead))
              .where(F.col("place") <= k).select("item", "score", "m", "bag", _class_hash()))
    chosen = materialise(chosen, "chosen-classes")
    # at most BLOCK_ITEMS x k hashes are sent out; whole classes are compared in the join after
    hashes = F.broadcast(chosen.select("h").distinct())
    inside = Window.partitionBy("h", "m", "bag").orderBy(F.col("id").asc_nulls_last())
    members = (met.join(hashes, "h", "left_semi").withColumn("place", F.row_number().over(inside))
               .where(F.col("place") <= k).select("h", "m", "bag", "id"))
    final = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return (chosen.join(members, ["h", "m", "bag"]).withColumn("rank", F.row_number().over(final))
            .where(F.col("rank") <= k).select("item", "rank", "id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, key, score: each item's k highest-scoring documents with a score above 0.

    Every document meets every item, in blocks of about ``BLOCK_ITEMS`` items: the vocabulary
    that is sent out and the dense score arrays are of that size whatever the tables hold.
    Null, empty and word-free texts have no term and are not counted; rows are documents, so
    repeated rows count and rank each for itself; equal scores go to the smaller key, a null key
    last. Item rows with one id (null too) are one item with the terms of all. Empty tables give
    no rows. Other columns of the tables don't matter, whatever their names.
    """
    docs = docs.select(F.col(key).alias(key), F.col(text).alias("__text"))
    own = materialise(item_terms(items, item, item_text), "item-terms")
    size = own.agg(F.countDistinct(F.struct("item")), F.sum(F.octet_length("term"))).first()
    blocks = max(1, -(-2 * size[0] // BLOCK_ITEMS), -(-2 * (size[1] or 0) // BLOCK_BYTES))
    if size[0] <= BLOCK_ITEMS and (size[1] or 0) <= BLOCK_BYTES:
        blocks = 1
    kind = dict(own.dtypes)["item"]
    spark, found = docs.sparkSession, []
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        ids = sorted({r.item for r in rows}, key=lambda x: (x is None, x))
        place = {x: i for i, x in enumerate(ids)}
        got = _block(docs, [(place[r.item], bytes(r.term)) for r in rows], k, key, "__text") if rows else None
        if got is not None:
            names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, name {kind}")
            found.append(got.join(F.broadcast(names), "item").select(
                F.col("name").alias(item), "rank", F.col("id").alias(key), "score"))
    if not found:
        return spark.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` bigint, score bigint")
    return reduce(DataFrame.unionByName, found)


SEARCH_SQL = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY r),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM f, c GROUP BY term, docs),
s AS (
  SELECT item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * docs) // total))))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s WHERE score > 0) WHERE rank <= 10
"""
