"""Repeats of 50 words across documents, revealed and verified by recompression (operator 12).

Equal windows hold an equal last-round symbol in their interiors, the anchor. Anchors are counted over
the corpus: one that a single text has rules out all its windows. What is left is verified by the
window's own name beside its anchor (two 64-bit numbers), and the smallest document of each is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import recompression as rc
from tidepanel.llm.shared import slices
from tidepanel.session import materialise

#: Words that are recompressed at a time; longer texts go in pieces that overlap by a window less one word.
PIECE = 1 << 17
#: Keys with over 1 / HOT_KEYS of all rows are sent to every task, so at most HOT_KEYS are.
HOT_KEYS = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def words_of(body: bytes | None) -> list[bytes]:
    """Runs without ASCII white space (space and bytes 9 to 13)."""
    return (body or b"").split()


def _pieces(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token hashes, their text's number and their place in it, about ``PIECE`` at a time."""
    digest, step = xxhash.xxh64_intdigest, PIECE
    held, size = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens = np.fromiter((digest(w) for _, _, part in held for w in part), np.uint64, size)
        lengths = [len(part) for _, _, part in held]
        # pieces of one text are owners of their own here
        owner = np.repeat(np.arange(len(held)), lengths)
        place = np.concatenate([np.arange(s, s + len(p)) for _, s, p in held])
        return tokens, owner, place

    for row, words in enumerate(texts):
        for start in range(0, max(1, len(words) - rc.WINDOW + 1), step):
            part = words[start:start + step + rc.WINDOW - 1]
            if len(part) < rc.WINDOW:
                continue
            held.append((row, start, part))
            size += len(part)
            if size >= step:
                tokens, owner, place = joined()
                yield tokens, owner, place, np.array([r for r, _, _ in held])
                held, size = [], 0
    if held:
        tokens, owner, place = joined()
        yield tokens, owner, place, np.array([r for r, _, _ in held])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _text_key(text: str) -> list[Column]:
    body = F.col(text).cast("binary")
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit("second"), body).alias("h2")]


def profiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, h1, h2 (the text's hashes), n (words), sha (of the words), anchors (distinct; of windows with an
    interior), loose (some window has none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 128):
                texts = [words_of(b) for b in batch.column(3).to_pylist()]
                loose = np.zeros(len(texts), bool)
                rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for tokens, owner, _, row in _pieces(texts):
                    first = rc.windows(owner)
                    own = rc.anchors(*rc.recompress(tokens, owner, first))
                    of = row[owner[first]]
                    loose[of[own == rc.NO_SYMBOL]] = True
                    change = np.concatenate(([True], (own[1:] != own[:-1]) | (of[1:] != of[:-1]))) if len(own) else []
                    rows.append(of[change])
                    keys.append(own[change])
                row, own = np.concatenate(rows), np.concatenate(keys)
                order = np.lexsort((own, row))
                row, own = row[order], own[order]
                new = np.ones(len(row), bool)
                new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
                new &= own != rc.NO_SYMBOL
                row, own = row[new], own[new]
                ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([hashlib.sha256(b" ".join(t)).hexdigest() for t in texts], pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(own))), pa.array(loose)],
                    names=["id", "h1", "h2", "n", "sha", "anchors", "loose"])

    return docs.select(F.col(key).cast("long").alias("id"), *_text_key(text), F.col(text).cast("binary").alias("body")
                       ).mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n bigint, sha string, "
                                         "anchors array<bigint>, loose boolean")


def _live_windows(texts: DataFrame) -> DataFrame:
    """(no, id, body, shared anchors) -> anchor, name, no, id, at: windows with a shared anchor or
    none, with the places of each in its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 128):
                shared = batch.column(3).flatten().to_numpy().view(np.uint64)
                for tokens, owner, place, row in _pieces([words_of(b) for b in batch.column(2).to_pylist()]):
                    first = rc.windows(owner)
                    own = rc.anchors(*rc.recompress(tokens, owner, first))
                    live = (own == rc.NO_SYMBOL) | np.isin(own, shared)
                    first, own = first[live], own[live]
                    name, of = rc.window_names(tokens)[first], row[owner[first]]
                    order = np.lexsort((name, own, of))
                    own, name, of, at = own[order], name[order], of[order], place[first][order]
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (name[1:] != name[:-1]) | (of[1:] != of[:-1])
                    heads = np.flatnonzero(new)
                    rows = pa.array(of[heads])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(own[heads])), pa.array(_signed(name[heads])), batch.column(0).take(rows),
                         batch.column(1).take(rows), pa.ListArray.from_arrays(
                             pa.array(np.append(heads, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))],
                        names=["anchor", "name", "no", "id", "at"])

    return texts.select("no", "id", "body", "shared").mapInArrow(
        run, "anchor bigint, name bigint, no bigint, id bigint, at array<int>")


def _cut(texts: DataFrame) -> DataFrame:
    """(sha, body, at) -> sha, n_removed, kept: the words that no window from ``at`` covers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 64):
                gone, kept = [], []
                for body, at in zip(batch.column(1).to_pylist(), batch.column(2)):
                    words = words_of(body)
                    at = at.values.to_numpy()
                    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + rc.WINDOW, minlength=len(words) + 1)
                    stays = np.cumsum(edge[:len(words)]) == 0
                    gone.append(int(len(words) - stays.sum()))
                    kept.append(hashlib.sha256(b" ".join(
                        [words[i] for i in np.flatnonzero(stays).tolist()])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                                 names=["sha", "n_removed", "kept"])

    return texts.select("sha", "body", "at").mapInArrow(run, "sha string, n_removed bigint, kept string")


def _met(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (unique on ``on``; ``times`` is how many rows a key has).

    Keys with over 1 / HOT_KEYS of all rows, at most HOT_KEYS of them, are broadcast; the shuffle of the others
    has no frequent key.
    """
    hot = F.col("times") * F.lit(HOT_KEYS).cast("long") > F.lit(total)
    often = F.broadcast(keyed.where(hot).drop("times"))
    rest = rows.join(often, on, "left_anti").join(keyed.where(~hot).drop("times"), on, how)
    return rows.join(often, on, how).unionByName(rest)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of each row.

    Words are runs without ASCII white space. A word is removed if a window of 50 words covers it that also
    starts in a row with a smaller key, judged on the input. Rows whose words are all the same are one text; the
    first of them takes part for all. Null, empty and shorter texts lose nothing. Rows with one key don't make
    each other lose words, so repeated rows get one and the same answer; a null key comes after all others
    and takes part likewise. Whole texts count, however long; an empty table gives no rows; further columns
    don't matter.
    """
    rows = materialise(profiles(docs, key, text), "profiles")
    # a text's first row, by which all its copies are judged
    first = rows.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("top"),
                                    F.count("*").alias("times"), F.first("anchors").alias("anchors"),
                                    F.max("loose").alias("loose"))
    first = materialise(first.select("sha", "times", "anchors", "loose", F.col("top.id").alias("id"),
                                     F.col("top.h1").alias("h1"), F.col("top.h2").alias("h2")), "texts")
    held = first.select("sha", F.explode("anchors").alias("anchor"))
    counts = materialise(held.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"), "shared-anchors")
    total = counts.agg(F.sum("times")).first()[0] or 0
    shared = _met(held, counts, ["anchor"], total, "left_semi").groupBy("sha").agg(F.collect_list("anchor").alias("shared"))
    asked = first.join(shared, "sha", "left").where("shared IS NOT NULL OR loose").select(
        "sha", F.col("id").alias("__id"), "h1", "h2", F.coalesce("shared", F.array().cast("array<bigint>")).alias("shared"))
    bodies = docs.select(F.col(key).cast("long").alias("id"), *_text_key(text), F.col(text).cast("binary").alias("body"))
    same = bodies.id.eqNullSafe(asked["__id"]) & (bodies.h1 == asked.h1) & (bodies.h2 == asked.h2)
    texts = materialise(bodies.join(asked, same).select("sha", "id", "body", "shared").withColumn(
        "no", F.monotonically_increasing_id()), "live-texts")
    found = materialise(_live_windows(texts), "live-windows")
    repeats = found.groupBy("anchor", "name").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("times"),
        F.max(F.col("id").isNull()).alias("none")).where("least < most OR (none AND least IS NOT NULL)")
    repeats = materialise(repeats.select("anchor", "name", "least", "times"), "repeats")
    total = repeats.agg(F.sum("times")).first()[0] or 0
    gone = _met(found, repeats, ["anchor", "name"], total).where("id IS NULL OR least < id").groupBy("no").agg(
        F.flatten(F.collect_list("at")).alias("at"))
    cut = _cut(texts.join(gone, "no")).dropDuplicates(["sha"])
    answers = materialise(first.select("sha", "times", F.col("id").alias("first_id")).join(cut, "sha", "left"), "answers")
    total = rows.count()
    is_first = F.col("id").eqNullSafe(F.col("first_id"))
    copy = ~is_first & (F.col("n") >= rc.WINDOW)
    removed = F.when(copy, F.col("n")).when(is_first, F.coalesce("n_removed", F.lit(0))).otherwise(0)
    kept = F.when(copy, F.lit(NOTHING)).when(is_first, F.coalesce("kept", "sha")).otherwise(F.col("sha"))
    return _met(rows.select("id", "n", "sha"), answers, ["sha"], total).select(
        F.col("id").alias(key), F.col("n").alias("n_words"), removed.cast("long").alias("n_removed"),
        kept.alias("kept_sha256"))


REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
k AS (SELECT r, doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
g AS (SELECT r, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM k)
      WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
c AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS i FROM g),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (r)
"""
