"""Language identification by nearest centroid (operator 10).

Character n-grams of the letters of a text are hashed, weighted by TF-IDF and
normalised. Each language has several centroids, found by spherical k-means; a
text gets the language of the centroid with the highest cosine, and is rejected
where it is further from that centroid than texts of the language ever are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.shared import code_points, gram_counts, letter_table, on_whole_rows, slices, squeeze_letters, unit_hash
from tidepanel.session import materialise

ORDERS, BUCKETS = (1, 2, 3), 4096
CENTROIDS = 4
#: Bound of the fit: about so many labelled texts of each language place its centroids.
FIT_TEXTS = 1500
#: A text is rejected below this share of the lowest cosine that all but 1 in 200 fit texts reach.
SLACK = 0.5
#: Most languages whose sizes are sent to every task, so that only drawn texts are shuffled; more are joined.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    weights: np.ndarray      # idf of each bucket
    centroids: np.ndarray    # unit rows
    languages: list[str]     # of each centroid
    floors: np.ndarray       # cosine below which a text is rejected, of each centroid


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from the fit: crc32 of the id's digits mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(text: str | None) -> np.ndarray:
    return squeeze_letters(code_points((text or "").lower()))


def unit_vectors(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; (1 + ln tf) * idf. A text without letters is a zero row."""
    counts = gram_counts([letters(t) for t in texts], ORDERS, BUCKETS)
    rows = np.log1p(counts, out=counts) * weights
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Texts and, per bucket, those that hold it, over all rows; a task sends one row of counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for whole in batches:
            for batch in slices(whole):
                counts = gram_counts([letters(t) for t in batch.column(0).to_pylist()], ORDERS, BUCKETS)
                total += (counts > 0).sum(axis=0)
                rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BUCKETS + 1), pa.int32()),
                 pa.array(np.append(total, rows), pa.int64())], names=["bucket", "n"])

    found = (texts.select("text").mapInArrow(run, "bucket int, n bigint")
             .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return int(out[-1]), out[:-1]


def spherical_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by k-means on cosine; the start is spread: each next row is the least like those before."""
    picked = [int(np.argmax(rows @ rows.mean(axis=0)))]
    nearest = rows @ rows[picked[0]]
    for _ in range(min(k, len(rows)) - 1):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[picked[-1]])
    centres = rows[picked]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def fit(docs: DataFrame, clusters: int = CENTROIDS, fit_texts: int = FIT_TEXTS) -> LanguageModel:
    """Learns from rows with text and language (``text``, ``lang``, ``doc_id`` only to draw the sample).

    Document frequencies cover all rows. The centroids of a language come from
    at most about ``fit_texts`` of its texts, drawn by a hash: a bounded group.
    Without a labelled row the model is empty and every answer is ``und``.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    total, having = document_frequencies(rows)
    weights = np.log((1 + total) / (1 + having)).astype(np.float32) + 1
    sizes = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if sizes.count() <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)
    share = F.least(F.lit(1.0), F.lit(float(fit_texts)) / F.col("n"))
    sample = (rows.join(sizes, "lang").where(
        unit_hash(F.col("doc_id"), F.xxhash64("text"), salt="lang") < share).select("lang", "text"))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("text")
        texts = [t for t in group["text"] if letter_table()[code_points(t)].any()]
        vectors = np.concatenate([unit_vectors(texts[i:i + 128], weights)
                                  for i in range(0, len(texts), 128)] or [np.zeros((0, BUCKETS), np.float32)])
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centre": [], "floor": []})
        centres = spherical_means(vectors, clusters)
        floor = SLACK * float(np.quantile((vectors @ centres.T).max(axis=1), 0.005))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "floor": floor,
                             "centre": [c.astype(np.float32).tobytes() for c in centres]})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, floor double")
    found = sorted(materialise(found, "centroids").collect(), key=lambda r: (r.lang, r.centre))
    centres = np.array([np.frombuffer(r.centre, np.float32) for r in found], np.float32)
    return LanguageModel(weights, centres.reshape(-1, BUCKETS), [r.lang for r in found],
                         np.array([r.floor for r in found]))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None,
             text: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred, score (cosine, 0 to 1) and rejected of each row.

    A null text or one without a letter is ``und`` with score 0 and rejected.
    Whole texts are read; each row by itself, so repeated rows get equal answers.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    fields = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                n = len(texts)
                lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                if m.languages:
                    vectors = unit_vectors(texts, m.weights)
                    cosine = vectors @ m.centroids.T
                    best = cosine.argmax(axis=1)
                    for i in np.flatnonzero(vectors.any(axis=1)):
                        if letter_table()[code_points(texts[i])].any():
                            lang[i] = m.languages[best[i]]
                            score[i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
                            rejected[i] = score[i] < m.floors[best[i]]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(lang), pa.array(score), pa.array(rejected)],
                    names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text")).mapInArrow(
        run, f"{schema}, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; fitted on the rows that are not held out."""
    rows = docs.withColumn("held_out", held_out())
    model = fit(rows.where(~F.col("held_out")))
    return identify(rows, model, ["doc_id", "held_out"])


@on_whole_rows
def recognised_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, their columns as they were.

    Null texts and texts without a letter are rejected; long texts count whole; repeated rows are judged
    alike. Without a language to learn, and on an empty table, nothing is left.
    """
    model = fit(docs.where(~held_out()))
    return identify(docs, model, ["__doc"]).where(~F.col("rejected"))
