"""Quality classifier by co-training (operator 1).

Two views of a document: its content (hashed character n-grams) and its page
metadata (source, language, length and layout: lines, word lengths, repetition,
shares of capitals, digits and signs). The content has a naive Bayes classifier;
the metadata, whose features depend on each other, a logistic regression.
In each round the unlabelled pool gets a fresh part of the corpus and either view
labels the documents of it that it is surest of, for both to learn from. The views are then calibrated on labelled documents that
no round learned from, and their log-odds added up to score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.shared import code_points, gram_counts, letter_table, on_whole_rows, slices, unit_hash
from tidepanel.session import materialise

ORDERS, GRAMS = (1, 2, 3), 4096
#: Bounds of the fit: about so many labelled documents, and unlabelled ones that join the pool in each
#: round; all are drawn by a hash. Of either class at least about LEAST labelled documents, if there are so many.
LABELLED, POOL, LEAST = 6000, 6000, 200
ROUNDS, GROWTH = 3, 0.1
#: Share of the labelled sample kept for the calibration.
CALIBRATION = 0.3
#: Documents whose chance to be of quality is below this are rejected.
THRESHOLD = 0.5
#: Bins of each metadata feature: language, source, then ten figures of the text.
BINS = (64, 256, *[24] * 10)
FEATURES = len(BINS)
OFFSETS = np.cumsum([0, *BINS])
#: Weight of a text's n-grams as of so many words.
EVIDENCE = 30.0
RIDGE = 1.0


@dataclass
class QualityModel:
    content: np.ndarray     # log ratio of each n-gram bucket
    metadata: np.ndarray    # log-odds of each metadata bin
    scale: np.ndarray       # calibration: slope and shift of either view
    prior: float            # log-odds of quality in the labelled sample


def metadata_bins(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """One bin of each feature; missing language or source is a value of its own."""
    codes = code_points(text)
    n = max(1, len(codes))
    words = text.split()
    w = max(1, len(words))
    letter = letter_table()[codes]
    space = int((codes == 32).sum() + (codes == 10).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    letters = int(letter.sum())
    capital = int(((codes >= 65) & (codes <= 90)).sum())
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = int((codes == 10).sum()) + 1

    def name(value: str | None, bins: int) -> int:
        return 0 if value is None else 1 + xxhash.xxh32_intdigest(value.encode("utf-8", "surrogatepass")) % (bins - 1)

    values = (name(lang, BINS[0]), name(source, BINS[1]), np.log2(n), np.log2(w), n / w, 20 * distinct / w,
              20 * same / w, 20 * capital / max(1, letters), 20 * digits / n,
              60 * (n - letters - space - digits) / n, 4 * np.log2(1 + w / lines),
              20 * space / n)
    return np.clip(np.array(values), 0, np.array(BINS) - 1).astype(np.int64) + OFFSETS[:-1]


def content_rows(texts: list[str]) -> np.ndarray:
    """n-gram counts scaled to shares, so a text weighs the same whatever its length."""
    counts = gram_counts([code_points(t) for t in texts], ORDERS, GRAMS)
    return counts / np.maximum(1, counts.sum(axis=1, keepdims=True))


def _featured(docs: DataFrame) -> DataFrame:
    """id, quality, part, content (float32 shares) and metadata (bins) of the drawn documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 128):
                quality, part, texts, lang, source = [c.to_pylist() for c in batch.columns[1:]]
                texts = [t or "" for t in texts]
                content = content_rows(texts).astype(np.float16)
                bins = [metadata_bins(*x).astype(np.int32).tobytes() for x in zip(texts, lang, source)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(quality, pa.int32()), pa.array(part, pa.int32()),
                     pa.array([c.tobytes() for c in content]), pa.array(bins)],
                    names=["id", "quality", "part", "content", "metadata"])

    rows = docs.select("id", "quality", "part", "text", "lang", "source")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, quality int, part int, "
                                "content binary, metadata binary")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    content = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.float16).reshape(-1, GRAMS)
    bins = np.frombuffer(b"".join(batch.column("metadata").to_pylist()), np.int32).reshape(-1, FEATURES)
    return content.astype(np.float32), bins


def _content_ratios(rows: DataFrame) -> np.ndarray:
    """Naive Bayes log ratios from rows with ``label``: each task sends one row of sums per class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, GRAMS))
        for batch in batches:
            content, _ = _arrays(batch)
            label = batch.column("label").to_numpy()
            for c in (0, 1):
                sums[c] += content[label == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], GRAMS), pa.int32()), pa.array(np.tile(np.arange(GRAMS), 2), pa.int32()),
             pa.array(sums.ravel())], names=["class", "place", "n"])

    found = (rows.mapInArrow(run, "class int, place int, n double")
             .groupBy("class", "place").agg(F.sum("n").alias("n")).toPandas())
    sums = np.zeros((2, GRAMS))
    sums[found["class"], found["place"]] = found["n"]
    content = sums + 1e-3
    content /= content.sum(axis=1, keepdims=True)
    return np.log(content[1] / content[0])


def _metadata_odds(rows: DataFrame) -> np.ndarray:
    """Log-odds of each bin by a ridge logistic regression on the drawn documents' bins (a bounded table)."""
    told = rows.select("metadata", "label").toPandas()
    bins = np.frombuffer(b"".join(told["metadata"]), np.int32).reshape(-1, FEATURES)
    label = told["label"].to_numpy(float)
    x = np.zeros((len(bins), OFFSETS[-1]))
    np.put_along_axis(x, bins.astype(np.int64), 1.0, axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + RIDGE * np.eye(len(beta))
        beta -= np.linalg.solve(hessian, x.T @ (p - label) + RIDGE * beta)
    return beta


def _scored(rows: DataFrame, content: np.ndarray, metadata: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_, bins = _arrays(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("quality"), batch.column("part"),
                 pa.array(EVIDENCE * (rows_ @ content), pa.float64()), pa.array(metadata[bins].sum(axis=1))],
                names=["id", "quality", "part", "s0", "s1"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, quality int, part int, "
                                "s0 double, s1 double")


def _platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the scores, by Newton steps, lightly held to slope 0."""
    spread = max(float(score.std()), 1e-9)
    x = np.stack([score / spread, np.ones_like(score)], axis=1)
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    beta = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-4])
        beta -= np.linalg.solve(hessian, x.T @ (p - target) + np.array([1e-2, 1e-4]) * beta)
    return float(beta[0] / spread), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL,
        rounds: int = ROUNDS) -> QualityModel | None:
    """Co-trains the views; None where fewer than two documents of either class have a label.

    The fit works on a bounded sample: about ``labelled`` documents with a label (more if a class would have
    fewer than LEAST) and ``pool`` without in each round, drawn by a hash of doc_id. The calibration gets its
    share of each class. A document with several labels has their majority (ties: of quality); null labels
    are none, and labels without a document and documents without doc_id take no part.
    """
    rows = docs.select("doc_id", "text", "lang", "source").where("doc_id IS NOT NULL")
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("quality"))
    marks = materialise(marks.join(rows.select("doc_id"), "doc_id", "left_semi"), "marks")
    classes = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    if min(classes.get(0, 0), classes.get(1, 0)) < 2:
        return None
    even = labelled / sum(classes.values())
    draws = {c: max(even, LEAST / n) for c, n in classes.items()}
    limit = F.when(F.col("quality") == 1, draws[1]).otherwise(draws[0])
    drawn = marks.where(unit_hash(F.col("doc_id"), salt="co-training") < limit)
    of_class = Window.partitionBy("quality")
    place = F.row_number().over(of_class.orderBy(unit_hash(F.col("doc_id"), salt="calibration"), "doc_id"))
    held = F.greatest(F.lit(1), F.floor(CALIBRATION * F.count("*").over(of_class)))
    drawn = materialise(drawn.select("doc_id", "quality", (place <= held).cast("int").alias("part")), "labelled")
    known = rows.join(F.broadcast(drawn), "doc_id")
    turn = F.floor(unit_hash(F.col("doc_id"), salt="pool") * (max(1, rows.count()) / pool)).cast("int")
    free = (rows.withColumn("turn", turn).where(F.col("turn") < rounds).join(marks, "doc_id", "left_anti")
            .withColumn("quality", F.lit(None).cast("int")).withColumn("part", 2 + F.col("turn")).drop("turn"))
    table = materialise(_featured(known.unionByName(free).withColumnRenamed("doc_id", "id")), "views")
    sizes = {(r.part, r.quality): r["count"] for r in table.groupBy("part", "quality").count().collect()}
    free_rows = sizes.get((2, None), 0)
    share = sizes[(0, 1)] / (sizes[(0, 0)] + sizes[(0, 1)])
    own = F.when(F.col("part") == 0, F.col("quality"))
    pseudo: dict = {}
    for step in range(rounds + 1):
        told = table.withColumn("label", _given(pseudo, own)).where("label IS NOT NULL")
        content, metadata = _content_ratios(told), _metadata_odds(told)
        scores = materialise(_scored(table, content, metadata), "scores")
        if step == rounds or not free_rows:
            break
        for view in ("s0", "s1"):
            for label, order in ((1, F.col(view).desc()), (0, F.col(view).asc())):
                most = round(GROWTH * free_rows * (share if label else 1 - share))
                in_pool = F.col("part").between(2, 2 + step)
                for r in scores.where(in_pool).orderBy(order, "id").limit(most * (step + 1)).collect():
                    pseudo.setdefault(r.id, label)
    held = scores.where("part = 1").select("quality", "s0", "s1").toPandas()
    label = held["quality"].to_numpy(float)
    scale = np.array([_platt(held[v].to_numpy(), label) for v in ("s0", "s1")])
    return QualityModel(content, metadata, scale, float(np.log(label.mean() / (1 - label.mean()))))


def _given(pseudo: dict, own: Column) -> Column:
    """A row's own label, else the pseudo-label of its id (bounded by the pools)."""
    yes, no = ([i for i, c in pseudo.items() if c == k] for k in (1, 0))
    return F.coalesce(own, F.when(F.col("part") >= 2, F.when(F.col("id").isin(yes), 1).when(
        F.col("id").isin(no), 0)))


def score(docs: DataFrame, model: QualityModel | None, keep: list[str] | None = None,
          text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The ``keep`` columns, p_content, p_metadata, quality (0 to 1) and kept of each row.

    A null text is empty. Without a model nothing can be told: the chances are
    null and all rows are kept.
    """
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(f"`{c}`") for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    names = [*keep, "p_content", "p_metadata", "quality", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in slices(whole):
                texts, langs, sources = [c.to_pylist() for c in batch.columns[-3:]]
                if m is None:
                    chances = [pa.nulls(len(texts), pa.float64())] * 3
                    good = np.ones(len(texts), bool)
                else:
                    texts = [t or "" for t in texts]
                    bins = np.array([metadata_bins(*x) for x in zip(texts, langs, sources)])
                    odds = np.stack([EVIDENCE * (content_rows(texts) @ m.content),
                                     m.metadata[bins].sum(axis=1)], axis=1) * m.scale[:, 0] + m.scale[:, 1]
                    both = odds.sum(axis=1) - m.prior
                    p = 1 / (1 + np.exp(-np.clip(np.column_stack([odds, both]), -500, 500)))
                    chances, good = [pa.array(c) for c in p.T], p[:, 2] >= THRESHOLD
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *chances, pa.array(good)], names=names)

    return docs.select(*kept, F.col(text).alias("__text"), F.col(lang).alias("__lang"),
                       F.col(source).alias("__source")).mapInArrow(
        run, f"{schema}, p_content double, p_metadata double, quality double, kept boolean")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_content, p_metadata, quality and kept of every document."""
    return score(docs, fit(docs, labels))


@on_whole_rows
def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, their columns as they were.

    Null and empty texts, nulls in other columns, long texts and repeated rows are scored like any other
    row; without a model (fewer than two labelled documents of a class) all rows stay. An empty table stays empty.
    """
    return score(docs, fit(docs, labels), ["__doc"]).where("kept")
