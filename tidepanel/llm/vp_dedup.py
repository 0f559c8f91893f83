"""SimHash near-duplicates, found with a forest of vantage-point trees (operator 3).

A ball of radius 4 around a 64-bit fingerprint straddles most median splits of a
vantage-point tree over all 64 bits (distances of unlike texts are 32 +- 4), so
such a tree prunes next to nothing and its shards must be copied to most leaves.
The trees here stand on blocks of the fingerprint instead. Of six blocks, two
fingerprints within 4 bits agree on two at least; in a tree over one block the
radius that has to be searched is then 0, and the triangle bound
|d(x, v) - d(y, v)| <= 0 sends both to the same branch at each vantage point v.
Inside a shard the full 64-bit metric is used (``hamming.near_roots``): vantage
points cover balls, and only covers whose widened balls overlap are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.graph import components
from tidepanel.llm.hamming import VANTAGES, near_roots
from tidepanel.llm.shared import on_whole_rows, slices
from tidepanel.llm.shingle_links import set_components, with_sets
from tidepanel.session import materialise

SEED = 42
RADIUS = 4
SHINGLE = 4
#: Widths of the blocks of a fingerprint, from the low bits up; the last has no tree of its own.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Rows of a shard above which it is split by a second block; not a limit on results.
SHARD_ROWS = 4096


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text (A-Z lower-cased).

    Words are runs without ASCII white space; fewer words than ``size`` make one
    shingle; none (or null) gives 0. Repeated shingles vote again. A bit is set
    if more than half of the shingle hashes (XXH64, seed 42) have it.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)),
                         ">u8", len(starts))
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                      name: str = "fp") -> DataFrame:
    """The columns in ``keep`` and the fingerprint of ``text`` as a signed long."""
    keep = keep or ["doc_id"]
    kept = docs.select(*keep, F.col(text).cast("binary").alias("__body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                values = [fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                fps = pa.array(np.array(values, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], fps], names=[*keep, name])

    return kept.mapInArrow(run, f"{schema}, `{name}` bigint")


def _block(fp: Column, k: int) -> Column:
    low = sum(BLOCKS[:k])
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1).cast("long"))


def _leaf(fp: Column, k: int) -> Column:
    """Leaf of the k-th tree: the branch (a distance, 4 bits) at each level."""
    part = _block(fp, k)
    mask = (1 << BLOCKS[k]) - 1
    code = F.lit(k).cast("long")
    for v in VANTAGES:
        away = F.bit_count(part.bitwiseXOR(F.lit(v & mask).cast("long"))).cast("long")
        code = code * F.lit(16).cast("long") + away
    return code


def near_links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct fingerprints (fp long) -> (a, b) links that connect all that lie within the radius.

    Every row goes to one leaf of each of the first five trees. A leaf with more
    than ``shard_rows`` rows is split by the leaf in each other tree: linked
    fingerprints agree on two blocks at least, so no link is lost, and no leaf is
    capped. A shard then emits a spanning star of each linked set, at most a row
    per row read.
    """
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"radius {radius} needs more than {len(BLOCKS)} blocks")
    fp = F.col("fp")
    leaves = F.array(*[_leaf(fp, k) for k in range(len(BLOCKS))])
    rows = distinct.select("fp", leaves.alias("leaves"))
    rows = rows.select("fp", "leaves", F.explode(
        F.slice("leaves", 1, len(BLOCKS) - 1)).alias("shard"))
    large = rows.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard")
    large = materialise(large, "large-shards")
    small = rows.join(large, "shard", "left_anti").select(
        "fp", "shard", F.lit(0).cast("long").alias("second"))
    split = rows.join(large, "shard").select(
        "fp", "shard", F.explode(F.filter("leaves", lambda x: x != F.col("shard"))).alias("second"))

    def star(shard: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(shard["fp"].to_numpy(np.int64))
        roots = near_roots(values.view(np.uint64).reshape(-1, 1), radius)
        moved = roots != np.arange(len(values))
        return pd.DataFrame({"a": values[moved], "b": values[roots[moved]]})

    return (small.unionByName(split).groupBy("shard", "second")
            .applyInPandas(star, "a bigint, b bigint"))


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    keep: list[str] | None = None) -> DataFrame:
    """Each row's ``keep`` columns, fp (signed long), fingerprint (hex) and component_id.

    component_id is the smallest ``key`` reachable over links of at most 4 bits,
    the row's own included. Copies share a fingerprint and collapse into one row
    before any search. Rows with a null text have fingerprint zero and link like
    any other; a null key takes part but never names a component (component_id
    is null only where all keys of the component are). Repeated rows stay.
    """
    keep = keep or [key]
    marked = materialise(with_fingerprints(docs, text, list(dict.fromkeys([key, *keep]))),
                         "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min(key).alias("__least")), "distinct")
    labels = components(near_links(distinct.select("fp")))
    named = (distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "__least", F.coalesce("label", "fp").alias("label")))
    named = materialise(named, "classes")
    least = named.groupBy("label").agg(F.min("__least").alias("component_id"))
    return (marked.join(named.select("fp", "label"), "fp").join(least, "label")
            .select(*keep, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id", "label"))


@on_whole_rows
def one_per_component(docs: DataFrame) -> DataFrame:
    """Documents with one row of each component of like texts left: the smallest doc_id's.

    Candidates are SimHashes of five-word shingles near each other, found by vantage-point trees
    (``shingle_links``; 512 bits, since a radius of 4 of 64 holds few texts alike by 0.8). Of these,
    texts are linked whose sets of shingles are alike by 0.8 or more. Null, empty and word-free texts have the same empty set: one of them
    stays, as of any other copies. Rows are told apart by doc_id and a hash of the whole
    row; of repeated rows one stays; a null doc_id stays only where its component has no other.
    Long texts count whole. An empty table stays empty; further columns come back as they were,
    whatever their names.
    """
    columns = docs.columns
    hashed = docs.withColumn("__row", F.xxhash64(*columns))
    marked = materialise(with_sets(hashed, "text", ["doc_id", "__row"]), "sets-of-rows")
    labels = set_components(marked, hashed.select("__row", F.col("text").cast("binary").alias("__body")))
    classes = marked.select("doc_id", "__row", "node").join(labels, "node", "left").select(
        "doc_id", "__row", F.coalesce("label", "node").alias("label"))
    first = classes.groupBy("label").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    keepers = first.select(F.col("first.doc_id").alias("__id"), F.col("first.__row").alias("__kept"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__kept"))
    return hashed.join(keepers, same, "left_semi").dropDuplicates(["doc_id", "__row"]).select(*columns)
