"""Texts whose sets of five-word shingles are alike by 0.8 or more (the pipeline's near-duplicates).

Each set has a SimHash of 512 bits, of which two sets at similarity 0.8 differ in 78 +- 8 and unlike sets in
256 +- 11. Candidates lie within ``RADIUS`` of each other and share a leaf of one of 46 vantage-point trees, each
over a block of 11 bits with a search radius of 0 there (``hamming``): at exactly 0.8 a pair shares none but for
1 in 4,000. A leaf is searched inside a task in the full metric and sends on fewer links than it has rows; no pair
is ever a row. A leaf over ``LEAF_ROWS`` falls into salted parts, and then the rows outside its largest component
meet the others part by part.

The components of these links are groups that hold all candidates. A group is decided inside one task, on whole
sets, where pairs that are linked already, whose sizes rule 0.8 out or whose fingerprints lie further apart are
passed over. It sends on one link for each two parts it joins. A group over ``GROUP_ROWS`` or ``GROUP_SETS``
falls into its leaves, and a leaf over them into parts as above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.graph import components
from tidepanel.llm.hamming import leaf_numbers, star_within
from tidepanel.llm.shared import slices
from tidepanel.session import materialise

SEED = 42
WORDS = 5
#: Least similarity, as a fraction.
LIKE, OF = 4, 5
#: Longs of a fingerprint, differing bits up to which two sets are candidates, bits of a tree's block.
SKETCH, RADIUS, BLOCK = 8, 120, 11
TREES = 64 * SKETCH // BLOCK
#: Rows of a leaf that a task searches at once, and of the leaves dealt to one group; not limits on results.
LEAF_ROWS, SHARD_ROWS = 4096, 16384
#: Rows and shingles of a group (or part of one) that a task holds; not a limit on results.
GROUP_ROWS, GROUP_SETS = 512, 4 << 20

_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 64, SKETCH, dtype=np.uint64)
_LEAVES = leaf_numbers(BLOCK)


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (XXH64) of the word shingles of a UTF-8 text (A-Z lower-cased).

    Words are runs without ASCII white space; fewer words than ``size`` make one
    shingle; none (or null) gives the empty set.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1:] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)),
                                 np.uint64, len(starts)))


def set_name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LIKE * (len(a) + len(b) - both)


def simhash(own: np.ndarray) -> np.ndarray:
    """The fingerprint (longs) of a set: a bit is set if over half of its shingles' hashes have it."""
    votes = np.zeros(64 * SKETCH, np.int64)
    for k in range(0, len(own), 255):  # so many votes fit a byte
        x = own[k:k + 255, None] + _SEEDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        votes += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(own)).view(np.int64)


def leaves(sketches: np.ndarray) -> np.ndarray:
    """Fingerprints (n x longs) -> the leaf of each tree (n x trees), numbered over all trees."""
    bits = np.unpackbits(np.ascontiguousarray(sketches).view(np.uint8), axis=1)[:, :TREES * BLOCK]
    blocks = bits.reshape(-1, TREES, BLOCK) @ (1 << np.arange(BLOCK))
    return (_LEAVES[blocks] + (np.arange(TREES) << BLOCK)).astype(np.int32)


def with_sets(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, and node (the set's name), n (its size), leaves (none of an empty set) and
    sketch (its fingerprint)."""
    kept = docs.select(*keep, F.col(text).cast("binary").alias("__body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = [shingles(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                made = np.array([simhash(s) for s in sets], np.int64).reshape(-1, SKETCH)
                node = np.array([set_name(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(node), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([at if len(s) else at[:0] for at, s in zip(leaves(made), sets)], pa.list_(pa.int32())),
                     pa.array(list(made), pa.list_(pa.int64()))],
                    names=[*keep, "node", "n", "leaves", "sketch"])

    return kept.mapInArrow(run, f"{schema}, node bigint, n int, leaves array<int>, sketch array<bigint>")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, own), the set as bytes; rows whose text has another set are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                node = batch.column(0).to_numpy().view(np.uint64)
                sets = [shingles(t) for t in batch.column(1).to_pylist()]
                right = [set_name(s) == int(k) for s, k in zip(sets, node)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(right, pa.bool_())),
                     pa.array([s.tobytes() for s, r in zip(sets, right) if r], pa.binary())],
                    names=["node", "own"])

    return texts.mapInArrow(run, "node bigint, own binary").groupBy("node").agg(F.first("own").alias("own"))


def _fingerprints(group: pa.Table) -> np.ndarray:
    flat = group.column("sketch").combine_chunks().flatten().to_numpy()
    return flat.view(np.uint64).reshape(group.num_rows, SKETCH)


def near_links(group: pa.Table) -> pa.Table:
    """Rows (bucket, node, n, sketch, comp, asks) of whole leaves -> links (a, b) within the radius."""
    bucket = group.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    node, sketch = group.column("node").to_numpy()[order], _fingerprints(group)[order]
    n, comp = group.column("n").to_numpy().astype(np.int64)[order], group.column("comp").to_numpy()[order]
    asks = group.column("asks").to_numpy()[order]
    ends = np.flatnonzero(np.diff(bucket[order], append=bucket[order[-1:]] + 1)) + 1
    a, b = [], []
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        if end - start > 1:
            at = slice(start, end)
            for i, j in star_within(sketch[at], RADIUS, comp[at], asks[at], n[at], (LIKE, OF)):
                a.append(node[start + i])
                b.append(node[start + j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def star_links(group: pa.Table) -> pa.Table:
    """Rows (node, n, sketch, own, comp, asks) of a group -> links (a, b) that join its parts.

    A row that asks is held against every other of another part; a link makes two parts one.
    """
    node = group.column("node").to_numpy()
    n = group.column("n").to_numpy().astype(np.int64)
    asks = group.column("asks").to_numpy()
    sketch = _fingerprints(group)
    own = [np.frombuffer(b, np.uint64) for b in group.column("own").to_pylist()]
    part = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    rest = np.ones(len(node), bool)
    for i in np.flatnonzero(asks):
        rest[i] = False
        there = np.flatnonzero(rest & (part != part[i]) & (OF * np.minimum(n, n[i]) >= LIKE * np.maximum(n, n[i])))
        away = np.bitwise_count(sketch[there] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        order = np.argsort(away, kind="stable")
        for j in there[order[:np.count_nonzero(away <= RADIUS)]].tolist():
            if part[j] != part[i] and alike(own[i], own[j]):
                found.append((node[i], node[j]))
                part[part == part[j]] = part[i]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _linked(rows: DataFrame, by: list[str], links: Callable[[pa.Table], pa.Table] = star_links) -> DataFrame:
    return rows.groupBy(*by).applyInArrow(links, "a bigint, b bigint")


def candidate_links(distinct: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows (node, n, leaves, sketch) -> (a, b) links that connect all candidates."""
    sizes = materialise(distinct.select(F.explode("leaves").alias("bucket")).groupBy("bucket").count(), "leaf-sizes")
    total, most = sizes.agg(F.sum("count"), F.max("count")).first()
    shards = -(-(total or 0) // SHARD_ROWS) or 1
    rows = distinct.select("node", "n", "sketch", F.col("node").alias("comp"), F.lit(True).alias("asks"),
                           F.explode("leaves").alias("bucket"))
    # the trees have so many leaves and no more, whatever the table holds
    rows = rows.join(F.broadcast(sizes.where("count > 1")), "bucket")
    shard = F.pmod(F.xxhash64("bucket"), F.lit(shards)).alias("shard")
    links = _linked(rows.where(F.col("count") <= leaf_rows).drop("count").withColumn("shard", shard), ["shard"], near_links)
    if (most or 0) <= leaf_rows:
        return materialise(links, "near")
    parts = F.ceil(F.col("count") / leaf_rows).cast("int")
    split = materialise(rows.where(F.col("count") > leaf_rows).select(
        *[c for c in rows.columns if c != "count"], parts.alias("parts"),
        F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")), "split-leaves")
    links = materialise(links.unionByName(_linked(split.drop("parts"), ["bucket", "part"], near_links)), "near")
    return links.unionByName(_met_parts(split, links, leaf_rows, near_links))


def set_components(marked: DataFrame, texts: DataFrame, group_rows: int = GROUP_ROWS,
                   group_sets: int = GROUP_SETS) -> DataFrame:
    """``with_sets`` rows with __row, and (__row, __body) texts -> (node, label), linked sets only.

    A set is one row, however long its text; rows with an equal set are one node, so they are alike without a
    link. An empty table gives no rows.
    """
    distinct = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("leaves").alias("leaves"),
                                          F.first("sketch").alias("sketch"), F.min("__row").alias("__row"))
    distinct = materialise(distinct, "distinct")
    groups = components(candidate_links(distinct))
    nodes = distinct.drop("leaves").join(groups, "node")
    # equal row hashes of unlike rows give each other's texts, which _whole_sets leaves out
    sets = _whole_sets(texts.join(nodes.select("node", "__row"), "__row").select("node", "__body"))
    nodes = nodes.drop("__row").join(sets, "node").withColumn("comp", F.col("node")).withColumn("asks", F.lit(True))
    nodes = materialise(nodes, "candidates")
    large = nodes.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("sets")).where(
        (F.col("rows") > group_rows) | (F.col("sets") > group_sets)).select("label")
    large = materialise(large, "large-groups")
    whole = nodes.join(large, "label", "left_anti").select(
        F.col("label").alias("bucket"), F.lit(-1).alias("part"), "node", "n", "sketch", "own", "comp", "asks")
    inside = nodes.join(large, "label", "left_semi")
    shared = inside.select("label", "node", "n").join(distinct.select("node", "leaves"), "node").select(
        "node", "n", F.explode("leaves").alias("leaf"), "label").select(
        "node", "n", F.xxhash64("label", "leaf").alias("bucket"))
    shared = materialise(shared, "shared")
    met = shared.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("n").alias("sets")).where("rows > 1")
    parts = F.greatest(F.ceil(F.col("rows") / group_rows), F.ceil(F.col("sets") / group_sets)).cast("int")
    split = inside.join(shared.join(met, "bucket").select(
        "node", "bucket", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")), "node")
    split = materialise(split.drop("label"), "split-groups")
    links = materialise(_linked(whole.unionByName(split.drop("parts")), ["bucket", "part"]), "alike")
    return components(links.unionByName(_met_parts(split, links, group_rows)))


def _met_parts(split: DataFrame, links: DataFrame, group_rows: int,
               link: Callable[[pa.Table], pa.Table] = star_links) -> DataFrame:
    """Links between the parts of the leaves that were split.

    The rows outside a leaf's largest component ask all its rows, in pairs of parts; where the parts'
    own links have made a leaf one component, nothing is left to ask.
    """
    split = split.where("parts > 1").drop("comp", "asks").join(components(links), "node", "left").withColumn(
        "comp", F.coalesce("label", "node")).drop("label")
    sizes = split.groupBy("bucket", "comp").count()
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.max("count").alias("most"),
                                       F.sum("count").alias("rows")).where("rows > most")
    main = main.withColumn("askers", F.ceil((F.col("rows") - F.col("most")) / group_rows).cast("int"))
    rows = materialise(split.join(main.select("bucket", "main", "askers"), "bucket"), "unmet")
    fields = [*[c for c in rows.columns if c not in ("parts", "main", "askers", "part")], "part", "turn", "asks"]

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    asking = rows.where("comp != main").withColumn("turn", F.pmod(F.xxhash64(F.lit("turn"), "node"), "askers").cast("int")
                                                   ).withColumn("part", each("parts"))
    asked = rows.withColumn("turn", each("askers"))
    met = asking.withColumn("asks", F.lit(True)).select(*fields).unionByName(
        asked.withColumn("asks", F.lit(False)).select(*fields))
    return materialise(_linked(met, ["bucket", "part", "turn"], link), "alike-across")
