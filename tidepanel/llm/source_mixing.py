"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.shared import WORD_PATTERN, on_whole_rows
from tidepanel.session import materialise

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at so many times its source's size.
MOST_EPOCHS = 3
#: Share of a source by which rounding may leave a target below whole epochs.
ROUNDING = 1e-9
#: Slices for each factor e of a key; only the slice with the budget's end is sorted. A key is exponential, so at
#: any weight no slice holds over 1 / (e KEY_SLICES) of the documents of that weight.
KEY_SLICES = 512
#: Most sources whose targets are sent to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of letters and white space, squared; an empty text has 0.1."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", ""))
    share = F.coalesce(plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))
    return F.lit(0.1) + F.lit(0.9) * share * share


def exponential_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with a repeatable uniform u of the document; the smallest keys are taken first."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def keyed(docs: DataFrame, seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """The documents' columns and __size, __slice and __place (the order within a source)."""
    key = exponential_key(F.col("doc_id"), quality_weight(F.col("text")) if weight is None else weight, seed)
    return (docs.withColumn("__size", word_count(F.col("text")))
            .withColumn("__key", key)
            .withColumn("__slice", F.floor(F.lit(KEY_SLICES) * F.log("__key")).cast("int"))
            .withColumn("__place", F.struct(
                F.col("__key"), F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"),
                F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("body")))
            .drop("__key"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS,
            most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    The targets share the sum of all sizes by weight; one above ``most`` times
    its source's size stops there and the excess is shared anew. The end of that
    sharing is a level: target = min(most * size, level * weight), found with one
    running sum over the sources in order of the level at which they fill up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    full = F.lit(float(most)) * F.col("source_size")
    by_fill = Window.orderBy("__fill", "__n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = (sizes.withColumn("__n", place).withColumn("weight", weight).withColumn("__full", full)
            .withColumn("__fill", F.col("__full") / F.col("weight")))
    rows = rows.withColumn("__level", (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("__full").over(by_fill), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0))))
    level = F.min(F.when(F.col("__level") <= F.col("__fill"),
                         F.struct("__fill", "__n", "__level"))).over(whole)
    return (rows.withColumn("__at", level)
            .select("source", "source_size", "weight",
                    F.least(F.col("__full"), F.col("__at.__level") * F.col("weight")).alias("target")))


def budgets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS,
            whole_documents: bool = False) -> DataFrame:
    """Keyed rows -> per source: source_size, target, epochs, end slice and place, cut document.

    Only sums of (source, slice) are ordered, and the rows of one slice of each
    source; no window holds a whole source.
    """
    slices = materialise(rows.groupBy("source", "__slice").agg(F.sum("__size").alias("size")), "slices")
    plan = targets(slices.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    size = F.nullif(F.col("source_size"), F.lit(0))
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.col("target") / size + ROUNDING), F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = materialise(plan, "targets")
    same = plan.source.eqNullSafe(slices.source)
    running = Window.partitionBy("source").orderBy("__slice")
    ends = (slices.join(plan, same).drop(slices.source)
            .withColumn("before", F.sum("size").over(running) - F.col("size"))
            .where("before <= rest and before + size > rest")
            .select(F.col("source").alias("s"), F.col("__slice").alias("end_slice"), "before", "rest"))
    last = Window.partitionBy("s").orderBy("__place")
    tail = (rows.select("source", "__slice", "__size", "__place")
            .join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("__slice") == F.col("end_slice")))
            .groupBy("s", "end_slice", "before", "rest", "__place")
            .agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
            .withColumn("start", F.col("before") + F.sum("size").over(last) - F.col("size")))
    reach = F.col("start") + F.col("size") / (2.0 if whole_documents else 1.0)
    words = F.greatest(F.lit(0.0), F.col("rest") - F.col("start")) / F.col("n")
    closing = tail.groupBy("s", "end_slice").agg(
        F.max(F.when(reach <= F.col("rest"), F.col("__place"))).alias("end_place"),
        F.min(F.when(reach > F.col("rest"), F.struct(
            F.col("__place").alias("place"), words.alias("words")))).alias("cut"))
    return (plan.join(closing, F.col("source").eqNullSafe(F.col("s")), "left")
            .select("source", "source_size", "target", "epochs", "end_slice", "end_place", "cut"))


def assign(rows: DataFrame, plan: DataFrame, whole_documents: bool = False) -> DataFrame:
    """Keyed rows and budgets -> the rows with source_size, target, copies (whole) and taken (words)."""
    plan = materialise(plan.withColumnRenamed("source", "__source"), "budgets")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__source")), "left")
    whole = (F.col("__slice") < F.col("end_slice")) | (
        (F.col("__slice") == F.col("end_slice")) & (F.col("__place") <= F.col("end_place")))
    copies = F.col("epochs") + F.when(F.coalesce(whole, F.lit(False)), 1).otherwise(0)
    cut = F.lit(0) if whole_documents else F.when(
        F.col("__place") == F.col("cut.place"), F.round("cut.words")).otherwise(0)
    return (rows.withColumn("copies", copies)
            .withColumn("taken", (F.col("copies") * F.col("__size") + cut).cast("long")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``.

    A source is taken whole ``floor(target / size)`` times; the rest of its
    budget goes to its documents in order of their exponential keys (quality
    weights make low keys likely), the last one in part, so each source's sum is
    its target to a word. Null sources are a source, the last in order; a null
    text has size 0. Equal rows (same doc_id and text) share a place: at the end
    of a budget they are taken or left together, or each cut alike.
    """
    rows = materialise(keyed(docs.select("doc_id", "text", "source"), seed).drop("text"), "keyed")
    return assign(rows, budgets(rows, weights)).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")


@on_whole_rows
def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The documents the mix takes, each as often as it is taken, whole.

    The document at the end of a budget is taken if that brings the sum nearer
    to the target. Texts are not shuffled: the budgets are sent to them. Empty
    and null texts cost nothing, so those whose key comes before a budget's end are taken one time more
    than the whole epochs, as other documents are; repeated rows are taken alike, a null
    source is a source. An empty table stays empty; further columns come back as they were.
    """
    rows = keyed(docs, seed)
    small = materialise(rows.select("source", "__size", "__slice", "__place"), "keyed")
    plan = budgets(small, weights, whole_documents=True)
    taken = assign(rows, plan, whole_documents=True)
    return (taken.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select("__doc"))


#: The same mix in DuckDB, with one window over each source.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS body, text IS NULL AS none,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT *, -ln((CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)
                 + 0.5::DOUBLE) / 281474976710656::DOUBLE)
    / (0.1::DOUBLE + 0.9::DOUBLE * q * q) AS key
  FROM (SELECT *, coalesce(length(regexp_replace(body, '[^\p{L}\x20\x09-\x0D]+', '', 'g'))
                           / nullif(length(body), 0)::DOUBLE, 0.0::DOUBLE) AS q FROM d)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
f AS (SELECT *, 3.0::DOUBLE * source_size AS full_size, 3.0::DOUBLE * source_size / weight AS fill FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM f)::DOUBLE - coalesce(sum(full_size) OVER p, 0))
        / ((SELECT sum(weight) FROM f) - coalesce(sum(weight) OVER p, 0)) AS lev
      FROM f WINDOW p AS (ORDER BY fill, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(full_size,
        (SELECT lev FROM l WHERE lev <= fill ORDER BY fill, n LIMIT 1) * weight) AS target FROM l),
r AS (SELECT *, coalesce(floor(target / nullif(source_size, 0) + 1e-9::DOUBLE), 0) AS epochs FROM t),
c AS (SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, greatest(0, r.target - r.epochs * r.source_size) AS rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id,
                          CASE WHEN none THEN '' ELSE md5(body) END) AS upto,
        sum(k.size) OVER p AS at_place, count(*) OVER p AS n
      FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
      WINDOW p AS (PARTITION BY k.source, k.key, k.doc_id, CASE WHEN none THEN '' ELSE md5(body) END))
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + CASE WHEN upto <= rest THEN size
       WHEN upto - at_place <= rest THEN round((rest - (upto - at_place)) / n) ELSE 0 END AS BIGINT) AS taken
FROM c
"""
