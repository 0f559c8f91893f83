"""Boosted trees over binned features, all walk-forward fits grown side by side.

Features are binned once, on edges from the sessions before the first refit, and written as one table
that every fit shares. A level of a tree is one job for all fits: tasks sum the residuals of their rows
by (fit, node, feature, bin), reduce tasks add these sums and choose each node's split, and only the
splits come back. Residuals are summed as whole numbers, so a rerun gives the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import materialise

BINS = 16
TREES, DEPTH, RATE = 12, 3, 0.15
#: Fewest training rows of a fit, and of a leaf.
LEAST, LEAF = 500, 50
#: Residuals are counted in this unit.
UNIT = 2.0 ** -24
KEYS = ("panel_id", "instrument", "session", "sess_no", "n_sessions")


@dataclass(frozen=True)
class Fit:
    """A training range and the range it scores: rows before ``train_end`` whose label is known, and sessions
    from ``score_from`` to before ``score_to``."""
    variant: str
    horizon: int
    fold: int
    features: tuple[int, ...]
    train_end: int
    score_from: int
    score_to: int


@dataclass
class Tree:
    """A complete binary tree in heap order; a row goes left where its bin is at most the cut."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        inner = (1 << depth) - 1
        return Tree(np.zeros(inner, np.int64), np.full(inner, 255, np.uint8), np.zeros(1 << depth))

    def node(self, x: np.ndarray, level: int) -> np.ndarray:
        """Place of each row among the nodes of a level."""
        at = np.zeros(len(x), np.int64)
        for step in range(level):
            inner = (1 << step) - 1 + at
            at = 2 * at + (x[np.arange(len(x)), self.feature[inner]] > self.cut[inner])
        return at


@dataclass
class Grown:
    """The trees of each (panel, fit) so far."""
    depth: int
    trees: dict[tuple[str, int], list[Tree]] = field(default_factory=dict)

    def predict(self, key: tuple[str, int], x: np.ndarray, done: int) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees.get(key, [])[:done]:
            out += tree.value[tree.node(x, self.depth)]
        return out


def walk_forward_fits(variants: dict[str, Sequence[str]], names: Sequence[str], horizons: Sequence[int], n_sessions: int,
                      min_train: int = 750, refit_every: int = 126) -> list[Fit]:
    """A fit per variant, horizon and refit point. It trains on sessions before refit - horizon, so each of its
    labels is known at the refit."""
    place = {n: i for i, n in enumerate(names)}
    return [Fit(v, h, k, tuple(place[c] for c in cols), i - h, i, min(i + refit_every, n_sessions))
            for v, cols in variants.items() for h in horizons
            for k, i in enumerate(range(min_train, n_sessions, refit_every))]


def binned(rows: DataFrame, names: Sequence[str], horizons: Sequence[int], head: Column, bins: int = BINS) -> DataFrame:
    """KEYS, label_h per horizon and x: one byte a feature, 0 where it is missing.

    Edges are quantiles of the rows of ``head`` (one row of numbers is read on the driver), so nothing after the
    first refit shapes them.
    """
    clean = {n: F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")) for n in names}
    rows = rows.select(*KEYS, *[F.col(f"label_{h}").cast("double").alias(f"label_{h}") for h in horizons],
                       *[c.alias(n) for n, c in clean.items()])
    rows = materialise(rows, "features")
    share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.where(head).agg(*[F.percentile_approx(n, share, 10_000).alias(n) for n in names]).first()
    edges = [np.unique(np.array(found[n] if found[n] is not None else [], float)) for n in names]
    kept = len(KEYS) + len(horizons)
    columns = [*rows.columns[:kept], "x"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:kept]) + ", x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, len(names)), np.uint8)
            for i, (column, cuts) in enumerate(zip(batch.columns[kept:], edges)):
                values = column.to_numpy(zero_copy_only=False)
                x[:, i] = np.where(np.isnan(values), 0, 1 + np.searchsorted(cuts, values, side="left"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=columns)

    return materialise(rows.mapInArrow(run, schema), "binned")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[str, pd.DataFrame, np.ndarray]]:
    """Rows by panel: panel, frame, bins."""
    for batch in batches:
        frame = batch.to_pandas()
        x = np.frombuffer(b"".join(frame.pop("x")), np.uint8).reshape(len(frame), width)
        for panel, at in frame.groupby("panel_id").indices.items():
            yield panel, frame.iloc[at], x[at]


def _sums(table: DataFrame, fits: Sequence[Fit], grown: Grown, width: int, done: int, level: int, bins: int) -> DataFrame:
    """Each task's residual sums and row counts by node, feature and bin, of every fit it has rows for."""
    nodes, depth_bins = 1 << level, bins + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for panel, frame, x in _blocks(batches, width):
            number = frame["sess_no"].to_numpy()
            for k, fit in enumerate(fits):
                key = (panel, k)
                if level + done and key not in grown.trees:
                    continue
                label = frame[f"label_{fit.horizon}"].to_numpy(float)
                use = np.flatnonzero((number < fit.train_end) & ~np.isnan(label))
                if not len(use):
                    continue
                own = x[use]
                rest = np.rint((label[use] - grown.predict(key, own, done)) / UNIT)
                node = grown.trees[key][done].node(own, level) if level else np.zeros(len(use), np.int64)
                columns = np.array(fit.features)
                cell = ((node[:, None] * len(columns) + np.arange(len(columns))) * depth_bins + own[:, columns]).ravel()
                size = nodes * len(columns) * depth_bins
                both = np.stack([np.bincount(cell, np.repeat(rest, len(columns)), size), np.bincount(cell, minlength=size)])
                held[key] = held.get(key, 0) + both.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in held], pa.string()), pa.array([k for _, k in held], pa.int32()),
             pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["panel_id", "fit", "sums"])

    return table.mapInArrow(run, "panel_id string, fit int, sums binary")


def best_splits(sums: np.ndarray, leaf: int, rate: float) -> list[tuple[int, int, float, float, int]]:
    """(2, nodes, features, bins) -> per node: feature, cut, the values left and right of it, rows."""
    g, n = sums
    out = []
    for node in range(g.shape[0]):
        left_g, left_n = np.cumsum(g[node], axis=1), np.cumsum(n[node], axis=1)
        all_g, all_n = int(left_g[0, -1]), int(left_n[0, -1])
        right_g, right_n = all_g - left_g, all_n - left_n
        fair = (left_n >= leaf) & (right_n >= leaf)
        if fair.any():
            with np.errstate(all="ignore"):
                gain = np.where(fair, (left_g * UNIT) ** 2 / left_n + (right_g * UNIT) ** 2 / right_n, -np.inf)
            f, c = np.unravel_index(int(gain.argmax()), gain.shape)
            out.append((int(f), int(c), rate * UNIT * left_g[f, c] / left_n[f, c],
                        rate * UNIT * right_g[f, c] / right_n[f, c], all_n))
        else:
            out.append((0, 255, rate * UNIT * all_g / all_n if all_n else 0.0, 0.0, all_n))
    return out


def grow(table: DataFrame, fits: Sequence[Fit], width: int, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
         bins: int = BINS, least: int = LEAST, leaf: int = LEAF) -> Grown:
    """Trees of all fits, a job a level. A fit with fewer than ``least`` training rows grows none."""
    grown = Grown(depth)
    schema = "panel_id string, fit int, node int, feature int, cut int, low double, high double, n bigint"

    def chooser(nodes: int):
        def choose(group: pa.Table) -> pa.Table:
            panel, fit = (group.column(c)[0].as_py() for c in ("panel_id", "fit"))
            columns = fits[fit].features
            sums = sum(np.frombuffer(b, np.int64) for b in group.column("sums").to_pylist())
            rows = [(panel, fit, i, columns[s[0]], *s[1:]) for i, s in enumerate(
                best_splits(sums.reshape(2, nodes, len(columns), bins + 1), leaf, rate))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                            names=["panel_id", "fit", "node", "feature", "cut", "low", "high", "n"])
        return choose

    for done in range(trees):
        for level in range(depth):
            found = _sums(table, fits, grown, width, done, level, bins).groupBy("panel_id", "fit").applyInArrow(
                chooser(1 << level), schema).collect()
            for r in found:
                key = (r.panel_id, r.fit)
                if not done and not level and r.n < least:
                    continue
                own = grown.trees.setdefault(key, [])
                if len(own) == done:
                    own.append(Tree.empty(depth))
                inner = (1 << level) - 1 + r.node
                own[done].feature[inner], own[done].cut[inner] = r.feature, r.cut
                if level == depth - 1:
                    own[done].value[2 * r.node:2 * r.node + 2] = r.low, r.high
    return grown


def scores(table: DataFrame, fits: Sequence[Fit], grown: Grown, width: int) -> DataFrame:
    """KEYS, variant, horizon, fold, score, label: every row in the scored range of each fit that has trees."""
    names = [*KEYS, "variant", "horizon", "fold", "score", "label"]
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for panel, frame, x in _blocks(batches, width):
            number = frame["sess_no"].to_numpy()
            for k, fit in enumerate(fits):
                at = np.flatnonzero((number >= fit.score_from) & (number < fit.score_to))
                if not len(at) or (panel, k) not in grown.trees:
                    continue
                own = frame.iloc[at]
                made = own[list(KEYS)].assign(
                    variant=fit.variant, horizon=fit.horizon, fold=fit.fold,
                    score=grown.predict((panel, k), x[at], len(grown.trees[panel, k])),
                    label=own[f"label_{fit.horizon}"].to_numpy(float))
                yield pa.RecordBatch.from_pandas(made[names], preserve_index=False)

    head = ", ".join(f"{c} {kinds[c]}" for c in KEYS)
    out = table.mapInArrow(run, f"{head}, variant string, horizon bigint, fold bigint, score double, label double")
    return out.withColumn("label", F.nanvl("label", F.lit(None).cast("double")))
