"""Regression trees of all labels at once, grown by histograms that tasks count and Spark adds up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, and rows that its thresholds are taken from; both as in Spark's trees.
BINS, SAMPLED = 32, 10_000


@dataclass
class Tree:
    """A binary tree: node i has the children 2i + 1 and 2i + 2. feature: -1 at leaves; x <= threshold (bin <= place) goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    place: np.ndarray
    value: np.ndarray


def thresholds(values: np.ndarray, zeros: int) -> np.ndarray:
    """Borders between a feature's bins: between all values if these are few, else at equal numbers of rows."""
    known, counts = np.unique(np.append(values, np.zeros(1 if zeros else 0)), return_counts=True)
    if zeros:
        counts[np.searchsorted(known, 0.0)] += zeros - 1
    middles = (known[:-1] + known[1:]) / 2
    if len(middles) < BINS:
        return middles
    stride, found = counts.sum() / BINS, []
    target = stride
    sums = np.cumsum(counts)
    for i in range(1, len(known)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


def sparse(features: Column, n_features: int) -> tuple[Column, Column]:
    """Places and values of an array of numbers that aren't zero."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.get(features, i) != 0), F.filter(features, lambda x: x != 0)


def borders(rows: DataFrame, n_rows: int, n_features: int) -> list[np.ndarray]:
    """Thresholds of each feature, from about SAMPLED of `rows` (places, values)."""
    chosen = rows.select("places", "values")
    table = (chosen.sample(SAMPLED / n_rows, seed=7) if n_rows > SAMPLED else chosen).toArrow().combine_chunks()
    places, values = (np.concatenate([np.empty(0), *(x.flatten().to_numpy() for x in table.column(c).chunks)]) for c in ("places", "values"))
    order = np.argsort(places, kind="stable")
    cuts = np.searchsorted(places[order], np.arange(n_features + 1))
    return [thresholds(values[order[a:b]], table.num_rows - (b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def binned(rows: DataFrame, cuts: list[np.ndarray], start: list[float]) -> DataFrame:
    """target, judge, the features and bins of each row that aren't in the bin of zero, and scores."""
    zero = [int(np.searchsorted(c, 0.0)) for c in cuts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            features, bins = [], []
            for places, values in zip(batch["places"], batch["values"]):
                each = [(p, b) for p, v in zip(places.tolist(), values.tolist()) if (b := int(np.searchsorted(cuts[p], v))) != zero[p]]
                features.append(np.array([p for p, _ in each], "<i4").tobytes())
                bins.append(np.array([b for _, b in each], np.uint8).tobytes())
            scores = np.tile(np.array(start, "<f8"), (len(batch), 1))
            yield pd.DataFrame({"target": batch["target"], "judge": batch["judge"], "features": features, "bins": bins, "scores": [x.tobytes() for x in scores]})

    return rows.mapInPandas(run, "target int, judge boolean, features binary, bins binary, scores binary")


class Rows:
    """A batch of binned rows, with the scores that `trees` (rounds of one a label) add."""

    def __init__(self, batch: pd.DataFrame, cuts: list[np.ndarray], rounds: list[list[Tree]], rate: float):
        self.n, self.zero = len(batch), np.array([np.searchsorted(c, 0.0) for c in cuts])
        self.row = np.repeat(np.arange(self.n), [len(x) for x in batch["bins"]])
        self.feature = np.frombuffer(b"".join(batch["features"]), "<i4").astype(np.int64)
        self.bins = np.frombuffer(b"".join(batch["bins"]), np.uint8).astype(np.int64)
        self.target, self.judge = batch["target"].to_numpy(np.int64), batch["judge"].to_numpy(bool)
        self.scores = np.frombuffer(b"".join(batch["scores"]), "<f8").reshape(self.n, -1).copy()
        by = np.argsort(self.feature, kind="stable")
        self.by, self.ends = by, np.searchsorted(self.feature[by], np.arange(len(cuts) + 1))
        for trees in rounds:
            for k, tree in enumerate(trees):
                self.scores[:, k] += rate * tree.value[self.node(tree)]

    def bin_of(self, feature: int) -> np.ndarray:
        at = self.by[self.ends[feature] : self.ends[feature + 1]]
        out = np.full(self.n, self.zero[feature])
        out[self.row[at]] = self.bins[at]
        return out

    def node(self, tree: Tree) -> np.ndarray:
        """Each row's leaf, as far as the tree has grown."""
        node = np.zeros(self.n, np.int64)
        for i in range(len(tree.feature)):
            if tree.feature[i] >= 0:
                here = node == i
                node[here] = 2 * i + 1 + (self.bin_of(int(tree.feature[i]))[here] > tree.place[i])
        return node

    def shares(self) -> np.ndarray:
        grown = np.exp(self.scores - self.scores.max(1, keepdims=True))
        return grown / grown.sum(1, keepdims=True)


def histograms(table: DataFrame, cuts: list[np.ndarray], rounds: list[list[Tree]], rate: float, growing: list[Tree], level: int) -> np.ndarray:
    """Rows and sums of what the probabilities lack, by label, node of a level, feature and bin; feature len(cuts) holds all rows."""
    wide, n_nodes = len(cuts) + 1, 1 << level

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            batch = batch[~batch["judge"]]
            if not len(batch):
                continue
            rows = Rows(batch, cuts, rounds, rate)
            lack = np.eye(len(growing))[rows.target] - rows.shares()
            here = []
            for k, tree in enumerate(growing):
                node = rows.node(tree) - (n_nodes - 1)
                inside = node >= 0
                e = inside[rows.row]
                cell = ((k * n_nodes + node[rows.row[e]]) * wide + rows.feature[e]) * BINS + rows.bins[e]
                every = ((k * n_nodes + node[inside]) * wide + wide - 1) * BINS
                cell, each = np.concatenate((cell, every)), np.concatenate((lack[rows.row[e], k], lack[inside, k]))
                here.append((cell, each))
            cell, each = (np.concatenate(x) for x in zip(*here))
            size = len(growing) * n_nodes * wide * BINS
            made = np.stack((np.bincount(cell, minlength=size), np.bincount(cell, each, size)))
            total = made if total is None else total + made
        if total is not None:
            at = np.flatnonzero(total[0])
            yield pd.DataFrame({"cell": at, "n": total[0, at].astype(np.int64), "s": total[1, at]})

    sums = table.mapInPandas(run, "cell long, n long, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    out = np.zeros((2, len(growing) * n_nodes * wide * BINS))
    out[:, sums.column("cell").to_numpy()] = sums.column("n").to_numpy(), sums.column("s").to_numpy()
    out = out.reshape(2, len(growing), n_nodes, wide, BINS)
    # What isn't listed is in the bin of zero.
    rest = out[..., -1:, :].sum(-1) - out[..., :-1, :].sum(-1)
    for f, c in enumerate(cuts):
        out[..., f, np.searchsorted(c, 0.0)] += rest[..., f]
    return out


def grown(table: DataFrame, cuts: list[np.ndarray], rounds: list[list[Tree]], rate: float, n_labels: int, depth: int) -> list[Tree]:
    """A round's trees: the split of most variance at each node, the first of equals, of those that lessen it."""
    size = (2 << depth) - 1
    trees = [Tree(np.full(size, -1), np.zeros(size), np.zeros(size, np.int64), np.zeros(size)) for _ in range(n_labels)]
    # Which borders each feature has.
    real = np.array([np.arange(BINS - 1) < len(c) for c in cuts])
    for level in range(depth):
        counts, sums = histograms(table, cuts, rounds, rate, trees, level)
        for k, tree in enumerate(trees):
            for j in range(1 << level):
                i, n, s = (1 << level) - 1 + j, counts[k, j, -1, 0], sums[k, j, -1, 0]
                if not n:
                    continue
                tree.value[i] = s / n
                left_n, left_s = np.cumsum(counts[k, j, :-1], 1)[:, :-1], np.cumsum(sums[k, j, :-1], 1)[:, :-1]
                right_n, right_s = n - left_n, s - left_s
                fits = real & (left_n > 0.5) & (right_n > 0.5)
                gain = np.where(fits, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - s * s / n, -1.0)
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-12 * n:
                    continue
                tree.feature[i], tree.threshold[i], tree.place[i] = f, cuts[f][b], b
                tree.value[2 * i + 1], tree.value[2 * i + 2] = left_s[f, b] / left_n[f, b], right_s[f, b] / right_n[f, b]
    return trees


def mean_loss(table: DataFrame, cuts: list[np.ndarray], rounds: list[list[Tree]], rate: float) -> float:
    """Mean log loss of the rows that judge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["judge"]]
            if len(batch):
                rows = Rows(batch, cuts, rounds, rate)
                told = rows.shares()[np.arange(rows.n), rows.target]
                yield pd.DataFrame({"n": [rows.n], "s": [float(-np.log(np.maximum(told, 1e-12)).sum())]})

    return table.mapInPandas(run, "n long, s double").agg(F.sum("s") / F.sum("n")).first()[0] or 0.0


def rescored(table: DataFrame, cuts: list[np.ndarray], rounds: list[list[Tree]], rate: float) -> DataFrame:
    """`table` with the scores after `rounds`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(scores=[x.tobytes() for x in Rows(batch, cuts, rounds, rate).scores] if len(batch) else [])

    return table.mapInPandas(run, table.schema)


def scores_of(features: Column, start: list[float], rate: float, rounds: list[list[Tree]]) -> Column:
    """Scores of rows by all rounds; features: an array of numbers."""
    used = sorted({int(f) for trees in rounds for t in trees for f in t.feature if f >= 0}) or [0]
    place = {f: i for i, f in enumerate(used)}

    @F.pandas_udf("array<double>")
    def told(x: pd.Series) -> pd.Series:
        values = np.stack(x.to_list()) if len(x) else np.zeros((0, len(used)))
        scores = np.tile(np.array(start), (len(x), 1))
        for trees in rounds:
            for k, tree in enumerate(trees):
                node = np.zeros(len(x), np.int64)
                for i in np.flatnonzero(tree.feature >= 0).tolist():
                    here = node == i
                    node[here] = 2 * i + 1 + (values[here, place[int(tree.feature[i])]] > tree.threshold[i])
                scores[:, k] += rate * tree.value[node]
        return pd.Series(list(scores))

    return told(F.transform(F.array(*map(F.lit, used)), lambda i: F.get(features, i)))
