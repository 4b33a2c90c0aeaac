"""Outliers by a forest of random splits over several columns (isolation forest).

Every tree is grown on a subsample of fixed size: the rows with the least hashes of key and tree,
so the sample depends on the keys alone, not on how the table is dealt. Trees are grown one a
task, flattened into arrays and held by every task that scores; their size is bounded by trees
times sample size, whatever the table's. Scoring is a map.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modulus of the hash rule; products of two residues fit into 63 bits.
PRIME = 2_147_483_647
EULER_GAMMA = 0.5772156649015329
#: Cells of the grid on which scores are ranked.
GRID = 10_000
MOST_BYTES = 64 << 20


class Forest(NamedTuple):
    """Trees as heaps: node i has children 2i + 1 (below the cut) and 2i + 2. feature -1 marks a leaf."""

    columns: tuple[str, ...]
    sample: int  # rows of each tree
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    size: np.ndarray


def _mixed(x):
    x = (x * x + 12_345) % PRIME
    return (x * x + 6_789) % PRIME


def node_hash(tree, node, turn):
    """A number below PRIME for a choice at a node."""
    return _mixed((tree * 104_729 + node * 1_299_709 + turn * 15_485_863 + 7_919) % PRIME)


def row_hash(key: Column, tree: Column) -> Column:
    """The number by which rows enter a tree's sample."""
    return _mixed((F.pmod(key, F.lit(1_000_003)) * 7_919 + tree * 104_729) % PRIME)


def expected_depth(n):
    """Mean depth of an unsuccessful search among n keys in a random binary tree."""
    n = np.asarray(n, float)
    more = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(more - 1) + EULER_GAMMA) - 2 * (more - 1) / more))


def height(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 2))))


def grow(tree: int, x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree on the rows of x: at each node a column that varies and a cut between its ends, both by hash."""
    nodes = 2 ** (levels + 1) - 1
    feature, cut, size = np.full(nodes, -1, np.int32), np.zeros(nodes), np.zeros(nodes, np.int32)
    at = np.zeros(len(x), np.int64)
    for node in range(nodes):
        here = x[at == node]
        size[node] = len(here)
        if len(here) < 2 or node >= 2**levels - 1:
            continue
        low, high = here.min(0), here.max(0)
        varies = np.flatnonzero(high > low)
        if not len(varies):
            continue
        j = varies[node_hash(tree, node, 0) % len(varies)]
        feature[node], cut[node] = j, low[j] + (node_hash(tree, node, 1) + 0.5) / PRIME * (high[j] - low[j])
        mine = at == node
        at[mine] = 2 * node + 1 + (x[mine, j] >= cut[node])
    return feature, cut, size


def _complete(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    whole = rows.select(F.col(key).alias("key"), *values)
    for i in range(len(columns)):
        whole = whole.filter(F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}") & (F.abs(f"x{i}") < float("inf")))
    return whole


def fit(rows: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256) -> Forest | None:
    """A forest on rows without a missing value; null for fewer than ten such rows. ``key`` is a whole number."""
    whole = _complete(rows, key, columns)
    n = whole.count()
    if n < 10:
        return None
    size = min(sample, n)
    levels = height(size)
    if trees * 2 ** (levels + 1) * 16 > MOST_BYTES:
        raise ValueError("trees times sample is too large to be held by every task")
    # Only rows whose hash lies below a cut that lets through well more than the sample are shuffled.
    below = int(PRIME * min(1.0, (1.5 * size + 150) / n))
    index = F.sequence(F.lit(0), F.lit(trees - 1))
    drawn = whole.withColumn("tree", F.explode(F.filter(index, lambda t: row_hash(F.col("key"), t.cast("long")) < below if n > size else F.lit(True))))
    order = Window.partitionBy("tree").orderBy(row_hash(F.col("key"), F.col("tree").cast("long")), "key")
    xs = [f"x{i}" for i in range(len(columns))]
    samples = drawn.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= size).select("tree", *xs)

    def one(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        f, c, s = grow(tree, np.stack([table.column(x).to_numpy() for x in xs], 1), levels)
        return pa.table({"tree": pa.array([tree], pa.int32()), "feature": pa.array([f.tolist()], pa.list_(pa.int32())), "cut": pa.array([c.tolist()], pa.list_(pa.float64())), "size": pa.array([s.tolist()], pa.list_(pa.int32()))})

    grown = samples.groupBy("tree").applyInArrow(one, "tree int, feature array<int>, cut array<double>, size array<int>").collect()  # one row a tree
    grown.sort(key=lambda r: r.tree)
    return Forest(tuple(columns), size, np.array([r.feature for r in grown], np.int32), np.array([r.cut for r in grown]), np.array([r["size"] for r in grown], np.int32))


def path_lengths(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Mean depth at which rows are isolated, leaves of several rows counted on."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    levels = (forest.feature.shape[1] + 1).bit_length() - 2
    leaf = expected_depth(forest.size)
    for f, c, extra in zip(forest.feature, forest.cut, leaf, strict=True):
        node, depth = np.zeros(len(x), np.int64), np.zeros(len(x))
        for _ in range(levels):
            j = f[node]
            go = j >= 0
            node = np.where(go, 2 * node + 1 + (x[rows, np.maximum(j, 0)] >= c[node]), node)
            depth += go
        total += depth + extra[node]
    return total / len(forest.feature)


def score(rows: DataFrame, key: str, forest: Forest) -> DataFrame:
    """(key, score): 2 ** (-path / expected path), near 1 for rows that few splits isolate. Rows with a missing value are left out."""
    normal = float(expected_depth(forest.sample))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(forest.columns))], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.exp2(-path_lengths(forest, x) / normal))], names=[key, "score"])

    kind = rows.schema[key].dataType.simpleString()
    return _complete(rows, key, list(forest.columns)).mapInArrow(task, f"{key} {kind}, score double")


def outliers(rows: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.1) -> DataFrame:
    """Scores, and the rows of highest score: those with fewer than ``contamination`` of all rows above them.

    Scores are ranked on a grid of 1 / GRID, so the ranking is one small aggregation; rows of one
    cell are outliers together.
    """
    forest = fit(rows, key, columns, trees, sample)
    if forest is None:
        empty = rows.filter("false")
        return empty.select(key, F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("outlier"))
    scored = score(rows, key, forest).withColumn("_cell", F.round(F.col("score") * GRID).cast("int"))
    cells = scored.groupBy("_cell").agg(F.count("*").alias("_n"))  # at most GRID + 1 rows
    order = Window.orderBy(F.desc("_cell"))
    above = F.sum("_n").over(order) - F.col("_n")
    flags = cells.withColumn("_above", above).withColumn("outlier", F.col("_above") < contamination * F.sum("_n").over(Window.partitionBy()))
    return scored.join(F.broadcast(flags.select("_cell", "outlier")), "_cell").select(key, "score", "outlier")
