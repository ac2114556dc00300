"""Tree members as tasks: many models over one table that fits into a task, each grown by one task.

A purged walk-forward fit is dozens of models over the same rows, and as long as these rows are few
(``TASK_ROWS``; a byte a feature once binned), growing each model in a task of its own takes a job
instead of a job for every level of every tree. Beyond that bound ``models`` fits each member by Spark's own
distributed trees; both use all rows.

A tree is three arrays over a heap of nodes (children of p are 2p+1 and 2p+2): the feature
that a node asks for (-1: a leaf), the cut, and the value of the node.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# tasks get these functions with the job, so that no executor needs the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a table that a task takes whole.
TASK_ROWS = 300_000
BINS = 32


def matrix(rows: DataFrame, *others: str):
    """``features`` as a float matrix, and other columns as arrays; ``rows`` has a proven bound."""
    import numpy as np

    table = rows.select(vector_to_array("features").alias("x"), *others).toArrow().combine_chunks()
    x = table.column("x").combine_chunks()
    return (x.flatten().to_numpy().astype(np.float64).reshape(len(table), -1) if len(table) else np.zeros((0, 1)), *[table.column(o).to_numpy() for o in others])


def cuts_of(x):
    """The quantiles of each feature, one row each: what a bin is."""
    import numpy as np

    return np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T


def binned(x, cuts):
    """The bin of each value: how many cuts are below it."""
    import numpy as np

    out = np.zeros(x.shape, dtype=np.uint8)
    for k in range(x.shape[1]):
        out[:, k] = np.searchsorted(cuts[k], x[:, k])
    return out


def grow(bins, g, h, rows, depth: int, columns, most: int, ridge: float, limits: dict):
    """One tree by Newton gains over histograms, all nodes of a level at once; fastest where ``bins`` lie column by column.

    ``columns()`` names the features of a level. ``limits``: minChildWeight (of h), minGain, minChildRows; of a level's
    nodes the best split first, until there are ``most`` leaves.
    """
    import numpy as np

    size = (1 << (depth + 1)) - 1
    feature, cut, value = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size)
    g, h = g[rows], h[rows]
    value[0] = -g.sum() / (h.sum() + ridge)
    at, active, count = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), 1
    numbers = np.zeros(size, dtype=np.int64)

    def numbered(here):
        """The nodes that hold rows, and for each row the place of its own among these."""
        nodes = np.flatnonzero(np.bincount(here, minlength=size))
        numbers[nodes] = np.arange(len(nodes))
        return nodes, numbers[here]

    for _ in range(depth):
        nodes, own = numbered(at[active])
        # what is too light for two children is a leaf
        heavy = (np.bincount(own, h[active]) >= 2 * limits.get("minChildWeight", 0)) & (np.bincount(own) >= 2 * limits.get("minChildRows", 1))
        if not heavy.all():
            active = active[heavy[own]]
            nodes, own = numbered(at[active])
        if not len(nodes):
            break
        cols = columns()
        # feature by feature: a histogram of one feature stays in the processor's cache
        counted = limits.get("minChildRows", 1) > 1
        here, both, first_bin = rows[active], (g + 1j * h)[active], own * BINS  # one pass adds up g and h, as the two parts of a number
        left, left_n = np.zeros((len(nodes), len(cols), BINS), dtype=complex), np.zeros((len(nodes), len(cols), BINS))
        place = np.empty(len(here), dtype=np.int64)
        for i, col in enumerate(cols):
            np.add(first_bin, bins[:, col] if len(here) == len(bins) else bins[:, col].take(here), out=place)
            sums = np.zeros(len(nodes) * BINS, dtype=complex)
            np.add.at(sums, place, both)
            left[:, i] = sums.reshape(-1, BINS).cumsum(axis=1)
            if counted:
                left_n[:, i] = np.bincount(place, minlength=len(nodes) * BINS).reshape(-1, BINS).cumsum(axis=1)
        left_g, left_h = left.real.copy(), left.imag.copy()
        all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
        allowed = np.minimum(left_h, right_h) >= max(limits.get("minChildWeight", 0), 1e-9)
        if counted:
            allowed &= np.minimum(left_n, left_n[:, :1, -1:] - left_n) >= limits["minChildRows"]
        allowed[:, :, -1] = False
        gain = np.where(allowed, gain, -1).reshape(len(nodes), -1)
        best = gain.argmax(axis=1)
        won = gain[np.arange(len(nodes)), best]
        order = np.argsort(-won, kind="stable")[: max(0, most - count)]
        split = order[won[order] > max(1e-9, limits.get("minGain", 0.0))]
        if not len(split):
            break
        count += len(split)
        k, b = best[split] // BINS, best[split] % BINS
        where = nodes[split]
        feature[where], cut[where] = cols[k], b
        for child, cg, ch in ((1, left_g, left_h), (2, right_g, right_h)):
            value[2 * where + child] = -cg[split, k, b] / (ch[split, k, b] + ridge)
        chosen = np.zeros(len(nodes), dtype=bool)
        chosen[split] = True
        active = active[chosen[own]]
        node = at[active]
        at[active] = 2 * node + 1 + (bins[rows[active], feature[node]] > cut[node])
    return feature, cut, value


def leaves(values, trees: list[tuple]):
    """The sum of trees for each row; ``values`` are bins, or raw values where cuts are raw."""
    import numpy as np

    total, row = np.zeros(len(values)), np.arange(len(values)) * values.shape[1]
    flat = values.ravel()
    for feature, cut, value in trees:
        # a leaf asks for nothing and is its own left child
        leaf, node = feature < 0, np.arange(len(feature))
        asked, limit, child = np.where(leaf, 0, feature).astype(np.int64), np.where(leaf, np.inf, cut), np.where(leaf, node, 2 * node + 1)
        at = np.zeros(len(values), dtype=np.int64)
        for _ in range(int(node[~leaf].max(initial=-1) + 1).bit_length()):
            at = child[at] + (flat[row + asked[at]] > limit[at])
        total += value[at]
    return total


def boosted(bins, target, params: dict, weight=None, seed: int = 42, ridge: float = 1.0) -> list[tuple]:
    """Trees of a logistic booster by Newton steps: maxIter, maxDepth, stepSize, subsamplingRate, featureShare, limits of ``grow``, maxLeaves."""
    import numpy as np

    rng, (n, width) = np.random.default_rng(seed), bins.shape
    bins, columns = np.ascontiguousarray(bins), np.asfortranarray(bins)
    weight = np.ones(n) if weight is None else weight
    score, trees, depth = np.zeros(n), [], int(params["maxDepth"])
    share = max(1, round(params.get("featureShare", 1.0) * width))
    for _ in range(int(params["maxIter"])):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(n) < params.get("subsamplingRate", 1.0))
        cols = np.sort(rng.choice(width, share, replace=False))
        feature, cut, value = grow(columns, weight * (p - target), weight * p * (1 - p), rows, depth, lambda cols=cols: cols, int(params.get("maxLeaves", 1 << depth)), ridge, params)
        trees.append((feature, cut, value * params["stepSize"]))
        score += leaves(bins, trees[-1:])
    return trees


def forest(bins, target, params: dict, weight=None, seed: int = 42) -> list[tuple]:
    """Trees of a bagged forest: numTrees, maxDepth, subsamplingRate, levelShare (of the features, drawn anew for each level)."""
    import numpy as np

    rng, (n, width), bins = np.random.default_rng(seed), bins.shape, np.asfortranarray(bins)
    weight = np.ones(n) if weight is None else weight
    trees, share = [], max(1, round(params["levelShare"] * width))
    for _ in range(int(params["numTrees"])):
        times = rng.poisson(params.get("subsamplingRate", 1.0), n)
        rows = np.flatnonzero(times)
        w = weight * times
        feature, cut, value = grow(bins, -w * target, w, rows, int(params["maxDepth"]), lambda: np.sort(rng.choice(width, share, replace=False)), 1 << 30, 1e-9, params)
        trees.append((feature, cut, value / params["numTrees"]))
    return trees


KINDS = {"boosted": boosted, "forest": forest}


@dataclass
class TreeModel:
    """A grown member; cuts are raw values."""

    kind: str
    trees: list[tuple] = field(repr=False)

    def probability(self, features: Column) -> Column:
        """Of an array column."""
        kind, trees, total = self.kind, self.trees, leaves

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            import numpy as np

            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
            out = total(values, trees)
            return pa.array(1 / (1 + np.exp(-out)) if kind == "boosted" else np.clip(out, 0.0, 1.0))

        return score(features)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.kind, k, f.tolist(), c.tolist(), v.tolist()) for k, (f, c, v) in enumerate(self.trees)]
        spark.createDataFrame(rows, "kind string, tree int, feature array<int>, cut array<double>, value array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        import numpy as np

        rows = spark.read.parquet(path).orderBy("tree").collect()  # as many as the model has trees
        return cls(rows[0].kind, [(np.array(r.feature, dtype=np.int32), np.array(r.cut), np.array(r.value)) for r in rows])


def _cuts(tables: dict[int, DataFrame]) -> dict:
    """``cuts_of`` each table, by key: each feature's values meet in a task, and only the cuts reach the driver."""

    def columns(key):
        def run(batches):
            import numpy as np

            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_pylist([{"key": key, "feature": k, "x": x[:, k].tobytes()} for k in range(x.shape[1])], wide)

        return run

    def quantiles(table):
        import numpy as np

        x = np.frombuffer(b"".join(table.column("x").to_pylist()))
        one = table.select(["key", "feature"]).slice(0, 1)
        return one.append_column("cuts", pa.array([cuts(x[:, None])[0].tolist()], pa.list_(pa.float64())))

    cuts, wide = cuts_of, pa.schema([("key", pa.int32()), ("feature", pa.int32()), ("x", pa.binary())])
    blocks = [rows.select(vector_to_array("features").alias("x")).mapInArrow(columns(key), "key int, feature int, x binary") for key, rows in tables.items()]
    found = reduce(DataFrame.union, blocks).groupBy("key", "feature").applyInArrow(quantiles, "key int, feature int, cuts array<double>").collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: (r.key, r.feature)):
        out.setdefault(r.key, []).append(r.cuts)
    return out


def _blocks(rows: DataFrame, key: int, cuts) -> DataFrame:
    """A table's rows in blocks, binned: key, and in their order part, number, then bins, target, weight as bytes."""
    bin_of = binned

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, edges = TaskContext.get().partitionId(), np.array(cuts)
        for number, batch in enumerate(batches):
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            y, w = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64).tobytes() for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, part, number, bin_of(x, edges).tobytes(), y, w), types, strict=True)], names=names)

    names, types = ["key", "part", "number", "bins", "target", "weight"], [pa.int32()] * 3 + [pa.binary()] * 3
    return rows.select(vector_to_array("features").alias("x"), "label", "weight").mapInArrow(run, "key int, part int, number int, bins binary, target binary, weight binary")


def fit(spark: SparkSession, tables: dict[int, DataFrame], specs: list[tuple]) -> dict[tuple, TreeModel]:
    """One model a task. ``tables``: by key rows (features, label, weight), read twice; ``specs``: (key, name, kind, params, seed).

    Rows are binned where they are read and shuffled to the tasks, a byte a feature; the driver gets cuts and models.
    """
    import json
    import pickle
    import zlib

    import numpy as np

    if not specs:
        return {}
    cuts, kinds = _cuts(tables), KINDS

    def run(batches):
        import numpy as np

        blocks = [row for batch in batches for row in batch.to_pylist()]
        if not blocks:
            return
        blocks.sort(key=lambda r: (r["part"], r["number"]))
        target, weight = (np.frombuffer(b"".join([r[k] for r in blocks])) for k in ("target", "weight"))
        bins = np.frombuffer(b"".join([r["bins"] for r in blocks]), dtype=np.uint8).reshape(len(target), -1)
        place, _, kind, params, seed = asked[blocks[0]["place"]]
        del blocks
        # features and bins are small numbers, and the driver knows the cuts
        grown = [(f.astype(np.int16), c.astype(np.uint8), v) for f, c, v in kinds[kind](bins, target, json.loads(params), weight, seed)]
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([zlib.compress(pickle.dumps(grown), 1)], pa.binary())], names=["place", "trees"])

    asked = [(i, key, kind, json.dumps(params), seed) for i, (key, _, kind, params, seed) in enumerate(specs)]
    listed = spark.createDataFrame([x[:2] for x in asked], "place int, key int")
    blocks = reduce(DataFrame.union, [_blocks(rows, key, cuts.get(key, [])) for key, rows in tables.items()])
    dealt = blocks.join(F.broadcast(listed), "key").repartitionById(len(asked), "place")
    found = dealt.mapInArrow(run, "place int, trees binary").collect()  # the models, which the driver keeps as it would Spark's own
    out = {}
    for r in found:
        key, name, kind, *_ = specs[r.place]
        edges = np.array(cuts[key])
        grown = [(f.astype(np.int32), c.astype(np.int64), v) for f, c, v in pickle.loads(zlib.decompress(r.trees))]
        out[key, name] = TreeModel(kind, [(f, edges[f.clip(0), c.clip(0, edges.shape[1] - 1)], v) for f, c, v in grown])
    return out
