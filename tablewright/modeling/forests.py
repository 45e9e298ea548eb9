"""Forests of fully grown trees: large nodes by Spark jobs, small ones inside tasks.

A Spark estimator names the trees (number, depth, features at a node, bootstrap); they are grown here, since Spark's own
builder adds up all bins of every open node in every task, however few rows the node has.

- The features are cut into at most ``maxBins`` bins once. A row keeps only its bins other than the lowest, so a one-hot
  feature costs nothing where it is 0. The table is written with a number per row; a row's weight in a tree (Poisson,
  mean 1) follows from both numbers.
- A node of many rows is split by Spark: tasks add up its cells (feature, bin), Spark sums them, one row per node comes back.
- The rows of a node with at most ``SMALL_ENTRIES`` entries meet in one task, which grows the rest of its tree level by level.

Splits follow Spark's rules: equal gains go to the first feature, then the lowest cut; a node whose drawn features don't
split it is a leaf; leaves of one parent that predict the same class are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.session import cut_lineage, scratch_path

# Bins other than the lowest, over all rows of a node that one task may hold.
SMALL_ENTRIES = 4_000_000
# Cells that a task adds up at once for the nodes that Spark splits.
CELLS = 4_000_000
# Beyond these the estimator's own fit is used: features are dense while they are cut, sums are held per class.
FOREST_WIDTH, FOREST_CLASSES = 4_096, 64
# Bytes of a model that are sent to the tasks whole; they read a larger one from its files, a tree at a time.
SENT_BYTES = 32_000_000
# Bytes of features that a task scores at once by trees read from files.
SCORED_BYTES = 64_000_000


def _kernels():
    """What runs inside tasks. Closures, so that they travel with the plan."""

    def weights(rows, tree, seed, bootstrap):
        """How often each row is drawn for a tree."""
        if not bootstrap:
            return np.ones(len(rows), np.uint8)
        x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x += np.uint64((seed * 1_000_003 + tree + 1) * 0xD1342543DE82EF95 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
        return np.searchsorted(upto, (x >> np.uint64(11)) / 2.0**53, "right").astype(np.uint8)

    def read(batch):
        """Numbers, labels and entries (place of the row, code) of some rows."""
        own = [np.frombuffer(b, np.int32) for b in batch["codes"]]
        sizes = np.array([len(c) for c in own], np.int64)
        codes = np.concatenate(own) if own else np.zeros(0, np.int32)
        return batch["row"].to_numpy(), batch["label"].to_numpy(), np.repeat(np.arange(len(own)), sizes), codes

    def drawn(nodes, width, share, rng):
        """Which features each node may look at; None for all."""
        if share >= width:
            return None
        chosen, at_once = np.zeros((nodes, width), bool), max(1, 4_000_000 // width)
        for start in range(0, nodes, at_once):
            dice = rng.random((min(at_once, nodes - start), width), np.float32)
            places = np.argpartition(dice, share - 1, axis=1)[:, :share]
            np.put_along_axis(chosen[start:start + at_once], places, True, axis=1)
        return chosen

    def best(node, code, n, sums, whole_n, whole_sums, feature_of, first_of):
        """The best cut of each node from its cells, in the order of node and code: nodes, gains, features, lowest codes to the right.

        What lies right of a cut is added up from the cells; what is left of it is the rest of the node.
        """
        none = np.zeros(0, np.int64)
        if not len(code):
            return none, np.zeros(0), none, none
        feature = feature_of[code]
        ends = np.flatnonzero(np.append((feature[1:] != feature[:-1]) | (node[1:] != node[:-1]), True))
        end = ends[np.searchsorted(ends, np.arange(len(code)))]
        right_n, right = np.cumsum(n), np.cumsum(sums, axis=0)
        right_n, right = right_n[end] - right_n + n, right[end] - right + sums
        left_n, left = whole_n[node] - right_n, whole_sums[node] - right
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left**2).sum(1) / left_n + (right**2).sum(1) / right_n - ((whole_sums**2).sum(1) / whole_n)[node]
        gain[~(left_n > 0.5)] = -1.0
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        most = np.maximum.reduceat(gain, starts)
        hits = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(starts, len(node)))))
        hits = hits[np.append(True, node[hits][1:] != node[hits][:-1])]
        # the cut lies right above the bin before, which is the lowest where there is none
        before = np.where((hits > 0) & (node[hits - 1] == node[hits]) & (feature[hits - 1] == feature[hits]), code[hits - 1], first_of[feature[hits]])
        return node[hits], most, feature[hits], before + 1

    def merged(feature, low, left, n, sums, gain):
        """The tree without splits into two leaves of the same class."""
        likeliest, feature = sums.argmax(1), feature.copy()
        while True:
            at = np.flatnonzero(feature >= 0)
            kids = left[at]
            at = at[(feature[kids] < 0) & (feature[kids + 1] < 0) & (likeliest[kids] == likeliest[kids + 1])]
            if not len(at):
                break
            feature[at] = -1
        kept, front = np.zeros(len(feature), bool), np.zeros(1, np.int64)
        while len(front):
            kept[front] = True
            inner = left[front[feature[front] >= 0]]
            front = np.concatenate([inner, inner + 1])
        place = np.cumsum(kept) - 1
        left = np.where(feature >= 0, place[left], 0)
        return feature[kept], low[kept], left[kept], n[kept], sums[kept], gain[kept]

    def sorted_places(keys, most):
        """The stable order of whole numbers below ``most``: sorted with their places in one number where both fit."""
        bits = len(keys).bit_length()
        if int(most).bit_length() + bits > 62:
            return np.argsort(keys, kind="stable")
        return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)

    def grow(entry_row, entry_code, w, y, classes, depth, share, rng, feature_of, first_of):
        """A tree over the given rows: feature (-1: leaf), lowest code to the right, left child (the right one follows), rows, sums, gain.

        All nodes of a level are split at once; rows stay in the order of their node. Entries stay where they are, and those of
        finished leaves go when they are half of all.
        """
        width, cells, rows = len(first_of) - 1, len(feature_of), len(y)
        node, made, total, level = np.zeros(rows, np.int64), [], 1, 0
        first_w, left_rows, per_row = w.astype(float), np.arange(rows), np.bincount(entry_row, minlength=rows)
        entry_feature = feature_of[entry_code]
        while True:
            m = total if level == 0 else int(node[-1]) + 1
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            whole_n = np.bincount(node, w, m)
            if classes:
                parts = np.zeros((len(y), classes))
                parts[np.arange(len(y)), y.astype(int)] = w
                whole = np.add.reduceat(parts, starts, axis=0)
                shown, mixed = whole, (whole > 0).sum(1) > 1
            else:
                shown = np.bincount(node, w * y, m)[:, None]
                parts = (w * (y - (shown[:, 0] / whole_n)[node]))[:, None]
                whole = np.add.reduceat(parts, starts, axis=0)
                mixed = np.maximum.reduceat(y, starts) > np.minimum.reduceat(y, starts)
            own = [np.full(m, -1, np.int32), np.zeros(m, np.int32), np.zeros(m, np.int32), whole_n, shown, np.zeros(m)]
            made.append(own)
            if level == depth or not mixed.any():
                break
            chosen = drawn(m, width, share, rng)
            # a place more, which allows nothing, for the rows of finished leaves
            node_of = np.full(rows, m, np.int64)
            node_of[left_rows] = node
            if chosen is None:
                picked = np.flatnonzero(np.append(mixed, False)[node_of][entry_row])
            else:
                allowed = np.concatenate([chosen & mixed[:, None], np.zeros((1, width), bool)]).ravel()
                picked = np.flatnonzero(allowed[(node_of * width)[entry_row] + entry_feature])
            at, code = entry_row[picked], entry_code[picked].astype(np.int64)
            of_entry = node_of[at]
            key = of_entry * cells + code
            order = sorted_places(key, m * cells)
            key, by_key = key[order], at[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            of_row = np.zeros((rows, parts.shape[1]))
            of_row[left_rows] = parts
            n = np.add.reduceat(first_w[by_key], heads) if len(heads) else np.zeros(0)
            sums = np.add.reduceat(of_row[by_key], heads, axis=0) if len(heads) else np.zeros((0, parts.shape[1]))
            split, gain, feature, low = best(key[heads] // cells, key[heads] % cells, n, sums, whole_n, whole, feature_of, first_of)
            # gains of equal halves are no more than rounding
            scale = whole_n if classes else np.add.reduceat(parts[:, 0] ** 2, starts)
            good = gain > 1e-12 * scale[split]
            split, gain, feature, low = split[good], gain[good], feature[good], low[good]
            if not len(split):
                break
            own[0][split], own[1][split], own[5][split] = feature, low, gain
            own[2][split] = total + 2 * np.arange(len(split))
            total += 2 * len(split)
            child = np.full(m, -1, np.int64)
            child[split] = 2 * np.arange(len(split))
            least, most = np.zeros(m, np.int64), np.zeros(m, np.int64)
            least[split], most[split] = low, first_of[feature + 1]
            # the feature that splits a node is one of those that it may look at
            right = np.zeros(rows, np.int64)
            right[at[(code >= least[of_entry]) & (code < most[of_entry])]] = 1
            below = child[node] + right[left_rows]
            stays = np.flatnonzero(child[node] >= 0)
            stays = stays[sorted_places(below[stays], 2 * m)]
            node, w, y, left_rows, level = below[stays], w[stays], y[stays], left_rows[stays], level + 1
            if 2 * per_row[left_rows].sum() < len(entry_row):
                lives = np.zeros(rows, bool)
                lives[left_rows] = True
                lives = lives[entry_row]
                entry_row, entry_code, entry_feature = entry_row[lives], entry_code[lives], entry_feature[lives]
        tree = [np.concatenate(c) for c in zip(*made)]
        return merged(*tree) if classes else tree

    def routed(top, entry_row, entry_code, rows, first_of):
        """The node of the grown top at which each row ends."""
        node = np.zeros(rows, np.int64)
        for i, f in enumerate(top["feature"]):
            if f >= 0:
                right = np.zeros(rows, np.int64)
                right[entry_row[(entry_code >= top["low"][i]) & (entry_code < first_of[f + 1])]] = 1
                node = np.where(node == i, top["left"][i] + right, node)
        return node

    return weights, read, drawn, best, merged, grow, routed


TREE = "tree int, width int, feature binary, cut binary, left binary, value binary"


class ForestModel(Transformer, MLReadable, MLWritable):
    """Adds ``prediction`` (the mean of the trees, or the likeliest class) and, for classes, ``probability``.

    ``path`` is a folder of written trees, a row each: feature (-1: leaf), cut (values up to it go left), left child, values of the
    node. Small forests are sent to the tasks whole, larger ones are read there tree by tree, so no process holds all of them.
    """

    def __init__(self, path: str = "", classes: int = 0, gains: list[float] | None = None, column: str = "features"):
        super().__init__()
        self.path, self.classes, self.gains, self.column = path, classes, gains or [], column

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (as Spark's own tree models call it)
        return DenseVector(self.gains)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, classes, path = df.sparkSession, self.classes, self.path
        stored = spark.read.schema(TREE).parquet(path)
        facts = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.length(c) for c in ("feature", "cut", "left", "value")), F.lit(0))).alias("size")).first()
        count, kept = facts["n"], None
        if facts["size"] <= SENT_BYTES:
            kept = spark.sparkContext.broadcast([[bytes(c) if isinstance(c, bytearray) else c for c in r] for r in stored.orderBy("tree").collect()])

        def unpacked(tree, width, feature, cut, left, value):
            return np.frombuffer(feature, np.int32), np.frombuffer(cut), np.frombuffer(left, np.int32), np.frombuffer(value).reshape(-1, width)

        def trees():
            if kept is not None:
                yield from (unpacked(*r) for r in kept.value)
                return
            system, base = fs.FileSystem.from_uri(path)
            for found in sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if f.is_file and f.path.endswith(".parquet")):
                with system.open_input_file(found) as opened:
                    for batch in pq.ParquetFile(opened).iter_batches(1, columns=TREE.replace(",", "").split()[::2]):
                        for r in batch.to_pylist():
                            yield unpacked(*r.values())

        def told(x):
            out = np.zeros((len(x), max(1, classes)))
            for feature, cut, left, value in trees():
                node, live = np.zeros(len(x), np.int64), np.arange(len(x))
                while len(live):
                    at = node[live]
                    inner = feature[at] >= 0
                    live, at = live[inner], at[inner]
                    node[live] = left[at] + ~(x[live, feature[at]] <= cut[at])
                out += value[node]
            return pd.Series(list(out / count))

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held, size = [], 0
            for vectors in batches:
                if not len(vectors):
                    yield pd.Series([], dtype=object)
                    continue
                held.append(np.stack(vectors.to_numpy()))
                size += held[-1].nbytes
                # a batch at a time where the trees are at hand
                if kept is not None or size >= SCORED_BYTES:
                    yield told(np.concatenate(held))
                    held, size = [], 0
            if held:
                yield told(np.concatenate(held))

        found = score(vector_to_array(self.column))
        if not classes:
            return df.withColumn("prediction", F.get(found, F.lit(0)))
        made = df.withColumn("probability", found)
        return made.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802 (Spark's name)
        m, spark = self.model, SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(m, path, spark.sparkContext, {"classes": m.classes, "gains": m.gains, "column": m.column})
        spark.read.schema(TREE).parquet(m.path).write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession().sparkContext)
        model = ForestModel(f"{path}/trees", meta["classes"], meta["gains"], meta["column"])
        model._resetUid(meta["uid"])
        return model


class Forest(Estimator):
    """Grows what the Spark estimator ``forest`` describes. ``cuts`` are the features' cuts where they are known."""

    def __init__(self, forest, cuts: list[list[float]] | None = None):
        super().__init__()
        self.forest, self.cuts = forest, cuts

    def _fit(self, df: DataFrame):
        spec, label = self.forest, F.col(self.forest.getLabelCol()).cast("double")
        x = vector_to_array(spec.getFeaturesCol())
        rows = df.select(label.alias("label"), x.alias("x"))
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.max("label").alias("last"), F.avg("label").alias("mean")).first()
        if not facts["n"]:
            raise ValueError("there are no rows to learn from")
        classes = int(facts["last"]) + 1 if isinstance(spec, RandomForestClassifier) else 0
        if facts["width"] > FOREST_WIDTH or classes > FOREST_CLASSES:
            return spec.fit(df)
        cuts = self.cuts or _cuts(rows, facts["width"], spec.getMaxBins())
        table = cut_lineage(_coded(rows, cuts, 0.0 if classes else facts["mean"]))
        path, gains = _grown(table, spec, cuts, classes, facts["n"], 0.0 if classes else facts["mean"])
        return ForestModel(path, classes, gains.tolist(), spec.getFeaturesCol())


def _firsts(cuts: list[list[float]]) -> np.ndarray:
    """The code of each feature's lowest bin, and the number of all codes."""
    return np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])


def _cuts(rows: DataFrame, width: int, most: int) -> list[list[float]]:
    """Per feature one cut between 0 and 1 if it has no other values, else between all values or at quantiles, ``most - 1`` at most."""

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = set()
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                found.update(np.flatnonzero(((x != 0) & (x != 1)).any(axis=0)).tolist())
        yield pd.DataFrame({"at": sorted(found)}, dtype="int32")

    wide = sorted(r["at"] for r in rows.select("x").mapInPandas(others, "at int").distinct().collect())
    cuts: list[list[float]] = [[0.5]] * width
    if not wide:
        return cuts
    values = rows.select(F.posexplode(F.transform(F.array(*map(F.lit, wide)), lambda i: F.get("x", i))).alias("at", "v"))
    marks = F.array(*[F.lit(i / most) for i in range(1, most)])
    found = values.groupBy("at").agg(F.percentile_approx("v", marks, 10_000).alias("q"), F.approx_count_distinct("v", 0.02).alias("n")).collect()
    few = [r["at"] for r in found if r["n"] <= 1.2 * most]
    exact: dict[int, list[float]] = {}
    if few:
        for r in values.where(F.col("at").isin(few)).distinct().collect():  # about as many as bins, per feature
            exact.setdefault(r["at"], []).append(r["v"])
    for r in found:
        known = sorted(exact.get(r["at"], []))
        if known and len(known) <= most:
            cuts[wide[r["at"]]] = [(a + b) / 2 for a, b in zip(known, known[1:])]
        else:
            cuts[wide[r["at"]]] = sorted(set(r["q"]))
    return cuts


def _coded(rows: DataFrame, cuts: list[list[float]], mean: float) -> DataFrame:
    """(row, label less ``mean``, codes): the bins of a row other than the lowest, each as a number among all features' bins."""
    first, plain = _firsts(cuts), np.array([list(c) == [0.5] for c in cuts])
    others = np.flatnonzero(~plain)
    edges = [np.array(cuts[i]) for i in others]

    @F.pandas_udf("binary")
    def codes(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy())
        bins = ~(x <= 0.5)
        bins = bins.astype(np.uint8 if all(len(e) < 256 for e in edges) else np.int32)
        for i, own in zip(others, edges):
            bins[:, i] = np.searchsorted(own, x[:, i], "left")
        at, feature = np.nonzero(bins)
        code = (first[feature] + bins[at, feature]).astype(np.int32)
        return pd.Series([c.tobytes() for c in np.split(code, np.searchsorted(at, np.arange(1, len(x))))])

    return rows.select(F.monotonically_increasing_id().alias("row"), (F.col("label") - mean).alias("label"), codes("x").alias("codes"))


def _share(spec, width: int) -> int:
    """Features drawn at a node, as Spark counts them."""
    named = spec.getFeatureSubsetStrategy()
    if named == "auto":
        named = "all" if spec.getNumTrees() == 1 else "sqrt" if isinstance(spec, RandomForestClassifier) else "onethird"
    if named in ("all", "sqrt", "onethird", "log2"):
        found = {"all": width, "sqrt": width**0.5, "onethird": width / 3, "log2": math.log2(max(width, 2))}[named]
        return max(1, min(width, math.ceil(found)))
    number = float(named)
    return max(1, min(width, int(number) if number >= 1 and "." not in named else math.ceil(number * width)))


def _grown(table: DataFrame, spec, cuts: list[list[float]], classes: int, rows: int, mean: float) -> tuple[str, np.ndarray]:
    """Writes all trees; their folder and the share of each feature in their gains."""
    weights, read, drawn, best, merged, grow, routed = _kernels()
    first, count, depth, seed, bootstrap = _firsts(cuts), spec.getNumTrees(), spec.getMaxDepth(), spec.getSeed(), spec.getBootstrap()
    width, parts, cells = len(cuts), max(1, classes), int(first[-1])
    feature_of, share = np.repeat(np.arange(width), np.diff(first)), _share(spec, width)
    entries = table.agg(F.sum(F.length("codes")) / 4).first()[0] or 0
    most = SMALL_ENTRIES // max(1, math.ceil(entries / rows))
    # the top of each tree: nodes split by Spark, in the order in which they were made; the others are grown below
    tops = [{"feature": [-1], "low": [0], "left": [0], "n": [0.0], "sums": [np.zeros(parts)], "gain": [0.0], "level": [0]} for _ in range(count)]
    live = [(t, 0) for t in range(count)] if rows > most and depth > 0 else []
    while live:
        at_once = max(1, CELLS // (cells * (parts + 2)))
        found = [r for i in range(0, len(live), at_once) for r in _split_by_spark(
            table, live[i:i + at_once], tops, (seed, bootstrap, classes, share, first, feature_of)).collect()]
        live = []
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            top, at = tops[r["tree"]], r["node"]
            top["n"][at], top["sums"][at] = r["n"], np.array(r["sums"])
            if r["rows"] <= most or r["gain"] <= 1e-12 * r["n"]:
                # few rows are left to a task; a node that nothing splits is a leaf
                top["level"][at] = top["level"][at] if r["rows"] <= most else depth
                continue
            level = top["level"][at] + 1
            top["feature"][at], top["low"][at], top["left"][at], top["gain"][at] = r["feature"], r["low"], len(top["feature"]), r["gain"]
            for _ in range(2):
                if level < depth:
                    live.append((r["tree"], len(top["feature"])))
                for name, value in (("feature", -1), ("low", 0), ("left", 0), ("n", 0.0), ("sums", np.zeros(parts)), ("gain", 0.0), ("level", level)):
                    top[name].append(value)

    code_type = np.uint16 if cells < 2**16 else np.int32
    edges = np.concatenate([np.append(c, np.inf) for c in cuts])

    def block(w, row, label, at, code, taken):
        """Some rows of a batch, packed: first number, weights, numbers, labels, entries of each row, codes."""
        place = np.full(len(row), -1, np.int64)
        place[taken] = np.arange(len(taken))
        held = place[at] >= 0
        sizes = np.bincount(place[at[held]], minlength=len(taken)).astype(np.uint16 if width < 2**16 else np.int32)
        return row[0], w[taken].tobytes(), row[taken].tobytes(), label[taken].tobytes(), sizes.tobytes(), code[held].astype(code_type).tobytes()

    def opened(blocks):
        """Weights, numbers, labels, places and codes of blocks in the order of their rows."""
        blocks = blocks.sort_values("first")
        types = (("w", np.uint8), ("row", np.int64), ("label", float), ("size", np.uint16 if width < 2**16 else np.int32), ("code", code_type))
        w, row, label, sizes, code = (np.concatenate([np.frombuffer(b, d) for b in blocks[c]]) for c, d in types)
        return w, row, label, np.repeat(np.arange(len(row)), sizes), code.astype(np.int32)

    def finished(tree, own):
        """A whole tree as it is written, and its gains by feature."""
        feature, low, left, n, sums, gain = own
        gained = np.bincount(feature[feature >= 0], gain[feature >= 0], width)
        cut = np.where(feature >= 0, edges[np.maximum(low - 1, 0)], 0.0)
        value = np.ascontiguousarray(sums / n[:, None] + (0.0 if classes else mean), float)
        return pd.DataFrame([(tree, parts, feature.astype(np.int32).tobytes(), cut.tobytes(), left.astype(np.int32).tobytes(), value.tobytes(),
                              (gained / (gained.sum() or 1.0)).tobytes())])

    def planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole trees over all rows, tree after tree."""

        def tree_of(number, blocks):
            _, row, label, at, code = opened(pd.concat(blocks))
            w = weights(row, number, seed, bootstrap)
            if not (w > 0).any():
                return finished(number, [np.full(1, -1), np.zeros(1, int), np.zeros(1, int), np.ones(1), np.zeros((1, parts)), np.zeros(1)])
            place = np.cumsum(w > 0) - 1
            held = w[at] > 0
            return finished(number, grow(place[at[held]], code[held], w[w > 0], label[w > 0], classes, depth, share,
                                         np.random.default_rng([seed % 2**32, number, 0]), feature_of, first))

        number, blocks = None, []
        for batch in batches:
            for own, some in batch.groupby("tree", sort=False):
                if number is not None and own != number:
                    yield tree_of(number, blocks)
                    blocks = []
                number = int(own)
                blocks.append(some)
        if blocks:
            yield tree_of(number, blocks)

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                row, label, at, code = read(batch)
                yield pd.DataFrame([block(np.ones(len(row), np.uint8), row, label, at, code, np.arange(len(row)))])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of each tree's lower nodes, packed by node."""
        for batch in batches:
            if not len(batch):
                continue
            row, label, at, code = read(batch)
            for tree, top in enumerate(tops):
                w = weights(row, tree, seed, bootstrap)
                node = routed(top, at, code, len(row), first)
                out = [(tree, own, *block(w, row, label, at, code, np.flatnonzero((w > 0) & (node == own)))) for own in np.unique(node[w > 0])]
                if out:
                    yield pd.DataFrame(out)

    def below(blocks: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(blocks["tree"].iloc[0]), int(blocks["node"].iloc[0])
        w, _, label, at, code = opened(blocks)
        made = grow(at, code, w, label, classes, depth - tops[tree]["level"][node], share,
                    np.random.default_rng([seed % 2**32, tree, node]), feature_of, first)
        types = (np.int32, np.int32, np.int32, float, float, float)
        return pd.DataFrame([(tree, node, *[np.ascontiguousarray(c, d).tobytes() for c, d in zip(made, types)])])

    def whole(lower: pd.DataFrame) -> pd.DataFrame:
        t = int(lower["tree"].iloc[0])
        own = _joined(tops[t], {int(r["node"]): r for r in lower.to_dict("records") if r["node"] >= 0}, parts)
        return finished(t, merged(*own) if classes else own)

    packed, tree_schema = "first long, w binary, row binary, label binary, size binary, code binary", TREE + ", gain binary"
    spark = table.sparkSession
    if all(len(top["feature"]) == 1 for top in tops) and rows <= most:
        # every tree is grown whole by a task of its own, which is sent the rows once for all trees
        numbers = spark.range(0, count, 1, count).select(F.col("id").cast("int").alias("tree"))
        grown = numbers.crossJoin(F.broadcast(table.mapInPandas(gathered, packed))).mapInPandas(planted, tree_schema)
    else:
        roots = sum(f < 0 for top in tops for f in top["feature"])
        schema = "tree int, node int, feature binary, low binary, left binary, n binary, sums binary, gain binary"
        lower = table.mapInPandas(dealt, "tree int, node int, " + packed)
        lower = lower.repartition(min(roots, 4_096), "tree", "node").groupBy("tree", "node").applyInPandas(below, schema)
        # a row for every tree, also for one without lower nodes
        every = spark.range(0, count, 1, count).select(F.col("id").cast("int").alias("tree"), F.lit(-1).alias("node"))
        grown = every.unionByName(lower, allowMissingColumns=True).groupBy("tree").applyInPandas(whole, tree_schema)
    path, gains = scratch_path(spark, "forest"), np.zeros(width)
    grown.write.option("compression", "zstd").parquet(path)
    for r in spark.read.schema(tree_schema).parquet(path).select("tree", "gain").orderBy("tree").collect():
        gains += np.frombuffer(r["gain"])
    return path, gains / (gains.sum() or 1.0)


def _joined(top: dict, lower: dict, parts: int) -> list[np.ndarray]:
    """A tree's top with the parts grown below it: the root of a part takes its place, its other nodes are appended."""
    whole = [np.array(top[c]) for c in ("feature", "low", "left", "n", "sums", "gain")]
    made, size = [whole], len(whole[0])
    for at, r in lower.items():
        part = [np.frombuffer(r[c], d) for c, d in zip(
            ("feature", "low", "left", "n", "sums", "gain"), (np.int32, np.int32, np.int32, float, float, float))]
        part[4] = part[4].reshape(-1, parts)
        part[2] = np.where(part[0] >= 0, part[2] - 1 + size, 0)
        for own, new in zip(whole, part):
            own[at] = new[0]
        made.append([c[1:] for c in part])
        size += len(part[0]) - 1
    tree = [np.concatenate(c) for c in zip(*made)]
    # the rows of a tree that draws none of them
    return tree if tree[3][0] else [*tree[:3], np.ones(len(tree[3])), *tree[4:]]


def _split_by_spark(table: DataFrame, live: list, tops: list, settings: tuple) -> DataFrame:
    """(tree, node, rows, n, sums, gain, feature, low): totals and best cut of each of the given nodes."""
    seed, bootstrap, classes, share, first, feature_of = settings
    weights, read, drawn, best, merged, grow, routed = _kernels()
    parts, cells, place = max(1, classes), int(first[-1]), {}
    for i, (tree, node) in enumerate(live):
        place.setdefault(tree, {})[node] = i

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a place more for the totals of a node; rows, weights, then a sum per part
        size = len(live) * (cells + 1)
        sums = np.zeros((2 + parts, size))
        for batch in batches:
            if not len(batch):
                continue
            row, label, at, code = read(batch)
            for tree, own in place.items():
                w = weights(row, tree, seed, bootstrap)
                # the nodes of a tree have places next to each other
                least, own_size = min(own.values()), len(own) * (cells + 1)
                number = np.full(len(tops[tree]["feature"]), -1, np.int64)
                number[list(own)] = np.array(list(own.values())) - least
                node = np.where(w > 0, number[routed(tops[tree], at, code, len(row), first)], -1)
                kept, held = np.flatnonzero(node >= 0), node[at] >= 0
                if not len(kept):
                    continue
                cell = np.concatenate([node[kept] * (cells + 1) + cells, node[at[held]] * (cells + 1) + code[held]])
                of = np.concatenate([kept, at[held]])
                to = slice(least * (cells + 1), least * (cells + 1) + own_size)
                sums[0, to] += np.bincount(cell, minlength=own_size)
                sums[1, to] += np.bincount(cell, w[of], own_size)
                for k in range(parts):
                    sums[2 + k, to] += np.bincount(cell, w[of] * ((label[of] == k) if classes else label[of]), own_size)
        cell = np.flatnonzero(sums[0])
        yield pd.DataFrame({"place": cell // (cells + 1), "code": cell % (cells + 1), "rows": sums[0, cell], "n": sums[1, cell],
                            **{f"s{k}": sums[2 + k, cell] for k in range(parts)}})

    names = ["rows", "n", *[f"s{k}" for k in range(parts)]]
    added = table.mapInPandas(add_up, "place int, code int, " + ", ".join(f"{c} double" for c in names))
    added = added.groupBy("place", "code").agg(*[F.sum(c).alias(c) for c in names])

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("code")
        tree, node = live[int(own["place"].iloc[0])]
        whole, rest = own.iloc[-1], own.iloc[:-1]
        sums = whole[names[2:]].to_numpy(float)
        chosen = drawn(1, len(first) - 1, share, np.random.default_rng([seed % 2**32, tree, node, 1]))
        if chosen is not None:
            rest = rest[chosen[0, feature_of[rest["code"].to_numpy()]]]
        _, gain, feature, low = best(
            np.zeros(len(rest), np.int64), rest["code"].to_numpy(np.int64), rest["n"].to_numpy(), rest[names[2:]].to_numpy(float),
            np.array([whole["n"]]), sums[None], feature_of, first)
        cut = (float(gain[0]), int(feature[0]), int(low[0])) if len(gain) else (-1.0, -1, 0)
        return pd.DataFrame([(tree, node, int(whole["rows"]), float(whole["n"]), sums.tolist(), *cut)])

    schema = "tree int, node int, rows long, n double, sums array<double>, gain double, feature int, low int"
    return added.groupBy("place").applyInPandas(choose, schema)
