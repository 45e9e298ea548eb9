"""Exact nearest neighbours as a pruned, partitioned join in two rounds.

Pivots are a hash sample of the training vectors; their number grows with the rows. They form two
levels: about the square root of them are tops, every pivot belongs to its nearest top, and a row
to the nearest pivot under its nearest top. A row's cell need not be the very nearest one: the
triangle inequality bounds hold for any cell with its pivot and radius.

Cells in a row make a strip, the unit in which rows travel. In the first round a query meets the strip of
its own cell only, which gives a distance that its k-th neighbour can't exceed. In the second it visits the
other strips with a cell that may hold something nearer: first tops, then the cells under the tops that are
left. (After Voronoi pruning for kNN joins, Lu et al., VLDB 2012.)

Equal training vectors are reduced to their ``k`` smallest ids before the shuffle and equal query
vectors are asked once, so copies cost nothing; strips and their queries are cut into blocks of
bounded size, so no task holds a whole strip. Only the best ``k`` per query and block leave a task.

Inside a block, squared distances come from a matrix product, as ``|a|^2 + |b|^2 - 2ab`` around the middle of
the cell. Its rounding error has a bound; what may be near within it is measured exactly, and only that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.ordering import slice_count
from tablewright.session import cut_lineage

# Training rows a cell is meant to hold.
CELL_ROWS = 1_024
FEWEST_PIVOTS = 32
# The pivots travel to every task: at most this many numbers (32 MB). Larger tables get larger cells.
PIVOT_NUMBERS = 4_000_000
# Rows (and numbers, 16 MB) of a strip or block, on either side; small tables have at least STRIPS strips if cells are that many.
BLOCK_ROWS = 16_384
BLOCK_NUMBERS = 2_000_000
STRIPS = 32
# Training sets up to this many rows (and numbers) are sent whole to the query tasks.
SMALL_ROWS = 20_000
SMALL_NUMBERS = 2_000_000


def _kernels():
    """The numeric kernels that run inside tasks.

    They are closures so that they travel with the plan: executors need numpy and
    pandas, not this package.
    """

    def distances(points, others):
        """Euclidean distances by summed squared differences, in steps of bounded memory."""
        out = np.empty((len(points), len(others)))
        step = max(1, int(4_000_000 / max(1, others.size)))
        for start in range(0, len(points), step):
            diff = points[start:start + step, None, :] - others[None, :, :]
            out[start:start + step] = np.sqrt((diff * diff).sum(axis=2))
        return out

    def best(query_ids, queries, ids, labels, points, k):
        """The ``k`` nearest of ``points`` (sorted by id) for each query vector."""
        parts = []
        step = max(1, int(1_000_000 / len(ids)))
        for start in range(0, len(queries), step):
            gaps = distances(queries[start:start + step], points)
            # stable sort: equal distances keep the smaller id first
            order = np.argsort(gaps, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(start, start + len(gaps)), order.shape[1])
            parts.append(pd.DataFrame({
                "query": query_ids[rows], "id": ids[order.ravel()], "label": labels[order.ravel()],
                "distance": np.take_along_axis(gaps, order, axis=1).ravel(),
            }))
        return pd.concat(parts)

    def usable(points):
        """The rows whose squares neither are nor become infinite or NaN."""
        return (np.abs(points) < 1e150).all(axis=1)

    def search(queries, own, bound, cell, points, k):
        """(row, place, distance): the ``k`` nearest of ``points`` within ``bound`` of each query; equal distances keep the smaller place.

        ``own`` and ``cell`` are the cells of both sides: a query without a bound meets its own cell first. All numbers are usable.
        """
        bound, width = bound.copy(), points.shape[1]
        near, place = np.full((len(queries), k), np.inf), np.full((len(queries), k), len(points))
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1]))

        def measure(row, mine):
            """Exact distances of pairs, in steps of bounded memory."""
            out, step = np.empty(len(row)), max(1, 4_000_000 // max(1, width))
            for at in range(0, len(row), step):
                diff = queries[row[at:at + step]] - points[mine[at:at + step]]
                out[at:at + step] = np.sqrt((diff * diff).sum(axis=1))
            return out

        def meet(rows, a, aa, b, bb, mine, reach):
            """``rows`` (``a`` around the middle of a cell, squared ``aa``) against the points ``mine`` (``b``, ``bb``)."""
            square = a @ b.T
            square *= -2
            square += aa[:, None]
            square += bb[None, :]
            # the error of the product and the sums, with room
            slack = (width + 16) * 5e-16 * (np.sqrt(aa) + reach) ** 2
            most = bound[rows] ** 2
            fresh = np.flatnonzero(np.isinf(most))
            if len(fresh) and len(mine) >= k:
                # k groups each hold something as near as their k-th best
                groups = max(k, len(mine) // 16)
                deep = len(mine) // groups
                least = square[fresh, :deep * groups].reshape(len(fresh), deep, groups).min(axis=1)
                most[fresh] = np.maximum(np.partition(least, k - 1, axis=1)[:, k - 1], 0.0) + 2 * slack[fresh]
            row, col = np.nonzero(square <= (most * (1 + 1e-9) + 1e-18 + slack)[:, None])
            if not len(row):
                return
            row, col = rows[row], mine[col]
            gap = measure(row, col)
            has = np.unique(row)
            row = np.concatenate([np.repeat(has, k), row])
            gap, col = np.concatenate([near[has].ravel(), gap]), np.concatenate([place[has].ravel(), col])
            best_first = np.lexsort((col, gap, row))
            first = np.searchsorted(row[best_first], has)
            best_first = best_first[first[:, None] + np.arange(k)]
            near[has], place[has] = gap[best_first], col[best_first]
            bound[has] = np.minimum(bound[has], near[has, -1])

        for first, last in zip(starts, np.append(starts[1:], len(order))):
            mine = order[first:last]
            middle = points[mine].mean(axis=0)
            b = points[mine] - middle
            bb = (b * b).sum(axis=1)
            reach, this = float(np.sqrt(bb.max())), cell[mine[0]]
            for rows in (np.flatnonzero(own == this), np.flatnonzero(own != this)):
                for at in range(0, len(rows), 4_096):
                    some = rows[at:at + 4_096]
                    a = queries[some] - middle
                    aa = (a * a).sum(axis=1)
                    # a hair of slack keeps rounding from excluding a neighbour on the boundary
                    inside = np.flatnonzero(np.sqrt(aa) * (1 - 1e-9) - reach * (1 + 1e-9) <= bound[some] * (1 + 1e-9) + 1e-9)
                    for lower in range(0, len(mine), 1_024):
                        part = slice(lower, lower + 1_024)
                        for piece in np.array_split(inside, -(-len(inside) // 512)) if len(inside) else ():
                            meet(some[piece], a[piece], aa[piece], b[part], bb[part], mine[part], reach)
        row, col = np.nonzero(np.isfinite(near))
        return row, place[row, col], near[row, col]

    def nearest(asked, known, k):
        """(query, id, label, distance): the best ``k`` within the bound of each query, and some of no use. Ids are in order."""
        query_ids, queries, bound = asked["query"].to_numpy(), matrix(asked["vector"]), asked["bound"].to_numpy(dtype=float)
        ids, labels, points = known["id"].to_numpy(), known["label"].to_numpy(), matrix(known["vector"])
        plain, sound = np.flatnonzero(usable(queries)), np.flatnonzero(usable(points))
        own, cell = asked["own"].to_numpy(), known["cell"].to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(plain) and len(sound):
            row, place, gap = search(queries[plain], own[plain], bound[plain], cell[sound], points[sound], k)
            out.append((plain[row], sound[place], gap))
        # vectors with numbers that can't be squared are compared one by one; what is no number comes last
        odd_queries, odd = np.setdiff1d(np.arange(len(queries)), plain), np.setdiff1d(np.arange(len(points)), sound)
        for rows, mine in ((odd_queries, np.arange(len(points))), (plain, odd)):
            if len(rows) and len(mine):
                found = best(rows, queries[rows], mine, mine, points[mine], k)
                row, place, gap = (found[c].to_numpy() for c in ("query", "id", "distance"))
                kept = ~(gap > bound[row])
                out.append((row[kept], place[kept], gap[kept]))
        row, place, gap = (np.concatenate(c) for c in zip(*out))
        if len(odd):
            order = np.lexsort((place, gap, row))
            row, place, gap = row[order], place[order], gap[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, place, gap = row[kept], place[kept], gap[kept]
        columns = {"query": query_ids[row], "id": ids[place], "label": labels[place], "distance": gap}
        return pd.DataFrame({c: pd.Series(v, dtype=v.dtype) for c, v in columns.items()})

    def matrix(vectors):
        return np.array(vectors.tolist(), dtype=float)

    def place(points, tops, starts, pivots):
        """Cell of each point and distance to its pivot; pivots ``starts[t]`` to ``starts[t + 1]`` are those of top t."""
        top = distances(points, tops).argmin(axis=1)
        cell, gap = np.empty(len(points), np.int32), np.empty(len(points))
        for t in np.unique(top):
            mine = np.flatnonzero(top == t)
            gaps = distances(points[mine], pivots[starts[t]:starts[t + 1]])
            near = gaps.argmin(axis=1)
            cell[mine], gap[mine] = starts[t] + near, gaps[np.arange(len(mine)), near]
        return cell, gap

    return distances, best, matrix, place, nearest


def _distinct_vectors(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids of each distinct vector; surplus copies go before the shuffle."""
    window = Window.partitionBy("vector").orderBy("id")
    return df.withColumn("__copy", F.row_number().over(window)).where(F.col("__copy") <= k).drop("__copy")


def _pivots(distinct: DataFrame, rows: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tops, starts, pivots): about ``wanted`` training vectors below a hash threshold, ordered by top."""
    share = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30)
    drawn = distinct.where(share < wanted / rows).select("vector").distinct().collect()
    drawn = drawn or distinct.select("vector").limit(1).collect()
    points = np.array(sorted(tuple(r["vector"]) for r in drawn), dtype=float)
    tops = points[np.random.default_rng(len(points)).permutation(len(points))[:int(np.ceil(len(points) ** 0.5))]]
    distances = _kernels()[0]
    owner = distances(points, tops).argmin(axis=1)
    order = np.argsort(owner, kind="stable")
    return tops, np.searchsorted(owner[order], np.arange(len(tops) + 1)), points[order]


def _with_cell(df: DataFrame, grid: tuple) -> DataFrame:
    _, _, matrix, place, _ = _kernels()

    @F.pandas_udf("struct<cell:int,gap:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        cell, gap = place(matrix(vectors), *grid) if len(vectors) else ([], [])
        return pd.DataFrame({"cell": np.array(cell, "int32"), "gap": np.array(gap, float)})

    return df.withColumn("__near", nearest("vector")).select("*", "__near.cell", "__near.gap").drop("__near")


def _summaries(cells: DataFrame) -> pd.DataFrame:
    """Per cell: size and radius; one row per pivot."""
    rows = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("gap").alias("radius")).collect()
    return pd.DataFrame([r.asDict() for r in rows]).sort_values("cell", ignore_index=True)


def _strips(summaries: pd.DataFrame, cells: int, rows: int) -> np.ndarray:
    """The strip of each of ``cells`` cells: cells in a row are put together as long as they have at most ``rows`` rows."""
    size, strips = np.zeros(cells, np.int64), np.zeros(cells, np.int32)
    size[summaries["cell"]] = summaries["size"]
    strip, filled = 0, 0
    for cell, own in enumerate(size):
        if filled and filled + own > rows:
            strip, filled = strip + 1, 0
        strips[cell], filled = strip, filled + own
    return strips


def _visits(asked: DataFrame, grid: tuple, summaries: pd.DataFrame, k: int, strips: np.ndarray | None = None) -> DataFrame:
    """(query, vector, bound, cells): the cells but its own (``cell``) that may hold a neighbour of a query.

    ``bound`` in ``asked`` is the distance of the k-th neighbour so far, infinite if there are fewer. With ``strips``,
    the strip of each cell, the strips of those cells but its own cell's.
    """
    distances, _, matrix, _, _ = _kernels()
    tops, starts, pivots = grid
    size, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    size[summaries["cell"]], radius[summaries["cell"]] = summaries["size"], summaries["radius"]
    owner = np.repeat(np.arange(len(tops)), np.diff(starts))
    reach = np.sqrt(((pivots - tops[owner]) ** 2).sum(axis=1)) + radius
    top_size, top_radius = np.add.reduceat(size, starts[:-1]), np.maximum.reduceat(reach, starts[:-1])
    rows_at_once = max(1, 2_000_000 // len(pivots))

    def first_bound(to_top):
        """A radius that surely holds ``k`` rows: whole tops, the nearest ends first."""
        far = to_top + top_radius[None, :]
        order = np.argsort(far, axis=1)
        enough = np.cumsum(top_size[order], axis=1) >= k
        at = enough.argmax(axis=1)
        found = np.take_along_axis(far, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
        return np.where(enough.any(axis=1), found, np.inf)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), rows_at_once):
                part = batch.iloc[start:start + rows_at_once]
                points, own = matrix(part["vector"]), part["cell"].to_numpy()
                to_top = distances(points, tops)
                bound = part["bound"].to_numpy(dtype=float)
                bound = np.where(np.isinf(bound), first_bound(to_top), bound)
                # a hair of slack keeps rounding from excluding a neighbour on the boundary
                bound = bound * (1 + 1e-9) + 1e-9
                near = to_top - top_radius[None, :] <= bound[:, None]
                row, cell = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for t in np.flatnonzero(near.any(axis=0)):
                    mine, under = np.flatnonzero(near[:, t]), slice(starts[t], starts[t + 1])
                    least = distances(points[mine], pivots[under]) - radius[None, under]
                    r, c = np.nonzero(least <= bound[mine][:, None])
                    row.append(mine[r])
                    cell.append(starts[t] + c)
                row, cell = np.concatenate(row), np.concatenate(cell)
                if strips is None:
                    other = cell != own[row]
                    row, cell = row[other], cell[other]
                else:
                    asks = np.zeros((len(part), strips[-1] + 1), bool)
                    asks[row, strips[cell]] = True
                    asks[np.arange(len(part)), strips[own]] = False
                    row, cell = np.nonzero(asks)
                order = np.argsort(row, kind="stable")
                has, at = np.unique(row[order], return_index=True)
                yield pd.DataFrame({
                    "query": part["query"].to_numpy()[has], "vector": part["vector"].to_numpy()[has], "bound": bound[has],
                    "cells": pd.Series(np.split(cell[order].astype("int32"), at[1:]) if len(has) else [], dtype=object),
                })

    kind = asked.schema["query"].dataType.simpleString()
    return asked.mapInPandas(visit, f"query {kind}, vector array<double>, bound double, cells array<int>")


def _result_type(asked: DataFrame, train: DataFrame) -> str:
    kinds = {n: d.schema[n].dataType.simpleString() for n, d in (("query", asked), ("id", train), ("label", train))}
    return ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", distance double"


def _small_join(asked: DataFrame, train: DataFrame, rows: list, k: int) -> DataFrame:
    """(query, id, label, distance) against a training set whose size was checked: no shuffle."""
    *_, nearest = _kernels()
    known = pd.DataFrame([r.asDict() for r in sorted(rows, key=lambda r: r["id"])]).assign(cell=0)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield nearest(batch.assign(own=0, bound=np.inf), known, k)

    return asked.mapInPandas(scan, _result_type(asked, train))


def _block_join(visits: DataFrame, cells: DataFrame, sizes: pd.DataFrame, block: int, k: int) -> DataFrame:
    """(query, id, label, distance): the best ``k`` within ``bound`` per query and block of training rows.

    Both sides of a strip are cut into blocks of about ``block`` rows by hash and every pair of blocks of the
    strip is one group: bounded memory, and a crowded cell becomes many tasks. ``own`` is the query's cell if it is in the strip.
    """
    spark = visits.sparkSession
    asked = visits.groupBy("strip").agg(F.count(F.lit(1)).alias("asked"))
    known = spark.createDataFrame([(int(r.strip), int(r.size)) for r in sizes.itertuples(index=False)], "strip int, size long")
    blocks = known.join(asked, "strip").select(
        "strip", F.ceil(F.col("size") / block).cast("int").alias("tb"),
        F.ceil(F.col("asked") / block).cast("int").alias("qb"),
    ).collect()                                    # one row per strip
    table = F.broadcast(spark.createDataFrame(blocks, "strip int, tb int, qb int"))

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Give a row its own block and copy it to every block of the other side."""
        placed = df.join(table, "strip").withColumn(own + "_no", F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return placed.withColumn(other + "_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    left = spread(visits, "query", "qb", "tb").select("strip", "tb_no", "qb_no", "query", "own", "vector", "bound")
    right = spread(cells, "id", "tb", "qb").select("strip", "tb_no", "qb_no", "id", "label", "cell", "vector")

    *_, nearest = _kernels()

    def search(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame({"query": [], "id": [], "label": [], "distance": []})
        # a distance that is no number counts in no block
        return nearest(asked, known.sort_values("id", kind="stable"), k).dropna(subset="distance")

    keys = ["strip", "tb_no", "qb_no"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _result_type(visits, cells))


def nearest_neighbors(
    queries: DataFrame, train: DataFrame, k: int = 5, pivots: int | None = None, exclude_self: bool = False,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """(id, rank, neighbor_id, label, distance): the ``k`` nearest training rows of each query, exactly.

    ``queries`` has ``id`` and ``vector array<double>``, ``train`` also ``label``. Equal
    distances rank by the smaller id. ``exclude_self`` leaves out the training row
    with the query's id.
    """
    wanted = k + 1 if exclude_self else k
    distinct = cut_lineage(_distinct_vectors(train.select("id", "label", "vector"), wanted))
    keyed = queries.select("id", "vector")
    answers = _answers(keyed.groupBy("vector").agg(F.min("id").alias("query")), distinct, wanted, pivots, small_rows)
    joined = keyed.join(answers, "vector").drop("vector")
    if not exclude_self:
        return joined.select("id", "rank", "neighbor_id", "label", "distance")
    others = joined.where(F.col("id") != F.col("neighbor_id"))
    own = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    ranked = others.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("id", "rank", "neighbor_id", "label", "distance")


def _answers(
    asked: DataFrame, distinct: DataFrame, k: int, pivots: int | None = None, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """(vector, rank, neighbor_id, label, distance) for distinct query vectors with a unique ``query`` id.

    ``distinct`` is a written table (:func:`_distinct_vectors`), since it is read several times.
    """
    known = distinct.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width")).first()
    if not known["rows"]:
        raise ValueError("no training rows to search")
    # the search is heavy per row: spread the queries over all tasks whatever their size in bytes
    spread = asked.select("query", "vector").repartition(slice_count(asked), "query")
    if known["rows"] <= small_rows and known["rows"] * known["width"] <= SMALL_NUMBERS:
        near = _small_join(spread, distinct, distinct.collect(), k)
    else:
        most = max(1, PIVOT_NUMBERS // max(1, known["width"]))
        wanted = pivots or min(most, max(FEWEST_PIVOTS, known["rows"] // CELL_ROWS))
        block = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, known["width"]), max(CELL_ROWS, known["rows"] // STRIPS)))
        near = _cell_join(spread, distinct, known["rows"], k, wanted, block)
    # written: metrics read the answers several times
    merged = cut_lineage(_best(near, k))
    merged = merged.select("query", F.col("id").alias("neighbor_id"), "label", "distance", "rank")
    return asked.join(merged, "query").drop("query")


def _best(near: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _cell_join(asked: DataFrame, distinct: DataFrame, rows: int, k: int, pivots: int, block: int) -> DataFrame:
    """The pruned join: own strips for a bound, then only the strips inside it. What is read twice is written once."""
    grid = _pivots(distinct, rows, pivots)
    cells = cut_lineage(_with_cell(distinct, grid).select("cell", "gap", "id", "label", "vector"))
    summaries = _summaries(cells)
    strips = _strips(summaries, len(grid[2]), block)
    sizes = summaries.assign(strip=strips[summaries["cell"]]).groupby("strip", as_index=False)["size"].sum()
    cells = cells.drop("gap")
    placed = cut_lineage(_with_cell(asked, grid).select("query", "vector", "cell"))

    def with_strip(df: DataFrame) -> DataFrame:
        numbers = df.sparkSession.createDataFrame(list(enumerate(strips.tolist())), "cell int, strip int")
        return df.join(F.broadcast(numbers), "cell")

    cells = with_strip(cells)
    home = with_strip(placed).select("query", "vector", "strip", F.col("cell").alias("own"), F.lit(float("inf")).alias("bound"))
    first = cut_lineage(_best(_block_join(home, cells, sizes, block, k), k).drop("rank"))
    bounds = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    bounded = placed.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    # a query's vector is kept once, beside the numbers of its strips
    visits = cut_lineage(_visits(bounded, grid, summaries, k, strips)).select(
        "query", "vector", "bound", F.lit(-1).alias("own"), F.explode("cells").alias("strip"))
    return first.unionByName(_block_join(visits, cells, sizes, block, k))


def knn_regress(queries: DataFrame, train: DataFrame, k: int = 5, **how) -> DataFrame:
    """(id, prediction): the mean label of the ``k`` nearest."""
    near = nearest_neighbors(queries, train, k, **how)
    return near.groupBy("id").agg(F.avg("label").alias("prediction"))


def knn_votes(queries: DataFrame, train: DataFrame, k: int = 5, **how) -> DataFrame:
    """(id, class, votes): the votes of the ``k`` nearest."""
    near = nearest_neighbors(queries, train, k, **how)
    return near.groupBy("id", F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("votes"))


def majority(votes: DataFrame) -> DataFrame:
    """(id, prediction): the class with most votes, the smaller class on a tie."""
    choice: Column = F.min_by("class", F.struct(-F.col("votes"), F.col("class")))
    return votes.groupBy("id").agg(choice.alias("prediction"))


def knn_classify(queries: DataFrame, train: DataFrame, k: int = 5, **how) -> DataFrame:
    """(id, prediction): the majority class of the ``k`` nearest."""
    return majority(knn_votes(queries, train, k, **how))
