"""Centroid clustering by Lloyd's rounds over ball trees.

Vectors become integers, so means and distances are exact. Each partition builds trees of
at most ``tree_size`` of its own vectors, without a shuffle, and writes them once. A ball
knows its vectors' count, integer sum and radius around their mean. In a round, balls come
down the tree with the centroids that may still own one of their vectors: by the triangle
inequality a centroid is out if it is farther from the ball's middle than the nearest one by
more than twice the radius. A ball with one centroid left is assigned whole, by its count and
sum; an open leaf's vectors are compared one by one. What a round sends is a sum by task,
centroid and dimension; the driver gets ``k * (width + 1)`` sums.

Bounds leave a margin for rounding, and ties never settle a ball, so that rounding costs
comparisons but no result. Vectors of components too large for exact floats stand in lists of
their own, compared in Python's integers.

Defined cases: vectors that are null, of another width, or hold a null or non-finite component
take no part; without vectors that can start a centroid there are no rows; fewer vectors than ``k`` start fewer centroids. A
null id's vector is assigned but starts no centroid. Repeated rows each count and each get a row;
rows of one id start centroids in the order of their components. Ties go to the smaller number; a
centroid that owns nothing stays. A distance or inertia that doesn't fit a long is an error, as is a
component that isn't finite once scaled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopsmith.llm.common import discard, map_arrow, written

#: Dimension under which the count of a centroid's vectors is sent.
COUNT = -1
RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def exact_below(width: int) -> float:
    """Magnitude up to which squared distances of integers are exact in doubles."""
    return math.sqrt(2.0**50 / max(width, 1))


def ball_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the points in which each ball has a run, and by ball: first place, count,
    first of two children (0: none), radius and sum. Balls are halved between two far points."""
    order = np.arange(len(points))
    first, count, child, radius, sums = [0], [len(points)], [0], [], []
    ball = 0
    while ball < len(first):
        a, n = first[ball], count[ball]
        own = points[order[a : a + n]]
        total = own.sum(axis=0)
        far = ((own - total / n) ** 2).sum(axis=1)
        radius.append(math.sqrt(far.max()))
        sums.append(total)
        if n > leaf and (own != own[0]).any():  # copies of one vector are one ball, however many
            one = own[far.argmax()]
            two = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = n // 2
            order[a : a + n] = order[a : a + n][np.argpartition(own @ (two - one), half)]
            child[ball] = len(first)
            first += [a, a + half]
            count += [half, n - half]
            child += [0, 0]
        ball += 1
    return order, {"first": np.array(first), "count": np.array(count), "child": np.array(child), "radius": np.array(radius), "sums": np.array(sums)}


def filtered(points: np.ndarray, balls: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's centroid, the settled balls, and which points were compared one by one."""
    owner, compared = np.full(len(points), -1), np.zeros(len(points), bool)
    settled, at, open_ = [], np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    size = max(float(np.abs(points).max(initial=0)), float(np.abs(centroids).max(initial=0))) * math.sqrt(points.shape[1])
    while len(at):
        middle, radius = balls["sums"][at] / balls["count"][at, None], balls["radius"][at]
        away = np.stack([np.sqrt(((middle - c) ** 2).sum(axis=1)) for c in centroids], axis=1)
        nearest = np.where(open_, away, np.inf).min(axis=1)
        margin = 1e-9 * (nearest + radius) + 1e-12 * size
        open_ = open_ & (away <= (nearest + 2 * radius + 4 * margin)[:, None])
        one = open_.sum(axis=1) == 1
        settled.append(at[one])
        for ball, c in zip(at[one], open_[one].argmax(axis=1)):
            owner[balls["first"][ball] : balls["first"][ball] + balls["count"][ball]] = c
        leaf = ~one & (balls["child"][at] == 0)
        for ball in at[leaf]:
            compared[balls["first"][ball] : balls["first"][ball] + balls["count"][ball]] = True
        down = ~one & ~leaf
        at, open_ = np.repeat(balls["child"][at[down]], 2), np.repeat(open_[down], 2, axis=0)
        at[1::2] += 1
    if compared.any():
        near = points[compared]
        squares = (near**2).sum(axis=1)[:, None] - 2 * (near @ centroids.T) + (centroids**2).sum(axis=1)
        owner[compared] = squares.argmin(axis=1)
    return owner, np.concatenate(settled) if settled else np.empty(0, np.int64), compared


def quantised(vectors: DataFrame, id_col: str, vec_col: str, width: int) -> DataFrame:
    """(id, vector) of the vectors that take part."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    vector = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("id"), vector.alias("vector")).where((F.size("vector") == width) & F.forall("vector", usable))


def scaled(flat: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(float(scale) * flat)
    if not np.isfinite(x).all():
        raise OverflowError("a component isn't finite once scaled")
    return x


TREE = "width int, kind string, points binary, first binary, count binary, child binary, radius binary, sums binary"


def trees(kept: DataFrame, width: int, scale: int, tree_size: int, leaf: int) -> DataFrame:
    """A row for each tree of a partition; a row without balls holds the vectors too large for one."""
    kind = dict(kept.dtypes)["id"]
    limit = exact_below(width)

    def row(ids: list, points: np.ndarray, wide: bool, id_type: pa.DataType) -> pa.RecordBatch:
        balls = {}
        if not wide:
            order, balls = ball_tree(points, leaf)
            ids, points = [ids[i] for i in order], points[order]
        most = np.abs(points).max(initial=0)
        stored = "<f8" if wide else "<i2" if most < 2**15 else "<i4"
        packed = [balls.get(n, np.empty(0)).astype(t).tobytes() for n, t in (("first", "<i4"), ("count", "<i4"), ("child", "<i4"), ("radius", "<f8"), ("sums", "<f8"))]
        values = [pa.array([ids], pa.list_(id_type)), pa.array([width], pa.int32()), pa.array([stored]), pa.array([points.astype(stored).tobytes()], pa.binary()), *(pa.array([p], pa.binary()) for p in packed)]
        return pa.RecordBatch.from_arrays(values, ["ids", "width", "kind", "points", "first", "count", "child", "radius", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        for batch in batches:
            id_type = batch.column("id").type
            for at in range(0, batch.num_rows, tree_size):
                part = batch.slice(at, tree_size)
                ids = part.column("id").to_pylist()
                points = scaled(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width), scale)
                is_wide = (np.abs(points) >= limit).any(axis=1)
                for wide, (own, parts) in held.items():
                    which = np.flatnonzero(is_wide == wide)
                    own += [ids[i] for i in which]
                    parts.append(points[which])
                    if len(own) >= tree_size:
                        yield row(own, np.concatenate(parts), wide, id_type)
                        held[wide] = [], []
        for wide, (own, parts) in held.items():
            if own:
                yield row(own, np.concatenate(parts), wide, id_type)

    return map_arrow(kept, run, f"ids array<{kind}>, {TREE}")


def unpacked(row: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    points = np.frombuffer(row["points"], row["kind"]).astype(np.float64).reshape(-1, row["width"])
    balls = {n: np.frombuffer(row[n], t) for n, t in (("first", "<i4"), ("count", "<i4"), ("child", "<i4"), ("radius", "<f8"), ("sums", "<f8"))}
    balls["sums"] = balls["sums"].reshape(-1, row["width"])
    return points, balls


def whole_numbers(points: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in p] for p in points.tolist()], object).reshape(points.shape)


def exact_squares(points: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances (points x centroids) in Python's integers."""
    own = whole_numbers(points)
    return np.array([[sum((a - b) ** 2 for a, b in zip(p, c)) for c in centroids] for p in own.tolist()], object).reshape(len(points), len(centroids))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Trees one by one; ids stay in Arrow."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].values if n == "ids" else batch.column(n)[i].as_py() for n in batch.schema.names}


def is_plain(row: dict, centroids: list[list[int]]) -> bool:
    return len(row["first"]) > 0 and max((abs(x) for c in centroids for x in c), default=0) < exact_below(row["width"])


def round_of(grown: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floors of their vectors' means."""
    k, width = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * k, np.zeros((k, width), object)
        near = np.array(centroids, np.float64)
        for row in rows_of(batches):
            points, balls = unpacked(row)
            if is_plain(row, centroids):
                owner, settled, compared = filtered(points, balls, near)
                added = np.zeros((k, width))
                np.add.at(added, owner[balls["first"][settled]], balls["sums"][settled])
                for c in np.unique(owner[compared]):
                    added[c] += points[compared & (owner == c)].sum(axis=0)
                totals += added.astype(np.int64).astype(object)
            else:
                owner = exact_squares(points, centroids).argmin(axis=1)
                np.add.at(totals, owner, whole_numbers(points))
            for c, n in enumerate(np.bincount(owner, minlength=k).tolist()):
                counts[c] += n
        for c, n in enumerate(counts):
            if n:
                values = [Decimal(n), *(Decimal(int(x)) for x in totals[c])]
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(values), pa.int32()), pa.array([COUNT, *range(width)], pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["cluster", "dimension", "total"])

    found = map_arrow(grown, sums, "cluster int, dimension int, total decimal(38,0)").groupBy("cluster", "dimension").agg(F.sum("total").alias("total"))
    by_place = {(r.cluster, r.dimension): int(r.total) for r in found.collect()}  # at most k * (width + 1) rows
    return [[by_place[c, d] // by_place[c, COUNT] for d in range(width)] if (c, COUNT) in by_place else old for c, old in enumerate(centroids)]


def assigned(grown: DataFrame, centroids: list[list[int]], kind: str) -> DataFrame:
    """(id, cluster, distance) of every vector; distances are squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.array(centroids, np.float64)
        for row in rows_of(batches):
            points, balls = unpacked(row)
            if is_plain(row, centroids):
                owner = filtered(points, balls, near)[0]
                distance = ((points - near[owner]) ** 2).sum(axis=1).astype(np.int64).tolist()
            else:
                squares = exact_squares(points, centroids)
                owner = squares.argmin(axis=1)
                distance = [int(s[c]) for s, c in zip(squares, owner)]
            if max(distance) >= 2**63:
                raise OverflowError("a squared distance doesn't fit a long")
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(owner, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return map_arrow(grown, run, f"id {kind}, cluster int, distance long")


def starts(kept: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of smallest hash, as integers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.where(F.col("id").isNotNull()).orderBy(h, "vector").limit(k).collect()
    return [[int(x) for x in scaled(np.array(r.vector), scale)] for r in rows]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", tree_size: int = 16384, leaf: int = 32) -> DataFrame:
    """Each vector's id, cluster and squared distance, its cluster's and the whole inertia,
    and the sha256 of its centroid. Rounds end early where no centroid moves any more: all
    later ones would be the same."""
    spark, kept = vectors.sparkSession, quantised(vectors, id_col, vec_col, width)
    kind = dict(kept.dtypes)["id"]
    centroids = starts(kept, k, scale, seed)
    if not centroids:
        return spark.createDataFrame([], f"{id_col} {kind}, {RESULT}")
    grown = written(trees(kept, width, scale, tree_size, leaf), "trees")
    for _ in range(rounds):
        before, centroids = centroids, round_of(grown, centroids)
        if centroids == before:
            break
    out = written(assigned(grown, centroids, kind), "assigned")
    discard(grown)
    inertia = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = sum(inertia.values())
    if whole >= 2**63:
        raise OverflowError("the inertia doesn't fit a long")

    def by_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)

    own = by_cluster([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", own, F.lit(whole).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"))
