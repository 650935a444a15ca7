"""Weights, clusters, entropies and thresholds of sampled answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from hopsmith.functions.vectors import total

#: Stands for a log weight that is missing or not finite.
MISSING = -1e30


def softmax_weights(logs: Column) -> Column:
    """Weights that sum to 1; if nothing counts, all alike."""
    finite = F.transform(logs, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), MISSING).otherwise(x))
    most = F.array_max(finite)
    raw = F.transform(finite, lambda x: F.exp(x - most))
    none = (most == MISSING) | (total(raw) < 1e-300)
    return F.when(none, F.transform(logs, lambda _: F.lit(1.0) / F.size(logs))).otherwise(F.transform(raw, lambda x: x / total(raw)))


def cluster_weights(weights: Column, cluster: Column) -> Column:
    """Summed weight of each cluster, by cluster number."""
    return F.transform(F.array_sort(F.array_distinct(cluster)), lambda c: total(F.zip_with(weights, cluster, lambda w, k: F.when(k == c, w).otherwise(0.0))))


def entropy(weights: Column) -> Column:
    """-sum(p ln p) over p above 1e-15."""
    return -F.aggregate(weights, F.lit(0.0), lambda a, p: a + F.when(p > 1e-15, p * F.log(p)).otherwise(0.0))


def count_entropy(cluster: Column) -> Column:
    """Entropy of cluster shares with log(p + 1e-12)."""
    share = F.transform(F.array_distinct(cluster), lambda c: F.size(F.filter(cluster, lambda k: k == c)) / F.size(cluster))
    return -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log(p + 1e-12))


def connected_clusters(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """Cluster of each of ``n`` items joined by mutual links; numbers in order of first items."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    number: dict[int, int] = {}
    return [number.setdefault(find(i), len(number)) for i in range(n)]


@pandas_udf(ArrayType(IntegerType()))
def mutual_clusters(entails: pd.Series, threshold: pd.Series) -> pd.Series:
    """Clusters by entailment above the threshold both ways; ``entails`` is a square of scores."""

    def of(square, t):
        n = len(square)
        return connected_clusters(n, [(i, j) for i in range(n) for j in range(i + 1, n) if square[i][j] > t and square[j][i] > t])

    return pd.Series([None if s is None else of(s, t) for s, t in zip(entails, threshold)])


@pandas_udf(ArrayType(IntegerType()))
def leader_clusters(mutual: pd.Series) -> pd.Series:
    """Each item joins the first cluster whose first member it matches both ways. Differs
    from ``mutual_clusters`` where matching isn't transitive."""

    def of(square):
        leaders: list[int] = []
        out = []
        for i in range(len(square)):
            at = next((c for c, lead in enumerate(leaders) if square[lead][i] and square[i][lead]), len(leaders))
            if at == len(leaders):
                leaders.append(i)
            out.append(at)
        return out

    return pd.Series([None if s is None else of(s) for s in mutual])
