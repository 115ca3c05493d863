"""Graph partitioning: Louvain clusters, merging into parts, vertex cuts and quality figures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut
from .topology import dense_index, exclusive_sum


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("vertex")).unionByName(edges.select(F.col("v").alias("vertex")))
    return both.groupBy("vertex").agg(F.count("*").alias("degree"))


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(edge_cut, edges): edges between different parts of parts(vertex, part)."""
    a, b = parts.select(F.col("vertex").alias("u"), F.col("part").alias("pu")), parts.select(F.col("vertex").alias("v"), F.col("part").alias("pv"))
    return edges.join(a, "u").join(b, "v").agg(F.sum((F.col("pu") != F.col("pv")).cast("long")).alias("edge_cut"), F.count("*").alias("edges"))


def _touched(edges: DataFrame, parts: DataFrame) -> DataFrame:
    p = parts.select("vertex", "part")
    far = edges.select(F.col("u").alias("vertex"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("u").alias("o")))
    return far.join(p.select(F.col("vertex").alias("o"), "part"), "o").select("vertex", "part")


def replication_factor(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Mean number of distinct parts among a vertex and its neighbours."""
    n = _touched(edges, parts).unionByName(parts.select("vertex", "part")).groupBy("vertex").agg(F.countDistinct("part").alias("n"))
    return n.agg(F.avg("n").alias("replication_factor"))


def load_balance(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(min_load, max_load, ratio): sums of degrees by part; the ratio is infinite when the least is zero."""
    load = parts.join(degrees(edges), "vertex", "left").groupBy("part").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("load"))
    got = load.agg(F.min("load").alias("min_load"), F.max("load").alias("max_load"))
    return got.withColumn("ratio", F.when(F.col("min_load") == 0, F.lit(float("inf"))).otherwise(F.col("max_load") / F.col("min_load")))


def vertex_cuts(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(vertex, primary, replicas): the part most met among a vertex' neighbours (own part first among equals), and all met."""
    near = _touched(edges, parts).groupBy("vertex", "part").count()
    own = parts.select("vertex", F.col("part").alias("own"))
    got = near.join(own, "vertex").groupBy("vertex").agg(F.max_by("part", F.struct("count", (F.col("part") == F.col("own")).cast("int"), -F.col("part"))).alias("primary"), F.sort_array(F.collect_set("part")).alias("replicas"))
    return parts.select("vertex", "part").join(got, "vertex", "left").select("vertex", F.coalesce("primary", "part").alias("primary"), F.coalesce("replicas", F.array("part")).alias("replicas"))


def louvain(edges: DataFrame, vertices: DataFrame, targets: int, alpha: float = 0.75, max_iters: int = 20) -> DataFrame:
    """(vertex, cluster): in each round pairs of clusters that are each other's best merge, until `targets` are left,
    nothing gains, or after max_iters rounds.

    A pair's score is its modularity gain scaled by alpha and by the ratio of the smaller to the larger volume; ties go
    to the lesser ids, and if fewer merges are wanted than there are, to the best ones. The best pair of all is always
    mutual, so each round merges one at least, and rounds follow the logarithm of the clusters where they pair up well.
    """
    m = edges.count()
    state = cut(vertices.select("vertex", F.col("vertex").alias("cluster")).distinct())
    n = state.count()
    degree = cut(degrees(edges))
    for _ in range(max_iters):
        if n <= targets or not m:
            break
        a, b = state.select(F.col("vertex").alias("u"), F.col("cluster").alias("cu")), state.select(F.col("vertex").alias("v"), F.col("cluster").alias("cv"))
        between = edges.join(a, "u").join(b, "v").where("cu <> cv").select(F.least("cu", "cv").alias("x"), F.greatest("cu", "cv").alias("y")).groupBy("x", "y").agg(F.count("*").alias("e"))
        volume = state.join(degree, "vertex", "left").groupBy("cluster").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("vol"))
        pairs = between.join(volume.select(F.col("cluster").alias("x"), F.col("vol").alias("vx")), "x").join(volume.select(F.col("cluster").alias("y"), F.col("vol").alias("vy")), "y")
        gain = F.col("e") / m - F.col("vx") * F.col("vy") / (2.0 * m * m)
        scored = pairs.select("x", "y", (gain * alpha * F.least("vx", "vy") / F.greatest("vx", "vy")).alias("score")).where("score > 0")
        sides = F.explode(F.array(F.struct(F.col("x").alias("own"), F.col("y").alias("o")), F.struct(F.col("y").alias("own"), F.col("x").alias("o")))).alias("p")
        best = scored.select("x", "y", "score", sides).groupBy("p.own").agg(F.max(F.struct("score", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).alias("b"))
        mutual = cut(best.groupBy((-F.col("b.x")).alias("x"), (-F.col("b.y")).alias("y")).agg(F.count("*").alias("k"), F.max("b.score").alias("score")).where("k = 2"))
        found = mutual.count()
        if not found:
            break
        if found > n - targets:
            order = dense_index(mutual.withColumn("rank", -F.col("score")), ["rank", "x", "y"], "i")
            mutual, found = order.where(F.col("i") < n - targets), n - targets
        state = cut(state.join(mutual.select(F.col("y").alias("cluster"), F.col("x").alias("_x")), "cluster", "left").select("vertex", F.coalesce("_x", "cluster").alias("cluster")))
        n -= found
    return state


def merge_clusters(clusters: DataFrame, edges: DataFrame, parts: int, epsilon: float = 0.05) -> DataFrame:
    """(vertex, part): loads, as sums of degrees, stay within a cluster or epsilon of the mean.

    Clusters over epsilon of the mean load, at most parts / epsilon of them, go to the least loaded part by falling
    volume. The others, in the same order, fill what each part lacks to the mean by their prefix sums. Clusters without
    edges are dealt by a hash.
    """
    volume = cut(clusters.join(degrees(edges), "vertex", "left").groupBy("cluster").agg(F.sum(F.coalesce("degree", F.lit(0))).cast("long").alias("vol")))
    total = volume.agg(F.sum("vol")).first()[0] or 0
    mean = total / parts
    load, head = [0] * parts, []
    for r in volume.where(F.col("vol") > epsilon * mean).orderBy(F.desc("vol"), "cluster").collect() if total else []:
        k = min(range(parts), key=lambda p: (load[p], p))
        load[k] += r["vol"]
        head.append((r["cluster"], k))
    ends, room = [], 0.0
    for x in load:
        room += max(0.0, mean - x)
        ends.append(room)
    spark = clusters.sparkSession
    big = F.broadcast(spark.createDataFrame(head, "cluster long, part int"))
    small = exclusive_sum(volume.where((F.col("vol") > 0) & (F.col("vol") <= epsilon * mean)).withColumn("_o", -F.col("vol")), "vol", ["_o", "cluster"], "before")
    full = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("before")))
    fill = small.select("cluster", F.least(full, F.lit(parts - 1)).cast("int").alias("part"))
    bare = volume.where("vol = 0").select("cluster", F.pmod(F.xxhash64("cluster"), F.lit(parts)).cast("int").alias("part"))
    chosen = volume.select("cluster").join(big, "cluster").unionByName(fill).unionByName(bare)
    return clusters.join(chosen, "cluster").select("vertex", "part")


def partition(edges: DataFrame, vertices: DataFrame, parts: int, alpha: float = 0.75, epsilon: float = 0.05, max_iters: int = 20, seed_factor: float = 4.0) -> DataFrame:
    clusters = louvain(edges, vertices, math.ceil(seed_factor * parts), alpha, max_iters)
    return merge_clusters(clusters, edges, parts, epsilon)


def pick_seeds(edges: DataFrame, vertices: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k vertices drawn without replacement in proportion to their degree, by exponential keys from a hash of the id."""
    u = (F.pmod(F.xxhash64("vertex", F.lit(seed)), F.lit(2**40)) + 1) / float(2**40 + 1)
    w = vertices.join(degrees(edges), "vertex", "left").select("vertex", F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1)).alias("w"))
    return w.withColumn("key", F.log(u) / F.col("w")).orderBy(F.desc("key"), "vertex").limit(k).select("vertex")


def least_decision(decisions: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Ranks' decisions about the same key reconciled: the least wins."""
    return decisions.groupBy(*keys).agg(F.min(value).alias(value))


def edge_faults(edges: DataFrame) -> DataFrame:
    """Edges not given once with u < v."""
    return edges.where("u >= v").withColumn("fault", F.lit("order")).unionByName(edges.groupBy("u", "v").count().where("count > 1").select("u", "v", F.lit("repeated").alias("fault")))
