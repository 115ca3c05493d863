"""Ownership, overlaps, ghost layers, star forests and periodic identification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import components, cut, empty
from .traverse import closure


def owners_from_parts(arrows: DataFrame, parts: DataFrame) -> DataFrame:
    """(point, owner) of parts(cell, part): a point's owner is the least part of the cells whose closure has it."""
    met = closure(arrows, parts.select("cell", F.col("cell").alias("point")), keys=["cell"])
    return met.join(parts, "cell").groupBy("point").agg(F.min("part").alias("owner"))


def ownership(held: DataFrame) -> DataFrame:
    """(rank, point, owner, is_ghost) of held(rank, point): the least rank that holds a point owns it."""
    least = held.groupBy("point").agg(F.min("rank").alias("owner"))
    return held.select("rank", "point").distinct().join(least, "point").select("rank", "point", "owner", (F.col("rank") != F.col("owner")).alias("is_ghost"))


def overlap_links(held: DataFrame) -> DataFrame:
    """(rank, point, neighbor): every other rank that holds the point."""
    a, b = held.select("rank", "point").distinct(), held.select(F.col("rank").alias("neighbor"), "point").distinct()
    return a.join(b, "point").where("rank <> neighbor").select("rank", "point", "neighbor")


def add_links(overlap: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent insertion; a remote id stays if a new link has none."""
    return overlap.unionByName(new, allowMissingColumns=True).groupBy("rank", "point", "neighbor").agg(F.max("remote_point").alias("remote_point"))


def remove_links(overlap: DataFrame, gone: DataFrame) -> DataFrame:
    return overlap.join(gone.select("rank", "point", "neighbor"), ["rank", "point", "neighbor"], "left_anti")


def retain_neighbors(overlap: DataFrame, ranks: list[int]) -> DataFrame:
    """Links to the given ranks; neighbours left without links are gone with them, as links are all there is of one."""
    return overlap.where(F.col("neighbor").isin(ranks))


def remove_neighbor(overlap: DataFrame, rank: int) -> DataFrame:
    return overlap.where(F.col("neighbor") != rank)


def resolve(overlap: DataFrame, known: DataFrame) -> DataFrame:
    got = overlap.join(known.select("rank", "point", "neighbor", F.col("remote_point").alias("new")), ["rank", "point", "neighbor"], "left")
    return got.withColumn("remote_point", F.coalesce("remote_point", "new")).drop("new")


def resolve_conflicts(overlap: DataFrame, known: DataFrame) -> DataFrame:
    return overlap.join(known.select("rank", "point", "neighbor", F.col("remote_point").alias("new")), ["rank", "point", "neighbor"]).where("remote_point is not null and remote_point <> new")


def neighbor_ranks(overlap: DataFrame) -> DataFrame:
    return overlap.groupBy("rank", "neighbor").agg(F.count("*").alias("links"), F.sum(F.col("remote_point").isNull().cast("int")).alias("unresolved"))


def overlap_faults(overlap: DataFrame) -> DataFrame:
    """Links to the own rank, repeated ones, and ones without a mirror."""
    own = overlap.where("rank = neighbor").select("rank", "point", "neighbor", F.lit("own_rank").alias("fault"))
    twice = overlap.groupBy("rank", "point", "neighbor").count().where("count > 1").select("rank", "point", "neighbor", F.lit("repeated").alias("fault"))
    back = overlap.select(F.col("neighbor").alias("rank"), F.coalesce("remote_point", "point").alias("point"), F.col("rank").alias("neighbor"))
    lone = overlap.join(back, ["rank", "point", "neighbor"], "left_anti").select("rank", "point", "neighbor", F.lit("no_mirror").alias("fault"))
    return own.unionByName(twice).unionByName(lone)


def ghost_layers(arrows: DataFrame, owned: DataFrame, layers: int = 1) -> DataFrame:
    """(rank, point, layer): owned(rank, point) as layer 0, then closure(support(...)) of what a rank has, layer by layer."""
    have = cut(owned.select("rank", "point").distinct().withColumn("layer", F.lit(0)))
    for k in range(1, layers + 1):
        up = have.select("rank", F.col("point").alias("dst")).join(arrows.select("src", "dst"), "dst").select("rank", F.col("src").alias("point")).distinct()
        met = closure(arrows, up, keys=["rank"]).select("rank", "point")
        new = met.join(have.select("rank", "point"), ["rank", "point"], "left_anti").withColumn("layer", F.lit(k))
        have = cut(have.unionByName(new))
    return have


def distribute(arrows: DataFrame, parts: DataFrame, layers: int = 1) -> dict[str, DataFrame]:
    """Local tables of all ranks: held (with layers), ownership, overlap and arrows(rank, src, dst)."""
    owners = cut(owners_from_parts(arrows, parts))
    own = parts.select(F.col("part").alias("rank"), "cell").select("rank", F.col("cell").alias("point"))
    local = closure(arrows, own, keys=["rank"]).select("rank", "point")
    held = ghost_layers(arrows, local, layers)
    ends = held.select("rank", F.col("point").alias("src")).join(arrows, "src").join(held.select("rank", F.col("point").alias("dst")), ["rank", "dst"], "left_semi")
    of = held.select("rank", "point").join(owners, "point").withColumn("is_ghost", F.col("rank") != F.col("owner"))
    return {"held": held, "ownership": of, "overlap": overlap_links(held), "arrows": ends.select("rank", *arrows.columns)}


def complete(values: DataFrame, owners: DataFrame) -> DataFrame:
    """Copies of the owner's value on every rank: values(rank, point, idx, value), owners(point, owner)."""
    from_ = values.join(owners.select("point", F.col("owner").alias("rank")), ["rank", "point"], "left_semi").select("point", "idx", F.col("value").alias("new"))
    return values.join(from_, ["point", "idx"], "left").withColumn("value", F.coalesce("new", "value")).drop("new").select("rank", "point", "idx", "value")


def complete_sieve(local: DataFrame, overlap: DataFrame, rounds: int = 50) -> DataFrame:
    """(rank, src, dst): a rank imports the neighbours' arrows of points that it shares until nothing new comes."""
    have = cut(local.select("rank", "src", "dst").distinct())
    for _ in range(rounds):
        shared = overlap.select(F.col("neighbor").alias("rank"), "point", F.col("rank").alias("to"))
        sent = have.join(shared.withColumnRenamed("point", "src"), ["rank", "src"]).select(F.col("to").alias("rank"), "src", "dst")
        new = cut(sent.distinct().join(have, ["rank", "src", "dst"], "left_anti"))
        if empty(new):
            return have
        have = cut(have.unionByName(new))
    raise RuntimeError("completion did not settle")


def complete_reduced(values: DataFrame, reducer=F.sum) -> DataFrame:
    """values(rank, point, idx, value) with every copy replaced by the reducer over all ranks' copies."""
    every = values.groupBy("point", "idx").agg(reducer("value").alias("value"))
    return values.select("rank", "point", "idx").join(every, ["point", "idx"]).select("rank", "point", "idx", "value")


def complete_stack(vertical: DataFrame, overlap: DataFrame) -> DataFrame:
    """vertical(rank, base, cap) with the neighbours' arrows of shared bases, each once."""
    to = overlap.select(F.col("neighbor").alias("rank"), F.col("point").alias("base"), F.col("rank").alias("to"))
    sent = vertical.join(to, ["rank", "base"]).select(F.col("to").alias("rank"), "base", "cap")
    return vertical.select("rank", "base", "cap").unionByName(sent).distinct()


def fetch(local: DataFrame, requests: DataFrame, kind: str = "cone") -> DataFrame:
    """(rank, src, dst): cones or supports, from whatever rank has them, of the points that requests(rank, point) name."""
    end = {"cone": "src", "support": "dst"}[kind]
    return requests.select("rank", F.col("point").alias(end)).distinct().join(local.select("src", "dst").distinct(), end).select("rank", "src", "dst")


def closure_completed(local: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(rank, point, depth): closures of seeds(rank, point) that go on through the arrows of all ranks."""
    return closure(local.select("src", "dst").distinct(), seeds, keys=["rank"], max_depth=max_depth)


def forest(owned: DataFrame) -> DataFrame:
    """Star forest of an ownership table: (rank, leaf, remote_rank, remote_point) for ghosts."""
    return owned.where("is_ghost").select("rank", F.col("point").alias("leaf"), F.col("owner").alias("remote_rank"), F.col("point").alias("remote_point"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Leaves of first followed through second; where second has no such leaf the first root stays."""
    nxt = second.select(F.col("rank").alias("remote_rank"), F.col("leaf").alias("remote_point"), F.col("remote_rank").alias("rr"), F.col("remote_point").alias("rp"))
    return first.join(nxt, ["remote_rank", "remote_point"], "left").select("rank", "leaf", F.coalesce("rr", "remote_rank").alias("remote_rank"), F.coalesce("rp", "remote_point").alias("remote_point"))


def invert(sf: DataFrame) -> DataFrame:
    return sf.select(F.col("remote_rank").alias("rank"), F.col("remote_point").alias("leaf"), F.col("rank").alias("remote_rank"), F.col("leaf").alias("remote_point"))


def invert_faults(sf: DataFrame) -> DataFrame:
    return sf.groupBy("remote_rank", "remote_point").count().where("count > 1")


def restrict_forest(sf: DataFrame, stratum: DataFrame) -> DataFrame:
    return sf.join(stratum.select(F.col("point").alias("leaf")), "leaf", "left_semi").select(*sf.columns)


def migrate(values: DataFrame, sf: DataFrame) -> DataFrame:
    """Rows of values(rank, point, ...) moved to the leaves whose roots they stand at."""
    roots = sf.select(F.col("remote_rank").alias("rank"), F.col("remote_point").alias("point"), F.col("rank").alias("to"), "leaf")
    rest = [c for c in values.columns if c not in ("rank", "point")]
    return values.join(roots, ["rank", "point"]).select(F.col("to").alias("rank"), F.col("leaf").alias("point"), *rest)


def forest_faults(sf: DataFrame, held: DataFrame) -> DataFrame:
    """Roots that no rank holds."""
    return sf.join(held.select(F.col("rank").alias("remote_rank"), F.col("point").alias("remote_point")), ["remote_rank", "remote_point"], "left_anti")


def periodic_classes(pairs: DataFrame) -> DataFrame:
    """(point, representative) of pairs(slave, master): the least id of each class."""
    return components(pairs.select(F.col("slave").alias("u"), F.col("master").alias("v"))).select(F.col("node").alias("point"), F.col("component").alias("representative"))


def periodic_conflicts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("slave").agg(F.countDistinct("master").alias("masters")).where("masters > 1")


def quotient(arrows: DataFrame, classes: DataFrame) -> DataFrame:
    """Arrows between representatives, without loops and repeats."""
    for c in ("src", "dst"):
        arrows = arrows.join(classes.select(F.col("point").alias(c), F.col("representative").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    return arrows.where("src <> dst").dropDuplicates(["src", "dst"])


def balance_boundary(shared: DataFrame, load: DataFrame) -> DataFrame:
    """(point, owner) of shared(point, rank): points in id order go to their sharing rank of least load, then rank.

    Inherently one pass in order: the boundary set goes to one task as pandas, the interior never does.
    """
    import pandas as pd

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        now = dict(zip(right["rank"], right["load"], strict=True))
        rows = []
        for p, g in left.sort_values(["point", "rank"]).groupby("point"):
            r = min(g["rank"], key=lambda x: (now.get(x, 0), x))
            now[r] = now.get(r, 0) + 1
            rows.append((p, r))
        return pd.DataFrame(rows, columns=["point", "owner"])

    one = F.lit(1).alias("k")
    return shared.select(one, "point", "rank").groupBy("k").cogroup(load.select(one, "rank", "load").groupBy("k")).applyInPandas(run, "point long, owner int")
