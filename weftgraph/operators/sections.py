"""Atlases and sections: layouts, gathers and scatters, resizing, refinement and assembly of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topology import exclusive_sum


def atlas(spans: DataFrame) -> DataFrame:
    """(point, seq, len, offset) of spans(point, seq, len): contiguous offsets in order of insertion."""
    return exclusive_sum(spans.select("point", "seq", F.col("len").cast("long").alias("len")), "len", ["seq"], "offset")


def atlas_faults(spans: DataFrame) -> DataFrame:
    """Points inserted twice, and spans without length."""
    twice = spans.groupBy("point").count().where("count > 1").select("point", F.lit("duplicate").alias("fault"))
    return twice.unionByName(spans.where("len < 1 or len is null").select("point", F.lit("no_length").alias("fault")))


def remove_points(spans: DataFrame, gone: DataFrame) -> DataFrame:
    return atlas(spans.join(gone.select("point"), "point", "left_anti"))


def flat(section: DataFrame) -> DataFrame:
    """(index, point, idx, value): the section's values in order of the atlas."""
    laid = exclusive_sum(section.withColumn("len", F.size("values").cast("long")), "len", ["seq"], "offset")
    return laid.select("offset", "point", F.posexplode("values").alias("idx", "value")).select((F.col("offset") + F.col("idx")).alias("index"), "point", "idx", "value")


#: Indices of a buffer that meet the slices' spans at once.
RUN = 64


def scatter(layout: DataFrame, buffer: DataFrame) -> DataFrame:
    """(point, seq, values) from buffer(index, value); slices with a hole come out short, see length_faults.

    Values meet the spans that touch their run of indices. The join is by sorting: a layout is small beside the spans
    that it is spread to, so its size mustn't decide that these are broadcast.
    """
    runs = F.sequence(F.floor(F.col("offset") / RUN), F.floor((F.col("offset") + F.col("len") - 1) / RUN))
    spans = layout.where("len > 0").select("point", "seq", "offset", "len", F.explode(runs).alias("run"))
    values = buffer.select("index", "value", F.floor(F.col("index") / RUN).alias("run"))
    met = values.join(spans.hint("merge"), "run").where("index >= offset and index < offset + len")
    got = met.groupBy("point", "seq").agg(F.array_sort(F.collect_list(F.struct((F.col("index") - F.col("offset")).alias("idx"), "value"))).alias("x"))
    return got.select("point", "seq", F.col("x.value").alias("values"))


def length_faults(section: DataFrame, layout: DataFrame) -> DataFrame:
    """Points of the layout whose slice is missing or of another length."""
    got = layout.select("point", "len").join(section.select("point", F.size("values").alias("n")), "point", "left")
    return got.where("n is null or n <> len")


def resized(values: Column, length: Column, policy: str = "zero", pad: float = 0.0) -> Column:
    """zero and pad discard old values; prefix and suffix keep min(old, new) of them at that end."""
    zero = F.lit(0.0)
    k = F.least(F.size(values), length)
    if policy == "zero":
        return F.array_repeat(zero, length)
    if policy == "pad":
        return F.array_repeat(F.lit(pad), length)
    if policy == "prefix":
        return F.concat(F.slice(values, F.lit(1), k), F.array_repeat(zero, length - k))
    if policy == "suffix":
        return F.concat(F.array_repeat(zero, length - k), F.slice(values, F.size(values) - k + 1, k))
    raise ValueError(policy)


def resize(section: DataFrame, lengths: DataFrame, policy: str = "zero", pad: float = 0.0) -> DataFrame:
    got = section.join(lengths.select("point", F.col("len").cast("int").alias("_len")), "point")
    return got.withColumn("values", resized(F.col("values"), F.col("_len"), policy, pad)).drop("_len")


def copy_between(section: DataFrame, pairs: DataFrame) -> DataFrame:
    """section with dst's slice set to src's, reversed where pairs(src, dst, reverse) says so."""
    from_ = section.select(F.col("point").alias("src"), F.col("values").alias("new"))
    new = pairs.join(from_, "src").select(F.col("dst").alias("point"), F.when(F.col("reverse"), F.reverse("new")).otherwise(F.col("new")).alias("new"))
    return section.join(new, "point", "left").withColumn("values", F.coalesce("new", "values")).drop("new")


def refine(coarse: DataFrame, mapping: DataFrame) -> DataFrame:
    """(point, values) of fine points: mapping(coarse, fine, reverse) copies coarse slices, reversed where it says so."""
    c = coarse.select(F.col("point").alias("coarse"), "values")
    return mapping.join(c, "coarse").select(F.col("fine").alias("point"), F.when(F.col("reverse"), F.reverse("values")).otherwise(F.col("values")).alias("values"))


def refine_faults(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("fine").count().where("count > 1")


def assemble(base: DataFrame, caps: DataFrame, stack: DataFrame, reducer=F.avg) -> DataFrame:
    """base with slices reduced element by element over its caps in stack(base, cap); bases without caps stay."""
    rows = stack.join(caps.select(F.col("point").alias("cap"), F.posexplode("values").alias("idx", "v")), "cap")
    cells = rows.groupBy("base", "idx").agg(reducer("v").alias("v")).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("x"))
    got = base.join(cells.select(F.col("base").alias("point"), F.col("x.v").alias("new")), "point", "left")
    return got.withColumn("values", F.coalesce("new", "values")).drop("new")


def on_points(section: DataFrame, reached: DataFrame) -> DataFrame:
    """Slices on a closure or star."""
    return reached.join(section, "point")


def fields_layout(fields: DataFrame) -> DataFrame:
    """(point, seq, field_idx, len, offset) of fields(point, seq, field_idx, len): point-major, field-minor."""
    return exclusive_sum(fields.withColumn("len", F.col("len").cast("long")), "len", ["seq", "field_idx"], "offset")


def advance(coords: DataFrame, velocity: DataFrame, dt: float) -> DataFrame:
    """Coordinates moved by dt times the velocity; points without one keep a null, see missing_velocity."""
    v = velocity.select("point", F.col("xyz").alias("v"))
    return coords.join(v, "point", "left").withColumn("xyz", F.zip_with("xyz", "v", lambda x, y: x + dt * y)).drop("v")


def missing_velocity(coords: DataFrame, velocity: DataFrame) -> DataFrame:
    return coords.join(velocity, "point", "left_anti")


def as_double(section: DataFrame, kind: str) -> DataFrame:
    """A mixed store's section with its scalar type kept as a tag: f64, f32, i32, i64, u32 or u64."""
    cast = {"f64": "double", "f32": "float", "i32": "int", "i64": "bigint", "u32": "bigint", "u64": "decimal(20,0)"}[kind]
    return section.withColumn("values", F.col("values").cast(f"array<{cast}>")).withColumn("scalar", F.lit(kind))
