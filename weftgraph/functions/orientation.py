"""Orientation groups as Column expressions: polarity, bit flips, rotations, dihedral elements, permutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flip_compose(a: Column, b: Column) -> Column:
    """Two-element group: forward (false) and reverse (true). Each element is its own inverse."""
    return a != b


def polarity_sign(reverse: Column) -> Column:
    return F.when(reverse, -1).otherwise(1)


def rot_compose(a: Column, b: Column, n: int) -> Column:
    return F.pmod(a + b, F.lit(n))


def rot_inverse(a: Column, n: int) -> Column:
    return F.pmod(-a, F.lit(n))


def dihedral(rot: Column, flip: Column) -> Column:
    return F.struct(rot.cast("int").alias("rot"), flip.cast("boolean").alias("flip"))


def dihedral_compose(a: Column, b: Column, n: int) -> Column:
    """r^i f^s then r^j f^t: a flip turns the rotation after it around."""
    turned = F.when(a["flip"], -b["rot"]).otherwise(b["rot"])
    return dihedral(F.pmod(a["rot"] + turned, F.lit(n)), a["flip"] != b["flip"])


def dihedral_inverse(a: Column, n: int) -> Column:
    return dihedral(F.when(a["flip"], a["rot"]).otherwise(F.pmod(-a["rot"], F.lit(n))), a["flip"])


def perm_compose(a: Column, b: Column) -> Column:
    """(a after b)[i] = a[b[i]]."""
    return F.transform(b, lambda i: F.get(a, i))


def perm_inverse(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (F.array_position(a, i) - 1).cast("int"))


def accumulate(path: Column, identity: Column, compose: Callable[[Column, Column], Column]) -> Column:
    """Left fold of a group's composition along an array of orientations."""
    return F.aggregate(path, identity, compose)


def oriented(values: Column, reverse: Column) -> Column:
    return F.when(reverse, F.reverse(values)).otherwise(values)
