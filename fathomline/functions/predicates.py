"""Conditions that joins of the analyses use, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signatures_fit(site_ret: str, site_params: str, ret: str, params: str) -> Column:
    """A call site may reach a function: as many parameters at most, each of the same class,
    and equal returns unless one is void ("V").  Parameters are arrays of classes, or
    strings with a letter each.  The calling convention is left to the join's key.
    """
    returns = (F.col(site_ret) == F.col(ret)) | (F.col(site_ret) == "V") | (F.col(ret) == "V")
    return returns & F.startswith(F.col(site_params), F.col(params))


def arrays_fit(site: str, own: str) -> Column:
    """``own`` is no longer than ``site`` and equal to its beginning, for arrays of structs."""
    short = F.size(own) <= F.size(site)
    return short & F.forall(F.zip_with(own, F.slice(site, 1, F.size(own)), lambda a, b: a.eqNullSafe(b)), lambda x: x)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs; Euclid's steps for 64 bits are at most 92."""
    pair = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.pmod(p["a"], F.when(p["b"] == 0, 1).otherwise(p["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda p: p["a"])


def locations_alias(off: Column, mod: Column, res: Column, off2: Column, mod2: Column, res2: Column) -> Column:
    """Exact offsets, lanes (residue modulo) or unknown (all null): may they name one cell?"""
    known, known2 = off.isNotNull() | mod.isNotNull(), off2.isNotNull() | mod2.isNotNull()
    return (
        F.when(~known | ~known2, True)
        .when(off.isNotNull() & off2.isNotNull(), off == off2)
        .when(off.isNotNull(), F.pmod(off - res2, mod2) == 0)
        .when(off2.isNotNull(), F.pmod(off2 - res, mod) == 0)
        .otherwise(F.pmod(res - res2, gcd(mod, mod2)) == 0)
    )


def regions_overlap(off, mod, res, width, off2, mod2, res2, width2) -> Column:
    """May byte ranges [location, location + width) meet?  An unknown width or location may.

    With lanes the distance of two beginnings is known modulo m; the ranges meet when
    some distance of that class lies between -width2 and width, both excluded.
    """
    unknown = width.isNull() | width2.isNull() | (off.isNull() & mod.isNull()) | (off2.isNull() & mod2.isNull())
    m = F.when(mod.isNotNull() & mod2.isNotNull(), gcd(mod, mod2)).otherwise(F.coalesce(mod, mod2))
    distance = F.coalesce(off2, res2) - F.coalesce(off, res)
    # least distance above -width2
    least = -width2 + 1 + F.pmod(distance + width2 - 1, m)
    return F.when(unknown, True).when(m.isNull(), (distance < width) & (-distance < width2)).otherwise(least < width)


def add_offsets(a: Column, b: Column) -> Column:
    """The sum, or null (unknown) where one is unknown or 64 bits do not hold it."""
    return F.try_add(a, b)


def is_exported(mode: str, exported: Column, listed: Column) -> Column:
    """Visible to other modules: in a library what its linkage exports, in an executable what a list names."""
    return exported if mode == "library" else F.coalesce(listed, F.lit(False))


def ignored_global(key: Column) -> Column:
    """Globals that no client asks about: string literals and other compiler-made names."""
    bare = F.regexp_replace(key, "^@", "")
    return bare.rlike(r"^(\.str|str\.|__const\.|llvm\.|switch\.table)")
