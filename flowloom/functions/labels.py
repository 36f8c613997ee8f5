"""Names, orders and formats of solvers and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The solvers' names in reports.
PRETTY = {
    "electrical": "Electrical Flow",
    "electrical_parallel": "Electrical Flow (parallel)",
    "raecke_frt": "Räcke-FRT",
    "raecke_ckr": "Räcke–Fast-CKR",
    "raecke_mst": "Räcke–MST",
    "cohen": "LP (Applegate–Cohen)",
    "lp": "LP (Applegate–Cohen)",
    "random_mst": "Räcke–MST",
    "mst": "Räcke–MST",
    "frt": "Räcke-FRT",
    "ckr": "Räcke-Fast-CKR",
    "frt_mendel": "Räcke-FRT (Mendel)",
    "ckr_mendel": "Räcke-Fast-CKR (Mendel)",
    "raecke_frt_mendel": "Räcke-FRT (Mendel)",
    "raecke_ckr_mendel": "Räcke–Fast-CKR (Mendel)",
    "raecke_random_mst": "Räcke–MST",
}
#: Part of a name, part of a longer form, its place with the longer form and without.
PLACES = (("electrical", "parallel", 1, 0), ("ckr", "mendel", 3, 2), ("frt", "mendel", 5, 4), ("mst|random", "", 6, 6), ("cohen|lp|applegate", "", 99, 99))
OTHERS = 90


def pretty(name: Column) -> Column:
    """The report's name; names with parentheses and unknown ones stay."""
    table = F.create_map(*[F.lit(x) for pair in PRETTY.items() for x in pair])
    return F.when(name.contains("(") & name.contains(")"), name).otherwise(F.coalesce(table[name], name))


def order(name: Column) -> Column:
    """The place of a solver in reports."""
    low = F.lower(name)
    short = F.trim(F.split_part(low, F.lit("("), F.lit(1)))
    out = F.lit(OTHERS)
    for part, more, longer, plain in reversed(PLACES):
        out = F.when(short.rlike(part), F.when(low.contains(more), longer).otherwise(plain)).otherwise(out)
    return out.cast("int")


def stem(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def base(name: Column) -> Column:
    """The name without a run's number at its end."""
    return F.regexp_replace(name, r"_\d+$", "")


def negative_power(base_: Column, exponent: Column) -> Column:
    """1 / base ** exponent; an error for base 0 and exponents below 0."""
    bad = (base_ == 0) | (exponent < 0)
    return F.when(bad, F.raise_error(F.lit("base 0 or exponent below 0"))).otherwise(1 / F.pow(base_, exponent))
