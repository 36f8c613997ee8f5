"""The short names by which solvers, demand models and graph formats are asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each solver's name and the tokens that stand for it, besides its name.
SOLVERS = {
    "electrical_naive": "elec_naive ef_naive 0",
    "electrical": "electrical_sketching elec_sketching ef_sketching e_sketching 1",
    "raecke_frt": "frt f 2 raecke_frt_pointer frt_pointer 9",
    "raecke_ckr": "ckr c 3 raecke_ckr_pointer ckr_pointer 10",
    "raecke_mst": "random_mst rmst mst 4 raecke_mst_pointer random_mst_pointer rmst_pointer mst_pointer 11",
    "cohen": "lp applegate ac l 5",
    "electrical_parallel": "elec_par e_par 6",
    "raecke_frt_mendel": "frt_mendel 7 raecke_frt_mendel_pointer frt_mendel_pointer 12",
    "raecke_ckr_mendel": "ckr_mendel 8 raecke_ckr_mendel_pointer ckr_mendel_pointer",
}
#: The demand models' names and tokens.
DEMANDS = {"gravity": "gravity_model", "bimodal": "bimodal_model", "gaussian": "gaussian_model", "uniform": "uniform_model"}
#: The graph formats' names and tokens.
FORMATS = {"csr": "", "adjlist": "list"}


def named(token: Column, names: dict[str, str]) -> Column:
    """The name that a token in any case stands for; null for others."""
    pairs = [(t, name) for name, more in names.items() for t in (name, *more.split())]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])[F.lower(token)]


def all_named(tokens: Column, names: dict[str, str]) -> Column:
    """The names of a list of tokens between commas; null if one of them is unknown."""
    found = F.transform(F.split(tokens, ","), lambda t: named(t, names))
    return F.when(~F.exists(found, lambda x: x.isNull()), found)


def required(tokens: Column, names: dict[str, str]) -> Column:
    """As all_named, but an unknown token is an error that says which list it is in."""
    found = all_named(tokens, names)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unsupported: "), tokens))).otherwise(found)
