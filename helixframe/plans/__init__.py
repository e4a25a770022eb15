"""Registered queries: each pairs a Spark plan with the equivalent SQL."""

from importlib import import_module

from .base import ORACLES, QUERIES

MODULES = ["codons", "residues", "chem", "pairs", "msa", "variants", "structures",
           "spatial", "templates", "tracks", "evaluation", "files", "streams"]


def load():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
