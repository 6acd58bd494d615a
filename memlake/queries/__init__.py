"""Registered queries, one module per family. Importing a module registers its queries."""

from importlib import import_module

from memlake import registry

FAMILIES = ["text", "failures", "packs", "retrieval", "evals", "sessions", "governance", "sources", "streams"]


def load():
    for family in FAMILIES:
        import_module(f"memlake.queries.{family}")
    return registry
