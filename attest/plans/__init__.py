"""All registered queries; importing the modules fills the registry."""

import importlib

from attest.plans.registry import ORACLES, QUERIES

_MODULES = ["evidence", "assessment", "evaluation", "similarity", "integrity", "drift", "behaviour", "provenance", "ingest", "streams"]


def load() -> tuple[dict, dict]:
    for name in _MODULES:
        importlib.import_module(f"attest.plans.{name}")
    return QUERIES, ORACLES
