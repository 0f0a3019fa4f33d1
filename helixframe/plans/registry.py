"""All registered queries and oracles, gathered from the query modules."""

from __future__ import annotations

import importlib

MODULES = [
    "q_structure", "q_motif", "q_align", "q_contacts", "q_prepare", "q_metrics",
    "q_predictions", "q_manifest", "q_audit", "q_sources", "q_store",
]


def gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"helixframe.plans.{name}")
        for key, value in getattr(module, attribute).items():
            if key in out:
                raise ValueError(f"registered twice: {key}")
            out[key] = value
    return out
