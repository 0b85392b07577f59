"""Matching configuration: defaults, overrides from dicts or JSON files, deep merge."""

from __future__ import annotations

import copy
import json
from pathlib import Path

# Defaults of the matching pipeline.
DEFAULTS: dict = {
    "scoring": {"date": 0.30, "geo": 0.25, "title": 0.30, "description": 0.15},
    "thresholds": {"high": 0.75, "low": 0.35, "title_veto": 0.45},
    "geo": {"max_distance_km": 10.0, "min_confidence": 0.85, "neutral_score": 0.5, "venue_match_distance_km": 1.0, "venue_mismatch_factor": 0.5},
    "date": {"time_tolerance_minutes": 30, "time_close_minutes": 90, "close_factor": 0.1, "far_factor": 0.0, "time_gap_penalty_hours": 2.0, "time_gap_penalty_factor": 0.0},
    "title": {"primary_weight": 0.7, "secondary_weight": 0.3, "blend_lower": 0.40, "blend_upper": 0.80, "cross_source_type": None},
    "cluster": {"max_cluster_size": 15, "min_internal_similarity": 0.40, "max_distinct_dates": 3},
    "ai": {"confidence_threshold": 0.6},
    "category_weights": {"priority": [], "overrides": {}},
}
# What a deployment sets on top.
DEPLOYED: dict = {
    "title": {"cross_source_type": {"primary_weight": 0.4, "secondary_weight": 0.6, "blend_lower": 0.25, "blend_upper": 0.95}},
    "category_weights": {
        "priority": ["fasnacht", "versammlung"],
        "overrides": {
            "fasnacht": {"date": 0.30, "geo": 0.30, "title": 0.25, "description": 0.15},
            "versammlung": {"date": 0.25, "geo": 0.20, "title": 0.40, "description": 0.15},
        },
    },
}


def merged(base: dict, changes: dict) -> dict:
    """``base`` with the leaves of ``changes`` written over it; neither is altered."""
    out = copy.deepcopy(base)
    for key, value in changes.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load_config(path: str | None = None, changes: dict | None = None) -> dict:
    """Defaults, then a JSON file if given, then explicit changes; unknown sections are an error."""
    config = copy.deepcopy(DEFAULTS)
    if path:
        config = merged(config, json.loads(Path(path).read_text(encoding="utf-8")))
    config = merged(config, changes or {})
    unknown = set(config) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown configuration sections: {sorted(unknown)}")
    return config
