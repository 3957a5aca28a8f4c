"""Import every query family so that ``REGISTRY`` is complete."""

from __future__ import annotations

import importlib

from statloom.plans.catalog import REGISTRY

_FAMILIES = ["q_describe", "q_profile", "q_stats", "q_prepare", "q_timeseries", "q_hypothesis", "q_text_io", "q_multivariate",
             "q_models"]

for _m in _FAMILIES:
    importlib.import_module(f"statloom.plans.{_m}")

__all__ = ["REGISTRY"]
