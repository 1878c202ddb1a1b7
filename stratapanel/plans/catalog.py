"""Importing this module registers every query."""

from __future__ import annotations

from stratapanel.plans import q_core, q_evidence, q_events, q_groups, q_influence, q_bars, q_quality, q_signals, q_streaming  # noqa: F401
from stratapanel.plans.registry import ORACLES, QUERIES  # noqa: F401
