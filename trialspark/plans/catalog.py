"""All queries over the reference's operators, gathered from their modules."""

from __future__ import annotations

from trialspark.plans import grading, pipelines, selection, summaries, texts
from trialspark.plans.summaries import arm_comparison_report

MODULES = (summaries, selection, grading, texts, pipelines)
QUERIES = {k: f for m in MODULES for k, f in m.Q.items()}
ORACLE = {k: v for m in MODULES for k, v in m.O.items()}
__all__ = ["ORACLE", "QUERIES", "arm_comparison_report"]
