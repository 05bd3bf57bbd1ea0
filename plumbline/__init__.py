"""Spark-first statistics for graded evaluations, with corpus operators beside them."""

from __future__ import annotations

import importlib

#: Where each public name lives; imported when first used, so that executors load only what they run.
_PLACES = {
    "operators.agreement": ("cohens_kappa", "fleiss_kappa", "rater_agreement"),
    "operators.audit": ("audit",),
    "operators.compare": ("compare_independent", "compare_paired"),
    "operators.judge": ("judge_validation",),
    "operators.length": ("length_bias",),
    "operators.pairwise": ("bradley_terry", "to_elo"),
    "operators.position": ("position_bias",),
    "operators.power": ("detectable_effect", "min_sample_size"),
    "operators.scores": ("score_ci",),
    "results": ("AgreementResult", "AuditConfig", "AuditReport", "BTResult", "ComparisonResult", "Finding", "JudgeValidation", "KappaResult", "LengthBias", "PositionBias", "PowerResult", "ScoreCI", "SkippedCheck"),
}
_NAMES = {name: place for place, names in _PLACES.items() for name in names}
__all__ = sorted(_NAMES)


def __getattr__(name: str):  # noqa: ANN202
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f".{_NAMES[name]}", __name__), name)
