"""All checks on what an evaluation has to show, ranked by how much they weaken its conclusion."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checks import finite_counts, is_binary, need_choice, need_scores
from ..results import CHECKS, SEVERITIES, AuditConfig, AuditReport, Finding, SkippedCheck, known, listed, points
from .agreement import LEVELS, rater_agreement
from .compare import compare_independent, compare_paired, paired
from .judge import judge_validation
from .length import length_bias
from .position import position_bias
from .power import detectable_effect
from .scores import score_ci

TITLES = {
    "compare": "Headline margin",
    "power": "What the evaluation could have detected",
    "agreement": "Agreement between raters",
    "judge": "Judge against humans",
    "position": "Position bias",
    "length": "Length bias",
    "scores": "Score intervals",
}


def checked(config: AuditConfig | Mapping | None) -> AuditConfig:
    if config is None:
        config = AuditConfig()
    if isinstance(config, Mapping):
        names = [f.name for f in dataclasses.fields(AuditConfig)]
        if extra := sorted(set(config) - set(names)):
            raise ValueError(f"the config has no field(s) {', '.join(extra)}; it has {', '.join(names)}")
        config = AuditConfig(**config)
    if not isinstance(config, AuditConfig):
        raise ValueError(f"config must be an AuditConfig or a mapping, not {type(config).__name__}")
    for name in ("confidence", "power", "alpha"):
        if not 0 < getattr(config, name) < 1:
            raise ValueError(f"{name} must lie strictly between 0 and 1, not {getattr(config, name)}")
    need_choice("level", config.level, LEVELS)
    if config.effect_of_interest is not None and not config.effect_of_interest > 0:
        raise ValueError("effect_of_interest must be positive: it is the difference that the decision turns on")
    if config.n_boot < 0:
        raise ValueError(f"n_boot must not be negative, not {config.n_boot}")
    return config


class _Systems:
    """Scores (system, item_id, score) split by system, in the order given or by name."""

    def __init__(self, scores: DataFrame | None, order: list[str] | None):
        self.frames: dict[str, DataFrame] = {}
        self.sizes: dict[str, int] = {}
        if scores is None:
            return
        scores = scores if "system" in scores.columns else scores.withColumn("system", F.lit("system"))
        rows, odd, first = finite_counts(scores, ["score"])
        found = scores.groupBy("system").agg(rows.alias("n"), odd.alias("odd"), first.alias("first"), F.avg("score").alias("mean"), is_binary(F.col("score").cast("double")).alias("binary")).collect()
        need_scores(sum(r.n for r in found), sum(r.odd for r in found), min((r.first for r in found if r.odd and r.first is not None), default=None), "scores")
        stats = {r.system: r for r in found}
        names = order or sorted(n for n in stats if n is not None)
        self.frames = {n: scores.where(F.col("system") == n) for n in names}
        self.sizes = {n: stats[n].n for n in names}
        self.means, self.binary = {n: stats[n]["mean"] for n in names}, all(stats[n].binary for n in names)


def _text(lead: str, result: object, action: str) -> str:
    return " ".join(x for x in (lead, result.summary(), action) if x)


def _scores(systems: _Systems, cfg: AuditConfig) -> list[Finding] | str:
    if not systems.frames:
        return "No scores were given."
    out = []
    for name, frame in systems.frames.items():
        result = score_ci(frame, confidence=cfg.confidence, seed=cfg.seed)
        out.append(Finding("scores", "info", f"Score of {name}", _text(f"The headline number of {name}.", result, "Give the interval wherever the number appears."), result))
    return out


def _comparison(systems: _Systems, cfg: AuditConfig):  # noqa: ANN202
    if len(systems.frames) != 2:
        return None
    (_, a), (_, b) = systems.frames.items()
    sizes = list(systems.sizes.values())
    same = sizes[0] == sizes[1] if cfg.paired is None else cfg.paired
    if same and sizes[0] != sizes[1]:
        raise ValueError(f"a paired comparison needs as many items on either side, not {sizes[0]} and {sizes[1]}")
    if same:
        pairs = paired(a, b).persist()
        try:
            return compare_paired(pairs, confidence=cfg.confidence, seed=cfg.seed)
        finally:
            pairs.unpersist()
    return compare_independent(a, b, confidence=cfg.confidence, seed=cfg.seed)


def _compare(margin, systems: _Systems, cfg: AuditConfig) -> Finding | str:  # noqa: ANN001
    if margin is None:
        n = len(systems.frames)
        return "No scores were given." if not n else "Scores of one system leave no margin to test." if n == 1 else f"There are {n} systems; a margin is between two."
    lead = f"The margin of {' over '.join(systems.frames)}."
    hint = " Equal numbers of items were read as the same items; set paired=False if they were not." if cfg.paired is None and margin.paired else ""
    if margin.crosses_zero:
        if cfg.claims_direction:
            return Finding("compare", "critical", "The margin does not exclude zero", _text(lead, margin, "Claim no direction; run more items or call it unresolved." + hint), margin)
        return Finding("compare", "warning", "The margin does not exclude zero", _text(lead, margin, "No direction is claimed, so this weakens the result without undoing it." + hint), margin)
    return Finding("compare", "info", "The margin excludes zero", _text(lead, margin, "Report the interval; its end nearer zero is the least margin that the data support." + hint), margin)


def _power(margin, systems: _Systems, cfg: AuditConfig) -> Finding | str:  # noqa: ANN001
    effect, sizes = cfg.effect_of_interest, list(systems.sizes.values())
    if effect is None and margin is None:
        return "Neither an effect of interest nor two systems to compare were given."
    if not sizes:
        return "No scores were given, so there is no size to judge."
    if margin is None and len(sizes) > 2:
        return f"There are {len(sizes)} systems; say which two the claim is about."
    same = margin.paired if margin is not None else cfg.paired is not False
    n = margin.n if margin is not None else sizes[0]
    if not systems.binary:
        return "Power here is for pass rates, and these scores are not 0/1."
    if margin is not None and not same and sizes[0] != sizes[1]:
        return f"Power here assumes groups of one size, and these have {sizes[0]} and {sizes[1]} items."
    if n < 2:
        return "One item has no power to speak of."
    rate = cfg.discordance_rate
    if margin is not None and same:
        rate = margin.n_discordant / margin.n
        if not rate:
            return "The systems agree on every item, so a paired test has nothing to work on."
    mean = list(systems.means.values())[-1]
    result = detectable_effect(n, baseline=mean if 0 < mean < 1 else 0.5, power=cfg.power, alpha=cfg.alpha, paired=same, discordance_rate=rate if same else None)
    if effect is None:
        return Finding("power", "warning", "No effect of interest was stated, so only the reach is known", _text("", result, "Set effect_of_interest to the difference that the decision turns on."), result)
    lead = f"The effect of interest is {points(effect)}."
    if margin is not None and not margin.crosses_zero:
        return Finding("power", "info", "The margin is established; more items would only narrow it", _text(lead, result, "Half the width takes about four times the items."), result)
    if result.attainable and result.difference <= effect:
        return Finding("power", "info", "The evaluation was large enough for the effect of interest", _text(lead, result, "A null result is informative at this size."), result)
    if margin is not None and -effect < margin.ci_low and margin.ci_high < effect:
        return Finding("power", "info", "The margin's interval rules the effect of interest out", _text(lead, result, "Power is about the design; the interval has answered the question."), result)
    side = ""
    if margin is not None:
        open_to = [f"{name} ahead by {points(effect)}" for name, possible in zip(systems.frames, (margin.ci_high >= effect, margin.ci_low <= -effect), strict=True) if possible]
        side = f" The interval leaves open {listed(open_to)}." if open_to else ""
    return Finding("power", "critical", f"The evaluation had under {100 * cfg.power:g}% power for the effect of interest", _text(lead, result, f"Not finding it says little.{side} Size the next run by the figures above."), result)


def _against_line(check: str, result, low: float, high: float, threshold: float, subject: str) -> Finding:  # noqa: ANN001
    if known(high) and high < threshold:
        return Finding(check, "warning", f"{subject} falls short of {threshold:.3f}", _text(f"The line here is {threshold:.3f}.", result, "Mend this before relying on the scores."), result)
    if known(low) and low > threshold:
        return Finding(check, "info", f"{subject} clears {threshold:.3f}", _text(f"The line here is {threshold:.3f}.", result, "Keep measuring it each round."), result)
    return Finding(check, "warning", f"The data cannot show that {subject.lower()} clears {threshold:.3f}", _text(f"The line here is {threshold:.3f}.", result, "That does not mean that it falls short; more doubly labelled items narrow the interval."), result)


def _agreement(ratings: DataFrame | None, cfg: AuditConfig) -> Finding | str:
    if ratings is None:
        return "No ratings were given; they have item_id, rater_id and rating."
    result = rater_agreement(ratings, cfg.level, cfg.confidence, cfg.n_boot > 0, cfg.n_boot, cfg.seed)
    if not result.n_overlapping_items:
        return Finding("agreement", "critical", "Agreement was never measurable", _text("The scores rest on these ratings.", result, "Have some items rated twice, blind, before acting on the rest."), result)
    if not known(result.alpha):
        return Finding("agreement", "warning", "Agreement is undefined", _text("", result, "Use the scale, or have more items rated twice."), result)
    return _against_line("agreement", result, result.ci_low, result.ci_high, cfg.agreement_threshold, "Agreement between raters")


def _judge(labels: DataFrame | None, cfg: AuditConfig) -> Finding | str:
    if labels is None:
        return "No judge labels were given; they have human and judge, and slice if there is one."
    result = judge_validation(labels, cfg.level, cfg.confidence, cfg.n_boot, cfg.seed)
    if (name := result.distinguishable_slice) is not None:
        return Finding("judge", "critical", f"The judge fails on slice {name}", _text("The judge stands in for humans on every slice.", result, "No ranking that leans on this slice is supported; have humans label it or leave it out."), result)
    if not known(result.agreement):
        return Finding("judge", "warning", "Judge agreement is undefined", _text("", result, "Label items on which the judge and humans use more than one label."), result)
    return _against_line("judge", result, result.ci_low, result.ci_high, cfg.judge_threshold, "The judge's agreement with humans")


def _position(comparisons: DataFrame | None, order: str | None) -> Finding | str:
    if comparisons is None:
        return "No comparisons were given; they have pair_id, option_a, option_b and winner."
    result = position_bias(comparisons, order=order)
    if not result.n_decisive and not result.n_pairs_scored:
        return Finding("position", "warning", "No comparison could be scored for position", _text("", result, "Judge some pairs in both orders."), result)
    if result.has_effect:
        return Finding("position", "warning", "The place shown moves the verdict", _text("", result, "Judge each pair in both orders and keep what holds."), result)
    return Finding("position", "info", "No effect of place could be shown", _text("", result, ""), result)


def _length(rows: DataFrame | None) -> Finding | str:
    if rows is None:
        return "No preferences with lengths were given; they have preference, len_a and len_b."
    result = length_bias(rows)
    by_humans = result.has_human and known(result.disagreement_ci_low)
    low, high, slope = (result.disagreement_ci_low, result.disagreement_ci_high, result.disagreement_coefficient) if by_humans else (result.ci_low, result.ci_high, result.coefficient)
    if not (known(low) and (low > 0 or high < 0)):
        return Finding("length", "info", "No effect of length could be shown", _text("", result, "That has not cleared the judge."), result)
    lead = f"The judge leans to {'longer' if slope > 0 else 'shorter'} options" + (" where it departs from humans." if by_humans else ".")
    if by_humans and known(result.coefficient) and (result.ci_low > 0 or result.ci_high < 0) and (result.coefficient > 0) != (slope > 0):
        lead += f" Over all choices it picks {'longer' if result.coefficient > 0 else 'shorter'} options more often; the verdict goes by its departures."
    return Finding("length", "warning", f"The judge is drawn to {'longer' if slope > 0 else 'shorter'} options", _text(lead, result, "See whether the winner is only the longer or shorter one."), result)


def audit(scores: DataFrame | None = None, comparisons: DataFrame | None = None, ratings: DataFrame | None = None, labels: DataFrame | None = None, preferences: DataFrame | None = None, config: AuditConfig | Mapping | None = None, systems: list[str] | None = None, order: str | None = None) -> AuditReport:
    """scores (system, item_id, score); comparisons as position_bias; ratings as rater_agreement; labels as judge_validation; preferences as length_bias.

    systems: their order, by name otherwise. order: the column that says which comparison came first.
    """
    if all(x is None for x in (scores, comparisons, ratings, labels, preferences)):
        raise ValueError("an audit needs scores, comparisons, ratings, labels or preferences")
    cfg = checked(config)
    given = [x for x in (scores, comparisons, ratings, labels, preferences) if x is not None and not x.is_cached]
    for x in given:  # each is read once, whatever the number of checks
        x.persist()
    try:
        return _audited(scores, comparisons, ratings, labels, preferences, cfg, systems, order)
    finally:
        for x in given:
            x.unpersist()


def _audited(scores: DataFrame | None, comparisons: DataFrame | None, ratings: DataFrame | None, labels: DataFrame | None, preferences: DataFrame | None, cfg: AuditConfig, systems: list[str] | None, order: str | None) -> AuditReport:
    split = _Systems(scores, systems)
    margin = _comparison(split, cfg)
    made = {"compare": _compare(margin, split, cfg), "power": _power(margin, split, cfg), "agreement": _agreement(ratings, cfg), "judge": _judge(labels, cfg), "position": _position(comparisons, order), "length": _length(preferences), "scores": _scores(split, cfg)}
    findings, skipped = [], []
    for check in CHECKS:
        got = made[check]
        if isinstance(got, str):
            skipped.append(SkippedCheck(check, TITLES[check], got))
        else:
            findings += got if isinstance(got, list) else [got]
    findings.sort(key=lambda f: SEVERITIES.index(f.severity))  # stable: by check within a severity
    return AuditReport(tuple(findings), tuple(skipped), cfg)
