"""Checks of arguments, made before any plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from spendlens.schema import METRICS


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {', '.join(METRICS)}")
    return metric


def check_metric_pair(metrics: Sequence[str]) -> list[str]:
    """Exactly two different metrics of the catalog."""
    if len(metrics) != 2:
        raise ValueError("choose exactly two metrics to compare")
    if metrics[0] == metrics[1]:
        raise ValueError("the two metrics must differ")
    return [check_metric(m) for m in metrics]


def check_weights(*weights: int) -> None:
    """Weights are whole percents, none negative, that total 100."""
    if any(w != int(w) or w < 0 for w in weights):
        raise ValueError(f"weights must be whole percents of 0 or more, not {weights}")
    if sum(weights) != 100:
        raise ValueError(f"weights must total 100, not {sum(weights)}")


def check_choice(value: str, choices: Sequence[str], what: str) -> str:
    if value not in choices:
        raise ValueError(f"{what} must be one of {', '.join(choices)}, not {value!r}")
    return value


def check_slice(low: int, high: int) -> None:
    if low < 1 or high < low:
        raise ValueError(f"rank range {low}..{high} is empty or starts before 1")
