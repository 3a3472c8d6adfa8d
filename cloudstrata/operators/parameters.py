"""Checked parameters of operators."""

from __future__ import annotations

import math

#: Fixed limits: points of a region, its area, points that may be clustered at once, and nodes of a cloth and of a regrouping.
MOST_REGION_POINTS, MOST_REGION_AREA, MOST_ELIGIBLE, MOST_NODES, MOST_VOXELS = 250_000, 250_000.0, 50_000, 500_000, 80_000
#: Allowed values of parameters: least, greatest, and whether they are whole numbers.
LIMITS = {
    "eps": (0.0, math.inf, False), "min_samples": (1, MOST_ELIGIBLE, True), "min_cluster_points": (1, MOST_ELIGIBLE, True), "max_candidates": (1, 30, True), "cell": (0.0, math.inf, False), "tolerance": (0.0, math.inf, False),
    "resolution": (0.0, math.inf, False), "threshold": (0.0, math.inf, False), "rigidness": (1, 3, True), "iterations": (1, 2000, True), "time_step": (0.0, math.inf, False), "padding": (0.0, math.inf, False),
    "chunk_points": (1, math.inf, True), "target_points": (1, math.inf, True),
}
#: Parameters that may be zero.
MAY_BE_ZERO = frozenset(["tolerance", "threshold", "padding"])
#: The parameters of both ground splits, which are given by these names exactly.
BASELINE, CLOTH = frozenset(["cell", "tolerance"]), frozenset(["resolution", "threshold", "rigidness", "time_step", "iterations", "smooth"])


def checked_parameters(**values: float) -> dict[str, float]:
    """The values, if each is finite, within its limits and whole where it has to be (a truth value is no number); ValueError otherwise."""
    for name, v in values.items():
        if name == "smooth":
            if not isinstance(v, bool):
                raise ValueError("smooth is true or false")
            continue
        if name not in LIMITS:
            raise ValueError(f"unknown parameter {name}")
        least, most, whole = LIMITS[name]
        if isinstance(v, bool) or not isinstance(v, int if whole else (int, float)) or not math.isfinite(v):
            raise ValueError(f"{name} has to be a {'whole' if whole else 'finite'} number")
        if v < least or v > most or v == 0 and name not in MAY_BE_ZERO:
            raise ValueError(f"{name} is out of its range")
    return values


def checked_experiment(baseline: dict, cloth: dict) -> tuple[dict, dict]:
    """The parameters of both ground splits, if they are all there, no others, and each in its range; ValueError otherwise."""
    for kind, given, names in (("baseline", baseline, BASELINE), ("cloth", cloth, CLOTH)):
        if set(given) != names:
            raise ValueError(f"{kind} takes {', '.join(sorted(names))}")
        checked_parameters(**given)
    return baseline, cloth
