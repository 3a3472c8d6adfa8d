"""Closed-form eigensystems of symmetric 3 x 3 matrices as columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVARIANCE = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def eigenvalues(df: DataFrame) -> DataFrame:
    """Adds l1 >= l2 >= l3 >= 0 of the covariance columns, by the trigonometric form."""
    df = df.withColumn("__q", F.expr("(cxx + cyy + czz) / 3"))
    df = df.withColumn("__p", F.expr("sqrt((pow(cxx - __q, 2) + pow(cyy - __q, 2) + pow(czz - __q, 2) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6)"))
    det = "((cxx - __q) * ((cyy - __q) * (czz - __q) - cyz * cyz) - cxy * (cxy * (czz - __q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - __q) * cxz))"
    df = df.withColumn("__t", F.expr(f"case when __p > 0 then acos(greatest(-1d, least(1d, {det} / (2 * __p * __p * __p)))) / 3 end"))
    df = df.withColumns({"l1": F.expr("case when __p > 0 then __q + 2 * __p * cos(__t) else __q end"), "l3": F.expr(f"case when __p > 0 then __q + 2 * __p * cos(__t + {2 * math.pi / 3}d) else __q end")})
    df = df.withColumn("l2", F.expr("3 * __q - l1 - l3"))
    return df.withColumns({k: F.greatest(F.col(k), F.lit(0.0)) for k in ("l1", "l2", "l3")}).drop("__q", "__p", "__t")


def vertical_part(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds |v.z| of the unit eigenvector of an eigenvalue column: the cross product of two rows of C - lI, the longest of three."""
    rows = [(f"(cxx - {value})", "cxy", "cxz"), ("cxy", f"(cyy - {value})", "cyz"), ("cxz", "cyz", f"(czz - {value})")]
    df = df.withColumns({f"__{out}_{k}": F.expr(_cross(rows[i], rows[j])) for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)))})
    best = F.greatest(*[F.col(f"__{out}_{k}") for k in range(3)])
    return df.withColumn(out, F.when(best["norm"] > 0, best["z"] / F.sqrt(best["norm"]))).drop(*[f"__{out}_{k}" for k in range(3)])


def _cross(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    x, y, z = f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"
    return f"named_struct('norm', {x} * {x} + {y} * {y} + {z} * {z}, 'z', abs({z}))"
