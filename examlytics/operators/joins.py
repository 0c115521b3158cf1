"""Equi-joins on derived keys.

A plain ``a.join(b, "k")`` makes Catalyst infer ``k IS NOT NULL`` and push it as
far down as it can, which copies the whole expression that computes ``k`` (for
question numbers: a chain of regexes) into the earliest scan stage. A null-safe
condition states the same match for non-null keys without that inferred
filter, so the key is computed once, where it is projected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` (kept once, from the left) with null-safe equality.

    Meant for keys that are non-null by construction (group keys of rows that
    were already filtered to have one), where null-safe and plain equality give
    the same rows; a post-join ``IS NOT NULL`` filter would itself be pushed
    down and defeat the purpose.
    """
    keys = list(keys)
    ren = {k: f"_rk{i}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(k).alias(a) for k, a in ren.items()], *[c for c in right.columns if c not in ren])
    cond = None
    for k, a in ren.items():
        c = F.col(k).eqNullSafe(F.col(a))
        cond = c if cond is None else cond & c
    return left.join(r, on=cond, how=how).drop(*ren.values())
