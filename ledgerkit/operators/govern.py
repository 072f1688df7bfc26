"""Column masks and row filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(col: str, rule: str) -> Column:
    """``email``, ``default`` or ``partial(prefix, text, suffix)``.

    A value too short for prefix and suffix together shows the text only.
    """
    c = F.col(col).cast("string")
    if rule == "email":
        return F.when(c.isNotNull(), F.concat(F.left(c, F.lit(1)), F.lit("XXX@XXXX.com")))
    if rule == "default":
        return F.when(c.isNotNull(), F.lit("XXXX"))
    parts = re.fullmatch(r"partial\((\d+),(.*),(\d+)\)", rule)
    if not parts:
        raise ValueError(f"mask {rule!r}")
    head, text, tail = int(parts[1]), parts[2], int(parts[3])
    shown = F.concat(F.left(c, F.lit(head)), F.lit(text), F.right(c, F.lit(tail)))
    return F.when(F.length(c) >= head + tail, shown).when(c.isNotNull(), F.lit(text))


def mask(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: masked(c, rule) for c, rule in rules.items()})


def rows_for(df: DataFrame, col: str, caller, is_admin: bool = False) -> DataFrame:
    """The caller's own rows; all rows for an administrator. ``caller`` may be a list."""
    if is_admin:
        return df
    own = list(caller) if isinstance(caller, Sequence) and not isinstance(caller, str) else [caller]
    return df.filter(F.col(col).isin(own))
