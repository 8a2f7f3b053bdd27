"""Splitting text the way the jobs' lines are split."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_dropping_tail(text: Column, separator: str) -> Column:
    """Split on one literal character; trailing empty tokens go, inner ones stay.

    An empty line yields one empty token, a line of separators only yields none.
    """
    if len(separator) != 1:
        raise ValueError("separator must be a single character")
    trimmed = F.rtrim(text, F.lit(separator))
    tokens = F.split(trimmed, re.escape(separator))
    only_separators = (trimmed == "") & (text != "")
    return F.when(only_separators, F.array().cast("array<string>")).otherwise(tokens)


def words(text: Column) -> Column:
    """Space-separated words of a line, as an array."""
    return split_dropping_tail(text, " ")
