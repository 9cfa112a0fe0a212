"""Canonical JSON: one text for equal content, whatever the order of keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def _texts(text: pd.Series) -> pd.Series:
    return text.map(_canonical, na_action="ignore")


def canonical(text: Column) -> Column:
    """Keys sorted at every level, arrays as they are, no spaces; null where the text is no JSON. Nested keys have no built-in order."""
    return F.pandas_udf(_texts, "string")(text)
