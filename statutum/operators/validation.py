"""Constraints of the tables as queries: which rows break which rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RULES


def violations(rows: DataFrame, table: str, key: str, rules: dict[str, str] | None = None) -> DataFrame:
    """``table_name, rule, key`` for each row and rule it breaks; a rule that is null for a row holds, as CHECKs do. One scan."""
    rules = RULES[table] if rules is None else rules
    broken = F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(name)) for name, sql in rules.items()])
    found = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))
    return found.select(F.lit(table).alias("table_name"), "rule", "key")


def duplicates(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Keys that more than one row has: ``table_name, key, n``."""
    some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return rows.where(some).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(table).alias("table_name"), F.concat_ws("|", *columns).alias("key"), "n")
