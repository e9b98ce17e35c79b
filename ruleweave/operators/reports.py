"""Reports over scan results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_rule(scan: DataFrame) -> DataFrame:
    """Rows scanned and matched per rule."""
    return scan.groupBy("rule_idx", "rule_name").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("matched").alias("matches"))


def by_tag(scan: DataFrame) -> DataFrame:
    """Matches per tag and rule, with subtotals per tag and a total (null marks)."""
    return scan.where("matched").select(F.explode("tags").alias("tag"), "rule_name").rollup("tag", "rule_name").agg(F.count(F.lit(1)).alias("matches"))
