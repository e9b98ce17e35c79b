"""Rules from SQL: a table function for single texts, and views of scanned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .engine import RuleSet, compile_str
from .evaluate import scan_text


def register_table_function(spark: SparkSession, rules: str, name: str = "rule_scan") -> None:
    """SELECT * FROM rule_scan('text'), or with LATERAL per row: rule_name and matched of every rule, in
    order. `rules` is source text; string patterns run everywhere, other tiers with the default backends."""

    class RuleScan:
        def __init__(self) -> None:
            self.rules = compile_str(rules)

        def eval(self, text: str):
            for m in scan_text(self.rules, text or ""):
                yield m.rule_name, m.matched

    compile_str(rules)  # errors show on the driver
    spark.udtf.register(name, udtf(RuleScan, returnType="rule_name: string, matched: boolean"))


def create_scan_view(df: DataFrame, rules: RuleSet, name: str, text: str = "text", **options) -> None:
    """A temporary view of the scan of df."""
    rules.scan(df, text, **options).createOrReplaceTempView(name)
