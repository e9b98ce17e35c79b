"""Where rules and contents come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileReadError, RuleFileNotFound


def read_rules(path: str, spark: SparkSession | None = None) -> str:
    """The text of a rule file, from the driver's disk or, with a session, through Spark."""
    if spark is not None:
        try:
            return spark.read.text(path, wholetext=True).collect()[0][0]  # one rule file
        except Exception as e:
            raise (RuleFileNotFound if "PATH_NOT_FOUND" in str(e) else FileReadError)(f"{path}: {str(e)[:200]}") from None
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        raise RuleFileNotFound(path) from None
    except (OSError, UnicodeDecodeError) as e:
        raise FileReadError(f"{path}: {e}") from None


def content_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files as rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def transcripts(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One text per conversation: "role: text" lines in order. A conversation is the unit of a scan."""
    line = F.struct(F.col(order).alias("o"), F.concat(F.col(role), F.lit(": "), F.col(text)).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    return turns.groupBy(key).agg(F.array_join(lines, "\n").alias("text"))
