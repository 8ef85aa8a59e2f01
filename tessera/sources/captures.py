"""Bundles that test runners write, as tables of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "struct<namespace:array<string>,name:string,mode:string,state:string,error_class:string,retry_count:bigint,repeat_count:bigint,flaky:boolean>"
MODULES = f"runner struct<id:string,version:string>, runtime struct<id:string,version:string>, completed_run struct<modules:array<struct<relative_module_id:string,state:string,errors:array<string>,cases:array<{CASE}>>>>"
CALLBACKS = "runner struct<id:string,version:string>, runtime struct<id:string,version:string>, result_callbacks array<string>, probe struct<parent_tests_run:bigint,successful:boolean,observations:array<struct<kind:string,case:array<string>,parent:array<string>,ordinal:bigint,outcome:string,error_class:string>>>"
COLUMNS = ["runner", "file", "identity", "status", "error_class", "retry_count", "repeat_count", "flaky"]

STATES = {"passed": "passed", "failed": "assertion_failed", "skipped": "skipped", "todo": "todo", "pending": "pending"}
OUTCOMES = {"success": "passed", "failure": "assertion_failed", "error": "errored", "skipped": "skipped", "expected_failure": "expected_failed", "unexpected_success": "unexpected_successful"}


def _named(values: dict[str, str], column: str):
    out = F.lit("errored")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def module_cases(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Cases of bundles that list modules, as a JavaScript reporter writes them: one a file,
    or one a line, which files of many bundles can be split by."""
    m = spark.read.schema(MODULES).json(path, multiLine=not by_line).select("runner", F.explode("completed_run.modules").alias("m"))
    c = m.select(F.col("runner.id").alias("runner"), F.col("m.relative_module_id").alias("file"), F.explode("m.cases").alias("c")).select("runner", "file", "c.*")
    return c.withColumn("identity", F.concat_ws("::", "namespace", "name")).withColumn("status", _named(STATES, "state")).select(COLUMNS)


def callback_cases(spark: SparkSession, path: str) -> DataFrame:
    """Parent cases of bundles that list result callbacks, as a Python runner writes them."""
    o = spark.read.schema(CALLBACKS).json(path, multiLine=True).select(F.col("runner.id").alias("runner"), F.explode("probe.observations").alias("o")).filter("o.parent IS NULL AND o.outcome IS NOT NULL")
    c = o.select("runner", F.lit(None).cast("string").alias("file"), F.concat_ws("::", "o.case").alias("identity"), F.col("o.outcome").alias("outcome"), F.col("o.error_class").alias("error_class"), F.lit(0).cast("bigint").alias("retry_count"), F.lit(0).cast("bigint").alias("repeat_count"), F.lit(False).alias("flaky"))
    return c.withColumn("status", _named(OUTCOMES, "outcome")).select(COLUMNS)
