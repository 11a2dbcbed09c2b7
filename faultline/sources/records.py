"""Case records and predictions on disk: JSON lines with a closed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "case_id string, system string, diagnosis struct<failure_type:string,root_cause:string,confidence:double,affected_files:array<string>>, error string, latency_ms double, tool_calls int, llm_calls int"

REJECTIONS = "case_id string, repo string, run_id bigint, reason string, details string, mined_at string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of exactly this schema; blank lines are skipped, a field that it doesn't name is an error.

    Spark ignores unknown fields, so the names of each line are compared with the schema's in the same pass.
    """
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    lines = spark.read.text(path).where(F.trim("value") != "")
    unknown = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, fields)))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ",")))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, PREDICTIONS)


def read_reports(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """path and the fields of each JSON report that the pattern finds, one report a file, whatever its line ends."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).select(F.col("_metadata.file_path").alias("path"), "*")


def runs(raw: DataFrame) -> DataFrame:
    """Run records with missing names as empty texts and a first attempt where none is told; raw: the service's fields."""
    text = lambda c, to: F.coalesce(F.col(c), F.lit("")).alias(to)
    attempt = F.when(F.coalesce("run_attempt", F.lit(0)) == 0, 1).otherwise(F.col("run_attempt"))
    return raw.select(F.col("id").alias("run_id"), "workflow_id", text("name", "workflow_name"), text("path", "workflow_path"), "event", text("head_repository.full_name", "head_repo"), text("head_branch", "head_branch"), "head_sha", "conclusion", "created_at", attempt.alias("run_attempt"), text("html_url", "html_url"))


def write_outcomes(cases: DataFrame, accepted: str, rejected: str) -> None:
    """Appends cases without a reason to one folder of JSON lines, those with one to the other."""
    cases.where("reason is null").drop("reason").write.mode("append").json(accepted)
    cases.where("reason is not null").write.mode("append").json(rejected)


def funnel(cases: DataFrame) -> DataFrame:
    """report: one JSON text of how many cases were seen, accepted, and rejected for each reason."""
    counted = cases.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
    held = counted.agg(F.sum("n").alias("seen"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    return held.select(F.to_json(F.struct("seen", "outcomes")).alias("report"))
