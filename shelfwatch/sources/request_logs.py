"""JSON request logs to rows and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _field(item: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))


def request_rows(df: DataFrame, col: str = "value") -> DataFrame:
    """`data.inParams[*].(ip, time)` of every JSON text in `col`.

    A payload or `data` that is no object gives no rows, items that are no objects
    are skipped, a missing field is empty, and an `inParams` that is no array stops
    the job, as does broken JSON.
    """
    keep = [c for c in df.columns if c != col]
    data = df.select(*keep, F.try_variant_get(F.parse_json(F.col(col)), "$.data", "variant").alias("_data"))
    params = F.when(_is_object(F.col("_data")), F.try_variant_get("_data", "$.inParams", "variant"))
    listed = data.select(*keep, params.alias("_p"))
    kind = F.schema_of_variant("_p")
    items = F.when(F.col("_p").isNull(), F.lit(None)).when(
        kind.startswith("ARRAY"), F.try_variant_get("_p", "$", "array<variant>")
    )
    bad = F.col("_p").isNotNull() & ~kind.startswith("ARRAY")
    checked = F.when(bad, F.raise_error(F.lit("data.inParams is not an array"))).otherwise(items)
    rows = listed.select(*keep, F.explode(checked.cast("array<variant>")).alias("_i")).filter(_is_object(F.col("_i")))
    return rows.select(*keep, _field(F.col("_i"), "ip").alias("ip"), _field(F.col("_i"), "time").alias("time"))


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text per file."""
    return request_rows(spark.read.text(path, wholetext=True))


def write_request_csv(df: DataFrame, path: str) -> None:
    """Header `ip,time`, UTF-8; the writer ends lines with LF."""
    df.select("ip", "time").write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def extract_to_csv(spark: SparkSession, input_path: str, output_path: str) -> None:
    write_request_csv(read_request_log(spark, input_path), output_path)
