"""Batch readers. Schemas are explicit; NaN becomes null on the way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from runledger import schemas
from runledger.functions.derive import nan_to_null
from runledger.functions.text import to_float
from runledger.sources.json_arrays import json_objects

CORRUPT = "_corrupt_record"
# ---- fixed values: texts that stand for a missing value in a prediction table ----------------
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null"]
# ---------------------------------------------------------------------------------------------


def clean_nan(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in doubles}) if doubles else df


def read_runs_csv(spark: SparkSession, path: str, schema: StructType = schemas.RUNS) -> DataFrame:
    """Run table with a header line."""
    return clean_nan(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path))


def read_results_json(spark: SparkSession, path: str, schema: StructType = schemas.RESULTS) -> DataFrame:
    """Files that hold one JSON array of records each, however large: many tasks read a file (`json_objects`)."""
    return clean_nan(json_objects(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*"))


def read_results_enveloped(spark: SparkSession, path: str, schema: StructType = schemas.RESULTS) -> DataFrame:
    """Files that hold a list, an object with a list `results`, or a single record, however large."""
    return clean_nan(json_objects(spark, path, "results").select(F.from_json("value", schema).alias("r")).select("r.*"))


def is_record(value: Column) -> Column:
    """Whether a line is a whole JSON object, by the parser that reads the records: bare NaN, Infinity and -Infinity are numbers."""
    return F.from_json(value, "map<string,string>").isNotNull()


def _parsed(lines: DataFrame, schema: StructType, keep: list[str] = []) -> DataFrame:
    """(r, object, keep...) of lines: the record with the text of a damaged one in CORRUPT, and whether the line is a record.

    A line is parsed once. Only where that reports damage does a second look tell a field of the wrong type from a broken line.
    """
    with_corrupt = StructType([*[f for f in schema.fields if f.name != CORRUPT], StructField(CORRUPT, StringType(), True)])
    record = F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # a lambda's argument is computed once, a column that a filter and a projection both name is not
    judged = F.transform(F.array(F.struct(record.alias("r"), F.col("value").alias("v"))), lambda x: F.struct(
        x["r"].alias("r"), F.when(x["r"][CORRUPT].isNull(), F.startswith(F.ltrim(x["v"]), F.lit("{"))).otherwise(is_record(x["v"])).alias("object")))
    return lines.select(*keep, F.inline(judged))


def json_records(lines: DataFrame, schema: StructType = schemas.RESULTS, keep: list[str] = []) -> DataFrame:
    """Records of the lines (column `value`) that hold a JSON object, with the columns `keep`; other lines are skipped.

    A field of the wrong type is null and its line stays. Which lines count does not depend on the columns that are read later.
    """
    records = _parsed(lines, schema, keep).where("object")
    return clean_nan(records.select(*[F.col(f"r.{f.name}") for f in schema.fields], *keep))


def read_results_jsonl(spark: SparkSession, path: str, schema: StructType = schemas.RESULTS) -> DataFrame:
    """JSON lines; blank and broken lines are skipped, see `json_records`."""
    return json_records(spark.read.text(path), schema)


def jsonl_health(spark: SparkSession, path: str, schema: StructType = schemas.RESULTS) -> DataFrame:
    """How many lines of a JSON-lines folder are read, how many of those lack a field of the wrong type, how many are skipped."""
    lines = _parsed(spark.read.text(path).where(F.trim("value") != ""), schema)
    damaged = F.col("object") & F.col(f"r.{CORRUPT}").isNotNull()
    return lines.agg(F.count_if("object").alias("good"), F.count_if(damaged).alias("damaged"), F.count_if(~F.col("object")).alias("broken"))


def read_predictions_csv(spark: SparkSession, path: str, has_parsed: bool = True) -> DataFrame:
    """Prediction table: text inputs to numbers, `error` "Invalid Input" when one of them is not a number.

    A missing input stays null and is no error. The text of the model is kept as it is.
    `parsed` is the text true/false; without that column a row counts as parsed when b1_pos is present.
    """
    fields = schemas.PREDICTIONS_TEXT.fields
    schema = StructType(fields if has_parsed else [f for f in fields if f.name != "parsed"])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)
    return type_predictions(raw)


def type_predictions(raw: DataFrame) -> DataFrame:
    inputs = ["monitor_window", "initial_power", "final_power"]
    known = [c for c in raw.columns if c not in ("run_id", "full_text")]
    raw = raw.withColumns({c: F.when(~F.trim(c).isin(*MISSING), F.col(c)) for c in known})
    numbers = {c: to_float(F.col(c)) for c in inputs}
    bad = reduce(Column.__or__, [F.col(c).isNotNull() & n.isNull() for c, n in numbers.items()])
    has_flag = "parsed" in raw.columns
    flag = F.lower(F.coalesce(F.col("parsed"), F.lit(""))) == "true" if has_flag else F.col("b1_pos").isNotNull()
    command = {c.name: to_float(F.col(c.name)) for c in schemas.COMMAND_STRUCT.fields}
    parsed = ~bad & flag
    error = F.when(bad, "Invalid Input").when(~parsed, "Parsing Failed")
    return raw.withColumns({**numbers, **command, "parsed": parsed, "error": error})


def union_labeled(tables: dict[str, DataFrame | None], label: str = "model") -> DataFrame:
    """All tables under one another with their label; missing sources are skipped, none at all is an error."""
    present = [df.withColumn(label, F.lit(name)) for name, df in tables.items() if df is not None]
    if not present:
        raise ValueError("no source could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def completeness(df: DataFrame, expected: int) -> DataFrame:
    """Rows found, rows expected, complete or not."""
    counted = df.agg(F.count("*").alias("n"))
    return counted.select("n", F.lit(expected).cast("long").alias("expected"), (F.col("n") >= expected).alias("complete"))


def failed_sims_filter(df: DataFrame, power: str = "final_power") -> DataFrame:
    """Runs without a result do not belong in the run table."""
    return df.where(F.col(power).isNotNull())
