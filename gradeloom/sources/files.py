"""Sources and sinks: JSON Lines with explicit schemas, summaries, configuration files."""

from __future__ import annotations

import ast
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: First line of a file that holds only a pointer to large-file storage.
POINTER = "version https://git-lfs.github.com/spec/"

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
#: The fact table of generations; task payloads (parsed, gold, meta) are JSON text.
RECORD = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("gen_idx", T.IntegerType()),
        T.StructField("prompt", T.ArrayType(MESSAGE)),
        T.StructField("generation", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("is_pass", T.BooleanType()),
        T.StructField("parsed", T.StringType()),
        T.StructField("gold", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("meta", T.StringType()),
    ]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON Lines file or folder, gzip too; a missing path is an empty table; a pointer file or a bad line raises.

    The schema is given, never inferred, so ids such as 00123 stay text.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    try:
        head = spark.read.text(path).where(F.trim("value") != "").limit(3).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    if head and head[0].value.startswith(POINTER):
        raise RuntimeError(f"{path} is a pointer, not data ({'; '.join(r.value for r in head[1:])}); fetch the file first")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_json(value: Mapping[str, Any], path: str) -> None:
    """One object, indented; for summaries at the edge of a run, written by the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def coerce_records(raw: DataFrame) -> DataFrame:
    """The record envelope with defaults: score 0, is_pass false, meta an empty object; rows without a key are left out; other columns stay."""
    meta = F.col("meta")
    return raw.withColumns(
        {"score": F.coalesce("score", F.lit(0.0)), "is_pass": F.coalesce("is_pass", F.lit(False)), "meta": F.when(meta.startswith("{"), meta).otherwise(F.lit("{}"))}
    ).where(F.col("sample_id").isNotNull() & F.col("gen_idx").isNotNull())


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Earlier records with load_seq, a place that grows in the order of files and rows."""
    raw = read_jsonl(spark, path, RECORD)
    place = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    seq = place if raw.inputFiles() else F.lit(None).cast("struct<time:timestamp,file:string,block:bigint,row:bigint>")
    return coerce_records(raw.withColumn("load_seq", seq))


def read_yaml(path: str) -> dict[str, Any]:
    """A mapping; anything else raises."""
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(value, dict):
        raise ValueError(f"{path}: the root must be a mapping")
    return value


def parse_pairs(pairs: list[str]) -> dict[str, Any]:
    """``key=value`` texts; true/false/none words, Python literals, else text."""
    words = {"true": True, "false": False, "none": None, "null": None}
    out: dict[str, Any] = {}
    for pair in pairs:
        key, sign, raw = pair.partition("=")
        if not sign or not key.strip():
            raise ValueError(f"expected key=value: {pair!r}")
        low = raw.strip().lower()
        if low in words:
            out[key.strip()] = words[low]
            continue
        try:
            out[key.strip()] = ast.literal_eval(raw.strip())
        except (ValueError, SyntaxError):
            out[key.strip()] = raw.strip()
    return out
