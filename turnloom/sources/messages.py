"""Transcriber messages, result files and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MESSAGE = "message_type string, text string, words array<struct<type:string, text:string, start:double, end:double>>"


def parse_messages(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``is_final``, ``text``, ``t_start``, ``t_end`` of JSON messages beside the other columns.

    A partial transcript is one row without times; a committed one with time stamps a row for each word of
    type ``word`` that isn't blank (an end that is missing is the start); a plain committed one a row without
    times; messages of other types, and text that is no JSON, give none.
    """
    m = rows.withColumn("__m", F.from_json(raw, _MESSAGE)).withColumn("__t", F.col("__m.message_type"))
    whole = m.where(F.col("__t").isin("partial_transcript", "committed_transcript") & (F.trim("__m.text") != ""))
    others = [c for c in rows.columns if c != raw]
    nothing = F.lit(None).cast("double")
    a = whole.select(*others, (F.col("__t") == "committed_transcript").alias("is_final"), F.col("__m.text").alias("text"), nothing.alias("t_start"), nothing.alias("t_end"))
    words = m.where("__t = 'committed_transcript_with_timestamps'").select(*others, F.explode("__m.words").alias("w")).where("w.type = 'word' and trim(w.text) != ''")
    b = words.select(*others, F.lit(True).alias("is_final"), F.col("w.text").alias("text"), F.col("w.start").alias("t_start"), F.coalesce("w.end", "w.start").alias("t_end"))
    return a.unionByName(b)


def read_results(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Result rows of flat CSV files; metrics that are missing or no number are 0.0."""
    rows = spark.read.csv(path, header=True)
    have = set(rows.columns)
    number = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) if c in have else F.lit(0.0)
    return rows.select(*[c for c in rows.columns if c not in metrics], F.struct(*[number(m).alias(m) for m in metrics]).alias("metrics"))


def read_json_results(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Result rows of JSON files, one object or an array of them each; metrics that are missing or no number are 0.0."""
    rows = spark.read.option("multiLine", True).json(path)
    kinds = dict(rows.dtypes)
    have = set(rows.select("metrics.*").columns) if kinds.get("metrics", "").startswith("struct") else set()
    number = lambda m: F.coalesce(F.expr(f"try_cast(metrics.`{m}` as double)"), F.lit(0.0)) if m in have else F.lit(0.0)
    return rows.select(*[c for c in rows.columns if c != "metrics"], F.struct(*[number(m).alias(m) for m in metrics]).alias("metrics"))


def metric_of_lines(lines: DataFrame, name: str) -> DataFrame:
    """``file_name``, ``line_no``, ``value`` of each run in result files read as lines: the number in the field whose last name is ``name``.

    CSV files (``.csv``) are read by the header in line 1, cells in quotes whole; all others are one JSON
    object a line, in which the field may lie at any depth. Lines read twice count once, headers and lines
    that can't be parsed are no runs. A value that is missing or no number is null.
    """
    once = lines.groupBy("file_name", "line_no").agg(F.max("raw").alias("raw"))
    is_csv = F.col("file_name").endswith(".csv")
    cells = F.transform(
        F.regexp_extract_all(F.concat("raw", F.lit(",")), F.lit('(?:"(?:[^"]|"")*"|[^",]*),'), F.lit(0)),
        lambda c: F.replace(F.regexp_replace(F.regexp_replace(c, ",$", ""), '^"((?s).*)"$', "$1"), F.lit('""'), F.lit('"')),
    )
    table = once.where(is_csv).withColumn("cells", cells)
    headers = table.where("line_no = 1").select(F.col("file_name").alias("__f"), F.col("cells").alias("names"))
    body = table.where("line_no > 1").join(headers, F.col("file_name") == F.col("__f")).where("size(cells) = size(names)")
    at = F.array_position("names", F.lit(name)).cast("int")
    flat = body.select("file_name", "line_no", F.when(at > 0, F.get("cells", at - 1)).alias("value"))
    # Of the fields at any depth the first with that last name, in the order of their paths.
    variant = once.where(~is_csv).withColumn("v", F.try_parse_json("raw")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    top, inner = f"try_variant_get(v, '$.{name}', 'string')", f"try_variant_get(v, '$.metrics.{name}', 'string')"
    deep = variant.select("file_name", "line_no", F.regexp_extract("raw", rf'"{name}"\s*:\s*(?:"([^"]*)"|([-+0-9.eE]+))', 0).alias("found"), F.coalesce(F.expr(inner), F.expr(top)).alias("near"))
    nested = deep.select("file_name", "line_no", F.coalesce("near", F.regexp_extract("found", r':\s*"?([^"]*)"?$', 1)).alias("value"))
    return flat.unionByName(nested).select("file_name", "line_no", F.expr("try_cast(value as double)").alias("value"))


def flatten_results(rows: DataFrame, nested: str = "metrics") -> DataFrame:
    """Nested metrics as columns of their own."""
    return rows.select(*[c for c in rows.columns if c != nested], f"{nested}.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def write_json_array(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """All rows as one JSON array in one file, which replaces the file before: a checkpoint of a report. More than ``most`` rows are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in one document; write JSON lines")
    one = rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def done_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Keys of the rows without error in JSON-lines files; lines that can't be parsed are left out."""
    schema = ", ".join(f"{k} string" for k in keys) + ", error string, _corrupt_record string"
    rows = spark.read.schema(schema).json(path, mode="PERMISSIVE").withColumn("broken", F.col("_corrupt_record").isNotNull())
    return rows.where("error is null and not broken").select(*keys).distinct()
