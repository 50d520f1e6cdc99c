"""Readers for session folders: JSONL, nested JSON, single documents, bytes, streams.

A session is a folder; its id is the folder name.  Where sessions are many and small, a file for each costs
far more than its bytes, so with ``packed`` the same readers take the layouts of `sources.writers` that hold many
sessions in a file.  Strict readers fail on a malformed row, lenient ones split it off.  A missing input reads as
an empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spanalign import fixed
from spanalign.functions import instants, sensitive, text as tx
from spanalign.operators.prefix import running

TRANSCRIPT_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("observedAtUnixMs", T.LongType()),
    T.StructField("audioOffsetMs", T.LongType()),
    T.StructField("monotonicOffsetMs", T.LongType()),
    T.StructField("eventId", T.StringType()),
    T.StructField("itemId", T.StringType()),
    T.StructField("text", T.StringType()),
])
UI_EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("app", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("window", T.StructType([T.StructField("title", T.StringType())])),
    T.StructField("selection", T.StructType([
        T.StructField("selectedText", T.StringType()),
        T.StructField("target", T.StructType([T.StructField("value", T.StringType())])),
    ])),
    T.StructField("ax", T.StructType([T.StructField("mode", T.StringType())])),
])
AUDIO_CHUNK_SCHEMA = T.StructType([
    T.StructField(n, T.LongType())
    for n in ("sampleStart", "sampleEnd", "byteStart", "byteEnd", "monotonicOffsetMs")
])
_LINES = "session_id string, seq bigint, value string"


def _session_of(path: Column) -> Column:
    """Name of the folder that holds a file."""
    return F.element_at(F.split(path, "/"), -2)


def read_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(session_id, seq, value): lines of all matching files, numbered within their file.

    Large files are read in splits like any text; a line's number is its place in its split plus the
    lines of the splits before it, so no task holds a file.
    """
    try:
        lines = spark.read.text(pattern)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], _LINES)
        raise
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),  # in order within a split
    )
    numbered = running(placed, ["path"], F.col("split"), ["split", "line"], sums={"before": F.lit(1)})
    return numbered.select(
        _session_of(F.col("path")).alias("session_id"), (F.col("before") + 1).cast("bigint").alias("seq"), "value"
    )


def _packed_line() -> list[Column]:
    """Session and text of a line of `write_packed_lines`."""
    session = F.substring_index("value", "\t", 1)
    return [F.nullif(session, F.lit("")).alias("session_id"), F.expr("substring(value, locate('\t', value) + 1)").alias("value")]


def read_packed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, seq, value) of `write_packed_lines`, numbered within the session in the order of the files."""
    try:
        lines = spark.read.option("lineSep", "\n").text(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], _LINES)
        raise
    placed = lines.select(
        *_packed_line(), F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start")).alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    numbered = running(placed, ["session_id"], F.col("split"), ["split", "line"], sums={"before": F.lit(1)})
    return numbered.select("session_id", (F.col("before") + 1).cast("bigint").alias("seq"), "value")


def _lines_of(spark: SparkSession, root: str, file: str, packed: bool) -> DataFrame:
    return read_packed_lines(spark, root) if packed else read_lines(spark, f"{root}/*/{file}")


def _parsed(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, Column]:
    """Lines with their parsed ``row``, and the test for a line that is no object of the schema."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    is_object = F.col("value").rlike(rf"(?s)\A{tx.WS}*\{{")
    return lines.withColumn("row", row), F.col("row._bad").isNotNull() | ~is_object


def _fields(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select("session_id", "seq", *[f"row.{f.name}" for f in schema.fields])


def parse_rows(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that are JSON objects of the schema, and the others with their number."""
    parsed, bad = _parsed(lines, schema)
    return _fields(parsed.where(~bad), schema), parsed.where(bad).select("session_id", "seq", "value")


def _strict_rows(lines: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Rows of the schema; the job fails with the row number at the first bad line."""
    parsed, bad = _parsed(lines, schema)
    message = F.concat(
        F.lit(f"{what} contains malformed JSONL at row "), F.col("seq").cast("string"),
        F.lit(" of session "), F.col("session_id"),
    )
    checked = F.when(bad, F.raise_error(message).cast(parsed.schema["row"].dataType)).otherwise(
        F.col("row")
    )
    return _fields(parsed.withColumn("row", checked), schema)


def _named_transcript(rows: DataFrame) -> DataFrame:
    return rows.select(
        "session_id", "seq", "kind",
        F.col("observedAtUnixMs").alias("observed_at_unix_ms"),
        F.col("audioOffsetMs").alias("audio_offset_ms"),
        F.col("monotonicOffsetMs").alias("monotonic_offset_ms"),
        F.col("eventId").alias("event_id"), F.col("itemId").alias("item_id"), "text",
    )


def read_transcript_events(
    spark: SparkSession, root: str, file: str = "transcript.timeline.jsonl", packed: bool = False
) -> DataFrame:
    """Transcript rows of all sessions below ``root``; a malformed row fails with its number."""
    lines = _lines_of(spark, root, file, packed)
    return _named_transcript(_strict_rows(lines, TRANSCRIPT_SCHEMA, "transcript artifact"))


def read_transcript_events_lenient(
    spark: SparkSession, root: str, file: str = "transcript.timeline.jsonl"
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined lines)."""
    good, bad = parse_rows(read_lines(spark, f"{root}/*/{file}"), TRANSCRIPT_SCHEMA)
    return _named_transcript(good), bad


def shape_ui_events(rows: DataFrame) -> DataFrame:
    """Nested event rows to the flat, redacted event table."""
    raw = F.col("timestamp")
    status = instants.timestamp_status(raw)
    hint = tx.ui_hint(
        F.col("selection.selectedText"), F.col("selection.target.value"), F.col("ax.mode")
    )
    title = F.col("window.title")
    longest = F.greatest(*[
        F.coalesce(F.octet_length(c), F.lit(0))
        for c in (raw, F.col("kind"), F.col("app.name"), title, F.col("selection.selectedText"))
    ])
    return rows.select(
        "session_id", "seq", F.col("id").alias("event_id"),
        sensitive.safe_field(F.coalesce("kind", F.lit("unknown"))).alias("kind"),
        F.when(status == "valid", raw).alias("ts_raw"),
        instants.parse_utc_ms(raw).alias("unix_ms"), status.alias("ts_status"),
        sensitive.safe_field(F.col("app.name")).alias("app"),
        F.when(title != "", sensitive.safe_field(title)).alias("window"),
        sensitive.safe_field(hint).alias("ui_hint"),
        (longest > fixed.EVENT_TEXT_MAX_BYTES).alias("oversize_text"),
    )


def read_ui_events(spark: SparkSession, root: str, file: str = "events.jsonl", packed: bool = False) -> DataFrame:
    """UI events of all sessions; an empty, malformed or non-object line fails with its number."""
    lines = _lines_of(spark, root, file, packed)
    return shape_ui_events(_strict_rows(lines, UI_EVENT_SCHEMA, "recording event artifact"))


def read_ui_events_lenient(
    spark: SparkSession, root: str, file: str = "events.jsonl"
) -> tuple[DataFrame, DataFrame]:
    good, bad = parse_rows(read_lines(spark, f"{root}/*/{file}"), UI_EVENT_SCHEMA)
    return shape_ui_events(good), bad


def read_capture_stream(spark: SparkSession, folder: str, packed: bool = False) -> DataFrame:
    """Streaming table of raw socket messages, one JSON text per line, with their session."""
    if packed:
        return spark.readStream.option("lineSep", "\n").text(folder).select(*_packed_line())
    return spark.readStream.option("recursiveFileLookup", True).text(folder).select(
        _session_of(F.col("_metadata.file_path")).alias("session_id"), "value"
    )


def read_session_documents(
    spark: SparkSession, root: str, file: str, schema: T.StructType | str, strict: bool = False, packed: bool = False
) -> DataFrame:
    """One JSON document per session; an unreadable one is NULL (or fails when ``strict``)."""
    try:
        if packed:
            texts = spark.read.parquet(root).where(F.col("name") == file).select(
                "session_id", F.col("content").cast("string").alias("value"))
        else:
            texts = spark.read.text(f"{root}/*/{file}", wholetext=True).select(
                _session_of(F.col("_metadata.file_path")).alias("session_id"), "value")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], "session_id string").withColumn(
                "document", F.from_json(F.lit(None).cast("string"), schema)
            )
        raise
    document = F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    readable = F.try_parse_json("value").isNotNull()
    return texts.select(
        "session_id",
        (document if strict else F.when(readable, document)).alias("document"),
    )


def read_artifact_bytes(
    spark: SparkSession, pattern: str, max_bytes: int = fixed.ARTIFACT_MAX_BYTES, packed: bool = False
) -> DataFrame:
    """(session_id, name, path, length, oversize, content); ``oversize`` flags files above the bound."""
    if packed:
        return spark.read.parquet(pattern).select(
            "session_id", "name", F.concat_ws("/", "_metadata.file_path", "session_id", "name").alias("path"),
            F.octet_length("content").cast("bigint").alias("length"),
            (F.octet_length("content") > max_bytes).alias("oversize"), "content",
        )
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(
        _session_of(F.col("path")).alias("session_id"),
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length",
        (F.col("length") > max_bytes).alias("oversize"), "content",
    )


def read_audio_chunks(spark: SparkSession, root: str, file: str = "audio-chunks.jsonl", packed: bool = False) -> DataFrame:
    rows = _strict_rows(_lines_of(spark, root, file, packed), AUDIO_CHUNK_SCHEMA, "audio chunk manifest")
    return rows.select(
        "session_id", F.col("seq").alias("idx"),
        F.col("byteStart").alias("byte_start"), F.col("byteEnd").alias("byte_end"),
        F.col("sampleStart").alias("sample_start"), F.col("sampleEnd").alias("sample_end"),
        F.col("monotonicOffsetMs").alias("monotonic_offset_ms"),
    )


def flatten_metric_report(reports: DataFrame) -> DataFrame:
    """Entries of nested coverage-like reports: (report_id, percent, path, file_percent).

    ``reports``: report_id, document (JSON text with ``data[0].totals`` and ``data[0].files[]``).
    """
    line = "struct<percent:double>"
    schema = (
        f"data array<struct<totals:struct<lines:{line}>,"
        f"files:array<struct<filename:string,summary:struct<lines:{line}>>>>>"
    )
    first = F.element_at(F.from_json("document", schema)["data"], 1)
    return reports.select("report_id", first.alias("d")).select(
        "report_id", F.col("d.totals.lines.percent").alias("total_percent"),
        F.explode("d.files").alias("f"),
    ).select(
        "report_id", "total_percent", F.col("f.filename").alias("path"),
        F.col("f.summary.lines.percent").alias("percent"),
    )
