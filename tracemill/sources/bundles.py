"""Run bundles as tables: manifests, JSONL with line locators, telemetry, verified files, published tables."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tracemill import schemas
from tracemill.functions.text import csv_safe, digest, parsed_json
from tracemill.operators.sets import verify_manifest
from tracemill.sources.shipping import ship


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, digest and size of every file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.col("length").alias("size"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """manifest_path and text of every manifest.json."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(root)
    return found.select(F.col("path").alias("manifest_path"), F.col("content").cast("string").alias("text"))


#: Columns of the index and where a run's manifest has them.
PATHS = {
    "bundle_id": "$.bundleId",
    "run_id": "$.run.id",
    "attempt_id": "$.attempt.id",
    "attempt_number": "$.attempt.number",
    "assessment_mode": "$.run.assessmentMode",
    "task_id": "$.run.task.id",
    "fixture_id": "$.run.fixture.id",
    "fixture_digest": "$.run.fixture.digest",
    "trial_id": "$.run.trial.id",
    "model_provider": "$.run.model.provider",
    "model_id": "$.run.model.id",
    "harness_id": "$.run.harness.id",
    "harness_version": "$.run.harness.version",
    "configuration_digest": "$.configuration.digest",
    "terminal_state": "$.terminal.state",
    "failure_class": "$.terminal.failureClass",
    "stop_reason": "$.terminal.stopReason",
    "workspace_artifact_id": "$.terminal.workspaceArtifactId",
    "legacy_qualification": "$.qualification.status",
    "structural_qualification": "$.qualification.structural.status",
}
REQUIRED = ("run_id", "attempt_id", "terminal_state")


def corpus_index(found: DataFrame) -> DataFrame:
    """A row for each manifest. One that doesn't parse, or lacks a field, is a row with issues and no failure.

    The structural qualification supersedes the legacy one; without either it is "unavailable".
    """
    doc = parsed_json(F.col("text"))
    rows = found.select("manifest_path", digest(F.col("text")).alias("manifest_digest"), doc.alias("doc"))
    rows = rows.select("manifest_path", "manifest_digest", "doc", *(F.try_variant_get("doc", p, "bigint" if c == "attempt_number" else "string").alias(c) for c, p in PATHS.items()))
    evidence = F.try_variant_get("doc", "$.evidence", "array<struct<id: string, kind: string, source: string, mediaType: string, digest: string, status: string, workspaceArtifactId: string>>")
    rows = rows.withColumn("evidence", F.coalesce(evidence, F.array()))
    verifiers = F.filter("evidence", lambda e: (e["kind"] == "verifier") & (e["workspaceArtifactId"].isNull() | e["workspaceArtifactId"].eqNullSafe(F.col("workspace_artifact_id"))))
    statuses = F.array_sort(F.array_compact(F.transform(verifiers, lambda e: e["status"])))
    missing = [F.when(F.col("doc").isNotNull() & F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("message"))) for c in REQUIRED]
    broken = F.when(F.col("doc").isNull(), F.struct(F.lit("manifest").alias("field"), F.lit("not valid JSON").alias("message")))
    return rows.select(
        "manifest_path",
        "manifest_digest",
        *(c for c in PATHS if not c.endswith("_qualification")),
        F.coalesce("structural_qualification", "legacy_qualification", F.lit("unavailable")).alias("capture_qualification"),
        statuses.alias("verifier_statuses"),
        F.array_sort(F.transform("evidence", lambda e: e["id"])).alias("evidence_ids"),
        F.array_compact(F.array(broken, *missing)).alias("issues"),
    )


def write_index(index: DataFrame, path: str) -> None:
    """An index as JSON lines in canonical form: keys sorted, nulls left out, an existing one is an error."""
    index.select(F.to_json(F.struct(*sorted(index.columns))).alias("value")).write.mode("errorifexists").text(path)


def read_index(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored index; a line that isn't JSON, or repeats a key, is a row of nulls with its text in ``broken``."""
    lines = spark.read.text(path)
    whole = parsed_json(F.col("value")).isNotNull()
    rows = lines.select(F.when(whole, F.from_json("value", schema)).alias("r"), F.when(~whole, F.col("value")).alias("broken"))
    return rows.select(*(F.col("r")[c].alias(c) for c in schema.names), "broken")


def telemetry_receipts(documents: DataFrame, text: str) -> DataFrame:
    """Adds receipt (canonical JSON, null if there is none) and receipt_status, "absent" without one."""
    doc = parsed_json(F.col(text))
    receipt = F.try_variant_get(doc, "$.telemetry.receipt", "variant")
    record = F.schema_of_variant(receipt).startswith("OBJECT")
    status = F.try_variant_get(doc, "$.telemetry.receipt.status", "string")
    return documents.withColumns({"receipt": F.when(record, F.to_json(receipt)), "receipt_status": F.when(record, status).otherwise("absent")})


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """path, locator (line:N) and text of the lines of JSONL files that hold something. Files are read in splits: a
    line's number is its place in its split and the lines of the splits before it, of which there are few rows."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value"
    )
    splits = lines.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("path", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = lines.join(splits, ["path", "split"]).withColumn("n", F.col("before") + F.col("id") - F.col("first") + 1)
    text = F.regexp_replace("value", "\r$", "")
    return numbered.where(F.trim(text) != "").select("path", F.concat(F.lit("line:"), F.col("n").cast("string")).alias("locator"), text.alias("text"))


def envelope_breaches(lines: DataFrame) -> DataFrame:
    """Lines that aren't JSON, or whose sequence isn't their line number."""
    sequence = F.try_variant_get(parsed_json(F.col("text")), "$.sequence", "bigint")
    line = F.regexp_extract("locator", "line:(\\d+)", 1).cast("long")
    problem = F.when(parsed_json(F.col("text")).isNull(), "not-json").when(sequence.isNotNull() & (sequence != line), "sequence-differs")
    return lines.select("path", "locator", problem.alias("problem")).where("problem IS NOT NULL")


def verify(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """listed: path, digest, size of a bundle's manifest against the files that are there."""
    return verify_manifest(files(spark, root), listed)


def write_table(df: DataFrame, name: str, path: str) -> None:
    """One published table; an empty one keeps its schema. An existing table is an error, so none is half replaced."""
    schemas.conform(df, name).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in which no text cell begins a formula."""
    df.select(*(csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes)).write.option("header", True).option("escape", '"').csv(path)


def chrome_trace(tracks: DataFrame, by: str, name: str) -> DataFrame:
    """Calls with tracks (start, end in seconds) as one trace event in JSON each."""
    event = F.struct(F.col(name).cast("string").alias("name"), F.lit("X").alias("ph"), (F.col("start") * 1e6).cast("long").alias("ts"), ((F.col("end") - F.col("start")) * 1e6).cast("long").alias("dur"), F.col(by).alias("pid"), F.col("track").alias("tid"))
    return tracks.select(F.to_json(event).alias("value"))


# Telemetry in protocol buffers. The wire format names no fields: numbers are kept as they are.


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out, shift = 0, 0
    while True:
        byte = data[at]
        out, at, shift = out | (byte & 0x7F) << shift, at + 1, shift + 7
        if not byte & 0x80:
            return out & 0xFFFFFFFFFFFFFFFF, at
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def wire_fields(data: bytes) -> list[tuple[int, int, object]]:
    """(field, wire type, value) of a message: numbers for types 0, 1 and 5, bytes for type 2."""
    out, at, end = [], 0, len(data)
    while at < end:
        tag = data[at]
        at += 1
        if tag > 127:
            tag, at = _varint(data, at - 1)
        kind = tag & 7
        if kind == 2:
            n = data[at]
            at += 1
            if n > 127:
                n, at = _varint(data, at - 1)
            value, at = data[at : at + n], at + n
        elif kind == 1 or kind == 5:
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + n], "little"), at + n
        elif kind == 0:
            value, at = _varint(data, at)
        else:
            raise ValueError(f"wire type {kind}")
        if at > end:
            raise ValueError("a field is cut off")
        out.append((tag >> 3, kind, value))
    return out


def _any(data: bytes) -> object:
    """An attribute's value: the union of string, bool, int, double, array, map and bytes."""
    out: object = None
    for field, _, v in wire_fields(data):
        if field == 1:
            out = {"stringValue": v.decode("utf-8", "replace")}
        elif field == 2:
            out = {"boolValue": bool(v)}
        elif field == 3:
            out = {"intValue": str(v - (1 << 64) if v >> 63 else v)}  # 64-bit numbers are strings in JSON
        elif field == 4:
            out = {"doubleValue": struct.unpack("<d", v.to_bytes(8, "little"))[0]}
        elif field == 5:
            out = {"arrayValue": {"values": [_any(x) for _, _, x in wire_fields(v)]}}
        elif field == 6:
            out = {"kvlistValue": {"values": [_attribute(x) for _, _, x in wire_fields(v)]}}
        elif field == 7:
            out = {"bytesValue": v.hex()}
    return out


def _attribute(data: bytes) -> dict:
    parts = {f: v for f, _, v in wire_fields(data)}
    return {"key": parts.get(1, b"").decode("utf-8", "replace"), "value": _any(parts.get(2, b""))}


def _log_record(data: bytes) -> dict:
    out: dict = {"attributes": []}
    for field, kind, v in wire_fields(data):
        if field in (1, 11):
            out["timeUnixNano" if field == 1 else "observedTimeUnixNano"] = str(v)
        elif field == 2:
            out["severityNumber"] = v
        elif field == 3:
            out["severityText"] = v.decode("utf-8", "replace")
        elif field == 5:
            out["body"] = _any(v)
        elif field == 6:
            out["attributes"].append(_attribute(v))
        elif field in (9, 10):
            out["traceId" if field == 9 else "spanId"] = v.hex()
        else:
            out.setdefault("unknownFields", []).append({"field": field, "wireType": kind, "value": v.hex() if isinstance(v, bytes) else str(v)})
    return out


def otlp_logs(data: bytes | None) -> str | None:
    """An export request of logs as JSON, unknown fields kept; null for bytes that don't parse."""
    if data is None:
        return None
    try:
        out = []
        for _, _, resource in (f for f in wire_fields(data) if f[0] == 1):
            parts = wire_fields(resource)
            attributes = [_attribute(a) for f, _, r in parts if f == 1 for g, _, a in wire_fields(r) if g == 1]
            scopes = [{"logRecords": [_log_record(r) for f, _, r in wire_fields(s) if f == 2]} for g, _, s in parts if g == 2]
            out.append({"resource": {"attributes": attributes}, "scopeLogs": scopes})
        return json.dumps({"resourceLogs": out}, sort_keys=True, separators=(",", ":"))
    except (ValueError, IndexError, AttributeError, TypeError):
        return None


def decode_otlp(df: DataFrame, column: str, name: str) -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: otlp_logs(None if b is None else bytes(b)), na_action=None)

    return df.withColumn(name, run(column))
