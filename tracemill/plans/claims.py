"""The SQL catalog: published tables as views, claims checked against SQL, receipts of views, guarded exports."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.functions import redaction


def register_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """The tables under a folder as temporary views, with the SQL functions that queries over them use."""
    from tracemill.functions import commands

    for name in names or schemas.TABLES:
        spark.read.schema(schemas.schema(name)).parquet(f"{root}/{name}").createOrReplaceTempView(name)
    commands.udfs(spark)
    redaction.register(spark)


def canonical(value: object) -> object:
    """Plain JSON values: whole numbers as integers, sorted keys, nothing that isn't finite."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number that isn't finite")
        return int(value) if value == int(value) else value
    if isinstance(value, dict):
        return {str(k): canonical(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def receipt(df: DataFrame, limit: int = 100_000) -> dict:
    """Rows and digest of a small result in its order; a larger one is an error, as receipts are made on the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: too many for a receipt")
    text = json.dumps([canonical(r.asDict(recursive=True)) for r in rows], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"rows": len(rows), "digest": "sha256:" + hashlib.sha256(text.encode()).hexdigest()}


def run_view(spark: SparkSession, data: dict[str, str], query: str) -> dict:
    """A view specification: each entry of ``data`` becomes a view by its SQL, then the query runs."""
    for name, sql in data.items():
        spark.sql(sql).createOrReplaceTempView(name)
    return receipt(spark.sql(query))


def cell(cells: DataFrame, where: str, value: str, denominator: str | None = None) -> float | None:
    """The sum of certified cells, or its share of a denominator; None, not 0, if no cell matches."""
    chosen = cells.where(F.expr(where))
    total = F.sum(value)
    row = chosen.agg((total / F.sum(denominator) if denominator else total).alias("v")).first()
    return row["v"]


def check_claims(spark: SparkSession, claims: list[dict], report: dict, cells: DataFrame, tolerance: float = 1e-9) -> list[dict]:
    """claims: id, expected and one of cell {where, value, denominator?}, pointer, sql, audit (a number found by hand).

    Returns a row for each claim with what was found and whether it holds; anything that can't be found fails.
    """
    out = []
    for c in claims:
        if "cell" in c:
            found = cell(cells, c["cell"]["where"], c["cell"]["value"], c["cell"].get("denominator"))
        elif "pointer" in c:
            found = pointer(report, c["pointer"])
        elif "sql" in c:
            rows = spark.sql(c["sql"]).limit(2).collect()
            found = rows[0][0] if len(rows) == 1 and len(rows[0]) == 1 else None
        else:
            found = c.get("audit")
        number = isinstance(found, (int, float)) and not isinstance(found, bool)
        holds = number and abs(found - c["expected"]) <= tolerance if isinstance(c["expected"], (int, float)) else found == c["expected"]
        out.append({"id": c["id"], "found": found, "holds": bool(holds)})
    return out


def pointer(doc: object, path: str) -> object:
    """A JSON pointer's value; None if it leads nowhere. Only members count, and only plain array indices."""
    for part in path.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(doc, dict) and part in doc:
            doc = doc[part]
        elif isinstance(doc, list) and (part == "0" or (part.isdigit() and part[0] != "0")) and int(part) < len(doc):
            doc = doc[int(part)]
        else:
            return None
    return doc


#: What each variant of a packet leaves out.
WITHHELD = {
    "internal": {},
    "partner": {"events": ["text", "content_json", "attributes_json"]},
    "restricted": {"events": ["text", "content_json", "attributes_json"], "units": ["command", "target", "error_signature", "embed_text"], "claims": ["text"], "assessments": ["rationale", "alternative_explanation"]},
}


def export(df: DataFrame, name: str, variant: str, path: str) -> list[str]:
    """Writes a table of a packet: withheld columns null, all strings redacted; read back and scanned.

    Fails closed: a secret in what was written is an error. Returns the columns that were withheld.
    """
    spark, gone = df.sparkSession, WITHHELD[variant].get(name, [])
    out = schemas.conform(df, name).withColumns({c: F.lit(None).cast("string") for c in gone})
    redaction.redact_all(out).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
    back = spark.read.parquet(f"{path}/{name}")
    texts = [c for c, t in back.dtypes if t == "string"]
    found = redaction.leaks(back, texts).collect() if texts else []
    if found:
        raise ValueError("secrets in the export: " + ", ".join(f"{r['column']} ({r['leaks']})" for r in found))
    return gone
