"""Answers of a judge, read strictly: every way in which one departs from the agreed form, or cites what its packet doesn't
hold, is a row. All in expressions over JSON values; citations meet their packets in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill import schemas
from tracemill.functions.text import parsed_json

# fixed values: the agreed form of an answer
FIELDS = ("disposition", "assessment", "confidence", "reason", "missingEvidenceCapability", "rationale", "alternativeExplanation", "citations", "claims")
ASSESSMENTS = ("constructive", "adverse", "mixed", "context-dependent")
MISSING = (*(f"family:{f}" for f in schemas.FAMILIES), "evidence:nativeOrder", "evidence:nativeTime", "evidence:parentage", "evidence:content")
SCALE = "evaluator-reported-0-to-1"
TEXT, MAX_CLAIMS = 8192, 64


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0)


def _null(v: Column) -> Column:
    return v.isNotNull() & F.is_variant_null(v)


def _has_only(v: Column, names: tuple[str, ...]) -> Column:
    keys = F.json_object_keys(F.to_json(v))
    return (_kind(v) == "OBJECT") & F.coalesce(F.array_sort(keys) == F.array_sort(F.array(*map(F.lit, names))), F.lit(False))


def _text(v: Column, most: int) -> Column:
    s = F.try_variant_get(v, "$", "string")
    return (_kind(v) == "STRING") & (F.trim(s) != "") & (F.length(s) <= most)


def _faults(checks: list[tuple[str | Column, Column, str]]) -> Column:
    """checks: place, condition that must hold, problem. The ones that don't, as an array."""
    found = [F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit(place).alias("place") if isinstance(place, str) else place.alias("place"), F.lit(problem).alias("problem"))) for place, good, problem in checks]
    return F.array_compact(F.array(*found))


def answer_breaches(answers: DataFrame, packet: DataFrame, max_citations: int = 32) -> DataFrame:
    """answers: answer_id, doc. packet: answer_id, event_id of every event that an answer may cite. Returns answer_id, place,
    problem. An answer that isn't JSON, or isn't one judgment, has that breach alone; a sound one has no row."""
    rows = answers.withColumn("v", parsed_json(F.col("doc"))).withColumn("r", _at(F.col("v"), "$.judgment"))
    whole = _has_only(F.col("v"), ("judgment",)) & _has_only(F.col("r"), FIELDS)
    no_form = rows.where(~F.coalesce(whole, F.lit(False))).select("answer_id", F.lit("answer").alias("place"), F.when(F.col("v").isNull(), "not-json").otherwise("fields-differ").alias("problem"))
    rows = rows.where(whole)
    r = lambda path, kind="variant": _at(F.col("r"), path, kind)
    assessed, abstained = r("$.disposition", "string") == "assessed", r("$.disposition", "string") == "abstained"
    value, missing = r("$.confidence.value", "double"), r("$.missingEvidenceCapability", "string")
    sized = lambda path, most: (_kind(r(path)) == "ARRAY") & (F.size(r(path, "array<variant>")) <= most)
    number = _kind(r("$.confidence.value")).isin("BIGINT", "DOUBLE", "DECIMAL")
    checks = [
        ("disposition", assessed | abstained, "unknown"),
        ("reason", F.when(assessed, _null(r("$.reason"))).otherwise(~abstained | _text(r("$.reason"), TEXT)), "doesn't fit the disposition"),
        ("missingEvidenceCapability", F.when(assessed, _null(r("$.missingEvidenceCapability"))).otherwise(~abstained | _null(r("$.missingEvidenceCapability")) | missing.isin(*MISSING)), "doesn't fit the disposition"),
        ("assessment", F.when(assessed, r("$.assessment", "string").isin(*ASSESSMENTS)).otherwise(~abstained | _null(r("$.assessment"))), "doesn't fit the disposition"),
        ("confidence", F.when(assessed, _has_only(r("$.confidence"), ("value", "scale")) & number & value.between(0, 1) & (r("$.confidence.scale", "string") == SCALE)).otherwise(~abstained | _null(r("$.confidence"))), "doesn't fit the disposition"),
        ("rationale", _text(r("$.rationale"), TEXT), "no text of that length"),
        ("alternativeExplanation", _text(r("$.alternativeExplanation"), TEXT), "no text of that length"),
        ("citations", sized("$.citations", max_citations), "no list of that length"),
        ("claims", sized("$.claims", MAX_CLAIMS) & (~assessed | (F.size(r("$.claims", "array<variant>")) > 0)), "no list of that length"),
    ]
    of_answers = rows.select("answer_id", F.explode(_faults(checks)).alias("f")).select("answer_id", "f.*")

    claims = rows.select("answer_id", F.posexplode(r("$.claims", "array<variant>")).alias("n", "c"))
    place = F.concat(F.lit("claims["), F.col("n").cast("string"), F.lit("]"))
    c = lambda path, kind="variant": _at(F.col("c"), path, kind)
    cited = c("$.citations", "array<variant>")
    of_claims = [
        (place, _has_only(F.col("c"), ("id", "text", "citations", "workspace")), "fields-differ"),
        (place, _text(c("$.id"), 256) & _text(c("$.text"), TEXT), "no text of that length"),
        (place, _null(c("$.workspace")) | _text(c("$.workspace"), 4096), "workspace is no text"),
        (place, cited.isNotNull() & (F.size(cited) > 0) & (F.size(cited) <= max_citations), "no list of that length"),
    ]
    claimed = claims.select("answer_id", F.explode(_faults(of_claims)).alias("f")).select("answer_id", "f.*")

    lists = rows.select("answer_id", F.lit("citations").alias("list"), r("$.citations", "array<variant>").alias("xs")).unionByName(claims.select("answer_id", F.concat(place, F.lit(".citations")).alias("list"), cited.alias("xs")))
    cites = lists.select("answer_id", "list", F.posexplode("xs").alias("n", "x"))
    x = lambda path, kind="variant": _at(F.col("x"), path, kind)
    form = _has_only(F.col("x"), ("eventId", "nativeReference")) & _text(x("$.eventId"), 256) & _has_only(x("$.nativeReference"), ("artifactId", "recordLocator")) & _text(x("$.nativeReference.artifactId"), 1024) & _text(x("$.nativeReference.recordLocator"), 1024)
    event = x("$.eventId", "string")
    cites = cites.select("answer_id", "list", "n", F.coalesce(form, F.lit(False)).alias("form"), event.alias("event_id"))
    cites = cites.withColumn("again", F.row_number().over(W.partitionBy("answer_id", "list", "event_id").orderBy("n")) > 1)
    known = packet.select("answer_id", "event_id").distinct().withColumn("packed", F.lit(True))
    cites = cites.join(known, ["answer_id", "event_id"], "left")
    where = F.concat("list", F.lit("["), F.col("n").cast("string"), F.lit("]"))
    of_cites = [(where, F.col("form"), "fields-differ"), (where, ~F.col("form") | F.col("packed"), "outside of the packet"), (where, ~F.col("form") | ~F.col("again"), "cited more than once")]
    cited_faults = cites.select("answer_id", F.explode(_faults(of_cites)).alias("f")).select("answer_id", "f.*")
    return no_form.unionByName(of_answers).unionByName(claimed).unionByName(cited_faults)
