"""Contracts of persisted records: exact shapes with a schema id and version, compiled to VARIANT column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.records import COUNTERS, SUMS

# Of each type: what a value is in Python, and how its VARIANT type begins.
_TYPES = {
    "string": (str, ["STRING"]), "number": ((int, float), ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]), "integer": (int, ["BIGINT"]), "boolean": (bool, ["BOOLEAN"]), "object": (dict, ["OBJECT"]), "array": (list, ["ARRAY"]),
    "strings": (list, ["ARRAY"]), "texts": (dict, ["OBJECT"]), "any": (object, [""]),
}


def _split(kind: str) -> tuple[str, bool, bool]:
    """(type, may be null, may be missing)."""
    plain = kind.rstrip("?~")
    return plain, "?" in kind[len(plain) :] or plain == "any", "~" in kind[len(plain) :]


@dataclass(frozen=True)
class Contract:
    """Fields by name, each a type of _TYPES; ``?`` at its end allows null, ``~`` that it is missing.

    ``strings`` is an array of strings, ``texts`` an object whose values are strings, ``any`` anything.
    """

    schema_id: str
    version: int
    fields: dict[str, str] = field(hash=False)

    def faults(self, value: object) -> list[str]:
        """What is wrong with one value on the driver (see ``checked`` for columns)."""
        if not isinstance(value, dict):
            return ["not an object"]
        out = []
        if value.get("schemaId") != self.schema_id or value.get("schemaVersion") != self.version or isinstance(value.get("schemaVersion"), bool):
            out.append("wrong schema")
        names = {"schemaId", "schemaVersion", *self.fields}
        needed = {k for k in names if k not in self.fields or not _split(self.fields[k])[2]}
        out += [f"missing {k}" for k in sorted(needed - set(value))] + [f"unknown {k}" for k in sorted(set(value) - names)]
        for k, kind in self.fields.items():
            plain, null, _ = _split(kind)
            v = value.get(k)
            if k not in value or plain == "any" or (v is None and null):
                continue
            inner = v if plain == "strings" else list(v.values()) if plain == "texts" and isinstance(v, dict) else []
            if not isinstance(v, _TYPES[plain][0]) or isinstance(v, bool) != (plain == "boolean") or not all(isinstance(x, str) for x in inner):
                out.append(f"wrong type of {k}")
        return out

    def json_schema(self) -> dict:
        """The contract as JSON Schema, draft 2020-12."""

        def one(kind: str) -> dict:
            plain, null, _ = _split(kind)
            if plain == "any":
                return {}
            name = {"strings": "array", "texts": "object"}.get(plain, plain)
            more = {"items": {"type": "string"}} if plain == "strings" else {"additionalProperties": {"type": "string"}} if plain == "texts" else {}
            return {"type": [name, "null"] if null else name} | more

        shape = {"schemaId": {"const": self.schema_id}, "schemaVersion": {"const": self.version}} | {k: one(t) for k, t in self.fields.items()}
        required = [k for k in shape if k not in self.fields or not _split(self.fields[k])[2]]
        return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": f"{self.schema_id}.v{self.version}", "type": "object", "additionalProperties": False, "required": required, "properties": shape}


def lookup(contracts: Iterable[Contract]) -> dict[str, Contract]:
    out: dict[str, Contract] = {}
    for c in contracts:
        if c.schema_id in out:
            raise ValueError(f"two contracts of {c.schema_id}")
        out[c.schema_id] = c
    return out


def _compiled(contract: Contract, values: Column) -> Column:
    """Faults of an object (a map of VARIANT) against one contract."""
    kind = lambda k: F.schema_of_variant(values[k])
    has = lambda k: F.map_contains_key(values, F.lit(k))
    text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    version = F.try_variant_get(values["schemaVersion"], "$", "bigint")
    wrong = ~F.coalesce((F.try_variant_get(values["schemaId"], "$", "string") == contract.schema_id) & (version == contract.version) & (kind("schemaVersion") == "BIGINT"), F.lit(False))
    out = [F.when(wrong, F.lit("wrong schema"))]
    out += [F.when(~has(k), F.lit(f"missing {k}")) for k in ("schemaId", "schemaVersion", *contract.fields) if k not in contract.fields or not _split(contract.fields[k])[2]]
    for k, spec in contract.fields.items():
        plain, null, _ = _split(spec)
        if plain == "any":
            continue
        good = F.lit(False)
        for begin in [*_TYPES[plain][1], *(["VOID"] if null else [])]:
            good = good | kind(k).startswith(begin)
        if plain in ("strings", "texts"):
            inner = F.try_variant_get(values[k], "$", "array<variant>") if plain == "strings" else F.map_values(F.try_variant_get(values[k], "$", "map<string,variant>"))
            good = good & ((kind(k) == "VOID") | F.forall(inner, text))
        out.append(F.when(has(k) & ~F.coalesce(good, F.lit(False)), F.lit(f"wrong type of {k}")))
    names = F.array(*(F.lit(k) for k in ("schemaId", "schemaVersion", *contract.fields)))
    unknown = F.transform(F.array_except(F.map_keys(values), names), lambda k: F.concat(F.lit("unknown "), k))
    return F.array_sort(F.concat(F.array_compact(F.array(*out)), unknown))


def checked(records: DataFrame, column: str, contracts: Iterable[Contract]) -> DataFrame:
    """Adds faults (sorted, empty if none) of JSON records, each against the contract its schemaId names.

    Everything is a column expression: a text is parsed once to a VARIANT and its fields are
    looked at there.  JSON in which a key repeats is not JSON here.
    """
    parsed = records.withColumn("_v", F.try_parse_json(F.col(column))).withColumn("_m", F.try_variant_get("_v", "$", "map<string,variant>"))
    schema = F.try_variant_get(F.col("_m")["schemaId"], "$", "string")
    faults = F.when(F.col("_v").isNull(), F.array(F.lit("not JSON")))
    for c in lookup(contracts).values():
        faults = faults.when(schema == c.schema_id, _compiled(c, F.col("_m")))
    return parsed.withColumn("faults", faults.otherwise(F.array(F.lit("unknown schema")))).drop("_v", "_m")


# The fields of persisted records by kind and type; the counters of stats follow from the counters of runs.
_SHAPES = {
    "request": "id uniqueKey rawUrl resolvedUrl normalizedUrl source seedUrl method renderPolicy createdAt updatedAt: string; depth sitemapIndexDepth priority retryCount maxRetries: number; headers: texts; userData: object; sitemapAncestors: strings; referrerUrl seedLabel: string?",
    "request-state": "runId requestId uniqueKey state updatedAt: string; reason: string?",
    "discovery": "runId uniqueKey rawUrl source seedUrl createdAt: string; depth: number; firstSeen: boolean; decision: object; requestId resolvedUrl normalizedUrl referrerUrl seedLabel: string?",
    "resource": "runId requestId requestedUrl normalizedUrl resourceType cacheStatus fetchedAt: string; responseTimeMs: number; ok: boolean; scopeDecision robotsDecision networkSafetyDecision: object; redirects warnings: array; finalUrl contentType remoteAddress httpProtocol: string?; statusCode contentLength wireBytesRead httpDecodedBytesRead fileDecodedBytesRead: number?; networkTimings tls encoding bodyHash error: object?",
    "html-page": "runId requestId resourceId requestedUrl finalUrl normalizedUrl discoveredBy htmlSource extractedAt: string; depth discoveredOutgoingLinkCount recordedOutgoingLinkCount truncatedOutgoingLinkCount inScopeOutgoingLinkCount outOfScopeOutgoingLinkCount: number; facts: object; discoveredFrom: string?; evidence: object?",
    "xml-resource": "runId requestId resourceId requestedUrl finalUrl normalizedUrl xmlKind extractedAt: string; parseStatus parserBudgets: object; namespaces sitemapEntries feedEntries warnings parserDiagnostics: array; rootName: string?; encoding evidence: object?",
    "link": "id runId fromUrl toRaw source linkKind discoveredAt: string; depth: number; nofollow sponsored ugc: boolean; enqueueDecision evidence: object; rel: array; toResolved toNormalized toFinalUrl anchorText target: string?",
    "skipped": "runId rawUrl reason createdAt: string; resolvedUrl normalizedUrl referrerUrl policyName detail: string?",
    "error": "code message createdAt: string; retryable fatal: boolean; url requestId causeName causeMessage: string?; attempt: number?",
    "robots": "runId origin requestedUrl source fetchedAt expiresAt: string; groups rules: number; sitemaps: array; finalUrl fallbackMode error: string?; statusCode: number?",
    "sitemap-entry": "runId sitemapUrl entryKind discoveredAt: string; warnings: array; rawLoc resolvedUrl normalizedUrl lastmod changefreq: string?; priority: number?",
    "feed-entry": "runId feedUrl discoveredAt: string; rawUrl resolvedUrl normalizedUrl title publishedAt updatedAt: string?",
    "manifest": "runId crawlerVersion configFingerprint operationalConfigFingerprint startedAt status: string; rawSnapshotsEnabled sensitive: boolean; stats runtime deliveryGuarantees: object; seeds: array; htmlParserVersion xmlParserVersion finishedAt stopReason outputDirectory resumedFrom: string?; stopDetail fatalError: object?",
    "stats": "runId startedAt: string; durationMs seeds averageResponseTimeMs peakConcurrency peakQueueSize resumedRequests renderedPages storageBackpressureEvents droppedEvents evidenceObjectsWritten evidenceBytesWritten changesRecorded workerHeartbeats replaysCompleted: number; finishedAt stopReason: string?; stopDetail: object?",
    "journal": "type checksum createdAt: string; sequence: number; previousChecksum: string?; requestId leaseId expiresAt: string~; reason: string?~; request: object~",
}


def record_contracts(namespace: str = "webloom", version: int = 1) -> dict[str, Contract]:
    """Contracts of the 12 record kinds and of manifest, stats and journal, by kind; the schema id is ``namespace.kind``."""
    out = {}
    for kind, shape in _SHAPES.items():
        fields = {name: part.split(":")[1].strip() for part in shape.split(";") for name in part.split(":")[0].split()}
        if kind == "stats":
            fields |= dict.fromkeys([c for table in (COUNTERS, SUMS) for names in table.values() for c in names], "number")
        out[kind] = Contract(f"{namespace}.{kind}", version, fields)
    return out


def evidence_fault(digest: Column, byte_length: Column, kind: Column, source_length: Column) -> Column:
    """Why a reference to evidence is invalid, or null.

    The digest is 64 lower-case hexadecimal digits and lengths aren't negative; a complete
    capture has the length of its source, a truncated one is shorter.
    """
    return (
        F.when(~F.coalesce(digest.rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
        .when(F.coalesce(byte_length, F.lit(-1)) < 0, "length")
        .when((kind == "complete") & ~F.coalesce(source_length == byte_length, F.lit(False)), "complete length")
        .when((kind == "truncated") & ~F.coalesce(source_length > byte_length, F.lit(True)), "truncated length")
        .when(~F.coalesce(kind.isin("complete", "truncated"), F.lit(False)), "capture")
    )
