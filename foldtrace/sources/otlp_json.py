"""One OTLP/JSON request as canonical record texts, or the reason it is refused.

Attribute values are trees of any depth, which no column type describes; this is the one step
of ingest that runs per request in Python.  Everything after it (names, sources, positions,
digests, admission) is Spark.

A request is walked once along the declared shapes below: every field must be known, given once
and of its type, so nothing is dropped or turned into null on the way.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from dataclasses import dataclass

# Messages of the protocol.  ``*`` is a list, ``?`` a field that is present even
# when it is zero; fields of one group of ``ONE_OF`` exclude each other.
SHAPES = {
    "AnyValue": "stringValue:string? boolValue:bool? intValue:int64? doubleValue:double? bytesValue:bytes? "
    "stringValueStrindex:int32? arrayValue:ArrayValue? kvlistValue:KeyValueList?",
    "ArrayValue": "values:AnyValue*",
    "KeyValueList": "values:KeyValue*",
    "KeyValue": "key:string value:AnyValue keyStrindex:int32",
    "EntityRef": "schemaUrl:string type:string idKeys:string* descriptionKeys:string*",
    "Resource": "attributes:KeyValue* droppedAttributesCount:uint32 entityRefs:EntityRef*",
    "Scope": "name:string version:string attributes:KeyValue* droppedAttributesCount:uint32",
    "LogsRequest": "resourceLogs:ResourceLogs*",
    "ResourceLogs": "resource:Resource scopeLogs:ScopeLogs* schemaUrl:string",
    "ScopeLogs": "scope:Scope logRecords:LogRecord* schemaUrl:string",
    "LogRecord": "timeUnixNano:uint64 observedTimeUnixNano:uint64 severityNumber:severity severityText:string body:AnyValue attributes:KeyValue* "
    "droppedAttributesCount:uint32 flags:uint32 traceId:bytes spanId:bytes eventName:string",
    "TraceRequest": "resourceSpans:ResourceSpans*",
    "ResourceSpans": "resource:Resource scopeSpans:ScopeSpans* schemaUrl:string",
    "ScopeSpans": "scope:Scope spans:Span* schemaUrl:string",
    "Span": "traceId:bytes spanId:bytes traceState:string parentSpanId:bytes flags:uint32 name:string kind:span_kind startTimeUnixNano:uint64 "
    "endTimeUnixNano:uint64 attributes:KeyValue* droppedAttributesCount:uint32 events:SpanEvent* droppedEventsCount:uint32 links:SpanLink* "
    "droppedLinksCount:uint32 status:Status",
    "SpanEvent": "timeUnixNano:uint64 name:string attributes:KeyValue* droppedAttributesCount:uint32",
    "SpanLink": "traceId:bytes spanId:bytes traceState:string attributes:KeyValue* droppedAttributesCount:uint32 flags:uint32",
    "Status": "message:string code:status_code",
    "MetricsRequest": "resourceMetrics:ResourceMetrics*",
    "ResourceMetrics": "resource:Resource scopeMetrics:ScopeMetrics* schemaUrl:string",
    "ScopeMetrics": "scope:Scope metrics:Metric* schemaUrl:string",
    "Metric": "name:string description:string unit:string gauge:Gauge? sum:Sum? histogram:Histogram? exponentialHistogram:ExponentialHistogram? "
    "summary:Summary? metadata:KeyValue*",
    "Gauge": "dataPoints:NumberPoint*",
    "Sum": "dataPoints:NumberPoint* aggregationTemporality:temporality isMonotonic:bool",
    "Histogram": "dataPoints:HistogramPoint* aggregationTemporality:temporality",
    "ExponentialHistogram": "dataPoints:ExponentialPoint* aggregationTemporality:temporality",
    "Summary": "dataPoints:SummaryPoint*",
    "NumberPoint": "attributes:KeyValue* startTimeUnixNano:uint64 timeUnixNano:uint64 asDouble:double? asInt:int64? exemplars:Exemplar* flags:uint32",
    "HistogramPoint": "attributes:KeyValue* startTimeUnixNano:uint64 timeUnixNano:uint64 count:uint64 sum:double? bucketCounts:uint64* "
    "explicitBounds:double* exemplars:Exemplar* flags:uint32 min:double? max:double?",
    "ExponentialPoint": "attributes:KeyValue* startTimeUnixNano:uint64 timeUnixNano:uint64 count:uint64 sum:double? scale:int32 zeroCount:uint64 "
    "positive:Buckets negative:Buckets flags:uint32 exemplars:Exemplar* min:double? max:double? zeroThreshold:double",
    "Buckets": "offset:int32 bucketCounts:uint64*",
    "SummaryPoint": "attributes:KeyValue* startTimeUnixNano:uint64 timeUnixNano:uint64 count:uint64 sum:double quantileValues:Quantile* flags:uint32",
    "Quantile": "quantile:double value:double",
    "Exemplar": "filteredAttributes:KeyValue* timeUnixNano:uint64 asDouble:double? asInt:int64? spanId:bytes traceId:bytes",
}
ONE_OF = {
    "AnyValue": {"stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "stringValueStrindex", "arrayValue", "kvlistValue"},
    "Metric": {"gauge", "sum", "histogram", "exponentialHistogram", "summary"},
    "NumberPoint": {"asDouble", "asInt"},
    "Exemplar": {"asDouble", "asInt"},
}
ENUMS = {
    "severity": ["SEVERITY_NUMBER_UNSPECIFIED"]
    + [f"SEVERITY_NUMBER_{level}{step}" for level in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL") for step in ("", "2", "3", "4")],
    "span_kind": [f"SPAN_KIND_{kind}" for kind in ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")],
    "temporality": [f"AGGREGATION_TEMPORALITY_{kind}" for kind in ("UNSPECIFIED", "DELTA", "CUMULATIVE")],
    "status_code": [f"STATUS_CODE_{code}" for code in ("UNSET", "OK", "ERROR")],
}
RANGES = {"int32": (-(2**31), 2**31 - 1), "uint32": (0, 2**32 - 1), "int64": (-(2**63), 2**63 - 1), "uint64": (0, 2**64 - 1)}
MAX_EXACT_INTEGER = 2**53 - 1
POINT_TYPES = {"gauge": "gauge", "sum": "sum", "histogram": "histogram", "exponential_histogram": "exponential_histogram", "summary": "summary"}
REQUESTS = {"log": "LogsRequest", "span": "TraceRequest", "metric": "MetricsRequest"}

_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", re.ASCII)
_SNAKE = re.compile(r"(?<!^)(?=[A-Z])")


class Refused(ValueError):
    """The request is not admitted; the text says why."""


class Repeated(Refused):
    """An attribute key stands twice in one list."""


class Pairs(list):
    """A JSON object as its members, so that a repeated one is seen."""


@dataclass(frozen=True)
class Limits:
    request_bytes: int = 16 * 1024 * 1024
    request_records: int = 10_000
    record_bytes: int = 256 * 1024
    depth: int = 200


def _fields_of(name: str) -> dict[str, tuple]:
    found = {}
    for item in SHAPES[name].split():
        field, kind = item.split(":")
        plain = kind.rstrip("*?")
        entry = (_SNAKE.sub("_", field).lower(), plain, kind.endswith("*"), kind.endswith("?"), field in ONE_OF.get(name, ()))
        found[field] = found[entry[0]] = entry
    return found


FIELDS = {name: _fields_of(name) for name in SHAPES}


def _integer(value, kind: str) -> int:
    if isinstance(value, str):
        if not (value.isdecimal() and value.isascii() and (value[0] != "0" or len(value) == 1)) and not _NUMBER.fullmatch(value):
            raise Refused("an integer is expected")
        if len(value) > 40:
            raise Refused("an integer is out of range")
        value = int(value) if value.lstrip("-").isdecimal() else float(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    low, high = RANGES[kind]
    if isinstance(value, bool) or not isinstance(value, int):
        raise Refused("an integer is expected")
    if not low <= value <= high:
        raise Refused("an integer is out of range")
    return value


def _double(value) -> float:
    if isinstance(value, str):
        if value in ("NaN", "Infinity", "-Infinity"):
            return float(value)
        if not _NUMBER.fullmatch(value):
            raise Refused("a number is expected")
        value = float(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise Refused("a number is expected")
    try:
        value = float(value)
    except OverflowError:
        value = math.inf
    if math.isinf(value):
        raise Refused("a number is out of range")
    return value


def _bytes(value) -> str:
    """Base64 of either alphabet, padded or not, in the standard padded form."""
    if not isinstance(value, str):
        raise Refused("a text is expected")
    try:
        plain = value.replace("-", "+").replace("_", "/").rstrip("=")
        return base64.b64encode(base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)).decode()
    except (binascii.Error, ValueError) as error:
        raise Refused("base64 is expected") from error


def _enum(value, names: list[str]):
    """The name, or the number where it has none."""
    if isinstance(value, str) and value in names:
        return value
    if isinstance(value, str):
        raise Refused("an enumeration value is expected")
    number = _integer(value, "int32")
    return names[number] if 0 <= number < len(names) else number


def _scalar(kind: str, value):
    if kind == "string":
        if not isinstance(value, str):
            raise Refused("a text is expected")
        if not value.isascii() and any("\ud800" <= c <= "\udfff" for c in value):
            raise Refused("a text is not valid Unicode")
        return value
    if kind == "bool":
        if not isinstance(value, bool):
            raise Refused("a boolean is expected")
        return value
    if kind == "double":
        number = _double(value)
        return number if math.isfinite(number) else str(value)
    if kind == "bytes":
        return _bytes(value)
    if kind in ENUMS:
        return _enum(value, ENUMS[kind])
    number = _integer(value, kind)
    return str(number) if kind.endswith("64") else number


def _is_zero(kind: str, value) -> bool:
    if kind in ENUMS:
        return value == ENUMS[kind][0]
    return value == "0" if kind.endswith("64") else not value


def message(name: str, value, depth: int) -> dict:
    """A message by its protocol field names; 64-bit integers as text, zero fields left out."""
    if not isinstance(value, Pairs):
        raise Refused("an object is expected")
    if depth <= 0:
        raise Refused("values nest too deep")
    fields, found, chosen = FIELDS[name], {}, None
    if name == "AnyValue" and len(value) == 1:  # most values are one scalar
        key, raw = value[0]
        entry = fields.get(key)
        if entry is not None and raw is not None and entry[1] not in FIELDS:
            return {entry[0]: _scalar(entry[1], raw)}
    for key, raw in value:
        entry = fields.get(key)
        if entry is None:
            raise Refused(f"unknown field {key[:80]!r}")
        target, kind, many, present, exclusive = entry
        if target in found:
            raise Refused(f"field {key!r} is given twice")
        if raw is None:
            continue
        if exclusive:
            if chosen is not None:
                raise Refused("a value of two kinds")
            chosen = target
        if many:
            if type(raw) is not list:
                raise Refused("a list is expected")
            found[target] = [message(kind, x, depth - 1) for x in raw] if kind in FIELDS else [_scalar(kind, x) for x in raw]
        elif kind in FIELDS:
            found[target] = message(kind, raw, depth - 1)
        else:
            read = _scalar(kind, raw)
            found[target] = None if not present and _is_zero(kind, read) else read
    return {key: held for key, held in found.items() if held is not None and held != []}


def any_value(value: dict | None):
    """A decoded attribute value; large integers and bytes keep what they are in a wrapper."""
    for kind, held in (value or {}).items():
        if kind == "int_value":
            number = int(held)
            return number if abs(number) <= MAX_EXACT_INTEGER else {"integer_decimal": held}
        if kind == "bytes_value":
            return {"bytes_base64": held}
        if kind == "array_value":
            return [any_value(x) for x in held.get("values", ())]
        if kind == "kvlist_value":
            return attribute_map(held.get("values", ()))
        if kind == "string_value_strindex":
            raise Refused("string-table attributes are unsupported")
        if kind == "double_value" and isinstance(held, str):
            raise Refused("non-finite double")
        return held
    return None


def attribute_map(attributes) -> dict:
    found = {}
    for entry in attributes:
        if entry.get("key_strindex"):
            raise Refused("string-table attributes are unsupported")
        key = entry.get("key", "")
        if not key:
            raise Refused("attribute key is empty")
        if key in found:
            raise Repeated("attribute key is duplicated")
        found[key] = any_value(entry.get("value"))
    return found


def _labelled(label: str, read, value):
    try:
        return read(value)
    except Repeated as error:
        raise Refused(f"{label}: {error}") from error


def _metric_identity(metric: dict, kind: str) -> dict:
    found = {name: metric.get(name, "") for name in ("name", "description", "unit")} | {"point_type": POINT_TYPES[kind]}
    if kind in ("sum", "histogram", "exponential_histogram"):
        found["aggregation_temporality"] = metric[kind].get("aggregation_temporality", ENUMS["temporality"][0])
    if kind == "sum":
        found["is_monotonic"] = metric[kind].get("is_monotonic", False)
    return found


def _hex(value: str | None) -> str | None:
    return base64.b64decode(value).hex() if value else None


def _records(signal: str, request: dict):
    """Canonical records of a request, in order."""
    plural = {"log": "logs", "span": "spans", "metric": "metrics"}[signal]
    for group in request.get(f"resource_{plural}", ()):
        held = group.get("resource", {})
        resource = {
            "attributes": _labelled("resource", attribute_map, held.get("attributes", ())),
            "dropped_attributes_count": held.get("dropped_attributes_count", 0),
            "schema_url": group.get("schema_url", ""),
        }
        for scoped in group.get(f"scope_{plural}", ()):
            held = scoped.get("scope", {})
            scope = {
                "name": held.get("name", ""),
                "version": held.get("version", ""),
                "attributes": _labelled("scope", attribute_map, held.get("attributes", ())),
                "dropped_attributes_count": held.get("dropped_attributes_count", 0),
                "schema_url": scoped.get("schema_url", ""),
            }
            around = {"resource": resource, "scope": scope}
            for item in scoped.get({"log": "log_records", "span": "spans", "metric": "metrics"}[signal], ()):
                if signal == "metric":
                    yield from _points(item, around)
                    continue
                record = around | {"attributes": _labelled("record", attribute_map, item.get("attributes", ())), "otel": item}
                if signal == "log":
                    record |= {
                        "body": _labelled("body", any_value, item.get("body")),
                        "severity_number": str(item.get("severity_number", ENUMS["severity"][0])),
                        "severity_text": item.get("severity_text", ""),
                        "flags": item.get("flags", 0),
                        "dropped_attributes_count": item.get("dropped_attributes_count", 0),
                    }
                else:
                    record |= {
                        "kind": str(item.get("kind", ENUMS["span_kind"][0])),
                        "parent_span_id": _hex(item.get("parent_span_id")),
                        "start_time_unix_nano": item.get("start_time_unix_nano"),
                        "end_time_unix_nano": item.get("end_time_unix_nano"),
                        "trace_state": item.get("trace_state", ""),
                        "flags": item.get("flags", 0),
                    }
                yield record


def _points(metric: dict, around: dict):
    kind = next((k for k in POINT_TYPES if k in metric), None)
    if kind is None:
        raise Refused("metric has no supported data points")
    identity = _metric_identity(metric, kind)
    for point in metric[kind].get("data_points", ()):
        yield around | {
            "attributes": _labelled("record", attribute_map, point.get("attributes", ())),
            "metric": identity,
            "start_time_unix_nano": point.get("start_time_unix_nano"),
            "time_unix_nano": point.get("time_unix_nano"),
            "otel": point,
        }


def _no_constant(name: str):
    raise ValueError(name)


_read = json.JSONDecoder(object_pairs_hook=Pairs, parse_constant=_no_constant)
_write = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode


def canonical_texts(signal: str, body: str | None, limits: Limits = Limits()) -> tuple[str | None, list[str] | None]:
    """(why the request is refused, its canonical records as JSON texts with sorted keys)."""
    if body is None or signal not in REQUESTS:
        return "malformed request", None
    if len(body) > limits.request_bytes or len(body) * 4 > limits.request_bytes and len(body.encode()) > limits.request_bytes:
        return "request exceeds the byte limit", None
    try:
        value = _read.decode(body)
    except (ValueError, RecursionError):
        return "malformed request", None
    try:
        texts = []
        for record in _records(signal, message(REQUESTS[signal], value, limits.depth)):
            texts.append(_write(record))
            if len(texts) > limits.request_records:
                raise Refused("request exceeds the record limit")
            if len(texts[-1]) * 4 > limits.record_bytes and len(texts[-1].encode()) > limits.record_bytes:
                raise Refused("canonical record exceeds the limit")
        return None, texts
    except Refused as error:
        return str(error), None
    except RecursionError:
        return "values nest too deep", None
