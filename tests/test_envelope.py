import json

import pytest
from pyspark.sql import functions as F

from foldtrace.operators.envelope import Envelope, Field, depth_error
from foldtrace.operators.record_view import finish_many
from foldtrace.plans.programs import program_app
from foldtrace.operators.constraints import Rules
from foldtrace.streaming import lifecycle

ENVELOPE = Envelope(
    meta=(Field("position", "INTEGER"), Field("signal", "TEXT"), Field("clock", "TEXT", optional=True)),
    event=(
        Field("amount", "REAL"),
        Field("note", "TEXT", nullable=True),
        Field("tags", "strings", optional=True),
        Field("attributes", "document", optional=True),
        Field("origin", "object", optional=True, nullable=True, members=(Field("host", "TEXT"), Field("port", "INTEGER", optional=True))),
    ),
    rows={"held": (Field("code", "INTEGER"), Field("open", "BOOLEAN", nullable=True))},
    max_bytes=4096,
    max_depth=20,
)


def good(**event):
    return {"meta": {"position": 1, "signal": "log"}, "event": {"amount": 1.5, "note": None, **event}, "rows": {"held": []}}


def changed(path, value=..., base=None):
    """A good input with one member set, or removed where no value is given."""
    made = json.loads(json.dumps(base or good()))
    *parents, last = path
    inner = made
    for name in parents:
        inner = inner[name]
    if value is ...:
        del inner[last]
    else:
        inner[last] = value
    return json.dumps(made)


CASES = [
    (json.dumps(good()), None),
    (json.dumps(good(tags=[], attributes={"a": {"b": [1]}}, origin=None)), None),
    (json.dumps(good(tags=["x", "y"], origin={"host": "h"})), None),
    (changed(["meta", "clock"], "now"), None),
    (changed(["rows", "held"], [{"code": 1, "open": None}, {"code": 2, "open": True}]), None),
    (changed(["meta"]), "input meta: is required"),
    (changed(["meta"], None), "input meta: must be a non-null object"),
    (changed(["meta", "signal"]), 'input meta: field "signal" is required'),
    (changed(["meta", "position"], 1.5), 'input meta: field "position": must be an exactly representable JSON integer'),
    (changed(["meta", "position"], None), 'input meta: field "position": must not be null'),
    (changed(["meta", "clock"], None), 'input meta: field "clock": must not be null'),
    (changed(["meta", "zone"], "UTC"), 'input meta: unknown field "zone"'),
    (changed(["event"], []), "input event: must be a non-null object"),
    (changed(["event", "amount"], "1"), 'input event: field "amount": must be a finite number'),
    (changed(["event", "note"]), 'input event: field "note" is required'),
    (changed(["event", "tags"], ["x", 1]), 'input event: field "tags": must contain only strings'),
    (changed(["event", "tags"], None), 'input event: field "tags": must be a non-null string array'),
    (changed(["event", "attributes"], [1]), 'input event: field "attributes": must be a non-null JSON object'),
    (changed(["event", "origin"], {"port": 1}), 'input event: field "origin": field "host" is required'),
    (changed(["event", "origin"], {"host": "h", "user": "u"}), 'input event: field "origin": unknown field "user"'),
    (changed(["event", "zz"], 1, good(aa=2)), 'input event: unknown field "aa"'),
    (changed(["rows", "held"], {}), 'input rows: field "held": must be an array of rows'),
    (changed(["rows", "held"], [{"code": 1, "open": True}, {"code": 2}]), 'input rows: field "held": row 1: field "open" is required'),
    (changed(["rows", "gone"], []), 'input rows: unknown field "gone"'),
    (changed(["more"], 1), 'input: unknown field "more"'),
    (json.dumps(good(note="x" * 5000)), "evaluation input exceeds 4096 bytes"),
    (json.dumps(good(note="[" * 50 + '\\"{' * 9)), None),
    (changed(["event", "attributes"], json.loads('{"a":' + "[" * 17 + "]" * 17 + "}")), None),
    (changed(["event", "attributes"], json.loads('{"a":' + "[" * 18 + "]" * 18 + "}")), "evaluation input exceeds depth 20"),
    (changed(["event", "attributes"], {"a": [[] for _ in range(60)]}), None),
    ('{"meta":{},"meta":{}}', "evaluation input is not a JSON object"),
    ("[]", "evaluation input is not a JSON object"),
    ("", "evaluation input is not a JSON object"),
    (None, "evaluation input is not a JSON object"),
]


def test_every_kind_of_error(spark):
    frame = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "k int, input string")
    found = {row.k: row.reason for row in frame.select("k", ENVELOPE.error(F.col("input")).alias("reason")).collect()}
    for k, (text, reason) in enumerate(CASES):
        assert found[k] == reason, text
    assert frame.limit(0).select(ENVELOPE.error(F.col("input"))).count() == 0


def test_depth_of_long_texts(spark):
    texts = ["[" * n + "]" * n for n in (1024, 1025)] + ['{"a":"' + '\\"' * 60000 + "[" * 60000 + '"}', "[" + "[]," * 60000 + "[]]", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, input string").select("k", depth_error(F.col("input")).alias("reason"))
    assert {row.k: row.reason for row in frame.collect()} == {0: None, 1: "evaluation input exceeds depth 1024", 2: None, 3: None, 4: None}


def test_declarations_are_checked():
    with pytest.raises(ValueError, match="repeat"):
        Envelope((Field("a", "TEXT"), Field("a", "TEXT")), ()).error(F.col("input"))
    with pytest.raises(ValueError, match="unknown kind"):
        Envelope((Field("a", "DATE"),), ()).error(F.col("input"))


def test_an_app_stops_at_an_input_that_does_not_fit(spark):
    envelope = Envelope((Field("position", "INTEGER"),), (Field("key", "TEXT"),))
    inputs = [json.dumps({"meta": {"position": k}, "event": {"key": "a"} if k != 3 else {"kee": "a"}}) for k in range(1, 6)]
    records = spark.createDataFrame([(k, f"r{k}", "log", "n", "s", text) for k, text in enumerate(inputs, 1)], "position long, event_id string, signal string, name string, source string, input string")
    normalize = lambda frame: finish_many(frame, F.expr("array(named_struct('key', get_json_object(input, '$.event.key')))"), envelope.problems(F.col("input")))
    seen = lambda events: events.select("key", F.lit("upsert").alias("op"), "position", "ordinal")
    app = program_app("keys", normalize, {"keys": Rules(("key",))}, [{"keys": seen}])
    assert lifecycle.first_gap(app, app.normalize(records), {}) == (3, 'input event: field "key" is required')
    _, frontier = lifecycle.advance(app, app.normalize(records), lifecycle.Frontier(), {})
    assert (frontier.position, frontier.consumed, frontier.detached) == (2, 2, 3)
