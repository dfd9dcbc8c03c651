"""Apps of programs: several events per record, own tables, constraints that stop an app."""

import random

import pytest
from pyspark.sql import functions as F

from foldtrace.catalog.programs import units_app
from foldtrace.operators import changes, constraints
from foldtrace.operators.constraints import Rules
from foldtrace.operators.record_view import finish_many
from foldtrace.plans.programs import program_app
from foldtrace.streaming import lifecycle
from foldtrace.streaming.runner import Runner

SCHEMA = "key string, code string, n int, op string, position long, ordinal int, step int"


def brute(rows, prior, unique=True):
    """Apply changes one by one until the first that breaks a rule."""
    table = {r[0]: r for r in prior}
    rank = {"insert": 0, "upsert": 1, "delete": 2}
    for row in sorted(rows, key=lambda r: (r[4], r[5], r[6], rank[r[3]])):
        key, code, n, op, position = row[:5]
        if op == "delete":
            table.pop(key, None)
            continue
        if n is None:
            return position, "NOT NULL constraint failed: t.n"
        if n < 0:
            return position, "CHECK constraint failed: n >= 0"
        if op == "insert" and key in table:
            return position, "insert: UNIQUE constraint failed"
        if unique and code is not None and any(k != key and r[1] == code for k, r in table.items()):
            return position, "UNIQUE constraint failed: t.code"
        table[key] = row
    return None, None


def case(seed):
    dice = random.Random(seed)
    rows = []
    for position in range(1, 60):
        for ordinal in range(dice.randint(0, 2)):
            key, code = dice.choice(["a", "b", "c", "d", "e", "f", None]), dice.choice([None, *(f"c{k}" for k in range(dice.choice([9, 60])))])
            op = dice.choice(["upsert"] * 4 + ["delete", "delete", "insert"])
            rows.append((key, code, dice.choice([1] * 60 + [None, -1]), op, position, ordinal, 0))
    prior = [(k, f"c{i}", 1) for i, k in enumerate(["a", None, "z"])] if seed % 2 else []
    return rows, prior


def test_first_violation_matches_one_by_one(spark):
    rules = Rules(("key",), ("n",), {"n >= 0": "n >= 0"}, (("code",),))
    stopped = 0
    for seed in range(6):
        rows, prior = case(seed)
        frame = spark.createDataFrame(rows, SCHEMA)
        stored = spark.createDataFrame(prior, "key string, code string, n int") if prior else None
        bad = constraints.violations("t", frame, rules, stored, chunk=7)
        got = bad.agg(F.min("position").alias("p"), F.min_by("reason", F.struct("position", "at", "reason")).alias("r")).first()
        want = brute(rows, prior)
        assert got.p == want[0], seed
        stopped += got.p is not None
        if want[1] and "NOT NULL" not in want[1]:
            assert got.r is not None
    assert stopped > 3


def test_two_columns_and_stored_null_keys(spark):
    rows = [("a", "x", 1, "upsert", 1, 0, 0), ("b", "x", 2, "upsert", 2, 0, 0), ("a", "y", 2, "upsert", 3, 0, 0), ("c", "y", 2, "upsert", 4, 0, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = constraints.unique_conflicts(frame, ["key"], ["code", "n"], "t").collect()
    assert [(r.position, r.reason) for r in found] == [(4, "UNIQUE constraint failed: t.code, t.n")]
    stored = spark.createDataFrame([(None, "z", 2)], "key string, code string, n int")
    fresh = spark.createDataFrame([(None, "q", 1, "insert", 1, 0, 0), (None, "q", 1, "insert", 2, 0, 0)], SCHEMA)
    assert sorted(r.position for r in changes.insert_conflicts(fresh, ["key"], stored).collect()) == [1, 2]
    assert [r.read_n for r in changes.lookup(fresh, stored.select("key", "n"), ["key"]).collect()] == [2, 2]
    one = changes.lookup_one(fresh, stored.union(stored), ["key"]).select("read_n", "error_reason").first()
    assert tuple(one) == (None, "read ONE: expected exactly one row")


RECORDS = "position long, event_id string, signal string, name string, source string, user_id long, value double, k long, canonical_bytes long"


def records(spark, rows):
    return spark.createDataFrame([(p, f"local:{p}", "log", "n", "s", user, value, k, 9) for p, user, value, k in rows], RECORDS)


def test_batches_of_several_events_and_a_restart(spark, tmp_path):
    dice = random.Random(3)
    rows = [(p, dice.randint(1, 5), float(p), dice.randint(0, 99)) for p in range(1, 91)]
    app, root = units_app(), str(tmp_path / "store")
    for batch, (low, high) in enumerate([(1, 30), (31, 31), (32, 90)]):
        Runner(spark, root, [app]).process_records(records(spark, rows[low - 1 : high]), batch)  # a new runner each time
    runner = Runner(spark, root, [app])
    state = runner.store.read()
    whole = app.tables(records(spark, rows))
    for name in app.keys:
        kept = sorted(map(tuple, runner.store.table(state, app.name, name).collect()), key=repr)
        assert kept == sorted(map(tuple, whole[name].collect()), key=repr) and kept, name
    frontier = state["apps"]["units"]["frontier"]
    assert frontier["position"] == 90 and frontier["emitted"] == sum(k % 4 for *_, k in rows) and frontier["ineffective"] == sum(k % 4 == 0 for *_, k in rows)


def test_a_violation_stops_the_app_before_its_record(spark, tmp_path):
    rows = [(1, 1, 1.0, 1), (2, 2, 2.0, 3), (3, 3, 2.0, 1), (4, 4, 2.0, 2), (5, 5, 9.0, 1)]  # record 4 writes codes that user 2 still holds in part
    app = units_app()
    runner = Runner(spark, str(tmp_path / "store"), [app])
    runner.process_records(records(spark, rows[:2]), 0)
    runner.process_records(records(spark, rows[2:]), 1)
    state = runner.store.read()
    frontier = state["apps"]["units"]["frontier"]
    # User 2 ends with the third code of its value, user 3 takes the first and keeps it, user 4 wants it too.
    assert (frontier["gap_position"], frontier["position"], frontier["detached"]) == (4, 3, 2)
    assert frontier["gap_reason"] == "UNIQUE constraint failed: codes.code" and not frontier["complete"]
    kept = sorted(r.user for r in runner.store.table(state, "units", "users").collect())
    assert kept == [1, 2, 3]


@pytest.mark.parametrize("count", [0, 1, 256, 257])
def test_bound_of_events(spark, count):
    one = "named_struct('x', 1)"
    frame = records(spark, [(1, 1, 1.0, 1)])
    events = F.expr(f"CAST(array_repeat({one}, {count}) AS array<struct<x: int>>)")
    app = program_app("many", lambda f: finish_many(f, events), {"t": Rules(("position",))}, [{"t": lambda e: e.selectExpr("position", "ordinal", "'upsert' AS op")}])
    gap = lifecycle.gap_frame(app, app.normalize(frame), {}).first()
    assert gap.reason == ("more than 256 events" if count > 256 else None)
    assert app.normalize(frame).first().effective == (count > 0)


def test_an_evaluation_with_too_many_changes_stops_the_app(spark):
    """Changes count over all tables of one program and event, and are refused before the first of them."""
    made = [(1, 2), (2, 3), (3, 4), (4, 9)]
    records = spark.createDataFrame([(p, f"r{p}", "log", "n", "s", n) for p, n in made], "position long, event_id string, signal string, name string, source string, n int")
    normalize = lambda frame: finish_many(frame, F.expr("array(named_struct('n', 1), named_struct('n', n))"))
    tags = lambda events: events.select(F.explode(F.expr("sequence(1, n)")).alias("tag"), F.lit("upsert").alias("op"), "position", "ordinal")
    seen = lambda events: events.select("n", F.lit("upsert").alias("op"), "position", "ordinal")
    rules = {"tags": Rules(("tag",), checks={"tag > 0": "tag > 0", "never": "tag < 0 OR position < 3"}), "seen": Rules(("n",))}
    app = program_app("tags", normalize, rules, [{"tags": tags, "seen": seen}, {"seen": seen}], max_changes=4)
    normalized = app.normalize(records)
    broken = {(row.position, row.at.o, row.at.s) for row in app.violations(normalized, {}).where("reason = 'row changes exceed 4'").collect()}
    assert broken == {(3, 1, 0), (4, 1, 0)}
    assert lifecycle.first_gap(app, normalized, {}) == (3, "CHECK constraint failed: never")  # the event before it
    late = program_app("tags", lambda frame: normalize(frame).where("position > 0"), {"tags": Rules(("tag",), checks={"never": "tag < 2"}), "seen": Rules(("n",))}, [{"tags": tags, "seen": seen}], max_changes=4)
    assert lifecycle.first_gap(late, late.normalize(records.where("position > 2")), {}) == (3, "row changes exceed 4")
    roomy = program_app("tags", normalize, {"tags": Rules(("tag",)), "seen": Rules(("n",))}, [{"tags": tags, "seen": seen}])
    assert lifecycle.first_gap(roomy, normalized, {}) is None
