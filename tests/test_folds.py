"""Sequential models of the ordered folds, compared on random histories and split batches."""

import bisect
import random

from pyspark.sql import functions as F

from foldtrace.functions.values import pack_nanos, unpack_nanos
from foldtrace.operators import changes, custom, folds, guard_folds, url_folds
from foldtrace.operators.app_folds import session_cost_detail

SCHEMA = (
    "harness string, session_id string, source_position long, event_time_unix_nano string, action_fingerprint string, "
    "progress_fingerprint string, progress_coverage string, success boolean, tool_coverage string, target_coverage string, coverage_reason string"
)


def history(seed, n=600):
    """Actions of a few sessions; one of them holds most of the events."""
    rng = random.Random(seed)
    rows = []
    for position in range(1, n + 1):
        session = "hot" if rng.random() < 0.6 else f"s{rng.randrange(8)}"
        progress = rng.choice([None, "p1", "p1", "p1", "p2"])
        rows.append(
            ("codex", session, position, str(10**18 + rng.randrange(10**9)), rng.choice("aab"), progress or "unknown",
             "observed" if progress else "unknown", rng.choice([True, False, False, None]), "observed", "observed", "r")
        )
    return rows


def model(rows):
    state, loops = {}, {}
    for harness, session, position, time, action, progress, coverage, success, *_ in rows:
        old = state.get(session)
        observed = coverage == "observed"
        same = observed and old is not None and old["progress"] == progress
        new = {
            "first": old["first"] if old else time,
            "last": time,
            "action": action,
            "progress": progress,
            "repeat": old["repeat"] + 1 if old and old["action"] == action else 1,
            "stuck": (old["stuck"] if old else 0) if not observed else (old["stuck"] + 1 if same else 0),
            "failures": (old["failures"] if old else 0) if success is None else (0 if success else (old["failures"] if old else 0) + 1),
            "distinct": (old["distinct"] if old else time) if not observed or same else time,
            "total": (old["total"] if old else 0) + 1,
            "position": position,
        }
        state[session] = new
        kind = (
            "repeated-failure" if new["failures"] >= 3 else "repeated-action" if new["repeat"] >= 3
            else "bounded-no-progress" if new["stuck"] >= 3 else None
        )
        if kind:
            loops[(session, kind)] = (position, new["first"], time, new["repeat"], new["failures"], new["stuck"])
    return state, loops


def progress_of(frame):
    return {
        row.session_id: (
            row.first_activity_unix_nano, row.last_activity_unix_nano, row.last_distinct_progress_unix_nano, row.action_fingerprint,
            row.progress_fingerprint, row.repeat_count, row.no_progress_count, row.consecutive_failures, row.total_actions, row.last_source_position,
        )
        for row in frame.collect()
    }


def loops_of(frame):
    return {
        (row.session_id, row.finding_kind): (
            row.source_position, row.first_observed_unix_nano, row.last_observed_unix_nano, row.repeat_count, row.consecutive_failures, row.no_progress_count,
        )
        for row in frame.collect()
    }


def test_runs_match_a_sequential_fold_for_any_chunk_and_split(spark, tmp_path):
    for seed, chunk, cuts in [(1, 1 << 20, []), (2, 16, []), (3, 7, [150, 151, 400]), (4, 64, [300])]:
        rows = history(seed)
        state, loops = model(rows)
        expected = {
            session: (s["first"], s["last"], s["distinct"], s["action"], s["progress"], s["repeat"], s["stuck"], s["failures"], s["total"], s["position"])
            for session, s in state.items()
        }
        bounds = [0, *cuts, len(rows)]
        progress = found = None
        for step, (low, high) in enumerate(zip(bounds, bounds[1:])):
            batch = spark.createDataFrame(rows[low:high], SCHEMA)
            progress, found = guard_folds.session_tables(batch, progress, found, chunk)
            if cuts:
                for name, frame in (("progress", progress), ("loops", found)):
                    frame.write.parquet(str(tmp_path / f"{seed}-{step}-{name}"))
                progress, found = (spark.read.parquet(str(tmp_path / f"{seed}-{step}-{name}")) for name in ("progress", "loops"))
        assert progress_of(progress) == expected, seed
        assert loops_of(found) == loops, seed


def test_project_moves_only_on_observed_values(spark):
    columns = (
        "harness string, session_id string, model string, project string, model_coverage string, project_coverage string, input_tokens long, "
        "output_tokens long, cached_input_tokens long, reasoning_output_tokens long, cost_microusd long, event_time_unix_nano string, source_position long"
    )
    rows = [
        ("h", "s", "m", "a", "observed", "observed", 1, 0, 0, 0, 0, "10", 1),
        ("h", "s", "m", "unknown", "observed", "unknown", 2, 0, 0, 0, 0, "9", 2),
    ]
    events = spark.createDataFrame(rows, columns)
    fold = session_cost_detail()
    split = fold.apply(events.where("source_position = 2"), fold.apply(events.where("source_position = 1")))
    for row in (fold.apply(events).first(), split.first()):
        assert (row.project, row.project_coverage, row.input_tokens) == ("a", "observed", 3)
        assert (row.first_event_time_unix_nano, row.last_event_time_unix_nano) == ("10", "9")


def test_url_context_rules(spark):
    schema = "event_family string, observed_full string, host string, harness string, session_id string, session_id_prefix string, tool_name string, project string, event_time_unix_nano string, source_position long"
    rows = [
        ("observation", "u", "h", "codex", "s", "s", "t", "p", "1", 1),
        ("observation", "u", "h", "codex", None, None, "", "q", "2", 2),
    ]
    events = spark.createDataFrame(rows, schema)
    first, second = events.where("source_position = 1"), events.where("source_position = 2")
    for keep, session in ((False, None), (True, "s")):
        fold = url_folds.url_observations(keep)
        for row in (fold.apply(events).first(), fold.apply(second, fold.apply(first)).first()):
            assert (row.latest_session_id, row.latest_tool_name, row.latest_project, row.observation_count) == (session, "t", "q", 2)


def test_nanos_keep_all_64_bits(spark):
    texts = ["1", "9223372036854775807", "9223372036854775808", "18446744073709551615", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [row[0] for row in frame.select(unpack_nanos(pack_nanos(F.col("t")))).collect()] == texts


def test_ordered_changes_against_a_replay(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(6)}", rng.randrange(100), p, 0, 0, rng.choice(["insert", "upsert", "delete"])) for p in range(1, 300)]
    frame = spark.createDataFrame(rows, "key string, balance long, position long, ordinal int, step int, op string")
    prior = spark.createDataFrame([("k0", 7), ("k9", 9)], "key string, balance long")
    table, conflicts = {"k0": 7, "k9": 9}, set()
    for key, balance, position, _, _, op in rows:
        if op == "insert" and key in table:
            conflicts.add(position)
        if op == "delete":
            table.pop(key, None)
        else:
            table[key] = balance
    assert {row.key: row.balance for row in changes.apply_changes(frame, ["key"], prior).collect()} == table
    for chunk in (8, 1 << 20):
        assert {row.position for row in changes.insert_conflicts(frame, ["key"], prior, chunk).collect()} == conflicts


def test_many_read_against_a_replay(spark):
    rng = random.Random(6)
    huge = 9007199254740993
    rows = [(rng.choice(["k0", "k1", None]), rng.choice([None, huge, huge + 2, rng.randrange(50)]), p) for p in range(1, 120)]
    frame = spark.createDataFrame(rows, "key string, balance long, position long")
    held, expected = {}, {}
    for key, balance, position in rows:
        expected[position] = sorted(held.setdefault(key, []), key=lambda v: (v is not None, v or 0))[:4]
        held[key].append(balance)
    for chunk in (10, 1 << 20):
        found = changes.many_read(frame, frame, ["key"], "balance", 4, chunk=chunk).collect()
        assert {row.position: row["values"] for row in found} == expected


def test_ordered_fold_keeps_null_keys_and_integers(spark):
    rows = [(None, 1, 9007199254740993), (None, 2, None), ("a", 3, 5), (None, 4, 2)]
    frame = spark.createDataFrame(rows, "key string, at long, n long")

    def step(state, event):
        assert event["n"] is None or isinstance(event["n"], int)
        return (state or 0) + (event["n"] or 0)

    found = custom.ordered_fold(frame, ["key"], ["at"], step, lambda total: {"total": total}, "key string, total long", ["n"])
    assert {row.key: row.total for row in found.collect()} == {None: 9007199254740995, "a": 5}


def test_running_total_keeps_null_keys(spark):
    frame = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 3, 4)], "key string, position long, n long")
    found = changes.running_total(frame, ["key"], "n", "position").collect()
    assert {(row.key, row.position): row["_running"] for row in found} == {(None, 1): 2, (None, 2): 5, ("a", 3): 4}


def test_sketches_merge_batch_by_batch(spark):
    fold = folds.Fold("t", ("key",), (folds.Quantiles("sketch", F.col("n")), folds.LastPosition("at", F.col("at"))), order="at")
    rows = spark.range(20_000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS key", "IF(id % 3 = 0, id, id * id) AS n", "id AS at")
    rows = rows.unionByName(spark.createDataFrame([("none", None, 1), (None, 5, 2)], "key string, n long, at long"))
    parts = [rows.where(f"at % 4 = {k}") for k in range(4)]
    stored = None
    for part in parts:
        stored = fold.apply(part, stored)
    got = {r.key: r for r in stored.select("key", *[folds.quantile(F.col("sketch"), s).alias(f"q{k}") for k, s in enumerate((0.05, 0.5, 0.95))]).collect()}
    values = {key: sorted(r.n for r in rows.where(f"key = '{key}'").collect()) for key in "ab"}
    for key, known in values.items():
        for k, share in enumerate((0.05, 0.5, 0.95)):
            assert abs(bisect.bisect_left(known, got[key][f"q{k}"]) / len(known) - share) < 0.02
    assert (got["none"].q1, got[None].q1) == (None, 5)
