"""Products beyond 64 bits: whole, exact and typed as integers."""

from datetime import datetime

from foldtrace.catalog import all_queries

DAY = datetime(2024, 1, 1)


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def events(*rows):
    """Purchases of (event_id, user_id, value)."""
    full = [(event, DAY, user, "purchase", value, '{"k": 1}') for event, user, value in rows]
    return full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_a_cost_scaled_beyond_64_bits(spark, tmp_path):
    folder = tables(spark, tmp_path, events=events((1, 4, 200000.0), (2, 4, 0.01), (3, 8, 0.5)))
    rows = all_queries()["q08_result_typing"](spark, folder).collect()
    assert {r.session_id: r.scaled for r in rows} == {"s4": '{"integer_decimal":"20000001000000000000"}', "s8": "50000000000000"}


def test_a_declared_integer_beyond_64_bits(spark, tmp_path):
    customers = [(1,), (9,), (10,), (20000,)]
    folder = tables(spark, tmp_path, events=events((1, 20000, 60.0), (2, 9, 1.0), (3, 5, 1.0)), customer=(customers, "c_custkey long"))
    rows = all_queries()["q08_typed_by_contract"](spark, folder).collect()
    assert {r.event_id: r.account for r in rows} == {"1": '{"integer_decimal":"20000000000000000000"}', "2": "9000000000000000", "3": None}
    assert {r.account_type for r in rows} == {"INTEGER"}


LAST = (2**63 - 1) // 3_000_000_000_000
WIDE = [(LAST - 1, 1, 1.5), (LAST, 2, 2.5), (LAST + 1, 3, 3.5), (6_000_000, 4, 4.5)]


def test_the_codec_wraps_a_product_beyond_64_bits(spark, tmp_path):
    rows = all_queries()["x12_codec"](spark, tables(spark, tmp_path, events=events(*WIDE))).collect()
    assert {r.event_id: r.wrapped for r in rows} == {k: f'{{"integer_decimal":"{k * 3_000_000_000_000}"}}' for k, _, _ in WIDE}


def test_requests_with_products_beyond_64_bits_are_admitted(spark, tmp_path):
    folder = tables(spark, tmp_path, events=events(*WIDE))
    found = all_queries()
    rows = found["s04_any_values"](spark, folder).orderBy("position").collect()
    assert [(r.position, r.value, r.big) for r in rows] == [(n + 1, v, str(k * 3_000_000_000_000)) for n, (k, _, v) in enumerate(WIDE)]
    for name in ("s02_span_records", "s10_content_digest"):
        assert found[name](spark, folder).count() == len(WIDE)
    assert {r.rejected for r in found["s11_record_bounds"](spark, folder).collect()} == {None}


def test_every_ingest_query_runs_on_products_beyond_64_bits(spark, tmp_path):
    folder = tables(spark, tmp_path, events=events(*WIDE))
    found = all_queries()
    rows = {name: found[name](spark, folder).collect() for name in found if name.startswith("s0") or name in ("s10_content_digest", "s11_record_bounds")}
    # All are purchases; a metric of an odd event has a second point.
    points = len(WIDE) + sum(event % 2 for event, _, _ in WIDE)
    whole = {"s01_log_records", "s02_span_records", "s03_distribution_points", "s04_any_values", "s04_deep_values", "s06_resource_scope", "s10_content_digest"}
    assert {name: len(rows[name]) for name in whole} == dict.fromkeys(whole, len(WIDE))
    assert len(rows["s03_metric_points"]) == points
    assert sum(r.records for r in rows["s07_source_names"]) == sum(r.records for r in rows["s08_log_event_names"]) == len(WIDE)
    assert [r.observed for r in rows["s09_optional_times"]] == [len(WIDE)]
    assert {r.rejected for r in rows["s11_record_bounds"]} == {None}
    assert rows["s05_rejected_attributes"] == []
