"""A user fold over micro-batches gives what one pass over all events gives."""

import random

import pytest

from foldtrace.operators import custom

EVENTS = "key string, at long, op string, n long"
RESULT = "key string, runs long, total long, last_op string"


def step(state, event):
    last, runs, total = state or (None, 0, None)
    n = event["n"]
    assert n is None or type(n) is int  # integers stay integers beside NULLs
    return event["op"], runs + (event["op"] != last), total if n is None else n + (total or 0)


def finish(state):
    return {"runs": state[1], "total": state[2], "last_op": state[0]}


def run(spark, source, checkpoint, latest):
    def publish(frame, batch):
        rows = frame.collect()
        assert len({r.key for r in rows}) == len(rows)
        latest.update({r.key: tuple(r) for r in rows})

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    folded = custom.ordered_fold_stream(stream, ["key"], ["at"], step, finish, RESULT, ["op", "n"])
    query = folded.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_batches_and_a_restart_give_the_batch_result(spark, tmp_path):
    dice = random.Random(5)
    rows = [
        (dice.choice(["hot", "hot", "hot", "a", "b", "c", None]), at, dice.choice("xyz"), dice.choice([None, 2**55 + at, at]))
        for at in range(240)
    ]
    source, latest = str(tmp_path / "in"), {}
    batches = [rows[:90], rows[90:150], rows[150:]]
    for k, batch in enumerate(batches):
        dice.shuffle(batch)
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        if k:  # the first start takes two batches, the second goes on with the last one
            run(spark, source, str(tmp_path / "checkpoint"), latest)
    frame = spark.createDataFrame([row for batch in batches for row in batch], EVENTS)
    want = custom.ordered_fold(frame, ["key"], ["at"], step, finish, RESULT, ["op", "n"])
    assert latest == {r.key: tuple(r) for r in want.collect()} and len(latest) == 5


def test_an_event_behind_the_fold_stops_the_query(spark, tmp_path):
    source, latest = str(tmp_path / "in"), {}
    for at in (10, 5):
        spark.createDataFrame([("a", at, "x", 1)], EVENTS).coalesce(1).write.mode("append").parquet(source)
        if at == 10:
            run(spark, source, str(tmp_path / "checkpoint"), latest)
    with pytest.raises(Exception, match="comes after a later one"):
        run(spark, source, str(tmp_path / "checkpoint"), latest)
    assert latest == {"a": ("a", 1, 1, "x")}
