"""User folds that are not aggregates: an ordered pass over the events of each key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered_fold(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[Any, dict], Any],
    finish: Callable[[Any], dict],
    schema: T.StructType | str,
    columns: Sequence[str],
) -> DataFrame:
    """Fold every key's events in order with ``step(state, event) -> state`` (``state`` starts as None).

    Spark partitions by key and sorts on disk where it must; the pass streams Arrow batches
    and holds the state of one key at a time, so a key of any size fits in memory.  Values keep
    their types: integers stay integers beside NULLs, and NULL is a key like any other.
    """
    names, wanted = list(keys), [*keys, *columns]
    result = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    layout = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[name] for name in names)
                if key != current:
                    if current is not None:
                        done.append({**dict(zip(names, current)), **finish(state)})
                    current, state = key, None
                state = step(state, row)
            if done:
                yield pa.RecordBatch.from_pylist(done, layout)
                done = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([{**dict(zip(names, current)), **finish(state)}], layout)

    pruned = events.select(*dict.fromkeys([*wanted, *order]))
    return pruned.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(run, result)


class _KeyedFold(StatefulProcessor):
    """State of one key: the order of its last event and what the events so far were folded to."""

    def __init__(self, keys, order, step, finish, encode, decode, columns):
        self.keys, self.order, self.step, self.finish = keys, order, step, finish
        self.encode, self.decode, self.columns = encode, decode, columns

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "last binary, state binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, state = None, None
        if self.kept.exists():
            stored = self.kept.get()
            last, state = pickle.loads(stored[0]), self.decode(stored[1])
        places = lambda event: tuple((event[name] is not None, event[name]) for name in self.order)
        for event in sorted((row.asDict() for row in rows), key=places):
            if last is not None and places(event) < last:
                raise ValueError(f"event of {dict(zip(self.keys, key))} comes after a later one was folded")
            last, state = places(event), self.step(state, event)
        self.kept.update((pickle.dumps(last), self.encode(state)))
        found = {**dict(zip(self.keys, key)), **self.finish(state)}
        yield Row(**{name: found[name] for name in self.columns})

    def close(self) -> None:
        pass


def ordered_fold_stream(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[Any, dict], Any],
    finish: Callable[[Any], dict],
    schema: T.StructType | str,
    columns: Sequence[str],
    encode: Callable[[Any], bytes] = pickle.dumps,
    decode: Callable[[bytes], Any] = pickle.loads,
) -> DataFrame:
    """``ordered_fold`` over a stream: every micro-batch gives the new result of each key it touches.

    Spark keeps a key's state in the (RocksDB) state store of the query's checkpoint, partitioned
    by key, so a restarted query goes on where it stopped and a lost executor's states are read
    from the checkpoint.  A key's events must come in order from batch to batch; inside a batch
    they are sorted, so a batch (``maxFilesPerTrigger``) bounds what a task holds of one key.  An
    event behind the last folded one stops the query, since its result would differ from the
    batch form's; an equal place is folded in the order of arrival.  Write the result in update
    mode, keyed by ``keys``.  ``encode`` and ``decode`` turn a state into bytes and back.

    Sets the session's state store to RocksDB, which stateful processors need; a query keeps
    the store its checkpoint was started with.
    """
    result = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fold = _KeyedFold(list(keys), list(order), step, finish, encode, decode, result.names)
    pruned = events.select(*dict.fromkeys([*keys, *columns, *order]))
    return pruned.groupBy(*keys).transformWithState(fold, result, "Update", "None")
