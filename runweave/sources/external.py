"""Another key-value store beside this one: operations go to a client made in each task.

No client comes with this package. connect is a function that returns an object with
insert(key, value), search(key) -> value or None, delete(key), scan(start, end) -> pairs and
close(); where none is given, opening fails with a plain message.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


class ExternalStore:
    def __init__(self, connect: Callable | None = None) -> None:
        if connect is None:
            raise RuntimeError("no client for an external store is installed")
        self.connect = connect

    def apply(self, log: DataFrame) -> int:
        """Applies the PUT and DELETE operations of a log in order of seq within each key; returns how many."""
        connect = self.connect

        def run(batches):
            client = connect()
            try:
                for batch in batches:
                    for key, op, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                        client.insert(key, value) if op == "PUT" else client.delete(key)
                    yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])
            finally:
                client.close()

        done = log.repartition("key").sortWithinPartitions("key", "seq").select("key", "op", "value").mapInArrow(run, "n bigint")
        return done.groupBy().sum("n").first()[0] or 0

    def search(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the keys that the store has."""
        connect = self.connect

        def run(batches):
            client = connect()
            try:
                for batch in batches:
                    found = [(k, client.search(k)) for k in batch.column(0).to_pylist()]
                    found = [(k, v) for k, v in found if v is not None]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.string())], names=["key", "value"])
            finally:
                client.close()

        return keys.select("key").distinct().mapInArrow(run, "key bigint, value string")

    def scan(self, start: int, end: int) -> list[tuple[int, str]]:
        client = self.connect()
        try:
            return list(client.scan(start, end))
        finally:
            client.close()
