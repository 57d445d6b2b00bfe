"""Files that are still being written wait at a gate: keyed state with timers, in place of a driver that sleeps.

A key passes once its size has been the same `looks` times in a row after the first sight. Nothing is given up: a file
that grows for hours keeps its state, which the checkpoint holds, and passes when it rests. State with timers needs Spark's
RocksDB store, which the functions set for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from quirefold.sources.stores import opened

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def seen(size: int, before: tuple[int, int] | None) -> tuple[int, int]:
    """What is known after a look: the size, and how many looks in a row it was the same before."""
    return (size, before[1] + 1) if before is not None and before[0] == size else (size, 0)


def length_of(path: str) -> int | None:
    """A file's size now; None where it is gone."""
    store, at = opened(path)
    info = store.get_file_info(at)
    return info.size if info.is_file else None


class _Files(StatefulProcessor):
    """A timer a file: each time it fires the file is looked at."""

    def __init__(self, every: float, looks: int, look: Callable[[str], int | None]):
        self.every, self.looks, self.look = int(every * 1000), looks, look

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "length long, same int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for _ in rows:
            pass
        if not self.state.exists():
            length = self.look(key[0])
            if length is not None:
                self.state.update(seen(length, None))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        length = self.look(key[0])
        if length is None:
            self.state.clear()
            return
        now = seen(length, tuple(self.state.get()))
        if now[1] >= self.looks:
            self.state.clear()
            yield pd.DataFrame({"path": [key[0]], "length": [length]})
        else:
            self.state.update(now)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)

    def close(self) -> None:
        pass


class _Sightings(StatefulProcessor):
    """Sizes come as rows, in the order of `at` within a batch."""

    def __init__(self, looks: int):
        self.looks = looks

    def init(self, handle) -> None:
        self.state = handle.getValueState("seen", "length long, same int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.state.get()) if self.state.exists() else None
        for at, size in sorted((r for part in rows for r in zip(part["at"], part["size"], strict=True)), key=lambda r: r[0]):
            if now is not None and now[1] >= self.looks:
                break
            now = seen(int(size), now)
            if now[1] >= self.looks:
                yield pd.DataFrame({"key": [key[0]], "at": [at], "size": [int(size)]})
        if now is not None:
            self.state.update(now)

    def close(self) -> None:
        pass


def settled_files(files: DataFrame, every: float, looks: int = 2, look: Callable[[str], int | None] = length_of) -> DataFrame:
    """path and length of a stream of files (path) once they rest: looked at every so many seconds, by executors."""
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = _Files(every, looks, look)
    return files.select("path").groupBy("path").transformWithStateInPandas(processor, "path string, length long", "Append", "ProcessingTime")


def settled_sightings(rows: DataFrame, looks: int = 2) -> DataFrame:
    """key, at and size of the first sighting that finds a key's size as the `looks` before it did; of a stream of key
    (long), at (long, ascending from batch to batch) and size."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = rows.select("key", "at", "size").groupBy("key")
    return keyed.transformWithStateInPandas(_Sightings(looks), "key long, at long, size long", "Append", "None")
