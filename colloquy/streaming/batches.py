"""Micro-batches of predictions, scored as they come, and state inside a dialogue."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.memory import retrieve
from ..sources.writers import write_step


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Scores every micro-batch and writes its metrics as one step, so that a batch that is run again replaces itself.

    The stream's checkpoint says where to go on after a stop.  Returns the running query."""

    def each(batch: DataFrame, number: int) -> None:
        write_step(batch.sparkSession, score(batch), path, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MEMORY = "ord long, domains array<string>, step int"


def grow_memory(stream: DataFrame, k: int, memory: str, found: str, checkpoint: str, after: Callable[[int], None] | None = None):
    """A memory that grows while it is used: stream(query_id, domains, ord, success).

    Each micro-batch looks its queries up in what earlier batches have added, writes what it found below ``found``, and then adds its own
    successes below ``memory``.  Both are steps by the batch's number: batch i reads steps below i only, and a batch that runs again
    replaces what it had written, so that it sees and leaves the same whatever had been written when it failed.  ``after`` is
    called at the end of a batch.  Returns the running query; the stream's checkpoint says where to go on."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            known = spark.read.schema(MEMORY).option("basePath", memory).option("ignoreMissingFiles", "true").parquet(memory).where(F.col("step") < number)
            write_step(spark, retrieve(batch.select("query_id", "domains"), known.select("ord", "domains"), k), found, number)
        write_step(spark, batch.where("success").select("ord", "domains"), memory, number)
        if after:
            after(number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Carried(StatefulProcessor):
    """The domain and the last turn of a dialogue as a value, the domains that it has booked as a map; a timer closes it."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "domain string, seen long, timer long")
        self.booked = handle.getMapState("booked", "domain string", "utt_idx long")

    def handleInputRows(self, key, rows, timerValues):
        domain, seen, timer = self.now.get() if self.now.exists() else (None, None, None)
        frame, out = pd.concat(list(rows)).sort_values("utt_idx", kind="stable"), []
        for idx, act, booked in zip(frame["utt_idx"].tolist(), frame["act_domain"].tolist(), frame["booked"].tolist(), strict=True):
            named = act if isinstance(act, str) and act else None
            late = seen is not None and idx <= seen
            new = not late and booked is not None and bool(booked) and named is not None and not self.booked.containsKey((named,))
            if not late:
                domain, seen = named or domain, idx
            if new:
                self.booked.updateValue((named,), (idx,))
            out.append((key[0], idx, named or domain, named if new else None, late))
        if self.idle:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(timer)
        self.now.update((domain, seen, timer))
        yield pd.DataFrame(out, columns=["dialogue_id", "utt_idx", "current_domain", "booked_domain", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.now.clear()
        self.booked.clear()
        return iter(())

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_state(turns: DataFrame, idle: int = 0) -> DataFrame:
    """(dialogue_id, utt_idx, current_domain, booked_domain, late): the last act domain so far and a domain booked for the first
    time, of a stream of turns.

    The turns of a dialogue in one batch are taken in their order, however they come.  Between batches a value state has
    the domain and the last turn, a map state the booked domains, a key each, in a RocksDB store.  A turn that comes after a later one of its dialogue (in an
    earlier batch) is ``late``: it is answered by its own domain or the current one, books nothing and changes nothing.  A dialogue
    without turns for ``idle`` milliseconds is closed and its state dropped (0: never); what comes after that is a new dialogue.  With
    ``idle`` give the stream a trigger of processing time: batches go on, so that timers can fire, and an available-now one would not end."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = turns.schema["dialogue_id"].dataType.simpleString()
    out = f"dialogue_id {kind}, utt_idx long, current_domain string, booked_domain string, late boolean"
    return turns.groupBy("dialogue_id").transformWithStateInPandas(Carried(idle), out, "append", "ProcessingTime" if idle else "None")
