"""Operators over the log of edits and asks (X1, X2): the same results from a table and from a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from placewright.plans.tables import shared_dir

ACTIONS = ("add", "toggle", "veto", "delete")


def fold_log(log: DataFrame) -> DataFrame:
    """X1. log: game_id, question_id, ts, seq, action -> current state: game_id, question_id, active, vetoed.

    A question is there from its add on; each toggle turns it off or on, each veto likewise; after a delete it is gone,
    until it is added again. Only edits after the last add count. Sums and maxima only, so edits may come in any order.
    """
    at = F.struct("ts", "seq")
    last = lambda a: F.max(F.when(F.col("action") == a, at))
    base = log.groupBy("game_id", "question_id").agg(last("add").alias("added"), last("delete").alias("deleted"))
    base = base.where("added is not null and (deleted is null or deleted < added)").select("game_id", "question_id", "added")
    after = log.join(base, ["game_id", "question_id"]).where(at > F.col("added"))
    odd = lambda a: (F.count_if(F.col("action") == a) % 2 == 1).alias(a)
    edits = after.groupBy("game_id", "question_id").agg(odd("toggle"), odd("veto"))
    j = base.join(edits, ["game_id", "question_id"], "left")
    return j.select("game_id", "question_id", (~F.coalesce("toggle", F.lit(False))).alias("active"), F.coalesce("veto", F.lit(False)).alias("vetoed"))


class LogState:
    """X1 on a stream. `upsert` is a foreachBatch function: it adds a batch to the kept log and folds the batch's games anew.

    All is kept under `path` (default: a new folder in the shared one), nothing in the driver: a log, the games touched and
    their state, each by epoch. So a batch writes what it touches and no more, one that is delivered twice replaces its own
    epoch, and a stream that is started again with the same path and checkpoint goes on where it was.
    """

    def __init__(self, path: str | None = None) -> None:
        self.path = path
        self.spark: SparkSession | None = None

    def _write(self, df: DataFrame, table: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/epoch={epoch}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        self.spark = batch.sparkSession
        if self.path is None:
            self.path = f"{shared_dir(self.spark)}/log-state-{uuid.uuid4().hex}"
        self._write(batch, "log", epoch)
        self._write(self._read("log").where(F.col("epoch") == epoch).select("game_id").distinct(), "touched", epoch)
        touched = self._read("touched").where(F.col("epoch") == epoch).select("game_id")
        log = self._read("log").drop("epoch").join(touched, "game_id", "left_semi")
        self._write(fold_log(log.dropDuplicates(["game_id", "question_id", "ts", "seq", "action"])), "state", epoch)

    def state_of(self, spark: SparkSession) -> DataFrame:
        """The current state of all games: that of the last epoch which touched a game."""
        self.spark = spark
        last = self._read("touched").groupBy("game_id").agg(F.max("epoch").alias("epoch"))
        return self._read("state").join(last, ["game_id", "epoch"], "left_semi").drop("epoch")

    @property
    def state(self) -> DataFrame:
        return self.state_of(self.spark)


class _Ordinals(StatefulProcessor):
    """Holds the asks of a key (game, group) until the watermark has passed them, then numbers them in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbered = handle.getValueState("numbered", "n long")
        self.open = handle.getListState("open", "micros long, question_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for got in rows:
            for micros, question in zip(got["micros"].tolist(), got["question_id"].tolist()):
                self.open.appendValue((micros, question))
                self.handle.registerTimer(micros // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        asks = sorted(tuple(x) for x in self.open.get()) if self.open.exists() else []
        due, later = [x for x in asks if x[0] <= passed], [x for x in asks if x[0] > passed]
        if due:
            n = self.numbered.get()[0] if self.numbered.exists() else 0
            self.numbered.update((n + len(due),))
            self.open.put(later) if later else self.open.clear()
            yield pd.DataFrame({"game_id": key[0], "group_key": key[1], "question_id": [q for _, q in due], "ordinal": range(n + 1, n + len(due) + 1)})

    def close(self) -> None:
        pass


ORDINALS = "game_id long, group_key string, question_id long, ordinal long"


def running_ordinals(asks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """X2. asks (stream): game_id, group_key, question_id, created_at -> the ask's ordinal in its group, in order of time and id.

    An ask is numbered once the watermark has passed it, so asks that come up to `delay` late, in whatever order, get the
    ordinals that the window gives. Later ones are dropped by the watermark. The state of a group is one count and the asks
    that are still open; it needs the RocksDB state store.
    """
    timed = asks.withWatermark("created_at", delay).withColumn("micros", F.unix_micros("created_at"))
    return timed.groupBy("game_id", "group_key").transformWithStateInPandas(_Ordinals(), ORDINALS, "Append", "EventTime")


def running_ordinals_compat(asks: DataFrame) -> DataFrame:
    """X2 by applyInPandasWithState, where the state store of transformWithState isn't available: numbers asks as they arrive,
    which equals the window's ordinals if they arrive in order of time from one trigger to the next."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["created_at", "question_id"])
        n = state.get[0] if state.exists else 0
        state.update((n + len(got),))
        yield got.assign(ordinal=range(n + 1, n + len(got) + 1))[["game_id", "group_key", "question_id", "ordinal"]]

    return asks.groupBy("game_id", "group_key").applyInPandasWithState(step, ORDINALS, "n long", "append", "NoTimeout")
