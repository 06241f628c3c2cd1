"""Block events of sites: the last ones, how many count at a time, and both kept up by a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events of a site that are kept, and that are shown.
KEPT, SHOWN = 100, 10
#: Seconds for which a block counts.
TTL = 3_600
STATE = "ts timestamp, event_id bigint, url string"
OUTPUT = "site bigint, at timestamp, active int, last_ids string"


def block_events(events: DataFrame) -> DataFrame:
    """The ``events`` table as block events: what failed, by site."""
    return events.where("event_type = 'error'").select("event_id", "ts", F.col("user_id").alias("site"), F.concat(F.lit("/"), F.col("event_id")).alias("url"))


def recent_blocks(blocks: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(site, rank, event_id, ts, url): the last ``shown`` blocks of each site, the latest first, of equal times the
    greater id. The rank's limit is applied before the shuffle, so a hot site sends few rows from each task."""
    order = Window.partitionBy("site").orderBy(F.desc("ts"), F.desc("event_id"))
    return blocks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).select("site", "rank", "event_id", "ts", "url")


def active_blocks(blocks: DataFrame, ttl: int = TTL) -> DataFrame:
    """(site, event_id, ts, active): at each block, the blocks of its site in the ``ttl`` seconds up to it, both ends and
    those of the same time counted.

    Time is cut into stretches of ``ttl``; a row is also sent to the next one, where it is context only, so that a hot
    site is as many groups as stretches, each complete for a range frame.
    """
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    stretch = F.floor(second / (ttl * 1_000_000))
    rows = blocks.select("site", "event_id", "ts", second.alias("t"), F.explode(F.array(stretch, stretch + 1)).alias("part"), stretch.alias("own"))
    frame = Window.partitionBy("site", "part").orderBy("t").rangeBetween(-ttl * 1_000_000, 0)
    return rows.withColumn("active", F.count(F.lit(1)).over(frame)).where("part = own").select("site", "event_id", "ts", "active")


class BlockBoard(StatefulProcessor):
    """Per site the blocks that still count. A row is put out when blocks come and again when one expires, which a timer
    on event time does without any new event of the site. At most ``KEPT`` blocks of a site stay in its state."""

    def __init__(self, ttl: int = TTL, kept: int = KEPT, shown: int = SHOWN) -> None:
        self.ttl, self.kept, self.shown = ttl * 1_000, kept, shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", STATE)

    def _put_out(self, key: tuple, at: int) -> Any:
        import pandas as pd

        rows = [tuple(r) for r in self.blocks.get()] if self.blocks.exists() else []
        live = sorted((r for r in rows if _millis(r[0]) + self.ttl > at), key=lambda r: (_millis(r[0]), r[1]))
        if live:
            self.blocks.put(live)
        else:
            self.blocks.clear()
        ids = ",".join(str(r[1]) for r in live[-self.shown :][::-1])
        return pd.DataFrame({"site": [key[0]], "at": [pd.Timestamp(at, unit="ms")], "active": [len(live)], "last_ids": [ids]}).astype({"active": "int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        held = {r[1]: tuple(r) for r in self.blocks.get()} if self.blocks.exists() else {}
        for part in rows:
            for ts, event_id, url in zip(part["ts"], part["event_id"], part["url"], strict=True):
                held[event_id] = (ts.to_pydatetime(), int(event_id), url)  # a repeated event counts once
        last = sorted(held.values(), key=lambda r: (_millis(r[0]), r[1]))[-self.kept :]
        self.blocks.put(last)
        mark = timerValues.getCurrentWatermarkInMs()
        for r in last:
            if _millis(r[0]) + self.ttl > mark:
                self.handle.registerTimer(_millis(r[0]) + self.ttl)
        yield self._put_out(key, max(mark, _millis(last[-1][0])))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        yield self._put_out(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _millis(ts: Any) -> int:
    """Milliseconds of a time without a zone, which is UTC here."""
    import calendar

    return calendar.timegm(ts.timetuple()) * 1_000 + ts.microsecond // 1_000


def block_board(blocks: DataFrame, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """The streaming ``blocks(site, ts, event_id, url)`` -> (site, at, active, last_ids) by ``BlockBoard``. Needs the
    RocksDB state store; the session's time zone is taken to be UTC."""
    return (
        blocks.select("site", F.col("ts").cast("timestamp").alias("ts"), "event_id", "url").withWatermark("ts", late).groupBy("site")
        .transformWithStateInPandas(statefulProcessor=BlockBoard(ttl), outputStructType=OUTPUT, outputMode="update", timeMode="EventTime")
    )
