"""Resumable discovery: each request of a day is answered once, whatever is sent again and whenever the stream starts again."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ANSWER = "day string, attempt string, ranks array<int>, resumed int"
OUT = "query_group string, mode string, day string, kind string, attempt string, video_id string, rank int, query_text string, n int"
#: What Spark needs for state with timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ends(day: str, grace: float) -> int:
    """Milliseconds since 1970 of the end of a day, in UTC, and `grace` hours more."""
    end = datetime.combine(date.fromisoformat(day), datetime.min.time(), UTC) + timedelta(days=1, hours=grace)
    return int(end.timestamp() * 1000)


class _Requests(StatefulProcessor):
    """State of a (query group, mode): the answer taken for each open day, and the last day that is closed."""

    def __init__(self, grace: float):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day string", ANSWER)
        self.closed = handle.getValueState("closed", "day string")

    def _closed(self) -> str:
        return self.closed.get()[0] if self.closed.exists() else ""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed, out = self._closed(), []
        for (day, attempt), own in pd.concat(list(rows)).sort_values(["ts", "attempt", "rank"], kind="stable").groupby(["day", "attempt"], sort=False):
            if day <= closed:
                continue
            known = self.open.getValue((day,)) if self.open.containsKey((day,)) else None
            if known is None:
                own_done = own[own["status"] == "ok"]
                if not len(own_done):  # a request that the quota stopped is still to be made
                    continue
                known = (day, attempt, [], 0)
                self.handle.registerTimer(_ends(day, self.grace))
            _, taken, ranks, resumed = known
            ranks = list(ranks)
            if attempt != taken:
                resumed += 1
                out.append((*key, day, "resumed", attempt, None, None, None, 1))
            else:
                for r in own[own["status"] == "ok"].itertuples(index=False):
                    if r.rank not in ranks:
                        ranks.append(int(r.rank))
                        out.append((*key, day, "hit", attempt, r.video_id, int(r.rank), r.query_text, 1))
            self.open.updateValue((day,), (day, taken, ranks, resumed))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (day,) in sorted(tuple(k) for k in self.open.keys()):  # noqa: SIM118
            if _ends(day, self.grace) <= now:
                _, attempt, ranks, resumed = self.open.getValue((day,))
                out.append((*key, day, "closed", attempt, None, None, None, len(ranks)))
                self.open.removeKey((day,))
                self.closed.update((max(day, self._closed()),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def resumable(answers: DataFrame, delay: str = "1 hour", grace: float = 72) -> DataFrame:
    """(query_group, mode, day, kind, attempt, video_id, rank, query_text, n) from a stream of answers (query_group, mode, day, attempt, status, video_id, rank, query_text, ts).

    A request is a query group and mode on a day. The first attempt with a row of status `ok` is its answer: each of its ranks is a `hit`
    once, however often and in however many batches it comes. Rows of another attempt are none: the request was answered (`resumed`, a row for
    each batch and attempt). Attempts that the quota stopped (`quota`) answer nothing, and what other requests have found stays. `grace`
    hours after the day's end, by the watermark of ts, the day is `closed` with its number of hits; then only the day's date is kept,
    and rows of it or of days before are passed over for good, so a start at any later time repeats nothing. State is one date
    a request and at most one answer, some dozen ranks, for each open day. Days are UTC dates as text; needs the state store `STATE_STORE`.
    """
    rows = answers.select("query_group", "mode", "day", "attempt", "status", "video_id", "rank", "query_text", "ts").withWatermark("ts", delay)
    return rows.groupBy("query_group", "mode").transformWithStateInPandas(_Requests(grace), OUT, "Append", "eventTime")
