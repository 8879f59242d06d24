"""Freshness of running streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


def _time(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))


class FreshnessListener(StreamingQueryListener):
    """Keeps the newest event time of each stream with a watermark and calls ``alert(name, newest, age)`` once a batch
    for which that time is more than ``max_age`` older than the batch itself. A batch without rows moves nothing."""

    def __init__(self, max_age: dt.timedelta, alert: Callable[[str, dt.datetime, dt.timedelta], None]):
        self.max_age, self.alert, self.newest = max_age, alert, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        name = progress.name or str(progress.id)
        if "max" in progress.eventTime:
            seen = _time(progress.eventTime["max"])
            self.newest[name] = max(seen, self.newest.get(name, seen))
        if name in self.newest:
            age = _time(progress.timestamp) - self.newest[name]
            if age > self.max_age:
                self.alert(name, self.newest[name], age)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
