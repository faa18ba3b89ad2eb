"""Progress of running streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class StatusListener(StreamingQueryListener):
    """Calls back with the progress of each micro-batch as JSON text."""

    def __init__(self, callback: Callable[[str, str], None]):
        self._callback = callback

    def onQueryStarted(self, event) -> None:
        self._callback("started", f'{{"id":"{event.id}"}}')

    def onQueryProgress(self, event) -> None:
        self._callback("progress", event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._callback("terminated", f'{{"id":"{event.id}"}}')
