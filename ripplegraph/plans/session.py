"""One project's analyses: the last result kept, listeners told, work that can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from ripplegraph.model import Options
from ripplegraph.plans.engine import Engine, Result


class Session:
    """Runs one analysis at a time on an engine.

    The result of the last method is kept until another method, other options or another ``stamp`` (a number that
    grows whenever the facts change) is asked for. Results and lines of status go to whoever has subscribed.
    """

    def __init__(self, engine: Engine, stamp: Callable[[], int] = lambda: 0):
        self.engine, self.stamp = engine, stamp
        self._results: list[Callable[[Result], None]] = []
        self._status: list[Callable[[str, bool], None]] = []
        self._kept: tuple[tuple, Result] | None = None
        self._tag: str | None = None
        self._lock = threading.Lock()

    def subscribe(self, listener: Callable[[Result], None]) -> Callable[[], None]:
        """``listener`` gets every result, and the kept one at once; what is returned ends that."""
        self._results.append(listener)
        if self._kept:
            listener(self._kept[1])
        return lambda: self._results.remove(listener)

    def subscribe_status(self, listener: Callable[[str, bool], None]) -> Callable[[], None]:
        """``listener`` gets each line of status and whether work goes on; what is returned ends that."""
        self._status.append(listener)
        return lambda: self._status.remove(listener)

    def _tell(self, line: str, running: bool) -> None:
        for listener in list(self._status):
            listener(line, running)

    def analyze_method(self, key: str, options: Options | None = None) -> Result:
        """The result of one method, from the last run if nothing has changed since."""
        options = options or self.engine.options
        asked = (key, options if not options.service_mappings else repr(options), self.stamp())
        if self._kept is None or self._kept[0] != asked:
            found = self.engine.by_method(self.engine.spark.createDataFrame([(key,)], "value string"))
            self._kept = asked, self._run(f"分析 {key}", lambda: self.engine.analyze(found, options))
        for listener in list(self._results):
            listener(self._kept[1])
        return self._kept[1]

    def analyze_input(self, value: str, options: Options | None = None) -> Result:
        """The result of a path or a topic; never kept."""
        result = self._run(f"分析 {value}", lambda: self.engine.analyze(self.engine.by_input(value), options))
        for listener in list(self._results):
            listener(result)
        return result

    def _run(self, what: str, work: Callable[[], Result]) -> Result:
        with self._lock:
            context = self.engine.spark.sparkContext
            self._tag = f"session-{uuid.uuid4().hex}"
            context.addJobTag(self._tag)
            self._tell(what, True)
            try:
                result = work()
                told = result.resources.agg(F.count("*")).first()[0]
                self._tell(f"{what}：{told}", False)
                return result
            except Exception as error:
                self._tell(f"{what}：{str(error).splitlines()[0] if str(error) else type(error).__name__}", False)
                raise
            finally:
                context.removeJobTag(self._tag)
                self._tag = None

    def cancel(self) -> None:
        """End the analysis that runs now, from another thread; it raises there."""
        if tag := self._tag:
            self.engine.spark.sparkContext.cancelJobsWithTag(tag)
