"""Named handlers that run on the rows of a stream's batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

Handler = Callable[[DataFrame], None]


class Handlers:
    """A registry of handlers by name; each gets the batch's rows that name it, as a DataFrame."""

    def __init__(self) -> None:
        self._known: dict[str, Handler] = {}

    def register(self, name: str) -> Callable[[Handler], Handler]:
        """Decorator; ValueError if the name is blank or taken."""

        def put(handler: Handler) -> Handler:
            if not name.strip() or name in self._known:
                raise ValueError(f"{name!r} is blank or registered already")
            self._known[name] = handler
            return handler

        return put

    def names(self) -> list[str]:
        return sorted(self._known)

    def run_batch(self, rows: DataFrame, column: str = "handler_name") -> None:
        """Runs every handler on its rows. A row that names no known handler is an error, before any handler runs."""
        unknown = rows.where(~F.coalesce(F.col(column).isin(self.names()), F.lit(False)))
        if first := unknown.select(column).head():
            raise LookupError(f"no handler {first[0]!r}")
        for name in self.names():
            self._known[name](rows.where(F.col(column) == name))

    def start(self, stream: DataFrame, checkpoint: str, column: str = "handler_name") -> StreamingQuery:
        """Runs handlers on each batch of what is there; a batch may run again after a failure, so handlers are to be idempotent."""
        writer = stream.writeStream.foreachBatch(lambda rows, _: self.run_batch(rows, column))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
