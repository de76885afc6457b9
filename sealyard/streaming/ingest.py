"""A stream of puts into a ledger: each micro-batch is one append, first writers win over all history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..ledger import Ledger


def append_stream(stream: DataFrame, ledger: Ledger, checkpoint: str, by: str = "timestamp", seal: bool = True, **trigger) -> StreamingQuery:
    """stream has key, value and timestamp. A batch that is run again after a failure adds nothing: its keys are known by then.

    Blocks are sealed as they fill. trigger: as for DataStreamWriter.trigger; all that is there, then stop, if none is given.
    """

    def add(batch: DataFrame, _: int) -> None:
        ledger.append(batch, by)
        if seal:
            ledger.seal()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
