"""State that a stream keeps for each record between its batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keeps state on the executors' disks instead of their heap; ``transformWithState`` asks for it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Grown(StatefulProcessor):
    """Of a record's lines in a batch the last in the file; later batches must be longer than all before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.longest = handle.getValueState("longest", "chars bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.longest.get()[0] if self.longest.exists() else None
        last, most = None, before
        for row in rows:
            last = row if last is None or row["offset"] > last["offset"] else last
            most = row["_chars"] if most is None or row["_chars"] > most else most
        self.longest.update((most,))
        if before is None or last["_chars"] > before:
            yield last

    def close(self) -> None:
        pass


def grown_records(records: DataFrame) -> DataFrame:
    """A stream of records without those that an earlier batch had in full.

    ``records`` have ``file``, ``offset``, ``record_id`` and ``text``. Per record
    the state is one number, however many lines repeat it, and a batch only
    reads and writes the states of its own records. Records without an id are
    never repeated and pass without state.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    sized = records.withColumn("_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint"))
    kept = (
        sized.where("record_id is not null")
        .groupBy("file", "record_id")
        .transformWithState(Grown(), sized.schema, outputMode="Append", timeMode="None")
    )
    return kept.unionByName(sized.where("record_id is null")).drop("_chars")
