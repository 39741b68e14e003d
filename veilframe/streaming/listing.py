"""A folder of objects as a stream of names, in the order in which they appeared."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from veilframe.sources.stores import listed

LISTING_SCHEMA = "path string, file_name string, last_modified timestamp, length long"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
START = {"time": -(1 << 62), "name": ""}

PER_TASK = 10_000
"""Names that one task turns into rows."""


class ObjectListing(DataSource):
    """Objects below `root` as a stream; options `limit` (per batch) and `settle` (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        options = self.options
        return ListingReader(options["root"], int(options.get("limit", "100000")), float(options.get("settle", "2")))


class ListingReader(DataSourceStreamReader):
    """The offset is the time and name of the last object that was taken.

    Objects are taken in that order, so equal times are told apart by name and a batch may
    end between them. An object is taken only when its time lies `settle` seconds back: until
    then another of the same time may still appear under a smaller name.
    """

    def __init__(self, root: str, limit: int, settle: float) -> None:
        self.root, self.limit, self.settle = root.rstrip("/"), limit, settle
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return START

    def _after(self, start: dict, end: dict | None = None) -> list[tuple[int, str, int]]:
        low, high = (start["time"], start["name"]), end and (end["time"], end["name"])
        found = (entry for entry in listed(self.root) if low < entry[:2])
        return sorted(entry for entry in found if high is None or entry[:2] <= high)

    def latestOffset(self) -> dict:
        start = self.at or START
        now = datetime.now(timezone.utc) - timedelta(seconds=self.settle)
        newest = (now - EPOCH) // timedelta(microseconds=1)
        some = [entry for entry in self._after(start) if entry[0] <= newest][: self.limit]
        return {"time": some[-1][0], "name": some[-1][1]} if some else start

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = end  # after a restart this is called with the last offset of the checkpoint
        if start == end:
            return []
        found = self._after(start, end)  # bounded by the limit of a batch
        return [InputPartition(found[at : at + PER_TASK]) for at in range(0, len(found), PER_TASK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for time, name, length in partition.value:
            yield f"{self.root}/{name}", name, EPOCH + timedelta(microseconds=time), length


def stream_listing(spark: SparkSession, root: str, limit: int = 100_000, settle: float = 2.0) -> DataFrame:
    """path, file_name, last_modified, length of the objects below `root`, each once; no bytes are read.

    A batch has at most `limit` objects, oldest first. An object that is written anew has a
    new time and comes again. Names that start with `_` or `.` are skipped.
    """
    spark.dataSource.register(ObjectListing)
    reader = spark.readStream.format("object_listing").option("root", root)
    return reader.option("limit", str(limit)).option("settle", str(settle)).load()


def drained(start, most: int = 1_000_000) -> list[StreamingQuery]:
    """Run `start()` (a query that takes what is available) until a run finds nothing new.

    A run takes one batch of a listing.
    """
    runs = []
    while len(runs) < most:
        query = start()
        query.awaitTermination()
        runs.append(query)
        if not any(p["numInputRows"] for p in query.recentProgress):
            break
    return runs
