"""Bytes of chosen objects, and of no others.

The chosen objects are written as a plan, packed so that each part has about the same
number of bytes. A part is a task: it reads its own list and opens just those objects. The
driver knows how many parts there are and nothing else, and no bytes are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from veilframe.plans.scale import packed_parts, work_dir
from veilframe.sources.stores import content_of, located

PART_BYTES = 256 << 20
"""Bytes of objects that a task reads."""

OPEN_BYTES = 1 << 16
"""What opening an object counts as, so that a task does not get too many small ones."""

PART = "_plan_part"
"""The column of a plan that names the task."""

BATCH_BYTES = 32 << 20
"""Bytes that a task hands over at once; a larger object goes alone."""


class ObjectBytes(DataSource):
    """The rows of a plan with the bytes at `path` as their last column, `content`."""

    @classmethod
    def name(cls) -> str:
        return "object_bytes"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ObjectReader(self.options["plan"], int(self.options["parts"]), schema)


class ObjectReader(DataSourceReader):
    def __init__(self, plan: str, parts: int, schema: T.StructType) -> None:
        self.plan, self.parts, self.schema = plan, parts, schema

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(number) for number in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        system, folder = located(f"{self.plan}/{PART}={partition.value}")
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        for file in sorted(info.path for info in found if info.path.endswith(".parquet")):
            with system.open_input_file(file) as stream:
                for rows in pq.ParquetFile(stream).iter_batches():
                    yield from with_content(rows, shape)


def with_content(rows: pa.RecordBatch, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows with the bytes of their objects, in batches of bounded size."""
    columns = [rows.column(field.name).cast(field.type) for field in list(shape)[:-1]]
    start, held, size = 0, [], 0
    for path in [*rows.column("path").to_pylist(), None]:
        last = start + len(held) == rows.num_rows
        if held and (size >= BATCH_BYTES or last):
            some = [column.slice(start, len(held)) for column in columns]
            yield pa.RecordBatch.from_arrays([*some, pa.array(held, shape[-1].type)], schema=shape)
            start, held, size = start + len(held), [], 0
        if not last:
            held.append(None if path is None else content_of(path))
            size += len(held[-1] or b"")


def fetched(objects: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add `content` to objects (`path`, perhaps `length`, and anything else).

    Objects that are gone, or have no path, have null content. An empty table opens nothing.
    The plan, names without bytes, stays in the shared folder.
    """
    spark = objects.sparkSession
    length = F.coalesce(F.col("length").cast("long"), F.lit(0)) if "length" in objects.columns else F.lit(0)
    plan = work_dir(spark, "plan")
    dealt, total = packed_parts(objects, ["path"], length + F.lit(OPEN_BYTES), part_bytes, PART)
    if not total:
        return objects.withColumn("content", F.lit(None).cast("binary"))
    dealt.write.partitionBy(PART).parquet(plan)
    schema = T.StructType([*objects.schema.fields, T.StructField("content", T.BinaryType())])
    spark.dataSource.register(ObjectBytes)
    reader = spark.read.format("object_bytes").schema(schema).option("plan", plan)
    return reader.option("parts", str(total // part_bytes + 1)).load()
