"""Views that turn the given tables into objects, detections, frames and rasters.

`SQL` holds the same views for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.raster import scanlines
from veilframe.plans.scale import numbered, restricted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_objects(spark: SparkSession, d: str) -> DataFrame:
    return objects_of(table(spark, d, "orders"))


def objects_of(orders: DataFrame) -> DataFrame:
    """Objects from orders, which may be a stream or a batch of one."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    flight = F.concat(F.lit("flight_"), (customer % 20).cast("string"), F.lit("/"))
    folder = F.when(customer % 10 == 0, F.lit("00_UNSORTED/")).otherwise(flight)
    suffix = (
        F.when(key % 5 == 0, ".jpg").when(key % 5 == 1, ".JPG").when(key % 5 == 2, ".png")
        .when(key % 5 == 3, ".MP4").otherwise(".txt")
    )
    return orders.select(
        key.alias("image_id"),
        F.concat(folder, key.cast("string"), suffix).alias("file_name"),
        F.col("o_orderdate").alias("last_modified"),
        (F.floor("o_totalprice").cast("bigint") % 5000).alias("length"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / 1000.0).alias("altitude"),
    )


def v_log(spark: SparkSession, d: str) -> DataFrame:
    return v_objects(spark, d).where(F.col("image_id") % 7 == 0).select("file_name")


def v_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(
        F.col("r_regionkey").cast("int").alias("class_id"), F.col("r_name").alias("class_name")
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _scores() -> list[Column]:
    class_id = (F.col("l_linenumber") % 5).cast("int")
    return [class_id.alias("class_id"), (F.col("l_discount") * 10).alias("score")]


def _numbered_lines(spark: SparkSession, d: str, ids: DataFrame | None = None) -> DataFrame:
    """Order lines with their place in their order; only of the orders in `ids`, if there are any."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", *LINE_ORDER, "l_quantity", "l_discount", "l_tax"
    )
    if ids is not None:
        lines = restricted(lines, ids.select(F.col("image_id").alias("l_orderkey")), "l_orderkey")
    return numbered(lines, ["l_orderkey"], LINE_ORDER, "det_id", start=1)


def v_detections(spark: SparkSession, d: str) -> DataFrame:
    across, down = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    return _numbered_lines(spark, d).select(
        F.col("l_orderkey").alias("image_id"),
        F.col("det_id").cast("int").alias("det_id"),
        *_scores(),
        (across + F.col("l_tax")).alias("x0"),
        (down + F.col("l_tax")).alias("y0"),
        (across + F.col("l_quantity")).alias("x1"),
        (down + F.col("l_quantity") / 2).alias("y1"),
    )


def v_frames(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "ts", "event_id")
    return numbered(events, ["user_id"], ["ts", "event_id"], "n", start=0).select(
        F.col("user_id").alias("video_id"),
        F.concat(F.col("n").cast("string"), F.lit(".jpg")).alias("frame_name"),
        "event_id",
    )


def v_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("image_id"),
        (320 + F.col("p_partkey") % 1600).cast("int").alias("width"),
        (240 + (F.col("p_size") * 37) % 900).cast("int").alias("height"),
    )


def with_sizes(spark: SparkSession, d: str, df: DataFrame, key: str) -> DataFrame:
    """Add `width, height` of an image to every row: the sizes are dealt out by `key`."""
    sizes = v_sizes(spark, d).withColumnRenamed("image_id", "_size")
    return df.withColumn("_size", F.col(key) % sizes.count()).join(sizes, "_size").drop("_size")


def v_rasters(spark: SparkSession, d: str) -> DataFrame:
    """Packed one-channel 8x8 rasters."""
    level = F.transform(
        "embedding",
        lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5))).cast("int"),
    )
    side = F.lit(8)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        side.alias("width"),
        side.alias("height"),
        F.lit(1).alias("channels"),
        level.alias("pixels"),
    )


def _three_channels(rasters: DataFrame) -> DataFrame:
    shifted = F.flatten(
        F.transform("pixels", lambda v: F.array(v, (v + 40) % 256, (v + 80) % 256))
    )
    return rasters.withColumns({"channels": F.lit(3), "pixels": shifted})


def v_rasters3(spark: SparkSession, d: str) -> DataFrame:
    """The same rasters with three channels."""
    return _three_channels(v_rasters(spark, d))


def v_shots(spark: SparkSession, d: str) -> DataFrame:
    """A raster for every order, so that each box has one: the rasters are dealt out by id."""
    rasters = v_rasters(spark, d).withColumnRenamed("image_id", "_raster")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    dealt = orders.withColumn("_raster", F.col("image_id") % rasters.count())
    return dealt.join(rasters, "_raster").drop("_raster")


def v_scan(spark: SparkSession, d: str) -> DataFrame:
    return scanlines(v_rasters(spark, d))


def v_scan3(spark: SparkSession, d: str) -> DataFrame:
    return scanlines(v_rasters3(spark, d))


def v_shot_scan(spark: SparkSession, d: str) -> DataFrame:
    return scanlines(v_shots(spark, d))


def v_shot_scan3(spark: SparkSession, d: str) -> DataFrame:
    return scanlines(_three_channels(v_shots(spark, d)))


def v_boxes8(spark: SparkSession, d: str) -> DataFrame:
    """A non-empty box for every detection, on the 8x8 rasters of the orders."""
    return _boxes8(_numbered_lines(spark, d))


def _boxes8(lines: DataFrame, *more: Column) -> DataFrame:
    count = F.col("l_quantity").cast("bigint")
    left, top = F.col("l_partkey") % 6, F.col("l_suppkey") % 6
    return lines.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("det_id").cast("int").alias("det_id"),
        left.cast("int").alias("x0"),
        top.cast("int").alias("y0"),
        F.least(F.lit(8), left + 1 + count % 4).cast("int").alias("x1"),
        F.least(F.lit(8), top + 1 + count % 3).cast("int").alias("y1"),
        *more,
    )


def v_scored_boxes8(spark: SparkSession, d: str, ids: DataFrame | None = None) -> DataFrame:
    """The boxes with class and score of their detections, numbered once; only those of the images in `ids`."""
    lines = _numbered_lines(spark, d, ids).where("l_orderkey is not null")
    return _boxes8(lines, *_scores())


SQL = {
    "v_objects": """
        select o_orderkey as image_id,
          concat(case when o_custkey % 10 = 0 then '00_UNSORTED/'
                 else concat('flight_', cast(o_custkey % 20 as varchar), '/') end,
            cast(o_orderkey as varchar),
            case o_orderkey % 5 when 0 then '.jpg' when 1 then '.JPG' when 2 then '.png'
                 when 3 then '.MP4' else '.txt' end) as file_name,
          o_orderdate as last_modified, cast(floor(o_totalprice) as bigint) % 5000 as length,
          case when o_orderkey % 11 = 0 then null else o_totalprice / 1000.0 end as altitude
        from orders""",
    "v_log": "select file_name from v_objects where image_id % 7 = 0",
    "v_classes": "select cast(r_regionkey as int) as class_id, r_name as class_name from region",
    "v_detections": """
        select l_orderkey as image_id,
          cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as det_id,
          cast(l_linenumber % 5 as int) as class_id, l_discount * 10 as score,
          cast(l_partkey % 40 as double) + l_tax as x0, cast(l_suppkey % 40 as double) + l_tax as y0,
          cast(l_partkey % 40 as double) + l_quantity as x1,
          cast(l_suppkey % 40 as double) + l_quantity / 2 as y1
        from lineitem""",
    "v_frames": """
        select user_id as video_id,
          concat(cast(row_number() over (partition by user_id order by ts, event_id) - 1 as varchar),
            '.jpg') as frame_name, event_id
        from events""",
    "v_sizes": """
        select p_partkey as image_id, cast(320 + p_partkey % 1600 as int) as width,
          cast(240 + (p_size * 37) % 900 as int) as height
        from part""",
    "v_pixels": """
        select vec_id as image_id, cast((i - 1) // 8 as int) as y, cast((i - 1) % 8 as int) as x,
          cast(least(255, greatest(0, floor((cast(v as double) + 1) * 127.5))) as int) as v
        from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i
              from embeddings)""",
    "v_pixels3": """
        select image_id, c, y, x, cast((v + 40 * c) % 256 as int) as v
        from v_pixels, (select unnest([0, 1, 2]) as c)""",
    "v_shots": """
        select o.image_id, y, x, v
        from (select o_orderkey as image_id, o_orderkey % (select count(*) from embeddings) as raster
              from orders) o
        join v_pixels p on o.raster = p.image_id""",
    "v_shots3": """
        select image_id, c, y, x, cast((v + 40 * c) % 256 as int) as v
        from v_shots, (select unnest([0, 1, 2]) as c)""",
    "v_boxes8": """
        select l_orderkey as image_id,
          cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as det_id,
          cast(l_partkey % 6 as int) as x0, cast(l_suppkey % 6 as int) as y0,
          cast(least(8, l_partkey % 6 + 1 + cast(l_quantity as bigint) % 4) as int) as x1,
          cast(least(8, l_suppkey % 6 + 1 + cast(l_quantity as bigint) % 3) as int) as y1
        from lineitem""",
}


def with_views(body: str) -> str:
    """Prefix a query with the views it names, in the order of their definition.

    A query that starts with its own `with` list continues the list.
    """
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(SQL[name])
                needed.append(name)

    need(body)
    views = ", ".join(f"{name} as ({SQL[name].strip()})" for name in needed)
    text = body.strip()
    if not views:
        return text
    if text.lower().startswith("with recursive"):
        return f"with recursive {views}, {text[len('with recursive'):]}"
    if text.lower().startswith("with"):
        return f"with {views}, {text[len('with'):]}"
    return f"with {views} {text}"
