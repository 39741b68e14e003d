"""Named queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import geometry as G
from veilframe.functions import labels as L
from veilframe.functions import paths as P
from veilframe.model import LOG_SCHEMA, Options
from veilframe.operators import detections as D
from veilframe.operators import frames as V
from veilframe.operators import overlap, raster, runlog, waves
from veilframe.operators import selection as S
from veilframe.operators.scoring import score
from veilframe.plans import fixtures as X
from veilframe.plans.detector import detector
from veilframe.plans.flows import choose_work, image_log, image_run, publish_videos, video_run
from veilframe.plans.scale import tidy, work_dir, written
from veilframe.sources import batches, logs, objects, sinks, tables
from veilframe.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BLUR = ("ASIA", "EUROPE")
DRAW = ("ASIA", "EUROPE", "AMERICA")
OPTIONS = Options(
    blur_classes=BLUR, min_altitude=200.0, kernel=5, lookback=timedelta(hours=3000)
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = tidy(run)
        if sql is not None:
            ORACLES[name] = X.with_views(sql)
        return run

    return add


def as_of(spark: SparkSession, d: str) -> Column:
    """The newest object time, as the moment of the run."""
    newest: datetime = X.table(spark, d, "orders").agg(F.max("o_orderdate")).first()[0]
    return F.to_timestamp_ntz(F.lit(newest.isoformat(sep=" ")))


# --- sources and sinks -------------------------------------------------------------


def _export_pages(spark: SparkSession, d: str) -> str:
    """The pages as text objects, one in each of up to 100 folders, in the shared folder."""
    root = work_dir(spark, "pages")
    pages = X.table(spark, d, "pages").select("page_id", "html", (F.col("page_id") % 100).alias("part"))
    dealt = pages.repartition("part").sortWithinPartitions("part", "page_id")
    dealt.select("html", "part").write.partitionBy("part").text(root)
    return root


OBJECT_SQL = """select concat('part=', cast(page_id % 100 as varchar)) as folder, page_id,
    string_agg(html || chr(10), '' order by page_id) over (partition by page_id % 100) as body from pages"""


@query(
    "s1_objects",
    f"select distinct folder, strlen(body) as length, true as named from ({OBJECT_SQL})",
)
def s1_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each object with its length, and whether its name, path and time fit together."""
    listing = objects.scan_objects(spark, _export_pages(spark, d))
    named = F.endswith("path", F.concat(F.lit("/"), F.col("file_name"))) & F.col("last_modified").isNotNull()
    return listing.select(F.split("file_name", "/")[0].alias("folder"), "length", named.alias("named"))


@query(
    "s2_content",
    f"""select folder, max(case when page_id % 2 = 0 then md5(body) end) as md5 from ({OBJECT_SQL}) group by folder""",
)
def s2_content(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of every second object; the others are no candidates."""
    root = _export_pages(spark, d)
    listing = objects.scan_objects(spark, root)
    folder = F.split("file_name", "/")[0]
    wanted = F.split(folder, "=")[1].cast("int") % 2 == 0
    loaded = objects.load_content(spark, listing.where(wanted), root)
    both = loaded.unionByName(listing.where(~wanted), allowMissingColumns=True)
    return both.select(folder.alias("folder"), F.md5("content").alias("md5"))


@query(
    "s7_log_append",
    """select file_name, length, case when altitude is null then null else altitude end as altitude
       from v_objects where altitude is null or altitude is not null""",
)
def s7_log_append(spark: SparkSession, d: str) -> DataFrame:
    """Two appends, the second with one more column; readers merge them."""
    path = work_dir(spark, "log")
    items = X.v_objects(spark, d).select("file_name", "length", "altitude")
    logs.append_log_path(items.where(F.col("altitude").isNull()).drop("altitude"), path)
    logs.append_log_path(items.where(F.col("altitude").isNotNull()), path)
    return logs.read_log_path(spark, path).select("file_name", "length", "altitude")


@query(
    "s8_replace",
    """select file_name, case when altitude < 100 then length + 1 else length end as length
       from v_objects""",
)
def s8_replace(spark: SparkSession, d: str) -> DataFrame:
    """Low objects are rewritten over their first version; the others stay."""
    path = work_dir(spark, "objects")
    items = X.v_objects(spark, d).select("file_name", "length", "altitude")
    sinks.replace_by_key(items.drop("altitude"), path, "file_name", buckets=16)
    low = items.where(F.col("altitude") < 100).select("file_name", (F.col("length") + 1).alias("length"))
    sinks.replace_by_key(low, path, "file_name", buckets=16)
    return spark.read.parquet(path).select("file_name", "length")


@query("s11_quarantine", "select file_name from v_objects where length < 1024")
def s11_quarantine(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark, "bad")
    checked = S.classify(X.v_objects(spark, d), signature=False)
    sinks.write_quarantine(runlog.quarantined(checked), path)
    return spark.read.text(path).withColumnRenamed("value", "file_name")


@query(
    "s12_layout",
    """select regexp_replace(file_name, '[^/]*$', '') as dir, file_name, length from v_objects""",
)
def s12_layout(spark: SparkSession, d: str) -> DataFrame:
    """Each object with the folder that it lies in."""
    path = work_dir(spark, "layout")
    sinks.write_by_folder(X.v_objects(spark, d).select("file_name", "length"), path)
    return spark.read.parquet(path).select("dir", "file_name", "length")


def _export_by_folder(spark: SparkSession, d: str) -> str:
    """The pages as text objects in four folders."""
    root = work_dir(spark, "folders")
    pages = X.table(spark, d, "pages").select("html", (F.col("page_id") % 4).alias("part"))
    pages.write.partitionBy("part").text(root)
    return root


FOLDER_SQL = """select concat('part=', cast(page_id % 4 as varchar)) as folder,
    cast(sum(strlen(html) + 1) as bigint) as bytes from pages group by 1"""


@query("s3_relative_path", FOLDER_SQL)
def s3_relative_path(spark: SparkSession, d: str) -> DataFrame:
    """Bytes per first folder of the names below the root."""
    listing = objects.scan_objects(spark, _export_by_folder(spark, d))
    folder = F.split("file_name", "/")[0].alias("folder")
    return listing.groupBy(folder).agg(F.sum("length").cast("bigint").alias("bytes"))


@query("s4_frame_folder", FOLDER_SQL)
def s4_frame_folder(spark: SparkSession, d: str) -> DataFrame:
    """Each folder scanned by itself; the names are those of the objects in it."""
    root = _export_by_folder(spark, d)
    scans = [objects.scan_frames(spark, f"{root}/part={n}", "*.txt") for n in range(4)]
    both = reduce(DataFrame.unionByName, scans).where(F.endswith("frame_name", F.lit(".txt")))
    folder = F.element_at(F.split("path", "/"), -2).alias("folder")
    return both.groupBy(folder).agg(F.sum("length").cast("bigint").alias("bytes"))


@query("s5_log_table", "select file_name from v_objects")
def s5_log_table(spark: SparkSession, d: str) -> DataFrame:
    """A catalog table that is made by the first append and gets a column by the second."""
    name = f"log_{uuid.uuid4().hex}"
    items = X.v_objects(spark, d).select("file_name", "length", "altitude")
    if not logs.read_log(spark, name).isEmpty():
        raise ValueError("a log that does not exist is not empty")
    logs.append_log(items.where(F.col("altitude").isNull()).drop("altitude"), name)
    logs.append_log(items.where(F.col("altitude").isNotNull()), name)
    return logs.read_log(spark, name)


@query(
    "s6_stored_detections",
    """select cast(image_id as varchar) as image_path, class_id, class_name, cast(x0 as int) as x0,
         cast(y0 as int) as y0, cast(x1 as int) as x1, cast(y1 as int) as y1
       from v_boxes8 join (select image_id, det_id, class_id from v_detections) using (image_id, det_id)
       join v_classes using (class_id)""",
)
def s6_stored_detections(spark: SparkSession, d: str) -> DataFrame:
    """Published detection records, stored and read by their schema."""
    path = work_dir(spark, "detections")
    boxes = D.name_classes(X.v_scored_boxes8(spark, d), X.v_classes(spark, d))
    D.detection_rows(boxes.withColumn("image_path", F.col("image_id").cast("string"))).write.parquet(path)
    return tables.read_detections(spark, path).drop("base_image", "score")


@query("s9_write_once", "select file_name, length from v_objects")
def s9_write_once(spark: SparkSession, d: str) -> DataFrame:
    """Objects are written once and others added once; a repetition of either is refused."""
    path = work_dir(spark, "once")
    items = X.v_objects(spark, d).select("file_name", "length")
    large = items.where(F.col("length") >= 1024)
    sinks.write_once(large, path)
    sinks.add_once(items.where(F.col("length") < 1024), path, "file_name")
    for again in (lambda: sinks.write_once(large, path), lambda: sinks.add_once(large, path, "file_name")):
        try:
            again()
        except (AnalysisException, ValueError):
            continue
        raise ValueError("a second write went through")
    return spark.read.parquet(path)


@query(
    "s10_reload",
    """select video_id, frame_name, event_id + case when video_id % 3 = 0 then 1 else 0 end as event_id
       from v_frames where video_id % 3 <> 0 or event_id % 2 = 0""",
)
def s10_reload(spark: SparkSession, d: str) -> DataFrame:
    """Every third video is reloaded with half its frames; the others stay."""
    path = work_dir(spark, "frames")
    frames = X.v_frames(spark, d)
    sinks.reload_frames(frames, path)
    some = frames.where("video_id % 3 = 0 and event_id % 2 = 0")
    sinks.reload_frames(some.withColumn("event_id", F.col("event_id") + 1), path)
    back = spark.read.parquet(path)
    return back.select(F.col("video_id").cast("bigint").alias("video_id"), "frame_name", "event_id")


# --- selection ---------------------------------------------------------------------

IMAGE_SQL = """(lower(file_name) like '%.jpg' or lower(file_name) like '%.jpeg'
    or lower(file_name) like '%.png')"""
RECENT_SQL = """last_modified is not null and last_modified >=
    (select max(o_orderdate) from orders) - interval 3000 hour"""
CANDIDATE_SQL = f"""select * from v_objects where {IMAGE_SQL}
    and position('00_UNSORTED' in file_name) = 0 and {RECENT_SQL}
    and file_name not in (select file_name from v_log)"""


@query("p1_image_suffix", f"select image_id, file_name from v_objects where {IMAGE_SQL}")
def p1_image_suffix(spark: SparkSession, d: str) -> DataFrame:
    return X.v_objects(spark, d).where(P.is_image("file_name")).select("image_id", "file_name")


@query(
    "p2_video_suffix",
    """select image_id, file_name from v_objects
       where regexp_matches(file_name, '\\.(MP4|mp4|AVI|avi|MOV|mov)$')""",
)
def p2_video_suffix(spark: SparkSession, d: str) -> DataFrame:
    return X.v_objects(spark, d).where(P.is_video("file_name")).select("image_id", "file_name")


@query(
    "p3_exclude",
    "select image_id, file_name from v_objects where position('00_UNSORTED' in file_name) = 0",
)
def p3_exclude(spark: SparkSession, d: str) -> DataFrame:
    kept = X.v_objects(spark, d).where(S.not_excluded("file_name", OPTIONS.exclude))
    return kept.select("image_id", "file_name")


@query("p4_recent", f"select image_id, file_name from v_objects where {RECENT_SQL}")
def p4_recent(spark: SparkSession, d: str) -> DataFrame:
    test = S.recent("last_modified", as_of(spark, d), OPTIONS.lookback)
    return X.v_objects(spark, d).where(test).select("image_id", "file_name")


@query("p5_candidates", f"select image_id, file_name from ({CANDIDATE_SQL})")
def p5_candidates(spark: SparkSession, d: str) -> DataFrame:
    chosen = S.candidates(
        X.v_objects(spark, d), X.v_log(spark, d), as_of(spark, d), OPTIONS.lookback, OPTIONS.exclude
    )
    return chosen.select("image_id", "file_name")


@query("p6_min_size", "select image_id, length from v_objects where length >= 1024")
def p6_min_size(spark: SparkSession, d: str) -> DataFrame:
    return X.v_objects(spark, d).where(S.large_enough(1024)).select("image_id", "length")


CHECKED_SQL = """(select file_name, case when image_id % 13 = 0 then 'missing' when length < 1024 then 'too small'
    when image_id % 3 = 2 then 'unreadable' end as reason from v_objects)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Objects with leading bytes: some have gone, some are of no known format."""
    gone, heads = F.col("image_id") % 13 == 0, F.array(*[F.lit(bytes.fromhex(h)) for h in ("FFD8FFE0", "89504E470D0A1A0A", "4749463839")])
    content = F.get(heads, (F.col("image_id") % 3).cast("int"))
    objects_ = X.v_objects(spark, d).withColumns(
        {"content": F.when(~gone, content), "length": F.when(~gone, F.col("length"))}
    )
    return S.classify(objects_)


@query("p7_quarantine", f"select file_name, reason from {CHECKED_SQL} where reason is not null")
def p7_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return runlog.quarantined(_checked(spark, d))


@query("p8_has_altitude", "select image_id, altitude from v_objects where altitude is not null")
def p8_has_altitude(spark: SparkSession, d: str) -> DataFrame:
    return S.with_altitude(X.v_objects(spark, d)).select("image_id", "altitude")


@query(
    "p9_route",
    """select image_id, case when altitude < 200 then 'redact' else 'pass' end as route
       from v_objects where altitude is not null""",
)
def p9_route(spark: SparkSession, d: str) -> DataFrame:
    routed = S.route(S.with_altitude(X.v_objects(spark, d)), OPTIONS.min_altitude)
    return routed.select("image_id", "route")


@query(
    "p10_class_filter",
    """select image_id, det_id, class_name, class_name in ('ASIA', 'EUROPE') as blur
       from v_detections join v_classes using (class_id)
       where class_name in ('ASIA', 'EUROPE', 'AMERICA')""",
)
def p10_class_filter(spark: SparkSession, d: str) -> DataFrame:
    named = D.name_classes(X.v_detections(spark, d), X.v_classes(spark, d))
    drawn = named.where(S.on_list("class_name", DRAW))
    blur = S.on_list("class_name", BLUR).alias("blur")
    return drawn.select("image_id", "det_id", "class_name", blur)


@query("p11_confidence", "select image_id, det_id, score from v_detections where score >= 0.15")
def p11_confidence(spark: SparkSession, d: str) -> DataFrame:
    return X.v_detections(spark, d).where(D.confident(0.15)).select("image_id", "det_id", "score")


@query(
    "p13_valid_boxes",
    """select image_id, det_id, cast(trunc(x0) as int) as x0, cast(trunc(y0) as int) as y0,
         cast(trunc(x1) as int) as x1, cast(trunc(y1) as int) as y1
       from v_detections where trunc(x1) > trunc(x0) and trunc(y1) > trunc(y0)""",
)
def p13_valid_boxes(spark: SparkSession, d: str) -> DataFrame:
    return D.valid_boxes(X.v_detections(spark, d)).select("image_id", "det_id", *G.CORNERS)


@query(
    "p13_rejected_boxes",
    """select image_id, det_id from v_detections
       where trunc(x1) <= trunc(x0) or trunc(y1) <= trunc(y0)""",
)
def p13_rejected_boxes(spark: SparkSession, d: str) -> DataFrame:
    return D.rejected_boxes(X.v_detections(spark, d)).select("image_id", "det_id")


def _published(spark: SparkSession, d: str) -> DataFrame:
    """Detections with class name and image path."""
    named = D.name_classes(X.v_detections(spark, d), X.v_classes(spark, d))
    paths = X.v_objects(spark, d).select("image_id", F.col("file_name").alias("image_path"))
    return named.join(paths, "image_id")


@query(
    "p14_detection_rows",
    """select file_name as image_path, regexp_extract(file_name, '[^/]*$') as base_image, class_id,
         class_name, cast(trunc(x0) as int) as x0, cast(trunc(y0) as int) as y0,
         cast(trunc(x1) as int) as x1, cast(trunc(y1) as int) as y1,
         cast(printf('%.2f', score) as double) as score
       from v_detections join v_classes using (class_id) join v_objects using (image_id)""",
)
def p14_detection_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.detection_rows(_published(spark, d))


@query(
    "p16_missing",
    f"select file_name from v_objects where not ({IMAGE_SQL})",
)
def p16_missing(spark: SparkSession, d: str) -> DataFrame:
    listing = X.v_objects(spark, d)
    return S.missing_inputs(listing.select("file_name"), listing.where(P.is_image("file_name")))


# --- joins -------------------------------------------------------------------------


@query(
    "j1_unprocessed",
    """select image_id, file_name from v_objects
       where file_name not in (select file_name from v_log)""",
)
def j1_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    left = S.unprocessed(X.v_objects(spark, d), X.v_log(spark, d))
    return left.select("image_id", "file_name")


@query(
    "j2_class_names",
    """select image_id, det_id, class_id, class_name
       from v_detections join v_classes using (class_id)""",
)
def j2_class_names(spark: SparkSession, d: str) -> DataFrame:
    named = D.name_classes(X.v_detections(spark, d), X.v_classes(spark, d), strict=True)
    return named.select("image_id", "det_id", "class_id", "class_name")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return X.v_detections(spark, d).select("image_id", "det_id", "score")


SCORED_SQL = "(select image_id, det_id, score from v_detections)"


@query(
    "j3_inner",
    f"select image_id, file_name, det_id, score from v_objects join {SCORED_SQL} using (image_id)",
)
def j3_inner(spark: SparkSession, d: str) -> DataFrame:
    images = X.v_objects(spark, d).select("image_id", "file_name")
    joined = D.images_with_boxes(images, _scored(spark, d), keep_empty=False)
    return joined.select("image_id", "file_name", "det_id", "score")


@query(
    "j3_left",
    f"select image_id, file_name, det_id, score from v_objects left join {SCORED_SQL} using (image_id)",
)
def j3_left(spark: SparkSession, d: str) -> DataFrame:
    images = X.v_objects(spark, d).select("image_id", "file_name")
    joined = D.images_with_boxes(images, _scored(spark, d), keep_empty=True)
    return joined.select("image_id", "file_name", "det_id", "score")


@query(
    "j4_pixels_in_boxes",
    """select p.image_id, b.det_id, p.y, p.x, p.v from v_shots p join v_boxes8 b
       on p.image_id = b.image_id and p.x >= b.x0 and p.x < b.x1 and p.y >= b.y0 and p.y < b.y1""",
)
def j4_pixels_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    hit = raster.pixels_in_boxes(X.v_shot_scan(spark, d), X.v_boxes8(spark, d))
    return hit.select("image_id", "det_id", "y", "x", "v")


@query(
    "j5_metadata",
    """select o.file_name, o.length, m.altitude from v_objects o
       left join (select * from v_objects where altitude is not null) m using (file_name)""",
)
def j5_metadata(spark: SparkSession, d: str) -> DataFrame:
    listing = X.v_objects(spark, d)
    known = S.with_altitude(listing).select("file_name", "altitude")
    return S.with_metadata(listing.select("file_name", "length"), known)


PAIR_SQL = """
    with shapes as (
      select image_id, class_id, x0, y0, x1, y1, min(det_id) as det_id, count(*) as copies
      from v_detections where x1 > x0 and y1 > y0 group by all),
    cand as (
      select a.image_id, a.class_id, a.det_id as det_a, b.det_id as det_b,
        greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0)
          * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as inter,
        (a.x1 - a.x0) * (a.y1 - a.y0) as area_a, (b.x1 - b.x0) * (b.y1 - b.y0) as area_b,
        a.copies * b.copies as pairs
      from shapes a join shapes b
      on a.image_id = b.image_id and a.class_id = b.class_id and a.det_id < b.det_id)
    select image_id, class_id, det_a, det_b, inter / (area_a + area_b - inter) as iou, pairs
    from cand where inter > 0.4::double * (area_a + area_b - inter)
    union all
    select image_id, class_id, det_id, det_id, 1.0::double, copies * (copies - 1) // 2
    from shapes where copies > 1"""


@query("j6_iou_pairs", PAIR_SQL)
def j6_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.iou_pairs(X.v_detections(spark, d), 0.4)


@query(
    "j6_partners",
    """with pair as (
         select a.image_id, a.class_id, a.det_id, b.det_id as other,
           greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as common,
           (a.x1 - a.x0) * (a.y1 - a.y0) as one, (b.x1 - b.x0) * (b.y1 - b.y0) as two
         from v_detections a join v_detections b
         on a.image_id = b.image_id and a.class_id = b.class_id and a.det_id <> b.det_id),
       hit as (select *, common / (one + two - common) as iou from pair where common > 0.4::double * (one + two - common)),
       best as (
         select image_id, class_id, det_id, count(*) as partners, arg_min(other, (-iou, other)) as best_id, max(iou) as best_iou
         from hit group by all)
       select d.image_id, d.class_id, d.det_id, coalesce(partners, 0) as partners, best_id, best_iou
       from v_detections d left join best using (image_id, class_id, det_id) where d.x1 > d.x0 and d.y1 > d.y0""",
)
def j6_partners(spark: SparkSession, d: str) -> DataFrame:
    """Per box, how many boxes it overlaps with and the one it overlaps with most."""
    return overlap.partner_counts(X.v_detections(spark, d), 0.4)


# --- aggregations ------------------------------------------------------------------


@query(
    "a1_blurred_objects",
    """select image_id, cast(count(b.det_id) as int) as blurred_objects
       from v_objects left join (
         select image_id, det_id from v_detections join v_classes using (class_id)
         where class_name in ('ASIA', 'EUROPE') and score >= 0.15) b using (image_id)
       group by image_id""",
)
def a1_blurred_objects(spark: SparkSession, d: str) -> DataFrame:
    boxes = X.v_detections(spark, d).where(D.confident(0.15))
    images = X.v_objects(spark, d).select("image_id")
    return D.blurred_per_image(images, boxes, X.v_classes(spark, d), BLUR)


MINIMUM_SQL = f"""
    select file_name, (select max(o_orderdate) from orders) as datetime,
      blurred_objects > 0 as blurred, blurred_objects
    from (select c.file_name, cast(count(b.det_id) as int) as blurred_objects
          from ({CANDIDATE_SQL}) c left join (
            select image_id, det_id from v_detections join v_classes using (class_id)
            where class_name in ('ASIA', 'EUROPE') and score >= 0.15) b
          on c.image_id = b.image_id and c.altitude < 200
          where c.length >= 1024 and c.altitude is not null group by c.file_name)"""


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and log rows of a run over the given tables."""
    stamp = as_of(spark, d)
    work = choose_work(X.v_objects(spark, d), X.v_log(spark, d), stamp, OPTIONS)
    rows = image_log(
        work, X.v_detections(spark, d), X.v_classes(spark, d), stamp, OPTIONS, suppress=False
    )
    return work.candidates, rows


@query("a2_log_rows", MINIMUM_SQL)
def a2_log_rows(spark: SparkSession, d: str) -> DataFrame:
    """Which new images need redaction, and how many objects are in each."""
    rows = _log(spark, d)[1]
    return rows.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query(
    "a3_run_summary",
    f"""select (select count(*) from ({CANDIDATE_SQL})) as processed,
          cast(count(*) filter (blurred) as bigint) as images_blurred,
          cast(coalesce(sum(blurred_objects), 0) as bigint) as objects_blurred
        from ({MINIMUM_SQL})""",
)
def a3_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return runlog.run_summary(*_log(spark, d))


@query(
    "a4_quarantine_counts",
    f"select reason, count(*) as objects from {CHECKED_SQL} where reason is not null group by reason",
)
def a4_quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    return runlog.quarantine_counts(_checked(spark, d))


@query(
    "a5_distinct_images",
    "select distinct file_name as image_path from v_detections join v_objects using (image_id)",
)
def a5_distinct_images(spark: SparkSession, d: str) -> DataFrame:
    ids = X.v_detections(spark, d).select("image_id").distinct()
    paths = X.v_objects(spark, d).select("image_id", F.col("file_name").alias("image_path"))
    return D.distinct_images(paths.join(ids, "image_id", "left_semi"))


@query(
    "a6_box_counts",
    """select count(*) as boxes, count(*) filter (score >= 0.15) as kept,
         count(distinct class_id) as classes from v_detections""",
)
def a6_box_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.box_counts(X.v_detections(spark, d), D.confident(0.15))


@query("a7_frames_per_video", "select video_id, count(*) as frames from v_frames group by video_id")
def a7_frames_per_video(spark: SparkSession, d: str) -> DataFrame:
    return V.frame_counts(X.v_frames(spark, d))


def _sized_frames(spark: SparkSession, d: str) -> DataFrame:
    """All frames with a size: part sizes, dealt out by event number."""
    return X.with_sizes(spark, d, X.v_frames(spark, d), "event_id")


SIZED_SQL = """(select f.*, s.width, s.height, cast(split_part(frame_name, '.', 1) as bigint) as stem
    from (select *, event_id % (select count(*) from part) as size_id from v_frames) f
    join v_sizes s on f.size_id = s.image_id)"""


@query(
    "a8_first_frame_size",
    f"""select video_id, arg_min(width, stem) as width, arg_min(height, stem) as height
        from {SIZED_SQL} group by video_id""",
)
def a8_first_frame_size(spark: SparkSession, d: str) -> DataFrame:
    frames = _sized_frames(spark, d).withColumn("frame_idx", P.stem_number("frame_name"))
    return V.first_frame_size(frames)


def _nms_sql(source: str, conf: float, iou: float) -> str:
    """CTEs up to `final`: what a plain loop over the boxes of an image and class keeps."""
    return f"""ranked as (
         select image_id, class_id, det_id, score, x0, y0, x1, y1,
           row_number() over (partition by image_id, class_id order by score desc, det_id) as rk
         from {source} where score >= {conf}),
       steps as (
         select image_id, class_id, rk,
           [{{'d': det_id, 's': score, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] as kept
         from ranked where rk = 1
         union all
         select r.image_id, r.class_id, r.rk,
           case when len(list_filter(s.kept, lambda k:
             greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0)
             * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0)
             > {iou}::double * ((k.x1 - k.x0) * (k.y1 - k.y0) + (r.x1 - r.x0) * (r.y1 - r.y0)
               - greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0)
               * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0)))) > 0 then s.kept
           else list_append(s.kept, {{'d': r.det_id, 's': r.score, 'x0': r.x0, 'y0': r.y0,
             'x1': r.x1, 'y1': r.y1}}) end
         from steps s join ranked r
         on r.image_id = s.image_id and r.class_id = s.class_id and r.rk = s.rk + 1),
       final as (
         select image_id, class_id, k.d as det_id, k.s as score, k.x0 as x0, k.y0 as y0, k.x1 as x1, k.y1 as y1
         from (select image_id, class_id, unnest(arg_max(kept, rk)) as k
               from steps group by image_id, class_id))"""


@query("a9_nms", f"with recursive {_nms_sql('v_detections', 0.15, 0.4)} select * from final")
def a9_nms(spark: SparkSession, d: str) -> DataFrame:
    return overlap.nms(X.v_detections(spark, d), 0.15, 0.4)


# --- windows -----------------------------------------------------------------------


@query(
    "w1_frame_index",
    """select user_id as video_id, event_id,
         cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_idx
       from events""",
)
def w1_frame_index(spark: SparkSession, d: str) -> DataFrame:
    events = X.table(spark, d, "events").select(F.col("user_id").alias("video_id"), "ts", "event_id")
    return V.number_frames(events, ["ts", "event_id"]).select("video_id", "event_id", "frame_idx")


@query(
    "w2_det_order",
    """select image_id, det_id,
         cast(row_number() over (partition by image_id order by score desc, det_id) - 1 as int)
           as place
       from v_detections""",
)
def w2_det_order(spark: SparkSession, d: str) -> DataFrame:
    boxes = X.v_detections(spark, d).select("image_id", "det_id", "score")
    placed = D.number_boxes(boxes, [F.col("score").desc(), "det_id"], "place")
    return placed.select("image_id", "det_id", "place")


def _mean_sql(boxes: str, source: str, k: int) -> str:
    """Box mean by an offset join: every pixel of a box with its k x k mirrored sources."""

    def mirrored(p: str, n: str) -> str:
        period = f"(2 * ({n} - 1))"
        m = f"((({p}) % greatest({period}, 1) + greatest({period}, 1)) % greatest({period}, 1))"
        return f"(case when {n} = 1 then 0 when {m} < {n} then {m} else {period} - {m} end)"

    shift = f"select unnest(range(-{k // 2}, {k - k // 2})) as o"
    sx = f"b.x0 + {mirrored('p.x - b.x0 + dx.o', '(b.x1 - b.x0)')}"
    sy = f"b.y0 + {mirrored('p.y - b.y0 + dy.o', '(b.y1 - b.y0)')}"
    return f"""select p.image_id, p.y, p.x, cast(round_even(sum(q.v) / {k * k}.0::double, 0) as int) as v
        from {source} p join {boxes} b on p.image_id = b.image_id
          and p.x >= b.x0 and p.x < b.x1 and p.y >= b.y0 and p.y < b.y1,
          ({shift}) dx, ({shift}) dy, {source} q
        where q.image_id = p.image_id and q.x = {sx} and q.y = {sy}
        group by p.image_id, p.y, p.x"""


@query(
    "w3_box_blur",
    f"""with one as (select vec_id as image_id, 1 as x0, 2 as y0, 6 as x1, 7 as y1 from embeddings),
        mean as ({_mean_sql('one', 'v_pixels', 4)})
        select p.image_id, p.y, p.x, coalesce(m.v, p.v) as v
        from v_pixels p left join mean m using (image_id, y, x)""",
)
def w3_box_blur(spark: SparkSession, d: str) -> DataFrame:
    boxes = X.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.lit(1).alias("det_id"),
        *[F.lit(v).alias(c) for c, v in zip(G.CORNERS, (1, 2, 6, 7))],
    )
    blurred = raster.box_blur(X.v_scan(spark, d), boxes, 4)
    return raster.pixels(blurred).select("image_id", "y", "x", "v")


WAVE_SQL = """chain as (
      select image_id, det_id, x0, y0, x1, y1, 0 as depth from v_boxes8
      union
      select b.image_id, b.det_id, b.x0, b.y0, b.x1, b.y1, c.depth + 1
      from chain c join v_boxes8 b on b.image_id = c.image_id and b.det_id > c.det_id
        and c.x0 < b.x1 and b.x0 < c.x1 and c.y0 < b.y1 and b.y0 < c.y1),
    waves as (
      select image_id, det_id, x0, y0, x1, y1, max(depth) as wave from chain group by all)"""


@query("w4_blur_waves", f"with recursive {WAVE_SQL} select image_id, det_id, wave from waves")
def w4_blur_waves(spark: SparkSession, d: str) -> DataFrame:
    return waves.blur_waves(X.v_boxes8(spark, d)).select("image_id", "det_id", "wave")


SHOT_LISTS = """select o_orderkey as image_id, list_transform(embedding, lambda v:
        cast(least(255, greatest(0, floor((cast(v as double) + 1) * 127.5))) as int)) as px
      from orders join embeddings on vec_id = o_orderkey % (select count(*) from embeddings)"""


def _fold_sql(boxes: str, k: int, shots: str = SHOT_LISTS) -> str:
    """CTEs up to `folded` (image_id, px): `boxes` blurred one after another in `det_id` order.

    Each image is a list of its 64 values, and a step of the recursion blurs one box of each
    image: the plain definition, without waves.
    """

    def mirrored(p: str, n: str) -> str:
        period = f"greatest(2 * ({n} - 1), 1)"
        m = f"((({p}) % {period} + {period}) % {period})"
        return f"(case when {n} = 1 then 0 when {m} < {n} then {m} else 2 * ({n} - 1) - {m} end)"

    x = f"b.x0 + {mirrored(f'i % 8 - b.x0 + o % {k} - {k // 2}', '(b.x1 - b.x0)')}"
    y = f"b.y0 + {mirrored(f'i // 8 - b.y0 + o // {k} - {k // 2}', '(b.y1 - b.y0)')}"
    inside = "i % 8 >= b.x0 and i % 8 < b.x1 and i // 8 >= b.y0 and i // 8 < b.y1"
    mean = f"round_even(list_sum(list_transform(range({k * k}), lambda o: s.px[(1 + 8 * ({y}) + {x})::int])) / {k * k}.0::double, 0)"
    return f"""shots as ({shots}),
        turns as (select *, row_number() over (partition by image_id order by det_id) as step from {boxes}),
        state as (
          select image_id, 0::bigint as step, px from shots
          union all
          select s.image_id, s.step + 1,
            list_transform(range(64), lambda i: case when {inside} then cast({mean} as int) else s.px[(i + 1)::int] end)
          from state s join turns b on b.image_id = s.image_id and b.step = s.step + 1),
        folded as (select image_id, arg_max(px, step) as px from state group by image_id)"""


def _redact_sql(k: int) -> str:
    return f"""with recursive {_fold_sql('v_boxes8', k)},
        spread as (select image_id, unnest(range(64)) as i, unnest(px) as v from folded)
        select image_id, cast(i // 8 as int) as y, cast(i % 8 as int) as x, v from spread"""


@query("w5_redact", _redact_sql(5))
def w5_redact(spark: SparkSession, d: str) -> DataFrame:
    done = waves.redact(X.v_shot_scan(spark, d), X.v_boxes8(spark, d), 5)
    return raster.pixels(done).select("image_id", "y", "x", "v")


RUN_SQL = f"""with recursive chosen as (
          select image_id, file_name, altitude < 200 as low from ({CANDIDATE_SQL})
          where length >= 1024 and altitude is not null),
        found as (
          select b.image_id, b.det_id, d.class_id, d.score, b.x0, b.y0, b.x1, b.y1 from v_boxes8 b
          join (select image_id, det_id, class_id, score from v_detections) d using (image_id, det_id)
          where b.image_id in (select image_id from chosen where low)),
        {_nms_sql('found', 0.15, 0.9)},
        hidden as (
          select f.* from final f join v_classes using (class_id) where class_name in ('ASIA', 'EUROPE')),
        {_fold_sql('hidden', 5, SHOT_LISTS + ' where o_orderkey in (select image_id from chosen where low)')},
        spread as (select image_id, unnest(range(64)) as i, unnest(px) as v from folded),
        counts as (
          select c.image_id, c.file_name, cast(count(h.det_id) as int) as blurred_objects
          from chosen c left join hidden h using (image_id) group by all)"""


def _stored_boxes8(spark: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    """A detector that has seen everything before."""

    def detect(lines: DataFrame) -> DataFrame:
        return X.v_scored_boxes8(spark, d, written(lines.select("image_id").distinct()))

    return detect


@query(
    "e1_image_run",
    RUN_SQL + """ select file_name, blurred_objects > 0 as blurred, blurred_objects,
          cast(i // 8 as int) as y, cast(i % 8 as int) as x, v
        from counts left join spread using (image_id)""",
)
def e1_image_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run: what it logs for each image, and every pixel of those below the gate."""
    out = image_run(
        X.v_objects(spark, d), X.v_log(spark, d), X.v_shot_scan(spark, d), _stored_boxes8(spark, d),
        X.v_classes(spark, d), as_of(spark, d), OPTIONS,
    )
    values = raster.pixels(out["redacted"]).join(out["images"], "image_id").select("file_name", "y", "x", "v")
    return out["log"].drop("datetime").join(values, "file_name", "left")


VIDEO_FRAMES = 20


@query(
    "e2_video_run",
    f"""with recursive wanted as (
          select video_id, frame_name, event_id as image_id, cast(split_part(frame_name, '.', 1) as int) as place
          from v_frames where cast(split_part(frame_name, '.', 1) as int) < {VIDEO_FRAMES}),
        hidden as (
          select b.* from v_boxes8 b
          join (select image_id, det_id, class_id, score from v_detections) using (image_id, det_id)
          join v_classes using (class_id) where class_name in ('ASIA', 'EUROPE') and score >= 0.15
            and image_id in (select image_id from wanted)),
        {_fold_sql('hidden', 5, SHOT_LISTS + ' where o_orderkey in (select image_id from wanted)')},
        spread as (select image_id, unnest(range(64)) as i, unnest(px) as v from folded)
        select concat('output/video/cam_', cast(video_id % 7 as varchar), '/', cast(video_id as varchar), '.mp4') as output_path,
          place, frame_name, place / 24.0::double as seconds, cast(i // 8 as int) as y, cast(i % 8 as int) as x, v
        from wanted join spread using (image_id)""",
)
def e2_video_run(spark: SparkSession, d: str) -> DataFrame:
    """The first frames of each video: every pixel as redacted, in the order of a manifest that is published once."""
    frames = X.v_frames(spark, d).select("video_id", "frame_name", F.col("event_id").alias("image_id"))
    frames = frames.withColumns({"width": F.lit(8), "height": F.lit(8)})
    options = replace(OPTIONS, n_frames=VIDEO_FRAMES)
    out = video_run(
        frames, _videos(frames), X.v_shot_scan(spark, d), _stored_boxes8(spark, d), X.v_classes(spark, d),
        "output/video", options,
    )
    path = work_dir(spark, "videos")
    for _ in range(2):
        publish_videos(out["manifest"], path)
    shown = spark.read.parquet(path).select("video_id", "output_path", "place", "frame_name", "seconds")
    named = shown.join(frames.select("video_id", "frame_name", "image_id"), ["video_id", "frame_name"])
    return named.join(raster.pixels(out["redacted"]), "image_id").drop("image_id", "video_id", "c")


def _corners_model() -> Callable:
    """A fixed rule in place of a network: brightness of two parts of a 12 x 16 canvas, one channel each."""
    import numpy as np

    def predict(batch: np.ndarray) -> dict[str, np.ndarray]:
        image = batch.reshape(-1, 3, 12, 16).astype(np.float64)
        parts = image[:, 0, :6, 2:14], image[:, 2, 6:, 2:14]
        both = lambda *values: np.tile(np.array(values), (len(image), 1))
        return {
            "class_id": both(0, 1).astype("int32"),
            "x0": both(2.0, 2.0),
            "y0": both(0.0, 6.0),
            "x1": both(14.0, 14.0),
            "y1": both(6.0, 12.0),
            "score": np.stack([p.sum(axis=(1, 2)) for p in parts], axis=1) / 72.0,
        }

    return predict


@query(
    "e3_detect",
    """with axis as (
         select i, greatest(0.0::double, (i + 0.5::double) * 8::double / 12::double - 0.5::double) as s
         from (select unnest(range(0, 12)) as i)),
       taps as (select i, floor(s)::int as a, least(floor(s)::int + 1, 7) as b, s - floor(s) as f from axis),
       fitted as (
         select p.image_id, p.c, ty.i as y, round_even(
           (1.0::double - ty.f) * ((1.0::double - tx.f) * p.v + tx.f * q.v)
           + ty.f * ((1.0::double - tx.f) * r.v + tx.f * w.v), 0)::int as v
         from taps ty, taps tx, v_pixels3 p, v_pixels3 q, v_pixels3 r, v_pixels3 w
         where p.y = ty.a and p.x = tx.a and (p.c = 2 and ty.i < 6 or p.c = 0 and ty.i >= 6)
           and q.image_id = p.image_id and q.c = p.c and q.y = ty.a and q.x = tx.b
           and r.image_id = p.image_id and r.c = p.c and r.y = ty.b and r.x = tx.a
           and w.image_id = p.image_id and w.c = p.c and w.y = ty.b and w.x = tx.b)
       select image_id, cast(y // 6 as int) as det_id, cast(y // 6 as int) as class_id,
         round_even(sum(cast(v / 255.0::double as float)::double) / 72.0::double * 100, 0) / 100.0::double as score,
         0 as x0, cast(4 * (y // 6) as int) as y0, 8 as x1, cast(4 + 4 * (y // 6) as int) as y1
       from fitted group by image_id, y // 6""",
)
def e3_detect(spark: SparkSession, d: str) -> DataFrame:
    """The whole detector step: letterbox, resample, pad, channel order, scaling, model, and boxes moved back."""
    detect = detector(_corners_model, width=16, height=12)
    return detect(X.v_scan3(spark, d))


# --- order and set operations ------------------------------------------------------


@query(
    "o1_frame_order",
    """select video_id, frame_name, cast(row_number() over (partition by video_id
         order by cast(split_part(frame_name, '.', 1) as bigint)) - 1 as int) as place
       from v_frames""",
)
def o1_frame_order(spark: SparkSession, d: str) -> DataFrame:
    return V.order_frames(X.v_frames(spark, d)).select("video_id", "frame_name", "place")


@query(
    "o2_first_n_frames",
    """select video_id, frame_name from v_frames
       where cast(split_part(frame_name, '.', 1) as bigint) < 10""",
)
def o2_first_n_frames(spark: SparkSession, d: str) -> DataFrame:
    return V.first_frames(X.v_frames(spark, d), 10).select("video_id", "frame_name")


@query(
    "o3_path_order",
    """select file_name as image_path, det_id,
         cast(row_number() over (order by file_name, det_id) - 1 as bigint) as place
       from v_detections join v_objects using (image_id)""",
)
def o3_path_order(spark: SparkSession, d: str) -> DataFrame:
    paths = X.v_objects(spark, d).select("image_id", F.col("file_name").alias("image_path"))
    rows = X.v_detections(spark, d).select("image_id", "det_id").join(paths, "image_id")
    return V.order_paths(rows.select("image_path", "det_id"), ["det_id"])


@query("o4_sample", "select video_id, '0.jpg' as frame_name from v_frames group by video_id")
def o4_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.sample_frame(X.v_frames(spark, d))


@query("u1_except", "select file_name from v_objects except select file_name from v_log")
def u1_except(spark: SparkSession, d: str) -> DataFrame:
    return S.unprocessed_names(X.v_objects(spark, d), X.v_log(spark, d))


# --- scalar functions --------------------------------------------------------------


@query(
    "f2_path_parts",
    """select page_id, regexp_extract(url, '[^/]*$') as base,
         case when regexp_extract(url, '[^/]*$') = '' then url
           else replace(url, regexp_extract(url, '[^/]*$'), '') end as dir_replaced,
         regexp_replace(url, '[^/]*$', '') as dir from pages""",
)
def f2_path_parts(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").select(
        "page_id",
        P.base_name("url").alias("base"),
        P.dir_by_replace("url").alias("dir_replaced"),
        P.dir_name("url").alias("dir"),
    )


@query(
    "f4_join_path",
    """select image_id, concat('output/', file_name) as output_path,
         substring(concat('/data/in/', file_name), 10) as relative from v_objects""",
)
def f4_join_path(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.lit("/data/in/"), F.col("file_name"))
    return X.v_objects(spark, d).select(
        "image_id",
        P.join_path(F.lit("output"), "file_name").alias("output_path"),
        P.relative_path(full, "/data/in").alias("relative"),
    )


@query("f5_output_name", "select page_id, replace(url, '.', '_blurred.') as output from pages")
def f5_output_name(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").select("page_id", P.blurred_name("url").alias("output"))


@query(
    "f7_px_size",
    "select p_partkey, cast(p_size as int) as width, cast(p_size as int) as height from part",
)
def f7_px_size(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("m-"), F.col("p_size").cast("string"), F.lit("px-x"))
    sized = X.table(spark, d, "part").select("p_partkey", P.square_size(name).alias("s"))
    return sized.select("p_partkey", "s.width", "s.height")


@query(
    "f8_labels",
    """select image_id, det_id, concat(class_name, ' ', score_text) as label,
         cast(trunc(x0) as int) as x, cast(trunc(y0) as int) - 10 as y
       from (select *, cast(cast(printf('%.2f', score) as double) as varchar) as score_text
             from v_detections) join v_classes using (class_id)""",
)
def f8_labels(spark: SparkSession, d: str) -> DataFrame:
    named = D.name_classes(X.v_detections(spark, d), X.v_classes(spark, d))
    anchor = L.label_anchor(F.col("x0").cast("int"), F.col("y0").cast("int"))
    return named.select(
        "image_id",
        "det_id",
        L.label_text("class_name", G.round_score("score")).alias("label"),
        anchor.alias("at"),
    ).select("image_id", "det_id", "label", "at.x", "at.y")


@query(
    "f9_box_ints",
    """select image_id, det_id, cast(trunc(x0 - 20) as int) as x0, cast(trunc(y0 - 20) as int) as y0,
         cast(trunc(x1 - 20) as int) as x1, cast(trunc(y1 - 20) as int) as y1 from v_detections""",
)
def f9_box_ints(spark: SparkSession, d: str) -> DataFrame:
    """Shifted left and up, so that negative corners occur too."""
    boxes = X.v_detections(spark, d).withColumns({c: F.col(c) - 20 for c in G.CORNERS})
    return boxes.select("image_id", "det_id", *G.int_corners())


@query(
    "f10_score_round",
    """select l_orderkey, l_linenumber, l_extendedprice / 1000.0::double as raw,
         cast(printf('%.2f', l_extendedprice / 1000.0::double) as double) as score from lineitem""",
)
def f10_score_round(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("l_extendedprice") / F.lit(1000.0)
    return X.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", raw.alias("raw"), G.round_score(raw).alias("score")
    )


LETTERBOX_SQL = """(
    select *, round_even(dh - 0.1::double, 0)::int as top, round_even(dh + 0.1::double, 0)::int as bottom,
      round_even(dw - 0.1::double, 0)::int as "left", round_even(dw + 0.1::double, 0)::int as "right"
    from (
      select *, (960 - iw) / 2.0::double as dw, (960 - ih) / 2.0::double as dh from (
        select *, round_even(width * ratio, 0) as iw, round_even(height * ratio, 0) as ih from (
          select image_id, width, height,
            least(960.0::double / height, 960.0::double / width) as ratio from v_sizes))))"""


@query(
    "f11_letterbox",
    f"""select image_id, ratio, iw::int as inner_width, ih::int as inner_height, dw, dh, top, bottom,
          "left", "right" from {LETTERBOX_SQL}""",
)
def f11_letterbox(spark: SparkSession, d: str) -> DataFrame:
    box = G.letterbox("width", "height", auto=False).alias("b")
    return X.v_sizes(spark, d).select("image_id", box).select("image_id", "b.*")


@query(
    "f12_unletterbox",
    f"""select b.image_id, det_id, round_even((x0 - dw) / ratio, 0)::int as x0,
          round_even((y0 - dh) / ratio, 0)::int as y0, round_even((x1 - dw) / ratio, 0)::int as x1,
          round_even((y1 - dh) / ratio, 0)::int as y1
        from (select *, image_id % (select count(*) from part) as size_id from v_detections) b
        join {LETTERBOX_SQL} s on b.size_id = s.image_id""",
)
def f12_unletterbox(spark: SparkSession, d: str) -> DataFrame:
    sized = X.with_sizes(spark, d, X.v_detections(spark, d), "image_id")
    boxes = sized.withColumn("b", G.letterbox("width", "height", auto=False))
    back = G.unletterbox(F.col("b.ratio"), F.col("b.dw"), F.col("b.dh"))
    return boxes.select("image_id", "det_id", *back)


@query(
    "f14_pad_raster",
    """select image_id, y, x, coalesce(p.v, 7) as v
       from (select vec_id as image_id, y, x from embeddings,
               (select unnest(range(0, 11)) as y), (select unnest(range(0, 13)) as x)) t
       left join (select image_id, y + 1 as y, x + 3 as x, v from v_pixels) p using (image_id, y, x)""",
)
def f14_pad_raster(spark: SparkSession, d: str) -> DataFrame:
    """One line above, two below, three pixels on the left, two on the right, filled with 7."""
    border = [F.lit(n) for n in (1, 2, 3, 2)]
    padded = raster.pad(X.v_scan(spark, d), *border, fill=7)
    return raster.pixels(padded).select(
        "image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "v"
    )


@query(
    "f15_resample",
    """with axis as (
         select i, greatest(0.0::double, (i + 0.5::double) * 8::double / 12::double - 0.5::double) as s
         from (select unnest(range(0, 12)) as i)),
       taps as (select i, floor(s)::int as a, least(floor(s)::int + 1, 7) as b,
         s - floor(s) as f from axis)
       select p.image_id, ty.i as y, tx.i as x, round_even(
         (1.0::double - ty.f) * ((1.0::double - tx.f) * p.v + tx.f * q.v)
         + ty.f * ((1.0::double - tx.f) * r.v + tx.f * w.v), 0)::int as v
       from taps ty, taps tx, v_pixels p, v_pixels q, v_pixels r, v_pixels w
       where p.y = ty.a and p.x = tx.a
         and q.image_id = p.image_id and q.y = ty.a and q.x = tx.b
         and r.image_id = p.image_id and r.y = ty.b and r.x = tx.a
         and w.image_id = p.image_id and w.y = ty.b and w.x = tx.b""",
)
def f15_resample(spark: SparkSession, d: str) -> DataFrame:
    scan = X.v_scan(spark, d)
    sizes = X.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(12).alias("new_width"), F.lit(12).alias("new_height")
    )
    return raster.pixels(raster.resample(scan, sizes)).select(
        "image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "v"
    )


@query("f16_channel_swap", "select image_id, 2 - c as c, y, x, v from v_pixels3")
def f16_channel_swap(spark: SparkSession, d: str) -> DataFrame:
    return raster.pixels(raster.swap_channels(X.v_scan3(spark, d)))


@query(
    "f17_to_tensor",
    """select image_id, c * 64 + y * 8 + x as pos, cast(v / 255.0::double as float) as v
       from v_pixels3""",
)
def f17_to_tensor(spark: SparkSession, d: str) -> DataFrame:
    tensor = raster.to_tensor(X.v_scan3(spark, d))
    return tensor.select("image_id", F.posexplode("tensor").alias("pos", "v"))


@query(
    "f18_outline",
    """select p.image_id, p.c, p.y, p.x,
         case when exists (select 1 from v_boxes8 b where b.image_id = p.image_id
             and p.x >= b.x0 and p.x < b.x1 and p.y >= b.y0 and p.y < b.y1
             and (p.x < b.x0 + 2 or p.x >= b.x1 - 2 or p.y < b.y0 + 2 or p.y >= b.y1 - 2))
           then case p.c when 1 then 255 else 0 end else p.v end as v
       from v_shots3 p""",
)
def f18_outline(spark: SparkSession, d: str) -> DataFrame:
    return raster.pixels(raster.draw_outlines(X.v_shot_scan3(spark, d), X.v_boxes8(spark, d)))


@query(
    "f19_class_map",
    """with ids as (select p_brand as class_name, max(p_partkey) as class_id from part group by p_brand)
       select p_partkey, class_id, coalesce(case when p_size > 25 then p_brand end, 'unknown') as known
       from part join ids on p_brand = class_name""",
)
def f19_class_map(spark: SparkSession, d: str) -> DataFrame:
    """Brands as a class dictionary with repeated names, inverted; and a lookup with default."""
    parts = X.table(spark, d, "part")
    listed = parts.select(F.col("p_partkey").alias("class_id"), F.col("p_brand").alias("class_name"))
    ids = D.class_ids(listed)
    large = F.create_map(F.lit("large"), F.col("p_brand"))
    key = F.when(F.col("p_size") > 25, "large").otherwise("small")
    return (
        parts.withColumnRenamed("p_brand", "class_name").join(ids, "class_name")
        .withColumnRenamed("class_name", "p_brand")
        .select("p_partkey", "class_id", L.lookup(large, key, "unknown").alias("known"))
    )


@query(
    "f22_frame_time",
    """select video_id, frame_name,
         cast(split_part(frame_name, '.', 1) as bigint) / 24.0::double as seconds from v_frames""",
)
def f22_frame_time(spark: SparkSession, d: str) -> DataFrame:
    seconds = L.frame_seconds(P.stem_number("frame_name")).alias("seconds")
    return X.v_frames(spark, d).select("video_id", "frame_name", seconds)


def _videos(frames: DataFrame) -> DataFrame:
    path = F.concat(
        F.lit("cam_"), (F.col("video_id") % 7).cast("string"), F.lit("/"),
        F.col("video_id").cast("string"), F.lit(".mp4"),
    )
    return frames.select("video_id").distinct().withColumn("video_path", path)


@query(
    "f23_manifest",
    f"""with sized as {SIZED_SQL},
        head as (select video_id, arg_min(width, stem) as vw, arg_min(height, stem) as vh
                 from sized group by video_id),
        placed as (select *, cast(row_number() over (partition by video_id order by stem) - 1 as int)
                   as place from sized)
        select video_id, concat('output/video/cam_', cast(video_id % 7 as varchar), '/',
            cast(video_id as varchar), '.mp4') as output_path, place, frame_name,
          vw as video_width, vh as video_height, width = vw and height = vh as fits,
          place / 24.0::double as seconds
        from placed join head using (video_id)""",
)
def f23_manifest(spark: SparkSession, d: str) -> DataFrame:
    frames = _sized_frames(spark, d)
    return V.manifest(frames, _videos(frames), "output/video")


# --- scoring and streams -----------------------------------------------------------


def _halves_model() -> Callable:
    """A fixed linear rule in place of a detector: brightness of the two image halves."""
    import numpy as np

    def predict(batch: np.ndarray) -> dict[str, np.ndarray]:
        image = batch.reshape(-1, 8, 8)
        top, bottom = image[:, :4].sum(axis=(1, 2)), image[:, 4:].sum(axis=(1, 2))
        rows = len(image)

        def both(first: float, second: float) -> np.ndarray:
            return np.tile(np.array([first, second]), (rows, 1))

        return {
            "class_id": both(0, 1).astype("int32"),
            "x0": both(0.0, 0.0),
            "y0": both(0.0, 4.0),
            "x1": both(8.0, 8.0),
            "y1": both(4.0, 8.0),
            "score": np.stack([top, bottom], axis=1) / 8160.0,
        }

    return predict


@query(
    "x1_score",
    """select image_id, cast(y // 4 as int) as det_id, cast(y // 4 as int) as class_id,
         0.0::double as x0, (y // 4) * 4.0::double as y0, 8.0::double as x1,
         (y // 4) * 4.0::double + 4.0::double as y1, sum(v)::double / 8160.0::double as score
       from v_pixels group by image_id, y // 4""",
)
def x1_score(spark: SparkSession, d: str) -> DataFrame:
    inputs = X.v_rasters(spark, d).select("image_id", F.col("pixels").cast("array<double>").alias("tensor"))
    return score(inputs, _halves_model, [64])


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = X.table(spark, d, "events").schema
    return stream.stream_table(spark, d, schema, "events.parquet")


@query("t1_ingest", "select event_id, user_id, event_type, value from events")
def t1_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one checkpoint: the second adds nothing."""
    root = work_dir(spark, "ingest")
    for _ in range(2):
        events = _event_stream(spark, d).select("event_id", "user_id", "event_type", "value")
        stream.ingest(events, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("t2_dedup", "select distinct event_id from events")
def t2_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event comes twice and is kept once."""
    root = work_dir(spark, "dedup")
    events = _event_stream(spark, d).select("event_id", "ts")
    twice = events.select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = stream.first_seen(twice, "event_id", "ts").select("event_id")
    stream.ingest(once, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("t3_logged_batches", f"select file_name, blurred, blurred_objects from ({MINIMUM_SQL})")
def t3_logged_batches(spark: SparkSession, d: str) -> DataFrame:
    """The image run per batch of a stream of objects, with the log as memory."""
    root = work_dir(spark, "batches")
    stamp, boxes, classes = as_of(spark, d), X.v_detections(spark, d), X.v_classes(spark, d)
    done = X.v_log(spark, d)
    schema = X.table(spark, d, "orders").schema
    orders = stream.stream_table(spark, d, schema, "orders.parquet")

    def work(batch: DataFrame, log: DataFrame) -> DataFrame:
        seen = done.unionByName(log.select("file_name"))
        chosen = choose_work(X.objects_of(batch), seen, stamp, OPTIONS)
        return image_log(chosen, boxes, classes, stamp, OPTIONS, suppress=False)

    run = stream.logged_batches(orders, work, f"{root}/log", f"{root}/state", "o_orderkey")
    run.awaitTermination()
    return logs.read_log_path(spark, f"{root}/log").select("file_name", "blurred", "blurred_objects")


@query(
    "t3_redacted_batches",
    RUN_SQL + """ select c.image_id, file_name, blurred_objects, cast(i // 8 as int) as y, cast(i % 8 as int) as x, v
        from counts c join spread using (image_id)""",
)
def t3_redacted_batches(spark: SparkSession, d: str) -> DataFrame:
    """The whole image run per batch of a stream of objects, in three batches: redacted lines and log rows are committed together."""
    root, stamp = work_dir(spark, "batches"), as_of(spark, d)
    orders = X.table(spark, d, "orders")
    files = orders.rdd.getNumPartitions()  # of each batch, so that a batch is written by many tasks
    orders.repartition(3 * files).write.parquet(f"{root}/in")
    arriving = stream.stream_table(spark, f"{root}/in", orders.schema, files=files)
    done, scan = X.v_log(spark, d), X.v_shot_scan(spark, d)

    def work(batch: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        seen = done.unionByName(log.select("file_name"))
        out = image_run(
            X.objects_of(batch), seen, scan, _stored_boxes8(spark, d), X.v_classes(spark, d), stamp, OPTIONS
        )
        named = out["redacted"].join(out["images"], "image_id")
        return named, out["log"]

    stream.committed_batches(
        arriving, work, f"{root}/store", f"{root}/state", "o_orderkey", "image_id", buckets=16
    ).awaitTermination()
    log = batches.read_log(spark, f"{root}/store", LOG_SCHEMA).select("file_name", "blurred_objects")
    lines = batches.read_objects(spark, f"{root}/store")
    values = raster.pixels(lines.join(log, "file_name"))
    names = lines.where("y = 0").select("image_id", "file_name").join(log, "file_name")
    return values.join(names, "image_id").select("image_id", "file_name", "blurred_objects", "y", "x", "v")
