"""What a run reads of its inputs."""

from pyspark.sql import functions as F

from veilframe.plans import fixtures as X


def test_boxes_of_some_images(spark, sf):
    """Restricted before they are numbered, boxes are those of the images and have the same numbers."""
    every = X.v_scored_boxes8(spark, sf)
    ids = every.select("image_id").distinct().where("image_id % 5 = 0")
    some = X.v_scored_boxes8(spark, sf, ids)
    assert sorted(some.collect()) == sorted(every.where("image_id % 5 = 0").collect())
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")
    scores = X.v_detections(spark, sf).select("image_id", "det_id", "class_id", "score")
    joined = X.v_boxes8(spark, sf).join(scores, ["image_id", "det_id"]).select(*every.columns)
    assert every.exceptAll(joined).isEmpty() and joined.exceptAll(every).where(F.lit(True)).isEmpty()
