"""The detector as a batch scoring step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("class_id", T.ArrayType(T.IntegerType())),
        T.StructField("x0", T.ArrayType(T.DoubleType())),
        T.StructField("y0", T.ArrayType(T.DoubleType())),
        T.StructField("x1", T.ArrayType(T.DoubleType())),
        T.StructField("y1", T.ArrayType(T.DoubleType())),
        T.StructField("score", T.ArrayType(T.DoubleType())),
    ]
)


def score(
    tensors: DataFrame,
    make_predict_fn: Callable,
    input_shape: list[int],
    column: str = "tensor",
    batch_size: int = 64,
) -> DataFrame:
    """Run a detector over model inputs and give one row per box.

    `make_predict_fn` loads the model once per worker and returns a function from a batch
    of inputs to arrays of boxes per input (the fields of `PREDICTION_SCHEMA`). Images
    without boxes drop out. Keep rows that need no scoring out of `tensors`: a condition
    around the call would still score them.
    """
    run = predict_batch_udf(
        make_predict_fn,
        return_type=PREDICTION_SCHEMA,
        batch_size=batch_size,
        input_tensor_shapes=[input_shape],
    )
    found = tensors.select(*[c for c in tensors.columns if c != column], run(column).alias("_p"))
    fields = [f.name for f in PREDICTION_SCHEMA]
    zipped = F.arrays_zip(*[F.col(f"_p.{f}").alias(f) for f in fields])
    rest = [c for c in found.columns if c not in ("_p", "shape")]
    return found.select(*rest, F.posexplode(zipped).alias("det_id", "_b")).select(
        *rest, "det_id", *[F.col("_b")[f].alias(f) for f in fields]
    )
