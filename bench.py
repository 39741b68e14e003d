"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Each query runs to a sink that drops its rows, after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from veilframe.plans.registry import QUERIES  # noqa: E402
from veilframe.plans.session import local_session  # noqa: E402

HEADLINE = [
    "p5_candidates",
    "a2_log_rows",
    "a1_blurred_objects",
    "p14_detection_rows",
    "j3_left",
    "j4_pixels_in_boxes",
    "j6_iou_pairs",
    "j6_partners",
    "a9_nms",
    "w1_frame_index",
    "w3_box_blur",
    "w4_blur_waves",
    "w5_redact",
    "e1_image_run",
    "e2_video_run",
    "e3_detect",
    "o3_path_order",
    "f15_resample",
    "f17_to_tensor",
    "f18_outline",
    "f23_manifest",
    "x1_score",
    "t3_logged_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["a6_box_counts"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
