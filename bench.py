"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from cueloom.queries import QUERIES
from cueloom.session import local_session

HEADLINES = [
    "coalesce_intervals", "crosstalk", "speech_rates", "qualified_silences", "segment_words",
    "batch_words", "repair_squeezed_words", "missing_cue_batches", "extend_ends", "renumber_cues",
    "align_starts", "refine_ends", "trim_long_silence", "rms_levels", "activity_intervals",
    "refine_onsets", "plan_chunks", "merge_chunks", "merge_overlap", "timeline_view",
    "upsert_cues", "replace_transcript", "event_problems", "render_ass", "ass_round_trip",
    "read_words_spaced", "settle_final_ids", "text_weight", "fold_traces",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that starting the JVM and Python workers is not measured.
    QUERIES["coalesce_intervals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only or HEADLINES:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps({
            "metric": "total_query_seconds",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
