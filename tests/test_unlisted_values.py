from datetime import datetime

from basinframe.plans import catalog


def test_recovery_totals_count_null_and_other_languages(spark, tmp_path):
    rows = [(1, "t", lang, "s", 1) for lang in ("en", "en", "it", None)] + [(2, "t", None, "none", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: (r.files, r.en, r.de, r.fr, r.es) for r in catalog.QUERIES["recovery_totals"](spark, str(tmp_path)).collect()}
    assert got == {"s": (4, 2, 0, 0, 0), "none": (1, 0, 0, 0, 0)}


def test_merge_ordered_events_keeps_null_and_other_types(spark, tmp_path):
    rows = [(k, 7, datetime(2026, 1, 1, 0, 9 - k), kind, 1.0) for k, kind in enumerate(["click", "refund", None, "error"])]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.event_id, r.event_type) for r in catalog.QUERIES["merge_ordered_events"](spark, str(tmp_path)).collect()]
    assert got == [(3, "error"), (2, None), (1, "refund"), (0, "click")]
