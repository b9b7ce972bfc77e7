"""Streams equal the batch result on the same files, also when stopped between files and started again."""

from farelake.plans import q_estimate as Q
from farelake.plans.registry import load_all
from farelake.session import shared_path
from farelake.streaming.estimates import last_lists
from tests.conftest import SF_SMALL


def _in_parts(spark, folder, parts):
    """Events dealt to files; writes the given parts."""
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for i in parts:
        events.where(f"pmod(hash(event_id), 3) = {i}").coalesce(1).write.mode("append").parquet(folder)


def test_estimates_as_a_stream_with_a_restart(spark):
    folder, base = shared_path(spark, "events"), shared_path(spark, "stream")
    _in_parts(spark, folder, [0])
    Q.stream_estimates(spark, SF_SMALL, folder, "*.parquet", base)
    _in_parts(spark, folder, [1, 2])
    out = Q.stream_estimates(spark, SF_SMALL, folder, "*.parquet", base)
    got = spark.read.parquet(out)
    assert got.select("epoch").distinct().count() == 3
    batch = load_all()["j8_estimate_table"].build(spark, SF_SMALL)
    a, b = (sorted(map(str, df.select("request_id", "session_id", "estimate").collect())) for df in (got, batch))
    assert a == b and len(a) > 100
    one = batch.first().estimate
    assert one.request.airline and one.request["class"] and "alibration" in one.market_calibration.note


def test_session_state_with_a_restart_and_a_replay(spark):
    folder, base = shared_path(spark, "events"), shared_path(spark, "stream")
    _in_parts(spark, folder, [2, 0])
    Q.stream_sessions(spark, SF_SMALL, folder, "*.parquet", base)
    _in_parts(spark, folder, [1, 0])  # some events come again
    out = Q.stream_sessions(spark, SF_SMALL, folder, "*.parquet", base)
    cols = ["session_id", "request_id", "position"]
    got = sorted(tuple(r) for r in last_lists(spark, out).select(*cols).collect())
    batch = sorted(tuple(r) for r in load_all()["j10_latest_per_session"].build(spark, SF_SMALL).select(*cols).collect())
    assert got == batch
