"""varint_length on sequence numbers that its SQL does not reach."""

from tidemark.plans.queries import QUERIES


def test_long_varints_are_not_left_out(spark, tmp_path):
    seqs = [1, 11, 12, 128, 100_000, 100_001, 185_363, 185_364, 2_097_152, 23_726_566, 23_726_567, 268_435_456, 3_037_000_499]
    rows = [(s - 1, 1, "view", 1.0) for s in seqs]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.seq: r.varint_bytes for r in QUERIES["varint_length"](spark, str(tmp_path)).collect()}
    assert got == {s: max(1, -(-(s * s).bit_length() // 7)) for s in seqs}
