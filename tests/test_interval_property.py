"""J1 against a brute-force nested loop on random inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from faultlens.operators.interval import interval_join

ts_list = st.lists(st.integers(-50, 300), min_size=0, max_size=40)
iv_list = st.lists(st.tuples(st.integers(-60, 300), st.integers(0, 120)), min_size=1, max_size=8)


@settings(max_examples=12, deadline=None)
@given(ts_list, iv_list, st.integers(1, 97))
def test_interval_join_matches_brute_force(spark, ts, ivs, bucket):
    rec = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "rid long, timestamp_ns long")
    rows = [(f"i{k}", lo, lo + ln - 30) for k, (lo, ln) in enumerate(ivs)]  # some intervals are empty (hi < lo)
    iv = spark.createDataFrame(rows, "uuid string, start_timestamp long, end_timestamp long")
    got = sorted((r.uuid, r.rid) for r in interval_join(rec, iv, bucket_ns=bucket).collect())
    exp = sorted((u, i) for u, lo, hi in rows for i, t in enumerate(ts) if lo <= t <= hi)
    assert got == exp
