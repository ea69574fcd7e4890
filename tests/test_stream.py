"""The incident stream: micro-batches of any size give the same numbers and normal periods."""

import os
import uuid

from faultlens.operators import metrics as M
from faultlens.sources import readers as R
from faultlens.streaming.incidents import run_incident_stream

NS = 1748736000000000000


def test_batch_size_does_not_matter(spark, tmp_path):
    for f in range(3):
        rows = "".join(f"u{f}{k},{NS + (f * 3 + k) * 10 ** 13},{NS + (f * 3 + k) * 10 ** 13 + 10 ** 12}\n" for k in range(3))
        (tmp_path / f"{f}.csv").write_text("uuid,start_timestamp,end_timestamp\n" + rows)
    whole = sorted(map(tuple, M.incident_periods(R.read_incidents(spark, str(tmp_path))).collect()))
    for size in (1, 2, 16):
        batches, periods = [], []

        def process(batch, batch_id):
            batches.append(batch.count())
            periods.extend(map(tuple, M.incident_periods(batch).collect()))
        q = run_incident_stream(spark, str(tmp_path), process, name=f"s{os.getpid()}{uuid.uuid4().hex}", max_files_per_trigger=size)
        q.awaitTermination(180)
        assert sorted(periods) == whole and sum(batches) == 9 and len(batches) >= (3 if size == 1 else 1)
