"""Micro-batch draft verification stream (availableNow) against a static facts table."""

import json
import os
import tempfile
import uuid

from cohortlens.streaming.drafts import verify_draft_stream


def test_stream_verifies_each_batch(spark):
    base = tempfile.mkdtemp(prefix="cl-stream-")
    src, out = os.path.join(base, "drafts"), os.path.join(base, "out")
    os.makedirs(src)
    batches = [[{"draft_id": "a", "context_id": "c", "text": "CLV $17.20 and 4.2x"}],
               [{"draft_id": "b", "context_id": "c", "text": "90.4% of revenue"}]]
    for i, b in enumerate(batches):
        with open(os.path.join(src, f"part-{i}.json"), "w") as f:
            f.write("\n".join(json.dumps(r) for r in b))
    facts = spark.createDataFrame([("c", "kpi.avg_clv", 17.2, None), ("c", "kpi.share", 0.904, None)],
                                  "context_id string, path string, value_double double, value_string string")
    q = verify_draft_stream(spark, src, facts, out, name=f"t{uuid.uuid4().hex[:8]}", max_files_per_trigger=1)
    q.awaitTermination(120)
    got = {r.draft_id: (r.total, r.verified) for r in spark.read.parquet(out).collect()}
    assert got == {"a": (2, 1), "b": (1, 1)}
    assert len([d for d in os.listdir(out) if d.startswith("batch_id=")]) == 2
