"""The streaming tagger equals the batch operator on the same documents."""

import os
import tempfile

from tagflow.operators import align
from tagflow.plans import fixtures as fx
from tagflow.streaming.tagging import tag_stream

from conftest import SF_SMALL


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp()
    src, sink = os.path.join(d, "src"), os.path.join(d, "sink")
    docs = fx.annotated(spark, SF_SMALL, partitioned=False)
    docs.where("doc_id < 100").write.parquet(os.path.join(src, "a"))
    docs.where("doc_id >= 100").write.parquet(os.path.join(src, "b"))
    q = tag_stream(spark, src + "/*", sink, checkpoint=os.path.join(d, "ck"), max_files_per_trigger=1)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(sink).drop("batch")
    want = align.align(docs)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
