"""The row-local scoring path runs unchanged on a file stream (availableNow, memory sink)."""

import tempfile

from lendscope.sources import tables as T
from lendscope.streaming.scoring import score_applications

from conftest import SF001


def test_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="lendscope-stream-src-")
    ckpt = tempfile.mkdtemp(prefix="lendscope-stream-ckpt-")
    batch = T.applicants(spark, SF001)
    batch.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (score_applications(stream).writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = spark.table("scored_stream")
    expected = score_applications(batch)
    assert streamed.count() == expected.count() > 0
    assert streamed.exceptAll(expected.select(*streamed.columns)).count() == 0
