"""The stateless ingest steps give the same rows on a stream as in batch."""

import tempfile

from estatelens.plans.ingest_queries import TEST_CONTRACT, contract_feed
from estatelens.streaming.ingest_stream import rowwise_ingest, start_stream_ingest
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    work = tempfile.mkdtemp(prefix="estatelens-stream-", dir="/tmp")
    feed = contract_feed(spark, SF_SMALL)
    feed.write.parquet(f"{work}/in")
    src = spark.read.parquet(f"{work}/in")
    q = start_stream_ingest(spark, f"{work}/in", src.schema, TEST_CONTRACT, f"{work}/out", f"{work}/state")
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{work}/out")
    batch = rowwise_ingest(src, TEST_CONTRACT)
    assert streamed.count() == batch.count() > 0
    cols = sorted(batch.columns)
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0


def test_second_application_resumes(spark):
    """A stream stopped and started by another application delivers the rows that came between, once each."""
    import subprocess
    import sys
    work = tempfile.mkdtemp(prefix="estatelens-resume-", dir="/tmp")
    feed = contract_feed(spark, SF_SMALL)
    first, second = feed.randomSplit([0.5, 0.5], seed=3)
    script = (
        "import sys; from estatelens.session import get_session; from estatelens.plans.ingest_queries import TEST_CONTRACT; "
        "from estatelens.streaming.ingest_stream import start_stream_ingest; w = sys.argv[1]; s = get_session('local[2]', 2); "
        "q = start_stream_ingest(s, w + '/in', s.read.parquet(w + '/in').schema, TEST_CONTRACT, w + '/out', w + '/state'); "
        "q.awaitTermination(200); s.stop()")
    first.write.mode("append").parquet(f"{work}/in")
    for more in (second, None):
        subprocess.run([sys.executable, "-c", script, work], check=True, timeout=280)
        if more is not None:
            more.write.mode("append").parquet(f"{work}/in")
    src = spark.read.parquet(f"{work}/in")
    batch = rowwise_ingest(src, TEST_CONTRACT)
    streamed = spark.read.parquet(f"{work}/out").select(*batch.columns)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0
