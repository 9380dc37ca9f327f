import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from contentspark.plans.jobs import start_crawl, start_job, start_publish, start_purge
from contentspark.plans.publish import read_done, read_outbox, read_pending
from tests.test_outbox import ATOM
from tests.test_streaming import NOW

PAYLOAD = "source_id string, length long, content binary, ingest_ts timestamp_ntz"


def at(**later):
    return F.lit(NOW + timedelta(**later)).cast("timestamp_ntz")


def test_each_job_runs_once(spark, tmp_path):
    box = str(tmp_path / "outbox")
    landed = lambda: spark.createDataFrame([("blog", len(ATOM), bytearray(ATOM.encode()), NOW)], PAYLOAD)
    for round_ in range(2):
        start_crawl(spark, landed, box, str(tmp_path / "crawl"), None, at()).awaitTermination(60)
        assert read_pending(spark, box).count() == 2, round_
    sent = []
    start_publish(spark, box, lambda rows: sent.extend(r.key for r in rows.collect()), str(tmp_path / "publish"), None, at()).awaitTermination(60)
    assert len(set(sent)) == len(sent) == 2 and read_done(spark, box).count() == 2
    start_purge(spark, box, str(tmp_path / "purge"), None, at(days=6)).awaitTermination(60)
    assert read_outbox(spark, box).count() == 2
    start_purge(spark, box, str(tmp_path / "purge"), None, at(days=8)).awaitTermination(60)
    assert read_outbox(spark, box).count() == 0


def test_a_job_runs_at_its_interval_until_stopped(spark, tmp_path):
    rounds = []
    job = start_job(spark, lambda: rounds.append(time.time()), str(tmp_path / "c"), 1.0)
    try:
        end = time.time() + 30
        while len(rounds) < 3 and time.time() < end:
            time.sleep(0.2)
    finally:
        job.stop()
    assert len(rounds) >= 3 and rounds[2] - rounds[1] > 0.5


def test_an_error_ends_the_job(spark, tmp_path):
    def work():
        raise RuntimeError("no feed today")

    with pytest.raises(Exception, match="no feed today"):
        start_job(spark, work, str(tmp_path / "c"), None).awaitTermination(60)
