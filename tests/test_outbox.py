from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentspark.operators.outbox import (
    apply_outcomes, claim_batch, first_per_key, insert_if_absent, is_pending, mark_failed, mark_processed, purge_processed,
)
from contentspark.plans.ingest import ingest_feeds
from contentspark.plans.publish import append_outbox, publish_outbox, purge_outbox, read_done, read_outbox, read_pending
from contentspark.schemas import OUTBOX_EVENT

NOW = datetime(2025, 6, 1, 12)
now = lambda: F.lit(NOW).cast("timestamp_ntz")

ATOM = """<feed><entry><title>One</title><id>1</id></entry><entry><title>Two</title><id>2</id></entry></feed>"""


def outbox(spark, *rows):
    base = {"aggregate_type": "CONTENT", "type": "ContentDiscoveredEvent", "payload": "{}", "created_at": NOW,
            "processed_at": None, "retry_count": 0, "error_message": None, "locked_until": None}
    full = [{**base, "aggregate_id": f"a{r['id']}", **r} for r in rows]
    return spark.createDataFrame([tuple(r[f] for f in OUTBOX_EVENT.fieldNames()) for r in full], OUTBOX_EVENT)


def test_pending_is_strict_about_the_lease(spark):
    box = outbox(
        spark, {"id": "free"}, {"id": "done", "processed_at": NOW}, {"id": "at", "locked_until": NOW},
        {"id": "past", "locked_until": NOW - timedelta(milliseconds=1)}, {"id": "leased", "locked_until": NOW + timedelta(1)})
    assert {r.id for r in box.where(is_pending(now())).collect()} == {"free", "past"}


def test_claim_takes_the_oldest_and_leases_them(spark):
    box = outbox(spark, *[{"id": str(i), "created_at": NOW - timedelta(hours=i)} for i in range(9)])
    claimed, leased = claim_batch(box, now(), limit=3)
    assert {r.id for r in claimed.collect()} == {"8", "7", "6"}
    state = {r.id: r.locked_until for r in leased.collect()}
    assert {k for k, v in state.items() if v == NOW + timedelta(seconds=30)} == {"8", "7", "6"}
    again, _ = claim_batch(leased, now(), limit=3)
    assert {r.id for r in again.collect()} == {"5", "4", "3"}
    later, _ = claim_batch(leased, F.lit(NOW + timedelta(seconds=31)).cast("timestamp_ntz"), limit=3)
    assert {r.id for r in later.collect()} == {"8", "7", "6"}


@pytest.mark.parametrize("limit", [1, 37, 150, 400])
def test_large_claims_take_the_same_rows(spark, monkeypatch, limit):
    from contentspark.operators import outbox as module

    rows = [{"id": f"{i:03}", "created_at": NOW - timedelta(hours=i * 37 % 50)} for i in range(300)]
    box = outbox(spark, *rows).repartition(5)
    expected = {r.id for r in claim_batch(box, now(), limit)[0].collect()}
    monkeypatch.setattr(module, "MERGED_CLAIM", 0)
    claimed, leased = claim_batch(box, now(), limit)
    assert {r.id for r in claimed.collect()} == expected and len(expected) == min(limit, 300)
    assert leased.where("locked_until is not null").count() == len(expected)


def test_transitions(spark):
    box = outbox(spark, {"id": "1", "locked_until": NOW}, {"id": "2", "locked_until": NOW}, {"id": "3"})
    one = box.where("id = '1'").select("id")
    assert {r.id: r.processed_at for r in mark_processed(box, one, now()).collect()} == {"1": NOW, "2": None, "3": None}
    failed = mark_failed(box, one.withColumn("error", F.lit("down")), rows=1).where("id = '1'").first()
    assert (failed.retry_count, failed.error_message, failed.processed_at, failed.locked_until) == (1, "down", None, NOW)
    outcomes = spark.createDataFrame([("1", True, None), ("2", False, "x")], "id string, ok boolean, error string")
    state = {r.id: r for r in apply_outcomes(box, outcomes, now()).collect()}
    assert state["1"].processed_at == NOW and state["1"].retry_count == 0
    assert state["2"].processed_at is None and (state["2"].retry_count, state["2"].error_message) == (1, "x")
    assert state["3"] == box.where("id = '3'").first()


def test_purge(spark):
    week = timedelta(days=7)
    box = outbox(
        spark, {"id": "old", "processed_at": NOW - timedelta(days=8)}, {"id": "edge", "processed_at": NOW - week},
        {"id": "new", "processed_at": NOW}, {"id": "open"})
    kept, purged = purge_processed(box, now())
    assert {r.id for r in kept.collect()} == {"edge", "new", "open"}
    assert purged.first().purged == 1


rows = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 50)), min_size=1, max_size=12, unique_by=lambda r: r[1])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(new=rows, old=rows)
def test_insert_if_absent_is_idempotent(spark, new, old):
    new_df = spark.createDataFrame(new, "k int, o int")
    old_df = spark.createDataFrame(old, "k int, o int")
    order = [F.col("o").asc()]
    inserted = insert_if_absent(new_df, old_df, ["k"], order)
    got = {tuple(r) for r in inserted.collect()}
    known = {k for k, _ in old}
    firsts = {}
    for k, o in sorted(new, key=lambda r: r[1]):
        firsts.setdefault(k, o)
    assert got == {(k, o) for k, o in firsts.items() if k not in known}
    bounded = insert_if_absent(new_df, old_df, ["k"], order, new_rows_bound=len(new))
    assert {tuple(r) for r in bounded.collect()} == got
    assert insert_if_absent(new_df, old_df.unionByName(inserted), ["k"], order).count() == 0


def test_repeats_of_a_hot_key_stay_on_their_task(spark):
    copies = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_per_key(copies, ["k"], [F.col("id").asc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert first_per_key(copies, ["k"], [F.col("id").asc()]).count() == 3


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "outbox")


def test_publish_and_purge_on_files(spark, folder):
    append_outbox(spark, folder, outbox(spark, *[{"id": str(i), "created_at": NOW - timedelta(hours=i)} for i in range(5)]))
    sent = []
    assert publish_outbox(spark, folder, lambda rows: sent.extend(r.key for r in rows.collect()), now(), limit=3) == 3
    assert set(sent) == {"a4", "a3", "a2"}
    assert {(r.id, r.processed_at) for r in read_done(spark, folder).collect()} == {(i, NOW) for i in "432"}
    assert {r.id for r in read_pending(spark, folder).collect()} == {"0", "1"}
    assert read_done(spark, folder).where("locked_until is null").count() == 0
    assert read_outbox(spark, folder).count() == 5

    def broken(rows):
        raise RuntimeError("Kafka broker unreachable")

    assert publish_outbox(spark, folder, broken, now()) == 0
    assert {(r.retry_count, r.error_message, r.processed_at) for r in read_pending(spark, folder).collect()} == {
        (1, "Kafka broker unreachable", None)}
    assert publish_outbox(spark, folder, sent.append, now()) == 0
    later = NOW + timedelta(hours=13)
    assert publish_outbox(spark, folder, lambda rows: rows.collect(), F.lit(later)) == 2
    assert read_pending(spark, folder).count() == 0
    week_on = lambda t: F.lit(t + timedelta(days=7)).cast("timestamp_ntz")
    assert purge_outbox(spark, folder, week_on(NOW)) == 0
    assert purge_outbox(spark, folder, week_on(NOW + timedelta(seconds=1))) == 3
    assert {r.id for r in read_done(spark, folder).collect()} == {"0", "1"}
    assert purge_outbox(spark, folder, week_on(later + timedelta(days=3))) == 2
    assert read_outbox(spark, folder).count() == 0


def test_one_bad_row_fails_alone_and_rounds_only_append(spark, folder):
    import os

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}

    append_outbox(spark, folder, outbox(spark, *[{"id": str(i), "created_at": NOW} for i in range(9)]))
    delivered = []

    def send(rows):
        keys = [r.key for r in rows.collect()]
        if "a4" in keys:
            raise RuntimeError("too long")
        delivered.extend(keys)

    before = files()
    assert publish_outbox(spark, folder, send, now(), limit=6) == 5
    assert before <= files()
    assert sorted(delivered) == ["a0", "a1", "a2", "a3", "a5"]
    assert {(r.id, r.retry_count) for r in read_pending(spark, folder).collect()} == {("4", 1), ("6", 0), ("7", 0), ("8", 0)}
    assert publish_outbox(spark, folder, send, now()) == 3
    assert read_outbox(spark, folder).count() == 9


def month(spark, folder):
    """Four days of rows, published a day later each, the last one not."""
    for day in range(4):
        at = NOW + timedelta(days=day)
        append_outbox(spark, folder, outbox(spark, *[{"id": f"{day}{i}", "created_at": at} for i in range(3)]), F.lit(at))
        if day:
            publish_outbox(spark, folder, lambda rows: rows.collect(), F.lit(at), limit=3)


def stored_ids(spark, folder):
    return {r.id for r in spark.read.parquet(f"{folder}/rows").where("id is not null").collect()}


def test_clearing_overwrites_old_partitions_only(spark, folder):
    import os

    month(spark, folder)
    files = {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/rows") for f in names if f.endswith(".parquet")}
    week_on = F.lit(NOW + timedelta(days=2, hours=1) + timedelta(days=7)).cast("timestamp_ntz")
    assert purge_outbox(spark, folder, week_on) == 6
    assert {r.id for r in read_outbox(spark, folder).collect()} == stored_ids(spark, folder) == {f"{d}{i}" for d in (2, 3) for i in range(3)}
    after = {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/rows") for f in names if f.endswith(".parquet")}
    assert {f for f in files if "day=2025-06-03" in f or "day=2025-06-04" in f} == {f for f in files & after}
    state = sorted((r.id, r.processed_at is None, r.retry_count) for r in read_outbox(spark, folder).collect())
    assert purge_outbox(spark, folder, week_on) == 0
    assert sorted((r.id, r.processed_at is None, r.retry_count) for r in read_outbox(spark, folder).collect()) == state


def test_rows_appended_beside_clearing_stay(spark, folder, monkeypatch):
    """Appends and publishing between what clearing reads and what it overwrites lose nothing."""
    from contentspark.plans import publish

    month(spark, folder)
    plain, meanwhile = publish._overwrite, []

    def beside(kept, touched, path):
        at = NOW + timedelta(days=9, hours=len(meanwhile))
        append_outbox(spark, folder, outbox(spark, {"id": f"new{len(meanwhile)}", "created_at": NOW}), F.lit(at))
        meanwhile.append(publish_outbox(spark, folder, lambda rows: rows.collect(), F.lit(at), limit=2))
        plain(kept, touched, path)
        append_outbox(spark, folder, outbox(spark, {"id": f"late{len(meanwhile)}", "created_at": NOW}), F.lit(at))

    monkeypatch.setattr(publish, "_overwrite", beside)
    assert purge_outbox(spark, folder, F.lit(NOW + timedelta(days=9, hours=2)).cast("timestamp_ntz")) == 6
    rows = {r.id: r.processed_at for r in read_outbox(spark, folder).collect()}
    assert set(rows) == {"20", "21", "22", "30", "31", "32", "new0", "new1", "late1", "late2"}
    assert len(meanwhile) == 2 and sum(r is not None and r > NOW + timedelta(days=8) for r in rows.values()) == sum(meanwhile)


def test_stop_within_clearing_loses_and_doubles_nothing(spark, folder, monkeypatch):
    from contentspark.plans import publish

    month(spark, folder)

    def broken(rows):
        raise RuntimeError("down")

    publish_outbox(spark, folder, broken, F.lit(NOW + timedelta(days=3)), limit=3)
    plain, calls = publish._overwrite, []

    def stopping(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        plain(*args)

    monkeypatch.setattr(publish, "_overwrite", stopping)
    later = F.lit(NOW + timedelta(days=9, hours=2)).cast("timestamp_ntz")
    with pytest.raises(RuntimeError):
        purge_outbox(spark, folder, later)
    monkeypatch.setattr(publish, "_overwrite", plain)
    assert purge_outbox(spark, folder, later) == 0
    rows = {r.id: r.retry_count for r in read_outbox(spark, folder).collect()}
    assert rows == {"20": 0, "21": 0, "22": 0, "30": 1, "31": 1, "32": 1}


def test_polling_a_feed_again_adds_nothing(spark, folder):
    payloads = spark.createDataFrame(
        [("blog", len(ATOM), bytearray(ATOM.encode()), NOW), ("broken", 3, bytearray(b"<<<"), NOW)],
        "source_id string, length long, content binary, ingest_ts timestamp_ntz")
    first, counts = ingest_feeds(payloads, read_outbox(spark, folder), now())
    assert {(r.source_id, r.ingested) for r in counts.collect()} == {("blog", 2), (None, 2)}
    append_outbox(spark, folder, first)
    again, counts = ingest_feeds(payloads, read_outbox(spark, folder), now(), new_rows_bound=2)
    assert again.count() == 0
    assert [r.ingested for r in counts.where("source_id is not null").collect()] == []
    assert read_outbox(spark, folder).count() == 2
