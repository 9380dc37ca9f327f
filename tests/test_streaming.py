import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contentspark.operators.enrich import enrich, model_embedder
from contentspark.operators.outbox import claim_batch
from contentspark.operators.policies import route_failures
from contentspark.sources.payloads import scan_payload_files, with_source, with_source_by_path, source_registry
from contentspark.sources.tables import read_items
from contentspark.sources.topics import dead_letter_rows, read_topic, topic_rows, with_headers, write_topic
from contentspark.streaming.breaker import BreakerRules, breaker_stream, next_state
from contentspark.streaming.consume import consume_batch, drop_recent_repeats, split_records, start_consumer
from contentspark.streaming.versions import version_stream

NOW = datetime(2025, 6, 1, 12)
now = lambda: F.lit(NOW).cast("timestamp_ntz")
RECORD = "key string, value string, topic string, partition int, offset long, timestamp timestamp"


def event(external, title, source="s", **more):
    return json.dumps({"eventId": "e", "timestamp": "2025-06-01T11:00", "sourceId": source, "externalId": external,
                       "contentType": "RSS", "title": title, "url": "http://x/1", "publishedAt": None, **more})


def records(spark, *values, start=0):
    return spark.createDataFrame(
        [(None, v, "content-discovered", 0, start + i, NOW) for i, v in enumerate(values)], RECORD)


FIRST = (event("1", "one"), "[neither, an: event", event("1", "one again"), event("2", "x" * 513),
         event("3", "three", source=None), event("4", "four", publishedAt="2025-01-01T00:00:00"))
SECOND = (event("1", "one late"), event("5", "five"))


def test_consume_batch(spark):
    result = consume_batch(records(spark, *FIRST), read_items(spark, "/nowhere"), now())
    items = {r.external_id: r for r in result.items.collect()}
    assert {k: v.title for k, v in items.items()} == {"1": "one", "4": "four"}
    assert (items["1"].published_at, items["4"].published_at) == (NOW, datetime(2025, 1, 1))
    assert items["1"].content_text == "one" and items["1"].embedding is None and items["1"].read is False
    dead = {r.source_offset: r for r in result.dead_letters.collect()}
    assert set(dead) == {1, 3, 4}
    assert dead[1].value == FIRST[1] and dead[1].error_class == "DecodingError"
    assert dead[3].error_message == "title longer than 512"
    assert dead[4].error_message == "source_id is null"
    assert {d.topic for d in dead.values()} == {"content-discovered.DLT"}


def run_stream(spark, folders, name, **more):
    stream = read_topic(spark, folders["in"], fmt="parquet")
    start_consumer(stream, folders[f"items{name}"], folders[f"dead{name}"], now=now(),
                   checkpoint=folders[f"ckpt{name}"], **more).awaitTermination(120)


@pytest.fixture
def folders(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "itemsA", "deadA", "ckptA", "itemsB", "deadB", "ckptB")}


def content(spark, path):
    return {(r.source_id, r.external_id, r.title) for r in read_items(spark, path).collect()}


def test_stream_equals_batch_in_one_or_two_runs(spark, folders):
    write_topic(records(spark, *FIRST).coalesce(1), folders["in"], fmt="parquet")
    run_stream(spark, folders, "A")
    assert content(spark, folders["itemsA"]) == {("s", "1", "one"), ("s", "4", "four")}
    write_topic(records(spark, *SECOND, start=len(FIRST)).coalesce(1), folders["in"], fmt="parquet")
    run_stream(spark, folders, "A")
    run_stream(spark, folders, "A")
    run_stream(spark, folders, "B")
    everything = consume_batch(records(spark, *FIRST, *SECOND), read_items(spark, "/nowhere"), now())
    expected = {(r.source_id, r.external_id, r.title) for r in everything.items.collect()}
    assert content(spark, folders["itemsA"]) == content(spark, folders["itemsB"]) == expected
    for name in "AB":
        dead = spark.read.parquet(folders[f"dead{name}"])
        assert sorted(r.source_offset for r in dead.collect()) == [1, 3, 4]


def test_repeated_batch_replaces_its_output(spark, folders):
    from contentspark.sources.tables import append_items

    first = consume_batch(records(spark, *FIRST), read_items(spark, folders["itemsA"]), now())
    for _ in range(2):
        existing = read_items(spark, folders["itemsA"]).where("batch_id < 0")
        again = consume_batch(records(spark, *FIRST), existing, now())
        append_items(again.items, folders["itemsA"], 1, 0)
    assert read_items(spark, folders["itemsA"]).count() == first.items.count() == 2


def test_new_checkpoint_keeps_what_is_stored(spark, folders):
    write_topic(records(spark, *FIRST).coalesce(1), folders["in"], fmt="parquet")
    run_stream(spark, folders, "A")
    write_topic(records(spark, *SECOND, start=len(FIRST)).coalesce(1), folders["in"], fmt="parquet")
    folders["ckptA"] += "-other"
    run_stream(spark, folders, "A")
    rows = [(r.external_id, r.title) for r in read_items(spark, folders["itemsA"]).collect()]
    assert sorted(rows) == [("1", "one"), ("4", "four"), ("5", "five")]
    assert {r.run for r in read_items(spark, folders["itemsA"]).collect()} == {1, 2}
    assert spark.read.parquet(folders["deadA"]).count() == 6


def test_model_sees_every_row_once(spark, folders):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def embed(texts):
            seen.add(len(texts))
            return [[1.0, 0.0] for _ in texts]

        return embed

    write_topic(records(spark, event("1", "one"), event("2", "two")).coalesce(1), folders["in"], fmt="parquet")
    run_stream(spark, folders, "A", embed=model_embedder(load), dim=2)
    assert seen.value == 2 and read_items(spark, folders["itemsA"]).count() == 2


def constant_model():
    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("model down")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_enrichment_fallback(spark):
    items = spark.createDataFrame([("good", "text"), ("bad", "text")], "title string, content_text string")
    rows = {r.title: r for r in enrich(items, model_embedder(constant_model)).collect()}
    assert (rows["good"].status, list(rows["good"].embedding)) == ("SUCCESS", [9.0, 1.0])
    assert (rows["bad"].status, rows["bad"].embedding, rows["bad"].content_text) == ("FALLBACK", None, "text")
    plain = enrich(items).first()
    assert (plain.status, plain.summary, plain.tags, plain.primary_category, plain.estimated_read_minutes) == (
        "FALLBACK", "good", [], "General", 1)


def test_embedding_of_wrong_size_is_a_dead_letter(spark):
    result = consume_batch(
        records(spark, event("1", "one"), event("2", "bad")), read_items(spark, "/nowhere"), now(),
        embed=model_embedder(constant_model), dim=3)
    assert [r.external_id for r in result.items.collect()] == ["2"]
    assert [r.error_message for r in result.dead_letters.collect()] == ["embedding size is not 3"]


def test_route_failures(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "failures int")
    retry, dead = route_failures(rows)
    assert {r.failures for r in retry.collect()} == {1, 2}
    assert {r.failures for r in dead.collect()} == {3, 4}


def test_dead_letters_as_broker_records(spark):
    _, bad = split_records(records(spark, "{bad").drop("timestamp"))
    row = with_headers(dead_letter_rows(bad)).first()
    assert row.topic == "content-discovered.DLT"
    assert {h.key: bytes(h.value).decode() for h in row.headers}["error_class"] == "DecodingError"


def test_topic_rows_and_files(spark, folders):
    box = spark.createDataFrame([("1", "a", "{}")], "id string, aggregate_id string, payload string")
    assert topic_rows(box).first().asDict() == {"key": "a", "value": "{}"}
    write_topic(topic_rows(box), folders["in"], fmt="json")
    back = read_topic(spark, folders["in"], fmt="json", streaming=False).first()
    assert (back.key, back.value, back.offset) == ("a", "{}", None)


def test_payload_files(spark, tmp_path):
    for source, name, size in (("a b", "1.xml", 10), ("c", "2.xml", 50)):
        folder = tmp_path / f"source_id={source.replace(' ', '%20')}"
        folder.mkdir()
        (folder / name).write_bytes(b"x" * size)
    rows = with_source_by_path(scan_payload_files(spark, str(tmp_path), "*.xml", max_bytes=20)).collect()
    assert [(r.source_id, r.length, bytes(r.content)) for r in rows] == [("a b", 10, b"x" * 10)]
    stream = scan_payload_files(spark, str(tmp_path), "*.xml", streaming=True)
    stream.writeStream.format("memory").queryName("payloads").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("payloads").count() == 2


def test_rejected_files(spark, tmp_path):
    from contentspark.plans.ingest import rejected_files

    folder = tmp_path / "source_id=a%20b"
    folder.mkdir()
    for name, size in (("1.xml", 10), ("2.xml", 50), ("3.xml", 0)):
        (folder / name).write_bytes(b"x" * size)
    rows = rejected_files(spark, str(tmp_path), "*.xml", max_bytes=20).collect()
    assert [(r.source_id, r.path[-5:], r.length, r.reason) for r in rows] == [("a b", "2.xml", 50, "too long")]


def test_broadcast_needs_few_bytes(spark, monkeypatch):
    from contentspark.plans import sizing

    hosts = spark.createDataFrame([("a", ["1.2.3.4"] * 1000), ("b", None)], "host string, addresses array<string>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sizing.broadcast_if_measured(hosts))
    monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", 5000)
    assert not hinted(sizing.broadcast_if_measured(hosts))


def test_checkpoints_of_a_cluster_need_a_shared_folder():
    from types import SimpleNamespace

    from contentspark.session import checkpoint_root

    def session(master, **conf):
        settings = SimpleNamespace(get=lambda name, default=None: conf.get(name.replace(".", "_"), default))
        return SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(master=master, getConf=lambda: settings))

    assert checkpoint_root(session("local[2]", spark_sql_warehouse_dir="file:/w")) == "file:/w/_checkpoints"
    assert checkpoint_root(session("yarn", spark_sql_warehouse_dir="hdfs://h/w")) == "hdfs://h/w/_checkpoints"
    assert checkpoint_root(session("yarn", spark_checkpoint_dir="hdfs://h/c", spark_sql_warehouse_dir="file:/w")) == "hdfs://h/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(session("yarn", spark_sql_warehouse_dir="file:/w"))


def test_registry(spark):
    registry = source_registry(spark, {"quay": "https://s/", "mole": "https://g/"})
    payloads = spark.createDataFrame([("https://s/", 1), ("https://other/", 2)], "url string, n int")
    assert [(r.source_id, r.n) for r in with_source(payloads, registry).collect()] == [("quay", 1)]
    assert source_registry(spark, {"quay": "https://s/"}, enabled=False).count() == 0


def memory_stream(spark, frame, folder, query, name, mode):
    frame.write.mode("append").parquet(folder)
    q = query(spark.readStream.schema(frame.schema).parquet(folder)).writeStream.format("memory").queryName(name) \
        .outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_version_stream(spark, folders):
    frame = spark.createDataFrame([("u",), ("u",), ("v",)], "user_id string").coalesce(1)
    rows = memory_stream(spark, frame, folders["in"], version_stream, "versions", "update")
    assert {(r.user_id, r.version) for r in rows} == {("u", 3), ("v", 2)}


def test_recent_repeats(spark, folders):
    frame = spark.createDataFrame([("s", "1", NOW), ("s", "1", NOW), ("s", "2", NOW)],
                                  "source_id string, external_id string, timestamp timestamp_ntz")
    rows = memory_stream(spark, frame, folders["in"], lambda s: drop_recent_repeats(s, "1 hour"), "recent", "append")
    assert sorted(r.external_id for r in rows) == ["1", "2"]
    # Rows first seen long after newer ones stay.
    for i, at in enumerate((NOW, datetime(2001, 1, 1), datetime(2035, 1, 1), datetime(1990, 1, 1))):
        spark.createDataFrame([("t", str(i), at)], frame.schema).coalesce(1).write.mode("append").parquet(folders["in"] + "2")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folders["in"] + "2")
    drop_recent_repeats(stream, "1 second").writeStream.format("memory").queryName("late").trigger(
        availableNow=True).start().awaitTermination(120)
    assert spark.table("late").count() == 4


def test_breaker_rules():
    rules = BreakerRules()
    state = ("closed", [], 0)
    for i in range(4):
        permitted, *state = next_state(rules, *state, now_ms=i, failed=True)
        assert permitted and state[0] == "closed"
    permitted, *state = next_state(rules, *state, now_ms=4, failed=True)
    assert permitted and state[0] == "open"
    assert next_state(rules, *state, now_ms=10_003, failed=False)[0] is False
    permitted, *half = next_state(rules, *state, now_ms=10_004, failed=False)
    assert permitted and half[0] == "half_open"
    for i in range(9):
        permitted, *half = next_state(rules, *half, now_ms=10_005 + i, failed=i < 4)
    assert half[0] == "closed"


def test_breaker_stream_isolates_domains(spark, folders):
    calls = [("bad", datetime(2025, 1, 1, 0, 0, i), i, True) for i in range(10)]
    calls += [("good", datetime(2025, 1, 1, 0, 0, i), 100 + i, False) for i in range(10)]
    frame = spark.createDataFrame(calls, "domain string, ts timestamp, call_id long, failed boolean")
    rows = memory_stream(spark, frame, folders["in"], breaker_stream, "verdicts", "append")
    assert all(r.permitted for r in rows if r.domain == "good")
    assert [r.permitted for r in sorted(rows, key=lambda r: r.call_id) if r.domain == "bad"] == [True] * 5 + [False] * 5


def test_workers_never_share_a_row(spark):
    box = spark.createDataFrame(
        [(str(i), f"a{i}", "{}", NOW, None, None) for i in range(20)],
        "id string, aggregate_id string, payload string, created_at timestamp_ntz, processed_at timestamp_ntz, "
        "locked_until timestamp_ntz")
    seen = []
    for _ in range(3):
        claimed, box = claim_batch(box, now(), limit=8)
        seen += [r.id for r in claimed.collect()]
    assert len(seen) == len(set(seen)) == 20


def test_task_functions_need_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from contentspark.operators.textsearch import parse_web_query

    (tmp_path / "f.bin").write_bytes(cloudpickle.dumps((parse_web_query, BreakerRules(), next_state)))
    code = ("import pickle; f, rules, step = pickle.load(open('f.bin', 'rb')); "
            "assert f('a b')['groups'][0]['need'] == [0], f('a b'); assert step(rules, 'closed', [], 0, 1, True)[0]")
    code = code.replace("'a b'", "'cat dog'").replace("[0], f", "[0, 1], f")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
