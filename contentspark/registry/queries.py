"""Registered queries: one per operator, on the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentspark.bindings import calls, content_items, document_items, outbox_events, table
from contentspark.functions.dates import parse_feed_date
from contentspark.functions.events import decode_event, encode_event
from contentspark.functions.fusion import rrf_score
from contentspark.functions.html import clean_html
from contentspark.functions.ids import aggregate_key, feed_key, query_key, shift_millis
from contentspark.functions.urls import is_safe_url, url_domain
from contentspark.functions.vectors import hash_vector, l2_normalize, vector_literal
from contentspark.operators import metrics
from contentspark.operators.constraints import constraint_violations, outbox_violations
from contentspark.operators.enrich import enrich, model_embedder
from contentspark.operators.extract import extract_feed_items, size_fits
from contentspark.operators.outbox import (
    apply_outcomes, claim_batch, insert_if_absent, is_expired, is_pending, mark_failed, mark_processed, outbox_rows,
    published_count, purge_processed,
)
from contentspark.operators.policies import breaker_trips, feed_versions, rate_limit, refresh_decision, retry_decision
from contentspark.operators.textsearch import (
    build_postings, text_candidates, text_candidates_from_postings, text_candidates_many,
)
from contentspark.operators.vectorindex import build_vector_index, pruned_candidates
from contentspark.operators.vectorsearch import has_vector, query_vector, vector_candidates, vector_candidates_many
from contentspark.plans.feed import feed_rows, unread, unread_feed
from contentspark.plans.ingest import new_outbox_rows
from contentspark.plans.ingest import rejected_payloads as ingest_rejects
from contentspark.plans.publish import fold_events
from contentspark.plans.search import hybrid_search, hybrid_search_many
from contentspark.plans.sizing import spread
from contentspark.registry.inputs import feed_payloads, now, queries_from_benchmark, topic_records
from contentspark.session import checkpoint_root
from contentspark.sources.payloads import accepted_status, with_source, with_url_safety
from contentspark.sources.tables import with_item_defaults
from contentspark.sources.topics import dead_letter_rows
from contentspark.streaming.consume import consume_batch
from contentspark.streaming.keyed import checked_records, first_wins, split_outcomes, use_keyed_state

DIM = 64
STEM = "light"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Search and feeds

@query
def unread_feed_newest(spark, sf):
    return unread_feed(content_items(spark, sf))


@query
def unread_feed_undated(spark, sf):
    """A feed longer than the number of dated rows: items of even sources have no date."""
    undated = F.when(F.col("id") % 5 == 0, F.col("published_at"))
    items = content_items(spark, sf).withColumn("published_at", undated)
    return unread_feed(items, limit=items.count())


@query
def content_scan(spark, sf):
    return feed_rows(content_items(spark, sf))


@query
def hybrid_search_one(spark, sf):
    return hybrid_search(content_items(spark, sf), "anat ated", dim=DIM, stem=STEM)


@query
def hybrid_search_table(spark, sf):
    items = content_items(spark, sf)
    found = hybrid_search_many(items, queries_from_benchmark(spark, sf), dim=DIM, stem=STEM)
    return found.select("query_id", "content_id", "title", "url", "rrf_score")


@query
def vector_top50(spark, sf):
    items = content_items(spark, sf)
    near = vector_candidates(items, query_vector(items, "atat", DIM))
    return near.select("id", "distance", F.col("rank").alias("vector_rank"))


@query
def vector_top50_pruned(spark, sf):
    items = content_items(spark, sf)
    folder = f"{checkpoint_root(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    build_vector_index(items, folder)
    vector = spark.range(1).select(hash_vector(F.lit("atat"), DIM)).first()[0]
    near = pruned_candidates(spark, folder, vector, dict(items.dtypes)["id"]).candidates
    return near.select("id", "distance", F.col("rank").alias("vector_rank"))


@query
def vector_top50_table(spark, sf):
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), hash_vector(F.col("text"), DIM).alias("vector"))
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = vector_candidates_many(items, queries)
    return near.select("query_id", "id", "distance", F.col("rank").alias("vector_rank"))


def _text(spark, sf, text):
    found = text_candidates(content_items(spark, sf), text, stem=STEM)
    return found.select("id", "text_score", F.col("rank").alias("text_rank"))


@query
def text_top50_all_words(spark, sf):
    return _text(spark, sf, "anat ated")


@query
def text_top50_one_word(spark, sf):
    return _text(spark, sf, "ananble")


@query
def text_top50_either_not(spark, sf):
    return _text(spark, sf, "atat ated or ananble -thion")


@query
def text_top50_phrase(spark, sf):
    return _text(spark, sf, "\"anat with by\"")


@query
def text_top50_two_word_phrase(spark, sf):
    return _text(spark, sf, "\"eriner thanea\" -\"de la\"")


@query
def text_top50_postings(spark, sf):
    postings = build_postings(document_items(spark, sf), STEM)
    found = text_candidates_from_postings(postings, "atat ated or ananble -thion", stem=STEM)
    return found.select("id", "text_score", F.col("rank").alias("text_rank"))


@query
def text_top50_table(spark, sf):
    postings = build_postings(document_items(spark, sf), STEM)
    found = text_candidates_many(postings, queries_from_benchmark(spark, sf), stem=STEM)
    return found.select("query_id", "id", "text_score", F.col("rank").alias("text_rank"))


@query
def text_top50_deny_only(spark, sf):
    """Queries that deny words stand beside one that needs a word."""
    asked = spark.createDataFrame([(1, "-anat -ated"), (2, "ananble"), (3, "ananble or -anat")], "query_id int, text string")
    found = text_candidates_many(document_items(spark, sf), asked, stem=STEM)
    return found.select("query_id", "id", "text_score", F.col("rank").alias("text_rank"))


@query
def text_top50_table_scan(spark, sf):
    found = text_candidates_many(document_items(spark, sf), queries_from_benchmark(spark, sf), stem=STEM)
    return found.select("query_id", "id", "text_score", F.col("rank").alias("text_rank"))


@query
def postings(spark, sf):
    return build_postings(document_items(spark, sf), STEM)


@query
def rrf_scores(spark, sf):
    rank = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") - 1)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(rrf_score(rank, F.col("l_quantity").cast("int")), 9).alias("rrf_score"))


# Vectors

@query
def unit_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(l2_normalize(F.transform("embedding", lambda x: (x * 3).cast("float")))).alias("i", "x"),
    ).select("vec_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def hash_vectors(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(hash_vector(F.col("text"), DIM)).alias("i", "x")) \
        .select("doc_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def vector_literals(spark, sf):
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit("]"))
    parsed = vector_literal(text)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(parsed).alias("n"),
        F.round(F.aggregate(parsed, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query
def rows_with_vector(spark, sf):
    return content_items(spark, sf).groupBy(has_vector(F.col("embedding")).alias("has_vector")).agg(
        F.count("*").alias("n"))


# Ids, keys, events

@query
def name_uuids(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", aggregate_key(F.col("source"), F.when(F.col("doc_id") % 5 != 0, F.col("text"))).alias("aggregate_id"))


@query
def cache_keys(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        query_key(F.concat(F.lit("  "), "c_name", F.lit(" ")), F.lit(20)).alias("search_key"),
        feed_key(F.col("c_custkey"), F.col("c_nationkey"), F.lit(50)).alias("feed_key"))


@query
def shifted_times(spark, sf):
    millis = (F.col("value") * 100).cast("long")
    return table(spark, sf, "events").select(
        "event_id", shift_millis(F.col("ts"), millis).alias("later"), shift_millis(F.col("ts"), -86_400_000).alias("earlier"))


@query
def encoded_events(spark, sf):
    items = content_items(spark, sf)
    return items.select("id", encode_event(
        F.col("external_id"), now(), F.col("source_id"), F.when(F.col("id") % 4 != 0, F.col("external_id")),
        F.col("content_text"), F.col("url"), F.when(F.col("id") % 5 != 0, F.col("published_at"))).alias("payload"))


@query
def decoded_events(spark, sf):
    d = decode_event(F.col("value"))
    return topic_records(spark, sf).select("offset", d.alias("d")).select(
        "offset", F.col("d.event.event_id").alias("event_id"), F.col("d.event.source_id").alias("source_id"),
        F.col("d.event.external_id").alias("external_id"), F.col("d.event.title").alias("title"),
        F.col("d.event.url").alias("url"), F.col("d.event.published_at").alias("published_at"),
        F.col("d.error").isNotNull().alias("failed"))


# URLs, text, dates, constraints, sources

@query
def url_safety(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", url_domain(F.col("url")).alias("domain"), is_safe_url(F.col("url")).alias("safe"))


@query
def address_safety(spark, sf):
    o = table(spark, sf, "orders")
    host = F.concat_ws(
        ".", (F.col("o_custkey") % 256).cast("string"), (F.col("o_orderkey") % 256).cast("string"),
        F.lit("7"), (F.col("o_custkey") % 200).cast("string"))
    url = F.concat(F.element_at(F.array(F.lit("http"), F.lit("HTTPS"), F.lit("ftp")), (F.col("o_orderkey") % 3 + 1).cast("int")),
                   F.lit("://"), host, F.lit(":8080/x"))
    return o.select("o_orderkey", url.alias("url")).select("o_orderkey", "url", is_safe_url(F.col("url")).alias("safe"))


@query
def resolved_url_safety(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    n = F.length("host") % 4
    hosts = pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).distinct().where(n < 3).select(
        "host", F.when(n == 0, F.array(F.lit("93.184.216.34"), F.lit("10.1.2.3")))
        .when(n == 1, F.array(F.lit("2001:db8::7"), F.lit("93.184.216.34")))
        .otherwise(F.array(F.lit("fd00::1"))).alias("addresses"))
    return with_url_safety(pages, hosts).select("page_id", "domain", "safe")


@query
def cleaned_pages(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", clean_html(F.col("html")).alias("text"))


@query
def feed_dates(spark, sf):
    ts = F.date_trunc("second", "ts").cast("timestamp_ntz")
    iso = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    day = F.element_at(F.array(*map(F.lit, "Mon Tue Wed Thu Fri Sat Sun".split())), F.weekday(ts.cast("date")) + 1)
    month = F.element_at(F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())), F.month(ts))
    clock = F.substring(iso, 12, 8)
    mail = F.concat(day, F.lit(", "), F.dayofmonth(ts).cast("string"), F.lit(" "), month, F.lit(" "),
                    F.year(ts).cast("string"), F.lit(" "), clock, F.lit(" "))
    kind = F.col("event_id") % 7
    text = (
        F.when(kind == 0, F.concat(mail, F.lit("GMT"))).when(kind == 1, F.concat(mail, F.lit("+0300")))
        .when(kind == 2, F.concat(iso, F.lit("Z"))).when(kind == 3, F.concat(iso, F.lit("-05:30")))
        .when(kind == 4, iso).when(kind == 5, F.concat(mail, F.lit("EST"))).otherwise(F.lit("someday")))
    return table(spark, sf, "events").select("event_id", text.alias("text")).select(
        "event_id", parse_feed_date(F.col("text")).alias("published_at"))


@query
def constraint_check(spark, sf):
    rows = content_items(spark, sf).withColumns({
        "external_id": F.when(F.col("id") % 7 != 0, F.col("external_id")), "title": F.col("content_text")})
    found = constraint_violations(
        {"title": 512, "url": 34}, ("external_id", "title"), vector="embedding", dim=DIM)
    return rows.select("id", F.array_join(found, "; ").alias("violations"))


@query
def outbox_constraint_check(spark, sf):
    rows = outbox_events(spark, sf).withColumns({
        "aggregate_type": F.repeat(F.lit("t"), (F.col("id") % 70).cast("int")),
        "payload": F.when(F.col("id") % 11 != 0, F.lit("{}"))})
    return rows.select("id", F.array_join(outbox_violations(), "; ").alias("violations"))


@query
def rejected_payloads(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("length"))
    return ingest_rejects(pages, 3000).select("page_id", "reason")


@query
def payload_size_guard(spark, sf):
    size = F.octet_length("html")
    return table(spark, sf, "pages").select("page_id", size.alias("length")).select(
        "page_id", "length", size_fits(F.col("length"), 4096).alias("fits"))


@query
def accepted_payloads(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.lit(100) + F.col("o_orderkey") % 500).alias("status"))
    return o.where(accepted_status(F.col("status")))


@query
def payload_sources(spark, sf):
    registry = table(spark, sf, "nation").select(
        F.col("n_name").alias("source_id"),
        F.concat(F.lit("https://feed.example.org/"), F.col("n_nationkey").cast("string")).alias("url"))
    payloads = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("https://feed.example.org/"), (F.col("c_custkey") % 40).cast("string")).alias("url"))
    return with_source(payloads, registry).select("c_custkey", "source_id", "url")


@query
def feed_items(spark, sf):
    return extract_feed_items(feed_payloads(spark, sf)).select(
        "source_id", "format", "position", "external_id", "title", "url", "content_text", "published_at")


# Outbox

@query
def first_insert_wins(spark, sf):
    docs = document_items(spark, sf)
    existing = docs.where(F.col("id") % 2 == 0)
    new = docs.select("*", F.explode(F.array(F.lit(2), F.lit(1))).alias("offset")).withColumn(
        "title", F.concat_ws(" ", "title", F.col("offset").cast("string")))
    kept = insert_if_absent(new, existing, ["source_id", "external_id"], [F.col("offset").asc()])
    return kept.select("source_id", "external_id", "title", "offset")


@query
def new_outbox(spark, sf):
    items = document_items(spark, sf).select(
        "*", F.col("id").alias("position"), F.lit(None).cast("timestamp_ntz").alias("published_at"))
    return outbox_rows(items, now(), F.col("external_id")).drop("id", "position")


@query
def pending_outbox(spark, sf):
    return outbox_events(spark, sf).where(is_pending(now())).select("id", "created_at")


@query
def expired_outbox(spark, sf):
    return outbox_events(spark, sf).where(is_expired(now())).select("id", "processed_at")


@query
def claimed_batch(spark, sf):
    return claim_batch(outbox_events(spark, sf), now())[0]


@query
def claimed_state(spark, sf):
    return claim_batch(outbox_events(spark, sf), now())[1].select("id", "processed_at", "locked_until")


@query
def processed_state(spark, sf):
    outbox = outbox_events(spark, sf)
    done = outbox.where(F.col("id") % 3 == 0).select("id")
    return mark_processed(outbox, done, now()).select("id", "processed_at", "retry_count", "locked_until")


@query
def failed_state(spark, sf):
    outbox = outbox_events(spark, sf)
    failures = outbox.where(F.col("id") % 3 == 1).select("id", F.concat(F.lit("broker "), F.col("id").cast("string")).alias("error"))
    return mark_failed(outbox, failures).select("id", "processed_at", "retry_count", "error_message", "locked_until")


def _outcomes(claimed):
    ok = F.col("id") % 2 == 0
    return claimed.select("id", ok.alias("ok"), F.when(~ok, F.lit("timeout")).alias("error"))


@query
def outbox_log_state(spark, sf):
    """Rows in the state that a log of claims, outcomes and repeated failures has brought them to."""
    kind, ts = F.col("event_type"), F.col("ts")

    def event(name, at, until=None, error=None):
        return F.struct(
            F.lit(name).alias("kind"), at.alias("at"), (F.lit(None).cast("timestamp_ntz") if until is None else until).alias("locked_until"),
            F.lit(error).cast("string").alias("error"))

    def later(seconds):
        return shift_millis(ts, 1000 * seconds)

    log = F.when(kind == "click", F.array(
        event("claimed", ts, later(30)), event("failed", later(1), error="first"), event("claimed", later(40), later(70)),
        event("failed", later(41), error="second"))).when(
        kind == "purchase", F.array(event("claimed", ts, later(30)), event("processed", later(2)), event("processed", later(3)))).otherwise(
        F.array(event("claimed", ts, later(30))))
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(
        F.col("event_id").alias("id"), F.explode(log).alias("e")).select("id", "e.*").where("id % 3 <> 0")
    rows = outbox_events(spark, sf).withColumns({
        "processed_at": F.lit(None).cast("timestamp_ntz"), "locked_until": F.lit(None).cast("timestamp_ntz")})
    return fold_events(rows, events).select("id", "processed_at", "retry_count", "error_message", "locked_until")


@query
def published_state(spark, sf):
    claimed, leased = claim_batch(outbox_events(spark, sf), now(), limit=200)
    return apply_outcomes(leased, _outcomes(claimed), now(), outcome_rows=200).select(
        "id", "processed_at", "retry_count", "error_message", "locked_until")


@query
def published_number(spark, sf):
    return published_count(_outcomes(claim_batch(outbox_events(spark, sf), now(), limit=200)[0]))


@query
def purged_state(spark, sf):
    return purge_processed(outbox_events(spark, sf), now())[0].select("id", "processed_at")


@query
def purged_number(spark, sf):
    return purge_processed(outbox_events(spark, sf), now())[1]


@query
def ingested_feeds(spark, sf):
    known = document_items(spark, sf).select(aggregate_key(
        F.col("source_id"), F.concat(F.lit("g-"), F.col("external_id"), F.lit("-0"))).alias("aggregate_id"))
    rows = new_outbox_rows(feed_payloads(spark, sf), known, now(), F.col("external_id"))
    return rows.select("aggregate_id", "aggregate_type", "type", "payload", "created_at", "retry_count")


# Consuming and enrichment

def _consumed(spark, sf):
    existing = document_items(spark, sf).where(F.col("id") % 4 == 1)
    return consume_batch(topic_records(spark, sf), existing, now())


@query
def consumed_items(spark, sf):
    return _consumed(spark, sf).items.select(
        "source_id", "external_id", "title", "url", "content_text", "read", "published_at", "created_at")


@query
def dead_letters(spark, sf):
    return _consumed(spark, sf).dead_letters.select(
        "key", "value", "topic", "error_class", "source_topic", "source_partition", "source_offset")


def _keyed(spark, sf):
    existing = document_items(use_keyed_state(spark), sf).where(F.col("id") % 4 == 1)
    return split_outcomes(first_wins(checked_records(topic_records(spark, sf), now()), existing))


@query
def consumed_items_keyed(spark, sf):
    return with_item_defaults(enrich(_keyed(spark, sf)[0]), now()).select(
        "source_id", "external_id", "title", "url", "content_text", "read", "published_at", "created_at")


@query
def dead_letters_keyed(spark, sf):
    return dead_letter_rows(_keyed(spark, sf)[2]).select(
        "key", "value", "topic", "error_class", "source_topic", "source_partition", "source_offset")


@query
def inserted_items(spark, sf):
    rows = content_items(spark, sf)
    return with_item_defaults(rows, now()).drop("id", "embedding", "raw_data")


@query
def enriched_without_model(spark, sf):
    return enrich(document_items(spark, sf)).select(
        "id", "summary", F.size("tags").alias("n_tags"), "primary_category", "estimated_read_minutes",
        F.col("embedding").isNull().alias("no_vector"), "status")


def _letter_model():
    def embed(texts):
        if any("?" in t for t in texts):
            raise ValueError("unreadable")
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    return embed


@query
def enriched_with_model(spark, sf):
    rows = enrich(document_items(spark, sf), model_embedder(_letter_model))
    return rows.select(
        "id", "status", F.col("embedding")[0].cast("double").alias("length"),
        F.col("embedding")[1].cast("double").alias("letters"))


@query
def query_vectors(spark, sf):
    fallback = hash_vector(F.col("text"), 2)
    vector = F.coalesce(model_embedder(_letter_model)(F.col("text")), fallback)
    return table(spark, sf, "conversations").select("conv_id", "turn", vector.alias("v")).select(
        "conv_id", "turn", F.round(F.col("v")[0].cast("double"), 6).alias("x"),
        F.round(F.col("v")[1].cast("double"), 6).alias("y"))


# Policies

@query
def rate_limited_calls(spark, sf):
    """Every call arrives as a burst within its own second, so that seconds overflow."""
    log = calls(spark, sf).withColumn("burst", F.explode(F.sequence(F.lit(0), F.col("call_id") % 8)))
    return rate_limit(log.withColumn("call_id", F.col("call_id") * 8 + F.col("burst"))).select("domain", "call_id", "admitted")


@query
def breaker_signal(spark, sf):
    return breaker_trips(calls(spark, sf)).select(
        "domain", "call_id", "window_calls", "window_failures", "tripped")


@query
def refresh_decisions(spark, sf):
    r = F.lit(0.0001) + (F.col("l_orderkey") % 9999) / F.lit(10000.0)
    left = F.col("l_quantity").cast("long") * 5 - 20
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        refresh_decision(left, F.lit(0), F.lit(200), F.lit(50), r).alias("decision"))


@query
def user_feed_versions(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return feed_versions(users, table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")))


@query
def retry_decisions(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", retry_decision(F.col("l_linenumber") - 1).alias("decision"))


# Metrics

@query
def ingested_counts(spark, sf):
    return metrics.ingested_per_source(document_items(spark, sf))


@query
def row_counts(spark, sf):
    return metrics.row_counts(
        content_items(spark, sf), total=F.lit(True), unread=unread(F.col("read")),
        with_vector=has_vector(F.col("embedding")))


@query
def request_rates(spark, sf):
    rates = metrics.request_rate(calls(spark, sf))
    return rates.select("window_start", F.round("rate", 9).alias("rate"))


@query
def hourly_metrics_from_minutes(spark, sf):
    minutes = metrics.minute_state(calls(spark, sf), ["endpoint"], "latency_ms", F.col("failed"))
    hours = metrics.state_metrics(metrics.merged_state(minutes, ["endpoint"], "hour"), seconds=3600.0)
    # The quantiles are estimates: the tests bound their rank error.
    return hours.select("endpoint", "window_start", F.round("rate", 9).alias("rate"), F.round("error_rate", 9).alias("error_rate"), "max_value")


@query
def max_per_minute(spark, sf):
    return metrics.max_gauge(calls(spark, sf), "latency_ms")


@query
def latency_quantiles_by_endpoint(spark, sf):
    q = metrics.latency_quantiles(calls(spark, sf), ["endpoint"], "latency_ms")
    return q.select("endpoint", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query
def latency_quantiles_by_minute(spark, sf):
    q = metrics.latency_quantiles_per_minute(calls(spark, sf), "latency_ms")
    return q.select("window_start", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query
def latency_quantiles_null_group(spark, sf):
    """A NULL key is a group, and a group of NULL values has NULL quantiles."""
    kind = F.col("endpoint")
    log = calls(spark, sf).withColumns({
        "endpoint": F.when(kind != "click", kind), "latency_ms": F.when(~F.coalesce(kind == "signup", F.lit(False)), F.col("latency_ms"))})
    q = metrics.latency_quantiles(log, ["endpoint"], "latency_ms")
    return q.select("endpoint", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query
def histogram_quantiles_by_endpoint(spark, sf):
    q = metrics.histogram_quantiles(
        calls(spark, sf), ["endpoint"], "latency_ms", [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0])
    return q.select("endpoint", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query
def service_levels(spark, sf):
    log = calls(spark, sf)
    levels = metrics.service_levels(
        log, "domain", "latency_ms", F.col("failed"), F.lit(40.0), F.lit(100.0), max_error_rate=0.2)
    return levels.select(
        "domain", F.round("error_rate", 9).alias("error_rate"), F.round("p95", 6).alias("p95"),
        F.round("p99", 6).alias("p99"), "errors_ok", "p95_ok", "p99_ok")
