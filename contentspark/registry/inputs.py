"""Inputs that registered queries derive from the star-schema tables, always from every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentspark.bindings import document_items, table
from contentspark.functions.events import encode_event
from contentspark.functions.text import words
from contentspark.plans.sizing import spread

NOW = "2024-01-20 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def queries_from_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query that needs all its words."""
    plain = F.array_join(F.filter(words(F.col("text")), lambda w: w != "or"), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), plain.alias("text"))


def _escaped(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per document with one item per line: RSS, Atom and video feeds by turns."""
    kind = F.col("doc_id") % 3
    doc = F.col("doc_id").cast("string")

    def item(line: Column, i: Column) -> Column:
        number = F.concat(doc, F.lit("-"), i.cast("string"))
        link = F.concat(F.lit("https://feed.example.org/"), number)
        escaped = _escaped(line)
        rss = F.concat(
            F.lit("<item><title><![CDATA["), line, F.lit("]]></title><link>"), link, F.lit("</link>"),
            F.when(i % 2 == 0, F.concat(F.lit("<guid>g-"), number, F.lit("</guid>"))).otherwise(F.lit("<guid> </guid>")),
            F.lit("<description>&lt;b&gt;"), escaped, F.lit("&lt;/b&gt;</description>"),
            F.lit("<pubDate>Wed, 19 Mar 2025 21:05:00 +0300</pubDate></item>\n"))
        atom = F.concat(
            F.lit("<entry><title>"), escaped, F.lit("</title><link rel=\"alternate\" href=\""), link,
            F.lit("\"/><id>urn:"), number, F.lit("</id><updated>2024-05-02T06:15:00Z</updated><summary>"),
            escaped, F.lit("</summary></entry>\n"))
        video = F.concat(
            F.lit("<entry><yt:videoId>v"), number, F.lit("</yt:videoId><title>"), escaped,
            F.lit("</title><link href='"), link, F.lit("'/><published>junk</published><media:group><media:description>"),
            escaped, F.lit("</media:description></media:group><summary>unused</summary></entry>\n"))
        return F.when(kind == 0, rss).when(kind == 1, atom).otherwise(video)

    items = F.array_join(F.transform(F.split("text", "\n"), item), "")
    head = F.when(kind == 0, "<?xml version=\"1.0\"?><rss><channel><title>All</title>").otherwise(
        "<?xml version=\"1.0\"?><feed><title>All</title>")
    tail = F.when(kind == 0, "</channel></rss>").otherwise("</feed>")
    content = F.concat(head, items, tail).cast("binary")
    # Out of a generator, so that a filter on the length does not write the feeds again.
    return spread(table(spark, sf_dir, "documents")).select("source", "doc_id", F.explode(F.array(content)).alias("content")).select(
        "source", F.col("source").alias("source_id"), "content", F.length("content").cast("long").alias("length"),
        now().alias("ingest_ts"), F.lit(200).alias("status"), F.concat(F.lit("/landing/"), doc).alias("path"),
    )


def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event messages of all documents, sent twice with another title; every tenth is cut in half."""
    items = document_items(spark, sf_dir)
    record = F.posexplode(F.array(F.lit("first"), F.lit("second"))).alias("round", "edition")
    sent = items.select("id", "source_id", "external_id", "title", "url", record)
    value = encode_event(
        F.concat(F.lit("e"), F.col("external_id")), now(), F.col("source_id"), F.col("external_id"),
        F.concat("title", F.lit(" "), "edition"), F.col("url"), F.lit(None).cast("timestamp_ntz"))
    cut = F.when(F.col("id") % 10 == 0, F.substring(value, F.lit(1), F.floor(F.length(value) / 2).cast("int"))).otherwise(value)
    return sent.select(
        F.col("external_id").alias("key"), cut.alias("value"), F.lit("content-discovered").alias("topic"),
        (F.col("id") % 4).cast("int").alias("partition"), (F.col("id") * 2 + F.col("round")).alias("offset"))
