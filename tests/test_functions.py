import hashlib
import uuid
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentspark.functions.dates import parse_feed_date
from contentspark.functions.events import decode_event, encode_event
from contentspark.functions.fusion import rrf_score
from contentspark.functions.html import clean_html, decode_entities
from contentspark.functions.ids import aggregate_key, feed_key, name_uuid, query_key, shift_millis
from contentspark.functions.urls import is_safe_url, url_domain
from contentspark.functions.vectors import cosine_distance, hash_vector, l2_normalize, vector_literal


def column(spark, values, expression, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def uuid3(text):
    digest = bytearray(hashlib.md5(text.encode()).digest())
    digest[6] = digest[6] & 0x0F | 0x30
    digest[8] = digest[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(digest)))


def test_name_uuid_matches_byte_level_definition(spark):
    texts = ["quay:1", "источник:запись", "", "x" * 500] + [f"k{i}" for i in range(100)]
    assert column(spark, texts, name_uuid) == [uuid3(t) for t in texts]


def test_aggregate_key_concatenates_and_keeps_the_text_null(spark):
    rows = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), ("a", None)], "s string, e string")
    keys = [r[0] for r in rows.select(aggregate_key(F.col("s"), F.col("e"))).collect()]
    assert keys[0] == keys[1]
    assert keys[2] == uuid3("a:null")


def test_keys(one):
    assert one(query_key(F.lit("  Tide Table "), F.lit(20))) == "search:tide table:20"
    assert one(feed_key(F.lit("u-1"), F.lit(5), F.lit(50))) == "feed:u-1:v5:l50"


def test_shift_millis(one):
    ts = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    assert one(shift_millis(ts, 1500)) == datetime(2025, 1, 1, 0, 0, 1, 500000)
    assert one(shift_millis(ts, -1)) == datetime(2024, 12, 31, 23, 59, 59, 999000)


DATES = {
    "Wed, 19 Mar 2025 21:05:00 GMT": datetime(2025, 3, 19, 21, 5),
    "Wed, 19 Mar 2025 21:05:00 +0300": datetime(2025, 3, 19, 21, 5),
    "19 Mar 2025 21:05 GMT": datetime(2025, 3, 19, 21, 5),
    "fri, 5 aug 2022 10:00:00 gmt": datetime(2022, 8, 5, 10),
    "Mon, 19 Mar 2025 21:05:00 GMT": None,
    "Wed, 19 Mar 2025 21:05:00 EST": None,
    "31 Feb 2025 10:00:00 GMT": datetime(2025, 2, 28, 10),
    "2024-05-02T06:15:00Z": datetime(2024, 5, 2, 6, 15),
    "2023-12-24T18:30:00+00:00": datetime(2023, 12, 24, 18, 30),
    "2025-06-10T12:00:01.1234567+02:00[Europe/Paris]": datetime(2025, 6, 10, 12, 0, 1, 123456),
    "2025-06-10T12:00": datetime(2025, 6, 10, 12),
    "2025-02-30T10:00:00Z": None,
    "2025-06-10": None,
    "junk": None,
    "": None,
    None: None,
}


def test_feed_dates_keep_wall_clock(spark):
    assert column(spark, list(DATES), parse_feed_date) == list(DATES.values())


SAFE = [
    # names, ports, queries and upper case
    "https://harbour.test/news.xml", "http://a.b.c.harbour.test:8443/x?y=1#z", "HTTP://HARBOUR.TEST/Q",
    # public addresses, next to the closed ranges as well
    "http://9.9.9.9/", "http://11.0.0.1/", "http://172.15.255.255/", "http://172.32.0.1/", "http://192.167.1.1/", "http://169.253.1.1/",
    "http://100.128.0.1/", "http://[2001:db8::1]/", "http://[::ffff:9.9.9.9]/",
]
UNSAFE = [
    # this machine
    "http://localhost/", "http://127.8.8.8:99/x", "http://127.1/", "http://0.0.0.0/", "http://[::1]/y", "http://[::]/",
    # private, link-local, shared and multicast ranges, both ends where they have two
    "http://10.0.0.0/", "http://10.255.255.255/", "http://172.16.0.0/", "http://172.31.255.255/", "http://192.168.0.7/",
    "http://169.254.169.254/", "http://169.254.0.1/", "http://100.64.0.1/", "http://224.0.0.1/",
    "http://[fd12::9]/", "http://[fe80::7]/", "http://[fec0::7]/", "http://[ff05::2]/", "http://[::ffff:10.0.0.1]/",
    "http://[0:0:0:0:0:ffff:7f00:1]/",
    # other schemes and no URLs
    "gopher://harbour.test/", "mailto:a@harbour.test", "", "  ", None, "harbour", "http://nodot/", "http://dot.test./", "http://a_b.test/",
]


def test_safe_urls(spark):
    urls = SAFE + UNSAFE
    assert column(spark, urls, is_safe_url) == [True] * len(SAFE) + [False] * len(UNSAFE)


def test_known_addresses_decide(spark):
    rows = spark.createDataFrame([
        ("http://a.example/", ["93.184.216.34"]), ("http://a.example/", ["93.184.216.34", "10.0.0.1"]),
        ("http://a.example/", []), ("http://a.example/", None), ("http://single/", ["93.184.216.34"]),
        ("http://a.example/", ["nonsense"]),
    ], "u string, a array<string>")
    assert [r[0] for r in rows.select(is_safe_url(F.col("u"), F.col("a"))).collect()] == [
        True, False, True, True, True, False]


def test_url_domain(spark):
    assert column(spark, ["https://harbour.test/x", "nonsense", None], url_domain) == ["harbour.test", "default", "default"]


def test_references_as_the_standard_reads_them(spark):
    """Every name with and without its semicolon, longer words that begin like a name, and numbers; Python's reader is the judge."""
    import html
    from html.entities import html5

    names = [n.rstrip(";") for n in html5]
    texts = [f"a &{n}; b" for n in names] + [f"a &{n} b" for n in names] + [f"&{n}zz;" for n in names] + [f"&&{n}=1&{n.upper()};" for n in names[::7]]
    texts += ["&#65;&#x41;&#X41&#65 &#128;&#150;&#xD800;&#x110000;&#0;&#99999999999999999999;&#x;&#;&;& &a;", "&notit; &noti &not &ampamp; &AMP", ""]
    assert column(spark, texts, decode_entities) == [html.unescape(t) for t in texts]


def test_clean_html(spark):
    texts = [
        "Sow <i>broad beans</i> &amp; peas", "a<br>b<p>c</p>d<i>e</i>f", None, "",
        "&#1087;&#x43f;&nbsp;z &bogus; &amp;lt; & x", "x<script>if(a<b){}</script>y <!-- <p> --> z", " a \n\t b ",
        "&#xD800;&#0;&#99999999;",
    ]
    assert column(spark, texts, clean_html) == [
        "Sow broad beans & peas", "a b c def", "", "", "пп z &bogus; &lt; & x", "xy z", "a b",
        "���",
    ]


def test_entities_are_decoded_once(one):
    assert one(decode_entities(F.lit("&amp;amp;&copy;&apos;"))) == "&amp;©'"


def hash_vector_reference(text, dim):
    data = np.frombuffer(text.encode(), dtype=np.int8)
    raw = [abs((i * 31 + int(data[i % len(data)])) ^ (len(data) * 17)) % 1000 / 1000.0 for i in range(dim)]
    v = np.array(raw, dtype=np.float32)
    total = np.float32(0)
    for x in v:
        total = np.float32(total + np.float32(x * x))
    return v / np.float32(np.sqrt(np.float64(total))) if total > 0 else v


def test_hash_vector_is_bit_exact(spark):
    texts = ["java", "Привет, мир", "x" * 4000, "é"]
    got = column(spark, texts, lambda c: hash_vector(c, 1536))
    for text, vector in zip(texts, got):
        assert np.array_equal(np.array(vector, dtype=np.float32), hash_vector_reference(text, 1536))


def test_hash_vector_of_blank_text_is_zero(spark):
    assert column(spark, [None, "", " \t\n"], lambda c: F.array_max(hash_vector(c, 8))) == [0.0, 0.0, 0.0]


def test_cosine_distance(one):
    constant = F.array_repeat(F.lit(0.05).cast("float"), 1536)
    assert one(cosine_distance(constant, constant)) < 1e-4
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(cosine_distance(a, b)) == pytest.approx(1.0)
    assert one(cosine_distance(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_l2_normalize_and_literal(one):
    v = one(l2_normalize(vector_literal(F.lit("[3, 4.0]"))))
    assert v == pytest.approx([0.6, 0.8])
    assert one(l2_normalize(vector_literal(F.lit("[0, 0]")))) == [0.0, 0.0]


def test_rrf_sample_value(one):
    assert one(rrf_score(F.lit(2), F.lit(2))) == pytest.approx(2 / 62)
    assert one(rrf_score(F.lit(None).cast("int"), F.lit(0))) == 0.0


@pytest.fixture(scope="module")
def rrf_table(spark):
    ranks = spark.range(1, 101).select(F.col("id").alias("a"))
    pairs = ranks.select("a", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("b"))
    return {(r.a, r.b): r.s for r in pairs.select("a", "b", rrf_score(F.col("a"), F.col("b")).alias("s")).collect()}


@settings(max_examples=1000, deadline=None)
@given(a=st.integers(1, 100), b=st.integers(1, 100))
def test_rrf_properties(rrf_table, a, b):
    score = rrf_table[(a, b)]
    assert 0 < score <= 2 / 61
    assert abs(score - rrf_table[(b, a)]) < 1e-12
    if a < 100:
        assert score > rrf_table[(a + 1, b)]


def test_event_round_trip(spark):
    rows = spark.createDataFrame([("e", "s", None, "A \"quoted\" \\ title\n\t\u0001 й", "http://x")],
                                 "e string, s string, x string, t string, u string")
    ts = F.lit("2025-01-01 00:00:00.5").cast("timestamp_ntz")
    value = encode_event(F.col("e"), ts, F.col("s"), F.col("x"), F.col("t"), F.col("u"), F.lit(None).cast("timestamp_ntz"))
    back = rows.select(decode_event(value).alias("d")).select("d.event.*", "d.error").first()
    assert back.error is None
    assert (back.external_id, back.content_type) == ("", "RSS")
    assert back.title == "A \"quoted\" \\ title\n\t\u0001 й"
    assert back.published_at == back.timestamp == datetime(2025, 1, 1, 0, 0, 0, 500000)


def test_decode_flags_bad_records(spark):
    values = ["[neither, an: event", "[]", "null", None, '{"timestamp":"zz"}', '{"publishedAt":"x"}',
              '{"eventId":"e","timestamp":"2025-08-15T10:00","other":1}']
    errors = column(spark, values, lambda c: decode_event(c)["error"])
    assert [e is not None for e in errors] == [True] * 6 + [False]
