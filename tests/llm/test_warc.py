import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringStartsWith
from pyspark.sql.types import StructType

from patchlore.llm import warc
from tests.llm.conftest import CLASHES

LONG = "<p>caf\xe9 " + "x" * 1200


def brute(rows):
    best = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            best[data] = max(best.get(data, float("-inf")), float("-inf") if page is None else page)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        head = best.get(data)
        own = head is None or head == page or head == float("-inf")
        out.append((page, url, len(data), hashlib.sha1(data).hexdigest(), "response" if own else "revisit", None if own else head))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", LONG), (5, "http://b/%20?q=1", LONG), (3, "http://c/", LONG), (None, "http://d/", LONG), (7, None, "short"), (8, "", "short"),
        (9, "\r\nhttp://line\nbreak \x7f ", None), (10, "http://\xe9日", ""), (-4, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n" * 40),
        (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "z" * 1000), (14, "u", "z" * 1000), (14, "u", "z" * 1000),
        (None, None, "n" * 2000), (None, None, "n" * 2000), (20, "big", "long text " * 300_000)]
ROWS += [(100 + i, f"copy{i}", "hot" * 500) for i in range(60)]


def through_archives(spark, tmp_path, rows, compression="none"):
    extra = CLASHES + ("page", "payload", "head", "record_type")
    pages = spark.createDataFrame([(*r, *([1] * len(extra))) for r in rows], "page_id long, url string, html string" + "".join(f", {c} int" for c in extra))
    folder = str(tmp_path / f"warc-{compression}")
    warc.write_archives(warc.deduplicated(pages), folder, compression)
    return folder, warc.read_archives(spark, folder).filter("record_type in ('response', 'revisit')")


def flat(rows):
    def page(urn):
        return None if urn is None else int(urn.removeprefix("urn:page:"))
    return sorted([(page(r.record_id), r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to)) for r in rows], key=str)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip_equals_brute_force(spark, tmp_path, compression):
    _, back = through_archives(spark, tmp_path, ROWS, compression)
    got = back.collect()
    assert flat(got) == brute(ROWS)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert r.payload is None


def test_query_on_a_table(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op11_warc(spark, str(tmp_path)).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_empty_table(spark, tmp_path):
    _, back = through_archives(spark, tmp_path, [])
    assert back.collect() == []


def test_header_predicates_are_pushed_down(spark, tmp_path):
    folder, _ = through_archives(spark, tmp_path, ROWS)
    everything = warc.read_archives(spark, folder)
    rows = everything.collect()
    picked = [(F.col("record_type") == "revisit", lambda r: r.record_type == "revisit"),
              (F.col("target_uri").startswith("copy") & (F.col("content_length") > 500), lambda r: (r.target_uri or "").startswith("copy") and r.content_length > 500),
              (F.col("refers_to").isNull() & (F.col("record_type") != "warcinfo"), lambda r: r.refers_to is None and r.record_type != "warcinfo"),
              (F.col("record_id").isin("urn:page:1", "urn:page:7"), lambda r: r.record_id in ("urn:page:1", "urn:page:7")),
              ((F.col("payload_bytes") == 5) | (F.col("target_uri") == "u"), lambda r: r.payload_bytes == 5 or r.target_uri == "u"),
              (~(F.col("target_uri") == "u"), lambda r: r.target_uri is not None and r.target_uri != "u")]
    for condition, test in picked:
        assert sorted(map(str, everything.filter(condition).collect())) == sorted(str(r) for r in rows if test(r))
    reader = warc.WarcReader(folder, StructType([]))
    asked = [EqualTo(("record_type",), "revisit"), IsNotNull(("target_uri",)), EqualTo(("payload_bytes",), 3), Not(In(("record_id",), ("a",)))]
    assert list(reader.pushFilters(asked)) == [asked[2]] and reader.filters == [asked[0], asked[1], asked[3]]


class Watched(io.BytesIO):
    """Counts the bytes that are read."""
    taken = 0

    def read(self, *n):
        data = super().read(*n)
        self.taken += len(data)
        return data

    def readline(self, *n):
        data = super().readline(*n)
        self.taken += len(data)
        return data


def record(kind, payload, **more):
    row = dict.fromkeys(("record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "date"))
    return warc.record_bytes({**row, "record_type": kind, "payload": payload, **more}, "2020-01-01T00:00:00Z")


def test_unwanted_payloads_are_not_read():
    data = b"".join(record("response", b"p" * 100_000, target_uri=f"u{i}") for i in range(10)) + record("resource", b"r" * 50_000, target_uri="res")
    for filters, payload, count, most in (([], False, 11, 10_000), ([EqualTo(("record_type",), "resource")], True, 1, 60_000), ([StringStartsWith(("target_uri",), "u3")], True, 1, 110_000)):
        stream = Watched(data)
        got = list(warc.read_records(stream, False, payload, payload, filters))
        assert len(got) == count and stream.taken < most
    assert list(warc.read_records(io.BytesIO(gzip.compress(data[:50]) + gzip.compress(data[50:])), True, True, True, [IsNull(("record_id",)), GreaterThan(("content_length",), 60_000)]))[0]["payload"] == b"p" * 100_000


def test_archives_made_elsewhere(spark, tmp_path):
    body = b"HTTP/1.0 404 Not Found\nX-Folded: a\n b\n\nrest"
    foreign = (b"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI:  http://f/ \r\nWARC-Payload-Digest: sha1:" + b"A9993E364706816ABA3E25717850C26C9CD0D89D" +
               b"\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
               b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.warc").write_bytes(foreign)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(foreign))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, r.target_uri, r.payload_digest, r.payload_bytes, r.payload) for r in got) == [
        ("metadata", None, None, 0, b"")] * 2 + [("response", "http://f/", "a9993e364706816aba3e25717850c26c9cd0d89d", 4, b"rest")] * 2


def test_broken_archives_raise():
    whole = record("response", b"abc" * 100)
    for data in (whole[:40], whole[:-200], b"text\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n"):
        with pytest.raises((EOFError, ValueError)):
            list(warc.read_records(io.BytesIO(data), False, True, True, []))
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(gzip.compress(whole)[:60]), True, True, True, []))


def test_failed_attempts_are_not_read(spark, tmp_path):
    folder, back = through_archives(spark, tmp_path, ROWS)
    (tmp_path / "warc-none" / "part-dead.warc").write_bytes(record("response", b"of a lost task"))
    before = len(ROWS)
    assert back.count() == before
    warc.write_archives(warc.deduplicated(spark.createDataFrame([(500, "u", "more")], "page_id long, url string, html string")), folder)
    assert warc.read_archives(spark, folder).filter("record_type <> 'warcinfo'").count() == before + 1
