import gzip
import hashlib

import pytest

from pitlake.llm import warc

LONG = "<p>same page</p>" * 20
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2 b\n", LONG), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "short"), (6, "http://a/6", "short"),
         (7, "http://a/7", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nHTTP/1.1 200\r\n\r\n\n" * 5), (8, "", "é漢" * 100), (0, "http://a/0", LONG), (0, "http://a/0", LONG), (None, "http://a/n", LONG)]
SCHEMA = "page_id long, url string, html string"


def brute(pages):
    least = {}
    for page_id, _, html in pages:
        if len((html or "").encode()) >= 100:
            least[html] = min(x for x in (least.get(html), page_id) if x is not None) if page_id is not None or html in least else page_id
    seen, out = set(), []
    for page_id, _, html in pages:
        body = (html or "").encode()
        first = len(body) < 100 or page_id == least[html] and html not in seen
        if first:
            seen.add(html)
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if first else "revisit", None if first else least[html]))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    got = warc.archive_pages(spark, spark.createDataFrame(PAGES, SCHEMA).repartition(3)).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(PAGES)
    assert all(r.intact for r in got) and {r.record_date for r in got} == {"2000-01-01T00:00:00Z"}
    assert len({r.record_id for r in got}) == len(PAGES)


@pytest.mark.parametrize("version", [1, 2])
def test_versions_and_payloads(spark, tmp_path, version):
    warc.write_arc(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), f"{tmp_path}/arc", version)
    data = next((tmp_path / "arc").glob("*.gz")).read_bytes()
    found = list(warc.arc_records("x", data))
    assert len(found) == len(PAGES) and set(found[0][0]) == set(warc.ARC_FIELDS[version])
    assert [f[0] for f in warc.arc_records("x", gzip.decompress(data))] == [f[0] for f in found]
    assert sorted(warc.split_http(c)[1] for _, _, c in found) == sorted((h or "").encode() for _, _, h in PAGES)
    plain = gzip.decompress(data)
    for _, offset, content in found:
        assert plain[offset:].split(b"\n", 1)[1].startswith(content)
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    payloads = {r.target_uri: bytes(r.payload) for r in warc.read_warc(spark, f"{tmp_path}/warc", with_payload=True).where("record_type = 'response'").collect()}
    assert payloads["http://a/7"] == PAGES[6][2].encode() and payloads["http://a/4"] == b""


def test_other_writers_files():
    block = b"1 0 X\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://x 0.0.0.0 19990101000000 text/plain %d\n" % len(block) + block + b"\nhttp://h/ 1.2.3.4 19990102030405 image/gif 5\nGIF\n!\n\nhttp://i/ 1.2.3.4 19990102 text/plain 0\n\n"
    found = list(warc.arc_records("x", data))
    assert [(f["URL"], c) for f, _, c in found] == [("http://h/", b"GIF\n!"), ("http://i/", b"")]
    assert warc.warc_date("19990102030405") == "1999-01-02T03:04:05Z" and warc.warc_date("19990102") == "1999-01-02T00:00:00Z"
    with pytest.raises(ValueError, match="declares"):
        list(warc.arc_records("x", data[:-30].replace(b"gif 5", b"gif 500")))
    with pytest.raises(ValueError, match="fields"):
        list(warc.arc_records("x", data.replace(b" image/gif", b"")))
    with pytest.raises(ValueError, match="version"):
        list(warc.arc_records("x", data.replace(b"1 0 X", b"7 0 X")))


def test_long_headers_and_packed_payloads(spark):
    """A url of two MiB, and a payload that inflates to many times what a task takes in at once."""
    pages = [(1, "http://a/" + "u" * (2 << 20), "x" * 200), (2, "http://a/2", "ab" * (12 << 20)), (3, "http://a/3", "x" * 200)]
    got = warc.archive_pages(spark, spark.createDataFrame(pages, SCHEMA).coalesce(1)).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(pages)
    assert all(r.intact for r in got) and max(len(r.target_uri) for r in got) == 9 + (2 << 20)


def test_inflating_is_bounded():
    stream = warc.Stream("x", gzip.compress(b"z" * (40 << 20)) + gzip.compress(b"end\n"))
    assert stream.more() and len(stream.ready) <= warc.INFLATED
    assert stream.take(40 << 20) == b"z" * (40 << 20) and stream.until(b"\n") == b"end" and stream.until(b"\n") is None


def test_levels_only_change_the_size(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "some words again and again " * 200 + str(i)) for i in range(50)], SCHEMA).coalesce(1)
    sizes, contents = [], []
    for level in ("BEST_SPEED", "BEST_COMPRESSION"):
        warc.write_arc(df, f"{tmp_path}/{level}", 1, level)
        data = next((tmp_path / level).glob("*.gz")).read_bytes()
        sizes.append(len(data))
        contents.append(gzip.decompress(data))
    assert sizes[0] > sizes[1] and contents[0] == contents[1]


def test_empty(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], SCHEMA)).count() == 0
