import gzip
import hashlib

import pytest

from swayrank.llm import warc

SCHEMA = "page_id long, url string, html string"
LONG = "é<p>\r\n\r\nWARC/1.0\n" * 20

ROWS = [
    (5, "http://a/x y", LONG), (3, "http://b/\n", LONG), (9, None, LONG), (9, None, LONG), (1, "http://é/", "short"),
    (2, "u", "short"), (4, "v", None), (6, "w", ""), (None, "n", LONG), (7, "filedesc://z", "y" * 100), (8, "q", "y" * 99),
    (10, "r", "y" * 99), (11, "big", "long page \n" * 300_000), (12, "big", "long page \n" * 300_000),
]


def expected(rows):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body]
        first = min(p for p in same if p is not None) if len(body) >= 100 else page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), first))
    return out


@pytest.mark.parametrize("versions,parts,file_bytes,listed", [((1,), 1, 300, 0), ((2,), 3, 1, 100), ((1, 2), 5, warc.FILE_BYTES, 100)])
def test_round_trip(spark, monkeypatch, versions, parts, file_bytes, listed):
    monkeypatch.setattr(warc, "MAX_BROADCAST_REVISITS", listed)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(parts).selectExpr("*", "1 as path", "2 as digest", "'x' as payload")
    found = warc.archive_pages(df, versions=versions, file_bytes=file_bytes).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in found), key=str)
    assert got == sorted((e[:3] for e in expected(ROWS)), key=str)
    firsts = {(p, d): f for p, _, d, f in expected(ROWS)}
    by_digest = {}
    for r in found:
        first = firsts[r.page_id, r.payload_digest]
        by_digest.setdefault(r.payload_digest, []).append(r)
        if r.record_type == "revisit":
            assert r.refers_to == first and r.payload is None and r.payload_bytes >= 100
        else:
            assert r.refers_to is None and r.page_id == first and hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
    for same in by_digest.values():
        responses = [r for r in same if r.record_type == "response"]
        assert len(responses) == (1 if same[0].payload_bytes >= 100 else len(same))
    urls = {r.page_id: r.url for r in found}
    assert urls[5] == "http://a/x%20y" and urls[3] == "http://b/%0A" and urls[9] is None and urls[1] == "http://é/"
    assert len({r.record_id for r in found}) == len(ROWS) and {r.date for r in found} == {"2000-01-01T00:00:00Z"}


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def packed(text):
    return gzip.compress(text if isinstance(text, bytes) else text.encode())


def test_foreign_archive_with_other_types():
    block = "1 0 origin\nURL IP-address Archive-date Content-type Archive-length\n"
    text = (
        f"filedesc://f.arc 0.0.0.0 199609 text/plain {len(block)}\n{block}\n"
        "dns:a 1.2.3.4 19970102030405 text/dns 5\nhello\n\n"
        "http://a/ 1.2.3.4 199701020304 text/html 21\nHTTP/1.0 200 OK\r\n\r\nhi\n"
    )
    records = list(warc.warc_records(gzip.compress(b"".join(warc._converted("p", packed(text), {})))))
    assert [f["warc-type"] for f, _ in records] == ["warcinfo", "resource", "response"]
    assert [f["warc-date"] for f, _ in records] == ["1996-09-01T00:00:00Z", "1997-01-02T03:04:05Z", "1997-01-02T03:04:00Z"]
    assert records[1][1] == b"hello" and records[1][0]["content-type"] == "text/dns"
    assert records[2][0]["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"hi").hexdigest()
    assert records[2][0]["warc-ip-address"] == "1.2.3.4"


GOOD = b"http://a/ 1.2.3.4 19970102030405 text/html 5\nhello\n"


@pytest.mark.parametrize("broken,reason,survivors", [
    (b"http://a/ 1.2.3.4 1997 text/html 99\nshort", "declares 99 bytes but 5 are left", 0),
    (b"http://a/ 1.2.3.4 text/html 5\nshort\n", "not a header", 1),
    (b"http://a/ 1.2.3.4 1997 text/html 2\nlonger\n", "not a header", 2),
    (b"filedesc://x 0.0.0.0 1997 text/plain 10\n9 0 origin\n", "not a known ARC version", 1),
])
def test_broken_records_are_reported_and_others_survive(broken, reason, survivors):
    made = list(warc.arc_records(packed(GOOD + broken + (GOOD if survivors else b""))))
    faults = [r for r in made if isinstance(r, warc.Fault)]
    assert len(faults) == 1 and reason in faults[0].reason and faults[0].n_bytes > 0
    good = [r[1] for r in made if not isinstance(r, warc.Fault)]
    assert good == [[b"hello"], [b"hello"] * 2, [b"hello", b"lo", b"hello"]][survivors]


def test_a_broken_stream_is_reported():
    made = list(warc.arc_records(packed(GOOD) + packed(GOOD)[:-9]))
    assert [r[1] for r in made if not isinstance(r, warc.Fault)][0] == b"hello" and isinstance(made[-1], warc.Fault)


def test_foreign_bytes_spaces_and_images(spark, tmp_path):
    """Payloads that are no UTF-8, URLs and content types with spaces, one member a record, and a fault between them."""
    image = bytes(range(256)) * 3
    page = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n".encode() + "<p>caf\xe9</p>".encode("latin-1") * 20
    record = lambda url, kind, block: f"{url} 1.2.3.4 19970102030405 {kind} {len(block)}\n".encode() + block + b"\n"
    records = [
        record("http://a/b c d", "text/html; charset=latin-1", page), b"rubbish\n",
        record("http://a/i.gif", "image/gif", b"HTTP/1.0 200 OK\r\n\r\n" + image), record("http://a/copy", "text/html", page),
    ]
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "part-0.arc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    made = warc.read_warc(spark, warc.convert(spark, str(folder), str(tmp_path / "warc"))).collect()
    kinds = {r.url: (r.record_type, r.payload_digest, r.payload_bytes) for r in made}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    body = page.partition(b"\r\n\r\n")[2]
    assert kinds == {
        "http://a/b%20c%20d": ("response", digest(body), len(body)), "http://a/i.gif": ("response", digest(image), len(image)),
        "http://a/copy": ("revisit", digest(body), len(body)),
    }
    assert {bytes(r.payload) for r in made if r.payload is not None} == {body, image}
    faults = warc.arc_faults(spark, str(folder)).collect()
    assert [(f.ordinal, f.n_bytes) for f in faults] == [(1, 8)] and "rubbish" in faults[0].fault


def test_a_record_can_be_read_alone(spark, tmp_path):
    """Every record is a gzip member of its own."""
    arc = warc.write_arc(spark.createDataFrame(ROWS, SCHEMA).repartition(1), str(tmp_path / "arc"))
    for file in (tmp_path / "arc").glob("part-*"):
        content = file.read_bytes()
        starts = [i for i in range(len(content)) if content.startswith(b"\x1f\x8b\x08", i)]
        members = [gzip.decompress(content[a:b]) for a, b in zip(starts, [*starts[1:], len(content)])]
        assert members[-1] == b"" and len(members) == len(ROWS) + 2 and all(m.endswith(b"\n") for m in members[:-1])
    assert arc == str(tmp_path / "arc")


@pytest.mark.parametrize("given,wanted", [
    ("19991231235959", "1999-12-31T23:59:59Z"), ("1999", "1999-01-01T00:00:00Z"), ("0", "1970-01-01T00:00:00Z"),
    ("19991331000000", "1970-01-01T00:00:00Z"), ("", "1970-01-01T00:00:00Z"), ("x", "1970-01-01T00:00:00Z"),
])
def test_dates(given, wanted):
    assert warc.warc_date(given) == wanted
