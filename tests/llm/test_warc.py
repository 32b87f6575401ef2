"""Archives: exact round trips, and what reading does with segments out of order, broken, or of other writers."""

import base64
import gzip
import hashlib
import random

import pytest

from appfacts.llm.warc import RecordReader, archive_pages, payload_of, read_messages, read_records, reassemble, unchunk

SCHEMA = "page_id bigint, url string, html string, record_id string, digest string, payload string, copies int"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    best, out = {}, []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        best[data] = max(best.get(data, -1), -1 if page is None else page)
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        first = (-1 if page is None else page) == best[data]
        out.append((page, len(data), digest(data), "response" if first else "revisit", None if first else best[data], None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA)


def test_given_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    assert sorted((tuple(r) for r in archive_pages(table).collect()), key=repr) == brute(rows)


def test_hand_made(spark, tmp_path):
    pick = random.Random(2)
    nasty = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n"
    rows = [(i, f"http://h/{i}", "".join(pick.choices("aé\r\n 日", k=pick.choice([0, 1, 5, 900, 9000])))) for i in range(40)]
    rows += [(50, None, None), (51, "", ""), (52, "u\r\nWARC-Type: x", nasty), (53, "u", nasty * 400), (None, "u", "nothing else"), (None, "u", "shared")]
    rows += [(60 + i, "u", "shared") for i in range(300)] + [(400, "u", "again")] * 50 + [(401, "v", "new " * 500_000)] + [(402, "v", "twice")] * 2 + [(403, "v", "twice")]
    folder = str(tmp_path / "archives")
    got = archive_pages(pages(spark, rows), segment_bytes=1000, folder=folder).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert read_records(spark, folder).where("type = 'continuation'").count() > 2000
    messages = {r.record_id: r for r in read_messages(spark, folder).collect()}
    assert bytes(messages[f"<urn:page:52:{digest(nasty.encode())}>"].payload) == nasty.encode()
    assert all(r.problem is None for r in messages.values())
    assert archive_pages(pages(spark, [])).count() == 0


def record(kind, block, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Members for each record, segments in other files and orders, lower-case names, missing and wrong parts."""
    message = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n5;x=1\r\nhello\r\n6\r\n\r\nyou!\r\n0\r\n\r\n"
    parts = [message[:20], message[20:50], message[50:]]

    def segments(name, of, total, numbers=(1, 2, 3)):
        out = []
        for i in numbers:
            fields = {"WARC_Record_ID": f"<{name}{i}>" if i > 1 else f"<{name}>", "warc_segment_number": i}
            fields |= {"WARC-Segment-Origin-ID": f"<{name}>"} if i > 1 else {"WARC-Payload-Digest": f"sha1:{of}"}
            fields |= {"WARC-Segment-Total-Length": total} if i == 3 else {}
            out.append(record("continuation" if i > 1 else "response", parts[i - 1], **fields))
        return out

    right = digest(b"hello\r\nyou!")
    a, b = segments("good", right, len(message)), segments("short", right, len(message) + 1)
    c, d = segments("gap", right, len(message), (1, 3)), segments("off", digest(b"x"), len(message))
    info = record("warcinfo", b"software: x\r\n", WARC_Record_ID="<info>")
    plain = record("response", b"HTTP/1.1 200 OK\r\n\r\nplain", WARC_Record_ID="<plain>")
    broken = record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhel", WARC_Record_ID="<broken>")
    one = b"".join(gzip.compress(x) for x in (info, a[2], a[1], plain, b[0], *c, broken))
    (tmp_path / "one.warc.gz").write_bytes(one)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join([a[0], a[1], *b[1:], *d])))
    (tmp_path / "three.warc").write_bytes(b"junk\r\n\r\n" + plain.replace(b"<plain>", b"<late>") + plain[:40])
    got = {r.record_id: r for r in read_messages(spark, str(tmp_path)).collect()}
    assert bytes(got["<good>"].payload) == b"hello\r\nyou!" and got["<good>"].problem is None
    assert {k: r.problem for k, r in got.items() if r.problem and k} == {
        "<short>": "length differs", "<gap>": "segments missing", "<off>": "digest differs", "<broken>": "broken chunks",
    }
    assert bytes(got["<plain>"].payload) == b"plain" == bytes(got["<late>"].payload) and bytes(got["<info>"].payload) == b"software: x\r\n"
    problems = sorted(r.problem for r in read_records(spark, str(tmp_path)).where("problem is not null").collect())
    assert problems == ["cut off", "no record header"]
    assert reassemble(read_records(spark, str(tmp_path))).where("record_id = '<good>'").count() == 1


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_reader_in_pieces(size):
    records = [record("response", bytes([i]) * (i * 31), WARC_Record_ID=f"<{i}>") for i in range(9)]
    data = b"".join(records)
    reader, got = RecordReader("f"), []
    for i in range(0, len(data), size):
        got += reader.feed(data[i : i + size])
    got += reader.feed(b"", end=True)
    assert [(r["record_id"], r["block"]) for r in got] == [(f"<{i}>", bytes([i]) * (i * 31)) for i in range(9)]


def test_framing():
    assert unchunk(b"0\r\n\r\n") == b"" and unchunk(b"3\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: x\r\n\r\n") == b"abc0123456789"
    assert [unchunk(x) for x in (b"", b"x\r\n", b"3\r\nab", b"3\r\nabcd\r\n0\r\n\r\n", b"-1\r\n")] == [None] * 5
    assert payload_of(b"no message") == (None, "no message")
