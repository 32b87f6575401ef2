"""Web archives (WARC 1.1): pages are written as records, long ones in segments, and read back whole.

Writing is column expressions and Spark's text writer (records end in two line ends, which is the writer's separator), so
archives land wherever Spark can write.  Reading streams each archive's lines through a task: a gzip file isn't split, so
they come in order, and memory holds one record.  Continuation records are grouped by the identifier of their first
segment, ordered by segment number and checked against the total length; then the HTTP message's chunked framing is undone.

Equal payloads are stored once: the page with the largest id is the response, others are revisits that refer to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appfacts.llm.tables import BATCH_BYTES, bit_filter, map_batches, workers_import, written
from appfacts.operators.skew import skew_join
from appfacts.session import ensure_checkpoint_dir

#: Longer blocks are cut into segments of this size.
SEGMENT_BYTES = 4096
#: Least size of a chunk of a body, and most chunks of one.
CHUNK_BYTES, CHUNKS = 1024, 16
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = (
    "file string, record_id string, type string, target_uri string, refers_to string, digest string, segment int,"
    " origin string, total bigint, block binary, problem string"
)
MESSAGE = "record_id string, type string, target_uri string, refers_to string, digest string, payload binary, problem string"


# -- writing ----------------------------------------------------------------------------------------------------


def payload_digest(payload: str) -> Column:
    """SHA-1 of a text or binary column in base 32 (five hexadecimal digits are four of base 32)."""
    five = f"cast(conv(substr(h, cast(i div 4 as int) * 5 + 1, 5), 16, 10) as int)"
    digit = f"substr('{BASE32}', (shiftright({five}, 15 - 5 * (i % 4)) & 31) + 1, 1)"
    return F.expr(f"element_at(transform(array(sha1({payload})), h -> array_join(transform(sequence(0, 31), i -> {digit}), '')), 1)")


def _bytes(*parts: Column | str) -> Column:
    return F.concat(*[(F.lit(p) if isinstance(p, str) else p).cast("binary") for p in parts])


def with_message(df: DataFrame, payload: str, out: str) -> DataFrame:
    """Column ``out``: an HTTP response with the binary column as its body, in at most CHUNKS chunks."""
    n = F.octet_length(payload)
    sized = df.withColumn("__size", F.greatest(F.lit(CHUNK_BYTES), F.ceil(n / CHUNKS)).cast("int")).withColumn(
        "__chunks", F.ceil(n / F.col("__size")).cast("int")
    )
    chunks = F.expr(f"""
        transform(
          slice(sequence(0, {CHUNKS}), 1, __chunks),
          i -> substr({payload}, i * __size + 1, __size))
    """)
    framed = F.aggregate(
        chunks,
        F.lit("").cast("binary"),
        lambda all_, c: F.concat(all_, _bytes(F.lower(F.hex(F.octet_length(c))), "\r\n", c, "\r\n")),
    )
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    return sized.withColumn(out, _bytes(head, framed, "0\r\n\r\n")).drop("__size", "__chunks")


def _safe(header: Column) -> Column:
    """Header text without line ends, which would forge further headers."""
    return F.regexp_replace(F.coalesce(header, F.lit("")), r"[\r\n]", "%20")


def _record(kind: Column | str, record_id: Column, fields: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v, F.lit("\r\n")) for name, v in fields]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    # Raw bytes to the text writer: a cast from binary leaves them as they are.
    return _bytes(head, block).cast("string")


def response_records(responses: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Column ``value``: records of (record_id, url, digest, payload binary), a long block's segments one by one."""
    message = with_message(responses, "payload", "block").select("record_id", "url", "digest", "block")
    count = f"greatest(1, cast(ceil(octet_length(block) / {segment_bytes}) as int))"
    parts = message.select(
        "record_id", "url", "digest", F.octet_length("block").alias("total"), F.expr(count).alias("parts"),
        F.expr(f"posexplode(transform(sequence(1, {count}), i -> substr(block, (i - 1) * {segment_bytes} + 1, {segment_bytes})))").alias("at", "part"),
    )
    first, number = F.col("at") == 0, F.when(F.col("parts") > 1, (F.col("at") + 1).cast("string"))
    record_id = F.when(first, F.col("record_id")).otherwise(F.concat(F.expr("substr(record_id, 1, length(record_id) - 1)"), F.lit("#"), (F.col("at") + 1).cast("string"), F.lit(">")))
    fields = [
        ("WARC-Target-URI", _safe(F.col("url"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        ("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        ("WARC-Segment-Number", number),
        ("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        ("WARC-Segment-Total-Length", F.when(~first & (F.col("at") + 1 == F.col("parts")), F.col("total").cast("string"))),
    ]
    return parts.select(_record(F.when(first, F.lit("response")).otherwise(F.lit("continuation")), record_id, fields, F.col("part")).alias("value"))


def revisit_records(revisits: DataFrame) -> DataFrame:
    """Column ``value``: records of (record_id, url, digest, refers_to) without a body."""
    fields = [
        ("WARC-Target-URI", _safe(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n").cast("binary")
    return revisits.select(_record("revisit", F.col("record_id"), fields, head).alias("value"))


def _page_record(page_id: str, digest: str) -> Column:
    """Record identifier of a page and its payload."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("null")), F.lit(":"), F.col(digest), F.lit(">"))


def write_pages(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write archives of pages (page_id, url, html) to a new folder; returns record_id and copies.

    A page is its id and payload; one repeated in full is archived once (with its least url) and counted in ``copies``.
    Of pages with equal payloads only the one with the largest id (null is the least) is stored, others refer to it.  What
    decides that are ids and digests alone; of the texts, only those that have copies and are kept are shuffled.
    """
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.select("*", payload_digest("payload").alias("digest")).withColumn("record_id", _page_record("page_id", "digest"))
    ids = written(
        keyed.groupBy("record_id").agg(
            F.first("page_id").alias("page_id"), F.first("digest").alias("digest"), F.min("url").alias("url"), F.count(F.lit(1)).alias("copies")
        )
    )
    shared = ids.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    of_shared = written(skew_join(ids, shared, ["digest"]).withColumn("kept", F.expr("page_id <=> keep")))
    losers, winners = of_shared.where("not kept"), of_shared.where("kept").select("record_id")
    revisits = losers.select("record_id", "url", "digest", _page_record("keep", "digest").alias("refers_to"))
    # Pages that stand alone go straight to their archive.  Of the others the texts to store are looked up: those of the
    # winners, of repeated pages without other partners, and of pages that a filter took for one of these by chance.
    special = of_shared.select("record_id").unionByName(ids.where("copies > 1").select("record_id")).distinct()
    repeated = special.join(of_shared.select("record_id"), "record_id", "left_anti")
    chance = bit_filter(ids.select("record_id"), special, ["record_id"]).join(special, "record_id", "left_anti")
    maybe, alone = bit_filter(keyed, special, ["record_id"], both=True)
    stored = (
        bit_filter(maybe, written(winners.unionByName(repeated).unionByName(chance)), ["record_id"])
        .groupBy("record_id", "digest")
        .agg(F.min("url").alias("url"), F.first("payload").alias("payload"))
        .join(losers.select("record_id"), "record_id", "left_anti")
    )
    columns = ["record_id", "url", "digest", "payload"]
    responses = alone.select(*columns).unionByName(stored.select(*columns))
    lines = response_records(responses, segment_bytes).unionByName(revisit_records(revisits))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)
    return ids.select("record_id", "copies")


# -- reading ----------------------------------------------------------------------------------------------------

_FIELDS = {
    b"warc-record-id": "record_id", b"warc-type": "type", b"warc-target-uri": "target_uri", b"warc-refers-to": "refers_to",
    b"warc-payload-digest": "digest", b"warc-segment-number": "segment", b"warc-segment-origin-id": "origin",
    b"warc-segment-total-length": "total", b"content-length": "length",
}


def _header(data: bytes) -> dict:
    """Known fields of a record's header; numbers as such (none where they aren't any)."""
    out: dict = {}
    for line in data.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon and (field := _FIELDS.get(name.strip().lower())):
            text = value.strip().decode("utf-8", "replace")
            out[field] = (int(text) if text.isdigit() else None) if field in ("segment", "total", "length") else text
    return out


class RecordReader:
    """Records of one archive, fed with its bytes in order."""

    def __init__(self, file: str):
        self.file, self.rest, self.at, self.need, self.lost = file, bytearray(), 0, 0, False

    def feed(self, data: bytes, end: bool = False) -> Iterator[dict]:
        """Records that are complete with ``data``; at the end also what is left, as a problem."""
        self.rest += data
        while len(self.rest) - self.at >= max(self.need, 8):
            while self.rest[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            if self.rest[self.at : self.at + 5] != b"WARC/"[: len(self.rest) - self.at]:
                # Something else: go on at the next record that can be seen.
                new = self.rest.find(b"\r\n\r\nWARC/", self.at)
                if not self.lost:
                    yield {"file": self.file, "problem": "no record header"}
                self.lost, self.need = new < 0, 0
                self.at = len(self.rest) - 8 if new < 0 else new + 4
                if new < 0:
                    break
                continue
            head = self.rest.find(b"\r\n\r\n", self.at)
            if head < 0:
                break
            fields = _header(bytes(self.rest[self.at : head]))
            length = fields.pop("length", None)
            if length is None:
                yield {"file": self.file, **fields, "problem": "no length"}
                self.at, self.need = head + 4, 0
                continue
            if len(self.rest) < head + 4 + length:
                self.need = head + 4 + length - self.at
                break
            yield {"file": self.file, **fields, "block": bytes(self.rest[head + 4 : head + 4 + length])}
            self.at, self.need = head + 4 + length, 0
        if self.at > BATCH_BYTES:
            del self.rest[: self.at]
            self.at = 0
        if end and not self.lost and bytes(self.rest[self.at :]).strip():
            yield {"file": self.file, "problem": "cut off"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row (RECORD) for each record of the archives below ``path``; what can't be read is a row with a problem.

    Archives are gzip files (each is read by one task, in order) or plain ones below a split's size.
    """
    lines = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    )
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in RECORD.split(", ")])

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], schema.field(n).type) for n in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, size = None, [], 0
        for batch in batches:
            files = batch.column("file").to_pylist()
            texts = batch.column("line").to_pylist()
            begin = 0
            for i in range(1, len(files) + 1):
                if i < len(files) and files[i] == files[begin]:
                    continue
                data = b"\n".join(texts[begin:i]) + b"\n"
                fresh: list[dict] = []
                if reader is None or reader.file != files[begin]:
                    fresh += reader.feed(b"", end=True) if reader else []
                    reader = RecordReader(files[begin])
                begin = i
                for row in (*fresh, *reader.feed(data)):
                    rows.append(row)
                    size += len(row.get("block", b""))
                    if size > BATCH_BYTES:
                        yield table(rows)
                        rows, size = [], 0
        if reader:
            rows += reader.feed(b"", end=True)
        if rows:
            yield table(rows)

    workers_import(spark)
    return lines.mapInArrow(run, RECORD)


def unchunk(body: bytes) -> bytes | None:
    """A body without its chunked framing; none if that is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            size = int(body[at:line].partition(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            return None
        if size < 0 or line + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


def payload_of(block: bytes) -> tuple[bytes | None, str | None]:
    """Body of an HTTP message as the server had it, and what is wrong with it."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        return None, "no message"
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            plain = unchunk(body)
            return plain, None if plain is not None else "broken chunks"
    return body, None


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records (columns of ``records`` but the segments', and ``blocks``) from records, some of them segments.

    Only segments are shuffled.  A group is one record's segments, so its size is that record's.  Segments must be numbered
    from 1 without gaps, end with one that says the total length, and have that length; copies of a segment count once.
    """
    common = ["record_id", "type", "target_uri", "refers_to", "digest"]
    single = records.where("segment is null and (origin is null)").select(*common, F.array("block").alias("blocks"), "problem")
    parts = records.where("segment is not null or origin is not null").withColumn("of", F.coalesce("origin", "record_id"))
    first = F.struct(*common)
    grouped = parts.groupBy("of").agg(
        F.min_by(first, "segment").alias("first"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("s"),
        F.max("total").alias("total"),
        F.count(F.when(F.col("total").isNotNull(), 1)).alias("ends"),
    )
    gapless = F.expr("s.segment = sequence(1, cast(size(s) as int))")
    length = F.expr("aggregate(s, 0L, (n, x) -> n + octet_length(x.block))")
    problem = F.when(~F.coalesce(gapless, F.lit(False)) | (F.col("ends") == 0), F.lit("segments missing")).when(
        length != F.col("total"), F.lit("length differs")
    )
    return single.unionByName(grouped.select("first.*", F.expr("s.block").alias("blocks"), problem.alias("problem")))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One row (MESSAGE) for each response, revisit or other record of the archives: its payload, unframed and checked.

    A digest in the header must be that of the payload.  Revisits have no payload of their own.  What is wrong stands in
    ``problem``; such rows are kept.
    """

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads, problems = [], []
        kinds, known = batch.column("type").to_pylist(), batch.column("problem").to_pylist()
        for i, blocks in enumerate(batch.column("blocks").to_pylist()):
            payload, problem = None, known[i]
            if problem is None and kinds[i] == "response":
                payload, problem = payload_of(b"".join(b or b"" for b in blocks))
            elif problem is None and kinds[i] != "revisit":
                payload = b"".join(b or b"" for b in blocks)
            payloads.append(payload)
            problems.append(problem)
        kept = [batch.column(c) for c in ("record_id", "type", "target_uri", "refers_to", "digest")]
        names = [f.split()[0] for f in MESSAGE.split(", ")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], names=names)

    messages = map_batches(reassemble(read_records(spark, path)), decode, MESSAGE)
    differs = F.col("payload").isNotNull() & (F.col("digest") != F.concat(F.lit("sha1:"), payload_digest("payload")))
    return messages.withColumn("problem", F.coalesce("problem", F.when(differs, F.lit("digest differs"))))


def archive_pages(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, folder: str | None = None) -> DataFrame:
    """Write pages as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, problem.

    Null texts are empty ones, and empty payloads are equal to each other like any.  Null ids, null addresses, very long
    texts (in segments) and repeated rows (archived once, given back as often) all come back; without pages there are no
    rows.  Columns other than page_id, url and html aren't used.  A revisit's size is that of the response it refers to.
    The archives are written to a new folder below the checkpoint folder, or to ``folder``.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    ids = write_pages(pages, folder, segment_bytes)
    read = written(read_messages(spark, folder).withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).drop("payload"))
    known = read.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("bytes_there"), F.col("digest").alias("digest_there"))
    revisits = skew_join(read.where("type = 'revisit'"), known, ["refers_to"], "left")
    dangling = F.col("bytes_there").isNull() | (F.col("digest") != F.col("digest_there"))
    resolved = revisits.withColumns({"payload_bytes": F.col("bytes_there"), "problem": F.coalesce("problem", F.when(dangling, F.lit("response missing")))})
    both = read.where("type is null or type <> 'revisit'").unionByName(resolved.select(*read.columns))
    id_type = pages.schema["page_id"].dataType

    def page(record: str) -> Column:
        return F.nullif(F.regexp_extract(record, r"^<urn:page:(.*):[A-Z2-7]{32}>$", 1), F.lit("null")).cast(id_type)

    return (
        both.join(ids.where("copies > 1"), "record_id", "left")
        .withColumn("__copy", F.explode(F.expr("sequence(1L, coalesce(copies, 1L))")))
        .select(
            page("record_id").alias("page_id"),
            "payload_bytes",
            F.expr("substr(digest, 6)").alias("payload_digest"),
            F.col("type").alias("record_type"),
            page("refers_to").alias("refers_to"),
            "problem",
        )
    )
