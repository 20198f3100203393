"""WARC archives of pages: writing with segmented records, and reassembly.

Writer: a response record holds an HTTP message with chunked transfer framing; a block over
``segment`` bytes goes on in continuation records. Of the records with equal payloads of at
least ``revisit_from`` bytes that with the largest id is the response, the others are revisits.
Records end with an empty line pair, which is the text writer's line separator, so
archives come from Spark's own writer and commit protocol (gzip files of bounded size).

Reader: a file comes as one value (up to 2 GB; the writer makes far smaller ones), is inflated piece by piece and
cut into records by content length; continuations are grouped by their origin's id, ordered by segment number, their total length
is verified, and chunked framing is decoded. A record whose segments are incomplete stays in the
result with a null payload and its status.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import written

SEGMENT, CHUNK, REVISIT_FROM, FILE_RECORDS, SALTS = 16_384, 4_096, 1_000, 2_000, 16
#: Message and record heads (fixed values of the formats).
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload string, n, digest, keeper): keeper is set on revisits.

    Equal payloads are found among ids and digests alone; a digest that very many pages have is dealt over ``SALTS``
    tasks. Which pages revisit which is written as a narrow table and joined to the pages by id and digest: if its
    size is below Spark's limit it is broadcast and no payload moves, else payloads are shuffled once, spread evenly by
    page, never gathered by digest. Null html is an empty payload; a null id is never a keeper; rows that repeat id
    and payload are alike."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    long = rows.where(F.col("n") >= revisit_from).select("page_id", "digest", "n")
    groups = long.groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and keeper is not null").drop("copies")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = long.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = mine.join(salted, ["digest", "n", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    told = written(revisits.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "keeper").distinct(), "warc-revisits")
    return rows.join(told, rows["page_id"].eqNullSafe(told["id"]) & (rows["digest"] == told["of"]), "left").drop("id", "of")


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(planned: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """One text row a record, without the final empty lines."""
    raw = F.col("payload").cast("binary")
    piece = lambda at: F.substring(raw, at + 1, F.lit(chunk))
    framed = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)).cast("int"), F.lit(chunk)), lambda at: F.concat(F.lower(F.hex(F.octet_length(piece(at)).cast("long"))), F.lit("\r\n"), piece(at).cast("string"), F.lit("\r\n")))
    body = F.when(F.col("n") > 0, F.array_join(framed, "")).otherwise("")
    block = F.when(F.col("keeper").isNull(), F.concat(F.lit(HTTP_HEAD), body, F.lit("0\r\n\r\n"))).otherwise("")
    rows = planned.withColumn("id", F.uuid()).withColumn("block", block.cast("binary")).withColumn("size", F.octet_length("block"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(segment))))
    part = F.substring(F.col("block"), F.col("at") + 1, F.lit(segment))
    number = (F.col("at") / segment).cast("int") + 1
    cut, last = F.col("size") > segment, F.col("at") + segment >= F.col("size")
    revisit = F.col("keeper").isNotNull()
    kind = F.when(revisit, "revisit").when(number == 1, "response").otherwise("continuation")
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url"), "%", "%25"), "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", urn(F.when(number == 1, F.col("id")).otherwise(F.concat("id", F.lit("-"), number.cast("string"))))),
        _field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _field("WARC-Target-URI", safe),
        _field("WARC-Page-ID", F.col("page_id").cast("string")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Payload-Length", F.col("n").cast("string")),
        _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("WARC-Refers-To-Page-ID", F.col("keeper").cast("string")),
        _field("WARC-Segment-Number", F.when(cut, number.cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(number > 1, urn(F.col("id")))),
        _field("WARC-Segment-Total-Length", F.when(cut & last, F.col("size").cast("string"))),
        _field("Content-Type", F.when(number == 1, "application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(part).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, part.cast("string")).alias("value"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, **names: str) -> None:
    """Archives of all ``pages`` below ``path``. Null html is an empty payload, null ids and urls
    are left out of the head; repeated rows are records each."""
    rows = records(plan_records(pages, **names), segment)
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_PARSED = "kind string, id string, origin string, number int, total long, page_id long, url string, digest string, length long, refers_to long, block binary"
_FIELDS = [("WARC-Type", str), ("WARC-Record-ID", str), ("WARC-Segment-Origin-ID", str), ("WARC-Segment-Number", int), ("WARC-Segment-Total-Length", int), ("WARC-Page-ID", int), ("WARC-Target-URI", str), ("WARC-Payload-Digest", str), ("WARC-Payload-Length", int), ("WARC-Refers-To-Page-ID", int)]
_KINDS = pa.schema([("kind", pa.string()), ("id", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.int64()), ("block", pa.binary())])
#: Bytes of a batch of records, and of a piece that is inflated at a time.
BATCH_BYTES, PIECE = 8 << 20, 1 << 20


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, gzip members (one or many) inflated piece by piece."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    one, tail, at, more = zlib.decompressobj(31), b"", 0, False
    while more or tail or at < len(data):
        if not tail and not more:
            tail, at = data[at : at + PIECE], at + PIECE
        out = one.decompress(tail, PIECE)
        tail, more = one.unconsumed_tail, len(out) == PIECE
        if one.eof:
            tail, more, one = one.unused_data, False, zlib.decompressobj(31)
            whole = True
        else:
            whole = False
        if out:
            yield out
    if not whole:
        raise ValueError("a gzip member is cut short")


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads (names in lower case) and blocks of an archive's records; holds one record at a time.

    Bytes that are no record, or a record cut short, are a ValueError."""
    held, pieces = bytearray(), iter(pieces)

    def has(n: int) -> bool:
        while len(held) < n:
            new = next(pieces, None)
            if new is None:
                return False
            held.extend(new)
        return True

    while has(1):
        if held[:1] in b"\r\n":
            del held[:1]
            continue
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not has(len(held) + 1):
                raise ValueError("a record's head is cut short")
        version, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record: {version[:40]!r}")
        head = {name.strip().lower(): value.removeprefix(" ") for name, _, value in (x.partition(":") for x in lines)}
        size = end + 4 + int(head["content-length"])
        if not has(size):
            raise ValueError("a record is cut short")
        yield head, bytes(held[end + 4 : size])
        del held[:size]


def unchunked(message: bytes) -> bytes:
    """The payload of an HTTP message, chunked framing decoded."""
    head, _, body = message.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        at = end + 4 + size


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS.types, strict=True)], schema=_KINDS)

    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for head, block in parse(inflated(content.as_buffer().to_pybytes())):
                rows.append([None if (v := head.get(name.lower())) is None else kind(v) for name, kind in _FIELDS] + [block])
                held += len(block)
                if held >= BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        blocks, status = columns.pop("block").to_pylist(), columns["status"].to_pylist()
        for k, kind in enumerate(columns["kind"].to_pylist()):
            if kind == "response" and blocks[k] is not None:
                try:
                    blocks[k] = unchunked(blocks[k])
                except ValueError:
                    blocks[k], status[k] = None, "broken"
        columns |= {"status": pa.array(status, pa.string()), "payload": pa.array(blocks, pa.binary())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, digest, length, refers_to, status, payload), one row a record.

    status is whole, reassembled, incomplete (segments are missing or don't sum up to the stated length) or broken
    (the chunked framing of a response is wrong); the payload of the last two is null, as is that of revisits. Records
    of other kinds come with their block as it is, fields that a head lacks are null, a folder of empty files gives
    no rows; a file that is no archive is an error. Files may be gzip, one member for all or for each record."""
    files = spark.read.format("binaryFile").load(path).select("content")
    cut = files.mapInArrow(_cut, _PARSED)
    keep = ["page_id", "url", "kind", "digest", "length", "refers_to", "status", "block"]
    whole = cut.where("number is null").withColumn("status", F.lit("whole")).withColumn("block", F.when(F.col("kind") != "revisit", F.col("block"))).select(keep)
    parts = cut.where("number is not null").withColumn("origin", F.coalesce("origin", "id"))
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    groups = parts.groupBy("origin").agg(*[first(c) for c in ("page_id", "url", "kind", "digest", "length", "refers_to")], F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    in_order = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    good = F.coalesce(in_order & (size == F.col("total")), F.lit(False))
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    again = groups.withColumn("status", F.when(good, "reassembled").otherwise("incomplete")).withColumn("block", F.when(good, joined)).select(keep)
    schema = "page_id long, url string, kind string, digest string, length long, refers_to long, status string, payload binary"
    out = whole.unionByName(again).mapInArrow(_decode, schema)
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%0A", "\n"), "%0D", "\r"), "%25", "%")
    return out.withColumn("url", named).withColumn("digest", F.regexp_replace("digest", "^sha1:", "")).withColumnRenamed("kind", "record_type")


def archive_digests(archives: DataFrame) -> DataFrame:
    """The contract's columns: from the payload read back, or for a revisit from its head."""
    has = F.col("payload").isNotNull()
    return archives.select("page_id", F.when(has, F.octet_length("payload").cast("long")).otherwise(F.col("length")).alias("payload_bytes"), F.when(has, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")
