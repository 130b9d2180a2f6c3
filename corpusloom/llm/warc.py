"""WARC archives: writing captures as transactions, and assembling transactions from archives.

A capture is a request, a response or revisit, and a metadata record; request and metadata name the
response by WARC-Concurrent-To. Payloads that repeat become revisits of the response with the
largest page_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._rows import map_batches
from ._store import written

#: Payloads of fewer bytes are always written in full.
REVISIT_FROM = 1000
#: Records of one file at most.
RECORDS = 3000
_END = "\r\n"
_VERSION = "WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def _record(headers: dict[str, Column], block: Column) -> Column:
    """A record without the two line ends after it, which the text writer puts between rows."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit(f"{_VERSION}0{_END}"), F.concat_ws(_END, *lines, length), F.lit(_END * 2), block)


def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, n_bytes, copy_of, nth`` of each page.

    ``copy_of`` is the largest page_id with an equal payload of ``REVISIT_FROM`` bytes or more, where
    that is another one; rows that repeat the largest id are responses too. Null html is an empty
    payload; a null page_id is less than any other. ``nth`` numbers rows of equal id and payload.
    """
    payload = F.coalesce("html", F.lit(""))
    all_pages = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("bigint").alias("n_bytes"))
    all_pages = all_pages.withColumn("key", F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest"))
    ids = all_pages.filter(F.col("n_bytes") >= REVISIT_FROM).select("page_id", "digest", "n_bytes", "key")
    largest = ids.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("copy_of"), F.count("*").alias("n")).filter("n > 1 and copy_of is not null").drop("n")
    copies = ids.join(largest, ["digest", "n_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("copy_of"))).select("key", "copy_of").distinct()
    # Window and join have the same one key, so payloads are dealt out once for both.
    numbered = all_pages.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("url")))
    return numbered.join(copies, "key", "left").drop("key")


def records(captured: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``record`` of each request, response or revisit, and metadata record of each capture."""
    key = lambda page, nth: (F.coalesce(page.cast("string"), F.lit("")), F.col("digest"), nth.cast("string"))
    own = key(F.col("page_id"), F.col("nth"))
    me = _uuid(*own, F.lit("response"))
    # What can't stand in a header line is percent-encoded.
    url = F.coalesce("url", F.concat(F.lit("urn:page:"), own[0]))
    for code in (*range(0x00, 0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    host, path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(_END * 2))
    common = lambda kind, id_: {"WARC-Type": F.lit(kind), "WARC-Record-ID": id_, "WARC-Date": F.lit(date), "WARC-Target-URI": F.col("_url")}
    labelled = F.concat(F.lit("sha1:"), F.col("digest"))
    request = _record(common("request", _uuid(*own, F.lit("request"))) | {"WARC-Concurrent-To": F.col("_me"), "Content-Type": F.lit("application/http; msgtype=request")}, F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(f" HTTP/1.1{_END}Host: "), host, F.lit(_END * 2)))
    response = _record(common("response", F.col("_me")) | {"WARC-Payload-Digest": labelled, "Content-Type": F.lit("application/http; msgtype=response")}, F.concat(http, F.col("payload")))
    revisit = _record(common("revisit", F.col("_me")) | {"WARC-Payload-Digest": labelled, "WARC-Profile": F.lit(_PROFILE), "WARC-Refers-To": _uuid(*key(F.col("copy_of"), F.lit(1)), F.lit("response")), "Content-Type": F.lit("application/http; msgtype=response")}, http)
    metadata = _record(common("metadata", _uuid(*own, F.lit("metadata"))) | {"WARC-Concurrent-To": F.col("_me"), "Content-Type": F.lit("application/warc-fields")}, F.concat(F.lit("page_id: "), own[0], F.lit(_END)))
    named = captured.withColumns({"_me": me, "_url": url})
    return named.select(F.explode(F.array(request, F.when(F.col("copy_of").isNull(), response).otherwise(revisit), metadata)).alias("record"))


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write gzip-compressed archives of all pages to a folder."""
    records(captures(pages), date).write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


_FIELDS = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-concurrent-to": "concurrent_to", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date", "warc-payload-digest": "labelled_digest"}


def _parsed(head: bytes, block: bytes) -> dict:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    out = {column: fields.get(name) for name, column in _FIELDS.items()}
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        return out | {"http": http.decode("utf-8", "replace"), "payload": payload, "complete": True}
    return out | {"http": None, "payload": block, "complete": True}


_MARK, _BREAK = _VERSION.encode(), b"\r\n\r\n"


def _records(chunks: Iterator[tuple[int, bytes]]) -> Iterator[dict]:
    """Records from what stands between occurrences of the version mark, each with its file's number.

    A block goes on for as many bytes as Content-Length says, whatever marks it contains. A record
    that its file ends in the middle of has ``complete`` false and what there is of it.
    """
    of, size, head = None, -1, None
    parts: list[bytes] = []
    n = 0  # bytes of the block so far, once its length is known

    def cut() -> dict | None:
        if head is None and not any(parts):
            return None
        if head is None:
            start, _, block = b"".join(parts).partition(_BREAK)
            return _parsed(start, block) | {"complete": False}
        block = b"".join(parts)
        return _parsed(head, block[:size]) | {"complete": len(block) >= size}

    for file, chunk in chunks:
        if of != file or head is None or n >= size:
            if found := cut():
                yield found
            of, size, head = file, -1, None
            start, mark, block = chunk.partition(_BREAK)
            length = [line.partition(b":")[2].strip() for line in start.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            if mark and length and length[0].isdigit():
                size, head, parts, n = int(length[0]), start, [block], len(block)
            else:
                parts = [chunk]
        else:
            parts += [_MARK, chunk]
            n += len(_MARK) + len(chunk)
    if found := cut():
        yield found


#: Suffixes of files that Spark never splits.
_WHOLE = (".gz", ".zst", ".zstd", ".lz4", ".snappy", ".deflate")


def _chunks(spark: SparkSession, path: str) -> list[DataFrame]:
    """``file, chunk`` of what stands between version marks, each file's chunks in order and in one task.

    A compressed file is one split. A plain file may have several, and a body may contain the mark, so
    only what comes before a chunk in its file tells a record from a body: its chunks are brought
    together by file and put in the order of splits and rows.
    """
    files = spark.read.text(path).inputFiles()
    whole = [f for f in files if f.endswith(_WHOLE)]
    plain = [f for f in files if not f.endswith(_WHOLE)]
    found = []
    reader = spark.read.option("lineSep", _VERSION)
    file, chunk = F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("chunk")
    if whole:
        found.append(reader.text(whole).select(file, chunk))
    if plain:
        placed = reader.text(plain).select(file, chunk, F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
        found.append(placed.repartition("file").sortWithinPartitions("file", "split", "row").select("file", "chunk"))
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, warc_type, concurrent_to, refers_to, target_uri, date, labelled_digest, http, payload, complete, n_bytes, digest`` of each record.

    Archives are read as streams of chunks, so a file is never held as a whole; WARC 1.0 and 1.1, plain
    or compressed as Spark's text reader knows. ``n_bytes`` and ``digest`` are of the payload as read.
    A record that ends before its Content-Length has ``complete`` false. Files without records, and a
    folder without files, give no rows.
    """
    names = [*_FIELDS.values(), "http", "payload", "complete"]
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.bool_() if n == "complete" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in _records(pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            rows.append(row)
            size += len(row["payload"])
            if size > 1 << 20 or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = ", ".join(f"{n} {'binary' if n == 'payload' else 'boolean' if n == 'complete' else 'string'}" for n in names)
    parsed = [map_batches(chunks, run, ddl) for chunks in _chunks(spark, path)] or [spark.createDataFrame([], ddl)]
    found = parsed[0] if len(parsed) == 1 else parsed[0].unionByName(parsed[1])
    return found.withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})


def transactions(found: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row for each capture: ``capture_id, target_uri, date, response, request, metadata``.

    Requests and metadata are joined to the response or revisit that they are concurrent to; where one
    is missing its struct is null, and records that name no capture in the archives are left out, as
    are incomplete ones (``read`` has them, with ``complete`` false). The archives are parsed once:
    records are written and the joins read them back. Without ``payload``, bodies stay out of that;
    their sizes and digests are there. Repeated records give repeated rows; no records, no rows.
    """
    fields = F.when(F.col("warc_type") == "metadata", F.col("payload").cast("string")).alias("fields")
    body = F.when(F.col("warc_type").isin("response", "revisit"), F.col("payload")).alias("payload")
    slim = written(found.filter("complete").select("record_id", "warc_type", "concurrent_to", "refers_to", "target_uri", "date", "labelled_digest", "http", *[body] * payload, fields, "complete", "n_bytes", "digest"), "records")
    main = slim.filter(F.col("warc_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), "target_uri", "date", F.struct("warc_type", "http", *["payload"] * payload, "n_bytes", "digest", "labelled_digest", "refers_to", "complete").alias("response"))
    beside = lambda kind, *columns: slim.filter((F.col("warc_type") == kind) & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", *columns).alias(kind))
    return main.join(beside("request", "http"), "capture_id", "left").join(beside("metadata", "fields"), "capture_id", "left")


def resolved(assembled: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each transaction; a revisit has those of the payload it refers to."""
    page = F.nullif(F.regexp_extract("metadata.fields", r"(?m)^page_id: ?(-?[0-9]*)", 1), F.lit("")).cast("bigint")
    flat = assembled.select("capture_id", page.alias("page_id"), F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("target"), F.col("response.n_bytes").alias("n_bytes"), F.col("response.digest").alias("digest"))
    flat = written(flat, "captures")
    targets = flat.filter("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("n_bytes").alias("of_bytes"), F.col("digest").alias("of_digest"))
    return flat.join(targets, "target", "left").select("page_id", F.coalesce("of_bytes", "n_bytes").alias("payload_bytes"), F.coalesce("of_digest", "digest").alias("payload_digest"), "record_type", "refers_to")
