"""WARC archives: pages written as records, and records assembled into captures.

Method: every capture is a request, a response (or revisit) and a metadata record.  The
reader parses archives record by record, then joins the three kinds through their
concurrent-to identifiers and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.common import BATCH_BYTES, cut, digest, pick

# Fixed values of the format.
VERSION = "WARC/1.1"
LINE = "\r\n"
BLANK = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK" + LINE + "Content-Type: text/html; charset=utf-8" + BLANK

# Bytes of payload that one archive file should hold.
FILE_BYTES = 32 * 1024 * 1024

RECORD = ("record_id string, type string, concurrent_to string, refers_to string, uri string, "
          "declared_digest string, payload binary, payload_bytes long, payload_digest string, fields map<string,string>")
FIELDS = [field.split()[0] for field in RECORD.split(", ")]
ANSWER = ("record_id", "type", "uri", "refers_to", "declared_digest", "payload_digest", "payload_bytes", "payload")


# Parts of a capture and their columns.
PARTS = {"request": ("record_id", "uri"), "response": ANSWER, "metadata": ("record_id", "uri", "fields")}
CAPTURE_FIELDS = ["capture_id", *PARTS, "complete"]
CAPTURE = (
    "capture_id string, request struct<record_id:string,uri:string>, "
    "response struct<record_id:string,type:string,uri:string,refers_to:string,declared_digest:string,"
    "payload_digest:string,payload_bytes:long,payload:binary>, "
    "metadata struct<record_id:string,uri:string,fields:map<string,string>>, complete boolean"
)


def urn(*parts: Column) -> Column:
    """A name in UUID form that follows from the parts."""
    h = F.lower(F.hex(digest(*parts)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def record(kind: str | Column, name: Column, uri: Column, block: Column, *more: Column) -> Column:
    """Header lines, an empty line and the block; the writer adds the two closing line ends."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat_ws(
        LINE, F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), name, F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]+", " ")),
        *more, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(BLANK), block)


def base32_sha1(hex_digest: Column) -> Column:
    """The base 32 form of a hexadecimal SHA-1, five bits a letter."""
    bits = F.lpad(F.conv(F.substring(hex_digest, 1, 10), 16, 2), 40, "0")
    for start in (11, 21, 31):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(hex_digest, start, 10), 16, 2), 40, "0"))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    fives = F.regexp_extract_all(bits, F.lit("([01]{5})"), 1)
    return F.array_join(F.transform(
        fives, lambda b: F.substring(letters, F.conv(b, 2, 10).cast("int") + 1, F.lit(1))
    ), "")


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 1000,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write gzip archives to ``folder``, three records a page.

    Of pages with equal payloads of ``least`` bytes or more, that with the largest id is
    written as response and the others as revisits that refer to it; smaller ones are
    all responses.  A null payload is an empty one; a null id counts as the smallest;
    among equal ids one is chosen by a hash.  Rows equal in id, url and payload are counted
    and each is written: one of them as the page, the others as its repeats (revisits, or
    responses if small).  An empty table writes archives without records.  Payloads of
    any length are written whole.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(
        "page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("content"),
    ).withColumn("page", urn(F.col("page_id"), F.col("url"), F.col("content")))
    known = cut(rows.groupBy("page", "page_id", "content", F.octet_length("html").alias("bytes")).agg(
        F.count("*").alias("times")
    ))
    first = known.filter(F.col("bytes") >= least).groupBy("content").agg(
        F.max(F.struct("page_id", "page")).alias("first"), F.sum("times").alias("n")
    ).filter("n > 1").select("content", F.col("first.page").alias("first"))
    # Narrow rows only meet on the content, of which one may be very common.
    roles = known.join(first, "content", "left").select("page", "times", "first")
    total = known.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = (
        rows.repartition(files, "page").dropDuplicates(["page"])
        .join(roles.repartition(files, "page"), "page")
    )
    # A page's repeats have names of their own; the first row keeps the page's.
    dealt = dealt.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).withColumn(
        "name", F.when(F.col("turn") == 1, F.col("page")).otherwise(urn(F.col("page"), F.col("turn")))
    ).withColumn("first", F.when(F.col("first") != F.col("name"), F.col("first")))
    page = F.col("name")
    answer, ask, about = urn(F.lit("response"), page), urn(F.lit("request"), page), urn(F.lit("metadata"), page)
    together = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), answer, F.lit(">"))
    http, revisit = F.lit("Content-Type: application/http"), F.col("first").isNotNull()
    uri = F.col("url")
    response = record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), answer, uri,
        F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("html"))), http,
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.sha1(F.col("html").cast("binary")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), urn(F.lit("response"), F.col("first")), F.lit(">"))),
    )
    request = record("request", ask, uri, F.concat(
        F.lit("GET "), F.regexp_replace(F.coalesce(uri, F.lit("/")), r"\s+", "%20"), F.lit(" HTTP/1.1" + BLANK)
    ), http, together)
    fields = F.concat(
        F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(LINE),
        F.lit("has_url: "), uri.isNotNull().cast("string"), F.lit(LINE),
    )
    metadata = record("metadata", about, uri, fields, F.lit("Content-Type: application/warc-fields"), together)
    (
        dealt.select(F.explode(F.array(request, response, metadata)).alias("value"))
        .write.option("lineSep", BLANK).option("compression", "gzip").text(folder)
    )


def bare(name: str | None) -> str | None:
    """The identifier inside ``<urn:uuid:...>``."""
    return name.strip().strip("<>").removeprefix("urn:uuid:") if name else None


def records(stream: bytes) -> Iterator[tuple]:
    """The records of one archive, found by their content lengths."""
    at = 0
    while True:
        end = stream.find(b"\r\n\r\n", at)
        if end < 0 or not stream.startswith(b"WARC/", at):
            if stream[at:].strip():
                raise ValueError(f"no record at byte {at}")
            return
        lines = stream[at:end].decode("utf-8").split(LINE)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(head["content-length"])
        block = stream[end + 4:end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at byte {at} ends early")
        at = end + 4 + size + 4
        kind, payload, fields = head["warc-type"], None, None
        if kind in ("response", "revisit"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif head.get("content-type") == "application/warc-fields":
            pairs = (line.partition(":") for line in block.decode("utf-8").split(LINE) if line)
            fields = {k.strip(): v.strip() for k, _, v in pairs}
        told = head.get("warc-payload-digest", "").removeprefix("sha1:")
        yield (
            bare(head["warc-record-id"]), kind, bare(head.get("warc-concurrent-to")),
            bare(head.get("warc-refers-to")), head.get("warc-target-uri"),
            base64.b32decode(told).hex() if told else None, payload,
            None if payload is None else len(payload),
            hashlib.sha1(payload).hexdigest() if kind == "response" else None, fields,
        )


def unpacked(content: bytes) -> bytes:
    """The bytes of one or many gzip members, or the content itself if it is not packed."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def assembled(stream: bytes) -> Iterator[tuple[str, dict, bool]]:
    """The captures of one archive: identifier, records by part, and whether all parts are there.

    A capture goes out as soon as it is whole; what is left at the end goes out in pieces.
    """
    open_: dict[str, dict] = {}
    for row in records(stream):
        kind = "response" if row[1] == "revisit" else row[1]
        if kind not in PARTS:
            continue
        name = row[0] if kind == "response" else row[2] or row[0]
        own = open_.setdefault(name, {})
        if kind in own:
            # A second record of a kind: the pieces are put in order over all archives.
            yield name, {kind: row}, False
            continue
        own[kind] = row
        if len(own) == len(PARTS):
            yield name, open_.pop(name), True
    for name, own in open_.items():
        yield name, own, False


def nested(parts: dict, kind: str) -> dict | None:
    """One part of a capture as a struct of its type in ``CAPTURE``."""
    if kind not in parts:
        return None
    row = dict(zip(FIELDS, parts[kind], strict=True))
    return {c: row[c] for c in (ANSWER if kind == "response" else PARTS[kind])}


def capture_rows(whole: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Whole captures with their payloads, or only identifiers and whether they are whole."""
    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows, held = [], 0
                for name, parts, complete in assembled(unpacked(content)):
                    if whole:
                        rows.append((name, *[nested(parts, kind) for kind in PARTS], complete))
                        held += len(parts["response"][6]) if "response" in parts else 0
                    else:
                        rows.append((name, complete))
                    if len(rows) == 512 or held > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=CAPTURE_FIELDS if whole else CAPTURE_FIELDS[::4])
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=CAPTURE_FIELDS if whole else CAPTURE_FIELDS[::4])
    return rows_of


def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = FIELDS
    for frame in frames:
        for content in frame["content"]:
            rows: list[tuple] = []
            for row in records(unpacked(content)):
                rows.append(row)
                if len(rows) == 512:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below ``folder``; a broken archive fails the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInPandas(parsed, RECORD)


def captures(archive: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, request, response, metadata``.

    ``response`` is the response or revisit record.  A capture whose partners are not in
    the archives has nulls in their place, so no record is lost; records that repeat
    an identifier are taken once; of several requests to one response the smallest
    identifier counts.  An archive read without its ``payload`` column gives captures
    without it, and no payload is moved.
    """
    def partners(kind: str) -> DataFrame:
        whole = F.struct("record_id", "uri", "fields") if kind == "metadata" else F.struct("record_id", "uri")
        return archive.filter(F.col("type") == kind).groupBy(
            F.coalesce("concurrent_to", "record_id").alias("capture_id")
        ).agg(F.min_by(whole, "record_id").alias(kind))

    answers = archive.filter(F.col("type").isin("response", "revisit")).dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("capture_id"),
        F.struct(*[c for c in ANSWER if c in archive.columns]).alias("response"),
    )
    return answers.join(partners("request"), "capture_id", "full").join(partners("metadata"), "capture_id", "full")


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``captures`` of the archives below ``folder``, whole payloads included.

    Archives keep the records of a capture near each other, so most captures are assembled
    where their archive is read and no payload is moved.  Identifiers that no single archive
    has whole, or that several have, are found from identifiers alone; only their records
    are joined across archives, under the rules of ``captures``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    names = files.mapInPandas(capture_rows(False), "capture_id string, complete boolean")
    scattered = cut(names.groupBy("capture_id").agg(
        F.count("*").alias("n"), F.min("complete").alias("whole")
    ).filter("n > 1 or not whole").select("capture_id"))
    local = files.mapInPandas(capture_rows(True), CAPTURE)
    if not scattered.head(1):
        return local.drop("complete")
    apart = local.join(scattered, "capture_id", "left_semi")

    def pieces(kind: str) -> DataFrame:
        """The records of one kind as ``captures`` takes them."""
        own = {c: F.col(f"{kind}.{c}") for c in PARTS[kind]}
        own |= {} if kind == "response" else {"type": F.lit(kind), "concurrent_to": F.col("capture_id")}
        kinds = dict(field.split(" ", 1) for field in RECORD.split(", "))
        return apart.filter(F.col(kind).isNotNull()).select(
            *[own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in FIELDS]
        )

    joined = captures(pieces("request").unionByName(pieces("response")).unionByName(pieces("metadata")))
    return local.join(scattered, "capture_id", "left_anti").drop("complete").unionByName(joined)


def resolved(found: DataFrame) -> DataFrame:
    """Captures as pages: a revisit has the size of the response that it refers to.

    Columns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.
    """
    flat = cut(found.select(
        "capture_id", F.col("metadata.fields")["page_id"].try_cast("long").alias("page_id"),
        F.when(F.col("metadata.fields")["has_url"] == "true", F.col("response.uri")).alias("url"),
        F.col("response.type").alias("record_type"),
        F.col("response.payload_bytes").alias("bytes"),
        F.coalesce("response.payload_digest", "response.declared_digest").alias("payload_digest"),
        F.col("response.refers_to").alias("target"),
    ))
    targets = flat.filter("record_type = 'response'").select(
        F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("target_bytes")
    )
    return flat.join(targets, "target", "left").select(
        "page_id", "url", F.coalesce("target_bytes", "bytes").alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to",
    )
