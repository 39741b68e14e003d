"""WARC archives: written as segmented records, read back and put together again.

A page becomes an HTTP response in chunked transfer framing, inside a WARC record. A block
longer than a segment is cut, and all but its first part go to continuation records. A
payload that an earlier page has is stored once; the other pages refer to that one. Reading
groups continuation records by the record they continue, orders them by segment number,
compares the length with the stated total and takes the chunk framing off.

Archives are text files to Spark, with the end of a record as line separator, so that its
writers and readers deal with stores, commits and compression, and a task holds one record
at a time instead of an archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import quoted
from veilframe.plans.scale import small, written

CRLF = "\r\n"
GAP = CRLF + CRLF
NEXT = GAP + "WARC/1."
"""Between two records; the writer cuts a chunk wherever a payload holds it."""

CHUNK = 2_048
"""Most payload bytes of a chunk."""

SEGMENT = 8_192
"""Most bytes of a record's block."""

LEAST = 100
"""Payload bytes from which equal payloads are stored once."""

DATE = "1970-01-01T00:00:00Z"

RECORD = (
    "record_id string, kind string, number int, total long, page_id string, refers_to string, "
    "uri string, digest string, part binary, payload binary, problem string"
)
HEAD = ["kind", "page_id", "refers_to", "uri", "digest"]


def text_of(data: Column) -> Column:
    """Bytes as a string that holds just them, for functions that take strings only."""
    return data.cast("binary").cast("string")


def uuid_of(digest: Column) -> Column:
    cuts = [F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def cut(data: Column, size: int) -> Column:
    """Bytes in pieces of at most `size`; none if there are none."""
    starts = F.filter(F.sequence(F.lit(0), F.ceil(F.octet_length(data) / size) - 1), lambda i: i * size < F.octet_length(data))
    return F.transform(starts, lambda i: F.substring(data, i.cast("int") * size + 1, F.lit(size)))


def chunked(payload: Column, size: int) -> Column:
    """The payload in chunked transfer framing, as bytes; `payload` is a string."""
    framed = lambda piece: F.concat(F.lower(F.hex(F.octet_length(piece).cast("long"))), F.lit(CRLF), text_of(piece), F.lit(CRLF))
    # cut inside each separator, so that none is left for a reader to split at
    apart = F.split(payload, r"(?<=\r\n\r\nWA)(?=RC/1\.)")
    whole = F.when(F.contains(payload, F.lit(NEXT)), apart).otherwise(F.array(payload))
    chunks = F.flatten(F.transform(whole, lambda text: F.transform(cut(text.cast("binary"), size), framed)))
    return F.concat(F.array_join(chunks, ""), F.lit("0" + GAP)).cast("binary")


def header(*fields: tuple[str, Column | None]) -> Column:
    """The lines of the given fields; fields that are null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit(CRLF))


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", payload: str = "html",
    chunk: int = CHUNK, segment: int = SEGMENT, least: int = LEAST, compression: str = "gzip",
) -> None:
    """Write a record for each page to archives in the folder `path`, which must not exist yet.

    A null payload is empty. Of equal payloads of at least `least` bytes the one with the
    smallest page_id is a response and the others are revisits of it; a null page_id is
    larger than all. Line ends in a uri become spaces. Record ids derive from page_id and
    payload: rows equal in both are one capture, however often they are written. An empty
    table makes an archive without records.
    """
    rows = pages.select(
        quoted(page_id).cast("long").alias("page_id"),
        F.translate(quoted(uri).cast("string"), "\r\n", "  ").alias("uri"),
        F.coalesce(quoted(payload).cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    size = F.octet_length("payload")
    shared = rows.where(size >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.where("n > 1 and first is not null").select("digest", "first"))
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    marked = rows.join(small(shared), "digest", "left").withColumn("refers_to", F.when(again, F.col("first")))
    start = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Transfer-Encoding: chunked" + GAP
    body = F.when(again, F.lit("")).otherwise(text_of(chunked(F.col("payload"), chunk)))
    block = F.concat(F.lit(start), body).cast("binary")
    capture = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest").cast("binary"))
    # segments are cut in one expression, so that no block is copied with each of them
    cuts = marked.select("page_id", "uri", "digest", "refers_to", capture.alias("capture"), F.octet_length(block).alias("total"), cut(block, segment).alias("cuts"))
    segments = cuts.select("*", F.size("cuts").alias("n"), F.posexplode("cuts").alias("i", "part")).drop("cuts")
    first, many = F.col("i") == 0, F.col("n") > 1
    name = lambda column: F.when(first, F.col(column).cast("string"))
    own = F.when(first, F.col("capture")).otherwise(F.md5(F.concat_ws(" ", "capture", F.col("i").cast("string")).cast("binary")))
    kind = F.when(~first, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    head = header(
        ("WARC-Type", kind),
        ("WARC-Record-ID", uuid_of(own)),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), name("digest"))),
        ("WARC-Profile", F.when(kind == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Segment-Origin-ID", F.when(~first, uuid_of(F.col("capture")))),
        ("WARC-Segment-Number", F.when(many, (F.col("i") + 1).cast("string"))),
        ("WARC-Segment-Total-Length", F.when(many & (F.col("i") == F.col("n") - 1), F.col("total").cast("string"))),
        ("Page-ID", name("page_id")),
        ("Refers-To-Page-ID", name("refers_to")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("part").cast("string")),
    )
    records = segments.select(F.concat(head, text_of(F.col("part"))).alias("value"))
    writer = records.write.option("lineSep", GAP).option("compression", compression)
    writer.option("zlib.compress.level", "BEST_SPEED").text(path)


def unchunked(body: bytes) -> tuple[bytes | None, str | None]:
    """The payload of a chunked body, or what is wrong with it."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or len(body) < end + 4 + size or body[end + 2 + size : end + 4 + size] != b"\r\n" and size:
            return None, "bad chunk"
        if not size:
            return b"".join(out), None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of an HTTP response: what follows its head, without chunk framing."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "no HTTP head"
    if b"transfer-encoding: chunked" in head.lower():
        return unchunked(body)
    return body, None


def fields_of(head: bytes) -> dict[str, str]:
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower().decode(): value.strip().decode("utf-8", "replace") for name, _, value in lines}


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields, block and problem of the records in what stands between two separators.

    That is one record as a rule, and several where a separator was not seen.
    """
    while data.strip():
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = fields_of(head)
        length = fields.get("content-length", "")
        if not length.isdigit():
            yield fields, b"", "no length"
            return
        block, data = rest[: int(length)], rest[int(length) :].lstrip(b"\r\n")
        yield fields, block, None if len(block) == int(length) else "cut off"


def record_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in RECORD.split(", ")]
    for batch in batches:
        rows = []
        for data in batch["value"]:
            for f, block, problem in records_in(data):
                number = f.get("warc-segment-number", "")
                total = f.get("warc-segment-total-length", "")
                kind = f.get("warc-type", "")
                part, payload = (block, None) if number else (None, None)
                if not number and kind == "response" and not problem:
                    payload, problem = payload_of(block)
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                rows.append(
                    (
                        f.get("warc-segment-origin-id") or f.get("warc-record-id"), kind, int(number) if number.isdigit() else None,
                        int(total) if total.isdigit() else None, f.get("page-id"), f.get("refers-to-page-id"),
                        f.get("warc-target-uri"), digest, part, payload, problem,
                    )
                )
        yield pd.DataFrame(rows, columns=names).astype({"number": "Int32", "total": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, those of a segmented one under its first id.

    Archives may be compressed, by record or as a whole. A record that ends before its
    stated length has a `problem`; so has one whose payload holds the separator.
    """
    values = spark.read.option("lineSep", NEXT).text(path).select(F.col("value").cast("binary").alias("value"))
    return values.where(F.octet_length("value") > 0).mapInPandas(record_rows, RECORD)


def joined_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = batch[["kind", "block", "problem"]].itertuples(index=False)
        pairs = [payload_of(r.block) if r.kind == "response" and r.problem is None else (None, r.problem) for r in rows]
        out = batch.drop(columns="block")
        out["payload"], out["problem"] = [p for p, _ in pairs], [x for _, x in pairs]
        yield out


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """record_id, kind, page_id, refers_to, uri, digest, payload, problem of all captures.

    Revisits have no payload of their own. `problem` says why a payload is missing or not as
    stated (a segment that is missing or cut off, a total that differs, a bad chunk, another
    digest); nothing is left out. A record that is stored several times counts once.
    """
    records = read_records(spark, path)
    whole = records.where("number is null").select("record_id", *HEAD, "payload", "problem")
    whole = whole.dropDuplicates(["record_id"])
    segment = F.struct("number", "part")
    first = F.max(F.when(F.col("number") == 1, F.struct(*HEAD)))
    groups = records.where("number is not null").groupBy("record_id").agg(
        first.alias("head"), F.max("total").alias("total"), F.max("problem").alias("problem"),
        F.sort_array(F.collect_set(segment)).alias("segments"),
    )
    block = F.array_join(F.transform("segments", lambda s: text_of(s["part"])), "").cast("binary")
    gapless = F.col("segments")[F.size("segments") - 1]["number"] == F.size("segments")
    found = groups.select(
        "record_id", *[F.col(f"head.{c}").alias(c) for c in HEAD], block.alias("block"), "total", "problem",
        F.when(~gapless | F.col("head").isNull() | F.col("total").isNull(), "missing segment").alias("gap"),
    )
    wrong = F.when(F.octet_length("block") != F.col("total"), "other length")
    found = found.select("record_id", *HEAD, "block", F.coalesce("problem", "gap", wrong).alias("problem"))
    schema = "record_id string, kind string, page_id string, refers_to string, uri string, digest string, problem string, payload binary"
    joined = found.mapInPandas(joined_rows, schema)
    both = whole.unionByName(joined)
    differs = F.sha2("payload", 256) != F.col("digest")
    return both.select(
        "record_id", "kind", F.col("page_id").cast("long").alias("page_id"), F.col("refers_to").cast("long").alias("refers_to"),
        "uri", "digest", "payload", F.coalesce("problem", F.when(differs, "other digest")).alias("problem"),
    )


def captures(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem for each capture.

    A revisit has the figures of the response that it refers to; if there is none they are
    null and `problem` says so.
    """
    figures = read_payloads(spark, path).select(
        "page_id", "refers_to", F.col("kind").alias("record_type"), "digest", "problem",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
    )
    figures = written(figures)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    stored = figures.where("record_type = 'response'")
    of = stored.select(
        F.col("page_id").alias("refers_to"), "digest",
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"),
    ).distinct()
    again = figures.where("record_type = 'revisit'").join(written(of), ["refers_to", "digest"], "left")
    lost = F.when(F.col("_digest").isNull(), "no such response")
    again = again.select(
        "page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type",
        "refers_to", F.coalesce("problem", lost).alias("problem"),
    )
    return stored.select(*columns).unionByName(again)
