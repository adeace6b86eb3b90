"""WARC archives: writing captures and assembling transactions.

Each page becomes three records: a request, a response (or a revisit, where another record has the
same payload) and a metadata record; request and metadata name the response as concurrent. The response
that revisits refer to has a record id made of its payload's digest, so that a revisit names it without
knowing its row. Captures are packed into files of bounded bytes and written by Spark's own text writer,
whose commit makes a lost or repeated task harmless; they are read back by declared lengths. Assembly
joins the records through their concurrent-to identifiers into one nested row a capture, and revisits
to responses through the record ids that they refer to.

Defined cases: a null html is an empty payload; a null url is an empty target; rows with a null
page_id are written with the id ``none`` and never referred to; of repeated page_ids each row is a
capture of its own; where the smallest page_id of a payload is repeated, one of its rows is the response
and the others revisit it; payloads under ``MIN_REVISIT`` bytes are always responses; of several request
or metadata records of one capture that with the smallest record id counts; a revisit that refers to no
record is an error; an empty table gives an empty archive. Columns other than page_id, url and html are
never read, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import join_spread, reach
from graphloom.session import materialize, new_path

MIN_REVISIT = 100
#: Bytes of an archive file at most; a capture that is larger has a file of its own.
FILE_BYTES = 32 << 20
_END = "\r\n\r\n"
_VERSION = "WARC/1.1"
_WHEN = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _head(kind: str, record, concurrent, url, body, *more) -> F.Column:
    """A record's header lines; ``more`` are (name, Column or None) pairs, nulls are left out."""
    fields = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record), ("WARC-Concurrent-To", concurrent),
              ("WARC-Date", F.lit(_WHEN)), ("WARC-Target-URI", url), *more, ("Content-Length", F.octet_length(body).cast("string"))]
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in fields if value is not None]
    return F.concat_ws("\r\n", F.lit(_VERSION), *lines)


def plan_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, size, first, role): what each page's record is to be.

    ``first`` is the smallest page_id of a payload of ``least`` bytes or more that several rows have;
    ``role`` is ``response``, ``target`` (the response that revisits refer to) or ``revisit``. Only small
    rows are aggregated, and counts come before any grouping, so a common payload costs one row there.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    whole = whole.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html").cast("long")})
    counted = whole.where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    lowest = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rows")))
    repeated = counted.groupBy("digest").agg(lowest.alias("low"), F.sum("rows").alias("n")).where("n > 1 AND low IS NOT NULL")
    firsts, _ = materialize(repeated.select("digest", F.col("low.page_id").alias("first"), F.col("low.rows").alias("ties"), "n"), "warc-firsts")
    if firsts.isEmpty():
        return whole.withColumns({"first": F.lit(None).cast("long"), "role": F.lit("response")})
    met = join_spread(whole, firsts, "digest", "n")
    at_first = F.col("page_id").eqNullSafe(F.col("first"))
    role = F.when(F.col("first").isNull(), "response").when(at_first, "target").otherwise("revisit")
    planned = met.withColumn("role", role)
    columns = ["page_id", "url", "html", "digest", "size", "first", "role"]
    if firsts.where("ties > 1").isEmpty():
        return planned.select(*columns)
    # rows that share the smallest page_id of a payload are told apart by counting them, not by their order
    tied = met.where(at_first & (F.col("ties") > 1))
    target = tied.groupBy("digest", "page_id", "first", "size").agg(F.min("url").alias("url"), F.min("html").alias("html"))
    alike = tied.groupBy("digest", "page_id", "first", "size", "url").agg(F.count("*").alias("rows"))
    left = alike.join(target.select("digest", F.col("url").alias("taken")), "digest").withColumn("rows", F.col("rows") - (F.col("url") == F.col("taken")).cast("int"))
    others = left.where("rows > 0").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).withColumn("html", F.lit(""))
    return (
        planned.where("NOT (role = 'target' AND ties > 1)").select(*columns)
        .unionAll(target.withColumn("role", F.lit("target")).select(*columns))
        .unionAll(others.withColumn("role", F.lit("revisit")).select(*columns))
    )


def _pack(most: int):
    """Captures to files: rows of one file's bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for capture in batch.column(0):
                body = capture.as_py()
                if held and size + len(body) > most:
                    yield pa.RecordBatch.from_arrays([pa.array([_SEPARATOR.join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
                held.append(body)
                size += len(body) + len(_SEPARATOR)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_SEPARATOR.join(held)], pa.binary())], names=["value"])

    return run


_SEPARATOR = _END.encode()


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT, most: int = FILE_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``pages``."""
    reach(pages.sparkSession)
    planned = plan_revisits(pages, least).withColumn("no", F.monotonically_increasing_id())
    page, no = F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("no").cast("string")
    name = lambda kind: F.concat(F.lit(f"<urn:page:{kind}:"), page, F.lit(":"), no, F.lit(">"))
    by_digest = F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">"))
    main = F.when(F.col("role") == "target", by_digest).otherwise(name("main"))
    revisit = F.col("role") == "revisit"
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), payload)
    ask = F.concat(F.lit("GET "), F.when(F.col("url") == "", "/").otherwise(F.regexp_replace("url", "[\r\n]", "")), F.lit(" HTTP/1.1\r\n\r\n"))
    target = F.when(F.col("url") != "", F.regexp_replace("url", "[\r\n]", ""))
    note = F.concat(F.lit("page-id: "), page, F.lit("\r\npayload-bytes: "), F.col("size").cast("string"), F.lit("\r\n"))
    request = F.concat(_head("request", name("request"), main, target, ask, ("Content-Type", F.lit("application/http; msgtype=request"))), F.lit(_END), ask)
    response = F.concat(
        _head(
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), main, None, target, answer, ("Content-Type", F.lit("application/http; msgtype=response")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, by_digest)),
        ), F.lit(_END), answer,
    )
    metadata = F.concat(_head("metadata", name("metadata"), main, target, note, ("Content-Type", F.lit("application/warc-fields"))), F.lit(_END), note)
    captures = planned.select(F.concat(request, F.lit(_END), response, F.lit(_END), metadata).cast("binary").alias("value"))
    files = captures.mapInArrow(_pack(most), "value binary").select(F.col("value").cast("string").alias("value"))
    # the writer ends every row, which is a file here, by the two line ends that end a record
    files.write.option("lineSep", _END).option("maxRecordsPerFile", 1).text(path)


class WarcError(ValueError):
    """An archive that doesn't hold what its headers declare."""


def parse(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The records of one uncompressed archive: headers by lower-case name, and the body."""
    view, at = memoryview(content), 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0 or not content.startswith(b"WARC/", at):
            raise WarcError(f"no record at byte {at}")
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = stop + 4
        end = start + int(headers["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise WarcError(f"the record at byte {at} doesn't end where it declares")
        yield headers, view[start:end]
        at = end + 4


_RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, page_id long"
_NAMES = [part.split()[0] for part in _RECORD.split(", ")]


def _http_payload(body: memoryview) -> memoryview:
    """The entity of an HTTP message: what follows its first empty line."""
    head = bytes(body[:65536])
    at = head.find(b"\r\n\r\n")
    return body[at + 4 :] if at >= 0 else body[len(body) :]


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                columns: list[list] = [[] for _ in range(9)]
                for headers, body in parse(content.as_py()):
                    kind = headers.get("warc-type", "")
                    declared, size, payload, page = None, None, None, None
                    if kind in ("response", "revisit"):
                        entity = _http_payload(body)
                        declared = headers.get("warc-payload-digest", "").partition(":")[2] or None
                        if kind == "response":
                            found = hashlib.sha256(entity).hexdigest()
                            if declared not in (None, found):
                                raise WarcError(f"the payload of {headers.get('warc-record-id')} has another digest than declared")
                            declared, size = found, len(entity)
                            payload = bytes(entity) if with_payload else None
                    elif kind == "metadata":
                        notes = dict(line.split(": ", 1) for line in bytes(body).decode("utf-8").split("\r\n") if ": " in line)
                        size = int(notes["payload-bytes"]) if "payload-bytes" in notes else None
                        page = int(notes["page-id"]) if notes.get("page-id", "none") != "none" else None
                    refers = headers.get("warc-refers-to")
                    row = (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), refers, declared, size, payload, page)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the archives in ``path``; digests of responses are checked on the way."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records(with_payload), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: page_id and the structs ``request``, ``response``, ``metadata``.

    Request and metadata records are joined to the response or revisit that they name as concurrent.
    A capture without one of the three has a null there; what names no record at all is left out.
    """
    key = F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    part = F.struct("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "page_id")
    one = lambda *kinds: F.min(F.when(F.col("record_type").isin(*kinds), part))
    return (
        records.withColumn("capture_id", key).where("capture_id IS NOT NULL").groupBy("capture_id")
        .agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))
        .select("capture_id", F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata")
    )


def resolve(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled captures.

    Bytes of a response are those measured, and have to be those that its metadata notes; of a revisit
    those noted. ``refers_to`` is the page_id of the record that a revisit refers to by its id.
    """
    noted, measured = F.col("metadata.payload_bytes"), F.col("response.payload_bytes")
    wrong = F.raise_error(F.concat(F.lit("the metadata of "), "capture_id", F.lit(" notes another length than its payload has")))
    size = F.when(F.col("response.record_type") == "revisit", noted).when(noted.eqNullSafe(measured) | noted.isNull(), measured).otherwise(wrong.cast("long"))
    flat, _ = materialize(
        captures.select("capture_id", "page_id", size.alias("payload_bytes"), "response.payload_digest", "response.record_type", F.col("response.refers_to").alias("record")), "warc-captures"
    )
    asked = flat.where("record IS NOT NULL").groupBy("record").agg(F.count("*").alias("n"))
    answers = flat.where("record_type = 'response'").select(F.col("capture_id").alias("record"), F.col("page_id").alias("referred"))
    known, _ = materialize(asked.join(answers, "record"), "warc-referred")
    missing = F.raise_error(F.concat(F.lit("no record is called "), "record")).cast("long")
    refers = F.when(F.col("record").isNull(), F.lit(None).cast("long")).when(F.col("referred").isNull(), missing).otherwise(F.col("referred"))
    return join_spread(flat, known, "record", "n").select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages``, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return resolve(assemble(read_records(pages.sparkSession, path)))


SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS place FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN n >= {MIN_REVISIT} AND place > 1 AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= {MIN_REVISIT} AND place > 1 THEN first END AS refers_to
FROM f
"""
