"""WARC archives: written from pages, read back, and put together into captures.

Writing: each page gives three records, a response (or a revisit, if another page
with the same payload and a greater id has the response), the request for it and
metadata with its ``page-id``; request and metadata name the response's record as
concurrent. A row of text is a record and the line separator is the record's end,
so Spark's text writer makes the files and commits them.

Reading: Spark's text reader cuts the files before each version number of the
format, in splits where the files are not compressed. A payload may hold one too.
A piece that has just its declared length is a record; in files with any other
piece the pieces are told apart in order, by declared lengths alone, and those of
one record are joined again. Payloads stay bytes.

Captures: a request or metadata record belongs to the response, revisit or
resource that it names as concurrent, otherwise to the smallest of those that
concurrent-to identifiers connect it with, however many steps away; records
without any form captures of their own. All of it is DataFrame code.

Cases: a null html is an empty payload, a null or empty url is left out; control
characters and blanks of a url are percent-encoded. Pages that share a page_id are
archived each; of equal payloads with the same greatest id one has the response.
Null page ids come back as null and count as the smallest. Of several requests
(or metadata records) of a capture the row holds the one with the smallest record
id and their number. Truncated records are flagged. No pages give an archive
without records. Other columns are not read.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.arrow import map_batches
from rankloom.llm.components import components
from rankloom.llm.sizes import broadcast_if_small
from rankloom.session import materialise

# Fixed values of the format.
END, MAGIC = "\r\n\r\n", "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PRIMARY = ("response", "revisit", "resource")


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1, in upper case: four times 40 bits, eight digits each."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _record_id(archive: str, kind: Column, row: Column) -> Column:
    name = F.md5(F.concat_ws("/", F.lit(archive), kind, row.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))


def _encoded(url: Column) -> Column:
    """Without characters that would end or fold a header line."""
    odd = F.regexp_extract_all(url, F.lit(r"[\x00-\x20\x7F<>]"), F.lit(0))
    replaced = F.aggregate(
        F.array_distinct(odd), url, lambda done, c: F.replace(done, c, F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0")))
    )
    return F.nullif(F.when(F.size(odd) == 0, url).otherwise(replaced), F.lit(""))


def _record(block: Column, **fields: Column | str) -> Column:
    """Header lines and block; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name.replace('_', '-')}: "), F.lit(value) if isinstance(value, str) else value) for name, value in fields.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit(f"{MAGIC}1"), *lines, length), F.lit(END), block)


def _bracketed(id: Column) -> Column:
    return F.concat(F.lit("<"), id, F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip", date: str | None = None) -> None:
    """Archive ``pages`` (page_id, url, html) below ``path``, a file per task.

    Pages with equal payloads of at least ``min_bytes`` have one response, at the
    greatest page_id; the others are revisits of it.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = materialise(
        pages.select(
            "page_id", _encoded(F.col("url")).alias("uri"), payload.alias("payload"), payload_digest(payload).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "pages",
    )
    last = F.max(F.struct("page_id", "row")).alias("last")
    equal = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(last, F.count(F.lit(1)).alias("n"))
    equal = materialise(equal.where("n > 1").select("digest", F.col("last.row").alias("original")), "equal-payloads")
    joined = rows.join(broadcast_if_small(equal), "digest", "left")
    revisit = F.coalesce(F.col("original") != F.col("row"), F.lit(False)) & (F.octet_length("payload") >= min_bytes)

    archive = uuid.uuid4().hex
    now = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    row, uri = F.col("row"), F.col("uri")
    own, original = (_bracketed(_record_id(archive, F.lit("response"), r)) for r in (row, F.col("original")))
    host = F.regexp_extract("uri", r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1)
    place = F.coalesce(F.nullif(F.regexp_extract("uri", r"^[^:/?#]+://[^/?#]*([^#]+)", 1), F.lit("")), F.lit("/"))
    asked = F.concat(F.lit("GET "), place, F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit(END),
    )
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    facts = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))

    def common(kind: str, id: Column) -> dict:
        return {"WARC_Type": kind, "WARC_Record_ID": id, "WARC_Date": now, "WARC_Target_URI": uri}

    def companion(kind: str) -> dict:
        return common(kind, _bracketed(_record_id(archive, F.lit(kind), row))) | {"WARC_Concurrent_To": own}

    http = "application/http; msgtype="
    response = _record(
        F.concat(answer, F.col("payload")), **common("response", own), WARC_Payload_Digest=digest, Content_Type=f"{http}response"
    )
    again = _record(
        answer, **common("revisit", own), WARC_Profile=PROFILE, WARC_Refers_To=original, WARC_Payload_Digest=digest,
        Content_Type=f"{http}response",
    )
    request = _record(asked, **companion("request"), Content_Type=f"{http}request")
    metadata = _record(facts, **companion("metadata"), Content_Type="application/warc-fields")
    records = joined.select(F.explode(F.array(F.when(revisit, again).otherwise(response), request, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, part and place (their order in it), text: what stands between two beginnings of a record,
    head_bytes, declared (null if the header doesn't say). What stands before the first is empty.

    The first letter of the separator is not in it again. Where a separator may
    begin inside another, the reader can miss it at the border of its buffer.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("text"),
    )
    return _measured(raw)


def _measured(pieces: DataFrame) -> DataFrame:
    head = F.substring_index("text", END, 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d+)", 1)
    return pieces.withColumn("head_bytes", F.octet_length(head)).withColumn("declared", length.try_cast("long"))


def _is_whole() -> Column:
    """The block has its declared length; the end of the record may be missing behind it."""
    rest = F.octet_length("text") - F.col("head_bytes") - len(END) - F.col("declared")
    return F.coalesce(rest.isin(0, len(END)), F.lit(False)) | (F.octet_length("text") == 0)


def _rejoined(pieces: DataFrame) -> DataFrame:
    """The records of files in which some piece is not a whole record."""
    gap = len(MAGIC)

    def number(batches):
        file, record, missing = None, 0, 0
        for batch in batches:
            numbers = []
            for name, n, need in zip(*(batch.column(c).to_pylist() for c in ("file", "n_bytes", "needed"))):
                if name != file:
                    file, record, missing = name, 0, 0
                missing -= n + gap
                if missing <= -gap - n:
                    record, missing = record + 1, need - n
                numbers.append(record)
            yield [batch.column("file"), batch.column("part"), batch.column("place"), numbers]

    needed = F.coalesce(F.col("head_bytes") + len(END) + F.col("declared"), F.lit(0))
    sizes = pieces.select("file", "part", "place", F.octet_length("text").cast("long").alias("n_bytes"), needed.alias("needed"))
    in_order = sizes.repartition("file").sortWithinPartitions("file", "part", "place")
    numbers = materialise(map_batches(in_order, number, "file string, part long, place long, record long"), "record-numbers")
    joined = pieces.join(numbers, ["file", "part", "place"])
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "place", "text"))), lambda x: x["text"])
    return _measured(joined.groupBy("file", "record").agg(F.array_join(texts, MAGIC).alias("text")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, gzipped or not: file, record_id, kind,
    target_uri, date, concurrent_to (an array), refers_to, digest, content_type, block, truncated."""
    pieces = _pieces(spark, path)
    odd = materialise(pieces.where(~_is_whole()).select("file").distinct(), "odd-archives")
    if not odd.isEmpty():
        odd = broadcast_if_small(odd)
        some = materialise(pieces.join(odd, "file", "left_semi"), "pieces")
        pieces = pieces.join(odd, "file", "left_anti").drop("part", "place").unionByName(_rejoined(some).drop("record"))
    lines = F.regexp_replace(F.substring_index("text", END, 1), "\r\n[ \t]+", " ")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*<?(.*?)>?[ \t]*$", 1), F.lit(""))

    rest = F.octet_length("text") - F.col("head_bytes") - len(END)
    block = F.substring(F.col("text").cast("binary"), F.col("head_bytes") + len(END) + 1, F.coalesce("declared", rest).cast("int"))
    return pieces.where("text <> ''").withColumn("head", lines).select(
        "file",
        field("WARC-Record-ID").alias("record_id"),
        F.lower(field("WARC-Type")).alias("kind"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Date").alias("date"),
        F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*<?(.*?)>?[ \t]*$"), F.lit(1)).alias("concurrent_to"),
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("digest"),
        field("Content-Type").alias("content_type"),
        block.alias("block"),
        (rest < F.coalesce("declared", F.lit(0))).alias("truncated"),
    )


def _companions(records: DataFrame) -> DataFrame:
    """capture, record_id, kind, target_uri, date, text of all requests and metadata."""
    is_primary = F.col("kind").isin(*PRIMARY)
    slim = materialise(
        records.select(
            "record_id", "kind", "target_uri", "date", "concurrent_to",
            F.when(F.col("kind").isin("request", "metadata"), F.col("block").cast("string")).alias("text"),
        ),
        "records",
    )
    links = slim.where("record_id IS NOT NULL").select("record_id", is_primary.alias("primary"), F.explode("concurrent_to").alias("other"))
    primaries = slim.where(is_primary).select(F.col("record_id").alias("other")).distinct()
    named = links.where("NOT primary").join(primaries, "other", "left_semi").groupBy("record_id").agg(F.min("other").alias("capture"))
    companions = slim.where(F.col("kind").isin("request", "metadata")).drop("concurrent_to")
    companions = materialise(companions.join(named, "record_id", "left"), "companions")
    if companions.where("capture IS NULL").isEmpty():
        return companions
    # Some name no primary record: look further along the identifiers.
    members = materialise(components(links.select(F.col("record_id").alias("a"), F.col("other").alias("b"))), "captures")
    held = members.join(primaries.withColumnRenamed("other", "node"), "node").groupBy("component").agg(F.min("node").alias("nearest"))
    found = members.join(held, "component", "left").select(
        F.col("node").alias("record_id"), F.coalesce("nearest", "component").alias("connected")
    )
    lost = companions.where("capture IS NULL").drop("capture").join(found, "record_id", "left")
    lost = lost.withColumn("capture", F.coalesce("connected", "record_id")).drop("connected")
    return companions.where("capture IS NOT NULL").unionByName(lost)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (the record id of its response, else the smallest id it is connected by),
    target_uri, date, response (record_id, kind, refers_to, digest, http, payload, payload_bytes, intact),
    request and metadata (record_id, text), n_requests, n_metadata.

    ``payload`` is what follows the HTTP header; ``intact`` whether it has the
    recorded digest, null for revisits and digests other than SHA-1.
    """
    companions = _companions(records)

    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    body = F.struct("record_id", "text")
    per_capture = companions.groupBy("capture").agg(
        F.min(of("request", body)).alias("request"),
        F.min(of("metadata", body)).alias("metadata"),
        F.count(of("request", F.lit(1))).alias("n_requests"),
        F.count(of("metadata", F.lit(1))).alias("n_metadata"),
        F.min("target_uri").alias("other_uri"),
        F.min("date").alias("other_date"),
    )
    is_http = F.coalesce(F.startswith("content_type", F.lit("application/http")), F.lit(False))
    head = F.when(is_http, F.substring_index(F.col("block").cast("string"), END, 1))
    payload = F.when(is_http, F.substring("block", F.octet_length(head) + len(END) + 1, F.lit(2**31 - 1))).otherwise(F.col("block"))
    declared = F.regexp_extract("digest", r"(?i)^sha1:([A-Z2-7]{32})$", 1)
    intact = F.when((F.col("kind") != "revisit") & (declared != ""), payload_digest(payload) == F.upper(declared))
    response = F.struct(
        "record_id", "kind", "refers_to", F.regexp_replace("digest", "(?i)^sha1:", "").alias("digest"), head.alias("http"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), intact.alias("intact"),
    )
    primary = records.where(F.col("kind").isin(*PRIMARY)).select(
        F.col("record_id").alias("capture"), "target_uri", "date", response.alias("response")
    )
    joined = primary.join(per_capture, "capture", "full_outer")
    count = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return joined.select(
        "capture", F.coalesce("target_uri", "other_uri").alias("target_uri"), F.coalesce("date", "other_date").alias("date"),
        "response", "request", "metadata", count("n_requests"), count("n_metadata"),
    )


def page_payloads(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the page of a revisit's response),
    intact for every page archived below ``path``; a revisit has the payload of its response."""
    found = captures(read_records(spark, path)).where("response.record_id IS NOT NULL")
    page = F.regexp_extract("metadata.text", r"(?im)^page-id:[ \t]*(-?\d+)", 1).try_cast("long")
    fields = [F.col(f"response.{c}").alias(c) for c in ("record_id", "kind", "refers_to", "digest", "payload_bytes", "intact")]
    rows = materialise(found.select(page.alias("page_id"), *fields), "archived-pages")
    originals = rows.where("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("full"), F.col("intact").alias("held")
    )
    none = F.lit(None).cast("long")
    own = rows.where("kind <> 'revisit'").select("page_id", "payload_bytes", "digest", "kind", none.alias("original"), "intact")
    others = rows.where("kind = 'revisit'").drop("payload_bytes", "intact").join(originals, "refers_to", "left")
    others = others.select("page_id", F.col("full").alias("payload_bytes"), "digest", "kind", "original", F.col("held").alias("intact"))
    return own.unionByName(others).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.col("original").alias("refers_to"), "intact",
    )
