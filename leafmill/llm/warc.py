"""WARC archives, index first.

Writing: a record a page, each a gzip member of its own, so that any record can be read from its offset alone. Of records with equal payloads of 1000 bytes or more the one with the largest page_id is the response and the others are revisits of it. While a task writes its archive it notes offset, length, URL and digest of each record; the notes of committed tasks are the index, a Parquet table beside the archives.

Reading: records are selected on the index; those of one archive are sorted by offset, and ranges that lie close together are read in one request.

Hot digests: equal payloads meet as (digest, page_id) pairs only, in a group-by with map-side combining; the answer goes back over a salted join.

Null html is an empty payload; null URLs are written as `urn:page:<id>`. Rows with one page_id are records of their own; a null page_id is written and read back as null and never is what others refer to. Equal rows are records of their own, too; of the rows with the largest page_id of a payload all are responses, so there are no ties. Empty payloads have a digest like any other, long ones a record of any length. An empty table gives no records. Columns other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, filesystem, partitions, shared_dir, write_once

MIN_REVISIT_BYTES = 1000
SALTS = 16
#: Two records of an archive this close are read together.
GAP = 64 << 10
#: Bytes of one request at most, a single longer record aside.
SPAN = 8 << 20
DATE = "2024-01-01T00:00:00Z"

INDEX = "archive string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string, refers_to bigint"


def _target(page_id: int | None, url: str | None) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A") if url else f"urn:page:{page_id}"


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, sha1_hex: str) -> bytes:
    sha1 = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    kind = "revisit" if refers_to is not None else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if kind == "revisit" else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {_target(page_id, url)}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        head += [f"WARC-Refers-To-Target-URI: {_target(refers_to, refers_url)}", f"WARC-Refers-To-Date: {DATE}"] if refers_url else []
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, HTTP payload and announced payload length of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record stands here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(": ", 1)[1] for x in http.decode().split("\r\n")[1:] if x.lower().startswith("content-length: ")]
    return fields, payload, int(sizes[0])


def revisits(pages: DataFrame) -> DataFrame:
    """digest, refers_to, refers_url: of each payload of MIN_REVISIT_BYTES or more that two records or more have, its largest page_id. pages: page_id, url, digest, bytes."""
    large = pages.where((F.col("bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull())
    return large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to")).where("n > 1").select("digest", "refers_to")


def write(pages: DataFrame, level: int = 6) -> tuple[str, DataFrame]:
    """Writes archives of all pages to a new shared folder. Returns its URI and the index."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    heads = cut(revisits(rows.select("page_id", "url", "digest", F.octet_length("payload").alias("bytes")))).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    marked = rows.withColumn("salt", salt).join(heads, ["digest", "salt"], "left")
    own = F.when(~F.col("refers_to").eqNullSafe(F.col("page_id")) & (F.octet_length("payload") >= MIN_REVISIT_BYTES), F.col("refers_to"))
    marked = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", own.cast("string").alias("refers_to"))  # as text: a null would make all ids of its batch floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        notes: list[tuple] = []

        def fill(out) -> None:
            at = 0
            for x in batches:
                for page, url, body, digest, to in zip(x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"], strict=True):
                    page, to = None if page is None else int(page), None if to is None else int(to)
                    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = deflate.compress(_record(page, url, bytes(body), to, None, digest)) + deflate.flush()
                    out.write(data)
                    notes.append((at, len(data), _target(page, url), digest, page, "response" if to is None else "revisit", to))
                    at += len(data)

        name = write_once(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz", fill)
        for i in range(0, len(notes), 20_000):
            made = pd.DataFrame(notes[i : i + 20_000], columns=["offset", "length", "url", "digest", "page_id", "record_type", "refers_to"], dtype=object)
            yield made.astype({"offset": "int64", "length": "int64", "page_id": "Int64", "refers_to": "Int64"}).assign(archive=name)[[c.split()[0] for c in INDEX.split(", ")]]

    marked.mapInPandas(run, INDEX).write.parquet(f"{folder}/index.parquet")
    return folder, spark.read.parquet(f"{folder}/index.parquet")


def spans(places: list[tuple[int, int]], gap: int = GAP, most: int = SPAN) -> list[tuple[int, int, list[int]]]:
    """Byte ranges (start, end, which places) that cover places (offset, length), sorted by offset, with gaps of up to `gap` read over and up to `most` bytes a range."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, n) in sorted(enumerate(places), key=lambda x: x[1]):
        if out and at - out[-1][1] <= gap and max(out[-1][1], at + n) - out[-1][0] <= most:
            start, end, own = out[-1]
            out[-1] = (start, max(end, at + n), [*own, i])
        else:
            out.append((at, at + n, [i]))
    return out


def read(folder: str, selected: DataFrame) -> DataFrame:
    """The selected records of the index, from their archives: page_id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to. Raises ValueError where a payload does not have its digest."""
    n = partitions(selected.sparkSession)
    dealt = selected.select("archive", "offset", "length").withColumn("zone", F.floor(F.col("offset") / SPAN)).repartition(n, "archive", "zone").sortWithinPartitions("archive", "offset")

    def number(x: str) -> int | None:
        x = x.removeprefix("<urn:page:").rstrip(">")
        return int(x) if x else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = filesystem(folder)
        for x in batches:
            for name, own in x.groupby("archive", sort=False):
                places = list(zip(own["offset"].tolist(), own["length"].tolist(), strict=True))
                with system.open_input_file(f"{path}/{name}") as data:
                    for start, end, which in spans(places):
                        data.seek(start)
                        chunk = data.read(end - start)
                        rows = []
                        for i in which:
                            at, n = places[i]
                            fields, payload, size = parse(zlib.decompress(chunk[at - start : at - start + n], 31))
                            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                            revisit = fields["WARC-Type"] == "revisit"
                            if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{name} at {at}: the payload does not have its digest")
                            rows.append((number(fields["WARC-Record-ID"]), None if revisit else payload, size, digest, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if revisit else None))
                        made = pd.DataFrame(rows, columns=["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
                        yield made.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    return dealt.mapInPandas(run, "page_id bigint, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top, count(*) AS n FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
