"""WARC archives: writing, normalising monolithic gzip files, reading through an index.

* ``write_archives`` writes one record per page into monolithic archives: one gzip stream for
  the whole file, as some tools leave them, which allows no random access.
* ``normalise`` inflates each such stream once, from start to end, rewrites every record as
  a gzip member of its own, and writes a sidecar index: one JSON line per record with offset,
  length, identifier, type and payload digest.
* ``read_archives`` fetches each record by its index entry.

Archives are opened by URI through pyarrow's file systems, so the shared folder may be a
local mount, HDFS or an object store.  A task writes to names of its own and reports them
only when it has ended, so files that a lost or repeated task leaves behind are never read.
Memory is bounded by the largest record.

Payload digests are bare upper-case base32 SHA-1 of the full payload.  A payload of at least
``min_revisit`` bytes that several pages share is written once, as the response of the page
with the smallest identifier; the other pages' records are revisits that refer to it.
Sharing is decided by SHA-256.

Edge cases: a null payload counts as empty; a null identifier sorts after all others; a null
target becomes ``urn:unknown``; of rows equal in identifier, target and payload one is the response
and the others are revisits; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, shared_root, small_or_shuffled

#: Uncompressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 1 << 30
#: Bytes read at once.
CHUNK = 1 << 20
#: Equal rows that are dealt out together.
TWINS = 10_000
#: Date written into records; archives made from equal tables are equal.
DATE = "2024-01-01T00:00:00Z"
NO_ID = 2**63 - 1

GZIP = 31  # zlib's number for a gzip wrapper with the largest window


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:unknown'}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if is_revisit:
        head += [
            f"WARC-Refers-To: {_urn(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is left out."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if ":" in line)}


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of an inflated archive that comes in pieces."""
    held = bytearray()
    source = iter(chunks)
    need, ended = 1, False
    while True:
        while len(held) < need and not ended:
            piece = next(source, None)
            ended = piece is None
            held += piece or b""
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if ended:
                if held.strip():
                    raise ValueError("an archive ends inside a record")
                return
            need = len(held) + 1
            continue
        fields = headers(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if len(held) < size:
            if ended:
                raise ValueError("an archive ends inside a record")
            need = size
            continue
        yield fields, bytes(held[:size])
        del held[:size]
        need = 1


def inflate(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members, piece by piece."""
    unzip = zlib.decompressobj(GZIP)
    while raw := stream.read(CHUNK):
        while raw:
            # the output of a step is bounded, however well the input is compressed
            yield unzip.decompress(raw, CHUNK)
            raw = unzip.unconsumed_tail
            if unzip.eof:
                raw = unzip.unused_data
                unzip = zlib.decompressobj(GZIP)


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, zipper, size, uri = [], None, None, 0, ""
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, uri, size = system.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0
                    zipper = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                data = record(row["page_id"], row["url"], (row["payload"] or "").encode(), row["refers_to"], row["is_revisit"])
                size += len(data)
                out.write(zipper.compress(data))
                if size >= ARCHIVE_BYTES:
                    out.write(zipper.flush())
                    out.close()
                    out = None
                    done.append({"archive": uri})
        if out is not None:
            out.write(zipper.flush())
            out.close()
            done.append({"archive": uri})
        yield _batch(done, pa.schema([("archive", pa.string())]))

    return run


def _normaliser(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = _open(folder)
        target.create_dir(root, recursive=True)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                name, offset = uuid.uuid4().hex, 0
                system, path = _open(uri)
                with (
                    system.open_input_stream(path, compression=None) as source,
                    target.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out,
                    target.open_output_stream(f"{root}/{name}.idx", compression=None) as index,
                ):
                    for fields, data in records_of(inflate(source)):
                        zipper = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = zipper.compress(data) + zipper.flush()
                        out.write(member)
                        entry = {
                            "offset": offset,
                            "length": len(member),
                            "id": fields["warc-record-id"],
                            "type": fields["warc-type"],
                            "digest": fields.get("warc-payload-digest"),
                        }
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset += len(member)
                yield _batch(
                    [{"archive": f"{folder}/{name}.warc.gz", "index": f"{folder}/{name}.idx"}],
                    pa.schema([("archive", pa.string()), ("index", pa.string())]),
                )

    return run


RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


#: Bytes that the reader asks for at once.
RANGE = 4 << 20


def read_record(member: bytes, with_payload: bool) -> dict:
    """The fields of one gzip member; a response's digest is computed anew and compared."""
    data = zlib.decompress(member, GZIP)
    end = data.index(b"\r\n\r\n")
    fields = headers(data[:end])
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    cut = block.index(b"\r\n\r\n")
    http, payload = headers(block[:cut]), block[cut + 4 :]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and digest != payload_digest(payload):
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "payload": payload if with_payload and fields["warc-type"] == "response" else None,
    }


def _ranges(lines) -> Iterator[list[dict]]:
    """The entries of an index in runs whose members lie side by side, ``RANGE`` bytes long or a little more."""
    held: list[dict] = []
    size, rest = 0, b""
    while piece := lines.read(CHUNK):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            entry = json.loads(line)
            if held and (size >= RANGE or entry["offset"] != held[0]["offset"] + size):
                yield held
                held, size = [], 0
            held.append(entry)
            size += entry["length"]
    if held:
        yield held


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(archive)
                rows, size = [], 0
                with system.open_input_file(path) as data, system.open_input_stream(_open(index)[1], compression=None) as lines:
                    for entries in _ranges(lines):
                        first = entries[0]["offset"]
                        members = data.read_at(sum(e["length"] for e in entries), first)
                        for e in entries:
                            at = e["offset"] - first
                            rows.append(read_record(members[at : at + e["length"]], with_payload))
                            size += rows[-1]["payload_bytes"] if with_payload else 0
                            if len(rows) >= 10_000 or size >= 32 * CHUNK:
                                yield _batch(rows, RECORDS)
                                rows, size = [], 0
                yield _batch(rows, RECORDS)

    return run


def plan_revisits(pages: DataFrame, home: str, min_revisit: int = 0) -> DataFrame:
    """page_id, url, payload of ``pages`` with refers_to and is_revisit."""
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"order": F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), F.coalesce("url", F.lit("")).alias("url")), "key": F.unhex(F.sha2("payload", 256))})
    shared = (
        keyed.where(F.octet_length("payload") >= min_revisit)
        .groupBy("key", "order")
        .agg(F.count(F.lit(1)).alias("equal"))
        .groupBy("key")
        .agg(F.sum("equal").alias("n"), F.min("order").alias("first"), F.min_by("equal", "order").alias("twins"))
        .where("n > 1")
        .select("key", "first", "twins")
    )
    shared = materialise(shared, f"{home}/shared")
    twins = not shared.where("twins > 1").isEmpty()
    joined = keyed.join(small_or_shuffled(shared), "key", "left")
    if twins:
        joined = _one_of_twins(joined)
    is_revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("order") == F.col("first"), F.lit(False))
    first = F.when(F.col("first.id") != NO_ID, F.col("first.id"))
    return joined.select("page_id", "url", "payload", F.when(is_revisit, first).alias("refers_to"), is_revisit.alias("is_revisit"))


def _one_of_twins(joined: DataFrame) -> DataFrame:
    """``joined``, where of rows equal to a group's first all but one come after it.

    Equal rows are counted before they are shuffled, and dealt out again in runs.
    """
    is_twin = F.coalesce((F.col("twins") > 1) & (F.col("order") == F.col("first")), F.lit(False))
    twins = joined.where(is_twin).groupBy("key", "page_id", "url", "order", "first").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("twins"))
    runs = twins.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("twins") - 1, F.lit(TWINS).cast("bigint")))).repartition("key", "begin")
    place = F.explode(F.sequence("begin", F.least(F.col("begin") + TWINS, F.col("twins")) - 1))
    # a later one is put behind the first by its order alone
    dealt = runs.withColumn("place", place).withColumn("order", F.when(F.col("place") == 0, F.col("order")).otherwise(F.lit(None)))
    return joined.where(~is_twin).unionByName(dealt.select(*joined.columns))


def write_archives(records: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Monolithic archives of ``records``; returns their URIs, materialised."""
    return materialise(records.mapInArrow(_writer(folder, level), "archive string"), f"{folder}-manifest")


def normalise(archives: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Archives with a gzip member per record and their indexes; returns URIs, materialised."""
    spread = archives.repartition(max(1, archives.count()))
    return materialise(spread.mapInArrow(_normaliser(folder, level), "archive string, index string"), f"{folder}-manifest")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of normalised archives."""
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    spread = archives.repartition(max(1, archives.count()))
    return spread.mapInArrow(_reader(with_payload), schema)


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write, normalise and read back: one row per page."""
    spark = pages.sparkSession
    ship(spark)
    home = shared_root(spark)
    written = write_archives(plan_revisits(pages, home, min_revisit), f"{home}/monolithic")
    return read_archives(normalise(written, f"{home}/members"))

