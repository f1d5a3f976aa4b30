"""WARC archives: a writer, and a reader that salvages what a damaged archive still holds.

Archives are bounded files of records in gzip members of their own. The reader takes an archive's bytes, checks each record
(version line, Content-Length, payload digest) and, where a check fails, goes on at the next valid gzip member or WARC
version line; the bytes in between are logged as a quarantined gap.
"""

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, fresh_path

#: Fixed values of the format.
VERSION, MEMBER, END = b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

#: An archive is closed once it has so many compressed bytes; the reader holds one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Repeated digests (about 80 bytes each) that are broadcast at most.
BROADCAST_DIGESTS = 500_000

READ_SCHEMA = (
    "archive string, start long, stop long, kind string, reason string, record_type string, page_id long, url string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary"
)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, digest: str | None = None) -> bytes:
    """One record, uncompressed. With refers_to it is a revisit: it names the payload's digest and carries no block."""
    block = b"" if refers_to is not None else payload
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:lectern:page:{page_id}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", "sha1:" + (digest or payload_digest(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[5:5] = [("WARC-Refers-To", f"<urn:lectern:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset of uncompressed bytes, and where it ends; Damaged if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Damaged("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Damaged("no end of header")
    head = {}
    for line in data[at + 10 : stop].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise Damaged("no length")
    body, end = stop + 4, stop + 4 + int(size)
    if data[end : end + 4] != END:
        raise Damaged("wrong length")
    kind, digest, payload = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:"), data[body:end]
    if kind == "response" and digest != payload_digest(payload):
        raise Damaged("wrong digest")
    page = lambda key: int(m[1]) if (m := re.fullmatch(r"<urn:lectern:page:(-?\d+)>", head.get(key, ""))) else None
    return {
        "record_type": kind, "page_id": page("warc-record-id"), "url": head.get("warc-target-uri"), "payload_digest": digest,
        "payload_bytes": len(payload) if kind == "response" else None, "refers_to": page("warc-refers-to"), "payload": payload,
    }, end + 4


def salvage(data: bytes):
    """Yields ('record', start, stop, reason, fields) and ('gap', start, stop, reason, None), which tile the archive.

    Offsets are of the archive's bytes. Plain and gzipped records may alternate. A member that unpacks but whose record
    fails a check is a gap of its own. After a failure the search goes on one byte further, at the next gzip magic or
    version line, and each place found has to pass the checks itself; so a false magic inside a damaged payload costs a
    try, not a record. An empty archive yields nothing.
    """
    at, bad, reason = 0, None, ""
    view = memoryview(data)
    while at < len(data):
        try:
            if data[at : at + 3] == MEMBER:
                z = zlib.decompressobj(31)
                parts, pos = [], at
                while not z.eof and pos < len(data):  # in pieces, so that a member costs its own size only
                    piece = view[pos : pos + 65536]
                    parts.append(z.decompress(piece))
                    pos += len(piece)
                if not z.eof:
                    raise Damaged("cut gzip member")
                stop = pos - len(z.unused_data)
                whole = b"".join(parts)
                fields, used = parse_record(whole, 0)
                if used != len(whole):
                    raise Damaged("bytes after the record")
            else:
                fields, stop = parse_record(data, at)
        except (Damaged, zlib.error) as e:
            if bad is None:
                bad, reason = at, str(e) if isinstance(e, Damaged) else "bad gzip member"
            found = [x for x in (data.find(MEMBER, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
            at = min(found, default=len(data))
            continue
        if bad is not None:
            yield "gap", bad, at, reason, None
            bad = None
        yield "record", at, stop, "", fields
        at = stop
    if bad is not None:
        yield "gap", bad, len(data), reason, None


def _filesystem(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(records: DataFrame, to: str) -> DataFrame:
    """Writes (page_id, url, payload, digest, refers_to) as archives under to, a URI in a store that all executors reach.

    Returns (archive, n_records, n_bytes), one row an archive; it is computed once and cut from its lineage. An archive's
    name is new in every attempt, and only archives in the returned manifest count, so a task that is run again leaves
    at worst a file that nothing reads.
    """

    def run(frames):
        store, base = _filesystem(to)
        parts, size, n = [], 0, 0

        def close():
            nonlocal parts, size, n
            path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(path, compression=None) as f:
                f.write(b"".join(parts))
            row = {"archive": path.rsplit("/", 1)[1], "n_records": n, "n_bytes": size}
            parts, size, n = [], 0, 0
            return pd.DataFrame([row])

        store.create_dir(base, recursive=True)
        for f in frames:
            whole = lambda x: None if pd.isna(x) else int(x)
            for page, url, payload, digest, ref in zip(f.page_id, f.url, f.payload, f.digest, f.refers_to, strict=True):
                parts.append(gzip_member(record(whole(page), url, bytes(payload), whole(ref), digest)))
                size, n = size + len(parts[-1]), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
        if n:
            yield close()

    return cut(records.select("page_id", "url", "payload", "digest", "refers_to").mapInPandas(run, "archive string, n_records long, n_bytes long"))


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "*.warc*") -> DataFrame:
    """Every record and gap of the archives in a folder (READ_SCHEMA), through salvage(); kind is record or gap.

    An empty or missing folder gives no rows. Without with_payload, payload is null.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], READ_SCHEMA)
    columns = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def run(frames):
        for f in frames:
            for path, content in zip(f.path, f.content, strict=True):
                rows, size = [], 0
                for kind, start, stop, reason, fields in salvage(bytes(content)):
                    rows.append({"archive": path.rsplit("/", 1)[1], "start": start, "stop": stop, "kind": kind, "reason": reason} | (fields or {}))
                    size += len(rows[-1].get("payload") or b"")
                    if not with_payload:
                        rows[-1]["payload"] = None
                    if size > ARCHIVE_BYTES:
                        yield _frame(rows, columns)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, READ_SCHEMA)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("start", "stop", "page_id", "payload_bytes", "refers_to"):
        out[c] = out[c].astype("Int64")
    for c in ("archive", "kind", "reason", "record_type", "url", "payload_digest", "payload"):
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    return out


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of (page_id, url, html).

    Of the pages with one payload of least_bytes or more, that with the largest page_id is written in full and the others
    refer to it. Repeated rows of that page are all written in full, as are pages with a null id. A null html is an empty payload.
    Hashes of the payloads are counted before any shuffle. Only repeated ones go on, as broadcast while there are few, so that no payload
    is shuffled; beyond, payloads are joined by digest, and AQE splits a hot one.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    last = p.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha1", "last")
    last = cut(last)
    p = p.join(F.broadcast(last) if last.count() <= BROADCAST_DIGESTS else last, "sha1", "left")
    return p.select("page_id", "url", "payload", base32("sha1").alias("digest"), F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("refers_to"))


def base32(hex_col: str):
    """Upper-case base32 of a 160-bit hex digest, in four 40-bit groups of eight letters, as SQL functions."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = []
    for g in range(4):
        bits = F.lpad(F.conv(F.substring(hex_col, 10 * g + 1, 10), 16, 2), 40, "0")
        groups += [F.substring(F.lit(letters), F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*groups)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload_bytes are those of the response with its digest, as read back. Gaps, of which a fresh archive has none, give no rows.
    An empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = pages.sparkSession
    to = fresh_path(spark, "warc")
    write_archives(with_revisits(pages, least_bytes), to).count()
    got = read_archives(spark, to, with_payload=False).filter("kind = 'record'")
    got = cut(got.select("page_id", "payload_digest", "record_type", "refers_to", "payload_bytes"))  # archives are read once
    # only what is revisited needs its response's size, and only revisits need one
    revisits, responses = got.filter("record_type = 'revisit'"), got.filter("record_type = 'response'")
    asked = cut(revisits.select("payload_digest").distinct())
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_DIGESTS else asked
    sizes = cut(responses.join(asked, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_DIGESTS else sizes
    again = revisits.join(sizes, "payload_digest", "left").select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)
