"""WARC archives with a two-level capture index.

Archives and index files lie in the shared folder and are opened through its URI. Each record is a
gzip member of its own, so that one can be read by its place. The index holds one line per record,
sorted by reversed-host URL key and page; lines are packed into compressed blocks, and a sparse
directory keeps the first line's key and the place of each block. A look-up searches the directory
by bisection, reads one block, searches its lines by bisection, and reads one record.

Tasks write under names of their own and return what they wrote; files of lost attempts are never
referred to."""

import base64
import bisect
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportlake.llm.work import new_path, stored

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
DIRECTORY_BYTES = 32 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
NO_PAGE = -(1 << 63)
LINES = "key string, page bigint, file string, at bigint, size bigint, type string"
DIRECTORY = "key string, page bigint, file string, at bigint, size bigint, n bigint"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query: com,example,www)/a?b."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(key, r"[\t\r\n]", "_")


def record_id(page: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>"


def render(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, target_url: str | None) -> bytes:
    """One record. A revisit has the response's headers, with the full length, but no payload."""
    clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, url or '')}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, target_url or '')}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload, and the payload length that the HTTP headers state."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields, payload, length


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(folder: str, archive_bytes: int):
    def run(stream):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in stream:
            lines = []
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                raw = render(row["page"], row["url"], payload, digest, row["first"], row["first_url"])
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = pack.compress(raw) + pack.flush()
                if out is None or at and at + len(raw) > archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                kind = "revisit" if row["first"] is not None else "response"
                lines.append((row["key"], row["page"], name, at, len(raw), kind))
                at += len(raw)
            columns = list(zip(*lines)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "page", "file", "at", "size", "type"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page to WARC files in `folder`; returns the stored capture lines.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least
    `least_bytes`, the one of the smallest id is the response and the others revisit it; rows that
    share that id are all responses, and rows without id are responses where no equal page has one."""
    source = pages.select(
        F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce("html", F.lit(""))
    keyed = source.withColumns({
        "sha1": F.sha1(payload.cast("binary")), "bytes": F.octet_length(payload).cast("bigint"), "key": url_key(F.col("url"))})
    groups = keyed.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(
        F.min_by(F.struct("page", "url"), "page").alias("kept"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1").select("sha1", "bytes", F.col("kept.page").alias("first"), F.col("kept.url").alias("first_url"))
    rows = keyed.join(groups, ["sha1", "bytes"], "left")
    first = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("key", "page", "url", "html", "sha1", first.alias("first"), "first_url")
    return stored(rows.mapInArrow(_write(folder, archive_bytes), LINES), "captures")


def _pack(folder: str, block_lines: int):
    def run(stream):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name, at, held, out = f"index-{uuid.uuid4().hex}.cdx.z", 0, [], None

        def block(lines):
            text = "\n".join("\t".join(map(str, x)) for x in lines)
            return zlib.compress(text.encode(), LEVEL)

        rows = []
        for batch in stream:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "page", "file", "at", "size", "type")))
            while len(held) >= block_lines:
                rows.append((held[:block_lines], None))
                held = held[block_lines:]
                out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                raw = block(rows[-1][0])
                out.write(raw)
                rows[-1] = (*rows[-1][0][0][:2], name, at, len(raw), block_lines)
                at += len(raw)
        if held:
            out = out or files.open_output_stream(f"{base}/{name}", compression=None)
            raw = block(held)
            out.write(raw)
            rows.append((*held[0][:2], name, at, len(raw), len(held)))
        if out is not None:
            out.close()
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "page", "file", "at", "size", "n"])

    return run


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the capture lines by key and page, pack them into blocks; returns the stored directory.
    A page without id sorts first among its key."""
    lines = captures.select("key", F.coalesce("page", F.lit(NO_PAGE)).alias("page"), "file", "at", "size", "type")
    ordered = lines.repartitionByRange("key", "page").sortWithinPartitions("key", "page", "file", "at")
    return stored(ordered.mapInArrow(_pack(folder, block_lines), DIRECTORY), "directory")


def _read_range(files, path: str, at: int, size: int) -> bytes:
    with files.open_input_file(path) as file:
        return file.read_at(size, at)


def _look_up(folder: str, directory):
    def run(stream):
        files, base = fs.FileSystem.from_uri(folder)
        firsts, blocks = directory.value
        last, lines, keys = -1, [], []
        for batch in stream:
            found = []
            for key, page in sorted(set(zip(batch.column("key").to_pylist(), batch.column("page").to_pylist()))):
                k = bisect.bisect_right(firsts, (key, page)) - 1
                if k < 0:
                    continue
                if k != last:
                    file, at, size = blocks[k]
                    text = zlib.decompress(_read_range(files, f"{base}/{file}", at, size)).decode()
                    lines = [x.split("\t") for x in text.split("\n")]
                    keys, last = [(x[0], int(x[1])) for x in lines], k
                i = bisect.bisect_left(keys, (key, page))
                if i < len(keys) and keys[i] == (key, page):
                    _, _, file, at, size, _ = lines[i]
                    fields, payload, length = parse(zlib.decompress(_read_range(files, f"{base}/{file}", int(at), int(size)), 31))
                    found.append((key, page, fields["WARC-Type"], fields["WARC-Payload-Digest"][5:], length, payload))
            columns = list(zip(*found)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "page", "type", "digest", "length", "payload"])

    return run


def look_up(wanted: DataFrame, directory: DataFrame, folder: str, directory_bytes: int = DIRECTORY_BYTES) -> DataFrame:
    """The captures (key, page, type, digest, length, payload) of the wanted (key, page) rows, by two
    bisections and two range reads each. A directory above `directory_bytes` is searched in pieces
    of its key order, one pass over the wanted rows per piece; unknown rows give none."""
    spark = wanted.sparkSession
    schema = "key string, page bigint, type string, digest string, length bigint, payload binary"
    size = directory.agg(F.sum(F.octet_length("key") + 100).cast("bigint")).first()[0] or 0
    pieces = max(1, -(-size // directory_bytes))
    if pieces > 1:
        directory = stored(directory.repartitionByRange(pieces, "key", "page").withColumn("piece", F.spark_partition_id()), "pieces")
    out, edges = None, []
    for piece in range(pieces):
        rows = directory.where(F.col("piece") == piece) if pieces > 1 else directory
        rows = sorted((r["key"], r["page"], r["file"], r["at"], r["size"]) for r in rows.collect())
        edges.append(([r[:2] for r in rows], [r[2:] for r in rows]))
    edges = [e for e in edges if e[0]] or [([], [])]
    for k, (firsts, blocks) in enumerate(edges):
        sent = spark.sparkContext.broadcast((firsts, blocks))
        own = wanted.select("key", "page")
        place = F.struct("key", "page")
        if k:
            own = own.where(place >= F.struct(F.lit(firsts[0][0]).alias("key"), F.lit(firsts[0][1]).cast("bigint").alias("page")))
        if k + 1 < len(edges):
            after = edges[k + 1][0][0]
            own = own.where(place < F.struct(F.lit(after[0]).alias("key"), F.lit(after[1]).cast("bigint").alias("page")))
        found = own.mapInArrow(_look_up(folder, sent), schema)
        out = found if out is None else out.unionAll(found)
    return out


def _scan(folder: str):
    def run(stream):
        files, base = fs.FileSystem.from_uri(folder)
        for batch in stream:
            for name in batch.column("file").to_pylist():
                rows = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as file:
                    for record in members(file):
                        fields, payload, length = parse(record)
                        kind = fields["WARC-Type"]
                        digest = fields["WARC-Payload-Digest"][5:]
                        if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {name}")
                        page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
                        rows.append((page and int(page), kind, digest, length, refers and int(refers)))
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], ["page", "type", "digest", "length", "refers_to"])

    return run


def members(file, step: int = 1 << 20):
    """Records of an archive, one gzip member after another, read in steps."""
    data, unpack, parts = b"", None, []
    while True:
        if not data:
            data = file.read(step)
            if not data:
                return
        unpack = unpack or zlib.decompressobj(31)
        parts.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = None, []


def read_archives(captures: DataFrame, folder: str) -> DataFrame:
    """All records (page, type, digest, length, refers_to) of the archives that the captures name,
    read from end to end; a response is checked against its digest and length."""
    names = captures.select("file").distinct()
    return names.mapInArrow(_scan(folder), "page bigint, type string, digest string, length bigint, refers_to bigint")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               folder: str | None = None, **options) -> DataFrame:
    """Write the pages, index them, read them back. One row per page: id, payload_bytes,
    payload_digest (base32 SHA-1), record_type, refers_to. Revisits are resolved through the index:
    the length is that of the
    response found there under the same digest. Other columns are ignored; an empty
    table gives no rows."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    captures = write_archives(pages, folder, id_col, url_col, html_col, **options)
    directory = build_index(captures, folder)
    records = stored(read_archives(captures, folder), "records")
    targets = records.where("type = 'revisit'").select(F.col("refers_to").alias("page")).distinct()
    places = captures.where("type = 'response' and page is not null").join(targets, "page", "left_semi")
    wanted = places.select("key", "page").distinct().repartition("key").sortWithinPartitions("key", "page")
    found = look_up(wanted, directory, folder).groupBy(F.col("page").alias("refers_to"), "digest").agg(F.max("length").alias("full"))
    revisits = records.where("type = 'revisit'").join(found, ["refers_to", "digest"], "left").select(
        "page", F.coalesce("full", "length").alias("length"), "digest", "type", "refers_to")
    responses = records.where("type = 'response'").select("page", "length", "digest", "type", "refers_to")
    return responses.unionAll(revisits).select(
        F.col("page").alias(id_col), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")
