"""WARC archives with a two-level capture index.

Captures are written as gzip members of WARC files, so each can be read by its byte range. Their
keys (the URL with its host reversed, then the page) are sorted into compressed blocks; a sparse
directory holds one line a block. A look-up searches the directory by bisection, then the lines
of one block, then reads the record's range.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.batches import bound_batches
from tracewell.operators.bounded import broadcast_if_small
from tracewell.sources.shared import new_path, write_shared

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: str | None) -> str:
    """The URL as a sort key: host parts from the right, then port, path and query.

    >>> reversed_host_key("https://Blog.Example.com:8080/a?b=1#c")
    'com,example,blog:8080)/a?b=1'
    """
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return "-)" + quote(url or "", safe="/?&=:%")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", key + (f"?{parts.query}" if parts.query else ""))


def capture_key(url: str | None, page: int | None) -> str:
    """Key and page in one string whose order is that of (key, page); a missing page comes first."""
    return f"{reversed_host_key(url)} {0 if page is None else page + (1 << 63) + 1:020d}"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP head, which says how long the payload was, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields in lower case, HTTP head, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _files(folder: str):
    """(file system, path) for a folder in any store that Arrow knows, shared by all executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)


def classify_captures(pages: DataFrame, min_payload: int = 100, max_broadcast_groups: int = 1_000_000) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, payload_bytes, refers_to (null for a response).

    Of pages with equal payloads of ``min_payload`` bytes or more the smallest page_id is the response;
    pages that share that id are all responses. Sizes and digests are grouped, never pages: only groups
    of two or more go back to the pages, by broadcast up to ``max_broadcast_groups`` of them.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    groups = (
        rows.filter(F.col("payload_bytes") >= min_payload).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    )
    groups = broadcast_if_small(write_shared(groups, "payload-groups"), max_broadcast_groups)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(groups, "digest", "left").withColumn("refers_to", refers).drop("first")


def write_archives(captures: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write one WARC file a task into ``folder`` and return (key, page_id, path, at, size) of each record.

    A file has a new name at each attempt, and only files whose rows came back are ever read: a task
    that runs again leaves an unused file and nothing wrong. Write the result to a table before
    using it twice.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _files(folder)
        store.create_dir(path, recursive=True)
        file = f"{path}/{uuid.uuid4().hex}.warc.gz"
        out = None
        try:
            at = 0
            for pdf in parts:
                rows = []
                for page, url, html, digest, refers in zip(
                    pdf["page_id"], pdf["url"], pdf["html"], pdf["digest"], pdf["refers_to"], strict=True
                ):
                    out = out or store.open_output_stream(file, compression=None)  # the members are compressed already
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                    data = packer.compress(data) + packer.flush()
                    out.write(data)
                    rows.append((capture_key(url, page), page, file, at, len(data)))
                    at += len(data)
                made = pd.DataFrame(rows, columns=["key", "page_id", "path", "at", "size"])
                made["page_id"] = made["page_id"].astype("Int64")
                yield made
        finally:
            if out is not None:
                out.close()

    # whole numbers with nulls become floats in pandas, so both ids travel as text
    rows = captures.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to")
    )
    return rows.mapInPandas(run, "key string, page_id long, path string, at long, size long")


def build_index(locations: DataFrame, lines: int = 2000, partitions: int | None = None) -> DataFrame:
    """Blocks (block, first_key, last_key, n, data) of ``lines`` sorted keys each, compressed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []

        def block() -> pd.DataFrame:
            keys = [x.split("\t", 1)[0] for x in (held[0], held[-1])]
            data = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"))
            return pd.DataFrame([(uuid.uuid4().hex, *keys, len(held), data)], columns=["block", "first_key", "last_key", "n", "data"])

        for pdf in parts:
            for row in zip(pdf["key"], pdf["path"], pdf["at"], pdf["size"], strict=True):
                held.append("\t".join(map(str, row)))
                if len(held) == lines:
                    yield block()
                    held = []
        if held:
            yield block()

    rows = locations.select("key", "path", "at", "size")
    ranged = rows.repartitionByRange(partitions, "key", "path", "at") if partitions else rows.repartitionByRange("key", "path", "at")
    return ranged.sortWithinPartitions("key", "path", "at").mapInPandas(
        run, "block string, first_key string, last_key string, n long, data binary"
    )


def _directory_pages(entries: DataFrame, fan: int, shown: int) -> DataFrame:
    """One level of the directory: pages (block, first_key, last_key, data) of ``fan`` entries of the level below, sorted.

    Keys of the directory are cut to ``shown`` characters: a range may then be a little wider than its
    block, never narrower, and an entry has a bounded size whatever the URLs.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str, str]] = []

        def page() -> pd.DataFrame:
            data = zlib.compress("\n".join("\t".join(x) for x in held).encode("utf-8", "surrogatepass"))
            return pd.DataFrame([(uuid.uuid4().hex, held[0][0], max(x[1] for x in held), data)], columns=["block", "first_key", "last_key", "data"])

        for pdf in parts:
            for first, last, block in zip(pdf["first_key"], pdf["last_key"], pdf["block"], strict=True):
                held.append((first[:shown], last[:shown], block))
                if len(held) == fan:
                    yield page()
                    held = []
        if held:
            yield page()

    rows = entries.select("first_key", "last_key", "block").repartitionByRange("first_key", "last_key", "block")
    return rows.sortWithinPartitions("first_key", "last_key", "block").mapInPandas(run, "block string, first_key string, last_key string, data binary")


def _ranges(entries: list[tuple[str, str, str]], shown: int):
    """A function from a key to the names of the entries (first, last, name; keys cut to ``shown``) whose range can hold it, by bisection."""
    entries = sorted(entries)
    firsts, own, names = ([x[i] for x in entries] for i in range(3))
    lasts = list(accumulate(own, max))  # ranges of cut keys may overlap

    def find(key: str) -> list[str]:
        cut = key[:shown]
        return [names[i] for i in range(bisect.bisect_left(lasts, cut), bisect.bisect_right(firsts, key)) if own[i] >= cut]

    return find


def look_up(index: DataFrame, wanted: DataFrame, max_directory: int = 20_000, fan: int = 2000, shown: int = 120) -> DataFrame:
    """(key, path, at, size) of the captures whose key is in ``wanted`` (a column ``key``; repeats count once).

    The sparse directory holds one entry a block. Where it has more than ``max_directory`` entries, they are packed into
    sorted, compressed pages of ``fan`` entries, and so on until the top level is that small: only this, of bounded entries, is handed to all
    tasks. A key is searched by bisection in the top level, then in its page of each level below, then among the sorted lines
    of its block. Nothing but the pages and blocks that a key can be in is opened. ``index`` must be a written table.
    """
    levels = [index.select("block", "first_key", "last_key", "data")]
    while levels[-1].limit(max_directory + 1).count() > max_directory:
        levels.append(write_shared(_directory_pages(levels[-1], fan, shown), "directory"))
    top = [tuple(r) for r in levels[-1].select(F.substring("first_key", 1, shown), F.substring("last_key", 1, shown), "block").collect()]

    @F.pandas_udf("array<string>")
    def blocks_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _ranges(top, shown)
        for ks in parts:
            yield pd.Series([find(k) for k in ks])

    sent = wanted.select("key").distinct().select("key", F.explode(blocks_of("key")).alias("block"))
    for depth in range(len(levels) - 1, -1, -1):
        both = levels[depth].select("block", F.lit("").alias("key"), "data").unionByName(sent.withColumn("data", F.lit(None).cast("binary")))
        # a page or block comes before the keys that are sought in it, which stream past it
        near = both.repartition("block").sortWithinPartitions("block", F.col("data").isNull(), "key")
        if depth:
            sent = near.mapInPandas(_search(shown), "key string, block string")
    return near.mapInPandas(_search(None), "key string, path string, at long, size long")


def _search(shown: int | None):
    """Search each key in the page (keys cut to ``shown``) or block (None) that precedes it; one page is held at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, lines, find = None, [], None
        for pdf in parts:
            rows = []
            for block, key, data in zip(pdf["block"], pdf["key"], pdf["data"], strict=True):
                if data is not None:
                    now, lines, find = block, None, None
                    packed = data
                    continue
                if block != now:
                    continue
                if lines is None:  # opened for the first key
                    lines = [x.split("\t") for x in zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")]
                    find = None if shown is None else _ranges(lines, shown)
                if find is not None:
                    rows += [(key, child) for child in find(key)]
                    continue
                i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while i < len(lines) and lines[i][0] == key:
                    rows.append((key, lines[i][1], int(lines[i][2]), int(lines[i][3])))
                    i += 1
            yield pd.DataFrame(rows, columns=["key", "path", "at", "size"] if shown is None else ["key", "block"])

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def read_records(locations: DataFrame, payloads: bool = True, stretch: int = 32 << 20) -> DataFrame:
    """The records at (path, at, size), read by byte range in the order of each file.

    Reads are dealt by stretches of ``stretch`` bytes of a file to the session's number of shuffle partitions:
    the locations are so small that their own size says nothing about the work.

    A response's digest is computed from its payload and must equal the one in its header; a revisit
    has the digest and the length of the payload that it refers to.
    """
    page = lambda urn: int(urn[10:-1]) if urn and len(urn) > 11 else None  # noqa: E731  <urn:page:...>

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, file = None, None
        for pdf in parts:
            rows = []
            for path, at, size in zip(pdf["path"], pdf["at"], pdf["size"], strict=True):
                if path != now:
                    if file is not None:
                        file.close()
                    store, _ = _files(root)
                    now, file = path, store.open_input_file(path)
                fields, http, payload = parse_record(zlib.decompress(file.read_at(int(size), int(at)), 31))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                n = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
                if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
                    raise ValueError(f"damaged record in {path} at {at}")
                rows.append((
                    page(fields["warc-record-id"]), n, digest, fields["warc-type"], page(fields.get("warc-refers-to")),
                    fields["warc-target-uri"], payload if payloads else None,
                ))
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])
            for c in ("page_id", "refers_to"):
                made[c] = made[c].astype("Int64")
            yield made
        if file is not None:
            file.close()

    from tracewell.sources.shared import shared_dir

    root = shared_dir(locations.sparkSession)
    tasks = int(locations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = locations.select("path", "at", "size").repartition(tasks, "path", F.floor(F.col("at") / stretch))
    near = near.sortWithinPartitions("path", "at")
    return near.mapInPandas(run, READ)


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` (page_id, url, html) as WARC files and return (locations, index), both written tables.

    Null html is an empty payload, a null URL an empty target; repeated rows are records of their own. Files
    go to ``folder``, by default a new one among the shared tables.
    """
    bound_batches(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "warc")
    locations = write_shared(write_archives(classify_captures(pages), folder), "captures")
    return locations, write_shared(build_index(locations), "capture-index")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    _, index = archive_pages(pages)

    @F.pandas_udf("string")
    def keys(urls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, None if pd.isna(i) else int(i)) for u, i in zip(urls, ids, strict=True)], dtype=object)

    wanted = pages.select(keys("url", F.col("page_id").cast("string")).alias("key"))
    return read_records(look_up(index, wanted), payloads=False).drop("payload", "target_uri")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
