"""WARC archives with a two-level capture index.

Writing: each task writes the records of its pages, every one a gzip member of
its own, to an archive in the shared folder.  A task's files carry its attempt
number and only those of committed attempts are listed, so a repeated task
leaves nothing behind that is read.

Index: capture lines (reversed-host URL key, page, archive, offset, length) are
range-partitioned and sorted by key.  Each partition is one index file of
compressed blocks followed by a sparse directory with the first key of each
block.  The first key of each file (one row per partition) is the top.

Reading: keys to look up are sorted, a binary search over the top finds the
file, one over its directory the block, and one within the block the captures,
whose records are then range-read.  No task ever holds an index as a whole.

Of records with equal payloads the one with the largest page_id is a response
and the others are revisits that refer to it.

Defined cases: a null html is the empty payload; a null url has the key '';
a null page_id sorts first and is referred to only when its whole group has
none; rows repeating both page_id and payload are alike: of the largest page_id
all are responses; each row is a record; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm.common import attach, read_table, shared_path, slices, written

READS = 5000              # range reads in a task
BLOCK_LINES = 1000        # captures in a compressed index block
ARCHIVE_BYTES = 1 << 30   # an archive is closed at this size
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture date
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long"
RECORD = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to long, refers_url string, payload binary")


# ------------------------------------------------------------------ records
def url_key(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; control and blank characters are escaped."""
    try:
        at = urlsplit(url or "")
        host, port = at.hostname or "", f":{at.port}" if at.port else ""
    except ValueError:
        return quote(url or "", safe="/:?&=#%+,;@!$'()*[]~")
    rest = at.path + (f"?{at.query}" if at.query else "") + (f"#{at.fragment}" if at.fragment else "")
    return quote(",".join(reversed(host.split("."))) + port + ")" + rest, safe="/:?&=#%+,;@!$'()*[]~")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def told(field: str, url: str | None) -> list[tuple[str, str]]:
    """Header fields of a URL, as a valid URI; one that unquoting would change also has an exact form."""
    plain = "-" if url is None else quote(url, safe="/:?&=#%+,;@!$'()*[]~")
    exact = [] if url is None or (plain != "-" and unquote(plain) == url) else [(f"X-Exact-{field}", quote(url))]
    return [(field, plain), *exact]


def heard(field: str, fields: dict) -> str | None:
    """The URL that ``told`` put into ``fields``."""
    if exact := fields.get(f"X-Exact-{field}"):
        return unquote(exact)
    return None if fields.get(field, "-") == "-" else unquote(fields[field])


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None, str | None] | None) -> bytes:
    """One WARC record as a gzip member; ``refers`` makes it a revisit without payload."""
    urn = lambda n: f"<urn:page:{'' if n is None else n}>"
    block = HTTP if refers else HTTP + payload
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE),
            *told("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
            ("Content-Type", "application/http; msgtype=response")]
    if refers:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers[0])), *told("WARC-Refers-To-Target-URI", refers[1])]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> dict:
    """The fields of RECORD; a response's payload is digested anew, a revisit has none."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    number = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None
    revisit = fields["WARC-Type"] == "revisit"
    return {"page_id": number(fields["WARC-Record-ID"]), "url": heard("WARC-Target-URI", fields), "record_type": fields["WARC-Type"],
            "payload_bytes": None if revisit else len(payload),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload),
            "refers_to": number(fields.get("WARC-Refers-To")), "refers_url": heard("WARC-Refers-To-Target-URI", fields),
            "payload": None if revisit else payload}


def _store(base: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(base)


# ------------------------------------------------------------------ writing
def write_archives(pages: DataFrame, base: str) -> DataFrame:
    """Write all records below ``base``; returns the capture lines."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    same = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_last"),
                                    F.max_by("url", F.coalesce("page_id", F.lit(-(1 << 63)))).alias("_last_url"))
    same = written(same.where("_n > 1"), "repeats")
    rows = attach(rows, same, "_sha", "_n", rows.count())
    rows = rows.withColumn("_revisit", F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")))
    spark = pages.sparkSession
    _store(base)[0].create_dir(_store(base)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = _store(base)
        out, name, at, parts = None, "", 0, 0
        for batch in slices(batches, "html"):
            lines = []
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, parts = f"archive-{task.partitionId():06d}-{task.taskAttemptId()}-{parts}.warc.gz", 0, parts + 1
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                member = record(row["page_id"], row["url"], row["html"].encode(),
                                (row["_last"], row["_last_url"]) if row["_revisit"] else None)
                out.write(member)
                lines.append((url_key(row["url"]), row["page_id"], name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*lines, strict=True), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)],
                names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(rows.select("page_id", "url", "html", "_revisit", "_last", "_last_url").mapInArrow(write, CAPTURE), "captures")


def _order(key: str, page_id: int | None) -> tuple:
    return key, page_id is not None, page_id or 0


def write_index(captures: DataFrame, base: str) -> list[tuple]:
    """Write the index files; returns the top: (first key, file, directory offset, directory length), sorted."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = _store(base)
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, at, directory, block = None, 0, [], []

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(block).encode())
            out.write(data)
            directory.append("\t".join([*block[0].split("\t")[:2], str(at), str(len(data))]))
            at += len(data)
            block.clear()

        for batch in batches:
            for row in batch.to_pylist():
                out = out or store.open_output_stream(f"{folder}/{name}", compression=None)
                block.append("\t".join("" if row[c] is None else str(row[c]) for c in ("key", "page_id", "file", "offset", "length")))
                if len(block) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if block:
            flush()
        data = zlib.compress("\n".join(directory).encode())
        out.write(data)
        out.close()
        key, page_id = directory[0].split("\t")[:2]
        yield pa.RecordBatch.from_pylist([{"key": key, "page_id": int(page_id) if page_id else None, "file": name,
                                           "offset": at, "length": len(data)}],
                                         schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()),
                                                           ("offset", pa.int64()), ("length", pa.int64())]))

    dealt = captures.repartitionByRange("key", F.col("page_id").asc_nulls_first()).sortWithinPartitions(
        "key", F.col("page_id").asc_nulls_first())
    top = written(dealt.mapInArrow(write, CAPTURE), "index-top")  # one row per partition
    return sorted((_order(r.key, r.page_id), r.file, r.offset, r.length) for r in top.collect())


# ------------------------------------------------------------------ reading
def lookup(keys: DataFrame, top: list[tuple], base: str, payloads: bool = False) -> DataFrame:
    """The records of each (url, page_id) of ``keys``, found by binary search and read by range."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())
            yield pa.record_batch([key, batch.column("page_id")], names=["key", "page_id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(base)
        files: dict[str, pa.NativeFile] = {}

        def ranged(name: str, offset: int, length: int) -> bytes:
            if name not in files:
                if len(files) > 200:
                    files.clear()
                files[name] = store.open_input_file(f"{folder}/{name}")
            return files[name].read_at(length, offset)

        def lines(name: str, offset: int, length: int) -> tuple[list, list]:
            rows = [x.split("\t") for x in zlib.decompress(ranged(name, offset, length)).decode().split("\n")]
            return [_order(x[0], int(x[1]) if x[1] else None) for x in rows], rows

        block = lru_cache(4)(lines)
        firsts = [t[0] for t in top]

        def captures(want: tuple) -> Iterator[list]:
            """Equal keys may run over several blocks and files, so go on while the next begins with no larger one."""
            at = max(bisect.bisect_left(firsts, want) - 1, 0)
            while at < len(top) and firsts[at] <= want:
                own, directory = block(*top[at][1:])
                b = max(bisect.bisect_left(own, want) - 1, 0)
                while b < len(own) and own[b] <= want:
                    held, rows = block(top[at][1], int(directory[b][2]), int(directory[b][3]))
                    k = bisect.bisect_left(held, want)
                    while k < len(held) and held[k] == want:
                        yield rows[k]
                        k += 1
                    b += 1
                at += 1

        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                           ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            out = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for line in captures(_order(key, page_id)):
                    found = parsed(ranged(line[2], int(line[3]), int(line[4])))
                    out.append(found if payloads else found | {"payload": None})
                    if len(out) == 500:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    want = keys.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(keyed, "key string, page_id long").distinct()
    want = written(want, "wanted")
    # keys are few bytes, what they read is not: a task for so many reads, whatever the planner makes of the keys' size
    tasks = max(1, -(-want.count() // READS))
    dealt = want.repartitionByRange(tasks, "key", F.col("page_id").asc_nulls_first()).sortWithinPartitions(
        "key", F.col("page_id").asc_nulls_first())
    return dealt.mapInArrow(search, RECORD)


def archive(pages: DataFrame, base: str | None = None) -> tuple[str, list[tuple]]:
    """Write archives and index of ``pages``; returns their folder and the index's top."""
    base = base or shared_path(pages.sparkSession, "warc")
    return base, write_index(write_archives(pages, base), base)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    base, top = archive(pages)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    read = written(lookup(pages.select("url", "page_id"), top, base).drop("payload"), "records")
    revisits = read.where("record_type = 'revisit'")
    targets = revisits.groupBy("refers_to", "refers_url", "payload_digest").agg(F.count(F.lit(1)).alias("_n"))
    sizes = lookup(targets.select(F.col("refers_url").alias("url"), F.col("refers_to").alias("page_id")), top, base)
    sizes = sizes.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    known = written(targets.groupBy("refers_to", "payload_digest").agg(F.sum("_n").alias("_n")).join(sizes, ["refers_to", "payload_digest"])
                    .select(F.struct("refers_to", "payload_digest").alias("_target"), "_n", "_bytes"), "targets")
    full = attach(revisits.drop("payload_bytes").withColumn("_target", F.struct("refers_to", "payload_digest")), known, "_target", "_n", read.count())
    return read.where("record_type = 'response'").select(columns).unionByName(
        full.withColumnRenamed("_bytes", "payload_bytes").select(columns))


_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
        list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
          substr({_BASE32}, 1 + ((('0x' || substr(h, 5 * i + 1, 5))::INT >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '')
        AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM d
"""
