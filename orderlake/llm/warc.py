"""WARC: a deterministic sharded writer, and its reader.

Rows are range-sorted by (page_id, digest, url) and cut into shards of about equal
payload bytes by exact prefix sums over key ranges. Each shard is written by one
task as gzip members, one a record, rolling to a new file when the compressed
size reaches ``roll_bytes``. Headers and digests are made anew from the payloads;
of equal payloads the smallest id (then url, then repeat) is a response and the
others revisit it. Files are written under temporary names that hold the
attempt, renamed by tasks once all are complete, and named in a manifest, lines
of JSON that are themselves renamed into place last, so a retried or lost task
leaves nothing that readers see, and reruns write the same bytes.

A null payload is empty, a null url is the empty text, a null id sorts first
and has the empty id. Repeated ids are written each, rows alike in id, url and
payload by one task. Very long payloads are one record. An empty table gives an
empty manifest, and columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, durable_path, spread

#: Ranges of page_id; shards whose bounds are broadcast.
RANGES, MOST_CUTS = 128, 1 << 17
#: The date of all records unless the caller gives one: archives must not depend on when they are written.
DATE = "1970-01-01T00:00:00Z"


def uri(path: str) -> str:
    """A folder as Arrow names it: Hadoop has other names for some schemes."""
    scheme, colon, rest = path.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}.get(scheme, scheme)
    if scheme == "file" and not rest.startswith("//"):
        rest = f"//{rest}"
    return f"{scheme}{colon}{rest}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri(path))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, repeat: int, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record without its trailing compression."""
    name = lambda i, k, u: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}|{k}|{u}')}>"
    kind = "revisit" if revisit else "response"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id, repeat, url)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {name(refers_to, 0, refers_url)}",
            f"WARC-Refers-To-Target-URI: {refers_url}",
            f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
        ]
    clean = [x.replace("\r", "%0D").replace("\n", "%0A") for x in lines]
    return ("\r\n".join([*clean, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _open(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done: list[tuple] = []
        state: dict = {"shard": None}
        page, lead, repeat = None, None, 0

        def close() -> None:
            if state.get("out") is not None:
                state["out"].close()
                done.append((state["name"], state["temporary"], state["shard"], state["part"], state["records"], state["bytes"], state["sha"].hexdigest()))
                state["out"] = None

        def start(shard: int, part: int) -> None:
            name = f"warc-{shard:05d}-{part:05d}.warc.gz"
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{shard}/{part}')}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"
            # the attempt is in the temporary name: two attempts of a task never touch one file
            state.update(shard=shard, part=part, name=name, temporary=f"_temporary/{attempt}-{name}", records=0, bytes=0, sha=hashlib.sha256())
            state["out"] = files.open_output_stream(f"{top}/{state['temporary']}", compression=None)
            put(info.encode())

        def put(raw: bytes) -> None:
            member = gzip.compress(raw, 6, mtime=0)
            state["out"].write(member)
            state["sha"].update(member)
            state["bytes"] += len(member)

        for batch in batches:
            for x in batch.to_pylist():
                if page != (x["page_id"], x["url"], x["sha"]):
                    page, lead, repeat = (x["page_id"], x["url"], x["sha"]), None, -1
                if x["first_url"] is not None:
                    lead = (x["first_id"], x["first_url"])
                    continue
                repeat += 1
                if state["shard"] != x["shard"]:
                    close()
                    start(x["shard"], 0)
                elif state["bytes"] >= roll_bytes:
                    part = state["part"]
                    close()
                    start(x["shard"], part + 1)
                payload = x["payload"].encode("utf-8", "surrogatepass")
                revisit = lead is not None and (lead != page[:2] or repeat > 0)
                put(record(x["page_id"], repeat, x["url"], payload, _digest(payload), *(lead or (None, "")), revisit, date))
                state["records"] += 1
        close()
        names = ["file", "temporary", "shard", "part", "records", "bytes", "sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names)

    return run


def plan(pages: DataFrame, shard_bytes: int, least: int) -> tuple[DataFrame, int]:
    """What the writer gets, and the number of shards.

    Payload rows have first_url null. A row before them, without payload, names
    the response that equal payloads of this page refer to: page_id, url, sha,
    payload, shard, first_id, first_url. Payloads are shuffled once, by shard;
    ranges, prefix sums and the grouping by digest work on keys alone.

    Rows are in order of (page_id, sha, url). Approximate quantiles of page_id
    bound the ranges, an id as frequent as a range (or null) is cut by its digests;
    the exact prefix sums of bytes over ranges say which shard a key is in, so
    where the bounds lie changes no shard.
    """
    rows = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    slim = durable(rows.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("size")), "warc-keys")
    keys = durable(slim.groupBy("page_id", "url", "sha").agg(F.sum(F.col("size") + 600).alias("bytes")), "warc-places")
    bounds = keys.approxQuantile("page_id", [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES) if not keys.isEmpty() else []
    bounds = [int(b) for b in bounds]
    hot = [b for b in set(bounds) if bounds.count(b) > 1]
    part = sum(((F.col("page_id") > b).cast("int") for b in sorted(set(bounds))), F.lit(0)) + sum(((F.col("page_id") >= b).cast("int") for b in hot), F.lit(0))
    often = F.col("page_id").isNull() | F.col("page_id").isin(*hot) if hot else F.col("page_id").isNull()
    part = [F.coalesce(part, F.lit(-1)).alias("part"), F.when(often, F.conv(F.substring("sha", 1, 2), 16, 10).cast("int")).otherwise(F.lit(0)).alias("sub")]
    keys = keys.select("*", *part)
    # at most 256 rows for each of some RANGES ids
    sums = keys.groupBy("part", "sub").agg(F.sum("bytes").alias("bytes"))
    starts = sums.select(F.col("part").alias("p"), F.col("sub").alias("s"), (F.sum("bytes").over(Window.orderBy("part", "sub")) - F.col("bytes")).alias("begin"))
    order = Window.partitionBy("part", "sub").orderBy(F.col("page_id").asc_nulls_first(), "sha", "url")
    before = F.col("begin") + F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    placed = keys.join(F.broadcast(starts), (F.col("part") == F.col("p")) & (F.col("sub") == F.col("s"))).withColumn("shard", F.floor(before / F.lit(shard_bytes)).cast("int"))
    placed = placed.withColumn("new", F.col("shard") != F.lag("shard").over(order))
    cut = F.struct("page_id", "sha", "url", "shard")
    # of each range its first shard, and the first key of each shard that begins in it
    cuts = durable(placed.groupBy("part", "sub").agg(F.min("shard").alias("base"), F.max("shard").alias("top"), F.sort_array(F.collect_list(F.when(F.col("new"), cut))).alias("cuts")), "warc-shards")
    n = int((cuts.agg(F.max("top")).first()[0] or 0) + 1)
    here = lambda c: F.struct(c["page_id"], c["sha"], c["url"]) <= F.struct("page_id", "sha", "url")
    shard = F.coalesce(F.try_element_at(F.filter("cuts", here), F.lit(-1))["shard"], F.col("base"))
    first = slim.where(F.col("size") >= least).groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct("page_id", "url")).alias("first")).where("copies > 1")
    leads = slim.join(first.select("sha", "first"), "sha").select("page_id", "url", "sha", F.lit(None).cast("string").alias("payload"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")).distinct()
    both = rows.select("page_id", "url", "sha", "payload", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url")).unionByName(leads).select("*", *part)
    cuts = F.broadcast(cuts.drop("top")) if n <= MOST_CUTS else cuts.drop("top")
    return both.join(cuts, ["part", "sub"]).withColumn("shard", shard).drop("part", "sub", "base", "cuts"), n


def _commit(folder: str):
    """Renames a task's files; one that is already renamed, by an attempt that was lost, stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _open(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if files.get_file_info(f"{top}/{temporary}").type != pafs.FileType.NotFound:
                    files.move(f"{top}/{temporary}", f"{top}/{name}")
                elif files.get_file_info(f"{top}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{temporary}")
            yield batch

    return run


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 32 << 20, roll_bytes: int = 4 << 20, least: int = 0, date: str = DATE) -> None:
    """Writes all ``pages`` (page_id, url, html) and commits a manifest, a line of JSON a file."""
    spark = pages.sparkSession
    files, top = _open(folder)
    files.create_dir(f"{top}/_temporary", recursive=True)
    rows, shards = plan(pages, shard_bytes, least)
    # a shard is whole in one task, and sorted there
    rows = rows.select("page_id", "url", "sha", "payload", "first_id", "first_url", "shard").repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha", "url", F.col("first_url").isNull())
    schema = "file string, temporary string, shard int, part int, records long, bytes long, sha256 string"
    written = durable(rows.mapInArrow(_writer(folder, roll_bytes, date), schema), "warc-files")
    done = durable(written.mapInArrow(_commit(folder), schema).drop("temporary"), "warc-committed")
    fresh = f"{folder.rstrip('/')}/_manifest-{uuid.uuid4().hex}"
    done.repartitionByRange(max(1, shards // 1024), "shard", "part").sortWithinPartitions("shard", "part").write.json(fresh)
    jvm = spark.sparkContext._jvm
    path = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    system = path(fresh).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = path(f"{folder.rstrip('/')}/manifest")
    if system.exists(target):
        raise FileExistsError(f"{folder} has a manifest already")
    system.rename(path(fresh), target)
    files.delete_dir(f"{top}/_temporary")  # with what lost attempts left there


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a decompressed archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        if raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block
        at = end + 8 + size


def _members(stream) -> Iterator[bytes]:
    """Decompressed gzip members, one after the other, of a file that is never whole in memory."""
    import zlib

    left, unit = b"", zlib.decompressobj(31)
    out: list[bytes] = []
    while chunk := left or stream.read(1 << 20):
        out.append(unit.decompress(chunk))
        left = b""
        if unit.eof:
            left = unit.unused_data
            yield b"".join(out)
            out, unit = [], zlib.decompressobj(31)
    if out and any(out):
        raise ValueError("the archive ends within a member")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _open(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        for head, block in parse(member):
                            if head["WARC-Type"] == "warcinfo":
                                continue
                            if head["WARC-Block-Digest"] != f"sha1:{_digest(block)}":
                                raise ValueError(f"a block of {name} does not match its digest")
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            kind = head["WARC-Type"]
                            if kind == "response" and _digest(payload) != digest:
                                raise ValueError(f"a payload of {name} does not match its digest")
                            number = lambda k: int(head[k]) if head.get(k) else None
                            rows.append((number("X-Page-Id"), head["WARC-Target-URI"], number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-Id"), payload.decode("utf-8", "surrogatepass") if kind == "response" else None))
                            held += len(payload) + 200
                            if held > 4 << 20:
                                yield batch_of(rows)
                                rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records that the manifest's files hold, with payloads of responses."""
    names = spark.read.schema("file string").json(f"{folder.rstrip('/')}/manifest")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    # some files a task, of a few MB each
    return names.repartition(max(1, min(names.count(), 10_000))).mapInArrow(_reader(folder), schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives into the shared folder and reads them back."""
    folder = durable_path(pages.sparkSession, "warc")
    write_warc(pages, folder, least=least)
    return read_warc(pages.sparkSession, folder)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, list_reduce(list_transform(string_split(x, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', c) - 1) * 4 + 1, 4)), lambda a, c: a || c) AS bits FROM d),
f AS (SELECT x, payload_bytes, min(page_id) AS first_id FROM d GROUP BY ALL)
SELECT b.page_id, b.payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN b.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN b.page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b JOIN f ON b.x = f.x AND b.payload_bytes = f.payload_bytes
"""
