"""WARC: a deterministic sharded writer and a reader.

Pages are dealt to shards by ranges of page_id that hold about equal payload bytes: ids are cut by their bytes, from the
first on, and wherever a range holds more than a shard it is cut by its next byte, so ids may lie as unevenly as they
like; only one id's repeated rows can exceed a shard. Each shard is written in page_id order by one task, and a new file
starts when the current one's compressed bytes reach the limit.
Every record is its own gzip member with fixed time stamps, headers and digests made anew, so the same pages give the same
bytes. A file is written under a temporary name and renamed when whole; a repeated task renames the same bytes over it.
The manifest, a table of files with sizes and digests, is written last and is what readers go by; they check both.

Of pages with equal payloads of at least REVISIT_BYTES bytes, that with the largest page_id is a response, others are
revisits that name it. Smaller ones are all responses. Of repeated rows of that page, one is the response. Null html is an
empty payload; a null url leaves the target out; null page_ids come first, in shards of their own that a hash deals them
to, take no part in revisits and are read back null. A payload of any length is one record, held whole by the task that
writes it. An empty table gives an empty manifest and reads back without rows. Columns of other names play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.common import bounded, save, shared_dir

REVISIT_BYTES, FILE_BYTES, SHARD_BYTES = 1000, 16 << 20, 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:x-page:"


# ---------------------------------------------------------------- records


def digest_text(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit (refers_to is given) has the HTTP header, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{PAGE_URN}{name}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~"))] if url else []),
        ("WARC-Payload-Digest", digest_text(payload)),
        ("WARC-Block-Digest", digest_text(block)),
        *([("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>"), ("WARC-Profile", PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after another."""
    unzip, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(out)
                unzip, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the last record is cut off")


def parsed(raw: bytes) -> dict:
    """A record's page_id, payload_bytes, payload_digest, record_type and refers_to; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    if digest_text(block) != fields["WARC-Block-Digest"] or not revisit and digest_text(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"the digest of {fields['WARC-Record-ID']} differs")
    name = lambda x: int(n) if (n := x.strip("<>").removeprefix(PAGE_URN)) else None
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    return {
        "page_id": name(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "record_type": fields["WARC-Type"], "refers_to": name(fields["WARC-Refers-To"]) if revisit else None,
    }


# ---------------------------------------------------------------- writing


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, payload) -> digest groups of two or more: digest, holder (the largest page_id)."""
    large = pages.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    return large.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("digest", "holder")


def digit_of(page_id: Column, level: int) -> Column:
    """The id's byte of that level, the first is 0, in the order of signed ids."""
    return F.shiftrightunsigned(page_id.bitwiseXOR(F.lit(-(1 << 63))), 56 - 8 * level).bitwiseAND(F.lit(255)).cast("int")


def shard_of(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[Column, int]:
    """A column that numbers ranges of page_id of about shard_bytes of payload, and how many there are.

    A tree over the bytes of ids: a node has 256 children, and a child with more than shard_bytes is a node itself. The driver
    holds the tree, 256 numbers for each heavy range; ranges are counted in Spark, a level at a time, from ids and sizes alone.
    """
    sizes = save(pages.select("page_id", (F.octet_length("payload") + 500).cast("long").alias("n")), "page-sizes")
    nulls = sizes.where("page_id IS NULL").agg(F.sum("n")).first()[0] or 0
    of_nulls = -(-nulls // shard_bytes)
    held = sizes.where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum("n").alias("n"))
    # an entry is the number of the child's node or, where the tree ends, -1 less the shard
    tree, weights, heavy = [-1] * 256, [0] * 256, [0]
    for level in range(8):
        at = followed(tree, level)
        rows = held.groupBy(at.alias("node"), digit_of(F.col("page_id"), level).alias("digit")).agg(F.sum("n").alias("n")).where(F.col("node").isin(heavy)).collect() if heavy else []
        heavy = []
        for r in sorted(rows):
            weights[r.node * 256 + r.digit] = r.n
            if r.n > shard_bytes and level < 7:
                heavy.append(len(tree) // 256)
                tree[r.node * 256 + r.digit] = heavy[-1]
                tree += [-1] * 256
                weights += [0] * 256
    total = 0

    def number(node: int) -> None:
        nonlocal total
        for k in range(node * 256, node * 256 + 256):
            if tree[k] >= 0:
                number(tree[k])
            else:
                tree[k] = -1 - (of_nulls + total // shard_bytes)
                total += weights[k]

    number(0)
    null_shard = F.pmod(F.xxhash64("url", "payload"), F.lit(max(1, of_nulls))).cast("int")
    return F.when(F.col("page_id").isNull(), null_shard).otherwise(-1 - followed(tree, 8)), of_nulls + max(1, -(-total // shard_bytes))


def followed(tree: list[int], levels: int) -> Column:
    """Where an id comes to by so many of its bytes: a node, or the negative entry where it left the tree."""
    digits = F.array(*(digit_of(F.col("page_id"), k) for k in range(levels))).cast("array<int>")
    entries = F.split(F.lit(",".join(map(str, tree))), ",").cast("array<int>")  # one constant, where a list would be one of each number
    return F.aggregate(digits, F.lit(0), lambda at, digit: F.when(at < 0, at).otherwise(F.element_at(entries, at * 256 + digit + 1)))


@bounded
def write(pages: DataFrame, place: str | None = None, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> str:
    """Write (page_id, url, html) as WARC files under `place` (any file system that PyArrow opens by URI) with a manifest."""
    spark: SparkSession = pages.sparkSession
    place = place or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    plain = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    shard, shards = shard_of(plain, shard_bytes)
    large = (F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    holders = plain.where(large).select("page_id", F.sha2("payload", 256).alias("digest")).join(revisits(plain), "digest").distinct()
    rows = plain.select("page_id", "url", "payload", F.lit(None).cast("long").alias("holder"), F.lit(None).cast("string").alias("digest"))
    rows = rows.unionByName(holders.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "holder", "digest"))
    tasks = max(shards, min(4 * shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["shard", "page_id", F.col("payload").isNotNull(), "url", F.sha2("payload", 256)]
    dealt = rows.withColumn("shard", shard).repartition(tasks, "shard").sortWithinPartitions(*order)

    def put(batches):
        out = ShardFiles(place, file_bytes)
        page, holders, seen = None, {}, set()  # of one page_id: the holder of each digest, and the digests written
        for batch in batches:
            for row in batch.to_pylist():
                if row["page_id"] != page:
                    page, holders, seen = row["page_id"], {}, set()
                if row["payload"] is None:  # comes before its page
                    holders[row["digest"]] = row["holder"]
                    continue
                target, payload = None, row["payload"].encode()
                if holders and len(payload) >= REVISIT_BYTES:
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest in holders and (holders[digest] != page or digest in seen):
                        target = holders[digest]
                    seen.add(digest)
                out.add(row["shard"], record(row["page_id"], row["url"], payload, target))
        yield pa.RecordBatch.from_pylist(out.close(), pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    dealt.select("shard", "page_id", "url", "payload", "holder", "digest").mapInArrow(put, "file string, records bigint, bytes bigint, sha256 string").write.parquet(f"{place}/manifest")
    return place


class ShardFiles:
    """A task's files: rolled by shard and by compressed size, each renamed to its final name when it is whole."""

    def __init__(self, place: str, file_bytes: int):
        self.system, self.folder = fs.FileSystem.from_uri(place)
        self.file_bytes, self.done, self.stream, self.shard, self.number = file_bytes, [], None, None, 0

    def add(self, shard: int, raw: bytes) -> None:
        if shard != self.shard:
            self.end()
            self.shard, self.number = shard, 0
        if self.stream is None:
            self.name = f"pages-{shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.system.create_dir(self.folder, recursive=True)
            self.stream, self.hash, self.records, self.bytes = self.system.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        zipped = zlib.compressobj(4, zlib.DEFLATED, 31)
        data = zipped.compress(raw) + zipped.flush()
        self.stream.write(data)
        self.hash.update(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        if self.bytes >= self.file_bytes:
            self.end()

    def end(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.system.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append({"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.hash.hexdigest()})
            self.stream, self.number = None, self.number + 1

    def close(self) -> list[dict]:
        self.end()
        return self.done


# ---------------------------------------------------------------- reading


class Seen:
    """A stream whose bytes are counted and digested as they are read."""

    def __init__(self, stream):
        self.stream, self.bytes, self.hash = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.bytes += len(data)
        self.hash.update(data)
        return data


def read(spark: SparkSession, place: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the manifest's files."""
    files = spark.read.schema("file string, records bigint, bytes bigint, sha256 string").parquet(f"{place}/manifest")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def get(batches):
        system, folder = fs.FileSystem.from_uri(place)
        for batch in batches:
            for line in batch.to_pylist():
                name, rows = line["file"], []
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    seen = Seen(stream)
                    rows = [parsed(raw) for raw in members(seen)]
                if (len(rows), seen.bytes, seen.hash.hexdigest()) != (line["records"], line["bytes"], line["sha256"]):
                    raise ValueError(f"{name} has {len(rows)} records in {seen.bytes} bytes, or another digest; the manifest says {line['records']} in {line['bytes']}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.repartition(max(1, spark.sparkContext.defaultParallelism), "file").mapInArrow(get, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(pages.sparkSession, write(pages)).drop("url")
