"""A deterministic sharded WARC writer and its reader, as a Spark data source named `warc`.

Records are range-sorted by payload digest, then page_id from the largest, then url, into shards. Bounds come from a sample by row
hash, so shards, files and every byte of them follow from the records alone, not from partitions or machines. Within a shard the
first record of a digest is the response and the others revisit it, without their payload; a digest that a bound cuts (at most one
for each bound, so a list of proven size) tells the later shards where its response is. So equal payloads need no join and no group,
and a digest with a third of all records is spread. Headers, digests and record ids are made anew; a record is a gzip member of its
own; a file is closed before it exceeds `roll` compressed bytes (a larger record has a file of its own), and its first record tells
its name. Task attempts write under temporary names; the commit renames the files of the successful attempts, then puts the manifest
in place, which alone readers follow. A lost attempt leaves temporary files only, removed by the commit.

Null html: empty payload. Null page_id: last among equal payloads, no page header; if all are null, refers_to is null. Null url: no
target header. Ties: equal page_id by url from the largest; repeated rows: one response, the others revisit it under ids of their
own. Payloads below `least` bytes: all responses. Very long payloads: one at a time in memory. Empty table: a manifest without files.
Extra columns are not read. Control characters and blanks in urls are percent-encoded.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import shared_folder

ROLL = 1_000_000_000
MOST_SHARDS = 10_000
SAMPLES = 20  # of each shard, about
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "manifest.jsonl"
SCHEMA = "page_id bigint, url string, record_type string, record_id string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary, file string"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def rank(digest: str, page_id: int | None) -> tuple:
    """Order of records: by digest, the largest page_id first, null last."""
    return digest, math.inf if page_id is None or page_id != page_id else -int(page_id)


def n_shards(n_bytes: int) -> int:
    """Number and size of shards both grow with the root of the bytes: 256 of 4 MB each for a GB, 8,000 of 125 MB for a TB."""
    return min(MOST_SHARDS, max(1, math.ceil(256 * math.sqrt(n_bytes / 1e9))))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Rows for the writer, sorted within their shards; a shard is whole within a partition."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    d = d.withColumn("n_bytes", F.octet_length("payload").cast("long"))
    size = d.agg(F.count("*"), F.sum("n_bytes")).first()
    shards = n_shards(size[1] or 0)
    d = d.withColumn("digest", F.sha1("payload"))
    one_in = max(1, size[0] // (shards * SAMPLES))
    drawn = d.where(F.pmod(F.xxhash64("payload", "page_id", "url"), F.lit(one_in)) == 0)
    drawn = sorted(rank(*r) for r in drawn.select("digest", "page_id").distinct().collect())  # at most about MOST_SHARDS * SAMPLES
    cuts = [drawn[len(drawn) * i // shards] for i in range(1, shards)] if drawn else []
    cuts = sorted(set(cuts))

    @F.pandas_udf("int")
    def shard(digest: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, rank(*x)) for x in zip(digest, page_id.astype(object).where(page_id.notna(), None))], dtype="int32")

    spark = pages.sparkSession
    cut_digests = spark.createDataFrame([(x,) for x in sorted({c[0] for c in cuts})], "digest string")  # at most MOST_SHARDS
    heads = d.join(F.broadcast(cut_digests), "digest", "left_semi").groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("head"))
    heads = heads.withColumn("head_shard", shard("digest", F.col("head.page_id")))
    d = d.withColumn("shard", shard("digest", "page_id")).join(F.broadcast(heads), "digest", "left")
    # the response of a digest that began in an earlier shard; else it is the first one here
    d = d.withColumn("head", F.when((F.col("head_shard") < F.col("shard")) & (F.col("n_bytes") >= least), F.col("head")))
    d = d.select("shard", "digest", "page_id", "url", "n_bytes", "payload", F.col("head").isNotNull().alias("headed"), F.col("head.page_id").alias("head_page"), F.col("head.url").alias("head_url"), (F.col("n_bytes") >= least).alias("shared"))
    return d.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "digest", F.col("page_id").desc_nulls_last(), F.col("url").desc_nulls_last())


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest, copy]))}>"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as one gzip member without a time stamp; fields without a value are left out."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        for i in range(b.num_rows):  # one payload at a time
            yield {n: c[i].as_py() for n, c in cols.items()}


def serialised(found: Iterator[dict]) -> Iterator[tuple[int, int | None, bytes]]:
    """(shard, page_id, member) of each record, in order."""
    last = head = own = None
    copy = 0
    for r in found:
        payload = r["payload"] or b""
        hashed = hashlib.sha1(payload).digest()
        again = (r["shard"], r["digest"]) == last
        copy = copy + 1 if again and own == (r["page_id"], r["url"]) else 0  # repeated rows get ids of their own
        last, own = (r["shard"], r["digest"]), (r["page_id"], r["url"])
        if not again:
            head = (r["head_page"], r["head_url"]) if r["headed"] else own
        revisit = r["shared"] and (again or r["headed"])
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        fields = [
            ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(*own, r["digest"], copy)), ("WARC-Date", DATE),
            ("WARC-Target-URI", header(own[1]) if own[1] is not None else None), ("X-Page-Id", str(own[0]) if own[0] is not None else None), ("WARC-Payload-Digest", f"sha1:{base32(hashed)}")]
        if revisit:
            fields += [
                ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(*head, r["digest"], 0)), ("WARC-Refers-To-Date", DATE),
                ("WARC-Refers-To-Target-URI", header(head[1]) if head[1] is not None else None), ("X-Refers-To-Page-Id", str(head[0]) if head[0] is not None else None)]
        yield r["shard"], own[0], member([*fields, ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, roll: int) -> None:
        self.folder, self.roll = folder, roll

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, at = fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{at}/_temporary", recursive=True)
        files: list[dict] = []
        out = None

        def close() -> None:
            if out:
                out.close()

        try:
            for shard, page_id, data in serialised(rows(batches)):
                if not files or files[-1]["shard"] != shard or files[-1]["bytes"] + len(data) > self.roll and files[-1]["records"]:
                    close()
                    seq = files[-1]["seq"] + 1 if files and files[-1]["shard"] == shard else 0
                    name = f"pages-{shard:05d}-{seq:05d}.warc.gz"
                    files.append({"name": name, "shard": shard, "seq": seq, "records": 0, "bytes": 0, "first_page": page_id, "temporary": f"_temporary/{uuid.uuid4().hex}"})
                    out = store.open_output_stream(f"{at}/{files[-1]['temporary']}", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, "", 0)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")
                    out.write(info)
                    files[-1]["bytes"] = len(info)
                out.write(data)
                files[-1]["records"] += 1
                files[-1]["bytes"] += len(data)
        finally:
            close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, at = fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{at}/_temporary", recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["shard"], f["seq"]))
        for f in files:
            store.move(f"{at}/{f.pop('temporary')}", f"{at}/{f['name']}")
        with store.open_output_stream(f"{at}/_temporary/{MANIFEST}", compression=None) as out:
            out.write("".join(json.dumps(f) + "\n" for f in files).encode())
        store.move(f"{at}/_temporary/{MANIFEST}", f"{at}/{MANIFEST}")
        store.delete_dir(f"{at}/_temporary")

    def abort(self, messages: list) -> None:
        store, at = fs.FileSystem.from_uri(self.folder)
        for f in (f for m in messages if m for f in m.files):
            if store.get_file_info(f"{at}/{f['temporary']}").type == fs.FileType.File:
                store.delete_file(f"{at}/{f['temporary']}")


@dataclass
class WarcFile(InputPartition):
    name: str
    records: int


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record; the block's digest must be right."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.0":
            raise ValueError(f"no WARC record begins with {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            fields[k] = v
        block = stream.read(int(fields["Content-Length"]))
        if f"sha1:{base32(hashlib.sha1(block).digest())}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"digest of {fields['WARC-Record-ID']}")
        stream.read(4)
        yield fields, block


class WarcReader(DataSourceReader):
    """A partition for each file of the manifest. Batches hold a few MB of payload."""

    def __init__(self, folder: str, payload: bool, schema: StructType) -> None:
        self.folder, self.payload, self.schema = folder, payload, schema

    def partitions(self) -> list[WarcFile]:
        store, at = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{at}/{MANIFEST}", compression=None) as f:
            found = [json.loads(x) for x in f.read().decode().splitlines()]
        return [WarcFile(x["name"], x["records"]) for x in found] or [WarcFile("", 0)]

    def read(self, part: WarcFile) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held, size, n = to_arrow_schema(self.schema), [], 0, 0
        store, at = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{at}/{part.name}", compression=None) as f:
            for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=f))):
                if h["WARC-Type"] == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                revisit, digest = h["WARC-Type"] == "revisit", h["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and base32(hashlib.sha1(payload).digest()) != digest:
                    raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
                whole = lambda k: int(h[k]) if k in h else None
                long = int(re.search(rb"Content-Length: (\d+)", head)[1])
                held.append((whole("X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Type"], h["WARC-Record-ID"], digest, long, whole("X-Refers-To-Page-Id"), payload if self.payload and not revisit else None, part.name))
                size, n = size + len(payload), n + 1
                if len(held) >= 1000 or size > 8_000_000:
                    yield self._batch(held, schema)
                    held, size = [], 0
        if n != part.records:
            raise ValueError(f"{part.name} has {n} records, the manifest says {part.records}")
        if held:
            yield self._batch(held, schema)

    def _batch(self, held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


class WarcSource(DataSource):
    """Options: path, roll (compressed bytes of a file), payload (whether payloads are read)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll", ROLL)))

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", schema)


def as_uri(folder: str) -> str:
    return folder if re.match(r"\w+:", folder) else f"file://{folder}"


def write(pages: DataFrame, folder: str | None = None, roll: int = ROLL, least: int = 0) -> str:
    """Write pages (page_id, url, html) to a new folder; returns it."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    folder = as_uri(folder or f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    records(pages, least).write.format("warc").option("path", folder).option("roll", str(roll)).mode("append").save()
    return folder


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", as_uri(folder)).option("payload", str(payload).lower()).load()


#: Five hexadecimal digits are four characters of base32.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(sha1(p), CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31)]), '')"
ORACLE = f"""WITH d AS (SELECT page_id, url, coalesce(html, '') p FROM pages),
 r AS (SELECT *, row_number() OVER w i, first_value(page_id) OVER w head FROM d WINDOW w AS (PARTITION BY p ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
 SELECT page_id, strlen(p) payload_bytes, {_BASE32} payload_digest, CASE WHEN i = 1 THEN 'response' ELSE 'revisit' END record_type, CASE WHEN i > 1 THEN head END refers_to FROM r"""
