"""WARC archives with an index that is written first.

Each task writes its records to one archive file in the shared folder, every record a gzip
member of its own, and returns offset, length, URL and payload digest of each as rows of the
index. A task that runs again writes another file; the index names the one that counts.
Reading sorts the selected index rows by file and offset, cuts the files into windows of
``READ_BYTES``, and joins neighbouring records of a window into one byte-range read.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the least
page_id is a response and the others revisit it. Rows that tie on the least page_id are all
responses. A null page_id revisits a page that has one; without one all are responses. Ids are of
any type that has an order; archives hold them as text. A
null html is an empty payload. A null url is left out. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 100
#: Bytes of an archive that one read covers at most (a longer record is read alone).
READ_BYTES = 8 << 20
#: Unselected bytes between two records that are read along rather than skipped.
GAP_BYTES = 64 << 10
#: Digests of at least one in so many rows are broadcast; there can't be more of them than that.
HOT = 4096
DATE = "2000-01-01T00:00:00Z"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def _record(page_id: int | None, url: str | None, digest: str, refers_to: int | None, revisit: bool,
            payload: bytes) -> bytes:
    """One WARC record, as a gzip member. A revisit has no payload of its own."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += b"Content-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"),
              ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=_PRINTABLE)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}/{digest}')}>"),
                   ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 2, mtime=0)


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the payload of one record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, block.partition(b"\r\n\r\n")[2]


def assign(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, revisit, refers_to) of every page."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    long_ = F.octet_length("html") >= REVISIT_BYTES
    again = own.filter(long_).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = common.Scratch(pages.sparkSession, "digests").keep(again, "again")
    # pages of a payload that very many have meet it where they are; of the others none has many
    often = F.col("n") * HOT >= (again.agg(F.sum("n")).first()[0] or 0)
    met = own.join(F.broadcast(again.filter(often)), "digest", "left")
    rest = met.filter("n is null").drop("first", "n").join(again.filter(~often), "digest", "left")
    both = met.filter("n is not null").unionByName(rest)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "html", "digest", revisit.alias("revisit"),
                       F.when(revisit, F.col("first")).alias("refers_to"))


def write(assigned: DataFrame, folder: str) -> DataFrame:
    """Write the records to archives in ``folder``; the index, to be kept by the caller at once.

    (page_id, url, digest, revisit, refers_to, file, offset, length) of every record.
    """
    common.prepare(assigned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            for part in common.slices(batch, "html"):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                offsets, lengths = [], []
                html = part.column("html")
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "revisit")]
                for row, values in enumerate(zip(*columns)):
                    data = _record(*values, html[row].as_py().encode())
                    out.write(data)
                    offsets.append(offset)
                    lengths.append(len(data))
                    offset += len(data)
                keep = [part.column(c) for c in ("page_id", "url", "digest", "revisit", "refers_to")]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()),
                     pa.array(lengths, pa.int64())],
                    ["page_id", "url", "digest", "revisit", "refers_to", "file", "offset", "length"])
        if out:
            out.close()

    kind = assigned.schema["page_id"].dataType.simpleString()
    return assigned.mapInArrow(run, f"page_id {kind}, url string, digest string, revisit boolean, refers_to {kind}, "
                                    "file string, offset long, length long")


def read(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload) of the index's records.

    The payload of a revisit is null; its digest is that of the response it refers to.
    """
    common.prepare(index.sparkSession)
    kind = index.schema["page_id"].dataType.simpleString()
    at = F.struct("offset", "length", "page_id", "url", "digest", "refers_to")
    windows = index.groupBy("file", (F.col("offset") / READ_BYTES).cast("long").alias("window")).agg(
        F.sort_array(F.collect_list(at)).alias("records")).select("file", "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            whole = batch.schema.field("records").type.value_type.field("page_id").type
            for row in batch.to_pylist():
                runs: list[list[dict]] = []
                for r in row["records"]:
                    if not runs or r["offset"] > runs[-1][-1]["offset"] + runs[-1][-1]["length"] + GAP_BYTES:
                        runs.append([])
                    runs[-1].append(r)
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    for own in runs:
                        start = own[0]["offset"]
                        data = source.read_at(own[-1]["offset"] + own[-1]["length"] - start, start)
                        yield from _rows(own, data, start, whole)

    def _rows(own: list[dict], data: bytes, start: int, whole: pa.DataType) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(own), 256):
            out: dict[str, list] = {c: [] for c in ("page_id", "url", "record_type", "refers_to", "payload_digest",
                                                    "payload")}
            for r in own[k:k + 256]:
                fields, payload = _parse(data[r["offset"] - start:r["offset"] - start + r["length"]])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                revisit = fields["WARC-Type"] == "revisit"
                if digest != r["digest"] or not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{r['url']}: the record at {r['offset']} isn't the one in the index")
                named = None if r["refers_to"] is None else str(r["refers_to"])
                if fields.get("X-Refers-To-Page") != named:
                    raise ValueError(f"{r['url']}: the record at {r['offset']} refers to another page than the index says")
                for c, v in zip(out, (r["page_id"], r["url"], fields["WARC-Type"], r["refers_to"], digest,
                                      None if revisit else payload)):
                    out[c].append(v)
            types = [None, pa.string(), pa.string(), None, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t or whole) for v, t in zip(out.values(), types)], list(out))

    return windows.mapInArrow(run, f"page_id {kind}, url string, record_type string, refers_to {kind}, "
                                   "payload_digest string, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; a revisit's size is that of its response."""
    scratch = common.Scratch(spark, "warc")
    folder = scratch.path("archives")
    index = scratch.keep(write(assign(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder), "index")
    rows = scratch.keep(read(index, folder).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type",
        "refers_to"), "rows")
    sizes = rows.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    again = rows.filter("record_type = 'revisit'").join(sizes, "payload_digest").select(
        "page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return rows.filter("record_type = 'response'").unionByName(again)
