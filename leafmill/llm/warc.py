"""WARC files, written and read in parallel.

A .warc.gz file is a row of gzip members, usually a record each. The reader cuts files into byte ranges; a task looks for
the gzip magic in its range, takes a place for a member only when it inflates to a record header (a WARC version line and
a Content-Length) and another member or the end of the file follows it, and owns the members that start inside its range,
reading beyond its end to finish the last. Members are inflated piece by piece, and all records of a member are read, so a
file that is one member needs no more memory than its longest record. After an owned member the next begins where it ended,
so what only looks like a member inside one is passed over.

Uncompressed .warc files have no mark that a body could not hold as well. A first job walks each file from record to record
by their Content-Length, touching headers only, and notes the first record of each range; ranges are then read in parallel.
So each record is read by exactly one task, whatever the ranges.

Defined results: empty files and ranges without a record give no rows; headers may have any length; of a damaged member the
records before the one that was being read are kept, and the search goes on behind its magic; in an uncompressed file a
place without a record is passed over to the next version line after a blank line; a record cut short by the end of the
file is dropped; ``start`` is where the member or the uncompressed record begins; null fields are written as absent
headers, a null or empty body as an empty one (read back as ''); rows that repeat are written and read each.
"""

from __future__ import annotations

import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = 32 << 20
READ = 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
#: Bytes that a task reads, where there are enough of them; more ranges than tasks share tasks.
TASK = 256 << 20
FIELDS = "path string, start long, type string, record_id string, uri string, date string, content_type string, body binary"


def _open(path: str):
    fs, p = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, p


class _Window:
    """Bytes of a file, read forward by and by."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        self.base, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes at ``at``."""
        end = min(self.size, at + n)
        if at < self.base or end > self.base + len(self.data):
            self.f.seek(at)
            self.base, self.data = at, self.f.read(max(0, min(self.size - at, max(n, READ))))
        return self.data[at - self.base : end - self.base]


END = re.compile(rb"\r?\n\r?\n")


def _header(text: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length of a record header, or None."""
    m = END.search(text)
    if not m or not VERSION.match(text):
        return None
    out = {}
    for line in text[: m.start()].split(b"\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return (out, m.end()) if out.get("content-length", "").isdigit() else None


class _Member:
    """The content of the gzip member at a place, inflated as it is asked for."""

    def __init__(self, w: _Window, at: int):
        self.w, self.pos, self.z = w, at, zlib.decompressobj(31)
        self.text, self.bad, self.first = bytearray(), False, True

    def more(self) -> bool:
        """Inflate another piece; False at the end."""
        if self.bad or self.z.eof:
            return False
        piece = self.w.get(self.pos, 1024 if self.first else READ // 4)
        self.first = False
        try:
            self.text += self.z.decompress(piece)
        except zlib.error:
            self.bad = True
        self.pos += len(piece)
        self.bad |= not piece
        return not self.bad

    @property
    def end(self) -> int:
        return self.pos - len(self.z.unused_data)

    def header(self) -> tuple[dict[str, str], int] | None:
        """That of the record at the beginning of what is left, or None."""
        seen = 0
        while True:
            if len(self.text) >= 12 and not VERSION.match(self.text):
                return None
            if END.search(self.text, max(0, seen - 4)):
                return _header(bytes(self.text))
            seen = len(self.text)
            if not self.more():
                return None

    def records(self):
        """(fields, body) of each record; the last one only when the member has ended well."""
        held = None
        while found := self.header():
            if held:
                yield held
                held = None
            fields, n = found
            size = int(fields["content-length"])
            while len(self.text) < n + size and self.more():
                pass
            if self.bad or len(self.text) < n + size:
                return
            held = fields, bytes(self.text[n : n + size])
            del self.text[: n + size]
            while len(self.text) < 4 and self.more():
                pass
            while self.text[:1] in (b"\r", b"\n"):
                del self.text[:1]
                if not self.text:
                    self.more()
        while self.more():  # the checksum
            self.text.clear()
        if held and not self.bad:
            yield held


def members(w: _Window, start: int, end: int):
    """(start, fields, body) of the records of the gzip members that begin in [start, end)."""
    at, synced = start, start == 0
    while at < end:
        if w.get(at, len(MAGIC)) != MAGIC:
            synced = False
            piece = w.get(at, READ)
            k = piece.find(MAGIC)
            if k < 0:
                if at + len(piece) >= w.size:
                    return
                at += max(1, len(piece) - len(MAGIC) + 1)
                continue
            at += k
            if at >= end:
                return
        if not synced:  # what is inside another member is followed by the rest of that
            probe = _Member(w, at)
            good = probe.header() is not None
            while good and probe.more():
                probe.text.clear()
            if not good or not probe.bad and probe.end < w.size and w.get(probe.end, len(MAGIC)) != MAGIC:
                at += 1
                continue
        m = _Member(w, at)
        for fields, body in m.records():
            yield at, fields, body
        at, synced = (at + 1, False) if m.bad else (m.end, True)


def _plain_header(w: _Window, at: int) -> tuple[dict[str, str], int] | None:
    n = 1024
    if not VERSION.match(w.get(at, 12)):
        return None
    while not END.search(text := w.get(at, n)) and at + n < w.size:
        n *= 4
    return _header(text)


def walk(w: _Window):
    """(start, header length, fields) of each record of an uncompressed file, without reading bodies."""
    at = 0
    while at < w.size:
        found = _plain_header(w, at)
        if found and at + found[1] + int(found[0]["content-length"]) <= w.size:
            yield at, found[1], found[0]
            at += found[1] + int(found[0]["content-length"])
            while (gap := w.get(at, 4)) and gap[:1] in b"\r\n":
                at += 1
            continue
        at += 1
        while at < w.size:
            piece = w.get(at, READ)
            k = piece.find(b"WARC/")
            if k < 0:
                at += max(1, len(piece) - 4)
                continue
            at += k
            if w.get(max(0, at - 4), min(at, 4)).endswith((b"\n\n", b"\n\r\n")):
                break
            at += 1


def plain(w: _Window, start: int, end: int):
    """(start, fields, body) of the records of an uncompressed file from the one at ``start`` to ``end``, exclusively."""
    at = start
    while at < end:
        found = _plain_header(w, at)
        size = int(found[0]["content-length"]) if found else 0
        if not found or at + found[1] + size > w.size:
            return
        yield at, found[0], w.get(at + found[1], size)
        at += found[1] + size
        while (gap := w.get(at, 4)) and gap[:1] in b"\r\n":
            at += 1


def _runs(split: int):
    """(path, size, start, end) of what may be read at once: runs of records that follow each other, cut at each range."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                fs, p = _open(path)
                out, last = [], None
                with fs.open_input_file(p) as f:
                    for at, n, fields in walk(_Window(f, size)):
                        past = at + n + int(fields["content-length"])
                        if last and at // split == last[0] // split and at - last[1] <= 4:
                            last[1] = past
                        else:
                            last = [at, past]
                            out.append(last)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array([size] * len(out), pa.int64()), pa.array([a for a, _ in out], pa.int64()), pa.array([z for _, z in out], pa.int64())], names=["path", "size", "start", "end"])

    return run


def splits(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """(path, size, start, end) of each byte range; folders are listed on the driver, as Spark lists its inputs, ranges are not."""
    found = []
    for path in paths:
        fs, p = _open(path)
        info = fs.get_file_info(p)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(p, recursive=True))
        pre = path[: len(path) - len(p)] if path.endswith(p) else ""
        found += [(pre + x.path, x.size) for x in files if x.type == pafs.FileType.File and x.size and re.search(r"\.warc(\.gz)?$", x.path)]
    parallel = spark.sparkContext.defaultParallelism
    tasks = lambda some: max(1, min(sum(-(-n // split) for _, n in some), max(parallel * 4, sum(n for _, n in some) // TASK)))
    table = lambda some: spark.createDataFrame(some, "path string, size long")
    zipped, raw = [x for x in found if x[0].endswith(".gz")], [x for x in found if not x[0].endswith(".gz")]
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start")
    out = table(zipped).select("path", "size", at).withColumn("end", F.least("size", F.col("start") + split)).repartition(tasks(zipped))
    if raw:
        out = out.unionByName(table(raw).repartition(max(1, min(len(raw), parallel * 4))).mapInArrow(_runs(split), "path string, size long, start long, end long").repartition(tasks(raw)))
    return out


def _read(batches):
    import pyarrow as pa

    names = ["path", "start", "type", "record_id", "uri", "date", "content_type", "body"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()]
    for batch in batches:
        for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            fs, p = _open(path)
            rows, held = [], 0
            with fs.open_input_file(p) as f:
                w = _Window(f, size)
                for at, h, body in (members if path.endswith(".gz") else plain)(w, start, end):
                    rows.append((path, at, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), body))
                    held += len(body)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_warc(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """All records of the .warc and .warc.gz files given or in the folders given."""
    return splits(spark, paths, split).mapInArrow(_read, FIELDS)


def render(kind: str, uri: str | None, body: bytes, record_id: str, date: str, content_type: str) -> bytes:
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"Content-Type: {content_type}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_warc(df: DataFrame, folder: str, compress: bool = True, level: int = 6) -> DataFrame:
    """Write (uri, record_id, body) rows as resource records, a file a task; (path, records, bytes) of each file.

    A file is written under a name of the attempt and then renamed to that of its partition, so a task that
    runs again replaces its file.
    """
    stamp = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, p = _open(folder)
        fs.create_dir(p, recursive=True)
        part = TaskContext.get().partitionId()
        final = f"{p}/part-{part:05d}.warc" + (".gz" if compress else "")
        tmp = f"{p}/_{uuid.uuid4().hex}"
        n = size = 0
        with fs.open_output_stream(tmp, compression=None) as out:
            for batch in batches:
                for uri, rid, body in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = render("resource", uri, body or b"", rid, stamp, "text/html; charset=utf-8")
                    if compress:
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        raw = z.compress(raw) + z.flush()
                    out.write(raw)
                    n += 1
                    size += len(raw)
        fs.move(tmp, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n]), pa.array([size])], names=["path", "records", "bytes"])

    d = df.select(F.col("uri").cast("string"), F.col("record_id").cast("string"), F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body"))
    return d.mapInArrow(run, "path string, records long, bytes long")
