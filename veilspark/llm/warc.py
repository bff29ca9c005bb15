"""WARC archives: a writer that stores repeated payloads once, and a reader that salvages damaged files.

Archives are written by Spark's own writer into a folder that the executors share and read with its binary-file reader, so
any store that Spark reaches will do.  A compressed archive that is written here holds one gzip member for each record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the format.
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "path string, offset long, length long, inner_offset long, inner_length long, kind string, reason string, gaps_before long, record_type string, record_id string,"
    " target_uri string, refers_to string, payload_digest string, payload_bytes long, checked boolean, payload binary"
)
#: Bytes of the longest record inside a gzip member that is looked for: a longer one is quarantined, as it is no row that Spark could hold.
#: A member may hold any number of records and inflate to any size.
MOST_RECORD = 1 << 30
#: Bytes of a member that are held at once where it is no longer; longer ones are inflated twice, first to check them.
HELD = 16 << 20


def dedup_plan(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Say which rows become revisits: id, uri, payload, digest, record_type, refers_to (the response's id).

    Of rows with equal payloads of min_bytes or more the one with the largest id is the response; rows that repeat
    this id are responses too, a null id is the smallest.  Smaller payloads are all responses.  A null payload is empty.
    Other columns are not read, whatever their names.  An empty table gives an empty plan.
    """
    url = F.col("url") if "url" in pages.columns else F.lit("")
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url, F.lit("")).alias("uri"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only payloads that occur twice or more are joined: partial counts first, then a join that Spark broadcasts if its
    # side is small and splits where a payload is frequent.
    large = rows.where(F.octet_length("payload") >= min_bytes)
    twice = large.groupBy("digest").agg(F.max("id").alias("_response"), F.count("*").alias("_n")).where("_n > 1").select(F.col("digest").alias("_digest"), "_response")
    joined = rows.join(twice, rows["digest"] == twice["_digest"], "left")
    revisit = F.col("_response").isNotNull() & ~F.col("id").eqNullSafe(F.col("_response"))
    return joined.select("id", "uri", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_response")).alias("refers_to"))


def record_bytes(record_type: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record.  A revisit has the HTTP header alone and gives its payload's length in an extension field."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        ("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)),
        ("WARC-Payload-Digest", f"sha1:{b32}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>"), ("X-Payload-Length", str(len(payload)))] if record_type == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    """A gzip member whose last byte is 0, as Spark's text writer ends each value with that byte.

    The last byte is the top one of the record's length, so it is 0 up to 16 MiB; else an empty member follows.
    """
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    data = deflate.compress(record) + deflate.flush()
    if data[-1]:
        deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
        data += deflate.compress(b"") + deflate.flush()
    return data


def write_warc(plan: DataFrame, path: str, compress: bool = True, file_bytes: int = 64_000_000) -> None:
    """Write a plan of dedup_plan() as archives of about file_bytes each (one record at least), in the plan's own partitions.

    Null and empty payloads are records of no bytes, very long ones records of their own length; rows that repeat are each written.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = 0
        for pdf in batches:
            out, file = [], []
            for i, uri, payload, digest, kind, refers in zip(pdf["id"], pdf["uri"], pdf["payload"], pdf["digest"], pdf["record_type"], pdf["refers_to"], strict=True):
                record = record_bytes(kind, f"urn:page:{i}", uri, bytes(payload), digest, None if refers is None else f"urn:page:{refers}")
                out.append(gzip_member(record)[:-1] if compress else record[:-4])
                file.append(held // file_bytes)
                held += len(out[-1])
            yield pd.DataFrame({"value": out, "file": file})

    cols = plan.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "uri", "payload", "digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    records = cols.mapInPandas(build, "value binary, file long").select(F.col("value").cast("string"), "file")
    records.write.option("lineSep", "\x00" if compress else "\r\n\r\n").partitionBy("file").text(path)


def _hex(digest: str | None) -> str | None:
    """A labelled SHA-1 digest in base 32 or 16 as hex; None if there is none or it's of another kind."""
    if not digest or not digest.lower().startswith("sha1:"):
        return None
    value = digest[5:].strip()
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at this place, where it ends, and what is wrong with it (then there is no record)."""
    if not (line := _VERSION_LINE.match(data, at)):
        return None, at, "no version line"
    if not (end := _HEAD_END.search(data, line.end() - 2)):
        return None, at, "header without end"
    fields: dict[str, str] = {}
    for text in data[line.end() : end.start()].decode("utf-8", "replace").splitlines():
        name, colon, value = text.partition(":")
        if not colon:
            return None, at, "bad header line"
        fields.setdefault(name.strip().lower(), value.strip())
    if not {"warc-type", "warc-record-id", "warc-date"} <= fields.keys():
        return None, at, "mandatory field missing"
    size = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        return None, at, "bad content length"
    start, stop = end.end(), end.end() + int(size)
    if stop > len(data):
        return None, at, "block cut off"
    close = re.compile(rb"\r\n\r\n").match(data, stop)
    if not close:
        return None, at, "no record end after the block"
    block = data[start:stop]
    if (want := _hex(fields.get("warc-block-digest"))) and hashlib.sha1(block).hexdigest() != want:
        return None, at, "block digest differs"
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        http = _HEAD_END.search(block)
        payload = block[http.end() :] if http else b""
    digest, kind, checked = _hex(fields.get("warc-payload-digest")), fields.get("warc-type"), want is not None
    if kind != "revisit":
        own = hashlib.sha1(payload).hexdigest()
        if digest and own != digest:
            return None, at, "payload digest differs"
        digest, checked = own, checked or digest is not None
    strip = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x
    n = fields.get("x-payload-length", "")
    return {
        "record_type": kind, "record_id": strip(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "refers_to": strip(fields.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": (int(n) if n.isdigit() else None) if kind == "revisit" else len(payload), "checked": checked, "payload": payload,
    }, close.end(), ""


def _inflated(data: bytes, at: int) -> Iterator[bytes]:
    """What the gzip member at this place holds, in parts, as far as it can be read; returns its end if its CRC is right, and what is wrong with it."""
    inflate, place = zlib.decompressobj(31), at
    try:
        while not inflate.eof:
            part = data[place : place + 65536]
            if not part:
                return None, "member cut off"
            out = inflate.decompress(part, 1 << 20)
            place += len(part) - len(inflate.unconsumed_tail)
            if out:
                yield out
    except zlib.error:
        return None, "broken member"
    return place - len(inflate.unused_data), ""


def _member(data: bytes, at: int) -> tuple[list[bytes] | None, int | None, str]:
    """The parts of a member that is short enough to be held (else None), its end if its CRC is right, and what is wrong with it."""
    parts, size, held = _inflated(data, at), 0, []
    while True:
        try:
            part = next(parts)
        except StopIteration as e:
            return (held if size <= HELD else None), *e.value
        size += len(part)
        if size <= HELD:
            held.append(part)
        else:
            held.clear()


#: What more bytes may mend.
_UNFINISHED = {"header without end", "block cut off", "no record end after the block"}
_LONGEST_HEAD = 1 << 20


def _inside(parts: Iterator[bytes], most: int) -> Iterator[tuple[dict | None, int, int, str]]:
    """Records of a member's bytes, which come in parts, and the gaps between them (no record): place, length, reason.

    Held are the bytes of one record, or of what looks like one; what is too long for one isn't waited for.
    """
    parts = iter(parts)
    held, base, at, gap, why, ended = bytearray(), 0, 0, None, "", False

    def more(n: int) -> None:
        """Have n bytes from here on, if there are as many."""
        nonlocal ended
        while not ended and len(held) - at < n:
            part = next(parts, None)
            if part is None:
                ended = True
            else:
                held.extend(part)

    while True:
        if at > 1 << 20:
            del held[:at]
            base, at = base + at, 0
        more(16)
        if at >= len(held):
            break
        found, end, reason = parse_record(held, at)
        while found is None and reason in _UNFINISHED and not ended and len(held) - at < (_LONGEST_HEAD if reason == "header without end" else most):
            more(2 * (len(held) - at))
            found, end, reason = parse_record(held, at)
        if found is None or end - at > most:
            gap, why = (base + at, reason or "record too long") if gap is None else (gap, why)
            more(1 << 16)
            at = p if (p := held.find(b"WARC/1.", at + 1)) >= 0 else max(at + 1, len(held) if ended else len(held) - 6)
            continue
        if gap is not None:
            yield None, gap, base + at - gap, why
            gap = None
        yield found | {"payload": bytes(found["payload"])}, base + at, end - at, ""
        at = end
    if gap is not None:
        yield None, gap, base + len(held) - gap, why


class _Marks:
    """The next gzip member's or version line's place; each mark is sought once over the whole file."""

    def __init__(self, data: bytes):
        self.data, self.next = data, {b"\x1f\x8b\x08": -1, b"WARC/1.": -1}

    def after(self, at: int) -> int:
        for mark, place in self.next.items():
            if place <= at and place != len(self.data):
                found = self.data.find(mark, at + 1)
                self.next[mark] = found if found >= 0 else len(self.data)
        return min(self.next.values())


def salvage(data: bytes, most_record: int = MOST_RECORD) -> Iterator[dict]:
    """Records of one archive, plain or gzip, and the byte gaps between them.

    After a failed check the search goes on from the next byte for a gzip member that holds a record, or for a version
    line; what lies between is one gap, with the first failure as its reason.  A member may hold many records, of which one is held at a
    time: what can't be read within it is a gap with an inner place.  Of a broken member the records before the break are kept if a digest confirms them.
    """
    gap, why, at, gaps, marks = None, "", 0, 0, _Marks(data)

    def lost(offset: int, length: int, reason: str, inner: tuple[int, int] | None = None) -> dict:
        nonlocal gaps
        gaps += 1
        where = {"inner_offset": inner[0], "inner_length": inner[1]} if inner else {}
        return {"kind": "gap", "offset": offset, "length": length, "reason": reason} | where

    def record(found: dict, place: int | None, length: int | None, end: int | None) -> dict:
        return {"kind": "record", "offset": at, "length": None if end is None else end - at, "inner_offset": place, "inner_length": length, "reason": None, "gaps_before": gaps} | found

    while at < len(data):
        end, reason = at, "neither a member nor a version line"
        if data[at : at + 3] == b"\x1f\x8b\x08":
            parts, stop, reason = _member(data, at)
            rows = _inside(_inflated(data, at) if parts is None else parts, most_record)
            # Gaps before the first record wait until there is one: without any the whole member is a gap.
            waiting, some, empty = [], False, True
            for found, place, length, bad in rows:
                empty = False
                if found is None or (stop is None and not found["checked"]):
                    if stop is not None and not some:
                        waiting.append((place, length, bad))
                    elif stop is not None:
                        yield lost(at, stop - at, bad, (place, length))
                    continue
                if not some:
                    some = True
                    if gap is not None:
                        yield lost(gap, at - gap, why)
                        gap = None
                    for x in waiting:
                        yield lost(at, stop - at, x[2], x[:2])
                yield record(found, place, length, stop)
            if stop is None:
                end = None
            elif some or empty:
                end = stop
                if gap is not None:
                    yield lost(gap, at - gap, why)
                    gap = None
            else:
                reason = waiting[0][2]
        elif data[at : at + 5] == b"WARC/":
            found, end, reason = parse_record(data, at)
            if found:
                if gap is not None:
                    yield lost(gap, at - gap, why)
                    gap = None
                yield record(found, None, None, end)
        if end is None or end == at:
            gap, why = (at, reason) if gap is None else (gap, why)
            end = marks.after(at)
        at = end
    if gap is not None:
        yield lost(gap, len(data) - gap, why)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind 'record' and, for each quarantined stretch of bytes, 'gap' (path, offset, length, reason).

    One file is one task's row, so archives should be of moderate size (write_warc() bounds its own by bytes); Spark
    takes files up to 2 GB.  Damaged and empty files never fail the job; records that repeat are each a row.  gaps_before says how
    many gaps stand before a record in its file, checked whether a digest confirms it.
    """
    columns = [c.split()[0] for c in RECORD_SCHEMA.split(",")]
    numbers = dict.fromkeys(["offset", "length", "inner_offset", "inner_length", "gaps_before", "payload_bytes"], "Int64")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, held = [], 0
                for r in salvage(bytes(content)):
                    held += len(r.get("payload") or b"") if payloads else 200
                    rows.append(r | {"path": name} | ({} if payloads else {"payload": None}))
                    if held > 8_000_000:
                        yield pd.DataFrame(rows, columns=columns).astype(numbers)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns).astype(numbers)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("path", "content").mapInPandas(parse, RECORD_SCHEMA)
