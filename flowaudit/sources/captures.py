"""Packet captures: pcap and pcapng files read in splits, and header decoding in batches."""
from __future__ import annotations

import gzip
import io
import ipaddress
import struct
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import checkpoint

# Link types and the bytes before the network header.
LINK_BYTES = {0: 4, 1: 14, 12: 0, 101: 0, 113: 16, 228: 0, 229: 0, 276: 20}
ETHERTYPE_IPV4, ETHERTYPE_IPV6, ETHERTYPE_VLAN = 0x0800, 0x86DD, 0x8100
IPV6_EXTENSIONS = [0, 43, 51, 60]
PACKET_SCHEMA = "file string, seq long, ts double, datalink int, frame_len int, frame binary"
BATCH_BYTES = 8 << 20


def check_datalink(link: int, name: str) -> None:
    if link not in LINK_BYTES:
        raise ValueError(f"{name}: unsupported datalink type {link}")


def _records(fh, name: str) -> Iterator[tuple[float | None, int, bytes]]:
    """(time, link type, frame) of one capture, read forward once."""
    head = fh.read(4)
    if head == b"\x0a\x0d\x0d\x0a":
        yield from _pcapng(fh, name)
        return
    formats = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
    if head not in formats:
        raise ValueError(f"{name}: neither pcap nor pcapng")
    end, div = formats[head]
    link = struct.unpack(end + "I", fh.read(20)[16:])[0] & 0x0FFFFFFF
    check_datalink(link, name)
    rec = struct.Struct(end + "IIII")
    while len(h := fh.read(16)) == 16:
        sec, sub, incl, _ = rec.unpack(h)
        frame = fh.read(incl)                                # a cut last record counts with what is there
        yield sec + sub / div, link, frame


def _pcapng(fh, name: str) -> Iterator[tuple[float | None, int, bytes]]:
    """Enhanced, simple and old packet blocks; each interface has its link type, time unit and snap length.

    A simple block has no time: its packet has a null one and is skipped as untimed later.
    """
    end, first, faces = "<", True, []
    while True:
        kind = b"\x0a\x0d\x0d\x0a" if first else fh.read(4)
        first = False
        size = fh.read(4)
        if len(kind) < 4 or len(size) < 4:
            return
        if kind == b"\x0a\x0d\x0d\x0a":
            magic = fh.read(4)
            end = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
            fh.read(struct.unpack(end + "I", size)[0] - 12)
            faces = []
            continue
        body = fh.read(struct.unpack(end + "I", size)[0] - 8)[:-4]
        kind_no = struct.unpack(end + "I", kind)[0]
        if kind_no == 1:
            link, unit, pos = struct.unpack_from(end + "H", body)[0], 1e6, 8
            while pos + 4 <= len(body):
                code, n = struct.unpack_from(end + "HH", body, pos)
                if code == 9 and n >= 1:
                    v = body[pos + 4]
                    unit = 2.0 ** (v & 0x7F) if v & 0x80 else 10.0 ** v
                if code == 0:
                    break
                pos += 4 + (n + 3) // 4 * 4
            check_datalink(link, name)
            faces.append((link, unit, struct.unpack_from(end + "I", body, 4)[0]))
        elif kind_no in (2, 3, 6):
            try:
                if kind_no == 3:
                    link, _, snap = faces[0]
                    cap = struct.unpack_from(end + "I", body)[0]
                    yield None, link, body[4:4 + (min(cap, snap) if snap else cap)]
                    continue
                layout = "IIIII" if kind_no == 6 else "HHIIII"
                i, *rest = struct.unpack_from(end + layout, body)
                hi, lo, cap, _ = rest[-4:]
                link, unit, _ = faces[i]
            except (struct.error, IndexError) as e:
                raise ValueError(f"{name}: unreadable packet block of type {kind_no}") from e
            yield ((hi << 32) | lo) / unit, link, body[20:20 + cap]


# ------------------------------------------------------------------ splits
_UINT = {"<": "<u4", ">": ">u4"}
SECTION = 0x0A0D0D0A
#: Bytes at the front of a split in which its first record is sought; the longest frame that counts as one.
PROBE, LONGEST = 1 << 20, 1 << 18


def _front(buf: bytes) -> tuple[str, str, int] | None:
    """(format, byte order, first record) of a file by its first bytes."""
    if buf[:4] == b"\x0a\x0d\x0d\x0a":
        return "pcapng", "<" if buf[8:12] == b"\x4d\x3c\x2b\x1a" else ">", 0
    if buf[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1"):
        return "pcap", "<", 24
    if buf[:4] in (b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
        return "pcap", ">", 24
    return None


def record_size(buf: bytes, pos: int, kind: str, end: str) -> int:
    """Bytes of the record or block at `pos`; 0 where its header is cut."""
    if kind == "pcap":
        return 16 + struct.unpack_from(end + "I", buf, pos + 8)[0] if pos + 16 <= len(buf) else 0
    if buf[pos:pos + 4] == b"\x0a\x0d\x0d\x0a":
        end = "<" if buf[pos + 8:pos + 12] == b"\x4d\x3c\x2b\x1a" else ">"
    return max(12, struct.unpack_from(end + "I", buf, pos + 4)[0]) if pos + 12 <= len(buf) else 0


def walk(buf: bytes, pos: int, kind: str, end: str) -> tuple[int, int, bytes]:
    """(packets, where the first record that is not whole begins, section and interface blocks) from a record's start on."""
    n, about = 0, []
    while (size := record_size(buf, pos, kind, end)) and pos + size <= len(buf):
        if kind == "pcapng":
            if buf[pos:pos + 4] == b"\x0a\x0d\x0d\x0a":
                end, about = "<" if buf[pos + 8:pos + 12] == b"\x4d\x3c\x2b\x1a" else ">", []
                about.append(buf[pos:pos + size])
            else:
                no = struct.unpack_from(end + "I", buf, pos)[0]
                if no == 1:
                    about.append(buf[pos:pos + size])
                n += no in (2, 3, 6)
        else:
            n += 1
        pos += size
    return n, pos, b"".join(about)


def first_record(buf: bytes, kind: str, end: str) -> int | None:
    """The first place from which plausible records follow each other to the end of the probe."""
    raw = np.frombuffer(buf[:PROBE], np.uint8)
    m = len(raw) - 16
    if m <= 0:
        return None
    at = lambda k: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 4)[k:k + m]).view(_UINT[end]).ravel().astype(np.int64)
    place = np.arange(m)
    if kind == "pcap":
        kept, told = at(8), at(12)
        good = (at(4) < 10 ** 9) & (kept >= 1) & (kept <= told) & (kept <= LONGEST) & (told <= 1 << 24)
        to = place + 16 + kept
    else:
        size = at(4)
        good = ((at(0) <= 16) | (at(0) == SECTION)) & (size >= 12) & (size <= LONGEST + 256) & (size % 4 == 0)
        to = place + size
        inside = np.flatnonzero(good & (to <= len(raw)))
        good[inside] = [buf[t - 4:t] == buf[p + 4:p + 8] for p, t in zip(inside.tolist(), to[inside].tolist())]
    to = np.where(good, np.minimum(to, m), m)
    good, to = np.append(good, True), np.append(to, m)
    while True:                                              # follow all chains at once, doubling the steps
        ahead = good & good[to]
        if (ahead == good).all() and (to == m)[good].all():
            break
        good, to = ahead, to[to]
    found = np.flatnonzero(good[:m])
    return int(found[0]) if len(found) else None


_INDEX = pa.schema([("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("whole", pa.binary()), ("guess", pa.int32()),
                    ("kind", pa.string()), ("end", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("prefix", pa.binary()), ("tail", pa.binary()), ("about", pa.binary())])
_INDEX_DDL = ("path string, block long, size long, bytes long, whole binary, guess int, kind string, end string, start long, n long, prefix binary, tail binary, about binary")
_PLAN = pa.schema([("path", pa.string()), ("block", pa.int64()), ("what", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("seq", pa.int64()), ("head", pa.binary()),
                   ("record", pa.binary())])
_PLAN_DDL = "path string, block long, what string, start long, stop long, seq long, head binary, record binary"


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(path, block, file size, bytes) of each split, from the pieces between line feeds in their order."""
    def runs():
        for b in batches:
            for key, rows in groupby(zip(*(c.to_pylist() for c in b.columns)), key=lambda r: r[:3]):
                yield key, b"".join([r[3] + b"\n" for r in rows])
    for (path, block, size), parts in groupby(runs(), key=lambda r: r[0]):
        yield path, block, size, b"".join([p for _, p in parts])


def _index(given: dict[tuple[str, int], tuple[int, str, str]]):
    """Where the records of a split begin, if nothing is known: a guess for each format. `given` places are not guessed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, size, buf in _splits(batches):
            if given and (path, block) not in given:
                continue
            if given:
                places = [given[path, block]]
            elif block == 0:
                if (known := _front(buf)) is None:
                    raise ValueError(f"{path}: neither pcap nor pcapng")
                places = [(known[2], known[0], known[1])]
            else:
                places = [(p, k, e) for k in ("pcap", "pcapng") for e in "<>" if (p := first_record(buf, k, e)) is not None]
            rows = [(path, block, size, len(buf), buf if len(buf) <= PROBE else buf[:16], -1, *[None] * 7)]
            for i, (start, kind, end) in enumerate(places):
                n, stop, about = walk(buf, start, kind, end)
                if len(buf) - stop <= 2 * LONGEST or block == 0 or given:
                    rows.append((path, block, size, len(buf), None, i, kind, end, start, n, buf[:start], buf[stop:], about))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX.types)], schema=_INDEX)
    return run


def _plan(index: pa.Table) -> pa.Table:
    """Chain the splits of one file: a split counts if it begins where the record before it ends."""
    splits: dict[int, list[dict]] = {}
    for r in index.to_pylist():
        splits.setdefault(r["block"], []).append(r)
    out, seq, tail, head, kind, end = [], 0, b"", b"", None, None
    path, left = index["path"][0].as_py(), index["size"][0].as_py()
    for block in sorted(splits):
        about = next(r for r in splits[block] if r["guess"] < 0)
        guesses = [r for r in splits[block] if r["guess"] >= 0]
        size, left = min(about["bytes"], left), left - about["bytes"]      # the last piece of a file ends without a line feed, or with one of its own
        over = about["bytes"] - size
        if block == 0:
            here = guesses[0]
            kind, end = here["kind"], here["end"]
            head = here["prefix"] if kind == "pcap" else b""
        else:
            need = 0
            if tail:
                whole = tail + about["whole"]
                need = record_size(whole, 0, kind, end) - len(tail)
            if need < 0 or need >= size:                                   # the record goes on behind this split
                if size > len(about["whole"]):
                    raise ValueError(f"{path}: no record of a sensible length at byte {block}")
                tail += about["whole"][:size]
                continue
            here = next((r for r in guesses if (r["start"], r["kind"], r["end"]) == (need, kind, end)), None)
            if here is None and size <= len(about["whole"]):               # a small split is at hand
                buf = about["whole"][:size]
                n, stop, more = walk(buf, need, kind, end)
                here = {"start": need, "n": n, "prefix": buf[:need], "tail": buf[stop:] + b"\n" * over, "about": more}
            if here is None:
                out.append((path, block, "again", need, None, None, kind.encode() + end.encode(), None))
                break
            if tail:
                record = tail + here["prefix"]
                n, _, more = walk(record, 0, kind, end)
                head = more if more[:4] == b"\x0a\x0d\x0d\x0a" else head + more
                if n:
                    out.append((path, block, "record", None, None, seq, head, record))
                    seq += 1
        tail = here["tail"][:len(here["tail"]) - over] if over else here["tail"]
        out.append((path, block, "split", here["start"], size - len(tail), seq, head, None))
        seq += here["n"]
        head = here["about"] if here["about"][:4] == b"\x0a\x0d\x0d\x0a" else head + here["about"]
        end = end if kind == "pcap" or not head else _front(head)[1]
    else:
        if kind == "pcap" and len(tail) >= 16:                             # a cut last record counts with what is there
            out.append((path, -1, "record", None, None, seq, head, tail))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PLAN.types)], schema=_PLAN) if out else _PLAN.empty_table()


def _batches(records: Iterator[tuple], name: str, seq: int) -> Iterator[pa.RecordBatch]:
    names = ["file", "seq", "ts", "datalink", "frame_len", "frame"]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]

    def flush(rows: list) -> pa.RecordBatch:
        n = len(rows)
        cols = [[name] * n, list(range(seq, seq + n)), [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [r[2] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows, size = [], 0
    for r in records:
        rows.append(r)
        size += len(r[2])
        if size >= BATCH_BYTES or len(rows) >= 20_000:
            yield flush(rows)
            seq, rows, size = seq + len(rows), [], 0
    if rows:
        yield flush(rows)


def _from_splits(plan: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, _, buf in _splits(batches):
            if (path, block) in plan.value:
                start, stop, seq, head = plan.value[path, block]
                yield from _batches(_records(io.BytesIO(head + buf[start:stop]), path), path, seq)
    return run


def _from_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            yield from _batches(_records(io.BytesIO(r["head"] + r["record"]), r["path"]), r["path"], r["seq"])


def _from_zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(*(c.to_pylist() for c in b.columns)):
            yield from _batches(_records(gzip.GzipFile(fileobj=io.BytesIO(content)), path), path, 0)


def scan_packets(spark: SparkSession, path: str) -> DataFrame:
    """S10. Packets of every capture under a path of any file system that Spark reads; the link type is read, never guessed.

    Captures are cut like any splittable file (`spark.sql.files.maxPartitionBytes`): Spark's
    reader of text hands out the raw bytes between line feeds, in order, with the split they are
    from. Records have no mark, so a first pass finds in each split a place from which plausible
    records follow each other, counts them, and keeps the cut ones at both ends. The splits of a
    file are then chained: each must begin where the record before it ends, else it is walked
    again from that place. A second pass reads the packets of each split; a record across splits
    is put together from its ends. One line of numbers for each split goes to the driver and
    back to the tasks, as many as Spark's own plan of the scan has. A task holds one split.
    Captures in gzip cannot be cut and are one task each.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    one = fs.exists(where) and fs.getFileStatus(where).isFile()
    root = fs.makeQualified(where.getParent() if one else where).toUri().getRawPath().rstrip("/")
    ends = "{pcap,pcapng,cap}"

    def files(kind: str, names: str):
        r = spark.read.option("recursiveFileLookup", "true").format(kind)
        return r if one else r.option("pathGlobFilter", names)

    zipped = path.endswith(".gz")
    names = ["path", "block", "size", "piece"]
    if not (one and zipped):
        m = F.col("_metadata")
        lines = files("text", f"*.{ends}").option("lineSep", "\n").load(path) \
            .select(m["file_path"].alias("path"), m["file_block_start"].alias("block"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("piece"))
        index, given = checkpoint(lines.select(*names).mapInArrow(_index({}), _INDEX_DDL)), {}
        while True:
            plan = checkpoint(index.groupBy("path").applyInArrow(_plan, _PLAN_DDL))
            again = plan.filter("what = 'again'").collect()
            if not again:
                break
            given = {(r.path, r.block): (r.start, bytes(r.head[:-1]).decode(), bytes(r.head[-1:]).decode()) for r in again}
            redone = spark.createDataFrame([k for k in given], "path string, block long")
            first = index.filter("guess < 0").join(redone, ["path", "block"], "left_semi")
            index = checkpoint(index.join(redone, ["path", "block"], "left_anti").unionByName(first)
                               .unionByName(lines.select(*names).mapInArrow(_index(given), _INDEX_DDL).filter("guess >= 0")))
        at = {(r.path, r.block): (r.start, r.stop, r.seq, bytes(r.head)) for r in plan.filter("what = 'split'").drop("record").collect()}
        cut = lines.select(*names).mapInArrow(_from_splits(spark.sparkContext.broadcast(at)), PACKET_SCHEMA)
        out = cut.unionByName(plan.filter("what = 'record'").mapInArrow(_from_records, PACKET_SCHEMA))
    if not one or zipped:
        content = files("binaryFile", f"*.{ends}.gz").load(path).select("path", "content")
        whole = content.mapInArrow(_from_zipped, PACKET_SCHEMA)
        if not one and not at and content.select("path").isEmpty():
            raise FileNotFoundError(f"no captures under {path!r}")
        out = whole if one else out.unionByName(whole)
    # the name under the folder, so that equal names in two folders stay apart
    name = F.url_decode(F.replace(F.regexp_extract("file", "^(?:[a-zA-Z0-9+.-]+:(?://[^/]*)?)?(/.*)$", 1), F.lit("+"), F.lit("%2B")))
    return out.withColumn("file", F.substring(name, len(unquote(root)) + 2, 1 << 20))


# ------------------------------------------------------------------ headers
_DECODED = [("file", pa.string()), ("seq", pa.int64()), ("ts", pa.float64()), ("datalink", pa.int32()), ("frame_len", pa.int32()), ("skip", pa.string()),
            ("version", pa.int32()), ("src4", pa.int64()), ("dst4", pa.int64()), ("src6", pa.string()), ("dst6", pa.string()), ("sport", pa.int32()), ("dport", pa.int32()),
            ("proto", pa.int32()), ("ttl", pa.int32()), ("ip_id", pa.int32()), ("ip_len", pa.int32()), ("payload_len", pa.int32()), ("flags", pa.int32())]
_DECODED_DDL = ("file string, seq long, ts double, datalink int, frame_len int, skip string, version int, src4 long, dst4 long, src6 string, dst6 string, "
                "sport int, dport int, proto int, ttl int, ip_id int, ip_len int, payload_len int, flags int")


def decode_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All header fields of a batch by index arithmetic on its frame buffer."""
    frames = batch.column("frame").cast(pa.large_binary())
    n = len(frames)
    offs = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset:frames.offset + n + 1]
    raw = frames.buffers()[2]
    buf = np.concatenate([np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), np.zeros(64, np.uint8)])
    start, size = offs[:-1], np.diff(offs)
    link = batch.column("datalink").to_numpy(zero_copy_only=False)
    for v in np.unique(link):
        check_datalink(int(v), "packet table")

    def u8(p):
        return buf[np.minimum(p, len(buf) - 1)].astype(np.int64)

    def u16(p):
        return (u8(p) << 8) | u8(p + 1)

    def u32(p):
        return (u16(p) << 16) | u16(p + 2)
    hdr = np.array([LINK_BYTES[int(v)] for v in link], np.int64) if n else np.zeros(0, np.int64)
    vlan = (link == 1) & (u16(start + 12) == ETHERTYPE_VLAN)
    hdr = hdr + np.where(vlan, 4, 0)
    eth = np.select([link == 1, link == 113, link == 276], [u16(start + hdr - 2), u16(start + 14), u16(start)], -1)
    short = size <= hdr
    ip = start + hdr
    ver = u8(ip) >> 4
    four = ~short & (ver == 4) & np.isin(eth, [-1, ETHERTYPE_IPV4])
    six = ~short & (ver == 6) & np.isin(eth, [-1, ETHERTYPE_IPV6])
    cap = size - hdr
    ihl = np.where(four, (u8(ip) & 15) * 4, 40)
    cut = (four & ((cap < 20) | (ihl < 20) | (cap < ihl))) | (six & (cap < 40))
    skip = np.where(short, "link", np.where(~(four | six), "not_ip", np.where(cut, "truncated", "")))
    skip = np.where((skip == "") & batch.column("ts").is_null().to_numpy(zero_copy_only=False), "untimed", skip)
    ok = skip == ""
    told = np.where(four, u16(ip + 2), 40 + u16(ip + 4))
    ip_len = np.where(told > 0, np.minimum(told, cap), cap)
    proto = np.where(four, u8(ip + 9), u8(ip + 6))
    l4, nxt = ip + ihl, proto.copy()
    while True:                                              # IPv6 extension headers, each at least 8 bytes on
        ext = six & np.isin(nxt, IPV6_EXTENSIONS) & (l4 + 8 <= ip + cap)
        if not ext.any():
            break
        step = np.where(nxt == 51, (u8(l4 + 1) + 2) * 4, (u8(l4 + 1) + 1) * 8)
        nxt, l4 = np.where(ext, u8(l4), nxt), np.where(ext, l4 + step, l4)
    body = np.maximum(ip_len - (l4 - ip), 0)
    frag = four & ((u16(ip + 6) & 0x1FFF) > 0)
    tcp = ok & (nxt == 6) & ~frag & (body >= 20)
    udp = ok & (nxt == 17) & ~frag & (body >= 8)
    ports = tcp | udp
    payload = np.where(tcp, np.maximum(body - (u8(l4 + 12) >> 4) * 4, 0), np.where(udp, body - 8, body))

    def text6(p):
        out = np.full(n, None, object)
        for i in np.flatnonzero(six & ok):
            out[i] = str(ipaddress.IPv6Address(bytes(buf[p[i]:p[i] + 16])))
        return out
    cols = {"file": batch.column("file"), "seq": batch.column("seq"), "ts": batch.column("ts"), "datalink": batch.column("datalink"), "frame_len": size,
            "skip": np.where(ok, None, skip), "version": ver, "src4": np.where(four, u32(ip + 12), 0), "dst4": np.where(four, u32(ip + 16), 0),
            "src6": text6(ip + 8), "dst6": text6(ip + 24), "sport": np.where(ports, u16(l4), 0), "dport": np.where(ports, u16(l4 + 2), 0), "proto": proto,
            "ttl": np.where(four, u8(ip + 8), u8(ip + 7)), "ip_id": np.where(four, u16(ip + 4), 0), "ip_len": ip_len, "payload_len": payload,
            "flags": np.where(tcp, u8(l4 + 13), 0)}
    return pa.RecordBatch.from_arrays([cols[k] if isinstance(cols[k], pa.Array) else pa.array(cols[k], t) for k, t in _DECODED], [k for k, _ in _DECODED])


def decode_headers(packets: DataFrame) -> DataFrame:
    """S11. Packet columns with `skip`, the reason a record has none. Frames do not pass on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield decode_batch(b)
    d = packets.mapInArrow(run, _DECODED_DDL)
    addr = lambda v: F.coalesce(F.col(f"{v}6"), S.ipv4_text(f"{v}4"))      # noqa: E731
    return d.withColumn("src", addr("src")).withColumn("dst", addr("dst")).drop("src4", "dst4", "src6", "dst6")


def parsed(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("skip").isNull()).drop("skip", "version")


def coverage(decoded: DataFrame, keys: list[str] = ("file",)) -> DataFrame:
    """S11. Records, parsed records and skipped ones by reason."""
    s = F.col("skip")
    g = decoded.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.count_if(s.isNull()).alias("parsed"),
                                   *[F.count_if(s == r).alias(f"skipped_{r}") for r in ("link", "not_ip", "truncated", "untimed")])
    return g.withColumn("coverage", F.col("parsed") / F.col("records"))


def mac_columns(packets: DataFrame) -> DataFrame:
    """A58. Hardware addresses of Ethernet frames."""
    def mac(pos: int):
        return F.when(F.col("datalink") == 1, F.lower(F.regexp_replace(F.hex(F.substring("frame", pos, 6)), "(..)(?!$)", "$1:")))
    return packets.withColumn("eth_dst", mac(1)).withColumn("eth_src", mac(7))
