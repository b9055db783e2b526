"""Media columns as MPEG transport streams.

``mux`` stores a payload of 8-bit samples as a stream: program tables (PAT, PMT), and one elementary stream of PES
packets with presentation timestamps, random-access points and clock references.  ``demux`` parses any such stream:
it reads the program tables, checks the continuity counters, reassembles the elementary packets and gives each access
unit's timestamp, place and random-access mark, so that a reader can start anywhere.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0, 0x1000, 0x100, 1
PRIVATE_PES, PRIVATE_STREAM = 0x06, 0xBD
#: Samples of an access unit, units from one random-access point to the next, and the sampling rate.
UNIT, GROUP, RATE = 16_384, 4, 8_000
CLOCK = 90_000
#: A task's output batch is cut at so many bytes.
BATCH_BYTES = 8 << 20


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


_PAT = section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_PES, 0xE000 | DATA_PID, 0xF000))


def _table_packet(pid: int, counter: int, data: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | counter, 0) + data).ljust(PACKET, b"\xff")


def _pts(value: int) -> bytes:
    return bytes([0x21 | (value >> 29) & 0x0E, (value >> 22) & 0xFF, 0x01 | (value >> 14) & 0xFE, (value >> 7) & 0xFF, 0x01 | (value << 1) & 0xFE])


def _adaptation(size: int, pcr: int | None) -> bytes:
    """An adaptation field of ``size`` bytes in all."""
    if size == 1:
        return b"\x00"
    flags, clock = (0x50, struct.pack(">IH", pcr >> 1, (pcr & 1) << 15 | 0x7E00)) if pcr is not None else (0, b"")
    return (bytes([size - 1, flags]) + clock).ljust(size, b"\xff")


def mux(payload: bytes) -> bytes:
    """The payload's transport stream."""
    out, tables, counter = [], 0, 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        pts = at * CLOCK // RATE % (1 << 33)
        pcr = pts if n % GROUP == 0 else None
        if pcr is not None:
            out += [_table_packet(PAT_PID, tables % 16, _PAT), _table_packet(PMT_PID, tables % 16, _PMT)]
            tables += 1
        data = payload[at : at + UNIT]
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x80, 0x80, 5) + _pts(pts) + data
        least = 8 if pcr is not None else 0
        first = max(least, 184 - len(pes))
        out += [struct.pack(">BHB", SYNC, 0x4000 | DATA_PID, (0x30 if first else 0x10) | counter % 16), _adaptation(first, pcr) if first else b"", pes[: 184 - first]]
        counter += 1
        rest = pes[184 - first :]
        k = len(rest) // 184
        if k:
            packets = np.empty((k, PACKET), dtype=np.uint8)
            packets[:, :3] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(k)) % 16
            packets[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=184 * k).reshape(k, 184)
            out.append(packets.tobytes())
            counter += k
        if last := rest[184 * k :]:
            out += [struct.pack(">BHB", SYNC, DATA_PID, 0x30 | counter % 16), _adaptation(184 - len(last), None), last]
            counter += 1
    return b"".join(out)


def _section_of(packet: np.ndarray) -> bytes:
    at = 5 + packet[4] if packet[3] & 0x20 else 4
    data = packet[int(at) :].tobytes()
    data = data[1 + data[0] :]
    size = 3 + ((data[1] & 0x0F) << 8 | data[2])
    return data[:size] if size <= len(data) and crc_mpeg(data[:size]) == 0 else b""


def programs(packets: np.ndarray, pids: np.ndarray) -> dict[int, tuple[int, int]]:
    """Elementary PID -> (program, stream type), from the first good PAT and PMT packets."""
    starts = (packets[:, 1] & 0x40) > 0
    maps: dict[int, int] = {}
    for i in np.flatnonzero((pids == PAT_PID) & starts):
        if s := _section_of(packets[i]):
            maps = {(s[k + 2] & 0x1F) << 8 | s[k + 3]: s[k] << 8 | s[k + 1] for k in range(8, len(s) - 4, 4) if s[k] << 8 | s[k + 1]}
            break
    out: dict[int, tuple[int, int]] = {}
    for pid, program in maps.items():
        for i in np.flatnonzero((pids == pid) & starts):
            if s := _section_of(packets[i]):
                k = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while k < len(s) - 4:
                    out[(s[k + 1] & 0x1F) << 8 | s[k + 2]] = (program, s[k])
                    k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
                break
    return out


def demux(media: bytes) -> dict:
    """n_packets, lost_sync (packets without the sync byte, left out), cc_errors, and streams: for each elementary PID its
    program, type and units (pts or None, random access, payload).  A trailing part of a packet is left out; a packet
    sent twice counts once."""
    packets = np.frombuffer(media, dtype=np.uint8, count=len(media) // PACKET * PACKET).reshape(-1, PACKET)
    good = packets[:, 0] == SYNC
    lost = int(len(packets) - good.sum())
    packets = packets if not lost else packets[good]
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    out = {"n_packets": len(packets), "lost_sync": lost, "cc_errors": 0, "streams": []}
    for pid, (program, kind) in sorted(programs(packets, pids).items()):
        own = packets[(pids == pid) & (packets[:, 3] & 0x10 > 0)]
        if not len(own):
            continue
        step = np.diff((own[:, 3] & 0x0F).astype(np.int16)) % 16
        again = np.concatenate([[False], (step == 0) & (own[1:] == own[:-1]).all(axis=1)]) if (step == 0).any() else np.zeros(len(own), dtype=bool)
        out["cc_errors"] += int(((step != 1) & ~again[1:]).sum())
        own = own[~again]
        field = (own[:, 3] & 0x20) > 0
        start = np.where(field, 5 + own[:, 4].astype(np.int32), 4)
        access = field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        data = own[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
        ends = np.cumsum(np.maximum(0, PACKET - start))
        heads = np.flatnonzero(own[:, 1] & 0x40)
        units = []
        for i, j in zip(heads, [*heads[1:], len(own)], strict=True):
            pes = data[int(ends[i - 1]) if i else 0 : int(ends[j - 1])]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                continue
            pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | (pes[11] >> 1) << 15 | pes[12] << 7 | pes[13] >> 1 if pes[7] & 0x80 and len(pes) >= 14 else None
            size = pes[4] << 8 | pes[5]
            units.append((pts, bool(access[i]), pes[9 + pes[8] : 6 + size if size else None]))
        out["streams"].append((pid, program, kind, units))
    return out


def padded(text: Column) -> Column:
    """UTF-8 bytes of the text (null: empty), with zero bytes up to a positive multiple of 64."""
    data = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    size = F.greatest(F.lit(64), F.ceil(F.octet_length(data) / 64).cast("int") * 64)
    return F.rpad(data, size, F.lit(b"\x00"))


def store_streams(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """``df`` with the column ``payload`` (binary) replaced by its transport stream; null and empty payloads give empty ones.
    An input column named as the stream is replaced."""
    df = df.drop(media) if media != payload else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != payload) + f", `{media}` binary"
    names = [c for c in df.columns if c != payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, start, out, size = batch.column(payload), 0, [], 0
            for i in range(batch.num_rows):
                out.append(mux(column[i].as_py() or b""))
                size += len(out[-1])
                if size > BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(out, pa.binary())], names=[*names, media])
                    start, out, size = i + 1, [], 0

    return df.mapInArrow(run, schema)


UNITS = "array<struct<pid:int,program:int,stream_type:int,pts:bigint,random_access:boolean,start:bigint,size:int>>"


def read_streams(df: DataFrame, media: str = "media", payload: str = "payload") -> DataFrame:
    """Add n_packets, lost_sync, cc_errors, units (an array in stream order: PID, program, type, timestamp,
    random-access mark, place and size in the payload) and the payload: all units' bytes, by PID, put together.

    Null and empty media have no units and an empty payload; damaged ones what can be read, with the errors counted.  Input columns named as the added ones are replaced.
    """
    df = df.drop("n_packets", "lost_sync", "cc_errors", "units", payload)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", n_packets int, lost_sync int, cc_errors int, units {UNITS}, `{payload}` binary"
    kind = pa.list_(pa.struct([("pid", pa.int32()), ("program", pa.int32()), ("stream_type", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("start", pa.int64()), ("size", pa.int32())]))
    fields = [("n_packets", pa.int32()), ("lost_sync", pa.int32()), ("cc_errors", pa.int32()), ("units", kind), (payload, pa.binary())]

    def one(data: bytes) -> tuple:
        found, at, units, parts = demux(data), 0, [], []
        for pid, program, stream_type, own in found["streams"]:
            for pts, access, part in own:
                units.append({"pid": pid, "program": program, "stream_type": stream_type, "pts": pts, "random_access": access, "start": at, "size": len(part)})
                parts.append(part)
                at += len(part)
        return found["n_packets"], found["lost_sync"], found["cc_errors"], units, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, start, out, size = batch.column(media), 0, [], 0
            for i in range(batch.num_rows):
                out.append(one(column[i].as_py() or b""))
                size += len(out[-1][4])
                if size > BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(list(c), t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]], names=[*batch.schema.names, *[n for n, _ in fields]])
                    start, out, size = i + 1, [], 0

    return df.mapInArrow(run, schema)
