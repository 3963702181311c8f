"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a payload of 8-bit samples as one elementary stream of private
data: a program association table, a program map table, then access units in
packetised elementary packets with presentation timestamps; every eighth unit
is a random-access point and carries a clock reference. ``demux`` reads any
such stream back: it parses the program tables, checks their checksums and the
continuity counter of every packet, reassembles the elementary packets, and
gives their timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import slices

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x0100, 0x0101
PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 1, 0x06, 0xBD
#: 14 bytes of header and a unit fill 176 + 22 * 184 bytes, so that whole units need no stuffing.
UNIT = 4210
TICKS, RANDOM_ACCESS_EVERY, CLOCK = 3600, 8, 90_000
BLOCK = 64


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


def crc32_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2) + number.to_bytes(2) + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4)


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2) + b"\x10\x00" + section).ljust(PACKET, b"\xff")


@lru_cache(1)
def _tables() -> bytes:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2))
    stream = bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2) + (0xF000).to_bytes(2)
    pmt = _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2) + (0xF000).to_bytes(2) + stream)
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _timestamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _read_timestamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream of one program with one elementary stream."""
    out, counter = [_tables()], 0
    starts = range(0, len(payload), UNIT) if payload else ()
    for k, at in enumerate(starts):
        unit, pts = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2) + b"\x84\x80\x05" + _timestamp(2, pts) + unit
        if k % RANDOM_ACCESS_EVERY:
            extra = b"\x00" + b"\xff" * 6
        else:
            extra = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6)
        done, first = 0, True
        while done < len(pes):
            left = len(pes) - done
            field = extra if first else b""
            room = 183 - len(field) if field else 184
            if left < room:
                field = (field or b"\x00" * (left < 183)).ljust(183 - left, b"\xff")
                room = left
            adapted = bool(field) or room == 183
            out.append(bytes((SYNC, 0x40 * first | ES_PID >> 8, ES_PID & 0xFF, (0x30 if adapted else 0x10) | counter)))
            if adapted:
                out.append(bytes((len(field),)) + field)
            out.append(pes[done : done + room])
            done, first, counter = done + room, False, counter + 1 & 15
    return b"".join(out)


class Stream:
    """What a transport stream holds: programs, elementary streams, packets and errors."""

    def __init__(self, data: bytes):
        self.packets = self.discontinuities = self.bad = self.duplicates = self.bad_tables = 0
        self.programs: dict[int, int] = {}
        self.kinds: dict[int, int] = {}
        #: (pid, pts or None, random access, start in the stream's bytes, length) of each elementary packet
        self.units: list[tuple[int, int | None, bool, int, int]] = []
        self.bytes: dict[int, bytearray] = {}
        self._open: dict[int, tuple[list[bytes], bool]] = {}
        self._last: dict[int, tuple[int, bytes]] = {}
        for at in range(0, len(data) - PACKET + 1, PACKET):
            self._packet(data[at : at + PACKET])
        self.bad += len(data) % PACKET > 0
        for pid in list(self._open):
            self._close(pid)

    def _packet(self, p: bytes) -> None:
        self.packets += 1
        if p[0] != SYNC or p[1] & 0x80:
            self.bad += 1
            return
        pid, control, count = (p[1] & 0x1F) << 8 | p[2], p[3] >> 4 & 3, p[3] & 15
        start, access, broken = 4, False, False
        if control & 2:
            start = 5 + p[4]
            if p[4]:
                access, broken = bool(p[5] & 0x40), bool(p[5] & 0x80)
        if not control & 1 or pid == 0x1FFF:
            return
        last = self._last.get(pid)
        if last is not None and not broken:
            if count == last[0] and p[4:] == last[1]:
                self.duplicates += 1
                return
            self.discontinuities += count != last[0] + 1 & 15
        self._last[pid] = (count, p[4:])
        body, begins = p[start:], bool(p[1] & 0x40)
        if pid == PAT_PID or pid in self.programs:
            if begins and body:
                self._table(pid, body[1 + body[0] :])
        elif pid in self.kinds:
            if begins:
                self._close(pid)
                self._open[pid] = ([body], access)
            elif pid in self._open:
                self._open[pid][0].append(body)

    def _table(self, pid: int, s: bytes) -> None:
        size = 3 + ((s[1] & 0x0F) << 8 | s[2])
        if size > len(s) or crc32_mpeg(s[:size]):
            self.bad_tables += 1
            return
        if s[0] == 0x00:
            for k in range(8, size - 4, 4):
                if number := int.from_bytes(s[k : k + 2]):
                    self.programs[int.from_bytes(s[k + 2 : k + 4]) & 0x1FFF] = number
        elif s[0] == 0x02:
            k = 12 + (int.from_bytes(s[10:12]) & 0x0FFF)
            while k < size - 4:
                self.kinds[int.from_bytes(s[k + 1 : k + 3]) & 0x1FFF] = s[k]
                k += 5 + (int.from_bytes(s[k + 3 : k + 5]) & 0x0FFF)

    def _close(self, pid: int) -> None:
        if pid not in self._open:
            return
        parts, access = self._open.pop(pid)
        pes = b"".join(parts)
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            self.bad += 1
            return
        size, head = int.from_bytes(pes[4:6]), 9 + pes[8]
        end = 6 + size if size else len(pes)
        self.bad += end > len(pes)
        pts = _read_timestamp(pes[9:14]) if pes[7] & 0x80 else None
        own = self.bytes.setdefault(pid, bytearray())
        self.units.append((pid, pts, access, len(own), end - head))
        own += pes[head:end]

    def features(self) -> str:
        """A short account of the stream; equal streams have equal ones."""
        stamps = [u[1] for u in self.units if u[1] is not None]
        span = f"{stamps[0]}-{stamps[-1]}" if stamps else "none"
        return (
            f"packets={self.packets};programs={len(self.programs)};streams={len(self.kinds)};units={len(self.units)};random_access={sum(u[2] for u in self.units)};"
            f"pts={span};seconds={(stamps[-1] - stamps[0]) / CLOCK if stamps else 0:.3f};discontinuities={self.discontinuities};duplicates={self.duplicates};bad={self.bad + self.bad_tables}"
        )


def pad(data: bytes) -> bytes:
    """Zero bytes appended up to the next positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_bytes`` and ``media``: each whole text as UTF-8, padded with zero bytes, as a transport stream.

    Null texts count as empty and give one block of zeros. Every row is kept; columns of these names are
    replaced, all others kept. An empty table gives an empty one.
    """
    docs = docs.drop("n_bytes", "media")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType(), False), T.StructField("media", T.BinaryType(), False)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                raw = [t or b"" for t in part.column(at).cast(pa.binary() if part.column(at).type == pa.string() else pa.large_binary()).to_pylist()]
                new = [pa.array([len(t) for t in raw], pa.int64()), pa.array([mux(pad(t)) for t in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "n_bytes", "media"])

    return docs.mapInArrow(run, schema)


UNIT_TYPE = "array<struct<pid:int,pts:bigint,random_access:boolean,start:bigint,length:bigint>>"


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add what each stored stream holds: ``payload`` (bytes of its first elementary stream), ``units`` and ``feature``.

    ``units`` has pid, presentation timestamp, random-access flag, start and length of every elementary packet.
    A null stream is read as an empty one. Damaged streams are read as far as they go; ``feature`` counts the damage.
    """
    df = df.drop("payload", "units", "feature")
    added = T.StructType([T.StructField("payload", T.BinaryType(), False), T.StructField("units", T._parse_datatype_string(UNIT_TYPE), False), T.StructField("feature", T.StringType(), False)])
    schema = T.StructType([*df.schema.fields, *added.fields])
    at = df.columns.index(media_col)
    unit = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                read = [Stream(m or b"") for m in part.column(at).to_pylist()]
                rows = [[dict(zip(("pid", "pts", "random_access", "start", "length"), u)) for u in s.units] for s in read]
                new = [pa.array([bytes(next(iter(s.bytes.values()), b"")) for s in read], pa.binary()), pa.array(rows, pa.list_(unit)), pa.array([s.features() for s in read], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "payload", "units", "feature"])

    return df.mapInArrow(run, schema)


def digests(payload: bytes) -> tuple[str, int]:
    """SHA-256 of a payload and CRC-32 of its last block, for tests."""
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:])
