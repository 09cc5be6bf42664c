"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

parse() reads a stream: the program association and map tables with their checksums, also over several packets, the continuity counter of every packet
identifier, the packets of the elementary stream put together again, and its timestamps with the random-access points. Bytes before the
first sync byte and packets that are no packets are skipped and counted.

write() stores a payload as such a stream, in 8-bit units without loss: one program with one private elementary stream, an access unit
per ``unit`` bytes, each a PES packet with its presentation time and a clock reference, the first of every ``GROUP`` a random-access point;
adaptation fields fill the last packet of a unit.

described() keeps of each stream an array with the time, the offset in the payload and the random-access flag of every unit.

stored() applies both to every text: a null text is an empty one; zero bytes are appended up to a positive multiple of 64. Equal
texts give equal values; every row gives a row, also repeated ones; an empty table gives an empty result. Other columns are not read.
Tasks hold one text and its stream at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Out, rows_of, run, table

#: Fixed values of the standard.
PACKET, SYNC, PAT_PID, NULL_PID, PRIVATE_STREAM, PRIVATE_TYPE = 188, 0x47, 0, 0x1FFF, 0xBD, 0x06
#: Free choices of this writer.
PMT_PID, MEDIA_PID, PROGRAM, TICKS = 0x100, 0x101, 1, 3600
UNIT, GROUP = 32768, 4


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(ticks: int) -> bytes:
    """A 33-bit time, as PES headers write it."""
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 255, 1 | (t >> 14) & 0xFE, t >> 7 & 255, 1 | (t << 1) & 0xFE])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def write(payload: bytes, unit: int = UNIT) -> bytes:
    """``payload`` as a transport stream."""
    out, counter = [_TABLES], 0
    for i, begin in enumerate(range(0, len(payload), unit)):
        piece = payload[begin : begin + unit]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(piece) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(i * TICKS) + piece
        clock = (i * TICKS & 0x1FFFFFFFF).to_bytes(5, "big")
        clock = ((int.from_bytes(clock, "big") << 15) | 0x7E00).to_bytes(6, "big")
        flags = 0x10 if i % GROUP else 0x50  # a clock reference; random access
        room = PACKET - 12  # the first packet's: 4 bytes of header, 8 of adaptation with the clock
        n = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
        frame = np.full((n, PACKET), 0xFF, np.uint8)
        frame[:, 0], frame[:, 1], frame[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
        frame[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        frame[0, 1] |= 0x40
        data = np.frombuffer(pes, np.uint8)
        if n == 1:
            fill = room - len(pes)
            frame[0, 3] |= 0x20
            frame[0, 4], frame[0, 5] = 7 + fill, flags
            frame[0, 6:12] = np.frombuffer(clock, np.uint8)
            frame[0, 12 + fill :] = data
        else:
            frame[0, 3] |= 0x20
            frame[0, 4], frame[0, 5] = 7, flags
            frame[0, 6:12] = np.frombuffer(clock, np.uint8)
            frame[0, 12:] = data[:room]
            whole = (len(pes) - room) // (PACKET - 4)
            frame[1 : 1 + whole, 4:] = data[room : room + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
            if whole < n - 1:
                rest = data[room + whole * (PACKET - 4) :]
                frame[-1, 3] |= 0x20
                frame[-1, 4] = PACKET - 5 - len(rest)
                if frame[-1, 4]:
                    frame[-1, 5] = 0
                frame[-1, PACKET - len(rest) :] = rest
        out.append(frame.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What parse() finds."""

    packets: int = 0
    skipped_bytes: int = 0
    table_errors: int = 0
    continuity_errors: int = 0
    transport_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number: PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID: stream type
    units: list[bytes] = field(default_factory=list)
    times: list[int | None] = field(default_factory=list)  # presentation time of each unit, in ticks of 90 kHz
    random_access: list[bool] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(self.units)


def _sections(packets: Iterable[tuple[bool, bytes]], table_id: int, found: Stream) -> Iterator[bytes]:
    """The bodies of the sections with sound checksums in a table's packets (whether a section starts there, payload), over packet ends."""
    held: bytes | None = None

    def whole(upto_start: bool) -> Iterator[bytes]:
        nonlocal held
        while held and held[0] != 0xFF:
            end = 3 + ((held[1] & 0x0F) << 8 | held[2]) if len(held) >= 3 else 4096
            if end > len(held) and not upto_start:
                return
            section, held = held[:end], held[end:]
            if len(section) < end or crc32_mpeg(section):
                found.table_errors += 1
                break
            if section[0] == table_id:
                yield section[8:-4]
        held = None

    for starts, data in packets:
        if starts and data:
            if held is not None:
                held += data[1 : 1 + data[0]]
                yield from whole(True)
            held = data[1 + data[0] :]
        elif held is not None:
            held += data
        yield from whole(False)
    if held is not None:
        yield from whole(True)


def parse(media: bytes, pid: int | None = None) -> Stream:
    """Read a transport stream. ``pid``: the elementary stream to put together; by default the first of the first program."""
    found, n = Stream(), len(media)
    rows, at = [], 0
    while at + PACKET <= n:
        if media[at] == SYNC and (at + PACKET >= n or media[at + PACKET] == SYNC):
            # a run of packets: as far as each begins with a sync byte
            run = np.frombuffer(media, np.uint8, count=(n - at) // PACKET * PACKET, offset=at).reshape(-1, PACKET)
            bad = np.flatnonzero(run[:, 0] != SYNC)
            run = run[: bad[0]] if len(bad) else run
            rows.append(run)
            at += len(run) * PACKET
        else:
            step = media.find(b"\x47", at + 1)
            step = n if step < 0 else step
            found.skipped_bytes += step - at
            at = step
    found.skipped_bytes += max(0, n - at)
    p = np.concatenate(rows) if rows else np.zeros((0, PACKET), np.uint8)
    found.packets = len(p)
    bad = p[:, 1] & 0x80 != 0
    found.transport_errors = int(bad.sum())
    p = p[~bad]
    pids = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    adapted, filled = p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0
    begins = np.where(adapted, 5 + p[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (p[:, 4] > 0), p[:, 5], 0)

    for x in np.unique(pids):
        if x != NULL_PID:
            mine = np.flatnonzero(pids == x)
            counters, moves = p[mine, 3] & 15, filled[mine]
            # a counter moves with each payload; one repeated packet and an announced discontinuity are allowed
            due = (counters[:-1] + moves[1:]) & 15
            repeat = moves[1:] & (counters[1:] == counters[:-1])
            if repeat.any():
                repeat &= (p[mine[1:]] == p[mine[:-1]]).all(axis=1)
                filled[mine[1:][repeat]] = False
            found.continuity_errors += int(((counters[1:] != due) & ~repeat & (flags[mine[1:]] & 0x80 == 0)).sum())

    def packets_of(wanted: list[int]) -> Iterator[list[tuple[bool, bytes]]]:
        for x in wanted:
            yield [(bool(p[i, 1] & 0x40), p[i, begins[i] :].tobytes()) for i in np.flatnonzero((pids == x) & filled & (begins < PACKET))]

    for packets in packets_of([PAT_PID]):
        for body in _sections(packets, 0, found):
            found.programs |= {int.from_bytes(body[j : j + 2], "big"): int.from_bytes(body[j + 2 : j + 4], "big") & 0x1FFF for j in range(0, len(body) - 3, 4) if body[j : j + 2] != b"\0\0"}
    for packets in packets_of(sorted(set(found.programs.values()))):
        for body in _sections(packets, 2, found):
            j = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while j + 5 <= len(body):
                found.streams[int.from_bytes(body[j + 1 : j + 3], "big") & 0x1FFF] = body[j]
                j += 5 + (int.from_bytes(body[j + 3 : j + 5], "big") & 0xFFF)

    wanted = next(iter(found.streams), None) if pid is None else pid
    mine = np.flatnonzero((pids == wanted) & filled & (begins < PACKET)) if wanted is not None else []
    if len(mine):
        starts = np.flatnonzero(p[mine, 1] & 0x40 != 0)
        for a, b in zip(starts, [*starts[1:], len(mine)], strict=True):
            at = mine[a:b]
            whole = begins[at] == 4
            parts = [p[at[0], begins[at[0]] :].tobytes()]
            if len(at) > 1:
                middle = at[1:]
                parts += [p[middle, 4:].tobytes()] if whole[1:].all() else [p[middle[:-1], 4:].tobytes(), p[middle[-1], begins[middle[-1]] :].tobytes()] if whole[1:-1].all() else [p[i, begins[i] :].tobytes() for i in middle]
            pes = b"".join(parts)
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                found.table_errors += 1
                continue
            size = int.from_bytes(pes[4:6], "big")
            found.units.append(pes[9 + pes[8] : 6 + size if size else None])
            found.times.append(_read_stamp(pes[9:14]) if pes[7] & 0x80 and pes[8] >= 5 else None)
            found.random_access.append(bool(flags[at[0]] & 0x40))
    return found


def feature(found: Stream) -> str:
    """What a catalogue of streams keeps: packets, units, errors, first and last time, random-access points."""
    times = [t for t in found.times if t is not None]
    n = len(found.programs)
    return (
        f"packets={found.packets};programs={n};streams={len(found.streams)};units={len(found.units)};first_pts={times[0] if times else ''};last_pts={times[-1] if times else ''};"
        f"random_access={sum(found.random_access)};continuity_errors={found.continuity_errors};table_errors={found.table_errors};skipped={found.skipped_bytes}"
    )


def index_of(found: Stream) -> list[dict]:
    """Time, offset in the payload and random-access flag of each unit."""
    out, offset = [], 0
    for unit, time, start in zip(found.units, found.times, found.random_access, strict=True):
        out.append({"pts": time, "offset": offset, "random_access": start})
        offset += len(unit)
    return out


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts:long,offset:long,random_access:boolean>>"
_UNIT = pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("units", pa.list_(_UNIT))])
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(_MEDIA)
    for doc_id, text in rows_of(batches):
        raw = (text or "").encode()
        media = write(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))
        if out.add((doc_id, len(raw), media), len(media)):
            yield out.batch()
    if out.rows:
        yield out.batch()


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(_ARROW)
    for doc_id, n, media in rows_of(batches):
        found = parse(media)
        payload = found.payload
        row = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), index_of(found))
        if out.add(row, 64 * len(found.units)):
            yield out.batch()
    if out.rows:
        yield out.batch()


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stream) of each text."""
    return run(docs.select(F.col("doc_id").cast("long"), "text"), _store, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """Digests and features, read from the stored bytes."""
    return run(media.select("doc_id", "n_bytes", "media"), _read, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(stored(table(spark, sf_dir, "documents")))
