"""Byte formats: frame containers, OBU streams, element trees and NAL streams, as table functions over binary columns.

Written from the public descriptions of IVF, AV1 low-overhead bitstreams, EBML and H.265 Annex B.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class Truncated(ValueError):
    pass


def ivf_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Timestamp and payload of each frame."""
    if len(data) < 32 or data[:4] != b"DKIF":
        raise Truncated("no IVF header")
    at = struct.unpack_from("<H", data, 6)[0]
    while at < len(data):
        if at + 12 > len(data):
            raise Truncated("frame header cut off")
        size, pts = struct.unpack_from("<IQ", data, at)
        at += 12
        if at + size > len(data):
            raise Truncated("frame cut off")
        yield pts, data[at : at + size]
        at += size


def ivf_file(frames: list[bytes], header: bytes | None = None) -> bytes:
    """Frames with timestamps from 0 on; header gives the stream's bytes 8 to 24 (codec, size, time base)."""
    head = (header or struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, b"AV01", 16, 16, 25, 1, 0, 0))[:24]
    return head + struct.pack("<II", len(frames), 0) + b"".join(struct.pack("<IQ", len(f), i) + f for i, f in enumerate(frames))


def ivf_concat(files: list[bytes]) -> bytes:
    """One file of all frames, timestamps counted anew; the streams must be alike."""
    if len({f[8:24] for f in files}) > 1:
        raise ValueError("the streams differ")
    return ivf_file([p for f in files for _, p in ivf_frames(f)], files[0])


def leb128(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for i in range(8):
        if at + i >= len(data):
            raise Truncated("number cut off")
        value |= (data[at + i] & 0x7F) << 7 * i
        if not data[at + i] & 0x80:
            return value, at + i + 1
    raise ValueError("number too long")


def to_leb128(value: int) -> bytes:
    out = bytearray()
    while True:
        value, low = value >> 7, value & 0x7F
        out.append(low | (0x80 if value else 0))
        if not value:
            return bytes(out)


def obus(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Type, header and payload of each unit of a temporal unit; units must carry their size, as they do in files."""
    at = 0
    while at < len(data):
        head, begin = data[at], at
        if not head & 2:
            raise Truncated("unit without a size")
        at += 2 if head & 4 else 1
        header = data[begin:at]
        size, at = leb128(data, at)
        if at + size > len(data):
            raise Truncated("unit cut off")
        yield head >> 3 & 15, header, data[at : at + size]
        at += size


def shown_frame(kind: int, payload: bytes, reduced_still: bool = False) -> bool:
    """Whether a frame (6) or frame header (3) unit is shown: an existing frame, or the show bit."""
    if kind not in (3, 6) or not payload:
        return False
    return reduced_still or bool(payload[0] & 0x80) or bool(payload[0] & 0x10)


def t35_obu(message: bytes) -> bytes:
    """A metadata unit of type 4 (ITU-T T.35) with trailing bits."""
    body = to_leb128(4) + message + b"\x80"
    return bytes([5 << 3 | 2]) + to_leb128(len(body)) + body


def vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise Truncated("no size")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Truncated("size cut off")
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep_marker else value & (1 << 7 * n) - 1), at + n


def elements(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int]]:
    """Id, begin and end of the payload of each element at one level; a size of all ones lasts to the end."""
    while at < len(data):
        ident, at = vint(data, at, True)
        begin = at
        size, at = vint(data, at, False)
        end = len(data) if size == (1 << 7 * (at - begin)) - 1 else at + size
        if end > len(data):
            raise Truncated("element cut off")
        yield ident, at, end
        at = end


def nal_units(data: bytes) -> Iterator[bytes]:
    """Units between start codes, without trailing zeros."""
    at = data.find(b"\x00\x00\x01")
    while at >= 0:
        end = data.find(b"\x00\x00\x01", at + 3)
        unit = data[at + 3 : end if end >= 0 else len(data)].rstrip(b"\x00")
        if unit:
            yield unit
        at = end


def without_emulation(data: bytes) -> bytes:
    """The payload without the bytes that keep start codes out."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def sei_t35(nal: bytes) -> Iterator[bytes]:
    """Payloads of type 4 (T.35) in an H.265 SEI unit (types 39 and 40)."""
    if len(nal) < 3 or nal[0] >> 1 & 63 not in (39, 40):
        return
    body, at = without_emulation(nal[2:]), 0
    while at < len(body) and body[at] != 0x80:
        kind = size = 0
        while at < len(body) and body[at] == 0xFF:
            kind, at = kind + 255, at + 1
        if at >= len(body):
            return
        kind, at = kind + body[at], at + 1
        while at < len(body) and body[at] == 0xFF:
            size, at = size + 255, at + 1
        if at >= len(body):
            return
        size, at = size + body[at], at + 1
        if kind == 4:
            yield body[at : at + size]
        at += size


def insert_metadata(data: bytes, messages: list[list[bytes]]) -> bytes:
    """An IVF file with the n-th messages (T.35 payloads) before its n-th shown frame; there must be as many shown frames as messages."""
    out, shown, still = [data[: int.from_bytes(data[6:8], "little")]], 0, False
    for pts, unit in ivf_frames(data):
        parts = []
        for kind, header, payload in obus(unit):
            if kind == 1:
                still = bool(payload[:1] and payload[0] & 8)
            if shown_frame(kind, payload, still):
                if shown == len(messages):
                    raise ValueError(f"more frames are shown than the {len(messages)} that have metadata")
                parts += [t35_obu(m) for m in messages[shown]]
                shown += 1
            parts.append(header + to_leb128(len(payload)) + payload)
        body = b"".join(parts)
        out.append(struct.pack("<IQ", len(body), pts) + body)
    if shown != len(messages):
        raise ValueError(f"{shown} frames are shown, but {len(messages)} have metadata")
    return b"".join(out)


def trimmed_config(record: bytes) -> bytes | None:
    """A codec configuration record with only the sequence header and static light metadata left; None if there is nothing to take out or it can't be read."""
    try:
        units = list(obus(record[4:])) if len(record) >= 4 else None
    except (Truncated, IndexError):
        return None
    if units is None:
        return None
    stays = [kind == 1 or (kind == 5 and payload[:1] in (b"\x01", b"\x02")) for kind, _, payload in units]
    if all(stays):
        return None
    return record[:4] + b"".join(header + to_leb128(len(payload)) + payload for keep, (_, header, payload) in zip(stays, units, strict=True) if keep)


def shrunk_element(data: bytes, begin: int, payload: bytes) -> bytes | None:
    """The element at begin with a shorter payload, filled up with a Void to the size it had, so nothing after it moves; None where that can't be done."""
    _, size_at = vint(data, begin, True)
    size, at = vint(data, size_at, False)
    width, end = at - size_at, at + size
    if len(payload) > size:
        return None
    room = size - len(payload)
    if room == 1:  # a Void takes two bytes at least
        return None
    head = data[begin:size_at] + ((1 << 7 * width) | len(payload)).to_bytes(width, "big") + payload
    if not room:
        return head
    for n in range(1, 9):
        rest = room - 1 - n
        if 0 <= rest < (1 << 7 * n) - 1:
            return head + b"\xec" + ((1 << 7 * n) | rest).to_bytes(n, "big") + bytes(rest)
    return None if end > len(data) else head


def pictures_with_messages(units: Iterator[bytes], message=lambda nal: next(sei_t35(nal), None)) -> list[bytes | None]:
    """Each picture's message in an H.265 stream's units: a prefix unit's goes to the next picture, a suffix unit's replaces the last one's; other layers are left out."""
    out: list[bytes | None] = []
    waiting = None
    for nal in units:
        if len(nal) < 2 or nal[0] & 1 or nal[1] >> 3:
            continue
        kind = nal[0] >> 1 & 63
        if kind <= 31 and len(nal) > 2 and nal[2] & 0x80:
            out.append(waiting)
            waiting = None
        elif kind == 39:
            waiting = message(nal) or waiting
        elif kind == 40 and out:
            out[-1] = message(nal) or out[-1]
    return out


def nal_units_of_blocks(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """As nal_units, of a stream that comes in blocks: only what follows the last start code is held over."""
    held = b""
    for block in blocks:
        held += block
        last = held.rfind(b"\x00\x00\x01")
        if last > 0:
            yield from nal_units(held[:last])
            held = held[last:]
    yield from nal_units(held)


@udtf(returnType="ordinal: bigint, message: binary")
class PictureMessages:
    def eval(self, content: bytes):
        if content is not None:
            yield from enumerate(pictures_with_messages(nal_units(bytes(content))))


@udtf(returnType="frame: int, pts: bigint, payload: binary")
class IvfFrames:
    def eval(self, content: bytes):
        if content is not None:
            for i, (pts, payload) in enumerate(ivf_frames(bytes(content))):
                yield i, pts, payload


@udtf(returnType="seq: int, kind: int, payload: binary")
class Obus:
    def eval(self, content: bytes):
        if content is not None:
            for i, (kind, _, payload) in enumerate(obus(bytes(content))):
                yield i, kind, payload


@udtf(returnType="seq: int, kind: int, unit: binary")
class NalUnits:
    def eval(self, content: bytes):
        if content is not None:
            for i, unit in enumerate(nal_units(bytes(content))):
                yield i, unit[0] >> 1 & 63, unit


@udtf(returnType="seq: int, element: bigint, payload: binary")
class Elements:
    def eval(self, content: bytes):
        if content is not None:
            data = bytes(content)
            for i, (ident, a, b) in enumerate(elements(data)):
                yield i, ident, data[a:b]


def _each(files: DataFrame, function, content: str, *rest: str) -> DataFrame:
    return files.lateralJoin(function(F.col(content).outer())).drop(*rest)


def read_ivf(files: DataFrame, content: str = "content") -> DataFrame:
    """files (any columns and a binary one) with frame, pts and payload of each frame."""
    return _each(files, IvfFrames, content, content)


def read_nal_units(files: DataFrame, content: str = "content") -> DataFrame:
    return _each(files, NalUnits, content, content)


def read_elements(files: DataFrame, content: str = "content") -> DataFrame:
    return _each(files, Elements, content, content)


def read_obus(files: DataFrame, content: str = "payload") -> DataFrame:
    return _each(files, Obus, content, content)


def read_picture_messages(files: DataFrame, content: str = "content") -> DataFrame:
    """files with ordinal and message of each picture of an H.265 stream."""
    return _each(files, PictureMessages, content, content)
