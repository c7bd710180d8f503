"""The binary event log: frames of varint-coded records behind a short header.

A file begins with four magic bytes and a version (u16, little endian); each frame is a length (u32,
little endian) and a record: the time, the number of the event's kind, then its fields in order.
Unsigned numbers are LEB128, signed ones zigzag before that; options have a leading 0 or 1, strings
their length in bytes, booleans one byte. Numbers of 64 bits are kept as signed ones.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from causeway.schema import EVENT_KINDS, STATE_OPS, TASK_KINDS

#: Fixed value of the format. The four bytes before it name the producer and are a parameter.
VERSION = 1
HEADER_BYTES = 6
#: Fields of each kind of event, in their order in a record. ``loc`` is file, line and column.
FIELDS = {
    "task_spawn": (("id", "u"), ("parent", "?u"), ("name", "?s"), ("loc", "loc"), ("kind", "kind")),
    "poll_start": (("task", "u"),),
    "poll_end": (("task", "u"),),
    "park": (("task", "u"), ("resource", "u"), ("op_name", "s")),
    "wake": (("woken", "u"), ("by", "?u")),
    "resource_new": (("id", "u"), ("parent", "?u"), ("concrete_type", "s"), ("loc", "loc"), ("is_internal", "b")),
    "resource_state": (("resource", "u"), ("field", "s"), ("value", "i"), ("op", "op")),
    "task_end": (("id", "u"),),
    "resource_drop": (("id", "u"),),
}


class BadLog(ValueError):
    """A file that is no log, or a frame that can't be decoded."""


class Truncated(BadLog):
    """Bytes end within a frame or the header."""


class _Body:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise BadLog("a record ends too early")
        self.at += 1
        return self.data[self.at - 1]

    def unsigned(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
            if shift >= 70:
                raise BadLog("a number is too long")
        if value >> 64:
            raise BadLog("a number is too large")
        return value

    def read(self, kind: str):
        if kind[0] == "?":
            flag = self.byte()
            if flag > 1:
                raise BadLog("an option is neither there nor not")
            return self.read(kind[1:]) if flag else None
        if kind == "u":
            value = self.unsigned()
            return value - (1 << 64) if value >> 63 else value
        if kind == "i":
            value = self.unsigned()
            return (value >> 1) ^ -(value & 1)
        if kind == "b":
            flag = self.byte()
            if flag > 1:
                raise BadLog("a truth value is neither true nor false")
            return bool(flag)
        if kind == "s":
            size = self.unsigned()
            if size > len(self.data) - self.at:
                raise BadLog("a string ends too early")
            self.at += size
            try:
                return self.data[self.at - size : self.at].decode()
            except UnicodeDecodeError as e:
                raise BadLog("a string isn't UTF-8") from e
        if kind == "loc":
            return self.read("?s"), self.read("?u"), self.read("?u")
        names = TASK_KINDS if kind == "kind" else STATE_OPS
        at = self.unsigned()
        if at >= len(names):
            raise BadLog(f"no {kind} of number {at}")
        return names[at]


def decode(body: bytes) -> dict:
    """The event of a frame's body."""
    data = _Body(body)
    ts, number = data.read("u"), data.unsigned()
    if number >= len(EVENT_KINDS):
        raise BadLog(f"no event of number {number}")
    event = {"ts": ts, "ev": EVENT_KINDS[number]}
    for name, kind in FIELDS[event["ev"]]:
        value = data.read(kind)
        if name == "loc":
            event["loc_file"], event["loc_line"] = value[0], value[1]
        else:
            event[name] = value
    if data.at != len(body):
        raise BadLog("a record has bytes left over")
    return event


def _unsigned(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _write(kind: str, value) -> bytes:
    if kind[0] == "?":
        return b"\0" if value is None else b"\1" + _write(kind[1:], value)
    if kind == "u":
        return _unsigned(value)
    if kind == "i":
        return _unsigned((value << 1) ^ (value >> 63))
    if kind == "b":
        return bytes([bool(value)])
    if kind == "s":
        return _unsigned(len(value.encode())) + value.encode()
    return _unsigned((TASK_KINDS if kind == "kind" else STATE_OPS).index(value))


def encode(event: dict) -> bytes:
    """A frame: length and body. The column of a place isn't kept."""
    body = _unsigned(event["ts"]) + _unsigned(EVENT_KINDS.index(event["ev"]))
    for name, kind in FIELDS[event["ev"]]:
        if name == "loc":
            body += _write("?s", event.get("loc_file")) + _write("?u", event.get("loc_line")) + b"\0"
        else:
            body += _write(kind, event.get(name))
    return struct.pack("<I", len(body)) + body


def header(magic: bytes) -> bytes:
    if len(magic) != 4:
        raise ValueError("magic is four bytes")
    return magic + struct.pack("<H", VERSION)


def write_log(path: str, events: list[dict], magic: bytes) -> None:
    with open(path, "wb") as out:
        out.write(header(magic))
        for event in events:
            out.write(encode(event))


def check_header(data: bytes, magic: bytes | None = None) -> None:
    """``magic`` None takes any producer's log."""
    if len(data) < HEADER_BYTES:
        raise Truncated("the header is incomplete")
    if magic is not None and data[:4] != magic:
        raise BadLog("not an event log of this producer")
    (version,) = struct.unpack("<H", data[4:6])
    if version != VERSION:
        raise BadLog(f"version {version} isn't supported")


def frames(stream, start: int = HEADER_BYTES) -> Iterator[tuple[int, dict]]:
    """(place after the frame, event) of a binary stream behind its header; read frame by frame.

    Up to three bytes at the end are a clean end; Truncated if a body is incomplete.
    """
    at = start
    while True:
        head = stream.read(4)
        if len(head) < 4:
            return
        (size,) = struct.unpack("<I", head)
        body = stream.read(size)
        if len(body) < size:
            raise Truncated("the last frame is incomplete")
        at += 4 + size
        yield at, decode(body)
