"""Writing containers: the counterpart of ``containers``, for fixtures and for exports that are read back.

Values are framed documents of binary XML in an envelope of literal blocks, as a reader expects them; nothing is compressed.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable

import numpy as np

from . import containers as C


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def string(s: str) -> bytes:
    return varint(len(s.encode())) + s.encode()


def value(v, end: bool = True) -> bytes:
    """A value record; ``end`` closes the element it is in."""
    if v == "":
        kind, data = 0xA8, b""
    elif isinstance(v, bool):
        kind, data = 0x86 if v else 0x84, b""
    elif isinstance(v, int):
        kind, data = 0x8E, struct.pack("<q", v)
    elif isinstance(v, float):
        kind, data = 0x92, struct.pack("<d", v)
    elif isinstance(v, uuid.UUID):
        kind, data = 0xB0, v.bytes_le
    elif isinstance(v, list):
        kind, data = C.LIST, b"".join(value(x, False) for x in v) + bytes([C.LIST_END])
        end = False  # a list can't close an element; an end record follows
    else:
        kind, data = 0x9C, struct.pack("<I", len(v.encode())) + v.encode()
    return bytes([kind | end]) + data


def element(name: str, *inside: bytes, namespace: str | None = None, **attributes) -> bytes:
    """An element with attributes and what is inside it, closed."""
    head = b"\x40" + string(name)
    if namespace is not None:
        head += bytes([C.NAMESPACE]) + string(namespace)
    head += b"".join(bytes([C.ATTRIBUTE]) + string(k) + value(v, False) for k, v in attributes.items())
    return head + b"".join(inside) + bytes([C.END])


def scalar(name: str, v) -> bytes:
    return element(name, value(v, False))


def array(name: str, values, form: str = "<f8") -> bytes:
    kind = next(k for k, f in C.ARRAYS.items() if f == form)
    data = np.asarray(values, form)
    return bytes([C.ARRAY, C.ELEMENT]) + string(name) + bytes([C.END, kind | 1]) + varint(len(data)) + data.tobytes()


def container(documents: Iterable[bytes], block: int = 1 << 16) -> bytes:
    """Documents framed and wrapped."""
    payload = C.FRAME_MAGIC + b"".join(bytes([C.FRAME_BODY]) + varint(len(d)) + d + bytes([C.FRAME_END]) for d in documents)
    out = bytearray(C.LZ4_MAGIC)
    for at in range(0, len(payload), block):
        part = payload[at : at + block]
        head, left = bytearray([min(len(part), 15) << 4]), len(part) - 15
        while left >= 0:
            head.append(min(left, 255))
            left -= 255
        out += struct.pack("<II", len(head) + len(part), 0) + head + part
    return bytes(out)
