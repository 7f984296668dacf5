"""MD5 that is put down after a part of a text and taken up in another process.

The state between two parts is 92 bytes: four words, the number of bits, the bytes of a block begun and how many
they are. That is the layout of OpenSSL's ``MD5_CTX``, so where Python's own library lets its ``MD5_Update``
be called, that does the work; anywhere else the rounds are gone through here, slower and with the same state.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import struct

_LAYOUT = struct.Struct("=6I64sI")
START = _LAYOUT.pack(0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0, 0, b"", 0)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_ALL = 0xFFFFFFFF


def _block(words: tuple[int, ...], x: tuple[int, ...]) -> tuple[int, ...]:
    a, b, c, d = words
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | (d ^ _ALL))
        f = (f + a + _SINES[i] + x[_WORDS[i]]) & _ALL
        a, d, c, b = d, c, b, (b + ((f << _SHIFTS[i]) | (f >> (32 - _SHIFTS[i])))) & _ALL
    return tuple((p + q) & _ALL for p, q in zip(words, (a, b, c, d), strict=True))


def update_plain(state: bytes, data: bytes) -> bytes:
    """The state after more bytes, in Python alone."""
    *words, low, high, held, n = _LAYOUT.unpack(state)
    bits = (low | high << 32) + 8 * len(data)
    data = held[:n] + data
    whole = len(data) - len(data) % 64
    for x in struct.iter_unpack("<16I", data[:whole]):
        words = _block(words, x)
    return _LAYOUT.pack(*words, bits & _ALL, bits >> 32 & _ALL, data[whole:], len(data) - whole)


def _openssl():
    """``update`` by the library behind hashlib, or None where it has none or another layout."""
    try:
        import _hashlib

        call = ctypes.CDLL(_hashlib.__file__).MD5_Update
    except (ImportError, OSError, AttributeError):
        return None
    call.argtypes, call.restype = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t], ctypes.c_int

    def update(state: bytes, data: bytes) -> bytes:
        held = ctypes.create_string_buffer(state, 2 * len(state))
        if call(held, data, len(data)) != 1:
            raise RuntimeError("MD5_Update failed")
        return held.raw[: len(state)]

    probe = bytes(range(200))
    try:
        right = hexdigest(update(update(START, probe[:77]), probe[77:]), update) == hashlib.md5(probe, usedforsecurity=False).hexdigest()
    except (RuntimeError, ValueError):
        return None
    return update if right else None


def hexdigest(state: bytes, update=update_plain) -> str:
    """The digest of all that came before."""
    *_, low, high, _, n = _LAYOUT.unpack(state)
    state = update(state, b"\x80" + bytes((55 - n) % 64) + struct.pack("<2I", low, high))
    return struct.pack("<4I", *_LAYOUT.unpack(state)[:4]).hex()


update = _openssl() or update_plain
