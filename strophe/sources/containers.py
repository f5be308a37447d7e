"""Encrypted containers, decoded in Arrow UDFs: there is no inflate and no such cipher among the expressions.

``decode_krc``: base64, four bytes of header, XOR with a repeated key, zlib, one leading byte, UTF-8.
``decode_qrc``: hex, a three-pass block cipher over 8 bytes, zlib, an optional byte order mark, UTF-8.
The cipher is DES by its published tables but for the byte order of 32-bit words, two entries of the substitution
boxes and the place of the second half in the key compression. What cannot be decoded is null.
"""

from __future__ import annotations

import base64
import binascii
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys, and the tables of the cipher, counted from 0 as in the published standard.
KRC_KEY = bytes([0x40, 0x47, 0x61, 0x77, 0x5E, 0x32, 0x74, 0x47, 0x51, 0x36, 0x31, 0x2D, 0xCE, 0xD2, 0x6E, 0x69])
QRC_KEY = b"!@#)(*$%123ZXC!@!@#)(NHL"
SHIFTS = [1, 1, 2, 2, 2, 2, 2, 2, 1, 2, 2, 2, 2, 2, 2, 1]
KEY_C = [56, 48, 40, 32, 24, 16, 8, 0, 57, 49, 41, 33, 25, 17, 9, 1, 58, 50, 42, 34, 26, 18, 10, 2, 59, 51, 43, 35]
KEY_D = [62, 54, 46, 38, 30, 22, 14, 6, 61, 53, 45, 37, 29, 21, 13, 5, 60, 52, 44, 36, 28, 20, 12, 4, 27, 19, 11, 3]
COMPRESSION = [
    13, 16, 10, 23, 0, 4, 2, 27, 14, 5, 20, 9, 22, 18, 11, 3, 25, 7, 15, 6, 26, 19, 12, 1,
    40, 51, 30, 36, 46, 54, 29, 39, 50, 44, 32, 47, 43, 48, 38, 55, 33, 52, 45, 41, 49, 35, 28, 31,
]
PERMUTATION = [15, 6, 19, 20, 28, 11, 27, 16, 0, 14, 22, 25, 4, 17, 30, 9, 1, 7, 23, 13, 31, 26, 2, 8, 18, 12, 29, 5, 21, 10, 3, 24]
BOXES = [
    [14, 4, 13, 1, 2, 15, 11, 8, 3, 10, 6, 12, 5, 9, 0, 7, 0, 15, 7, 4, 14, 2, 13, 1, 10, 6, 12, 11, 9, 5, 3, 8,
     4, 1, 14, 8, 13, 6, 2, 11, 15, 12, 9, 7, 3, 10, 5, 0, 15, 12, 8, 2, 4, 9, 1, 7, 5, 11, 3, 14, 10, 0, 6, 13],
    [15, 1, 8, 14, 6, 11, 3, 4, 9, 7, 2, 13, 12, 0, 5, 10, 3, 13, 4, 7, 15, 2, 8, 15, 12, 0, 1, 10, 6, 9, 11, 5,
     0, 14, 7, 11, 10, 4, 13, 1, 5, 8, 12, 6, 9, 3, 2, 15, 13, 8, 10, 1, 3, 15, 4, 2, 11, 6, 7, 12, 0, 5, 14, 9],
    [10, 0, 9, 14, 6, 3, 15, 5, 1, 13, 12, 7, 11, 4, 2, 8, 13, 7, 0, 9, 3, 4, 6, 10, 2, 8, 5, 14, 12, 11, 15, 1,
     13, 6, 4, 9, 8, 15, 3, 0, 11, 1, 2, 12, 5, 10, 14, 7, 1, 10, 13, 0, 6, 9, 8, 7, 4, 15, 14, 3, 11, 5, 2, 12],
    [7, 13, 14, 3, 0, 6, 9, 10, 1, 2, 8, 5, 11, 12, 4, 15, 13, 8, 11, 5, 6, 15, 0, 3, 4, 7, 2, 12, 1, 10, 14, 9,
     10, 6, 9, 0, 12, 11, 7, 13, 15, 1, 3, 14, 5, 2, 8, 4, 3, 15, 0, 6, 10, 10, 13, 8, 9, 4, 5, 11, 12, 7, 2, 14],
    [2, 12, 4, 1, 7, 10, 11, 6, 8, 5, 3, 15, 13, 0, 14, 9, 14, 11, 2, 12, 4, 7, 13, 1, 5, 0, 15, 10, 3, 9, 8, 6,
     4, 2, 1, 11, 10, 13, 7, 8, 15, 9, 12, 5, 6, 3, 0, 14, 11, 8, 12, 7, 1, 14, 2, 13, 6, 15, 0, 9, 10, 4, 5, 3],
    [12, 1, 10, 15, 9, 2, 6, 8, 0, 13, 3, 4, 14, 7, 5, 11, 10, 15, 4, 2, 7, 12, 9, 5, 6, 1, 13, 14, 0, 11, 3, 8,
     9, 14, 15, 5, 2, 8, 12, 3, 7, 0, 4, 10, 1, 13, 11, 6, 4, 3, 2, 12, 9, 5, 15, 10, 11, 14, 1, 7, 6, 0, 8, 13],
    [4, 11, 2, 14, 15, 0, 8, 13, 3, 12, 9, 7, 5, 10, 6, 1, 13, 0, 11, 7, 4, 9, 1, 10, 14, 3, 5, 12, 2, 15, 8, 6,
     1, 4, 11, 13, 12, 3, 7, 14, 10, 15, 6, 8, 0, 5, 9, 2, 6, 11, 13, 8, 1, 4, 10, 7, 9, 5, 0, 15, 14, 2, 3, 12],
    [13, 2, 8, 4, 6, 15, 11, 1, 10, 9, 3, 14, 5, 0, 12, 7, 1, 15, 13, 8, 10, 3, 7, 4, 12, 5, 6, 11, 0, 14, 9, 2,
     7, 11, 4, 1, 9, 12, 14, 2, 0, 6, 10, 13, 15, 3, 5, 8, 2, 1, 14, 7, 4, 10, 8, 13, 15, 12, 9, 0, 3, 5, 6, 11],
]

#: Initial permutation by its rule: columns of the bit matrix from the right, odd ones first, rows from below.
_INITIAL = [8 * row + col for col in (1, 3, 5, 7, 0, 2, 4, 6) for row in range(7, -1, -1)]
_FINAL = [_INITIAL.index(i) for i in range(64)]
#: Expansion by its rule: six bits around each group of four.
_EXPANSION = [(4 * g + k - 1) % 32 for g in range(8) for k in range(6)]


def _bits(blocks: np.ndarray) -> np.ndarray:
    """Bits of rows of bytes whose 32-bit words are little-endian."""
    return np.unpackbits(blocks.reshape(len(blocks), -1, 4)[:, :, ::-1].reshape(len(blocks), -1), axis=1)


def _bytes(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).reshape(len(bits), -1, 4)[:, :, ::-1].reshape(len(bits), -1)


def round_keys(key: bytes, forward: bool) -> list[np.ndarray]:
    """48 bits for each of the 16 rounds."""
    bits = _bits(np.frombuffer(key, np.uint8)[None])[0]
    c, d, out = bits[KEY_C], bits[KEY_D], []
    for shift in SHIFTS:
        c, d = np.roll(c, -shift), np.roll(d, -shift)
        second = np.append(d, 0)  # the second half is read one place late, beyond its end a zero
        out.append(np.concatenate([c[COMPRESSION[:24]], second[[x - 27 for x in COMPRESSION[24:]]]]))
    return out if forward else out[::-1]


@cache
def _box_bits() -> np.ndarray:
    """For each box and each six input bits its four output bits."""
    row = lambda v: (v >> 4 & 2) | (v & 1)
    values = np.array([[box[16 * row(v) + (v >> 1 & 15)] for v in range(64)] for box in BOXES], np.uint8)
    return np.unpackbits(values[:, :, None], axis=2)[:, :, 4:]


def crypt(blocks: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """One pass over all blocks (rows of 8 bytes) at once."""
    bits = _bits(blocks)[:, _INITIAL]
    left, right = bits[:, :32], bits[:, 32:]
    weights = np.array([32, 16, 8, 4, 2, 1])
    table = _box_bits()
    for n, key in enumerate(keys):
        six = ((right[:, _EXPANSION] ^ key).reshape(len(bits), 8, 6) * weights).sum(axis=2)
        mixed = table[np.arange(8), six].reshape(len(bits), 32)[:, PERMUTATION] ^ left
        left, right = (right, mixed) if n < 15 else (mixed, right)
    return _bytes(np.concatenate([left, right], axis=1)[:, _FINAL])


def passes(key: bytes, decode: bool) -> list[list[np.ndarray]]:
    parts = [key[:8], key[8:16], key[16:24]]
    order = [(2, False), (1, True), (0, False)] if decode else [(0, True), (1, False), (2, True)]
    return [round_keys(parts[i], forward) for i, forward in order]


#: Blocks of one call of ``crypt``: their bits as numbers are some tens of MB.
BLOCKS = 1 << 14


def crypt_all(datas: list[bytes], key: bytes = QRC_KEY, decode: bool = True) -> Iterator[bytes]:
    """Three passes over each; short last blocks are filled with zeros and cut again. Blocks stand alone, so all go together."""
    full = np.frombuffer(b"".join(d + b"\0" * (-len(d) % 8) for d in datas), np.uint8).reshape(-1, 8).copy()
    rounds = passes(key, decode)
    for at in range(0, len(full), BLOCKS):
        for keys in rounds:
            full[at : at + BLOCKS] = crypt(full[at : at + BLOCKS], keys)
    at = 0
    for d in datas:
        size = -(-len(d) // 8)
        yield full[at : at + size].tobytes()[: len(d)]
        at += size


def crypt_bytes(data: bytes, key: bytes = QRC_KEY, decode: bool = True) -> bytes:
    return next(crypt_all([data], key, decode))


def krc_text(data: bytes | None) -> tuple[str | None, str | None]:
    """(text, error) of a container's bytes."""
    if data is None or len(data) <= 4:
        return None, "InvalidInput"
    body = np.frombuffer(data[4:], np.uint8)
    plain = (body ^ np.resize(np.frombuffer(KRC_KEY, np.uint8), len(body))).tobytes()
    try:
        text = zlib.decompressobj().decompress(plain)
    except zlib.error:
        return None, "DecompressionFailed"
    if not text:
        return None, "DecompressionFailed"
    try:
        return text[1:].decode(), None
    except UnicodeDecodeError:
        return None, "DecryptionFailed"


def krc_bytes(text: str) -> bytes:
    """A container for a text: the inverse, for tests and fixtures."""
    body = np.frombuffer(zlib.compress(b"\xef" + text.encode()), np.uint8)
    return b"krc1" + (body ^ np.resize(np.frombuffer(KRC_KEY, np.uint8), len(body))).tobytes()


def _hex(coded: str | None) -> bytes | None:
    try:
        return None if coded is None else bytes.fromhex("".join(coded.split()))
    except ValueError:
        return None


def _inflated(plain: bytes) -> str | None:
    try:
        return zlib.decompressobj().decompress(plain).removeprefix(b"\xef\xbb\xbf").decode()
    except (ValueError, zlib.error):
        return None


def qrc_texts(coded: list[str | None]) -> list[str | None]:
    """Texts of hex containers; all that are hex go through the cipher together."""
    datas = [_hex(c) for c in coded]
    plain = crypt_all([d for d in datas if d])
    return [_inflated(next(plain)) if d else None for d in datas]


def qrc_text(coded: str | None) -> str | None:
    return qrc_texts([coded])[0]


def qrc_hex(text: str) -> str:
    """A container for a text: the inverse, for tests and fixtures."""
    data = zlib.compress(text.encode())
    return crypt_bytes(data + b"\0" * (-len(data) % 8), decode=False).hex().upper()


def _base64(text: str | None) -> bytes | None:
    try:
        return None if text is None else base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None


#: Different containers that are Python objects at a time.
SLICE = 500


def _texts(decode, c: Column) -> Column:
    """An Arrow UDF of a function from values to texts or nulls; equal values of a batch are decoded once."""

    def run(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        parts = [pa.array(decode(coded.dictionary.slice(at, SLICE).to_pylist()), pa.string()) for at in range(0, len(coded.dictionary), SLICE)]
        return pa.concat_arrays([*parts, pa.array([], pa.string())]).take(coded.indices)

    return F.arrow_udf(run, T.StringType())(c)


def decode_krc(c: Column) -> Column:
    """Text of a base64 container, or null."""
    return _texts(lambda vs: [krc_text(_base64(v))[0] for v in vs], c)


def decode_krc_bytes(c: Column) -> Column:
    """Text of a container file (see Spark's binaryFile source), or null."""
    return _texts(lambda vs: [krc_text(v)[0] for v in vs], c)


def decode_krc_result(c: Column) -> Column:
    """(value, error) of a container file."""

    def run(values: pa.Array) -> pa.Array:
        rows = [dict(zip(("value", "error"), krc_text(v), strict=True)) for v in values.to_pylist()]
        return pa.array(rows, pa.struct([("value", pa.string()), ("error", pa.string())]))

    return F.arrow_udf(run, T.StructType().add("value", T.StringType()).add("error", T.StringType()))(c)


def decode_qrc(c: Column) -> Column:
    """Text of a hex container, or null."""
    return _texts(qrc_texts, c)
