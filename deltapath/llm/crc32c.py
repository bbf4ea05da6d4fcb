"""CRC-32C (Castagnoli) of many records at once, and its masked form.

A CRC is linear over GF(2): leading zero bytes leave a zero register as it is,
and the CRC of a concatenation is the CRC of the first part moved over the
length of the second, xor the CRC of the second.  So records are cut into
lanes of equal length (padded in front), all lanes run through the slicing
tables together, and the lanes of a record are folded from left to right.
"""

from __future__ import annotations

import numpy as np

_POLY = 0x82F63B78  # reflected Castagnoli polynomial
_MASK_DELTA = 0xA282EAD8
LANE = 512


def _tables() -> np.ndarray:
    t = np.zeros((8, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLY), c >> 1)
    t[0] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 0xFF]
    return t


_T = _tables()
#: For two bytes at a time: the low one goes through the later table.
_PAIRS = [_T[k + 1][np.arange(1 << 16) & 0xFF] ^ _T[k][np.arange(1 << 16) >> 8] for k in (0, 2, 4, 6)]


def _move_tables() -> np.ndarray:
    """Tables that move a register over LANE zero bytes, one for each byte of the register."""
    c = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(LANE):
        c = (c >> 8) ^ _T[0][c & 0xFF]
    bits = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(8):
            out[k] ^= np.where(bits[:, b] == 1, c[8 * k + b], 0).astype(np.uint32)
    return out


_MOVE = _move_tables()


def _short(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ int(_T[0][(c ^ b) & 0xFF])
    return c ^ 0xFFFFFFFF


def crc32c_many(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record (unsigned)."""
    n = len(records)
    lens = np.fromiter((len(r) for r in records), np.int64, n)
    out = np.zeros(n, np.uint32)
    for i in np.flatnonzero(lens < 4):
        out[i] = _short(records[i])
    big = np.flatnonzero(lens >= 4)
    if not len(big):
        return out
    lanes = -(-lens[big] // LANE)
    last = np.cumsum(lanes)
    zeros, before = bytes(LANE), (lanes * LANE - lens[big]).tolist()
    flat = np.frombuffer(bytearray().join(x for i, pad in zip(big.tolist(), before) for x in (zeros[:pad], records[i])), np.uint8)
    flat[(last * LANE - lens[big])[:, None] + np.arange(4)] ^= 0xFF  # the same as starting with a register of ones
    rows = flat.reshape(-1, LANE)
    words = np.ascontiguousarray(rows.view("<u4").T)
    c = np.zeros(len(rows), np.uint32)
    for k in range(0, LANE // 4, 2):
        a, b = c ^ words[k], words[k + 1]
        c = _PAIRS[3].take(a & 0xFFFF)
        c ^= _PAIRS[2].take(a >> 16)
        c ^= _PAIRS[1].take(b & 0xFFFF)
        c ^= _PAIRS[0].take(b >> 16)
    order = np.argsort(-lanes, kind="stable")
    first, many = (last - lanes)[order], lanes[order]
    r = np.zeros(len(order), np.uint32)
    for j in range(int(many[0])):
        live = int(np.searchsorted(-many, -j, side="left"))  # records of more than j lanes
        x = r[:live]
        moved = _MOVE[0][x & 0xFF] ^ _MOVE[1][(x >> 8) & 0xFF] ^ _MOVE[2][(x >> 16) & 0xFF] ^ _MOVE[3][x >> 24]
        r[:live] = moved ^ c[first[:live] + j]
    out[big[order]] = r ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that a checksum of data that holds checksums stays sound."""
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)
