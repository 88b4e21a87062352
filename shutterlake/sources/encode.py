"""Baseline JPEG files from pixels, in numpy: cosine transform, quantisation and Huffman codes fitted to each picture."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The standard's example steps of quantisation, row by row, for brightness and colour.
BRIGHT = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

#: Places of a block along its diagonals, each second one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
_N = np.arange(8)
COSINES = np.cos(np.pi / 8 * (_N[None, :] + 0.5) * _N[:, None]) / 2 * np.where(_N[:, None], 1, np.sqrt(0.5))
LONGEST_CODE = 16


def steps(base: list[int], quality: int) -> np.ndarray:
    """Steps for a quality from 1 to 100, scaled as is usual."""
    share = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * share + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray) -> np.ndarray:
    """Blocks of 8 x 8, edges repeated to fill the last ones."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def _quantised(rgb: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Blocks x 3 x 64: coefficients along the diagonals."""
    r, g, b = (rgb[:, :, k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    out = []
    for plane, table in zip((y - 128, (b - y) / 1.772, (r - y) / 1.402), tables, strict=True):
        flat = (COSINES @ _blocks(plane) @ COSINES.T).reshape(-1, 64)
        out.append(np.clip(np.rint(flat / table), -1023, 1023)[:, ZIGZAG])
    return np.stack(out, axis=1).astype(np.int64)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of at most LONGEST_CODE bits that leave the code of all ones unused."""
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()] + [(0, -1, (-1,))]  # -1 takes the code of all ones
        heapq.heapify(heap)
        depth = dict.fromkeys([*counts, -1], 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= LONGEST_CODE:
            break
        counts = {s: n // 2 + 1 for s, n in counts.items()}  # flatter, so shorter
    del depth[-1]
    return depth


def _codes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length for each symbol value, and the table as the file holds it."""
    found, counts = np.unique(symbols, return_counts=True)
    length = code_lengths(dict(zip(found.tolist(), counts.tolist(), strict=True)))
    order = sorted(length, key=lambda s: (length[s], s))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= length[s] - last
        codes[s], sizes[s], last = code, length[s], length[s]
        code += 1
    table = bytes(sum(n == k for n in length.values()) for k in range(1, LONGEST_CODE + 1))
    return codes, sizes, table + bytes(order)


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits a magnitude has."""
    return np.ceil(np.log2(np.abs(x) + 1)).astype(np.int64)


def _scan(z: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The coded blocks, and the tables for first and for other coefficients."""
    first = np.diff(z[:, :, 0], axis=0, prepend=0).reshape(-1)
    rest = z.reshape(-1, 64)
    row, k = np.nonzero(rest[:, 1:])
    k = k + 1
    value = rest[row, k]
    before = np.where(np.r_[True, row[1:] != row[:-1]][: len(row)], 0, np.r_[0, k[:-1]][: len(row)])
    run = k - before - 1
    last = np.zeros(len(rest), np.int64)
    np.maximum.at(last, row, k)
    short = np.flatnonzero(last < 63)
    zeros = np.repeat(np.arange(len(row)), run // 16)  # runs of sixteen noughts before a value
    rows = np.arange(len(rest))
    # in the order of blocks and places; at one place the runs come first
    at = np.concatenate([rows * 65, row[zeros] * 65 + k[zeros], row * 65 + k, short * 65 + 64])
    symbol = np.concatenate([_bits(first), np.full(len(zeros), 0xF0), (run % 16 << 4) + _bits(value), np.zeros(len(short), np.int64)])
    amount = np.concatenate([first, np.zeros(len(zeros), np.int64), value, np.zeros(len(short), np.int64)])
    is_first = np.arange(len(at)) < len(rows)
    order = np.argsort(at, kind="stable")
    symbol, amount, is_first = symbol[order], amount[order], is_first[order]
    codes_f, sizes_f, table_f = _codes(symbol[is_first])
    codes_r, sizes_r, table_r = _codes(symbol[~is_first])
    code, size = np.where(is_first, codes_f[symbol], codes_r[symbol]), np.where(is_first, sizes_f[symbol], sizes_r[symbol])
    more = _bits(amount)
    word = (code << more) + np.where(amount < 0, amount + (1 << more) - 1, amount)
    total = size + more
    ends = np.cumsum(total)
    which = np.repeat(np.arange(len(total)), total)
    bit = (word[which] >> (ends[which] - 1 - np.arange(ends[-1]))) & 1
    bit = np.r_[bit, np.ones(-len(bit) % 8, np.int64)]
    return np.packbits(bit.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\0"), table_f, table_r


def jpeg(rgb: np.ndarray, quality: int = 75) -> bytes:
    """A baseline JPEG file of height x width x 3 values from 0 to 255, red first, colours at full size."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must be from 1 to 100")
    h, w, _ = rgb.shape
    if not (0 < h < 65_536 and 0 < w < 65_536):
        raise ValueError("a JPEG file has 1 to 65,535 rows and columns")
    bright, colour = steps(BRIGHT, quality), steps(COLOUR, quality)
    data, first, rest = _scan(_quantised(rgb, [bright, colour, colour]))
    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k, table in enumerate((bright, colour)):
        out += part(0xDB, bytes([k, *table[ZIGZAG].tolist()]))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += part(0xC4, b"\x00" + first) + part(0xC4, b"\x10" + rest)
    return out + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
