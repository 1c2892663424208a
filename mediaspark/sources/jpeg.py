"""Baseline JPEG files from pixels, with Huffman tables made for each image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The quantisation tables that the JPEG standard suggests, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
# RGB to luminance and colour differences (JFIF).
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])

#: Places of an 8 x 8 block along its diagonals, each the other way than the one before.
ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_k = np.arange(8)
#: The discrete cosine transform of eight values.
DCT = np.sqrt(np.where(_k[:, None] == 0, 1, 2) / 8) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def _table(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 200 - 2 * quality if quality >= 50 else 5000 // quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _coefficients(px: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Quantised coefficients in zigzag order: [block, component, 64]; edges are repeated to whole blocks."""
    h, w, _ = px.shape
    padded = np.pad(px, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    ycc = padded @ YCC.T - np.array([128.0, 0, 0])
    rows, cols = padded.shape[0] // 8, padded.shape[1] // 8
    blocks = ycc.reshape(rows, 8, cols, 8, 3).transpose(0, 2, 4, 1, 3).reshape(rows * cols, 3, 8, 8)
    return np.rint((DCT @ blocks @ DCT.T).reshape(-1, 3, 64) / np.stack(tables)).astype(np.int64)[:, :, ZIGZAG]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.frexp(np.abs(v).astype(np.float64))[1]


def _huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Code and length of each of 256 symbols, numbers of codes of each length to 16, and symbols in order of their codes.

    One more symbol takes the code of ones alone, which must not stand for anything.
    """
    heap = [(int(n), s, (s,)) for s, n in enumerate(counts) if n] + [(0, 256, (256,))]
    heapq.heapify(heap)
    depth = dict.fromkeys((s for _, s, _ in heap), 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (*a[2], *b[2])))
    bits = [0] * 258
    for d in depth.values():
        bits[d] += 1
    for i in range(257, 16, -1):
        while bits[i]:
            # Two of the longest codes: one takes their parent's place, a shorter code parts in two for the other.
            j = i - 2
            while not bits[j]:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    bits[max(i for i in range(17) if bits[i])] -= 1
    order = sorted((s for s in depth if s < 256), key=lambda s: (depth[s], s))
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at = value = 0
    for n in range(1, 17):
        for s in order[at : at + bits[n]]:
            code[s], length[s] = value, n
            value += 1
        at += bits[n]
        value <<= 1
    return code, length, bits[1:17], order


def _tokens(coefficients: np.ndarray) -> tuple[np.ndarray, ...]:
    """Table (0, 1: first values of luminance and colour; 2, 3: the others), symbol, further bits and their number, in file order."""
    n = len(coefficients)
    first = np.diff(coefficients[:, :, 0], axis=0, prepend=np.zeros((1, 3), np.int64)).reshape(-1)
    rest = coefficients.reshape(3 * n, 64)
    block = np.arange(3 * n)
    at, k = np.nonzero(rest[:, 1:])
    k = k + 1
    before = np.where(np.concatenate([[True], at[1:] != at[:-1]]), 0, np.concatenate([[0], k[:-1]])) if len(k) else k
    run, value = k - before - 1, rest[at, k]
    last = np.zeros(3 * n, np.int64)
    last[at] = k  # in order, so the last one stays
    ended = block[last < 63]
    zeros = np.repeat(np.arange(len(k)), run // 16)  # sixteen zeros each

    def part(blocks, place, table, symbol, v):
        size = _size(v)
        more = np.where(v < 0, v + (1 << size) - 1, v)
        return 128 * blocks + place, np.where(blocks % 3 == 0, 0, 1) + table, symbol, more, size

    none = lambda x: np.zeros(len(x), np.int64)
    parts = [
        part(block, none(block), 0, _size(first), first),
        part(at[zeros], 2 * k[zeros] - 1, 2, none(zeros) + 0xF0, none(zeros)),
        part(at, 2 * k, 2, (run % 16) * 16 + _size(value), value),
        part(ended, none(ended) + 127, 2, none(ended), none(ended)),
    ]
    key, *columns = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(key, kind="stable")
    return tuple(c[order] for c in columns)


def jpeg(px: np.ndarray, quality: int = 90) -> bytes:
    """An RGB image (height, width, 3) of bytes as a JPEG file, colours at full resolution."""
    h, w, _ = px.shape
    tables = [_table(LUMINANCE, quality), _table(CHROMINANCE, quality)]
    table, symbol, more, size = _tokens(_coefficients(px, [tables[0], tables[1], tables[1]]))
    codes = [_huffman(np.bincount(symbol[table == t], minlength=256)) for t in range(4)]
    code, length = (np.stack([c[i] for c in codes]) for i in (0, 1))
    bits = length[table, symbol] + size
    values = code[table, symbol] << size | more
    ends = np.cumsum(bits)
    place = np.repeat(ends, bits) - 1 - np.arange(ends[-1])
    stream = (np.repeat(values, bits) >> place) & 1
    stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.int64)])
    data = np.packbits(stream.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")

    def segment(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0]))
    out += b"".join(segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables))
    out += segment(0xC0, frame)
    for t, (_, _, counts, order) in enumerate(codes):
        out += segment(0xC4, bytes([(t // 2) << 4 | t % 2]) + bytes(counts) + bytes(order))
    return out + segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + data + b"\xff\xd9"
