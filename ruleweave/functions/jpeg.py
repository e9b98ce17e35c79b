"""Baseline JPEG files to pixels: Huffman decoding block by block, all else in arrays."""

from __future__ import annotations

import struct

import numpy as np


def _zigzag() -> np.ndarray:
    """Place in a block, row by row, of each coefficient in the order of the file."""
    diagonals = sorted(((y + x, (x if (y + x) % 2 == 0 else y), y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([place for _, _, place in diagonals])


ZIGZAG = _zigzag()
#: Rows are cosine waves: pixels = WAVES.T @ coefficients @ WAVES.
WAVES = np.array([[(1 if u else 0.5**0.5) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of one stretch of entropy-coded data, without stuffed bytes; ones after its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        chunk = self.data[self.at : self.at + 8]
        self.at += 8
        chunk += b"\xff" * (8 - len(chunk))
        if self.at > len(self.data) + 64:
            raise ValueError("image data end too soon")
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(chunk, "big")
        self.n += 64

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if not found:
            raise ValueError("unknown code in image data")
        self.n -= found >> 8
        return found & 0xFF

    def number(self, size: int) -> int:
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        value = self.held >> self.n & ((1 << size) - 1)
        return value if value >> (size - 1) else value - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: length of the code that they begin with, and its symbol in the low byte."""
    table, code, k = [0] * 65536, 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[k : k + count]:
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
            code += 1
        k += count
        code <<= 1
    return table


def decode(content: bytes) -> np.ndarray:
    """Pixels of a file, rows by columns by channels (one or three). Raises ValueError for other kinds."""
    at, quant, codes, interval, frame, rgb = 2, {}, {}, 0, None, False
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise ValueError("no marker where one should be")
        mark = content[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", content, at + 2)
        body, at = content[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(float)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not height:
                raise ValueError("only 8-bit gray and colour JPEG files are supported")
            frame = height, width, [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8:
            raise ValueError("only baseline JPEG files are supported")
        elif mark == 0xDD:
            (interval,) = struct.unpack(">H", body[:2])
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
            rgb = body[11] == 0
        elif mark == 0xDA:
            if frame is None or body[0] != len(frame[2]):
                raise ValueError("only JPEG files of one scan are supported")
            tables = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            planes = _scan(content[at:], frame, tables, quant, codes, interval)
            return planes if rgb or planes.shape[2] == 1 else _colours(planes)
    raise ValueError("no image data")


def _scan(data: bytes, frame, tables, quant, codes, interval: int) -> np.ndarray:
    height, width, parts = frame
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # blocks of a lone part stand one by one
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    units = [(k, y, x) for k, (_, h, v, _) in enumerate(parts) for y in range(v) for x in range(h)]
    values = [np.zeros((down * p[2], across * p[1], 64)) for p in parts]
    read = [(codes[tables[p[0]] >> 4], codes[16 | tables[p[0]] & 15]) for p in parts]
    end = _data_end(data)
    stretches, n = _stretches(data[:end]), 0
    for stretch in stretches:
        bits, last = _Bits(stretch), [0] * len(parts)
        for _ in range(interval or across * down):
            if n == across * down:
                break
            row, col = divmod(n, across)
            n += 1
            for k, y, x in units:
                first, others = read[k]
                last[k] += bits.number(bits.symbol(first))
                block = values[k][row * parts[k][2] + y, col * parts[k][1] + x]
                block[0] = last[k]
                i = 1
                while i < 64:
                    found = bits.symbol(others)
                    if not found & 15 and found != 0xF0:
                        break
                    i += found >> 4
                    if i > 63:
                        raise ValueError("a block is too long")
                    block[i] = bits.number(found & 15)
                    i += 1
    if n < across * down:
        raise ValueError("image data end too soon")
    planes = []
    for (_, h, v, q), found in zip(parts, values):
        blocks = np.zeros_like(found)
        blocks[..., ZIGZAG] = found * quant[q]
        pixels = WAVES.T @ blocks.reshape(*found.shape[:2], 8, 8) @ WAVES + 128
        plane = pixels.transpose(0, 2, 1, 3).reshape(found.shape[0] * 8, found.shape[1] * 8)
        planes.append(plane.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)[:height, :width])
    return np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)


def _data_end(data: bytes) -> int:
    """Where the first marker stands that is neither a stuffed byte nor a restart."""
    at = data.find(b"\xff")
    while 0 <= at < len(data) - 1 and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
        at = data.find(b"\xff", at + 2)
    return at if at >= 0 else len(data)


def _stretches(data: bytes) -> list[bytes]:
    """Parts between restart markers."""
    out, begin, at = [], 0, data.find(b"\xff")
    while 0 <= at < len(data) - 1:
        if data[at + 1]:
            out.append(data[begin:at])
            begin = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[begin:]]


def _colours(planes: np.ndarray) -> np.ndarray:
    """RGB of luma and two colour differences, by the file format's fixed weights."""
    y, blue, red = (planes[..., k].astype(float) - (128 if k else 0) for k in range(3))
    out = np.stack([y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
