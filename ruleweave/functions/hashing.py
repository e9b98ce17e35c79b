"""Perceptual hashes of file contents: 64 bits of comparisons between neighbours."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PerceptualHashError
from . import jpeg

SAMPLES = 65
MAX_CHUNK = 256 << 20


def signed(value: int) -> int:
    """The same 64 bits as a BIGINT."""
    return value - (1 << 64) if value >> 63 else value


def falling_bits(samples: list[int]) -> int:
    """Bit i is set where sample i is larger than the next."""
    return signed(sum(1 << i for i, (a, b) in enumerate(zip(samples, samples[1:])) if a > b))


def video_hash(content: bytes) -> int:
    """65 bytes at even distances; 0 for an empty file."""
    if not content:
        return 0
    last = len(content) - 1
    return falling_bits([content[i * last // (SAMPLES - 1)] for i in range(SAMPLES)])


def audio_hash(content: bytes) -> int:
    """65 frames of a PCM WAV file at even distances, first channel; 0 without frames."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE" or len(content) < 12:
        raise PerceptualHashError("not a WAV file")
    at, channels, width, frames, start = 12, 1, 2, 0, 0
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        at += 8
        if name in (b"fmt ", b"data") and size > MAX_CHUNK:
            raise PerceptualHashError(f"WAV chunk of {size} bytes is too large")
        if name == b"data":
            start, frames = at, size // (channels * width)
            break
        if name == b"fmt ":
            if at + size > len(content):
                raise PerceptualHashError("WAV format chunk is cut short")
            if size >= 16:
                channels = max(1, struct.unpack_from("<H", content, at + 2)[0])
                width = max(1, struct.unpack_from("<H", content, at + 14)[0] // 8)
        at += size + size % 2  # chunks are padded to even sizes
    if not frames:
        return 0
    step = max(1, frames // SAMPLES)
    return falling_bits([_amplitude(content, start + min(i * step, frames - 1) * channels * width, width) for i in range(SAMPLES)])


def _amplitude(content: bytes, at: int, width: int) -> int:
    raw = content[at : at + width]
    if len(raw) < width:
        return 0
    if width in (2, 4):
        return int.from_bytes(raw, "little", signed=True)
    return raw[0] - 128 if width == 1 else raw[0]


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos with three lobes, columns first, as 8-bit values."""

    def weights(old: int, new: int) -> np.ndarray:
        ratio = old / new
        scale = max(ratio, 1.0)
        out = np.zeros((new, old))
        for i in range(new):
            centre = (i + 0.5) * ratio
            low, high = max(0, int(np.floor(centre - 3 * scale))), min(old, int(np.ceil(centre + 3 * scale)))
            x = (np.arange(low, high) + 0.5 - centre) / scale
            w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
            out[i, low:high] = w / w.sum()
        return out

    tall = weights(gray.shape[0], height) @ gray
    both = tall @ weights(gray.shape[1], width).T
    return np.clip(np.round(both), 0, 255).astype(np.uint8)


def gradient_hash(gray: np.ndarray, size: int = 8) -> int:
    """Bit row * size + column is set where a pixel of the reduced image is brighter than its right neighbour."""
    if size > 8:
        raise PerceptualHashError(f"hash size {size} is over 8, the most that 64 bits hold")
    small = resize(gray.astype(float), size + 1, size).astype(int)
    bits = small[:, :-1] > small[:, 1:]
    return signed(sum(1 << int(i) for i in np.flatnonzero(bits.ravel())))


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(int) @ np.array([2126, 7152, 722]) // 10000


def image_hash(content: bytes, size: int = 8) -> int:
    """dHash of a PNG (not interlaced), baseline JPEG or binary PGM / PPM file. Other formats go through
    Spark's image source and `pixel_hash`."""
    return gradient_hash(decode(content), size)


def decode(content: bytes) -> np.ndarray:
    """Gray values of an image file."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(content)
        if content[:3] == b"\xff\xd8\xff":
            pixels = jpeg.decode(content)
            return pixels[..., 0] if pixels.shape[2] == 1 else luma(pixels)
        if content[:2] in (b"P5", b"P6"):
            head = content.split(maxsplit=4)
            width, height, _ = map(int, head[1:4])
            n = 1 if content[:2] == b"P5" else 3
            data = np.frombuffer(content[-width * height * n :], np.uint8).reshape(height, width, n)
            return data[..., 0] if n == 1 else luma(data)
    except (ValueError, LookupError, struct.error, zlib.error) as e:
        raise PerceptualHashError(f"image cannot be decoded: {e}") from None
    raise PerceptualHashError("unknown image format")


def _png(content: bytes) -> np.ndarray:
    at, data, palette, head = 8, b"", None, None
    while at + 8 <= len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data += body
    width, height, depth, color, _, _, interlaced = head
    if interlaced:
        raise PerceptualHashError("interlaced PNG files are not supported")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    bits, step = channels * depth, max(1, channels * depth // 8)
    row = (width * bits + 7) // 8
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(raw[y, 0], raw[y, 1:], above, step)
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        out = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        out = (out @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * channels]
        if color == 0:
            out = out * (255 // ((1 << depth) - 1))
    pixels = out.reshape(height, width, channels)
    if color == 3:
        return luma(palette[pixels[..., 0]])
    return pixels[..., 0] if channels < 3 else luma(pixels)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], np.uint8)


def pixel_hash(image: Column, size: int = 8) -> Column:
    """dHash of a decoded `image` struct (Spark's image source: BGR rows), BIGINT; null where it has none."""

    @F.pandas_udf("bigint")
    def run(images: pd.DataFrame) -> pd.Series:
        out = []
        for height, width, channels, data in zip(images["height"], images["width"], images["nChannels"], images["data"]):
            if data is None or height <= 0:
                out.append(None)
                continue
            pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            out.append(gradient_hash(pixels[..., 0] if channels == 1 else luma(pixels[..., 2::-1]), size))
        return pd.Series(out, dtype="Int64")

    return run(image)


HASHERS = {"imagehash": image_hash, "audiohash": audio_hash, "videohash": video_hash}
