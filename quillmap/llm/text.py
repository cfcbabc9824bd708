"""Byte-level text helpers shared by the operators of this package.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D, which is what
``bytes.split()`` splits on; ``bytes.lower()`` touches A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes looked at in one go; longer texts are walked in overlapping slices.
SLICE_BYTES = 1 << 20

_MIX = np.uint32(2654435761)


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty and lone surrogates survive."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered."""
    return encode(text).lower().split()


def gram_bins(raw: bytes, n: int, bits: int) -> Iterator[np.ndarray]:
    """Hash bins of all byte n-grams (n is 3 or 4), slice by slice."""
    step = SLICE_BYTES
    for start in range(0, max(len(raw) - n + 1, 0), step):
        b = np.frombuffer(raw, np.uint8, min(step + n - 1, len(raw) - start), start).astype(np.uint32)
        code = b[: len(b) - n + 1].copy()
        for k in range(1, n):
            code <<= np.uint32(8)
            code |= b[k : len(b) - n + 1 + k]
        code *= _MIX
        code >>= np.uint32(32 - bits)
        yield code


def gram_counts(raw: bytes, n: int, bits: int) -> np.ndarray:
    """Counts of the hashed byte n-grams of a whole text, 2**bits of them."""
    out = np.zeros(1 << bits, np.int64)
    for code in gram_bins(raw, n, bits):
        out += np.bincount(code, minlength=1 << bits)
    return out
