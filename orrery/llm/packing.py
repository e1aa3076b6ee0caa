"""Arrays and strings as compressed bytes, so that a block of rows travels as one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2^32, as four planes of bytes: the upper ones are mostly zero and cost next to nothing."""
    return squeeze(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def pack_strings(x: list[str]) -> bytes:
    lengths = pack_numbers(np.fromiter(map(len, x), np.int64, len(x)))
    return len(lengths).to_bytes(8, "little") + lengths + squeeze("".join(x).encode())


def unpack_strings(data: bytes) -> list[str]:
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(unpack_numbers(data[8 : 8 + n])).tolist()
    text = unsqueeze(data[8 + n :]).decode()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
