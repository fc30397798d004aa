"""Byte codecs of blocks and the probe for data that will not shrink."""

from __future__ import annotations

import zlib

import pyarrow as pa

from .scalars import BROTLI, LEVELS

# Least size probed, bytes sampled, least share that a sample keeps.
PROBE_FROM, PROBE_BYTES, PROBE_KEEPS = 4096, 256 << 10, 0.97


def compress(mode: str, data: bytes) -> bytes:
    """Brotli at the mode's level; store keeps the bytes. An unknown mode is an error."""
    if mode == "store":
        return data
    if mode not in BROTLI:
        raise ValueError(f"unknown mode: {mode}")
    return pa.Codec("brotli", compression_level=BROTLI[mode]).compress(data, asbytes=True)


def decompress(mode: str, data: bytes, raw_size: int) -> bytes:
    return data if mode == "store" else pa.Codec("brotli").decompress(data, raw_size, asbytes=True)


def deflate(data: bytes, level: int) -> bytes:
    """Raw deflate at a level of 0 to 9; 0 keeps the bytes."""
    level = max(0, min(9, level))
    if not level:
        return data
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def probe_sample(data: bytes) -> bytes:
    """All, or a third of the sample from each of the start, the centred middle and the end."""
    if len(data) <= PROBE_BYTES:
        return data
    third = PROBE_BYTES // 3
    middle = len(data) // 2 - third // 2
    return data[:third] + data[middle : middle + third] + data[len(data) - third :]


def looks_incompressible(data: bytes) -> bool:
    if len(data) < PROBE_FROM:
        return False
    sample = probe_sample(data)
    return len(deflate(sample, 1)) >= PROBE_KEEPS * len(sample)


def pack_block(mode: str, data: bytes) -> tuple[bytes, bool]:
    """A block's payload, and whether it is stored: in store mode, for dense data, or where packing gains nothing."""
    if mode == "store" or looks_incompressible(data):
        return data, True
    packed = compress(mode, data)
    return (data, True) if len(packed) >= len(data) else (packed, False)


__all__ = ["LEVELS", "compress", "decompress", "deflate", "looks_incompressible", "pack_block", "probe_sample"]
