"""Compression, by content and never by name."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from typing import BinaryIO

#: What compressed files begin with.
MAGIC = ((b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"\xfd7zXZ\x00", "xz"))


def codec_of(head: bytes) -> str | None:
    found = next((name for magic, name in MAGIC if head.startswith(magic)), None)
    return found or ("bzip2" if head[:3] == b"BZh" and head[3:4].isdigit() and head[3:4] != b"0" else None)


def decoded(raw: BinaryIO, codec: str | None) -> BinaryIO:
    if codec == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if codec == "bzip2":
        return bz2.BZ2File(raw)
    if codec == "xz":
        return lzma.LZMAFile(raw)
    if codec == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True, closefd=True))
    return raw


def open_decoded(path: str, codec: str | None) -> BinaryIO:
    return decoded(open(path, "rb"), codec)
