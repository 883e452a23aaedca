"""Finding log files: what is read, what is skipped and why, and in which order."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from dataclasses import dataclass, field

from tributary.sources.codecs import codec_of, open_decoded

#: Folders and endings that hold no logs.
SKIPPED_DIRS = frozenset(".git .svn .hg node_modules .terraform __pycache__ .venv vendor".split())
SKIPPED_ENDINGS = frozenset(".duckdb .db .sqlite .sqlite3 .zip .tar .7z .png .jpg .jpeg .gif .pdf .ico .so .dylib .dll .exe .a .o .class .jar .pyc .wasm .mp4 .mov .mp3 .woff .woff2 .ttf".split())
COMPRESSED = (".gz", ".zst", ".zstd", ".xz", ".bz2")
MOST_BYTES = 4 << 30
SNIFF_BYTES, MOST_NULS = 8000, 0.01


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    mtime_ns: int
    codec: str | None = None

    @property
    def fingerprint(self) -> str:
        return f"{self.path}:{self.size}:{self.mtime_ns}"


@dataclass
class Listing:
    files: list[Found] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)


def bare_name(path: str) -> str:
    """Base name without the ending of a compression."""
    name = os.path.basename(path)
    return next((name[: -len(e)] for e in COMPRESSED if name.lower().endswith(e)), name)


def rotation(path: str) -> tuple[str, str, int]:
    """Folder, name without rotation number, and minus the number: older rotations come first."""
    name = bare_name(path)
    m = re.fullmatch(r"(.+)\.(\d+)", name)
    return os.path.dirname(path), m[1] if m else name, -int(m[2]) if m else 0


def logical_source(path: str) -> str:
    """Name of the program that a file belongs to: no compression, rotation number or log ending."""
    name = rotation(path)[1]
    return next((name[: -len(e)] for e in (".log", ".txt", ".out", ".err") if name.endswith(e) and len(name) > len(e)), name)


def looks_binary(head: bytes) -> bool:
    return bool(head) and head[:SNIFF_BYTES].count(0) > MOST_NULS * len(head[:SNIFF_BYTES])


def looks_document(head: bytes) -> bool:
    """A JSON document over several lines, not JSON lines."""
    first = head.split(b"\n", 1)[0].strip()
    if not first.startswith((b"{", b"[")):
        return False
    try:
        json.loads(first)
        return False
    except ValueError:
        return b"\n" in head and first in (b"{", b"[") or first.endswith((b"{", b"[", b","))


def _glob(pattern: str) -> re.Pattern:
    return re.compile(fnmatch.translate(pattern.replace("[^", "[!")))


def walk(root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> Listing:
    """Files below ``root`` (a file is taken as it is), in reading order; links to folders are not followed."""
    out = Listing()
    root = os.path.realpath(root)
    if os.path.isfile(root):
        out.files.append(_found(root))
        return out
    if not os.path.isdir(root):
        out.skipped.append((root, "does not exist"))
        return out
    wanted, unwanted = [_glob(p) for p in include], [_glob(p) for p in exclude]
    real: dict[str, str] = {}
    candidates = []
    for folder, dirs, names in os.walk(root, followlinks=False):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED_DIRS)
        candidates += [os.path.join(folder, n) for n in sorted(names)]
    for path in sorted(candidates, key=os.path.islink):  # a file itself goes before links to it
        why = _reason(path, wanted, unwanted, most_bytes)
        target = os.path.realpath(path)
        if why is None and target in real:
            why = f"the same file as {real[target]}"
        if why is not None:
            out.skipped.append((path, why))
            continue
        real[target] = path
        out.files.append(_found(path))
    out.files.sort(key=lambda f: rotation(f.path))
    out.skipped.sort()
    return out


def walk_all(paths: list[str], **options) -> Listing:
    """Several paths as one listing; a file that is reached twice is read once."""
    out, seen = Listing(), set()
    for path in paths:
        part = walk(path, **options)
        out.skipped += part.skipped
        for f in part.files:
            if os.path.realpath(f.path) not in seen:
                seen.add(os.path.realpath(f.path))
                out.files.append(f)
    return out


def _found(path: str) -> Found:
    stat = os.stat(path)
    with open(path, "rb") as f:
        return Found(path, stat.st_size, stat.st_mtime_ns, codec_of(f.read(8)))


def _reason(path: str, wanted: list, unwanted: list, most_bytes: int) -> str | None:
    name = os.path.basename(path)
    if os.path.islink(path) and not os.path.exists(path):
        return "a broken link"
    if not os.path.isfile(path):
        return "not a file"
    if name.startswith("."):
        return "hidden"
    if os.path.splitext(bare_name(path))[1].lower() in SKIPPED_ENDINGS:
        return "its ending is not of a log"
    if wanted and not any(p.match(name) for p in wanted):
        return "not included"
    if any(p.match(name) for p in unwanted):
        return "excluded"
    try:
        size = os.path.getsize(path)
        if not size:
            return "empty"
        with open(path, "rb") as f:
            codec = codec_of(f.read(8))
        if codec is None and size > most_bytes:
            return f"larger than {most_bytes} bytes"
        with open_decoded(path, codec) as f:
            head = f.read(64 << 10)
    except (OSError, EOFError, ValueError) as problem:
        return f"cannot be read: {problem}"
    if codec is None and looks_binary(head):
        return "binary"
    return "a JSON document" if looks_document(head) else None
