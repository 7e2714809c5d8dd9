"""Block-compressed files (BGZF) and their tabix and CSI indexes.

A file is a row of gzip members of at most 64 kB of data, each with its own
size in its header.  A virtual offset is a block's place in the file, shifted left by
16 bits, plus a place in the block's data.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs

_MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of data in a block that is written.
BLOCK = 65_280
#: Bytes asked of the file system at once.
FETCH = 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def files_of(path: str, endings: tuple[str, ...]) -> list[str]:
    """The files at a path: itself, or those of a folder that end so, by name."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(inner))
    base = path.rstrip("/")
    return sorted(f"{base}/{x.base_name}" for x in found if x.type == pafs.FileType.File and x.base_name.endswith(endings) and not x.base_name.startswith((".", "_")))


def size_of(path: str) -> int:
    fs, inner = file_system(path)
    return fs.get_file_info(inner).size


def exists(path: str) -> bool:
    fs, inner = file_system(path)
    return fs.get_file_info(inner).type == pafs.FileType.File


def is_bgzf(path: str) -> bool:
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        return _block_size(f.read_at(18, 0), 0) > 0 if f.size() >= 18 else False


def _block_size(data: bytes, at: int) -> int:
    """Size of the block whose header is at ``at``; 0 where there is none."""
    if data[at : at + 4] != _MAGIC or at + 12 > len(data):
        return 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    k, stop = at + 12, at + 12 + extra
    while k + 6 <= min(stop, len(data)):
        name, length = data[k : k + 2], struct.unpack_from("<H", data, k + 2)[0]
        if name == b"BC" and length == 2:
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + length
    return 0


class Blocks:
    """Blocks of a file from a place on; ``read`` counts them."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        self.size, self.read = self.file.size(), 0
        self._at, self._held = 0, b""

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _bytes(self, at: int, n: int) -> bytes:
        if not (self._at <= at and at + n <= self._at + len(self._held)):
            self._held, self._at = self.file.read_at(min(max(n, FETCH), self.size - at), at), at
        return self._held[at - self._at : at - self._at + n]

    def first_from(self, at: int) -> int:
        """Place of the first block that starts at ``at`` or later; the file's size if none does.

        The bytes of a header may occur in compressed data by chance, so the block after it must have one too.
        """
        while at + 18 <= self.size:
            data = self._bytes(at, min(FETCH, self.size - at))
            k = data.find(_MAGIC)
            if k < 0:
                at += max(1, len(data) - 3)
                continue
            n = _block_size(self._bytes(at + k, min(32, self.size - at - k)), 0)
            after = at + k + n
            if n and (after == self.size or _block_size(self._bytes(after, min(32, self.size - after)), 0)):
                return at + k
            at += k + 1
        return self.size

    def blocks(self, at: int) -> Iterator[tuple[int, int, bytes]]:
        """(place, place of the next, data) of blocks from the block at ``at`` on."""
        while at < self.size:
            n = _block_size(self._bytes(at, min(512, self.size - at)), 0)
            if not n:
                raise ValueError(f"no block at {at}: the file is cut or not block-compressed")
            raw = self._bytes(at, n)
            extra = struct.unpack_from("<H", raw, 10)[0]
            self.read += 1
            yield at, at + n, zlib.decompress(raw[12 + extra : -8], -15)
            at += n


def lines(source: Blocks, begin: int, skip: int | None, end: int, end_skip: int | None) -> Iterator[bytes]:
    """Lines that begin in a range of blocks.

    ``begin`` and ``end`` are places in the file.  With ``skip`` and ``end_skip`` the range is from
    one virtual offset to another, both at line starts.  Without ``skip`` the line in which the
    first block begins is left to the range before, which, without ``end_skip``, reads on to its end.
    """
    at = begin if skip is not None else source.first_from(begin)
    if end_skip is None:
        end = source.first_from(end) if end < source.size else source.size
    rest, skipping = b"", skip is None and begin > 0
    over = False
    for place, _, data in source.blocks(at):
        if end_skip is not None:
            if place > end or (place == end and end_skip == 0):
                break
            data = data[:end_skip] if place == end else data
        if skip and place == begin:
            data = data[skip:]
        over = end_skip is None and place >= end
        if skipping:
            if over:
                return
            k = data.find(b"\n")
            if k < 0:
                continue
            data, skipping = data[k + 1 :], False
        if over:  # the last line goes on to its end
            k = data.find(b"\n")
            if k < 0:
                rest += data
                continue
            yield rest + data[:k]
            return
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        yield from parts
    if rest and not skipping:
        yield rest


# ---- indexes


def bin_of(begin: int, end: int, shift: int = 14, depth: int = 5) -> int:
    """Smallest bin that holds [begin, end)."""
    end -= 1
    level, first = depth, ((1 << depth * 3) - 1) // 7
    while level > 0:
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
        level -= 1
        shift += 3
        first -= 1 << level * 3
    return 0


def bins_over(begin: int, end: int, shift: int = 14, depth: int = 5) -> Iterator[range]:
    """Bins that may hold records over [begin, end), as ranges by level."""
    end -= 1
    shift += depth * 3
    first = 0
    for level in range(depth + 1):
        yield range(first + (begin >> shift), first + (end >> shift) + 1)
        first += 1 << level * 3
        shift -= 3


class Index:
    """A tabix (.tbi) or CSI (.csi) index: names, and by name the chunks of each bin."""

    def __init__(self, raw: bytes):
        at = 0

        def take(form: str):
            nonlocal at
            values = struct.unpack_from("<" + form, raw, at)
            at += struct.calcsize("<" + form)
            return values if len(values) > 1 else values[0]

        kind = raw[:4]
        at = 4
        self.shift, self.depth, self.names = 14, 5, []
        if kind == b"TBI\x01":
            n_ref = take("i")
            *_, length = take("7i")
            self.names = raw[at : at + length].decode().split("\0")[:-1]
            at += length
        elif kind == b"CSI\x01":
            self.shift, self.depth, length = take("3i")
            if length >= 28:
                self.names = raw[at + 28 : at + length].decode().split("\0")[:-1]
            at += length
            n_ref = take("i")
        else:
            raise ValueError("neither a tabix nor a CSI index")
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.floor: list[list[int] | dict[int, int]] = []
        last = ((1 << (self.depth + 1) * 3) - 1) // 7
        for _ in range(n_ref):
            bins, low = {}, {}
            for _ in range(take("i")):
                number = take("I")
                if kind == b"CSI\x01":
                    low[number] = take("Q")
                n = take("i")
                chunks = [struct.unpack_from("<QQ", raw, at + 16 * k) for k in range(n)]
                at += 16 * n
                if number <= last:
                    bins[number] = chunks
            self.bins.append(bins)
            if kind == b"TBI\x01":
                n = take("i")
                self.floor.append(list(struct.unpack_from(f"<{n}Q", raw, at)))
                at += 8 * n
            else:
                self.floor.append(low)

    def _least(self, ref: int, begin: int) -> int:
        """No record over ``begin`` or later starts before this virtual offset."""
        low = self.floor[ref]
        if isinstance(low, list):
            k = min(begin >> self.shift, len(low) - 1)
            return low[k] if k >= 0 else 0
        number = ((1 << self.depth * 3) - 1) // 7 + (begin >> self.shift)
        while number not in low and number:
            number = (number - 1) >> 3
        return low.get(number, 0)

    def chunks(self, ref: int, begin: int, end: int | None) -> list[tuple[int, int]]:
        """Ranges of virtual offsets, in order and apart, that hold all records over [begin, end)."""
        if not 0 <= ref < len(self.bins):
            return []
        most = 1 << self.shift + 3 * self.depth
        end = most if end is None else min(end, most)
        least, bins = self._least(ref, begin), self.bins[ref]
        found = sorted(c for over in bins_over(begin, end, self.shift, self.depth) for b in (over if len(over) < len(bins) else (x for x in bins if x in over)) for c in bins.get(b, ()) if c[1] > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            a = max(a, least)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out


def read_index(path: str) -> Index | None:
    """The index beside a file, if there is one."""
    for ending in (".tbi", ".csi"):
        if exists(path + ending):
            with Blocks(path + ending) as source:
                return Index(b"".join(data for _, _, data in source.blocks(0)))
    return None


# ---- writing


class Writer:
    """Writes blocks to a stream; ``tell`` is the virtual offset of what comes next."""

    def __init__(self, out):
        self.out, self.held, self.place = out, bytearray(), 0

    def tell(self) -> int:
        return self.place << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK:
            self._block(bytes(self.held[:BLOCK]))
            del self.held[:BLOCK]

    def _block(self, data: bytes) -> None:
        packed = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packed.compress(data) + packed.flush()
        head = _MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<HccHH", 6, b"B", b"C", 2, len(body) + 25)
        block = head + body + struct.pack("<II", zlib.crc32(data), len(data))
        self.out.write(block)
        self.place += len(block)

    def close(self) -> None:
        if self.held:
            self._block(bytes(self.held))
            self.held.clear()
        self.out.write(END)


class IndexBuilder:
    """Collects where the records of a sorted file lie; gives a tabix or a CSI index."""

    def __init__(self):
        self.names: list[str] = []
        self.bins: list[dict[int, list[list[int]]]] = []
        self.windows: list[list[int]] = []

    def add(self, name: str, begin: int, end: int, start: int, stop: int) -> None:
        """A record of [begin, end), from 0, between two virtual offsets."""
        if not self.names or self.names[-1] != name:
            if name in self.names:
                raise ValueError(f"records of {name} are not together")
            self.names.append(name)
            self.bins.append({})
            self.windows.append([])
        chunks = self.bins[-1].setdefault(bin_of(begin, end), [])
        if chunks and chunks[-1][1] >> 16 == start >> 16:
            chunks[-1][1] = stop
        else:
            chunks.append([start, stop])
        low = self.windows[-1]
        last = (end - 1) >> 14
        while len(low) <= last:
            low.append(start)

    def tabix(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n in self.names)
        out = [b"TBI\x01", struct.pack("<8i", len(self.names), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
        for bins, low in zip(self.bins, self.windows, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)))
                out += [struct.pack("<QQ", *c) for c in chunks]
            out.append(struct.pack(f"<i{len(low)}Q", len(low), *low))
        return b"".join(out)

    def csi(self, contigs: list[str]) -> bytes:
        """Of a file whose records name contigs by their place in ``contigs``."""
        out = [b"CSI\x01", struct.pack("<4i", 14, 5, 0, len(contigs))]
        for name in contigs:
            k = self.names.index(name) if name in self.names else -1
            bins, low = (self.bins[k], self.windows[k]) if k >= 0 else ({}, [])
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                level, first = 5, 4681
                while number < first:
                    level -= 1
                    first = ((1 << level * 3) - 1) // 7
                window = (number - first) << 3 * (5 - level)
                out.append(struct.pack("<IQi", number, low[min(window, len(low) - 1)], len(chunks)))
                out += [struct.pack("<QQ", *c) for c in chunks]
        return b"".join(out)
