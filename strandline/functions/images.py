"""Decoders of file-system images and archives by their structure alone; see ``formats`` for what a decoder is.

Every decoder reads the structures it needs at the places they name, and gives the regular files; what cannot be read, lies
outside the content or runs in a circle makes the whole image invalid, so that chance signatures give nothing.
"""

from __future__ import annotations

import lzma
import stat
import struct
import zlib
from collections.abc import Callable, Iterator

Found = tuple[int, list[tuple[str, bytes | None]]] | None


class _Bad(ValueError):
    """The image contradicts itself."""


def _cut(c: bytes, at: int, size: int) -> bytes:
    if at < 0 or size < 0 or at + size > len(c):
        raise _Bad
    return c[at : at + size]


def _guarded(decode: Callable[[bytes, int], tuple[int, list]]) -> Callable[[bytes, int], Found]:
    def safe(c: bytes, at: int) -> Found:
        try:
            end, files = decode(c, at)
        except (ValueError, struct.error, zlib.error, lzma.LZMAError, IndexError, EOFError, OverflowError):
            return None
        return (end, files) if end <= len(c) else None

    return safe


def _walk(root, children: Callable[[object], Iterator[tuple[str, bool, object]]], read: Callable[[object], bytes]) -> list[tuple[str, bytes]]:
    """Files below a directory, whose ``children`` are (name, is a directory, handle); a directory met twice is an error."""
    out, stack, met = [], [("", root)], {root}
    while stack:
        path, node = stack.pop()
        for name, is_directory, handle in children(node):
            if is_directory:
                if handle in met:
                    raise _Bad
                met.add(handle)
                stack.append((f"{path}{name}/", handle))
            else:
                out.append((path + name, read(handle)))
    return sorted(out)


@_guarded
def iso9660(c: bytes, at: int):
    start = at - 32769
    head = _cut(c, start + 32768, 2048)
    if head[0] != 1:
        raise _Bad
    blocks, block = struct.unpack_from("<I", head, 80)[0], struct.unpack_from("<H", head, 128)[0]
    entry = lambda r: (struct.unpack_from("<I", r, 2)[0], struct.unpack_from("<I", r, 10)[0])

    def children(node):
        data, p = _cut(c, start + node[0] * block, node[1]), 0
        while p < len(data):
            size = data[p]
            if not size:
                p = (p // block + 1) * block
                continue
            record = data[p : p + size]
            name = record[33 : 33 + record[32]]
            rest = record[33 + record[32] + (record[32] + 1) % 2 :]
            k = rest.find(b"NM")
            if k >= 0 and k + 5 <= len(rest):
                name = rest[k + 5 : k + rest[k + 2]]
            if name not in (b"\x00", b"\x01", b".", b".."):
                yield name.split(b";")[0].decode("utf-8", "replace"), bool(record[25] & 2), entry(record)
            p += size

    return start + blocks * block, _walk(entry(head[156:190]), children, lambda f: _cut(c, start + f[0] * block, f[1]))


@_guarded
def romfs(c: bytes, at: int):
    size = struct.unpack_from(">I", c, at + 8)[0]
    image = _cut(c, at, size)
    name_at = lambda p: image[p : image.index(0, p)]
    padded = lambda p: p + (len(name_at(p)) + 16) // 16 * 16

    def children(node):
        p, met = node, set()
        while p:
            if p in met:
                raise _Bad
            met.add(p)
            following, info, _ = struct.unpack_from(">III", image, p)
            name = name_at(p + 16).decode("utf-8", "replace")
            if following & 7 == 1 and name not in (".", ".."):
                yield name, True, info
            elif following & 7 == 2:
                yield name, False, p
            p = following & ~15

    def read(p):
        return _cut(image, padded(p + 16), struct.unpack_from(">I", image, p + 8)[0])

    return at + size, _walk(padded(16), children, read)


@_guarded
def cramfs(c: bytes, at: int):
    order = "<" if c[at : at + 4] == b"\x45\x3d\xcd\x28" else ">"
    size = struct.unpack_from(order + "I", c, at + 4)[0]
    if order == ">" or _cut(c, at + 16, 16) != b"Compressed ROMFS":
        raise _Bad
    image = _cut(c, at, size)

    def inode(p):
        mode, _, sized, placed = struct.unpack_from("<HHII", image, p)
        return mode, sized & 0xFFFFFF, (placed & 63) * 4, (placed >> 6) * 4

    def children(node):
        _, length, _, p = node
        end = p + length
        while p < end:
            own = inode(p)
            name = _cut(image, p + 12, own[2]).rstrip(b"\x00").decode("utf-8", "replace")
            if stat.S_ISDIR(own[0]) or stat.S_ISREG(own[0]):
                yield name, stat.S_ISDIR(own[0]), own
            p += 12 + own[2]

    def read(own):
        _, length, _, p = own
        n = -(-length // 4096)
        ends, out, from_ = struct.unpack_from(f"<{n}I", image, p), [], p + 4 * n
        for to in ends:
            out.append(zlib.decompress(_cut(image, from_, to - from_)) if to > from_ else b"\x00" * 4096)
            from_ = to
        return b"".join(out)[:length]

    return at + size, _walk(inode(64), children, read)


def _mapped_blocks(direct: tuple[int, ...], levels: tuple[int, ...], per: int, read: Callable[[int], tuple[int, ...]]) -> Iterator[int]:
    """Numbers of the blocks of a file: the direct ones, then those behind one, two and more levels of tables."""

    def below(block: int, level: int) -> Iterator[int]:
        if not level:
            yield block
        elif not block:
            yield from [0] * per**level
        else:
            for x in read(block):
                yield from below(x, level - 1)

    yield from direct
    for level, block in enumerate(levels, 1):
        yield from below(block, level)


def _joined(c: bytes, start: int, block: int, size: int, numbers: Iterator[int]) -> bytes:
    out, left = [], size
    while left > 0:
        k = next(numbers, None)
        if k is None:
            raise _Bad
        n = min(left, block)
        out.append(_cut(c, start + k * block, n) if k else b"\x00" * n)
        left -= n
    return b"".join(out)


@_guarded
def minix(c: bytes, at: int):
    start = at - 0x410
    inodes, zones, imap, zmap, _, log = struct.unpack_from("<6H", c, start + 1024)
    if log or not inodes or start < 0:
        raise _Bad
    table = start + (2 + imap + zmap) * 1024

    def inode(k):
        if not 1 <= k <= inodes:
            raise _Bad
        return struct.unpack_from("<HHIIBB9H", c, table + (k - 1) * 32)

    def data(k):
        own = inode(k)
        pointers = lambda b: struct.unpack_from("<512H", c, start + b * 1024)
        return _joined(c, start, 1024, own[2], _mapped_blocks(own[6:13], own[13:15], 512, pointers))

    def children(k):
        entries = data(k)
        for p in range(0, len(entries), 32):
            child, name = struct.unpack_from("<H", entries, p)[0], entries[p + 2 : p + 32].rstrip(b"\x00")
            if child and name not in (b".", b".."):
                mode = inode(child)[0]
                if stat.S_ISDIR(mode) or stat.S_ISREG(mode):
                    yield name.decode("utf-8", "replace"), stat.S_ISDIR(mode), child

    return start + zones * 1024, _walk(1, children, data)


@_guarded
def ext2(c: bytes, at: int):
    start = at - 0x438
    if start < 0:
        raise _Bad
    top = _cut(c, start + 1024, 264)
    inodes, blocks, first, log, per_group = (struct.unpack_from("<I", top, p)[0] for p in (0, 4, 20, 24, 40))
    block = 1024 << log
    wide = struct.unpack_from("<H", top, 88)[0] if struct.unpack_from("<I", top, 76)[0] else 128
    if log > 6 or not per_group or not wide or wide < 128:
        raise _Bad

    def inode(k):
        if not 1 <= k <= inodes:
            raise _Bad
        group, place = divmod(k - 1, per_group)
        table = struct.unpack_from("<I", c, start + (first + 1) * block + group * 32 + 8)[0]
        p = start + table * block + place * wide
        mode, size, flags = struct.unpack_from("<H", c, p)[0], struct.unpack_from("<I", c, p + 4)[0], struct.unpack_from("<I", c, p + 32)[0]
        if flags & 0x80000:
            raise _Bad
        return mode, size, struct.unpack_from("<15I", c, p + 40)

    def data(k):
        _, size, own = inode(k)
        pointers = lambda b: struct.unpack_from(f"<{block // 4}I", c, start + b * block)
        return _joined(c, start, block, size, _mapped_blocks(own[:12], own[12:], block // 4, pointers))

    def children(k):
        entries, p = data(k), 0
        while p + 8 <= len(entries):
            child, size, n = struct.unpack_from("<IHB", entries, p)
            name = entries[p + 8 : p + 8 + n]
            if size < 8:
                raise _Bad
            if child and name not in (b".", b".."):
                mode = inode(child)[0]
                if stat.S_ISDIR(mode) or stat.S_ISREG(mode):
                    yield name.decode("utf-8", "replace"), stat.S_ISDIR(mode), child
            p += size

    return start + blocks * block, _walk(2, children, data)


@_guarded
def squashfs(c: bytes, at: int):
    _, _, _, block, _, packer, _, _, _, major, _, root, used = struct.unpack_from("<5I6H2Q", c, at)
    _, _, inode_table, directory_table, fragment_table = struct.unpack_from("<5Q", c, at + 48)
    if major != 4 or packer not in (1, 2, 4):
        raise _Bad
    image = _cut(c, at, used)

    def plain(data: bytes) -> bytes:
        return zlib.decompress(data) if packer == 1 else lzma.decompress(data)

    def meta(table: int, offset: int, size: int, skip: int = 0) -> bytes:
        """``size`` bytes of a table from the place (block, offset) on."""
        p, out = table + skip, b""
        while len(out) < offset + size:
            head = struct.unpack_from("<H", image, p)[0]
            data = _cut(image, p + 2, head & 0x7FFF)
            out += data if head & 0x8000 else plain(data)
            p += 2 + (head & 0x7FFF)
        return out[offset : offset + size]

    def inode(ref):
        skip, offset = ref
        kind = struct.unpack("<H", meta(inode_table, offset, 2, skip))[0]
        if kind == 1:
            index, _, size, place, _ = struct.unpack("<IIHHI", meta(inode_table, offset + 16, 16, skip))
            return kind, index, size, place
        if kind == 8:
            _, size, index, _, _, place, _ = struct.unpack("<IIIIHHI", meta(inode_table, offset + 16, 24, skip))
            return 1, index, size, place
        if kind == 2:
            begin, fragment, place, size = struct.unpack("<4I", meta(inode_table, offset + 16, 16, skip))
            n, behind = size // block + (fragment == 0xFFFFFFFF and size % block > 0), offset + 32
        elif kind == 9:
            begin, size, _, _, fragment, place, _ = struct.unpack("<QQQ4I", meta(inode_table, offset + 16, 40, skip))
            n, behind = size // block + (fragment == 0xFFFFFFFF and size % block > 0), offset + 56
        else:
            return kind, 0, 0, 0
        return 2, begin, size, (fragment, place, struct.unpack(f"<{n}I", meta(inode_table, behind, 4 * n, skip)))

    def children(ref):
        _, index, size, place = inode(ref)
        data, p = meta(directory_table, place, max(size - 3, 0), index), 0
        while p < len(data):
            n, skip, _ = struct.unpack_from("<III", data, p)
            p += 12
            for _ in range(n + 1):
                offset, _, kind, length = struct.unpack_from("<HhHH", data, p)
                if kind in (1, 2):
                    yield data[p + 8 : p + 9 + length].decode("utf-8", "replace"), kind == 1, (skip, offset)
                p += 9 + length

    def stored(p: int, size: int) -> bytes:
        data = _cut(image, p, size & 0xFFFFFF)
        return data if size & 0x1000000 else plain(data)

    def read(ref):
        _, p, size, (fragment, place, sizes) = inode(ref)
        out = []
        for s in sizes:
            out.append(stored(p, s) if s else b"\x00" * block)
            p += s & 0xFFFFFF
        if fragment != 0xFFFFFFFF:
            table = struct.unpack_from("<Q", image, fragment_table + fragment // 512 * 8)[0]
            begin, length, _ = struct.unpack("<QII", meta(table, fragment % 512 * 16, 16))
            out.append(stored(begin, length)[place : place + size % block])
        return b"".join(out)[:size]

    return at + used, _walk((root >> 16, root & 0xFFFF), children, read)


@_guarded
def jffs2(c: bytes, at: int):
    order, p = ("<" if c[at : at + 2] == b"\x85\x19" else ">"), at
    names: dict[int, tuple[int, int, str, int]] = {}
    parts: dict[int, list[tuple[int, int, bytes]]] = {}
    sizes: dict[int, tuple[int, int]] = {}
    while p + 12 <= len(c) and struct.unpack_from(order + "H", c, p)[0] == 0x1985:
        kind, total, crc = struct.unpack_from(order + "HII", c, p + 2)
        if total < 12 or (zlib.crc32(c[p : p + 8], 0xFFFFFFFF) ^ 0xFFFFFFFF) != crc:
            raise _Bad
        node = _cut(c, p, total)
        if kind == 0xE001:
            parent, version, own, _, n, what = struct.unpack_from(order + "IIIIBB", node, 12)
            if own not in names or names[own][0] < version:
                names[own] = version, parent, node[40 : 40 + n].decode("utf-8", "replace"), what
        elif kind == 0xE002:
            own, version = struct.unpack_from(order + "II", node, 12)
            size, offset, packed, plain = (struct.unpack_from(order + "I", node, q)[0] for q in (28, 44, 48, 52))
            data = node[68 : 68 + packed]
            if node[56] == 6:
                data = zlib.decompress(data)
            elif node[56] == 1:
                data = b"\x00" * plain
            elif node[56]:
                raise _Bad
            parts.setdefault(own, []).append((version, offset, data))
            sizes[own] = max(sizes.get(own, (0, 0)), (version, size))
        p += (total + 3) // 4 * 4
    if not names:
        raise _Bad

    def path(own):
        out, met = [], set()
        while own in names and own not in met:
            met.add(own)
            _, parent, name, _ = names[own]
            out.append(name)
            own = parent
        return "/".join(reversed(out))

    files = []
    for own, (_, _, _, what) in names.items():
        if what == 8:
            data = bytearray(sizes.get(own, (0, 0))[1])
            for _, offset, part in sorted(parts.get(own, [])):
                data[offset : offset + len(part)] = part
            files.append((path(own), bytes(data[: sizes.get(own, (0, 0))[1]])))
    return min(p, len(c)), sorted(files)


@_guarded
def cabinet(c: bytes, at: int):
    size, files_at, folders, n, flags = (struct.unpack_from(f, c, at + p)[0] for f, p in (("<I", 8), ("<I", 16), ("<H", 26), ("<H", 28), ("<H", 30)))
    if flags or size < 36 or not n:
        raise _Bad
    image, plain = _cut(c, at, size), []
    for k in range(folders):
        p, blocks, packing = struct.unpack_from("<IHH", image, 36 + 8 * k)
        out = b""
        for _ in range(blocks):
            packed, length = struct.unpack_from("<HH", image, p + 4)
            data = _cut(image, p + 8, packed)
            if packing & 15 == 1:
                if data[:2] != b"CK":
                    raise _Bad
                data = zlib.decompressobj(-15, zdict=out[-32768:]).decompress(data[2:])
            elif packing & 15:
                raise _Bad
            if len(data) != length:
                raise _Bad
            out += data
            p += 8 + packed
        plain.append(out)
    files, p = [], files_at
    for _ in range(n):
        length, offset, folder = struct.unpack_from("<IIH", image, p)
        end = image.index(0, p + 16)
        files.append((image[p + 16 : end].decode("utf-8", "replace").replace("\\", "/"), _cut(plain[folder], offset, length)))
        p = end + 1
    return at + size, files


@_guarded
def compressed(c: bytes, at: int):
    """A file of variable-width codes for strings met before, up to the end of the content. Codes come in groups of eight;
    the rest of a group in which the width changes or the table is cleared is padding."""
    widest, clears = c[at + 2] & 31, c[at + 2] & 128
    if not 9 <= widest <= 16:
        raise _Bad
    fresh = [bytes([k]) for k in range(256)] + ([b""] if clears else [])
    table, width, last, out, p = list(fresh), 9, None, [], at + 3
    while p < len(c):
        group = c[p : p + width]
        number, n = int.from_bytes(group, "little"), 8 * len(group) // width
        p += width
        for k in range(n):
            code = number >> k * width & (1 << width) - 1
            if clears and code == 256:
                table, width, last = list(fresh), 9, None
                break
            if code > len(table) or code == len(table) and last is None or last is None and code > 255:
                raise _Bad
            word = table[code] if code < len(table) else last + last[:1]
            out.append(word)
            if last is not None and len(table) < 1 << widest:
                table.append(last + word[:1])
            last = word
            if len(table) == 1 << width and width < widest:
                width += 1
                break
    if not out:
        raise _Bad
    return len(c), [("compress", b"".join(out))]


IMAGES: dict[str, Callable[[bytes, int], Found]] = {
    "iso9660": iso9660, "romfs": romfs, "cramfs_le": cramfs, "minix": minix, "ext2": ext2, "squashfs2": squashfs, "jffs2_le": jffs2, "jffs2_be": jffs2, "cab": cabinet, "compress": compressed,
}
