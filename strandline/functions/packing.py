"""Writers of the byte formats around one payload: inputs for round trips through checks, decoders and carvers.

Each is the smallest file of its kind that holds the payload, written from the format's structure and not with the code
that reads it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable

_FILE, _DIRECTORY = 0o100644, 0o040755


def _tar(x: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        info = tarfile.TarInfo("text")
        info.size = len(x)
        t.addfile(info, io.BytesIO(x))
    return out.getvalue()


def _zip(x: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("text"), x, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _cpio(x: bytes) -> bytes:
    out = b""
    for name, data, mode in ((b"text", x, _FILE), (b"TRAILER!!!", b"", 0)):
        out += b"070701" + b"".join(b"%08X" % n for n in (1, mode, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(name) + 1, 0)) + name + b"\x00"
        out += b"\x00" * (-len(out) % 4) + data
        out += b"\x00" * (-len(out) % 4)
    return out


def _ar(x: bytes) -> bytes:
    return b"!<arch>\n" + b"%-16s%-12d%-6d%-6d%-8s%-10d`\n" % (b"text/", 0, 0, 0, b"644", len(x)) + x + b"\n" * (len(x) % 2)


def _rpm(x: bytes) -> bytes:
    header = b"\x8e\xad\xe8\x01" + b"\x00" * 4 + struct.pack(">II", 0, 0)
    return b"\xed\xab\xee\xdb\x03\x00" + b"\x00" * 90 + header + header + gzip.compress(_cpio(x), mtime=1)


def _lzip(x: bytes) -> bytes:
    raw = lzma.compress(x, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])
    return b"LZIP\x01\x10" + raw + struct.pack("<IQQ", zlib.crc32(x), len(x), 26 + len(raw))


def _xar(x: bytes) -> bytes:
    packed = zlib.compress(x)
    toc = zlib.compress(b'<xar><toc><file><name>text</name><data><offset>0</offset><length>%d</length><encoding style="application/x-gzip"/></data></file></toc></xar>' % len(packed))
    return b"xar!" + struct.pack(">HHQQI", 28, 1, len(toc), 0, 0) + toc + packed


def _sparse(x: bytes) -> bytes:
    return struct.pack("<IHHHHIIII", 0xED26FF3A, 1, 0, 28, 12, 1, len(x), 1, 0) + struct.pack("<HHII", 0xCAC1, 0, len(x), 12 + len(x)) + x


def _ihex(x: bytes) -> bytes:
    line = lambda kind, at, d: b":" + (r := bytes([len(d), at >> 8 & 255, at & 255, kind]) + d).hex().upper().encode() + b"%02X\n" % (-sum(r) & 255)
    return b"".join(line(0, i, x[i : i + 16]) for i in range(0, len(x), 16)) + line(1, 0, b"")


def _uu(x: bytes) -> bytes:
    return b"begin 644 text\n" + b"".join(binascii.b2a_uu(x[i : i + 45]) for i in range(0, len(x), 45)) + b"`\nend\n"


def _plf(x: bytes) -> bytes:
    return b"PLF!" + struct.pack("<III", 10, 16, 12) + struct.pack("<III", 3, len(x), 0) + x + b"\x00" * (-len(x) % 4)


def _lzw(x: bytes) -> bytes:
    table, width, out, group, last = {bytes([k]): k for k in range(256)}, 9, b"\x1f\x9d\x90", [], b""
    free = 257

    def flush(whole: bool) -> bytes:
        number = sum(c << k * width for k, c in enumerate(group))
        size = width if whole else -(-len(group) * width // 8)
        group.clear()
        return number.to_bytes(size, "little")

    codes = []
    for byte in x:
        word = last + bytes([byte])
        if word in table:
            last = word
            continue
        codes.append(table[last])
        table[word] = len(table) + 1
        last = bytes([byte])
        if len(table) >= 1 << 15:
            break
    else:
        codes.append(table[last])
    rest = x[len(_expanded(codes)) :]
    for i, code in enumerate(codes):
        group.append(code)
        if len(group) == 8:
            out += flush(True)
        # The reader has one string less than codes.
        if free + i == 1 << width and width < 16:
            out += flush(True) if group else b""
            width += 1
    if rest:
        group.append(256)
        return out + flush(True) + _lzw(rest)[3:]
    return out + (flush(False) if group else b"")


def _expanded(codes: list[int]) -> bytes:
    table, last, out = [bytes([k]) for k in range(256)] + [b""], None, []
    for code in codes:
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last is not None:
            table.append(last + word[:1])
        last = word
    return b"".join(out)


def _cabinet(x: bytes) -> bytes:
    blocks, before = b"", b""
    parts = [x[i : i + 32768] for i in range(0, len(x), 32768)]
    for part in parts:
        packer = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=before) if before else zlib.compressobj(9, zlib.DEFLATED, -15)
        data = b"CK" + packer.compress(part) + packer.flush()
        blocks += struct.pack("<IHH", 0, len(data), len(part)) + data
        before = part
    files = struct.pack("<IIHHHH", len(x), 0, 0, 0, 0, 32) + b"text\x00"
    at = 36 + 8 + len(files)
    return b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, at + len(blocks), 0, 44, 0, 3, 1, 1, 1, 0, 0, 0) + struct.pack("<IHH", at, len(parts), 1) + files + blocks


def _iso(x: bytes) -> bytes:
    both = lambda n: struct.pack("<I", n) + struct.pack(">I", n)

    def record(block: int, size: int, flags: int, name: bytes) -> bytes:
        own = b"\x00" + both(block) + both(size) + b"\x00" * 7 + bytes([flags]) + b"\x00\x00" + struct.pack("<HH", 1, 256) + bytes([len(name)]) + name
        own += b"\x00" * (len(name) % 2 == 0)
        return bytes([len(own) + 1]) + own

    blocks = 20 + -(-len(x) // 2048)
    top = b"\x01CD001\x01".ljust(80, b"\x00") + both(blocks)
    top = top.ljust(128, b"\x00") + struct.pack("<HH", 2048, 0x0008)
    top = top.ljust(156, b"\x00") + record(18, 2048, 2, b"\x00")
    inner = (record(18, 2048, 2, b"\x00") + record(18, 2048, 2, b"\x01") + record(19, 2048, 2, b"D")).ljust(2048, b"\x00")
    below = (record(19, 2048, 2, b"\x00") + record(18, 2048, 2, b"\x01") + record(20, len(x), 0, b"TEXT;1")).ljust(2048, b"\x00")
    return b"\x00" * 32768 + top.ljust(2048, b"\x00") + b"\xffCD001\x01".ljust(2048, b"\x00") + inner + below + x + b"\x00" * (-len(x) % 2048)


def _romfs(x: bytes) -> bytes:
    name = b"text".ljust(16, b"\x00")
    body = struct.pack(">IIII", 2, 0, len(x), 0) + name + x + b"\x00" * (-len(x) % 16)
    return b"-rom1fs-" + struct.pack(">II", 32 + len(body), 0) + b"disk".ljust(16, b"\x00") + body


def _cramfs(x: bytes) -> bytes:
    inode = lambda mode, size, names, at: struct.pack("<HHII", mode, 0, size, names // 4 | at // 4 << 6)
    parts = [zlib.compress(x[i : i + 4096]) for i in range(0, len(x), 4096)]
    at, ends = 92 + 4 * len(parts), []
    for p in parts:
        at += len(p)
        ends.append(at)
    body = inode(_DIRECTORY, 16, 0, 76) + inode(_FILE, len(x), 4, 92) + b"text" + b"".join(struct.pack("<I", e) for e in ends) + b"".join(parts)
    size = (64 + len(body) + 3) // 4 * 4
    head = struct.pack("<IIII", 0x28CD3D45, size, 0, 0) + b"Compressed ROMFS" + struct.pack("<IIII", 0, 0, len(parts), 2) + b"disk".ljust(16, b"\x00")
    return (head + body).ljust(size, b"\x00")


def _zones(x: bytes, first: int, block: int, direct: int, width: str) -> tuple[list[int], list[int], bytes]:
    """Numbers of direct blocks, of one or two levels of tables, and the blocks themselves from ``first`` on."""
    n, per = -(-len(x) // block), block // struct.calcsize(width)
    numbers = list(range(first, first + n))
    data, free = x + b"\x00" * (n * block - len(x)), first + n
    own, rest, tables = numbers[:direct], numbers[direct:], []
    packed = lambda xs: b"".join(struct.pack(width, k) for k in xs).ljust(block, b"\x00")
    if rest:
        tables.append(free)
        data += packed(rest[:per])
        free, rest = free + 1, rest[per:]
    if rest:
        tables.append(free)
        inner = [rest[i : i + per] for i in range(0, len(rest), per)]
        data += packed(range(free + 1, free + 1 + len(inner))) + b"".join(packed(i) for i in inner)
    return own, tables, data


def _minix(x: bytes) -> bytes:
    own, tables, data = _zones(x, 7, 1024, 7, "<H")
    inode = lambda mode, size, zones: struct.pack("<HHIIBB9H", mode, 0, size, 0, 0, 1, *(zones + [0] * 9)[:9])
    zones = 7 + len(data) // 1024
    entry = lambda k, name: struct.pack("<H", k) + name.ljust(30, b"\x00")
    top = struct.pack("<HHHHHHIH", 32, zones, 1, 1, 6, 0, 1 << 28, 0x138F).ljust(1024, b"\x00")
    table = (inode(_DIRECTORY, 96, [6]) + inode(_FILE, len(x), own + [0] * (7 - len(own)) + tables)).ljust(2048, b"\x00")
    return b"\x00" * 1024 + top + b"\x00" * 2048 + table[:2048] + (entry(1, b".") + entry(1, b"..") + entry(2, b"text")).ljust(1024, b"\x00") + data


def _ext2(x: bytes) -> bytes:
    own, tables, data = _zones(x, 9, 1024, 12, "<I")
    blocks = 9 + len(data) // 1024
    inode = lambda mode, size, zones: (struct.pack("<HHI", mode, 0, size).ljust(40, b"\x00") + struct.pack("<15I", *(zones + [0] * 15)[:15])).ljust(128, b"\x00")
    entry = lambda k, name, size: (struct.pack("<IHBB", k, size, len(name), 0) + name).ljust(size, b"\x00")
    top = struct.pack("<6I", 16, blocks, 0, 0, 0, 1) + struct.pack("<IIIII", 0, 0, 8192, 8192, 16) + struct.pack("<II", 0, 0) + struct.pack("<HHH", 0, 0, 0xEF53)
    group = struct.pack("<III", 3, 4, 5).ljust(32, b"\x00")
    table = b"\x00" * 128 + inode(_DIRECTORY, 1024, [8]) + b"\x00" * 9 * 128 + inode(_FILE, len(x), own + [0] * (12 - len(own)) + tables)
    listing = entry(2, b".", 12) + entry(2, b"..", 12) + entry(12, b"text", 1000)
    image = b"\x00" * 1024 + top.ljust(1024, b"\x00") + group.ljust(1024, b"\x00") + b"\x00" * 2048 + table.ljust(3072, b"\x00") + listing
    return image + data


def _squashfs(x: bytes) -> bytes:
    block = 131072
    packed = [zlib.compress(x[i : i + block]) for i in range(0, len(x), block)]
    meta = lambda d: struct.pack("<H", len(z := zlib.compress(d))) + z if len(d) <= 8192 else b""
    begin = 96
    head = lambda kind, number: struct.pack("<HHHHII", kind, 0o755, 0, 0, 0, number)
    own = head(2, 1) + struct.pack("<IIII", begin, 0xFFFFFFFF, 0, len(x)) + b"".join(struct.pack("<I", len(p)) for p in packed)
    listing = struct.pack("<III", 0, 0, 1) + struct.pack("<HhHH", 0, 0, 2, 3) + b"text"
    root = head(1, 2) + struct.pack("<IIHHI", 0, 2, len(listing) + 3, 0, 3)
    data = b"".join(packed)
    inodes, listings, ids = meta(own + root), meta(listing), meta(struct.pack("<I", 0))
    at = [begin + len(data)]
    for part in (inodes, listings, ids):
        at.append(at[-1] + len(part))
    used, none = at[3] + 8, (1 << 64) - 1
    top = struct.pack("<5I6H2Q", 0x73717368, 2, 0, block, 0, 1, 17, 0, 1, 4, 0, len(own), used)
    return top + struct.pack("<6Q", at[3], none, at[0], at[1], none, none) + data + inodes + listings + ids + struct.pack("<Q", at[2])


def _jffs2(x: bytes) -> bytes:
    crc = lambda d: zlib.crc32(d, 0xFFFFFFFF) ^ 0xFFFFFFFF

    def node(kind: int, body: bytes) -> bytes:
        head = struct.pack("<HHI", 0x1985, kind, 12 + len(body))
        return (head + struct.pack("<I", crc(head)) + body).ljust((12 + len(body) + 3) // 4 * 4, b"\x00")

    out = node(0xE001, struct.pack("<IIIIBB2xII", 1, 1, 2, 0, 4, 8, 0, 0) + b"text")
    for k, at in enumerate(range(0, len(x), 4096)):
        part = x[at : at + 4096]
        data = zlib.compress(part)
        out += node(0xE002, struct.pack("<IIIHHIIIIIIIBBHII", 2, k + 1, _FILE, 0, 0, len(x), 0, 0, 0, at, len(data), len(part), 6, 6, 0, 0, 0) + data)
    return out


def _swapped(x: bytes) -> bytes:
    """An image of a kernel with the two bytes of each word exchanged."""
    plain = b"Uncompressing Linux..." + gzip.compress(x, mtime=1)
    plain += b"\x00" * (len(plain) % 2)
    out = bytearray(plain)
    out[0::2], out[1::2] = plain[1::2], plain[0::2]
    return bytes(out)


def _xored(x: bytes) -> bytes:
    plain = gzip.compress(x, mtime=1)
    plain += b"\x00" * (-len(plain) % 16 + 512)
    key = bytes(range(33, 49))
    return bytes(a ^ b for a, b in zip(plain, key * (len(plain) // 16)))


#: Formats whose payload comes out again when they are unpacked, by the names of the decoders.
CONTAINERS: dict[str, Callable[[bytes], bytes]] = {
    "gzip": lambda x: gzip.compress(x, mtime=1), "bz2": bz2.compress, "xz": lzma.compress, "lzma_alone": lambda x: lzma.compress(x, lzma.FORMAT_ALONE), "lzip": _lzip, "tar1": _tar, "zip": _zip, "ar": _ar, "cpio1": _cpio, "rpm": _rpm,
    "xar": _xar, "android-sparse": _sparse, "androidbackup": lambda x: b"ANDROID BACKUP\n1\n1\nnone\n" + zlib.compress(x), "plf": _plf, "compress": _lzw, "cab": _cabinet, "iso9660": _iso, "romfs": _romfs, "cramfs_le": _cramfs, "minix": _minix, "ext2": _ext2,
    "squashfs2": _squashfs, "jffs2_le": _jffs2,
}
#: Encodings of a whole content, and what hides another file.
ENCODED = {"base64": base64.encodebytes, "ihex": _ihex, "uuencode": _uu, "byteswap": _swapped, "xor": _xored}


def _png(x: bytes) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\x00" * 13) + chunk(b"tEXt", x) + chunk(b"IEND", b"")


def _blocks(x: bytes, most: int, head: Callable[[bytes], bytes]) -> bytes:
    return b"".join(head(x[i : i + most]) + x[i : i + most] for i in range(0, len(x), most))


def _gif(x: bytes) -> bytes:
    return b"GIF89a" + b"\x01\x00\x01\x00\x00\x00\x00" + b"\x21\xfe" + _blocks(x, 255, lambda p: bytes([len(p)])) + b"\x00\x3b"


def _jpeg(x: bytes) -> bytes:
    return b"\xff\xd8" + _blocks(x, 60000, lambda p: b"\xff\xfe" + struct.pack(">H", len(p) + 2)) + b"\xff\xd9"


def _ogg(x: bytes) -> bytes:
    return _blocks(x, 255, lambda p: b"OggS" + b"\x00" * 22 + b"\x01" + bytes([len(p)]))


def _font(kind: bytes) -> Callable[[bytes], bytes]:
    return lambda x: kind + struct.pack(">HHHH", 1, 16, 0, 0) + b"name" + struct.pack(">III", 0, 28, len(x)) + x + b"\x00" * (-len(x) % 4)


def _elf(x: bytes) -> bytes:
    head = b"\x7fELF\x02\x01\x01" + b"\x00" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 64 + len(x), 0, 64, 0, 0, 64, 1, 0)
    return head + x + b"\x00" * 64


def _java(x: bytes) -> bytes:
    utf = lambda d: b"\x01" + struct.pack(">H", len(d)) + d
    parts = [x[i : i + 60000] for i in range(0, len(x), 60000)]
    pool = [utf(b"a/B"), b"\x07\x00\x01", *map(utf, parts)]
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, len(pool) + 1) + b"".join(pool) + struct.pack(">7H", 1, 2, 0, 0, 0, 0, 0)


#: Formats that are carved whole by their structure; their sizes follow from that of the payload.
CARVED: dict[str, Callable[[bytes], bytes]] = {
    "png": _png, "gif89": _gif, "jpeg": _jpeg, "bmp": lambda x: b"BM" + struct.pack("<III", 26 + len(x), 0, 26) + b"\x00" * 12 + x, "riff": lambda x: b"RIFF" + struct.pack("<I", 4 + len(x)) + b"WAVE" + x,
    "aiff": lambda x: b"FORM" + struct.pack(">I", 4 + len(x)) + b"AIFF" + x, "ogg": _ogg, "pdf": lambda x: b"%PDF-1.4\n" + x + b"\n%%EOF\n", "otf": _font(b"OTTO"), "ttf": _font(b"\x00\x01\x00\x00"),
    "woff": lambda x: b"wOFF" + struct.pack(">II", 0, 44 + len(x)) + b"\x00" * 32 + x, "elf": _elf, "swf": lambda x: b"CWS\x0a" + struct.pack("<I", len(x) + 8) + zlib.compress(x, 0),
    "ico": lambda x: struct.pack("<HHH", 0, 1, 1) + bytes([16, 16, 0, 0]) + struct.pack("<HHII", 1, 32, len(x), 22) + x, "icc": lambda x: struct.pack(">I", 128 + len(x)).ljust(36, b"\x00") + b"acsp" + b"\x00" * 88 + x, "java": _java,
}


def program(symbols: list[str] = (), needed: list[str] = (), soname: str = "", information: list[tuple[str, str]] = ()) -> bytes:
    """A 64-bit ELF file that defines symbols, needs libraries, has a name and module information."""
    strings, places = bytearray(b"\x00"), {}
    for name in (*symbols, *needed, *([soname] if soname else [])):
        if name not in places:
            places[name] = len(strings)
            strings += name.encode() + b"\x00"
    dynamic = b"".join(struct.pack("<qQ", 1, places[n]) for n in needed) + (struct.pack("<qQ", 14, places[soname]) if soname else b"") + struct.pack("<qQ", 0, 0)
    table = b"\x00" * 24 + b"".join(struct.pack("<IBBHQQ", places[n], 0x12, 0, 1, 0, 0) for n in symbols)
    modinfo = b"".join(f"{k}={v}".encode() + b"\x00" for k, v in information)
    names = [b"", b".dynstr", b".dynamic", b".dynsym", b".modinfo", b".shstrtab"]
    own = b"\x00".join(names) + b"\x00"
    data, rows = b"", []
    for name, kind, body in zip(names, (0, 3, 6, 11, 1, 3), (b"", bytes(strings), dynamic, table, modinfo, own)):
        rows.append(struct.pack("<IIQQQQIIQQ", own.index(b"\x00" + name + b"\x00") + 1 if name else 0, kind, 0, 0, 64 + len(data), len(body), 0, 0, 1, 0))
        data += body
    return b"\x7fELF\x02\x01\x01" + b"\x00" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 64 + len(data), 0, 64, 0, 0, 64, len(names), 5) + data + b"".join(rows)


def java_class(name: str, methods: list[str], strings: list[str]) -> bytes:
    """A Java class with methods and string constants."""
    pool: list[bytes] = []

    def put(entry: bytes) -> int:
        pool.append(entry)
        return len(pool)

    utf = lambda x: put(b"\x01" + struct.pack(">H", len(x.encode())) + x.encode())
    this, kind = put(b"\x07" + struct.pack(">H", utf(name.replace(".", "/")))), utf("()V")
    members = b"".join(struct.pack(">4H", 1, utf(m), kind, 0) for m in methods)
    for x in strings:
        put(b"\x08" + struct.pack(">H", utf(x)))
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, len(pool) + 1) + b"".join(pool) + struct.pack(">5H", 1, this, 0, 0, 0) + struct.pack(">H", len(methods)) + members + struct.pack(">H", 0)


def _dex(x: bytes) -> bytes:
    body = struct.pack("<I", 0x70 + len(x)).rjust(24, b"\x00").ljust(0x70 - 12, b"\x00") + x
    return b"dex\n035\x00" + struct.pack("<I", zlib.adler32(body)) + body


def _riff(kind: bytes) -> Callable[[bytes], bytes]:
    return lambda x: b"RIFF" + struct.pack("<I", 4 + len(x)) + kind + x


def _pages(x: bytes) -> bytes:
    n = -(-(100 + len(x)) // 512)
    return (b"SQLite format 3\x00" + struct.pack(">H", 512) + b"\x00" * 10 + struct.pack(">I", n) + b"\x00" * 68 + x).ljust(n * 512, b"\x00")


#: For each check the name of a file and a writer of its format.
CHECKED: dict[str, tuple[str, Callable[[bytes], bytes]]] = {
    "text": ("a.txt", lambda x: x.hex().encode()), "xml": ("a.xml", lambda x: b"<?xml version='1.0'?><a>" + x.hex().encode() + b"</a>"), "aiff": ("a.aiff", CARVED["aiff"]), "dex": ("a.dex", _dex), "odex": ("a.odex", lambda x: b"dey\n036\x00" + struct.pack("<I", 12) + x),
    "androidresource": ("resources.arsc", lambda x: struct.pack("<HHI", 2, 12, 8 + len(x)) + x), "androidxml": ("a.xml", lambda x: b"\x03\x00\x08\x00" + x), "bflt": ("a", lambda x: b"bFLT" + struct.pack(">IIII", 4, 64, 64, 64 + len(x)) + b"\x00" * 44 + x),
    "pak": ("a.pak", lambda x: struct.pack("<IIB", 4, 1, 1) + struct.pack("<HIHI", 1, 21, 0, 21 + len(x)) + x), "elf": ("a", _elf), "pe": ("a.exe", lambda x: b"MZ" + b"\x00" * 58 + struct.pack("<I", 64 + len(x)) + x + b"PE\x00\x00"), "ico": ("a.ico", CARVED["ico"]),
    "ihex": ("a.hex", lambda x: _ihex(x)[:-1]), "messagecatalog": ("a.mo", lambda x: b"\xde\x12\x04\x95" + x), "resourcefork": ("a", lambda x: b"\x00\x05\x16\x07" + b"\x00" * 20 + struct.pack(">HIII", 1, 2, 38, len(x)) + x),
    "rsacertificate": ("a.RSA", lambda x: b"\x30\x84" + struct.pack(">I", len(x)) + x), "sqlite3": ("a.db", _pages), "terminfo": ("a", lambda x: b"\x1a\x01" + struct.pack("<5h", 2, 0, 0, 0, 8) + b"t\x00" + b"\x00" * 8), "timezone": ("a", lambda x: b"TZif2" + b"\x00" * 15 + struct.pack(">6I", 0, 0, 0, 0, 1, 4) + b"\x00" * 6 + b"UTC\x00"),
    "wav": ("a.wav", _riff(b"WAVE")), "webp": ("a.webp", _riff(b"WEBP")), "vimswap": (".a.swp", lambda x: b"b0VIM 8.0" + x), "mp4": ("a.mp4", lambda x: struct.pack(">I", 8 + len(x)) + b"ftyp" + x),
    "certificate": ("a.pem", lambda x: b"-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(x) + b"-----END CERTIFICATE-----\n"),
}
#: Checks of a signature alone: a file of another kind differs at its start, of others it is cut off at its end.
BY_START = ("androidxml", "messagecatalog", "vimswap", "odex")


def spoilt(kind: str, whole: bytes) -> bytes:
    """A file for which the check of its kind must not hold."""
    return whole + b"\x00" if kind == "text" else whole[1:] if kind in BY_START else whole[:-1]
