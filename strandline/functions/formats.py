"""Formats of binary files: signatures, checks that tag a file, and decoders that take contained files out.

Everything here works on bytes of one file and is called from Arrow batches on the executors. A decoder gets the
content and the offset of a signature and returns (end, [(name, bytes)]) or None if there is no valid file there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import io
import lzma
import re
import struct
import tarfile
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable

from strandline.functions.images import IMAGES

#: Bytes of a contained file that a row can hold; a larger one is found and named, with a null content.
LARGEST = 1 << 30

# Signatures of formats, and where in the format they lie if not at its start.
SIGNATURES: dict[str, bytes] = {
    "gzip": b"\x1f\x8b\x08", "bz2": b"BZh", "xz": b"\xfd7zXZ\x00", "lzma_alone": b"\x5d\x00\x00", "lzip": b"LZIP", "compress": b"\x1f\x9d", "zip": b"PK\x03\x04", "zipend": b"PK\x05\x06", "tar1": b"ustar\x00", "tar2": b"ustar  ",
    "ar": b"!<arch>\n", "cpio1": b"070701", "cpio2": b"070702", "cpio3": b"070707", "rpm": b"\xed\xab\xee\xdb", "xar": b"xar!", "7z": b"7z\xbc\xaf\x27\x1c", "rar": b"Rar!\x1a\x07", "arj": b"\x60\xea", "cab": b"MSCF", "chm": b"ITSF",
    "lzop": b"\x89LZO\x00\r\n\x1a\n", "lrzip": b"LRZI", "rzip": b"RZIP", "iso9660": b"CD001", "cramfs_le": b"\x45\x3d\xcd\x28", "cramfs_be": b"\x28\xcd\x3d\x45", "romfs": b"-rom1fs-", "ext2": b"\x53\xef", "minix": b"\x8f\x13",
    "squashfs1": b"sqsh", "squashfs2": b"hsqs", "squashfs3": b"qshs", "squashfs4": b"shsq", "jffs2_le": b"\x85\x19", "jffs2_be": b"\x19\x85", "ubi": b"UBI#", "upx": b"UPX!", "mswim": b"MSWIM\x00\x00\x00", "installshield": b"ISc(",
    "msi": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "pack200": b"\xca\xfe\xd0\x0d", "pe": b"MZ", "elf": b"\x7fELF", "bflt": b"bFLT", "dex": b"dex\n", "odex": b"dey\n", "java": b"\xca\xfe\xba\xbe", "java_serialized": b"\xac\xed\x00\x05",
    "android-sparse": b"\x3a\xff\x26\xed", "androidbackup": b"ANDROID BACKUP\n", "swf": b"CWS", "png": b"\x89PNG\r\n\x1a\n", "gif87": b"GIF87a", "gif89": b"GIF89a", "jpeg": b"\xff\xd8\xff", "bmp": b"BM", "riff": b"RIFF", "aiff": b"FORM",
    "ogg": b"OggS", "pdf": b"%PDF-", "otf": b"OTTO", "ttf": b"\x00\x01\x00\x00", "woff": b"wOFF", "icc": b"acsp", "plf": b"PLF!", "sqlite3": b"SQLite format 3\x00", "appledouble": b"\x00\x05\x16\x07", "certificate": b"-----BEGIN ",
}
CORRECTIONS = {"tar1": 257, "tar2": 257, "iso9660": 32769, "ext2": 0x438, "minix": 0x410, "icc": 36}
#: Formats that need a decoder of their own, which is not here: they are found and tagged, not unpacked.
FOUND_ONLY = ("7z", "arj", "chm", "cramfs_be", "installshield", "lrzip", "lzop", "msi", "pack200", "rar", "rzip", "squashfs1", "squashfs3", "squashfs4", "ubi", "upx", "mswim", "pe")


def offsets(content: bytes, names: tuple[str, ...] = tuple(SIGNATURES)) -> list[tuple[str, int]]:
    """All places of the signatures, as (name, offset), by name and offset."""
    out = []
    for name in names:
        mark, at = SIGNATURES[name], -1
        while (at := content.find(mark, at + 1)) >= 0:
            if name == "compress" and not (at + 2 < len(content) and 9 <= content[at + 2] & 0x1F <= 16):
                continue
            out.append((name, at))
    return out


# --- checks ---------------------------------------------------------------------------------------------------------

_TEXT = bytes(range(9, 14)) + bytes(range(32, 127))


def _riff(c: bytes, kind: bytes) -> bool:
    return c[:4] == b"RIFF" and c[8:12] == kind and len(c) >= 12 and struct.unpack_from("<I", c, 4)[0] + 8 == len(c)


def _xml(c: bytes) -> bool:
    head = c.removeprefix(b"\xef\xbb\xbf").lstrip()
    if not head.startswith(b"<?xml"):
        return False
    try:
        ET.fromstring(head)
    except ET.ParseError:
        return False
    return True


def _ihex(c: bytes) -> bool:
    lines = [x for x in c.split(b"\n") if x.strip()]
    if not lines:
        return False
    for line in lines:
        x = line.strip()
        if x.startswith(b"#"):
            continue
        try:
            if not x.startswith(b":") or sum(bytes.fromhex(x[1:].decode())) % 256:
                return False
        except ValueError:
            return False
    return True


def _sqlite(c: bytes) -> bool:
    if not c.startswith(SIGNATURES["sqlite3"]) or len(c) < 100:
        return False
    page = struct.unpack_from(">H", c, 16)[0]
    page = 65536 if page == 1 else page
    return page >= 512 and len(c) % page == 0 and struct.unpack_from(">I", c, 28)[0] in (0, len(c) // page)


def _pak(c: bytes) -> bool:
    if len(c) < 9:
        return False
    version, n, encoding = struct.unpack_from("<IIB", c)
    return version == 4 and encoding in (0, 1, 2) and 9 + 6 * (n + 1) <= len(c) and struct.unpack_from("<HI", c, 9 + 6 * n)[1] == len(c)


def _ico(c: bytes) -> bool:
    if len(c) < 6:
        return False
    zero, kind, n = struct.unpack_from("<HHH", c)
    if zero or kind not in (1, 2) or not n or 6 + 16 * n > len(c):
        return False
    return all((s := struct.unpack_from("<II", c, 6 + 16 * i + 8))[0] + s[1] <= len(c) for i in range(n))


def _dex(c: bytes) -> bool:
    return len(c) >= 0x70 and c[:4] == b"dex\n" and struct.unpack_from("<I", c, 32)[0] == len(c) and struct.unpack_from("<I", c, 8)[0] == zlib.adler32(c[12:])


def _terminfo(c: bytes) -> bool:
    if len(c) < 12 or c[:2] != b"\x1a\x01":
        return False
    names, flags, numbers, strings, table = struct.unpack_from("<hhhhh", c, 2)
    size = 12 + names + flags
    size += size % 2 + 2 * numbers + 2 * strings + table
    return min(names, flags, numbers, strings, table) >= 0 and size <= len(c)


def _tz(c: bytes) -> bool:
    if len(c) < 44 or c[:4] != b"TZif" or c[4:5] not in b"\x00234" or any(c[5:20]):
        return False
    isut, isstd, leap, times, types, chars = struct.unpack_from(">6I", c, 20)
    return types > 0 and 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut <= len(c)


def _appledouble(c: bytes) -> bool:
    if len(c) < 26 or not c.startswith(SIGNATURES["appledouble"]):
        return False
    n = struct.unpack_from(">H", c, 24)[0]
    return 26 + 12 * n <= len(c) and all((e := struct.unpack_from(">III", c, 26 + 12 * i))[1] + e[2] <= len(c) for i in range(n))


def _der(c: bytes) -> bool:
    if len(c) < 4 or c[0] != 0x30:
        return False
    if c[1] < 0x80:
        return 2 + c[1] == len(c)
    n = c[1] & 0x7F
    return 1 <= n <= 4 and 2 + n + int.from_bytes(c[2 : 2 + n]) == len(c)


def _certificate(c: bytes) -> bool:
    """A text that is one or more certificates in armour, from its first line to its last."""
    parts = re.findall(rb"-----BEGIN (?:X509 |TRUSTED )?CERTIFICATE-----\r?\n([A-Za-z0-9+/=\r\n]*)-----END (?:X509 |TRUSTED )?CERTIFICATE-----\r?\n", c)
    try:
        return bool(parts) and c.startswith(b"-----BEGIN ") and all(base64.b64decode(b"".join(p.split()), validate=True) for p in parts) and c.endswith(b"-----\n")
    except binascii.Error:
        return False


def elf_header(c: bytes) -> dict | None:
    """Class, byte order, type, machine and section table of an ELF file."""
    if len(c) < 52 or c[:4] != SIGNATURES["elf"] or c[4] not in (1, 2) or c[5] not in (1, 2):
        return None
    order, wide = "<>"[c[5] - 1], c[4] == 2
    if wide and len(c) < 64:
        return None
    kind, machine = struct.unpack_from(order + "HH", c, 16)
    at = struct.unpack_from(order + ("Q" if wide else "I"), c, 40 if wide else 32)[0]
    size, n, names = struct.unpack_from(order + "HHH", c, 58 if wide else 46)
    return {"order": order, "wide": wide, "type": kind, "machine": machine, "at": at, "size": size, "n": n, "names": names}


CHECKS: dict[str, Callable[[str, bytes], bool]] = {
    "xml": lambda n, c: _xml(c),
    "aiff": lambda n, c: c[:4] == b"FORM" and c[8:12] in (b"AIFF", b"AIFC") and struct.unpack_from(">I", c, 4)[0] + 8 == len(c),
    "dex": lambda n, c: _dex(c),
    "odex": lambda n, c: c[:4] == b"dey\n" and n.endswith(".odex") and len(c) >= 12 and struct.unpack_from("<I", c, 8)[0] < len(c),
    "androidresource": lambda n, c: n.endswith("resources.arsc") and len(c) >= 8 and struct.unpack_from("<HHI", c)[::2] == (2, len(c)),
    "androidxml": lambda n, c: n.endswith(".xml") and c[:4] == b"\x03\x00\x08\x00",
    "bflt": lambda n, c: len(c) >= 64 and c[:4] == b"bFLT" and struct.unpack_from(">I", c, 4)[0] == 4 and max(struct.unpack_from(">3I", c, 8)) <= len(c),
    "pak": lambda n, c: n.endswith(".pak") and _pak(c),
    "elf": lambda n, c: (h := elf_header(c)) is not None and h["at"] + h["size"] * h["n"] <= len(c),
    "pe": lambda n, c: c[:2] == b"MZ" and len(c) >= 64 and c[(p := struct.unpack_from("<I", c, 60)[0]) : p + 4] == b"PE\x00\x00",
    "ico": lambda n, c: n.endswith((".ico", ".cur", ".hdb")) and _ico(c),
    "ihex": lambda n, c: c[:1] in (b":", b"#") and _ihex(c),
    "messagecatalog": lambda n, c: n.endswith(".mo") and c[:4] in (b"\xde\x12\x04\x95", b"\x95\x04\x12\xde"),
    "resourcefork": lambda n, c: _appledouble(c),
    "rsacertificate": lambda n, c: n.endswith(".RSA") and _der(c),
    "sqlite3": lambda n, c: _sqlite(c),
    "terminfo": lambda n, c: _terminfo(c),
    "timezone": lambda n, c: _tz(c),
    "wav": lambda n, c: _riff(c, b"WAVE"),
    "webp": lambda n, c: _riff(c, b"WEBP"),
    "vimswap": lambda n, c: n.endswith(".swp") and c[:6] == b"b0VIM ",
    "certificate": lambda n, c: _certificate(c),
    "mp4": lambda n, c: c[4:8] == b"ftyp" and len(c) >= 8 and struct.unpack_from(">I", c)[0] <= len(c),
}


def tags_of(name: str, content: bytes | None) -> list[str]:
    """text or binary, and every check that holds; an empty or null content has the tag empty."""
    if not content:
        return ["empty"]
    out = ["binary" if content.translate(None, _TEXT) else "text"]
    for tag, check in CHECKS.items():
        try:
            if check(name or "", content):
                out.append(tag)
        except (struct.error, ValueError, IndexError):
            pass
    return out


# --- decoders -------------------------------------------------------------------------------------------------------

Found = tuple[int, list[tuple[str, bytes | None]]] | None


def _inflated(d, c: bytes, at: int) -> tuple[int, bytes | None] | None:
    """(end, content) of a stream from ``at`` on; the content is null beyond LARGEST, where only its end is looked for."""
    view, out, size = memoryview(c)[at:], [], 0
    step, waiting = 1 << 20, b""
    errors = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)
    p = 0
    try:
        while not d.eof:
            if not waiting and p >= len(view) and getattr(d, "needs_input", True):
                return None
            data = waiting or bytes(view[p : p + step])
            p += 0 if waiting else len(data)
            plain = d.decompress(data, LARGEST + 1)
            waiting = getattr(d, "unconsumed_tail", b"")
            size += len(plain)
            if size <= LARGEST:
                out.append(plain)
            else:
                out = []
    except errors:
        return None
    return at + p - len(d.unused_data), b"".join(out) if size <= LARGEST else None


def _inflating(new: Callable[[], object], name: str) -> Callable[[bytes, int], Found]:
    def decode(c: bytes, at: int) -> Found:
        found = _inflated(new(), c, at)
        return found and (found[0], [(name, found[1])])

    return decode


def _lzip(c: bytes, at: int) -> Found:
    if len(c) < at + 26 or c[at + 4] != 1:
        return None
    coded = c[at + 5]
    size = 1 << (coded & 0x1F)
    size -= (size // 16) * (coded >> 5)
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": max(size, 4096), "lc": 3, "lp": 0, "pb": 2}])
    try:
        out = d.decompress(c[at + 6 :], LARGEST)
    except lzma.LZMAError:
        return None
    end = len(c) - len(d.unused_data) if d.eof else len(c) - 20
    if end + 20 > len(c) or struct.unpack_from("<IQ", c, end) != (zlib.crc32(out), len(out)):
        return None
    return end + 20, [("lzip", out)]


def _tar(c: bytes, at: int) -> Found:
    at -= CORRECTIONS["tar1"]
    if at < 0:
        return None
    out = []
    try:
        with tarfile.open(fileobj=io.BytesIO(c[at:]), mode="r:") as t:
            for m in t:
                if m.isfile():
                    out.append((m.name, t.extractfile(m).read()))
            end = at + t.offset
    except (tarfile.TarError, OSError, ValueError, EOFError):
        return None
    while c[end : end + 512] == b"\x00" * 512:
        end += 512
    return end, out


def _zip(c: bytes, at: int) -> Found:
    stop = c.find(SIGNATURES["zipend"], at)
    if stop < 0 or stop + 22 > len(c):
        return None
    end = stop + 22 + struct.unpack_from("<H", c, stop + 20)[0]
    try:
        with zipfile.ZipFile(io.BytesIO(c[at:end])) as z:
            return end, [(i.filename, z.read(i) if i.file_size <= LARGEST else None) for i in z.infolist() if not i.is_dir() and not i.flag_bits & 1]
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError, EOFError, ValueError):
        return None


def encrypted_entries(content: bytes) -> list[tuple[str, int]]:
    """(name, crc) of the encrypted entries of a zip file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(i.filename, i.CRC) for i in z.infolist() if i.flag_bits & 1]
    except (zipfile.BadZipFile, OSError, ValueError):
        return []


def _ar(c: bytes, at: int) -> Found:
    p, out, long_ = at + 8, [], b""
    while p + 60 <= len(c) and c[p + 58 : p + 60] == b"`\n":
        name = c[p : p + 16].rstrip()
        try:
            size = int(c[p + 48 : p + 58])
        except ValueError:
            return None
        data = c[p + 60 : p + 60 + size]
        if len(data) < size:
            return None
        if name == b"//":
            long_ = data
        elif name not in (b"/", b"/SYM64/"):
            if name[:1] == b"/" and name[1:].isdigit():
                name = long_[int(name[1:]) :].split(b"\n")[0]
            out.append((name.rstrip(b"/").decode("utf-8", "replace"), data))
        p += 60 + size + size % 2
    return (min(p, len(c)), out) if p > at + 8 else None


def _cpio(c: bytes, at: int) -> Found:
    p, out = at, []
    while c[p : p + 6] in (b"070701", b"070702"):
        try:
            fields = [int(c[p + 6 + 8 * i : p + 14 + 8 * i], 16) for i in range(13)]
        except ValueError:
            return None
        mode, size, n = fields[1], fields[6], fields[11]
        name = c[p + 110 : p + 110 + n - 1]
        start = at + (p - at + 110 + n + 3) // 4 * 4
        if start + size > len(c) or not n:
            return None
        p = at + (start - at + size + 3) // 4 * 4
        if name == b"TRAILER!!!":
            return min(p, len(c)), out
        if mode & 0o170000 == 0o100000:
            out.append((name.decode("utf-8", "replace"), c[start : start + size]))
    return None


def _rpm(c: bytes, at: int) -> Found:
    p = at + 96
    for k in range(2):
        if c[p : p + 3] != b"\x8e\xad\xe8":
            return None
        n, size = struct.unpack_from(">II", c, p + 8)
        p += 16 + 16 * n + size
        if k == 0:
            p = at + (p - at + 7) // 8 * 8
    for mark, decode in ((b"\x1f\x8b", DECODERS["gzip"]), (b"\xfd7zXZ", DECODERS["xz"]), (b"BZh", DECODERS["bz2"]), (b"\x5d\x00\x00", DECODERS["lzma_alone"])):
        if c[p:].startswith(mark) and (got := decode(c, p)):
            inner = _cpio(got[1][0][1], 0)
            return (got[0], inner[1]) if inner else None
    return None


def _xar(c: bytes, at: int) -> Found:
    if at + 28 > len(c):
        return None
    head, _, packed, plain = struct.unpack_from(">HHQQ", c, at + 4)
    try:
        toc = ET.fromstring(zlib.decompress(c[at + head : at + head + packed]))
    except (zlib.error, ET.ParseError):
        return None
    heap, out, end = at + head + packed, [], at + head + packed
    for f in toc.iter("file"):
        data = f.find("data")
        if data is not None:
            offset, length = int(data.findtext("offset", "0")), int(data.findtext("length", "0"))
            raw = c[heap + offset : heap + offset + length]
            end = max(end, heap + offset + length)
            style = data.find("encoding")
            try:
                if style is not None and style.get("style") == "application/x-gzip":
                    raw = zlib.decompress(raw)
                elif style is not None and style.get("style") == "application/x-bzip2":
                    raw = bz2.decompress(raw)
            except (zlib.error, OSError):
                return None
            out.append((f.findtext("name", "file"), raw))
    return end, out


def _swf(c: bytes, at: int) -> Found:
    found = _inflated(zlib.decompressobj(), c, at + 8)
    if found is None or found[1] is not None and len(found[1]) + 8 != struct.unpack_from("<I", c, at + 4)[0]:
        return None
    return found[0], [("swf", found[1] and b"FWS" + c[at + 3 : at + 8] + found[1])]


def _sparse(c: bytes, at: int) -> Found:
    if at + 28 > len(c):
        return None
    _, _, _, head, chunk, block, total, n, _ = struct.unpack_from("<IHHHHIIII", c, at)
    if total * block > LARGEST:
        return None
    p, out = at + head, io.BytesIO()
    for _ in range(n):
        if p + chunk > len(c):
            return None
        kind, _, blocks, size = struct.unpack_from("<HHII", c, p)
        body = c[p + chunk : p + size]
        if kind == 0xCAC1:
            out.write(body)
        elif kind == 0xCAC2:
            out.write(body[:4] * (blocks * block // 4))
        elif kind == 0xCAC3:
            out.write(b"\x00" * (blocks * block))
        elif kind != 0xCAC4:
            return None
        p += size
    return p, [("image", out.getvalue())]


def _backup(c: bytes, at: int) -> Found:
    lines = c[at : at + 64].split(b"\n", 4)
    if len(lines) < 5 or lines[3] != b"none":
        return None
    start = at + sum(len(x) + 1 for x in lines[:4])
    if lines[2] == b"0":
        return len(c), [("backup.tar", c[start:])]
    found = _inflated(zlib.decompressobj(), c, start)
    return found and (found[0], [("backup.tar", found[1])])


def _png(c: bytes, at: int) -> Found:
    p = at + 8
    while p + 12 <= len(c):
        size, kind = struct.unpack_from(">I4s", c, p)
        if p + 12 + size > len(c) or zlib.crc32(c[p + 4 : p + 8 + size]) != struct.unpack_from(">I", c, p + 8 + size)[0]:
            return None
        p += 12 + size
        if kind == b"IEND":
            return p, [("image.png", c[at:p])]
    return None


def _gif(c: bytes, at: int) -> Found:
    if at + 13 > len(c):
        return None
    p = at + 13 + (3 << ((c[at + 10] & 7) + 1) if c[at + 10] & 0x80 else 0)
    while p < len(c):
        if c[p] == 0x3B:
            return p + 1, [("image.gif", c[at : p + 1])]
        if c[p] == 0x21:
            p += 2
        elif c[p] == 0x2C and p + 10 < len(c):
            p += 11 + (3 << ((c[p + 9] & 7) + 1) if c[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(c) and c[p]:
            p += 1 + c[p]
        p += 1
    return None


def _jpeg(c: bytes, at: int) -> Found:
    p = at + 2
    while p + 4 <= len(c) and c[p] == 0xFF:
        kind = c[p + 1]
        if kind == 0xD9:
            return p + 2, [("image.jpg", c[at : p + 2])]
        p += 2 + struct.unpack_from(">H", c, p + 2)[0]
        if kind == 0xDA:
            while p + 1 < len(c) and not (c[p] == 0xFF and c[p + 1] not in (0, *range(0xD0, 0xD8))):
                p += 1
    return (p + 2, [("image.jpg", c[at : p + 2])]) if c[p : p + 2] == b"\xff\xd9" else None


def _sized(size_of: Callable[[bytes, int], int | None], name: str) -> Callable[[bytes, int], Found]:
    def decode(c: bytes, at: int) -> Found:
        try:
            size = size_of(c, at)
        except struct.error:
            return None
        return (at + size, [(name, c[at : at + size])]) if size and 0 < size <= len(c) - at else None

    return decode


def _font_size(c: bytes, at: int) -> int | None:
    n, search = struct.unpack_from(">HH", c, at + 4)
    if not n or search != 16 << (n.bit_length() - 1):
        return None
    ends = [sum(struct.unpack_from(">II", c, at + 12 + 16 * i + 8)) for i in range(n)]
    return (max(ends) + 3) // 4 * 4 if max(ends) <= len(c) - at else None


def _elf_size(c: bytes, at: int) -> int | None:
    h = elf_header(c[at : at + 64])
    return h["at"] + h["size"] * h["n"] if h and h["at"] else None


def _ogg_size(c: bytes, at: int) -> int | None:
    p = at
    while c[p : p + 4] == b"OggS" and p + 27 <= len(c):
        n = c[p + 26]
        p += 27 + n + sum(c[p + 27 : p + 27 + n])
    return p - at if p <= len(c) else None


def _pdf_size(c: bytes, at: int) -> int | None:
    stop = c.find(b"%%EOF", at)
    following = c.find(b"%PDF-", at + 5)
    while (more := c.find(b"%%EOF", stop + 5)) >= 0 and stop >= 0 and (following < 0 or more < following):
        stop = more
    if stop < 0:
        return None
    end = stop + 5
    while c[end : end + 1] in (b"\r", b"\n"):
        end += 1
    return end - at


def _plf(c: bytes, at: int) -> Found:
    try:
        version, head, section = struct.unpack_from("<III", c, at + 4)
        p, out = at + head, []
        while p + section <= len(c) and section >= 12:
            kind, size = struct.unpack_from("<II", c, p)
            if not size or p + section + size > len(c):
                break
            out.append((f"section-{len(out)}-{kind}", c[p + section : p + section + size]))
            p += section + (size + 3) // 4 * 4
    except struct.error:
        return None
    return (min(p, len(c)), out) if out else None


def _ico_size(c: bytes, at: int) -> int | None:
    zero, kind, n = struct.unpack_from("<HHH", c, at)
    if zero or kind != 1 or not 0 < n <= 64:
        return None
    entries = [struct.unpack_from("<BBBBHHII", c, at + 6 + 16 * i) for i in range(n)]
    if any(e[3] or e[4] > 1 or e[5] not in (0, 1, 2, 4, 8, 16, 24, 32) or not e[6] or e[7] < 6 + 16 * n for e in entries):
        return None
    return max(e[6] + e[7] for e in entries)


def _icc_size(c: bytes, at: int) -> int | None:
    size = struct.unpack_from(">I", c, at - 36)[0] if at >= 36 else 0
    return size if size >= 128 else None


def _icc(c: bytes, at: int) -> Found:
    size = _icc_size(c, at)
    return (at - 36 + size, [("profile.icc", c[at - 36 : at - 36 + size])]) if size and at - 36 + size <= len(c) else None


def _class_size(c: bytes, at: int) -> int | None:
    """The size of a Java class by its pool, members and attributes."""
    n, p, i = struct.unpack_from(">H", c, at + 8)[0], at + 10, 1
    sizes = {3: 5, 4: 5, 5: 9, 6: 9, 7: 3, 8: 3, 9: 5, 10: 5, 11: 5, 12: 5, 15: 4, 16: 3, 17: 5, 18: 5, 19: 3, 20: 3}
    while i < n:
        tag = c[p] if p < len(c) else 0
        if tag == 1:
            p += 3 + struct.unpack_from(">H", c, p + 1)[0]
        elif tag in sizes:
            p += sizes[tag]
        else:
            return None
        i += 2 if tag in (5, 6) else 1
    p += 8 + 2 * struct.unpack_from(">H", c, p + 6)[0]
    for level in range(3):
        count = struct.unpack_from(">H", c, p)[0]
        p += 2
        for _ in range(count):
            if level < 2:
                attributes = struct.unpack_from(">H", c, p + 6)[0]
                p += 8
                for _ in range(attributes):
                    p += 6 + struct.unpack_from(">I", c, p + 2)[0]
            else:
                p += 6 + struct.unpack_from(">I", c, p + 2)[0]
    return p - at


DECODERS: dict[str, Callable[[bytes, int], Found]] = {
    "gzip": _inflating(lambda: zlib.decompressobj(31), "gzip"),
    "bz2": _inflating(bz2.BZ2Decompressor, "bz2"),
    "xz": _inflating(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), "xz"),
    "lzma_alone": _inflating(lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), "lzma"),
    "lzip": _lzip,
    "tar1": _tar,
    "tar2": _tar,
    "zip": _zip,
    "ar": _ar,
    "cpio1": _cpio,
    "cpio2": _cpio,
    "rpm": _rpm,
    "xar": _xar,
    "swf": _swf,
    "android-sparse": _sparse,
    "androidbackup": _backup,
    "png": _png,
    "gif87": _gif,
    "gif89": _gif,
    "jpeg": _jpeg,
    "bmp": _sized(lambda c, at: struct.unpack_from("<I", c, at + 2)[0] if struct.unpack_from("<I", c, at + 6)[0] == 0 else None, "image.bmp"),
    "riff": _sized(lambda c, at: struct.unpack_from("<I", c, at + 4)[0] + 8, "riff"),
    "aiff": _sized(lambda c, at: struct.unpack_from(">I", c, at + 4)[0] + 8 if c[at + 8 : at + 12] in (b"AIFF", b"AIFC") else None, "sound.aiff"),
    "ogg": _sized(_ogg_size, "sound.ogg"),
    "pdf": _sized(_pdf_size, "document.pdf"),
    "otf": _sized(_font_size, "font.otf"),
    "ttf": _sized(_font_size, "font.ttf"),
    "woff": _sized(lambda c, at: struct.unpack_from(">I", c, at + 8)[0], "font.woff"),
    "elf": _sized(_elf_size, "program.elf"),
    "plf": _plf,
    "icc": _icc,
    "java": _sized(_class_size, "program.class"),
    **IMAGES,
}
#: Formats whose signature says too little to be searched for: they are looked for at the start of a content only.
AT_START = {"ico": _sized(_ico_size, "image.ico"), "jffs2_le": IMAGES["jffs2_le"], "jffs2_be": IMAGES["jffs2_be"], "compress": IMAGES["compress"]}


def unpack(content: bytes) -> list[tuple[str, int, int, list[tuple[str, bytes | None]]]]:
    """(format, from, to, files) of what a content holds, signatures at its start first. A place inside a stretch
    that was claimed already is passed over, and a whole copy of the content itself is no contained file."""
    places = [(at - CORRECTIONS.get(n, 0), n, at) for n, at in offsets(content, tuple(n for n in DECODERS if n not in AT_START)) if at >= CORRECTIONS.get(n, 0)]
    places += [(0, n, 0) for n in AT_START if content.startswith(SIGNATURES.get(n, b"\x00\x00\x01\x00"))]
    places.sort(key=lambda x: (x[0] != 0, x[0], x[1]))
    out, claimed = [], []
    for start, name, at in places:
        if any(lo <= start < hi for lo, hi in claimed):
            continue
        try:
            found = (AT_START.get(name) or DECODERS[name])(content, at)
        except (struct.error, IndexError, ValueError, OverflowError):
            found = None  # the content ends within a structure, or a field of it makes no sense
        if found is None:
            continue
        end, files = found
        if len(files) == 1 and start == 0 and end == len(content) and files[0][1] == content:
            continue
        claimed.append((start, end))
        out.append((name, start, end, files))
    return out


def byte_swapped(content: bytes) -> bytes:
    even = content[: len(content) // 2 * 2]
    out = bytearray(even)
    out[0::2], out[1::2] = even[1::2], even[0::2]
    return bytes(out) + content[len(even) :]


#: What a kernel says when it starts; found only after the bytes of each word are exchanged, the content is swapped.
_BOOTS = b"Uncompressing Linux"


def restored(content: bytes) -> list[tuple[str, bytes]]:
    """The content with the two bytes of each word exchanged, or without the key it was mixed with, where it shows signs of
    that: the swapped words of a starting kernel, or padding of zeros that has become a repeated block of 16 bytes, without
    which a known file begins."""
    out = []
    if _BOOTS[:18] not in content and byte_swapped(_BOOTS[:18]) in content:
        out.append(("byteswap", byte_swapped(content)))
    if key := padding_key(content):
        plain = unxored(content, key)
        if any(n not in AT_START for n, lo, _, _ in unpack(plain) if lo == 0):
            out.append(("xor", plain))
    return out


def padding_key(content: bytes, *, least: int = 8) -> bytes | None:
    """The block of 16 bytes that is repeated most in a row at multiples of 16, at least ``least`` times; None if it is of
    one value only or there is none."""
    import numpy as np

    n = len(content) // 16
    if n < least:
        return None
    blocks = np.frombuffer(content, np.uint8, n * 16).reshape(n, 16)
    same = np.concatenate([[False], (blocks[1:] == blocks[:-1]).all(1), [False]])
    edges = np.flatnonzero(np.diff(same.astype(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2] + 1
    if not len(lengths) or lengths.max() < least:
        return None
    key = blocks[starts[lengths.argmax()]]
    return None if (key == key[0]).all() else key.tobytes()


def unxored(content: bytes, key: bytes) -> bytes:
    import numpy as np

    data = np.frombuffer(content, np.uint8)
    return (data ^ np.resize(np.frombuffer(key, np.uint8), len(data))).tobytes()


def decoded_text(content: bytes) -> list[tuple[str, bytes]]:
    """The content as base64, Intel HEX or uuencoded text, where it is one."""
    out = []
    bare = b"".join(content.split())
    if len(bare) >= 16 and len(bare) % 4 == 0 and re.fullmatch(rb"[A-Za-z0-9+/]+={0,2}", bare):
        out.append(("base64", base64.b64decode(bare)))
    if content[:1] == b":" and _ihex(content):
        data = b"".join(r[4:-1] for x in content.split(b"\n") if x.strip().startswith(b":") and (r := bytes.fromhex(x.strip()[1:].decode()))[3] == 0)
        out.append(("ihex", data))
    if content.startswith(b"begin ") and b"\nend" in content:
        try:
            out.append(("uuencode", b"".join(binascii.a2b_uu(x) for x in content.split(b"\n")[1 : content.split(b"\n").index(b"end")])))
        except (binascii.Error, ValueError):
            pass
    return out
