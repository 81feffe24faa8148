"""Checks, decoders and extractors on files made here."""

import base64
import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib

import pytest

from strandline.functions import formats as B
from strandline.functions import programs as P
from strandline.operators import carve as V


def tar_of(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zip_of(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def cpio_of(files):
    out = b""
    for name, data, mode in [*((n, d, 0o100644) for n, d in files.items()), ("TRAILER!!!", b"", 0)]:
        raw = name.encode() + b"\x00"
        head = b"070701" + b"".join(b"%08X" % x for x in (1, mode, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(raw), 0))
        out += head + raw
        out += b"\x00" * (-len(out) % 4) + data
        out += b"\x00" * (-len(out) % 4)
    return out


def ar_of(files):
    out = b"!<arch>\n"
    for name, data in files.items():
        out += b"%-16s%-12d%-6d%-6d%-8s%-10d`\n" % (name.encode() + b"/", 0, 0, 0, b"644", len(data)) + data + b"\n" * (len(data) % 2)
    return out


def lzip_of(data):
    raw = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])
    return b"LZIP\x01\x10" + raw + struct.pack("<IQQ", zlib.crc32(data), len(data), 6 + len(raw) + 20)


def png_of():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\x00" * 13) + chunk(b"IEND", b"")


def sparse_of():
    head = struct.pack("<IHHHHIIII", 0xED26FF3A, 1, 0, 28, 12, 4, 3, 3, 0)
    return head + struct.pack("<HHII", 0xCAC1, 0, 1, 16) + b"data" + struct.pack("<HHII", 0xCAC2, 0, 1, 16) + b"fill" + struct.pack("<HHII", 0xCAC3, 0, 1, 12)


def xar_of(name, data):
    packed = zlib.compress(data)
    toc = zlib.compress(f'<xar><toc><file><name>{name}</name><data><offset>0</offset><length>{len(packed)}</length><encoding style="application/x-gzip"/></data></file></toc></xar>'.encode())
    return b"xar!" + struct.pack(">HHQQI", 28, 1, len(toc), 0, 0) + toc + packed


def elf_of():
    """A small 64-bit ELF file with a dynamic section, symbols and module information."""
    names = [b"", b".dynstr", b".dynamic", b".dynsym", b".modinfo", b".shstrtab"]
    strtab = b"\x00libc.so.6\x00libme.so\x00printf\x00mine\x00"
    at = lambda s: strtab.index(s)
    dynamic = struct.pack("<qQqQqQ", 1, at(b"libc"), 14, at(b"libme"), 0, 0)
    dynsym = b"\x00" * 24 + struct.pack("<IBBHQQ", at(b"printf"), 0x12, 0, 0, 0, 0) + struct.pack("<IBBHQQ", at(b"mine"), 0x22, 0, 1, 0, 0)
    modinfo = b"license=Dual BSD\x00GPL\x00author=me\x00alias=x=y\x00"
    shstr = b"\x00".join(names) + b"\x00"
    bodies, offset, rows = [b"", strtab, dynamic, dynsym, modinfo, shstr], 64, []
    kinds = [0, 3, 6, 11, 1, 3]
    data = b""
    for name, kind, body in zip(names, kinds, bodies):
        rows.append(struct.pack("<IIQQQQIIQQ", shstr.index(b"\x00" + name + b"\x00") + 1 if name else 0, kind, 0, 0, offset + len(data), len(body), 0, 0, 1, 0))
        data += body
    table = offset + len(data)
    head = b"\x7fELF\x02\x01\x01" + b"\x00" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, table, 0, 64, 0, 0, 64, len(names), 5)
    return head + data + b"".join(rows)


def class_of():
    pool = [b"\x01\x00\x03a/B", b"\x07\x00\x01", b"\x01\x00\x01f", b"\x01\x00\x01I", b"\x01\x00\x03run", b"\x01\x00\x03()V", b"\x01\x00\x0aSourceFile", b"\x01\x00\x06B.java", b"\x01\x00\x05hello", b"\x08\x00\x09"]
    body = struct.pack(">4H", 1, 2, 0, 0) + struct.pack(">H4H", 1, 0, 3, 4, 0) + struct.pack(">H4H", 1, 0, 5, 6, 0) + struct.pack(">HHIH", 1, 7, 2, 8)
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, len(pool) + 1) + b"".join(pool) + body


INNER = {"a.txt": b"hello " * 40, "d/b.bin": bytes(range(256))}
TEXT = b"some text that is packed " * 20


@pytest.mark.parametrize(
    ("kind", "data", "files"),
    [
        ("gzip", gzip.compress(TEXT), [TEXT]), ("bz2", bz2.compress(TEXT), [TEXT]), ("xz", lzma.compress(TEXT), [TEXT]), ("lzma_alone", lzma.compress(TEXT, lzma.FORMAT_ALONE), [TEXT]), ("lzip", lzip_of(TEXT), [TEXT]),
        ("tar1", tar_of(INNER), list(INNER.values())), ("zip", zip_of(INNER), list(INNER.values())), ("ar", ar_of({"x.o": b"abc", "y.o": b"de"}), [b"abc", b"de"]), ("cpio1", cpio_of(INNER), list(INNER.values())),
        ("android-sparse", sparse_of(), [b"datafill\x00\x00\x00\x00"]), ("xar", xar_of("f", TEXT), [TEXT]), ("swf", b"CWS\x0a" + struct.pack("<I", len(TEXT) + 8) + zlib.compress(TEXT), [b"FWS\x0a" + struct.pack("<I", len(TEXT) + 8) + TEXT]),
        ("androidbackup", b"ANDROID BACKUP\n1\n1\nnone\n" + zlib.compress(TEXT), [TEXT]),
    ],
)
def test_decoders_round_trip(kind, data, files):
    # In front of it and behind it lies something else; the claimed range is exact.
    got = [x for x in B.unpack(b"\xee" * 7 + data + b"\xee" * 5) if x[0] == kind]
    assert got and [d for _, d in got[0][3]] == files
    assert got[0][1] == 7 and (got[0][2] == 7 + len(data) or kind == "tar1")
    # Cut off in the middle it is not a file of this kind.
    assert kind == "tar1" or not [x for x in B.unpack(data[: len(data) // 3]) if x[0] == kind and x[3] and x[3][0][1] == files[0]]


@pytest.mark.parametrize(
    "data",
    [png_of(), b"GIF89a" + b"\x01\x00\x01\x00\x00\x00\x00" + b"\x2c" + b"\x00" * 9 + b"\x02\x01\x00\x00\x3b", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03\x00abc\xff\x00d\xff\xd9", b"RIFF\x04\x00\x00\x00WAVE", b"%PDF-1.4\nx\n%%EOF\n", b"OggS" + b"\x00" * 22 + b"\x01\x02ab"],
)
def test_carved_by_structure(data):
    got = B.unpack(b"??" + data + b"!!")
    assert len(got) == 1 and got[0][1:3] == (2, 2 + len(data)) and got[0][3][0][1] == data
    assert B.unpack(data) == []  # the whole file contains no other


def test_tags():
    assert B.tags_of("x", b"plain\ttext\n") == ["text"]
    assert B.tags_of("x", b"") == ["empty"] and B.tags_of("x", None) == ["empty"]
    assert "xml" in B.tags_of("a.xml", b"\xef\xbb\xbf <?xml version='1.0'?><a/>") and "xml" not in B.tags_of("a.xml", b"<?xml version='1.0'?><a>")
    assert "wav" in B.tags_of("a", b"RIFF\x04\x00\x00\x00WAVE") and "elf" in B.tags_of("a", elf_of())
    assert "ihex" in B.tags_of("a", b":0300300002337A1E\n:00000001FF\n") and "ihex" not in B.tags_of("a", b":0300300002337A1F\n")
    assert "vimswap" in B.tags_of(".a.swp", b"b0VIM 8") and "aiff" in B.tags_of("a", b"FORM\x00\x00\x00\x04AIFF")
    assert "androidxml" in B.tags_of("a.xml", b"\x03\x00\x08\x00") and "messagecatalog" in B.tags_of("a.mo", b"\xde\x12\x04\x95")
    assert "rsacertificate" in B.tags_of("a.RSA", b"\x30\x02\x01\x00")
    page = b"SQLite format 3\x00" + struct.pack(">H", 512) + b"\x00" * 10 + struct.pack(">I", 1)
    assert "sqlite3" in B.tags_of("a", page + b"\x00" * (512 - len(page)))


def test_text_decodings_and_bytes():
    assert ("base64", b"hello world, hello") in B.decoded_text(base64.b64encode(b"hello world, hello"))
    assert ("ihex", b"\x02\x33\x7a") in B.decoded_text(b":0300300002337A1E\n:00000001FF\n")
    assert ("uuencode", b"cat") in B.decoded_text(b"begin 644 f\n#8V%T\n`\nend\n")
    assert B.byte_swapped(B.byte_swapped(b"abcde")) == b"abcde" and B.byte_swapped(b"abcd") == b"badc"
    assert B.unxored(B.unxored(b"secret", b"k3"), b"k3") == b"secret"


def test_programs():
    elf = elf_of()
    assert P.architecture(elf) == "x86-64" and P.dynamic(elf) == (["libc.so.6"], "libme.so")
    assert P.symbols(elf) == [("printf", "global", "func", False), ("mine", "weak", "func", True)]
    assert P.module_information(elf) == [("license", "Dual BSDGPL"), ("author", "me"), ("alias", "x=y")]
    assert P.java_class(class_of()) == {"name": "a.B", "source": "B.java", "fields": ["f"], "methods": ["run"], "strings": ["hello"]}
    for broken in (b"", b"\x7fELF", elf[:100], class_of()[:40]):
        assert P.symbols(broken) == [] and P.module_information(broken) == [] and P.java_class(broken) is None


def test_recursive_unpacking(spark):
    inside = tar_of({"n.gz": gzip.compress(TEXT), "same.txt": TEXT, "empty": b""})
    rows = [("k1", "fw.zip", zip_of({"fw.tar": inside})), ("k2", "copy.zip", zip_of({"fw.tar": inside})), ("k3", "empty", b""), ("k4", "null", None)]
    files, edges = V.unpacked_all(spark.createDataFrame(rows, "key string, path string, content binary"))
    got = {r.key: r.level for r in files.collect()}
    assert got[V.digest(TEXT)] == 2 and got[V.digest(inside)] == 1 and len(got) == len(set(got))
    assert {(r.format) for r in edges.collect()} >= {"zip", "tar1", "gzip"}


def test_deep_contents_and_large_entries(spark, monkeypatch):
    import pytest

    deep = TEXT
    for i in range(10):
        deep = gzip.compress(deep, mtime=i + 1)
    df = spark.createDataFrame([("k", "deep.gz", deep)], "key string, path string, content binary")
    assert {r.key: r.level for r in V.unpacked_all(df)[0].collect()}[V.digest(TEXT)] == 10
    with pytest.raises(ValueError, match="below 2"):
        V.unpacked_all(df, depth=2)
    monkeypatch.setattr(V.B, "LARGEST", 10)
    ((_, _, _, inner),) = [x for x in V.B.unpack(zip_of({"large": b"x" * 11, "small": b"x"})) if x[0] == "zip"]
    assert dict(inner) == {"large": None, "small": b"x"}


def test_extractors_over_tables(spark):
    rows = [("e", "a.ko", elf_of()), ("j", "B.class", class_of()), ("t", "t.txt", b"short\x00longer line\x01"), ("z", "z", None), ("s", "s", b"\x00sqsh\x00")]
    df = spark.createDataFrame(rows, "key string, path string, content binary")
    assert {(r.key, r.line) for r in V.strings_of(df).collect()} >= {("j", "hello"), ("t", "short"), ("t", "longer line")}
    assert {(r.key, r.name, r.kind) for r in V.symbols_of(df).collect()} >= {("e", "mine", "func"), ("j", "run", "method"), ("j", "f", "field")}
    assert [(r.key, r.needed, r.soname, r.architecture) for r in V.libraries_of(df).collect()] == [("e", ["libc.so.6"], "libme.so", "x86-64")]
    assert {(r.field, r.value) for r in V.modules_of(df).collect()} == {("license", "Dual BSDGPL"), ("author", "me"), ("alias", "x=y")}
    assert {r.key: r.tags for r in V.tagged(df).collect()}["z"] == ["empty"]
    assert {(r.key, r.marker) for r in V.marker_offsets(df).collect()} >= {("e", "elf"), ("s", "squashfs1"), ("j", "java")}
    assert [(r.parent, r.lo, r.path) for r in V.unpacked(df).where("format = 'squashfs1'").collect()] == [("s", 1, None)]
    assert V.encrypted_of(df).count() == 0


def test_round_trips_of_all_written_formats():
    import random

    from strandline.functions import packing as K

    rng = random.Random(1)
    texts = [b"x", b"some words " * 4, bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789 \n") for _ in range(150_000)), "日本語 é\n".encode() * 2000]
    for text in texts:
        for name, write in K.CONTAINERS.items():
            before, behind = b"" if name in B.AT_START else b"\xee" * 7, b"" if name == "compress" else b"\xee" * 5
            got = [x for x in B.unpack(before + write(text) + behind) if x[0] == name]
            assert got and [d for _, d in got[0][3]] == [text] and got[0][1] == len(before), name
            cut = write(text)[: len(write(text)) // 2]
            assert name == "tar1" or all(d != text for n, _, _, files in B.unpack(cut) if n == name for _, d in files), name
        for name, write in K.CARVED.items():
            before, built = b"" if name in B.AT_START else b"\xee" * 7, write(text)
            assert (len(before), len(before) + len(built)) in [x[1:3] for x in B.unpack(before + built + b"!!") if x[0] == name], name


def test_images_that_contradict_themselves():
    from strandline.functions import packing as K

    image = bytearray(K.CONTAINERS["romfs"](b"text"))
    image[32:36] = (32 | 2).to_bytes(4)  # the next file is this one
    assert B.IMAGES["romfs"](bytes(image), 0) is None
    for name, decode in B.IMAGES.items():
        for broken in (b"", b"\x00" * 40, B.SIGNATURES[name] * 20):
            assert decode(broken, 0) is None, name


def test_large_streams_are_named(monkeypatch):
    monkeypatch.setattr(B, "LARGEST", 10)
    for pack, name in ((gzip.compress, "gzip"), (bz2.compress, "bz2"), (lzma.compress, "xz")):
        data = pack(b"y" * 3_000_000)
        assert B.unpack(b"?" + data + b"!")[0][:4] == (name, 1, 1 + len(data), [(name, None)])
