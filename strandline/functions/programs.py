"""What programs say about themselves: ELF symbols and libraries, Java classes, DEX strings, module information."""

from __future__ import annotations

import struct

from strandline.functions.formats import elf_header

# Machines and bindings of ELF files.
MACHINES = {2: "SPARC", 3: "x86", 4: "m68k", 8: "MIPS", 20: "PowerPC", 21: "PowerPC64", 22: "S390", 40: "ARM", 42: "SuperH", 50: "IA-64", 62: "x86-64", 93: "ARCompact", 94: "Xtensa", 183: "AArch64", 243: "RISC-V"}
BINDINGS, KINDS = {0: "local", 1: "global", 2: "weak"}, {0: "notype", 1: "object", 2: "func", 3: "section", 4: "file", 6: "tls"}
MODULE_FIELDS = ("alias", "author", "depends", "description", "firmware", "license", "parm", "parmtype", "vermagic", "version")


def sections(c: bytes) -> dict[str, tuple[int, int, int, int]]:
    """name -> (type, offset, size, link) of an ELF file."""
    h = elf_header(c)
    if h is None or not h["n"]:
        return {}
    rows = []
    try:
        for i in range(h["n"]):
            at = h["at"] + i * h["size"]
            if h["wide"]:
                name, kind, _, _, offset, size, link = struct.unpack_from(h["order"] + "IIQQQQI", c, at)
            else:
                name, kind, _, _, offset, size, link = struct.unpack_from(h["order"] + "IIIIIII", c, at)
            rows.append((name, kind, offset, size, link))
        table = rows[h["names"]]
    except (struct.error, IndexError):
        return {}
    return {_text(c, table[2] + r[0]): r[1:] for r in rows}


def _text(c: bytes, at: int) -> str:
    return c[at : c.find(b"\x00", at)].decode("utf-8", "replace") if 0 <= at < len(c) else ""


def architecture(c: bytes) -> str | None:
    h = elf_header(c)
    return None if h is None else MACHINES.get(h["machine"], f"machine {h['machine']}")


def dynamic(c: bytes) -> tuple[list[str], str | None]:
    """(needed libraries, own library name)."""
    own = sections(c)
    if ".dynamic" not in own or ".dynstr" not in own:
        return [], None
    h, (_, at, size, _) = elf_header(c), own[".dynamic"]
    form, step = (h["order"] + "qQ", 16) if h["wide"] else (h["order"] + "iI", 8)
    needed, soname, strings = [], None, own[".dynstr"][1]
    for p in range(at, min(at + size, len(c) - step + 1), step):
        tag, value = struct.unpack_from(form, c, p)
        if tag == 1:
            needed.append(_text(c, strings + value))
        elif tag == 14:
            soname = _text(c, strings + value)
    return needed, soname


def symbols(c: bytes, table: str = ".dynsym") -> list[tuple[str, str, str, bool]]:
    """(name, binding, kind, defined) of a symbol table."""
    own = sections(c)
    strings = {".dynsym": ".dynstr", ".symtab": ".strtab"}[table]
    if table not in own or strings not in own:
        return []
    h, (_, at, size, _) = elf_header(c), own[table]
    step, out = 24 if h["wide"] else 16, []
    for p in range(at, min(at + size, len(c) - step + 1), step):
        if h["wide"]:
            name, info, _, section = struct.unpack_from(h["order"] + "IBBH", c, p)
        else:
            name, _, _, info, _, section = struct.unpack_from(h["order"] + "IIIBBH", c, p)
        if text := _text(c, own[strings][1] + name):
            out.append((text, BINDINGS.get(info >> 4, "other"), KINDS.get(info % 16, "other"), section != 0))
    return out


def module_information(c: bytes) -> list[tuple[str, str]]:
    """(field, value) of a kernel module; a part without a known field goes on with the licence before it."""
    own = sections(c)
    if ".modinfo" not in own:
        return []
    _, at, size, _ = own[".modinfo"]
    out: list[tuple[str, str]] = []
    for part in c[at : at + size].split(b"\x00"):
        text = part.decode("utf-8", "replace")
        field, mark, value = text.partition("=")
        if mark and field in MODULE_FIELDS:
            out.append((field, value))
        elif text and out and out[-1][0] == "license":
            out[-1] = ("license", out[-1][1] + text)
    return out


def java_class(c: bytes) -> dict | None:
    """Class name, source file, fields, methods and string constants of a Java class file."""
    try:
        if c[:4] != b"\xca\xfe\xba\xbe":
            return None
        n, p = struct.unpack_from(">H", c, 8)[0], 10
        pool: list = [None] * n
        i = 1
        while i < n:
            tag = c[p]
            if tag == 1:
                size = struct.unpack_from(">H", c, p + 1)[0]
                pool[i] = (tag, c[p + 3 : p + 3 + size].decode("utf-8", "replace"))
                p += 3 + size
            elif tag in (7, 8, 16, 19, 20):
                pool[i] = (tag, struct.unpack_from(">H", c, p + 1)[0])
                p += 3
            elif tag == 15:
                p += 4
            elif tag in (3, 4, 9, 10, 11, 12, 17, 18):
                p += 5
            elif tag in (5, 6):
                p += 9
                i += 1
            else:
                return None
            i += 1
        _, this, _, interfaces = struct.unpack_from(">4H", c, p)
        p += 8 + 2 * interfaces
        members = []
        for _ in range(2):
            count = struct.unpack_from(">H", c, p)[0]
            p += 2
            names = []
            for _ in range(count):
                _, name, _, attributes = struct.unpack_from(">4H", c, p)
                names.append(pool[name][1])
                p += 8
                for _ in range(attributes):
                    p += 6 + struct.unpack_from(">I", c, p + 2)[0]
            members.append(names)
        source = None
        for _ in range(struct.unpack_from(">H", c, p)[0]):
            p = p if source is not None else p
            name, size = struct.unpack_from(">HI", c, p + 2)
            if pool[name][1] == "SourceFile":
                source = pool[struct.unpack_from(">H", c, p + 8)[0]][1]
            p += 6 + size
        strings = [pool[x[1]][1] for x in pool if x and x[0] == 8]
        return {"name": pool[pool[this][1]][1].replace("/", "."), "source": source, "fields": members[0], "methods": members[1], "strings": strings}
    except (struct.error, IndexError, TypeError):
        return None


def dex_strings(c: bytes) -> list[str]:
    """The string table of a DEX file."""
    if len(c) < 0x70 or c[:4] != b"dex\n":
        return []
    n, at = struct.unpack_from("<II", c, 56)
    out = []
    for i in range(n):
        if at + 4 * i + 4 > len(c):
            break
        p = struct.unpack_from("<I", c, at + 4 * i)[0]
        while p < len(c) and c[p] & 0x80:
            p += 1
        out.append(_text(c, p + 1))
    return out
