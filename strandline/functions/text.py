"""Expressions over text: lines, literals, versions, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
EXTENSIONS = {
    "c": "C", "h": "C", "cc": "C", "hh": "C", "cxx": "C", "cpp": "C", "hpp": "C", "c++": "C", "hxx": "C", "l": "C", "y": "C", "qml": "C", "S": "C", "s": "C",
    "groovy": "Java", "java": "Java", "jsp": "Java", "scala": "Java", "as": "ActionScript", "js": "JavaScript", "cs": "C#", "php": "PHP", "py": "Python", "rb": "Ruby", "dart": "JavaScript",
}


def language_of(path: Column) -> Column:
    """The language a path's extension stands for, null for others."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return table[F.regexp_extract(path, r"\.([A-Za-z+]+)$", 1)]


def language_of_tags(tags: Column) -> Column:
    """Java for anything of a Java machine, else C."""
    java = F.arrays_overlap(tags, F.array(*[F.lit(x) for x in ("java", "dalvik", "oat", "serializedjava")]))
    return F.when(F.coalesce(java, F.lit(False)), "Java").otherwise("C")


def printable(text: Column) -> Column:
    return text.rlike(r"^[\x09-\x0d\x20-\x7e]*$")


def runs(latin1: Column, least: int = 5) -> Column:
    """Printable runs of at least ``least`` characters in content read as Latin-1."""
    return F.regexp_extract_all(latin1, F.lit(rf"([\x20-\x7e\t]{{{least},}})"), F.lit(1))


def pieces(text: Column) -> Column:
    """Text split at control characters, without the empty pieces."""
    return F.filter(F.split(text, r"[\x00-\x08\x0e-\x1f\x7f]+"), lambda x: x != "")


def unescaped(literal: Column) -> Column:
    r"""A C literal with \", \t and \\ taken for what they mean."""
    out = F.replace(F.replace(literal, F.lit('\\"'), F.lit('"')), F.lit("\\t"), F.lit("\t"))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def line_at(text: Column, offset: Column) -> Column:
    """The number, from 1, of the line in which the character at an offset from 1 lies."""
    before = F.substring(text, F.lit(1), offset - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def version_key(version: Column) -> Column:
    """The numbers at the head of a version, to be compared as an array."""
    return F.transform(F.split(F.regexp_extract(version, r"^[0-9]+(?:\.[0-9]+)*", 0), r"\."), lambda x: x.try_cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two texts."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def cpe_parts(cpe: Column) -> Column:
    """vendor, product and version of a CPE name."""
    parts = F.split(F.regexp_replace(cpe, "^cpe:/[aho]:", ""), ":")
    return F.struct(F.get(parts, F.lit(0)).alias("vendor"), F.get(parts, F.lit(1)).alias("product"), F.get(parts, F.lit(2)).alias("version"))


def archive_parts(name: Column) -> Column:
    """package and version in the file name of an archive."""
    pattern = r"^(.+?)[-_]v?(\d[^/]*?)(?:\.src\.rpm|\.tar\.[a-z0-9]+|\.tgz|\.zip|\.jar)$"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("package"), F.regexp_extract(name, pattern, 2).alias("version"))


def normal_path(path: Column) -> Column:
    """A path without empty and . parts and with .. taken for the directory above; a leading slash stays."""
    empty = F.array().cast("array<string>")
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


def bare_function(name: Column) -> Column:
    """A demangled function name without its arguments and scopes."""
    return F.substring_index(F.regexp_replace(name, r"\(.*$", ""), "::", -1)


def macro_arguments(source: Column, macros: list[str]) -> Column:
    """First arguments of the named macros in source text, such as the symbols a kernel file exports."""
    return F.regexp_extract_all(source, F.lit(r"\b(?:" + "|".join(macros) + r")\s*\(\s*\"?(\w+)"), F.lit(1))


def spec_sources(spec: Column) -> Column:
    """The sources and patches that an RPM specification names."""
    return F.regexp_extract_all(spec, F.lit(r"(?mi)^\s*(?:source|patch)\d*\s*:\s*(\S+)"), F.lit(1))
