"""The registry of scans, and the scans of single files that are expressions over their text."""

from __future__ import annotations

import configparser
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.files import gate

PHASES = ("prerun", "unpack", "leaf", "aggregate", "postrun")


@dataclass(frozen=True)
class Scan:
    """One configured scan: when it runs, on what, and with which settings."""

    name: str
    phase: str
    method: str
    priority: int = 0
    enabled: bool = True
    magic: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    settings: dict[str, str] = field(default_factory=dict)


def read_registry(text: str) -> list[Scan]:
    """Scans of an INI configuration, those of a phase together and by falling priority, disabled ones left out.

    Lists are separated by colons; ``envvars`` holds settings as A=1:B=2. A section without a known type is no scan."""
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.read_string(text)
    out = []
    for name in parser.sections():
        own = parser[name]
        if own.get("type") in PHASES and own.get("enabled", "yes").strip().lower() in ("yes", "true", "1"):
            listed = lambda key, own=own: tuple(x for x in own.get(key, "").split(":") if x)
            settings = dict(x.split("=", 1) for x in listed("envvars") if "=" in x)
            out.append(Scan(name, own["type"], own.get("method", ""), own.getint("priority", 0), True, listed("magic"), listed("scanonly"), listed("noscan"), settings))
    return sorted(out, key=lambda s: (PHASES.index(s.phase), -s.priority, s.name))


def dispatch(files: DataFrame, scans: Sequence[Scan], methods: Mapping[str, Callable[[DataFrame, Mapping[str, str]], DataFrame]], phase: str) -> DataFrame:
    """(scan, priority, key, name, value): what the scans of a phase say of the files (key, path, tags, ...).

    Each scan gets the files that its tags let through (``gate``) and, if it names formats, that bear one of their tags, and
    its settings; its method, by name, gives (key, name, value) as strings. Scans without a method here are an error."""
    own = [s for s in scans if s.phase == phase]
    if missing := sorted({s.method for s in own} - set(methods)):
        raise ValueError(f"no such methods: {missing}")
    found = files.limit(0).select(F.lit("").alias("scan"), F.lit(0).alias("priority"), F.col("key").cast("string").alias("key"), F.lit("").alias("name"), F.lit("").alias("value"))
    for s in own:
        let = files.where(gate(F.col("tags"), (*s.only, *s.magic), s.never))
        rows = methods[s.method](let, s.settings).select(F.lit(s.name).alias("scan"), F.lit(s.priority).alias("priority"), *[F.col(c).cast("string").alias(c) for c in ("key", "name", "value")])
        found = found.unionByName(rows)
    return found


def scannable(files: DataFrame, *, least: int = 1, ignored: Sequence[str] = ()) -> DataFrame:
    """Files (path, size) that are not too small and have none of the ignored endings."""
    ends = [F.endswith("path", F.lit(x)) for x in ignored]
    return files.where((F.col("size") >= least) & ~F.coalesce(F.greatest(*ends, F.lit(False), F.lit(False)), F.lit(False)))


def kernel_version(text: Column) -> Column:
    """The version in a kernel's banner, null without one."""
    return F.nullif(F.regexp_extract(text, r"Linux version ([\d.\w-]+) \(", 1), F.lit(""))


def busybox_version(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"BusyBox v(\d+\.[\d.]+[-\w.]*)", 1), F.lit(""))


def module_parameters(source: Column) -> Column:
    """(name, type) of the parameters a module declares."""
    # A named parameter has its variable between name and type.
    plain = F.regexp_replace(source, r"module_param_named\s*\(\s*(\w+)\s*,\s*\w+\s*,", "module_param($1,")
    pattern = r"module_param\s*\(\s*(\w+)\s*,\s*(\w+)\s*,"
    names, kinds = (F.regexp_extract_all(plain, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(names.alias("name"), kinds.alias("type"))


def is_certificate(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("-----BEGIN")) & ~is_private_key(text)


def is_private_key(text: Column) -> Column:
    return F.contains(F.element_at(F.split(text, "\n"), 1), F.lit("PRIVATE KEY"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """(key, path, line) of what unified diffs (key, text) add, with the file each line is added to."""
    lines = diffs.where("text is not null").select("key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    target = F.when(F.startswith("line", F.lit("+++ ")), F.regexp_replace(F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""), r"\t.*$", ""))
    path = F.last(target, ignorenulls=True).over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    added = F.startswith("line", F.lit("+")) & ~F.startswith("line", F.lit("+++ "))
    return lines.withColumn("path", path).where(added & F.col("path").isNotNull()).select("key", "path", F.expr("substring(line, 2)").alias("line"))


def option_differences(left: DataFrame, right: DataFrame, *, besides: str = "FEATURE|ASH") -> DataFrame:
    """(option, side) of options that only one of two configurations sets, without those that match ``besides``."""
    a, b = (x.select("option").where(~F.col("option").rlike(besides)).distinct() for x in (left, right))
    return a.join(b, "option", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "option", "left_anti").withColumn("side", F.lit("right")))


def chunks(files: DataFrame, size: int, overlap: int) -> DataFrame:
    """(key, start, content) of large contents in pieces of ``size`` bytes, each with ``overlap`` more, so that nothing
    of up to ``overlap`` bytes is lost at a border."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(size)))
    return files.select("key", starts.alias("start"), "content").select("key", "start", F.substring("content", F.col("start") + 1, F.lit(size + overlap)).alias("content"))
