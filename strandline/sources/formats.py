"""Text, binary and feed formats of the catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
PACKAGE_LIST = _text("package", "version", "filename", "origin")
DOWNLOAD_URLS = _text("downloadurl", "website")
REWRITES = ("package", "version", "filename", "origin", "sha256", "newpackage", "newversion")
SCAN_RESULT = (
    "name string, relativename string, path string, realpath string, magic string, tags array<string>, size long, checksum string, scans array<struct<offset: long, size: long, scanname: string, scanreports: array<string>>>"
)


#: Tables of the knowledge base and of results, by name, as schemas for readers, writers and ``CREATE TABLE``.
SCHEMAS = {
    "processed": "package string, version string, filename string, origin string, checksum string, downloadurl string, website string",
    "processed_file": "package string, version string, pathname string, checksum string, filename string, thirdparty boolean",
    "extracted_string": "stringidentifier string, checksum string, language string, linenumber int",
    "extracted_function": "checksum string, functionname string, language string, linenumber int",
    "extracted_name": "checksum string, name string, type string, language string, linenumber int",
    "licenses": "checksum string, license string, scanner string, version string",
    "extracted_copyright": "checksum string, copyright string, type string, byteoffset long",
    "hashconversion": "sha256 string, md5 string, sha1 string, crc32 long",
    "renames": "originalname string, newname string",
    "rpm": "rpmname string, checksum string, downloadurl string",
    "stringscores": "stringidentifier string, packages int, score double",
    "avgstringscache": "package string, language string, avgstrings double",
    "results": SCAN_RESULT,
}


def schemas(names: Sequence[str] = tuple(SCHEMAS), *, using: str = "parquet", prefix: str = "") -> list[str]:
    """Statements that create the named tables where they are not there."""
    return [f"CREATE TABLE IF NOT EXISTS {prefix}{n} ({SCHEMAS[n]}) USING {using}" for n in names]


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, size, content, key): all files below a path, key being the content's sha256; with ``glob`` only files whose
    names match it are opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (raw.option("pathGlobFilter", glob) if glob else raw).load(path)
    return raw.select("path", F.col("length").alias("size"), "content", F.sha2("content", 256).alias("key"))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a source tree in a known language, with their language and text."""
    from strandline.functions.text import EXTENSIONS, language_of

    own = binary_files(spark, path, "*.{" + ",".join(EXTENSIONS) + "}").withColumn("language", language_of(F.col("path")))
    return own.where("language is not null").withColumn("text", F.decode("content", "utf-8"))


def package_file_list(lists: DataFrame) -> DataFrame:
    """(filename, directory, package) of rows with package, directory and filenames, the names joined by slashes, as
    in the file lists of package databases."""
    own = lists.select("package", "directory", F.explode(F.split("filenames", "/")).alias("filename"))
    return own.where("filename != ''").select("filename", "directory", "package")


def package_list(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated list of packages: package, version, filename, origin."""
    return spark.read.csv(path, sep="\t", schema=PACKAGE_LIST)


def download_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=DOWNLOAD_URLS)


def hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, hash, value) of a manifest whose first line names its hashes; one row per file and hash."""
    lines = spark.read.text(path).where("trim(value) != ''")
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], "filename string, hash string, value string")
    names = head["value"].split()[1:]
    parts = F.split(F.trim("value"), r"\s+")
    own = lines.where(F.col("value") != head["value"]).select(parts.alias("p"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("hash"), F.get("p", F.lit(i + 1)).alias("value")) for i, n in enumerate(names)]))
    return own.select(F.col("p")[0].alias("filename"), pairs.alias("x")).select("filename", "x.hash", "x.value")


def rewrite_list(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) != ''").select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(REWRITES)])


def rewritten(packages: DataFrame, rewrites: DataFrame) -> DataFrame:
    """A package list with new names and versions where the rewrite list has the archive."""
    keys = ["package", "version", "filename", "origin"]
    new = rewrites.select(*keys, "newpackage", "newversion").dropDuplicates(keys)
    out = packages.join(new, keys, "left")
    return out.withColumn("package", F.coalesce("newpackage", "package")).withColumn("version", F.coalesce("newversion", "version")).select(*packages.columns)


def distribution_contents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, directory, package) of a distribution's contents listing: a path, blanks, then the packages that
    hold it, each as area/package, separated by commas. Lines before and with the FILE heading are no entries."""
    line = F.regexp_extract("value", r"^(\S.*?)\s+(\S+)$", 1)
    held = F.regexp_extract("value", r"^(\S.*?)\s+(\S+)$", 2)
    own = spark.read.text(path).select(line.alias("path"), F.explode(F.split(held, ",")).alias("package"))
    own = own.where((F.col("path") != "") & F.contains("package", F.lit("/")) & (F.col("path") != "FILE"))
    return own.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), F.element_at(F.split("package", "/"), -1).alias("package"))


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results: a JSON list of file records in each file."""
    return spark.read.option("multiLine", True).schema(SCAN_RESULT).json(path)


def vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """(cve, vendor, product, version) of an XML feed of entries, one row per vulnerable product version."""
    from strandline.functions.text import cpe_parts

    schema = "_id string, `vuln:vulnerable-software-list` struct<`vuln:product`: array<string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    own = raw.select(F.col("_id").alias("cve"), F.explode(F.col("`vuln:vulnerable-software-list`.`vuln:product`")).alias("cpe"))
    parts = cpe_parts(F.col("cpe"))
    return own.select("cve", parts["vendor"].alias("vendor"), parts["product"].alias("product"), parts["version"].alias("version"))


def vulnerable_files(cves: DataFrame, files: DataFrame) -> DataFrame:
    """(cve, key, pathname): files (package, version, pathname, key) of vulnerable products (cve, product, version, path)
    whose path ends with the vulnerable one."""
    met = cves.join(files.withColumnRenamed("package", "product"), ["product", "version"])
    return met.where(F.endswith("pathname", F.col("path"))).select("cve", "key", "pathname").distinct()


def database_table(spark: SparkSession, url: str, name: str, key: str, parts: int, low: int, high: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of the numeric column ``key``."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
