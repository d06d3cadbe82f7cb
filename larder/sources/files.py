"""File inventories and rasters as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_key, host_of, kind_of, normalise_url, slug_title

# What a root leaves out unless told otherwise.
DEFAULT_EXCLUDES = ("**/Library/**", "**/Temp/**", "**/Obj/**", "**/Build/**", "**/Logs/**", "**/.git/**", "**/node_modules/**", ".DS_Store", "*.meta")


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size and mtime of the files under a folder; no content is read. Symbolic links look like what they point at."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)  # folders named key=value are no partitions here
    if not recursive:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        folder = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
        found = found.where(F.regexp_replace("path", "/[^/]*$", "") == folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_content(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and content_hash of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", content_key("content").alias("content_hash"))


def with_kind(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of known extensions, with their kind."""
    return files.withColumn("kind", kind_of(path)).where("kind is not null")


def glob_regex(glob: str) -> str:
    """An anchored regular expression of a glob: ``**`` crosses folders, ``*`` and ``?`` do not, ``[!a]`` is a negated class."""
    bracket = r"\[[!^]?\]?[^\]]*\]"
    out = []
    for part in re.findall(rf"\*\*/|\*\*|\*|\?|{bracket}|.", glob, re.S):
        if part == "**/":
            out.append("(?:[^/]+/)*")
        elif part == "**":
            out.append(".*")
        elif part == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif len(part) > 2 and part[0] == "[":
            body = part[1:-1]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("[", r"\[") + "]")
        else:
            out.append(re.escape(part))
    return "^" + "".join(out) + "$"


def excluded(rel: str | Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether a root-relative path, or a folder above it, matches one of the globs: those without a slash by name."""
    path = F.col(rel) if isinstance(rel, str) else rel
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    matches = lambda glob: lambda p: p.rlike(glob_regex(glob))
    tests = [F.exists(above if "/" in g else parts, matches(g)) for g in globs]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def exclude(files: DataFrame, globs: list[str] | tuple[str, ...] = (), rel: str = "rel", defaults: bool = True) -> DataFrame:
    """Files that none of the globs leaves out."""
    return files.where(~excluded(rel, [*(DEFAULT_EXCLUDES if defaults else ()), *globs]))


def links(text: DataFrame, column: str = "value") -> DataFrame:
    """url, title and site of every line that is an address; nothing is fetched."""
    url = text.select(normalise_url(column).alias("url")).where("url is not null").distinct()
    return url.select("url", slug_title("url").alias("title"), host_of("url").alias("site_name"))


def load_links(spark: SparkSession, path: str) -> DataFrame:
    return links(spark.read.text(path))


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels and data (rows of BGR or BGRA bytes) of the pictures that the JVM decodes."""
    image = spark.read.format("image").option("dropInvalid", "true").load(path)
    return image.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
