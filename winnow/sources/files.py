"""File listings and image rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import media_format, safe_relative, unix_path, variant_key

# Folders the library manages itself and a scan never enters.
MANAGED = (".curation-quarantine", ".curation-cache", ".curation")


def _unseen(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    return hidden and not name.startswith(("_metadata", "_common_metadata"))


def _walk(spark: SparkSession, root: str, managed: tuple[str, ...]) -> tuple[list[str], list[str], list[tuple]]:
    """(folders that a recursive listing may take whole, single files of the other folders, rows of files that Spark passes over):
    no managed folder and no link is entered."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(root).getFileSystem(spark._jsc.hadoopConfiguration())
    # Only a local file system has links; its plain listing shows what they lead to.
    local = files.getScheme() == "file"

    def is_link(path) -> bool:
        # A local path is looked up by its name without the scheme.
        return local and files.getFileLinkStatus(paths(path.toUri().getPath())).isSymlink()

    apart: list[str] = []
    single: list[str] = []
    unseen: list[tuple] = []

    def look(path) -> list[str] | None:
        """The topmost folders that can be taken whole, None if ``path`` itself is one; what a recursive listing misses goes apart."""
        whole, own, clean = [], [], True
        for status in files.listStatus(path):
            child = status.getPath()
            name = child.getName()
            if name in managed and status.isDirectory() or is_link(child):
                clean = False
            elif not status.isDirectory():
                if _unseen(name):
                    unseen.append((child.toString(), status.getModificationTime() * 1000, status.getLen()))
                else:
                    own.append(child.toString())
            else:
                below = look(child)
                if _unseen(name):
                    apart.extend([child.toString()] if below is None else below)
                else:
                    clean &= below is None
                    whole += [child.toString()] if below is None else below
        if clean:
            return None
        single.extend(own)
        return whole

    top = look(paths(root))
    return [*([root] if top is None else top), *apart], single, unseen


def list_files(spark: SparkSession, root: str, *, managed: tuple[str, ...] = MANAGED) -> DataFrame:
    """path (relative), mtime_us, size_bytes of all files below ``root``; contents are not read.

    Managed folders are left out before anything below them is listed, and links are not followed. Folders without either are
    listed by Spark, in parallel; a folder without files gives no rows.
    """
    paths = spark._jvm.org.apache.hadoop.fs.Path
    place = paths(root)
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    folders, single, unseen = _walk(spark, base, managed)
    listed = spark.createDataFrame(unseen, "path string, mtime_us long, size_bytes long")
    for some, recursive in ((folders, "true"), (single, "false")):
        if some:
            # Spark reads these as patterns.
            plain = [re.sub(r"([\\*?\[\]{},])", r"\\\1", x) for x in some]
            rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(plain)
            rows = rows.select("path", F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("size_bytes"))
            listed = listed.unionByName(rows)
    start = len(re.sub("^file:/+", "/", base)) + 2
    plain = F.regexp_replace("path", "^file:/+", "/")
    return listed.select(unix_path(F.substr(plain, F.lit(start))).alias("path"), "mtime_us", "size_bytes")


def classify_files(listing: DataFrame) -> DataFrame:
    """Adds format (NULL = unsupported), filename and variant key; unsafe paths are flagged."""
    return (
        listing.withColumn("format", media_format("path"))
        .withColumn("filename", F.element_at(F.split("path", "/"), -1))
        .withColumn("capture_variant_id", variant_key("path"))
        .withColumn("safe", safe_relative("path"))
    )


def read_images(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, failures) from Spark's image source; corrupt files become failure rows."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")
    ok = images.filter((F.col("height") > 0) & (F.col("width") > 0))
    bad = images.filter((F.col("height") <= 0) | (F.col("width") <= 0)).select(
        F.col("origin").alias("path"), F.lit("undecodable").alias("reason")
    )
    return ok.select(F.col("origin").alias("path"), "height", "width", "nChannels", "data"), bad
