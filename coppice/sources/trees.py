"""Trees of root files as tables."""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import markdown

#: Folders that hold no documents of a tree's own.
SKIP = (".git", "node_modules")
# Folders of tools that documents name in backticks.
TOOLS = ("scripts", "protocols", "examples", "integrations")
ROOT = r"(?iu)^(?:(?:root|kök|kok)-)?\d[-_].*\.md$"


def roots(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the root files directly in a folder."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    return found.where(F.col("file").rlike(ROOT))


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder; contents aren't read. Empty files, and names that begin with a dot or an underscore, are hidden to Spark's readers."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def documents(spark: SparkSession, folder: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of all Markdown files below a folder, but for SKIP and folders and files named in skip."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.where(F.lower("path").endswith(".md") & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, (*SKIP, *skip))))).select("path", F.col("content").cast("string").alias("content"))


def leaves(spark: SparkSession, folder: str, prefix: str = markdown.PREFIX) -> DataFrame:
    return markdown.leaves(roots(spark, folder), prefix)


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, content) of all files below a folder, as bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"), "content")


@lru_cache(64)
def _store(base: str) -> pafs.FileSystem:
    """The store of paths that begin so: nothing or file: for the local root, else scheme:/authority."""
    if base in ("", "file:"):
        return pafs.LocalFileSystem()
    return pafs.FileSystem.from_uri(base.replace(":/", "://", 1))[0]


def _placed(path: str) -> tuple[str, str]:
    """The base of a path (scheme:/a/b, or a/b of the local root) and its name in that store."""
    scheme, mark, rest = path.partition(":/")
    if not mark or scheme == "file":
        return ("file:", f"/{rest}") if mark else ("", f"/{path}")
    return f"{scheme}:/{rest.partition('/')[0]}", pafs.FileSystem.from_uri(f"{scheme}://{rest}")[1]


@lru_cache(1 << 16)
def _missing(folder: str) -> bool:
    """Whether the store says that a folder, or one that it is in, isn't there, so that nothing in it is; false where it doesn't say."""
    above, mark, _ = folder.rpartition("/")
    if not mark:
        above = ""
    if above and not above.endswith(":") and _missing(above):
        return True
    try:
        base, name = _placed(folder)
        return _store(base).get_file_info(name).type == pafs.FileType.NotFound
    except (OSError, ValueError):
        return False


def _found(paths: list[str]) -> list[bool]:
    """Whether each path is there; false where the store can't be reached from here. Paths in folders that aren't there aren't asked for, the others together."""
    out, asked = [False] * len(paths), {}
    for i, path in enumerate(paths):
        above = path.rpartition("/")[0]
        if not above or above.endswith(":") or not _missing(above):
            try:
                base, name = _placed(path)
                asked.setdefault(base, []).append((i, name))
            except (OSError, ValueError):
                pass
    for base, some in asked.items():
        try:
            infos = _store(base).get_file_info([name for _, name in some])
        except (OSError, ValueError):
            infos = [_info(base, name) for _, name in some]
        for (i, _), info in zip(some, infos):
            out[i] = info is not None and info.type != pafs.FileType.NotFound
    return out


def _info(base: str, name: str) -> pafs.FileInfo | None:
    try:
        return _store(base).get_file_info(name)
    except (OSError, ValueError):
        return None


@F.arrow_udf(BooleanType())
def _there(paths: pa.Array) -> pa.Array:
    return pa.array(_found(paths.to_pylist()), pa.bool_())


# else Spark asks the store before its join, for all links and all files
_there = _there.asNondeterministic()


def resolved(path: Column) -> Column:
    """The path's steps as an array, with "." and ".." taken, however many there are."""
    step = lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def plain(path: Column) -> Column:
    """The steps of `resolved` joined by slashes; only paths that have something to resolve, beside "." between others, go through it."""
    bare = F.ltrim(path, F.lit("/"))
    for _ in range(2):  # as those beside each other overlap
        bare = F.replace(bare, F.lit("/./"), F.lit("/"))
    steps = F.concat(F.lit("/"), bare, F.lit("/"))
    return F.when(steps.contains("//") | steps.contains("/./") | steps.contains("/../"), F.array_join(resolved(path), "/")).otherwise(bare)


def within(path: Column) -> Column:
    """The path up to its last slash, with it; empty where there is none."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


def broken_links(docs: DataFrame, files: DataFrame, root: str, tools: tuple[str, ...] = TOOLS) -> DataFrame:
    """(path, link): what Markdown documents (path, content) below a root refer to and no file (path) or folder is.

    References are links, with a title or without, that don't lead to another site, mail or the document itself, and
    paths of tools in backticks. Those that begin with a slash or a tool's folder count from the root, others from the
    document; percent signs are decoded, fragments cut off. Patterns (with <, { or *) aren't judged. What no listed file
    accounts for, as empty and hidden files aren't listed, is looked for in the store itself."""
    link, tool = r'\[[^\]]*\]\((?!https?:|mailto:|#)([^)\s]+)(?:\s+"[^"]*")?\)', rf"`((?:{'|'.join(tools)})/[A-Za-z0-9._/-]+)`"
    # outer, as Spark would otherwise look for the references once more to leave out documents without any
    asked = docs.select("path", F.explode_outer(F.array_distinct(F.concat(*(F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in (link, tool))))).alias("link"))
    bare = F.substring_index("link", "#", 1)
    own = F.when(bare.contains("%"), F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)).otherwise(bare)
    asked = asked.withColumn("clean", own).where("clean <> '' and not (contains(clean, '<') or contains(clean, '{') or contains(clean, '*'))")
    from_root = reduce(or_, (F.col("link").startswith(f"{t}/") for t in ("", *tools)))
    # the steps up that a link begins with are taken from its folder at once
    folder = plain(F.rtrim(F.when(from_root, F.lit(root)).otherwise(within(F.col("path"))), F.lit("/")))
    asked = asked.withColumns({"folder": folder, "up": F.regexp_extract("clean", r"^(?:\.{0,2}/)+", 0)})
    left = F.length("folder") - F.length(F.replace("folder", F.lit("/"))) + 1 - F.regexp_count("up", F.lit(r"\.\."))
    kept = F.call_function("substring_index", "folder", F.lit("/"), F.greatest(left, F.lit(0)))
    asked = asked.withColumn("whole", F.concat(kept, F.lit("/"), F.substring("clean", F.length("up") + 1, F.length("clean")))).withColumn("target", plain(F.col("whole")))
    # all files, and every folder that one is in
    own = files.select(plain(F.col("path")).alias("target"))
    steps = own.select(F.split(F.rtrim(within(F.col("target")), F.lit("/")), "/").alias("s")).distinct()
    folders = steps.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.array_join(F.slice("s", 1, n), "/"))).alias("target")).distinct()
    # the hash goes first, as sorting by numbers is faster than by paths that begin alike
    key = ["h", "target"]
    hashed = lambda df: df.withColumn("h", F.xxhash64("target"))
    lost = hashed(asked.select("path", "link", "target")).join(hashed(own.unionByName(folders)), key, "left_anti")
    return lost.where(~_there("target")).select("path", "link")


def check(spark: SparkSession, folder: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, link): broken links of all documents below a folder."""
    files = paths(spark, folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    return broken_links(documents(spark, folder, skip), files, root)
