"""Files as documents: enumeration, include and exclude globs, MIME types."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.text import extension
from loamline.session import ship, shipped
from loamline.sources import corpus

# The extensions and file names that are indexed by default, and what is skipped.
DEFAULT_EXTENSIONS = "md markdown html htm pdf epub docx xlsx pptx odt ods odp txt text rs py js mjs ts tsx json yaml yml toml lock c h cpp hpp go java rb php sh css scss sql csv xml ini cfg".split()
LOCKFILES = ["Cargo.lock", "package-lock.json", "yarn.lock", "poetry.lock", "Gemfile.lock"]
DEFAULT_INCLUDES = [f"**/*.{e}" for e in DEFAULT_EXTENSIONS] + [f"**/{name}" for name in LOCKFILES]
DEFAULT_EXCLUDES = [f"**/{name}" for name in (".git", "node_modules", ".DS_Store", "target", "__pycache__", ".venv")]
# The MIME type that is stored for an extension.
STORED_MIME = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "pdf": "application/pdf",
    "epub": "application/epub+zip", "rs": "text/x-rust", "py": "text/x-python", "js": "text/javascript", "mjs": "text/javascript", "ts": "text/typescript",
    "tsx": "text/typescript", "json": "application/json", "yaml": "text/yaml", "yml": "text/yaml", "toml": "text/toml",
}


class RootUnavailable(OSError):
    """The root of a path source can't be listed; nothing may be concluded about its files."""


def glob_regex(glob: str) -> str:
    """A whole-path pattern: * and ? stay within a component, ** crosses them, **/ may match nothing."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = glob[k]
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return f"^{out}$"


def matches(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def selected(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path relative to the root is indexed: it matches an include, and neither it nor a folder above it is
    excluded by relative path or by bare name."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    out = DEFAULT_EXCLUDES if exclude is None else exclude
    pruned = F.exists(above, lambda p: matches(p, out)) | F.exists(parts, lambda p: matches(p, out)) if out else F.lit(False)
    return matches(path, DEFAULT_INCLUDES if include is None else include) & ~pruned


def enumerate_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """uri, path (relative), modified, size and content of the files to index below root; a file as root stands for itself.

    Folders on a mounted file system are walked, see walk(), which takes keep. Other storage is left to Spark's reader, which may
    know it when workers don't: it lists everything below root and leaves out names that begin with a dot or an underscore.
    A root that isn't there raises RootUnavailable.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    try:
        status = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    except Exception as e:
        raise RootUnavailable(root) from e
    base = status.getPath().toString().rstrip("/")
    if status.isDirectory() and base.startswith("file:"):
        return with_content(walk(spark, base, include, exclude, keep)[0]).select("uri", "path", "modified", "size", "content")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if status.isFile():
        return rows.select(F.col("path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    relative = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(re.sub("^file:/+", "file:/", base)) + 2, 1 << 20)
    rows = rows.select(F.col("path").alias("uri"), relative.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return rows.filter(selected(F.col("path"), include, exclude))


# --- the walk: a level of folders at a time, excluded folders are never listed ------------------------------------------

ENTRIES = "path string, uri string, folder boolean, size long, millis long"
_BATCH = 4096


def _local(uri: str) -> str | None:
    """The local path of a file: URI or of a path without a scheme; None for other storage."""
    return re.sub("^file:(//)?", "", uri) if re.match("file:|/", uri) else None


def _listing(uri: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """name, uri, whether it's a folder, size and milliseconds of what lies in a folder. Links are followed and local URIs are those of the real paths.

    A local folder is read as it streams; of other storage a folder's listing is held by its task. What can't be listed is an error.
    """
    local = _local(uri)
    if local is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
        for e in store.get_file_info(fs.FileSelector(at)):
            if e.type != fs.FileType.NotFound:
                yield e.base_name, f"{uri.rstrip('/')}/{e.base_name}", e.type == fs.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1_000_000
        return
    with os.scandir(local) as entries:
        for e in entries:
            if e.is_dir() or e.is_file():
                at = e.stat()
                yield e.name, "file:" + os.path.realpath(e.path), e.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in ENTRIES.split(", ")]
    for batch in batches:
        for path, uri in zip(batch["path"], batch["uri"], strict=True):
            held = []
            for name, *rest in _listing(uri):
                held.append((f"{path}/{name}" if path else name, *rest))
                if len(held) == _BATCH:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
            yield pd.DataFrame(held, columns=columns)


def walk(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files to index below a folder (uri, path, modified, size), and the folders that were listed (path, uri; the root's path is empty).

    Each level's folders are a table, dealt over the tasks that list them; an excluded folder is dropped before the next level, so
    nothing below it is listed. A folder that several links lead to is listed once, by its shortest and then first path. Names that
    begin with a dot or an underscore are files like others. keep() writes a frame and reads it back; by default below spark.checkpoint.dir.
    """
    ship(spark)
    if keep is None:
        base, made = corpus.new_folder(spark, "walk"), []

        def keep(frame: DataFrame) -> DataFrame:
            made.append(f"{base}/{len(made)}")
            frame.write.parquet(made[-1])
            return spark.read.schema(frame.schema).parquet(made[-1])

    out = DEFAULT_EXCLUDES if exclude is None else exclude
    wanted = matches(F.col("path"), DEFAULT_INCLUDES if include is None else include)
    local = _local(root)
    at = root.rstrip("/") if local is None else "file:" + os.path.realpath(local)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    level = spark.createDataFrame([("", at)], "path string, uri string")
    found, listed = None, None
    while True:
        listed = level if listed is None else listed.unionByName(level)
        entries = level.repartition(tasks, "path").mapInPandas(_list_folders, ENTRIES)
        pruned = matches(F.col("path"), out) | matches(F.element_at(F.split("path", "/"), -1), out)
        entries = keep(entries.filter(~pruned & (F.col("folder") | wanted)))
        files = entries.filter("NOT folder")
        found = files if found is None else found.unionByName(files)
        below = entries.filter("folder").groupBy("uri").agg(F.min("path").alias("path")).select("path", "uri")
        level = keep(below.join(listed.select("uri"), "uri", "left_anti").select("path", "uri"))
        if level.isEmpty():
            break
    return found.select("uri", "path", F.timestamp_millis("millis").alias("modified"), "size"), listed


def with_content(found: DataFrame) -> DataFrame:
    """Files of walk() with content, each read as it is needed. A file that has gone since is an error: a listing that isn't whole proves nothing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):
                row, uri = batch.iloc[k : k + 1], batch["uri"].iloc[k]
                if (local := _local(uri)) is not None:
                    with open(local, "rb") as f:
                        yield row.assign(content=[f.read()])
                else:
                    from pyarrow import fs

                    store, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
                    with store.open_input_stream(at) as f:
                        yield row.assign(content=[f.read()])

    kinds = ", ".join(f"`{n}` {t}" for n, t in found.dtypes)
    return shipped(found).mapInPandas(read, f"{kinds}, content binary")


def stored_mime(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in STORED_MIME.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(extension(name))), F.lit("application/octet-stream"))


#: Leading bytes, in hex, and the type they tell.
MAGIC = (("25504446", "application/pdf"), ("504b0304", "application/zip"), ("89504e470d0a1a0a", "image/png"), ("ffd8ff", "image/jpeg"), ("474946383", "image/gif"), ("1f8b", "application/gzip"))


def sniffed_mime(content: Column, name: Column) -> Column:
    """By leading bytes, an EPUB's or Office file's being those of a zip with a telling entry; else by extension; else null."""
    head = F.lower(F.hex(F.substring(content, 1, 64)))
    out = F.when(F.contains(head, F.lit(b"mimetypeapplication/epub+zip".hex())), "application/epub+zip")
    for magic, mime in MAGIC:
        out = out.when(head.startswith(magic), mime)
    by_name = stored_mime(name)
    return out.otherwise(F.when(by_name != "application/octet-stream", by_name))
