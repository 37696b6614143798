"""Library source trees as rows of files."""

from __future__ import annotations

import tarfile
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wane.functions.text import module_path
from wane.session import cut_lineage


#: Bytes of text that a reader hands on at a time.
BATCH_BYTES = 8_000_000


def _listed(folders, deep):
    """Rows (root, folder, file, below) of the folders in (root, folder): Python files, and folders within or, with ``deep``, their files too.

    Spark's own listing hides names that begin with an underscore.
    """
    for root, folder in folders:
        system, base = fs.FileSystem.from_uri(root)
        todo, cut = [folder or base], len(base.rstrip("/")) + 1
        while todo:  # folder by folder, so that a large tree is not held as a whole
            found = system.get_file_info(fs.FileSelector(todo.pop()))
            within = sorted(f.path for f in found if f.type == fs.FileType.Directory)
            paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".py"))
            rows = [(root, None, p, p[cut:]) for p in paths]
            if deep:
                todo += within
            else:
                rows += [(root, p, None, None) for p in within]
            if rows:
                yield pd.DataFrame(rows, columns=["root", "folder", "file", "below"])


def _list_level(batches):
    for batch in batches:
        yield from _listed(zip(batch["root"], batch["folder"]), False)


def _list_below(batches):
    for batch in batches:
        yield from _listed(zip(batch["root"], batch["folder"]), True)


def list_files(roots: DataFrame, levels: int = 2, enough: int = 256) -> DataFrame:
    """(root, file, below) of the Python files below each root.

    The first ``levels`` of folders are listed one level at a time, so that the folders of one large root spread over tasks; from there, or
    from ``enough`` folders on, each task walks what is below its folders.
    """
    parts = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    form = "root string, folder string, file string, below string"
    front = roots.select("root", F.lit(None).cast("string").alias("folder")).distinct()
    found = []
    for _ in range(levels):
        level = cut_lineage(front.repartition(parts, "root", "folder").mapInPandas(_list_level, form))
        found.append(level.where("file is not null"))
        front = level.where("folder is not null").select("root", "folder")
        if front.limit(enough).count() >= enough:
            break
    below = front.repartition(parts, "root", "folder").mapInPandas(_list_below, form)
    for level in found:
        below = below.unionByName(level)
    return below.select("root", "file", "below")


def _batches_by_bytes(rows, columns):
    """Frames of about BATCH_BYTES; each row comes with the size of its text."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _read_files(batches):
    """Text of each file; bytes that are not UTF-8 become the replacement character."""
    for batch in batches:
        def read(batch=batch):
            for row in batch.itertuples(index=False):
                try:
                    with fs.FileSystem.from_uri(row.root)[0].open_input_stream(row.file) as f:
                        text = f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                    yield (*row, text, None), len(text)
                except OSError as e:
                    yield (*row, None, f"Read error: {e}"), 0

        yield from _batches_by_bytes(read(), [*batch.columns, "source", "error"])


def scan_roots(roots: DataFrame) -> DataFrame:
    """Files of all trees in ``root, library, version[, snapshot]``: file, prefix, source, the other columns, error.

    Folders are listed by tasks, and the paths are spread before the files are read, so
    neither names nor contents pass through the driver. The columns of a root are joined to
    paths, never to texts.
    """
    others = [c for c in roots.columns if c not in ("root", "library")]
    listed = list_files(roots)
    # a number of its own: paths are small, and adaptive execution would put the reading of all files into one task
    parts = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = listed.join(roots, "root").repartition(parts, "file")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema.fields)
    read = paths.mapInPandas(_read_files, f"{kinds}, source string, error string")
    return read.select(
        "file", module_path(F.col("below"), F.col("library")).alias("prefix"), "source", "library", *others, "error")


def scan_tree(spark: SparkSession, root: str, library: str, version: str | None = None) -> DataFrame:
    """All Python files below one folder."""
    return scan_roots(spark.createDataFrame([(root, library, version)], "root string, library string, version string"))


def scan_snapshots(spark: SparkSession, base: str, snapshots: dict[str, list[str]]) -> DataFrame:
    """Every snapshot folder ``base/<library>-<version>/<library>`` in one DataFrame.

    ``snapshot`` is the number of the folder in the order given: catalog order is (snapshot, file, ord).
    """
    names = [(lib, snap) for lib, of_lib in snapshots.items() for snap in of_lib]
    rows = [(f"{base.rstrip('/')}/{snap}/{lib}", lib, snap.split("-", 1)[1], i) for i, (lib, snap) in enumerate(names)]
    return scan_roots(spark.createDataFrame(rows, "root string, library string, version string, snapshot int"))


def coverage_gaps(files: DataFrame) -> DataFrame:
    """Files that cannot be read, or that hold bytes which are not UTF-8."""
    bad = F.contains("source", F.lit("\ufffd"))
    return files.where(F.col("error").isNotNull() | bad).select(
        "file", F.coalesce("error", F.lit("undecodable bytes")).alias("error"))


def scan_file(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """One file; a missing path is an error."""
    row = spark.createDataFrame([(path, path)], "root string, file string")
    read = row.mapInPandas(_read_files, "root string, file string, source string, error string")
    found = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    return read.where(found).select("file", F.lit(prefix).alias("prefix"), "source")


def _place(name, library):
    """Path of a member below the library's folder, None for others."""
    head, mark, rest = f"/{name}".partition(f"/{library}/")
    return rest if mark and name.endswith(".py") and head.count("/") <= 1 else None


def from_archives(spark: SparkSession, pattern: str, library: str) -> DataFrame:
    """Python members of wheels and source archives; compiled members are left out.

    The directory of a zip file is read alone, and its members are spread over tasks, which open the file at their places; so one large
    archive is read by many. A compressed tar file can only be read from its beginning and goes to one task as a whole.
    """

    def names(batches):
        """(path, member): the members of zip files; tar files as they are."""
        for batch in batches:
            for path in batch["path"]:
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as f:
                    if not zipfile.is_zipfile(f):
                        yield pd.DataFrame({"path": [path], "member": [None]})
                        continue
                    with zipfile.ZipFile(f) as z:
                        found = [n for n in z.namelist() if _place(n, library) is not None]
                for k in range(0, len(found), 10_000):
                    yield pd.DataFrame({"path": path, "member": found[k : k + 10_000]})

    def texts(path, members):
        system, place = fs.FileSystem.from_uri(path)
        if members == [None]:
            with system.open_input_stream(place, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as t:
                for m in t:
                    if m.isfile() and _place(m.name, library) is not None:
                        yield (f"{path}!{m.name}", _place(m.name, library), text := t.extractfile(m).read().decode("utf-8", "replace")), len(text)
            return
        with system.open_input_file(place) as f, zipfile.ZipFile(f) as z:
            for name in members:
                yield (f"{path}!{name}", _place(name, library), text := z.read(name).decode("utf-8", "replace")), len(text)

    def read(batches):
        for batch in batches:
            for path, members in batch.groupby("path")["member"]:
                yield from _batches_by_bytes(texts(path, members.tolist()), ["file", "below", "source"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives = spark.read.format("binaryFile").load(pattern).select("path").repartition(parts, "path")
    members = archives.mapInPandas(names, "path string, member string").repartition(parts, "path", "member")
    rows = members.mapInPandas(read, "file string, below string, source string")
    return rows.select("file", module_path(F.col("below"), F.lit(library)).alias("prefix"), "source",
                       F.lit(library).alias("library"))
