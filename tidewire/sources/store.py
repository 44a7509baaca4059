"""Files opened in tasks, wherever they lie, and the sources that read them."""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import DataFrameReader, SparkSession, datasource
from pyspark.sql.datasource import DataSource, Filter

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def open_file(path: str):
    """A file for random access, of a path or an address that pyarrow knows a file system for."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(inner)


def files_of(path: str) -> list[str]:
    """The files of a path: of a folder those that are not hidden, of a pattern in the last part those it fits, else the path itself."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    folder, _, last = inner.rstrip("/").rpartition("/")
    parent = path.rstrip("/").rpartition("/")[0]
    if any(c in last for c in "*?["):
        inner, pattern = folder, last
    elif system.get_file_info(inner).type == fs.FileType.Directory:
        parent, pattern = path.rstrip("/"), "*"
    else:
        return [path]
    found = [i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File]
    return [f"{parent}/{n}" for n in sorted(found) if fnmatch.fnmatch(n, pattern) and not n.startswith(("_", "."))]


def told(text: str) -> list[Filter]:
    """The filters that asking gave to a source as an option."""
    out = []
    for name, column, *value in json.loads(text or "[]"):
        out.append(getattr(datasource, name)((column,), *[tuple(v) if isinstance(v, list) else v for v in value]))
    return out


def asking(spark: SparkSession, source: type[DataSource], where: list[Filter], push: bool = False) -> DataFrameReader:
    """A reader of a source that is given filters (of pyspark.sql.datasource) to test as it reads. With push it is also given those that Spark finds in the
    plan. A frame read with push is for one use in one plan: Spark 4.1 keeps the filters of a frame's last planned use, so another use of
    the same frame, even in the same plan, would be read with them and lose rows."""
    spark.dataSource.register(source)
    if push:
        spark.conf.set(PUSHDOWN, "true")
    asked = json.dumps([[type(f).__name__, f.attribute[0], *([f.value] if hasattr(f, "value") else [])] for f in where])
    return spark.read.format(source.name()).option("asked", asked).option("push", str(push).lower())
