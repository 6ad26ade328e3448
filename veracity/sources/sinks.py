"""Sinks (K-1 .. K-3) and scratch locations on the shared filesystem."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from veracity.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Never a machine-local temp folder: every executor must see the files.
    """
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/veracity-{name}-{uuid.uuid4().hex[:12]}"


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside ``path``, then put it in the place of ``path`` (K-3).

    A write that fails leaves the old content as it is.  The swap is two
    renames of the shared file system; if the second one fails, the old
    folder goes back.  A swap that was cut short between the two is made
    good by the next call: the old folder is still there under its own name.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    nxt, old = (hadoop.fs.Path(target.getParent(), f".{target.getName()}.{kind}") for kind in ("next", "old"))
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            _rename(fs, old, target)
    fs.delete(nxt, True)
    write(nxt.toString())
    had = fs.exists(target)
    if had:
        _rename(fs, target, old)
    try:
        _rename(fs, nxt, target)
    except Exception:
        if had:
            _rename(fs, old, target)
        raise
    fs.delete(old, True)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source.toString()} to {target.toString()}")


def write_csv(df: DataFrame, path: str, columns: Sequence[str], header: bool = True,
              sep: str = ",", partition_by: Sequence[str] = ()) -> None:
    """CSV with a fixed column order (K-1), replaced as a whole (K-3)."""
    w = df.select(*columns, *[c for c in partition_by if c not in columns]).write \
        .option("header", header).option("sep", sep).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        w = w.partitionBy(*partition_by)
    replace_folder(df.sparkSession, path, w.csv)


def write_text_lines(df: DataFrame, path: str) -> None:
    """One line per row of a single string column (JSON Lines export, K-2), replaced as a whole (K-3)."""
    replace_folder(df.sparkSession, path, df.write.text)
