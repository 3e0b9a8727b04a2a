"""Writers. All go through Spark's commit protocol; row order is kept by sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, partition: str | None = None, header: bool = True) -> None:
    """Tabs, no quoting, backslash escapes; a folder a value of ``partition``."""
    names = [c for c in df.columns if c != partition]
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"([\\\t])", r"\\$1"), "\n", r"\\n")
    line = F.concat_ws("\t", *[F.coalesce(safe(c), F.lit("NA")) for c in names])
    # one column, whose separator no line holds: the writer has nothing to quote
    out = df.select(line.alias("\t".join(names)), *([partition] if partition else [])).write.mode("overwrite")
    out = out.partitionBy(partition) if partition else out
    out.csv(path, sep="\x01", header=header, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_lines(df: DataFrame, path: str, order: Sequence[str] = (), partition: str | None = None) -> None:
    """Non-ASCII characters are kept; null fields too."""
    rows = df.sortWithinPartitions(*order) if order else df
    out = rows.write.mode("overwrite").option("ignoreNullFields", False)
    (out.partitionBy(partition) if partition else out).json(path)


def text_lines(df: DataFrame, column: str, path: str, order: Sequence[str]) -> None:
    """A line a row, in global order over the files by name."""
    df.orderBy(*order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def score_vector(df: DataFrame, value: str, path: str, order: Sequence[str], decimals: int = 8) -> None:
    df.orderBy(*order).select(F.format_string(f"%.{decimals}f", F.col(value)).alias("value")).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def r_tables(df: DataFrame, path: str, factors: Sequence[str] = ()) -> None:
    """Binary R tables, one a partition."""
    from .rtables import RTables

    df.sparkSession.dataSource.register(RTables)
    df.write.format("rtable").mode("append").option("factors", ",".join(factors)).save(path)


def document_files(df: DataFrame, line: Column, name: Column, path: str, order: Sequence[str]) -> None:
    """One text file a document, ``path``/``name``, its lines in order.

    Rows of a name meet in one task, which writes them sorted through Spark's commit
    protocol; then only the files are renamed, by the driver.
    """
    spark = df.sparkSession
    rows = df.select(line.cast("string").alias("value"), name.alias("__name"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(order)])
    rows = rows.repartition("__name").sortWithinPartitions("__name", *[f"__{k}" for k in range(len(order))])
    rows.select("value", "__name").write.mode("overwrite").partitionBy("__name").text(f"{path}/_parts")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(f"{path}/_parts")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for folder in fs.listStatus(root):
        if folder.isDirectory() and folder.getPath().getName().startswith("__name="):
            to = fs_path(f"{path}/{unescaped(folder.getPath().getName().split('=', 1)[1])}")
            fs.mkdirs(to.getParent())
            for part in fs.listStatus(folder.getPath()):
                fs.rename(part.getPath(), to)
    fs.delete(root, True)
