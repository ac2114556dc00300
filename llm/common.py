"""Small helpers shared by the operators: reading, durable cuts, hashes, Arrow batches."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word contracts: 0x20 and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this repository's packages to the executors, once for each application."""
    import atexit
    import tempfile
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.TemporaryDirectory()  # the driver's own; executors fetch the file from the driver
    atexit.register(folder.cleanup)
    path = f"{folder.name}/pipeline_packages.zip"
    with zipfile.ZipFile(path, "w") as z:
        for package in ("llm", "barweave"):
            for f in sorted((root / package).rglob("*.py")):
                z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cut(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    The lineage ends at durable files: a lost executor re-reads them.
    """
    return _cut(df, name, compression)[0]


def free(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, the shuffle files of a query go when it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Cuts whose files go when they have been read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _cut(df, name)
        self.paths[id(out)] = out, path
        return out

    def free(self, *tables: DataFrame) -> None:
        for table in tables:
            free(self.spark, self.paths.pop(id(table))[1])

    def free_all(self, *, but: DataFrame) -> None:
        self.free(*[table for table, _ in self.paths.values() if table is not but])


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[column], F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def dealt(*columns: str) -> Column:
    """A non-negative hash that deals rows out evenly, and equally when a task is repeated."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def utf8_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
