"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv_typed(spark: SparkSession, path: str, schema: StructType, null_values: tuple = ("", "NA", "N/A", "null"), date_cols: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header and declared types: every column is read as text, null tokens are dropped, then cast; what does not parse is null."""
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    clean = {f.name: F.when(~F.trim(f.name).isin(list(null_values)), F.trim(f.name)) for f in schema.fields}
    dates = date_cols or {}
    typed = {f.name: F.try_to_date(clean[f.name], dates[f.name]) if f.name in dates else clean[f.name].try_cast(f.dataType) for f in schema.fields}
    return raw.select(*(c.alias(n) for n, c in typed.items()))


def jdbc_options(url: str, table: str, column: str | None = None, lower=None, upper=None, n: int | None = None, props: dict | None = None) -> dict:
    """Options of a JDBC read; with a column, of n parallel range reads."""
    out = {"url": url, "dbtable": table, **(props or {})}
    if column is not None:
        if n is None or n < 1 or lower is None or upper is None:
            raise ValueError("a partitioned read needs lower, upper and n")
        out |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(n)}
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower=None, upper=None, n: int | None = None, props: dict | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, column, lower, upper, n, props)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", props: dict | None = None) -> None:
    df.write.format("jdbc").options(**jdbc_options(url, table, props=props)).mode(mode).save()


def _sql(spark: SparkSession, url: str, statements: list[str], props: dict | None = None) -> int:
    """Run statements in one transaction of the database; returns the rows that the last one changed."""
    jvm = spark._jvm
    info = jvm.java.util.Properties()
    for k, v in (props or {}).items():
        info.setProperty(k, v)
    if "driver" in (props or {}):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(props["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, info)
    try:
        connection.setAutoCommit(False)
        changed = 0
        for text in statements:
            statement = connection.createStatement()
            changed = statement.executeUpdate(text)
            statement.close()
        connection.commit()
        return changed
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def foreach_batch_jdbc(url: str, table: str, props: dict | None = None):
    """A foreachBatch function that appends each micro-batch to a table once, however often it comes.

    The batch goes to a staging table first, which a failed attempt may leave and the next one
    replaces.  One transaction then moves it to the table and puts its number into the ledger
    ``<table>_batches``; a number that is there already is skipped.
    """
    ledger, stage = f"{table}_batches", f"{table}_stage"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write_jdbc(batch.limit(0), url, table, props=props)  # makes the table if it is not there
        write_jdbc(spark.createDataFrame([], "batch long"), url, ledger, props=props)
        if not read_jdbc(spark, url, ledger, props=props).where(F.col("batch") == number).isEmpty():
            return
        write_jdbc(batch, url, stage, "overwrite", props)
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
        columns = ", ".join(quoted(c) for c in batch.columns)
        _sql(spark, url, [f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}", f"INSERT INTO {ledger} ({quoted('batch')}) VALUES ({int(number)})"], props)
        _sql(spark, url, [f"DROP TABLE {stage}"], props)

    return write


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, files: int | None = None, sort_by: list[str] | None = None, **options) -> None:
    """Write a table; ``files`` bounds the files, ``partition_by`` lays out folders (rows of one folder meet first, so it has few files; a folder of many rows is cut at the size that adaptive execution advises)."""
    if files is not None:
        df = df.coalesce(files)
    elif partition_by:
        df = df.hint("rebalance", *(F.col(c) for c in partition_by))  # a repartition by key would leave a folder's rows to one task
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def land_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> list[str]:
    """Land each table in a folder of its own."""
    paths = []
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", mode=mode)
        paths.append(f"{root}/{name}")
    return paths


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset and Spark runs in one process."""
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarryflow.scratch.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-quarryflow-")
        spark.conf.set("quarryflow.scratch.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
