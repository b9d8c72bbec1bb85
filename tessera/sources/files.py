"""Tables from and to files: partitioned Parquet, feather days, wide tables, calendars, manifests, pipe-delimited hand-offs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FeatherFiles(DataSource):
    """``spark.read.format("feather")``: one partition per Arrow IPC file. Options: path (a file or a pattern), tolerant (skip unreadable files).

    Files must lie where the executors can open them; Parquet is the better home for anything read more than once (``converted``).
    """

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> str:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_opened(_matching(self.options["path"])[0]).schema)

    def reader(self, schema) -> DataSourceReader:
        return _FeatherReader(self.options, schema)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _FeatherReader(DataSourceReader):
    def __init__(self, options, schema) -> None:
        self.paths = _matching(options["path"])
        self.tolerant = str(options.get("tolerant", "false")).lower() == "true"
        self.columns = schema.names

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator:
        import pyarrow as pa

        try:
            table = _opened(partition.path)
        except (pa.ArrowInvalid, OSError):
            if self.tolerant:
                return
            raise
        yield from table.select(self.columns).combine_chunks().to_batches(max_chunksize=65_536)


def _matching(pattern: str) -> list[str]:
    import glob

    found = sorted(glob.glob(pattern))
    if not found:
        raise FileNotFoundError(pattern)
    return found


def _opened(path: str):
    import pyarrow as pa
    import pyarrow.feather

    try:
        table = pyarrow.feather.read_table(path)
    except pa.ArrowInvalid:
        with pa.memory_map(path) as source:
            table = pa.ipc.open_stream(source).read_all()
    fine = [f.with_type(pa.timestamp("us", f.type.tz)) if pa.types.is_timestamp(f.type) else f for f in table.schema]
    return table.cast(pa.schema(fine), safe=False).replace_schema_metadata(None)  # Spark's timestamps have microseconds


def read_feather(spark: SparkSession, pattern: str, tolerant: bool = False) -> DataFrame:
    spark.dataSource.register(FeatherFiles)
    return spark.read.format("feather").option("path", pattern).option("tolerant", str(tolerant).lower()).load()


def unreadable(pattern: str) -> list[str]:
    """Files of the pattern that are neither feather nor an Arrow stream."""
    import pyarrow as pa

    bad = []
    for p in _matching(pattern):
        try:
            _opened(p)
        except (pa.ArrowInvalid, OSError):
            bad.append(p)
    return bad


def converted(spark: SparkSession, pattern: str, folder: str, *by: str) -> DataFrame:
    """Feather files written once as partitioned Parquet, which prunes by partition from then on."""
    write_partitioned(read_feather(spark, pattern, tolerant=True), folder, *by)
    return spark.read.parquet(folder)


def long_from_wide(wide: DataFrame, field: str, date: str = "TRADE_DATE") -> DataFrame:
    """A table of one column per code as (trade_date, code, field); codes have six digits, missing cells stay out."""
    codes = [c for c in wide.columns if c != date]
    named = wide.select(F.to_date(date).alias("trade_date"), *(F.col(f"`{c}`").cast("double").alias(c.zfill(6)) for c in codes))
    return named.unpivot(["trade_date"], [c.zfill(6) for c in codes], "code", field).where(F.col(field).isNotNull() & ~F.isnan(field))


def wide_from_long(frame: DataFrame, field: str, codes: list[str], single: bool = False) -> DataFrame:
    """One column per code, at an export boundary only: the codes are given, so that the shape does not depend on the data."""
    out = frame.groupBy("trade_date").pivot("code", codes).agg(F.first(field)).orderBy("trade_date")
    return out.select("trade_date", *(F.col(f"`{c}`").cast("float").alias(c) for c in codes)) if single else out


def read_pickled(spark: SparkSession, pattern: str, field: str) -> DataFrame:
    """(trade_date, code, field) from pickled wide frames (index or first column: the date; a column per code): one task per file, opened on the executors.

    Unpickling runs what the file says: only for files of one's own.
    """

    def run(batches: Iterator) -> Iterator:
        import io

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                wide = pd.read_pickle(io.BytesIO(content))
                if not isinstance(wide.index, pd.DatetimeIndex):
                    wide = wide.set_index(wide.columns[0])
                wide = wide.rename_axis(index="trade_date", columns="code")
                long = wide.reset_index().melt(id_vars="trade_date", var_name="code", value_name=field).dropna()
                yield pd.DataFrame({"trade_date": pd.to_datetime(long["trade_date"]).dt.date, "code": long["code"].astype(str).str.zfill(6), field: long[field].astype(float)})

    return spark.read.format("binaryFile").load(pattern).select("content").mapInPandas(run, f"trade_date date, code string, `{field}` double")


def read_stock_files(spark: SparkSession, pattern: str, schema: str, renamed: dict[str, str] | None = None, skip: int = 0) -> DataFrame:
    """Many feather files of one stock each as one table: each file's first ``skip`` rows left out, columns renamed and cast to ``schema``; code, if
    the files have none, is the file's name without its ending. One task per file, opened on the executors."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.feather

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                table = pyarrow.feather.read_table(pa.BufferReader(content.as_buffer())).slice(skip)
                table = table.rename_columns([(renamed or {}).get(c, c) for c in table.column_names])
                if "code" in names and "code" not in table.column_names:
                    table = table.append_column("code", pa.array([path.rsplit("/", 1)[-1].rsplit(".", 1)[0]] * len(table), pa.string()))
                yield from table.select(names).combine_chunks().to_batches()

    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(_parse_datatype_string(schema))

    def cast(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in run(batches):
            yield from pa.Table.from_batches([b]).cast(wanted, safe=False).to_batches()

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(cast, schema)


def register_tables(spark: SparkSession, folder: str, *names: str) -> None:
    """Each table ``folder/name.parquet`` as a temporary view for SQL."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def merged(tables: list[DataFrame], *keys: str) -> DataFrame:
    """Result tables joined in full by ``keys`` (code); of columns of one name the first table's stay."""
    keys = keys or ("code",)
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.drop(*(c for c in t.columns if c in out.columns and c not in keys)), list(keys), "full")
    return out


def as_known(frame: DataFrame, as_of: str) -> DataFrame:
    """Rows up to a date: what was known then."""
    return frame.where(F.col("trade_date") <= F.lit(as_of).cast("date"))


def between(frame: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a date range; on a table partitioned by trade_date only its partitions are read."""
    day = F.col("trade_date")
    out = frame if start is None else frame.where(day >= F.lit(start).cast("date"))
    return out if end is None else out.where(day <= F.lit(end).cast("date"))


def calendar(frame: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The distinct dates of a table in a range."""
    return between(frame.select("trade_date").distinct(), start, end)


def write_partitioned(frame: DataFrame, folder: str, *by: str, sort: tuple[str, ...] = (), compression: str = "zstd") -> None:
    """Partitioned Parquet, replacing only the partitions that the frame has; rows of a partition meet before the write, sorted."""
    out = frame.repartition(*by) if by else frame
    out = out.sortWithinPartitions(*by, *sort) if sort else out
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*by).parquet(folder)


def write_delimited(frame: DataFrame, folder: str, separator: str = "|") -> None:
    frame.write.mode("overwrite").option("header", True).option("sep", separator).csv(folder)


def record(path: str, **entry: object) -> None:
    """One line of JSON appended to a manifest on the driver."""
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps({"at": datetime.now(timezone.utc).isoformat(), **entry}, default=str) + "\n")


def head_sample(frame: DataFrame, n: int, how: str = "first", seed: int = 0, keys: tuple[str, ...] = ("code", "trade_date")) -> DataFrame:
    """A sampling operator: the first n rows by key, n random ones, or n split between both ends; each key once."""
    once = frame.dropDuplicates(list(keys))
    if how == "random":
        return once.orderBy(F.rand(seed)).limit(n)
    if how == "ends":
        return once.orderBy(*keys).limit(n - n // 2).union(once.orderBy(*(F.desc(k) for k in keys)).limit(n // 2)).dropDuplicates(list(keys))
    return once.orderBy(*keys).limit(n)
