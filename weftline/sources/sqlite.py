"""S13. Tables of SQLite databases as a Spark data source, and descriptions of databases.

    register(spark)
    spark.read.format("sqlite").option("table", "orders").load("/shared/dbs").where("o_custkey = 7")

The path is a database or a folder of them, on a file system that the driver and all executors share. Every database is
read in ranges of row numbers, each a task's; filters on numbers and texts go into the databases' own queries, and a schema
of fewer columns reads only these. A value that its column's type cannot hold stops the read; read as text, all do. Written
frames become one database a partition.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Suffixes of databases in a folder.
SUFFIXES = (".sqlite", ".sqlite3", ".db")
#: Row numbers of one task, as long as a database has no more ranges than MOST.
ROWS = 200_000
MOST = 256
_BATCH = 10_000
#: Declared types whose values keep their order as the type read has it.
_AFFINE = re.compile("INT|CHAR|CLOB|TEXT|REAL|FLOA|DOUB", re.IGNORECASE)
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}


def local_path(path: str) -> str:
    """A path of a mounted file system without its scheme."""
    bare = path[len("file:") :] if path.startswith("file:") else path
    if "://" in bare and not bare.startswith("//"):
        raise ValueError(f"SQLite reads mounted file systems only, not {path}")
    return "/" + bare.lstrip("/") if path.startswith("file:") else bare


def databases(path: str) -> list[str]:
    """A database, or those below a folder, in order."""
    at = local_path(path)
    if os.path.isfile(at):
        return [at]
    found = sorted(os.path.join(d, f) for d, _, some in os.walk(at) for f in some if f.endswith(SUFFIXES) and not f.startswith(("_", ".")))
    if not found:
        raise FileNotFoundError(f"no SQLite database at {path}")
    return found


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> T.DataType:
    """The type of a declared one by the rules of affinity; what has numeric affinity or no type is read as text."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else T.StringType()


def _declared(path: str, table: str) -> dict[str, str]:
    with closing(_open(path)) as c:
        found = {r[1]: r[2] or "" for r in c.execute(f"pragma table_info({_quoted(table)})")}
    if not found:
        raise ValueError(f"no table {table} in {path}")
    return found


@dataclass
class _Range(InputPartition):
    path: str
    first: int | None  # None: the whole table
    last: int | None


class SQLiteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, rows: int):
        self._path, self._table, self._schema, self._rows = path, table, schema, rows
        self._where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters of columns that are declared and read as the same kind of number or text become part of the query; Spark
        keeps all of them, as a database may hold other values than its columns declare."""
        declared = [_declared(p, self._table) for p in databases(self._path)]
        kinds = {f.name: {spark_type(d[f.name]) if f.name in d and _AFFINE.search(d[f.name]) else None for d in declared} for f in self._schema}
        types = {f.name: type(f.dataType) for f in self._schema if kinds[f.name] == {f.dataType}}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            fits = {T.LongType: int, T.DoubleType: float, T.StringType: str}.get(types.get(name))
            if fits is None:
                continue
            if isinstance(f, (IsNull, IsNotNull)):
                self._where.append((f"{_quoted(name)} is {'not ' * isinstance(f, IsNotNull)}null", []))
            elif type(f) in _SIGNS and type(f.value) is fits and f.value == f.value:
                self._where.append((f"{_quoted(name)} {_SIGNS[type(f)]} ? collate binary", [f.value]))
            elif isinstance(f, In) and f.value and all(type(v) is fits for v in f.value) and len(f.value) <= 500:
                self._where.append((f"{_quoted(name)} collate binary in ({', '.join('?' * len(f.value))})", list(f.value)))
        return filters

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path in databases(self._path):
            first = last = None
            if not {"rowid"} & {n.lower() for n in _declared(path, self._table)}:  # else the name means a column
                with closing(_open(path)) as c:
                    table = c.execute("select 1 from sqlite_master where type = 'table' and name = ? collate nocase", [self._table]).fetchone()
                    try:
                        first, last = (c.execute(f"select {f}(rowid) from {_quoted(self._table)}").fetchone()[0] for f in ("min", "max")) if table else (None, None)
                    except sqlite3.OperationalError:  # a table without row numbers
                        pass
            if first is not None:
                step = max(self._rows, -(-(last - first + 1) // MOST))
                found += [_Range(path, a, min(last, a + step - 1)) for a in range(first, last + 1, step)]
            else:
                found.append(_Range(path, None, None))
        return found

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        where, values = list(self._where), [x for _, some in self._where for x in some]
        if part.first is not None:
            where.append(("rowid between ? and ?", []))
            values += [part.first, part.last]
        of = lambda f: f"cast({_quoted(f.name)} as text)" if isinstance(f.dataType, T.StringType) else _quoted(f.name)
        query = f"select {', '.join(map(of, self._schema)) or '1'} from {_quoted(self._table)}" + " where " * bool(where) + " and ".join(w for w, _ in where)
        schema = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in self._schema])
        with closing(_open(part.path)) as c:
            rows = c.execute(query, values)
            while some := rows.fetchmany(_BATCH):
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*some), schema.types)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class SQLiteWriter(DataSourceWriter):
    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self._path, self._table, self._schema, self._overwrite = local_path(path), table, schema, overwrite

    def write(self, rows: Iterator) -> _Written:
        """A task's rows as a database, which counts once it is renamed."""
        os.makedirs(self._path, exist_ok=True)
        at = os.path.join(self._path, f"_{uuid.uuid4().hex}.sqlite")
        names = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL", T.BinaryType: "BLOB"}
        columns = ", ".join(f"{_quoted(f.name)} {names.get(type(f.dataType), 'TEXT')}" for f in self._schema)
        with closing(sqlite3.connect(at)) as c:
            c.execute("pragma journal_mode = off")
            c.execute(f"create table {_quoted(self._table)} ({columns})")
            c.executemany(f"insert into {_quoted(self._table)} values ({', '.join('?' * len(self._schema))})", map(tuple, rows))
            c.commit()
        return _Written(at)

    def commit(self, messages: list[_Written | None]) -> None:
        done = [m.path for m in messages if m]
        if self._overwrite:
            keep = set(done)
            for f in os.listdir(self._path) if os.path.isdir(self._path) else ():
                if f.endswith(SUFFIXES) and os.path.join(self._path, f) not in keep:
                    os.remove(os.path.join(self._path, f))
        for at in done:
            os.rename(at, os.path.join(os.path.dirname(at), f"part-{os.path.basename(at)[1:]}"))

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class SQLiteSource(DataSource):
    """Options: path; table; rows, the row numbers of a task."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        declared = _declared(databases(self.options["path"])[0], self.options["table"])
        return T.StructType([T.StructField(n, spark_type(d)) for n, d in declared.items()])

    def reader(self, schema: T.StructType) -> SQLiteReader:
        odd = [f.name for f in schema if type(f.dataType) not in _ARROW]
        if odd:
            raise ValueError(f"columns {odd} are no numbers, texts or bytes")
        return SQLiteReader(self.options["path"], self.options["table"], schema, int(self.options.get("rows", ROWS)))

    def writer(self, schema: T.StructType, overwrite: bool) -> SQLiteWriter:
        odd = [f.name for f in schema if type(f.dataType) not in _ARROW]
        if odd:
            raise ValueError(f"columns {odd} are no numbers, texts or bytes")
        return SQLiteWriter(self.options["path"], self.options["table"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """The format `sqlite` in a session, with its filters pushed down."""
    spark.dataSource.register(SQLiteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def tables(spark: SparkSession, path: str) -> DataFrame:
    """database, table_name, ddl, column_name, data_type, pos: what the databases at a path declare, a task some of them."""

    def look(parts):
        import pandas as pd

        for pdf in parts:
            rows = []
            for path in pdf["path"]:
                with closing(_open(path)) as c:
                    for name, ddl in c.execute("select name, sql from sqlite_master where type = 'table' order by rowid").fetchall():
                        rows += [(path, name, ddl, r[1], r[2], r[0]) for r in c.execute(f"pragma table_info({_quoted(name)})")]
            yield pd.DataFrame(rows, columns=["database", "table_name", "ddl", "column_name", "data_type", "pos"])

    return _listed(spark, path).mapInPandas(look, "database string, table_name string, ddl string, column_name string, data_type string, pos int")


def prompts(spark: SparkSession, path: str, samples: int = 0) -> DataFrame:
    """database, prompt: the statements that create a database's tables, each with its first rows, if asked for, in a comment."""

    def describe(parts):
        import pandas as pd

        for pdf in parts:
            yield pd.DataFrame({"database": pdf["path"], "prompt": [_prompt(p, samples) for p in pdf["path"]]})

    return _listed(spark, path).mapInPandas(describe, "database string, prompt string")


def _prompt(path: str, samples: int) -> str:
    out = ""
    with closing(_open(path)) as c:
        for name, ddl in c.execute("select name, sql from sqlite_master where type = 'table' order by rowid").fetchall():
            out += f"{ddl};\n"
            if samples > 0:
                rows = c.execute(f"select * from {_quoted(name)} limit {int(samples)}")
                head = [x[0] for x in rows.description]
                lines = ["    ".join(head), *("    ".join(map(str, r)) for r in rows)]
                # fixed values: the words of the comment, whatever the number of rows
                out += f"/*\n3 example rows:\nSELECT * FROM {name} LIMIT {samples};\n" + "".join(x + "\n" for x in lines) + "*/\n"
            out += "\n"
    return out


def _listed(spark: SparkSession, path: str) -> DataFrame:
    found = databases(path)
    return spark.createDataFrame([(p,) for p in found], "path string").repartition(min(len(found), 4 * spark.sparkContext.defaultParallelism), F.col("path"))
