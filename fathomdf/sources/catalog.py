"""Tables by name: Parquet folders as views, declared types, predefined views, schema evolution."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Names of declared types.
SIMPLE = {
    "null": T.NullType(), "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.LongType(), "i64": T.LongType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "uint": T.LongType(), "u64": T.DecimalType(20, 0), "float": T.DoubleType(), "f64": T.DoubleType(), "double": T.DoubleType(), "real": T.DoubleType(),
    "text": T.StringType(), "string": T.StringType(), "char": T.StringType(), "varchar": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(), "datetime": T.TimestampType(),
    "object": T.MapType(T.StringType(), T.StringType()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


_INDEXES: dict[tuple, str] = {}


def index_of(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id", text_col: str = "text"):
    """The stored inverted index of a table, built at first use under the shared checkpoint folder (or a folder of this machine where
    all runs in one process) and found again as long as the table's files are the same: by name, length and time."""
    import tempfile
    import uuid

    from fathomdf.operators.lexical import Index

    df, sc = table(spark, sf_dir, name), spark.sparkContext
    state = []
    for f in sorted(df.inputFiles()):
        at = sc._jvm.org.apache.hadoop.fs.Path(f)
        s = at.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(at)
        state.append((f, s.getLen(), s.getModificationTime()))
    key = (sc.applicationId, name, id_col, text_col, tuple(state))
    if key not in _INDEXES:
        base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all machines share")
            base = tempfile.mkdtemp(prefix="fathomdf-index-")
        path = f"{base}/index-{uuid.uuid4().hex}"
        Index.build(df, path, id_col, text_col)
        _INDEXES[key] = path
    return Index(spark, _INDEXES[key], id_col)


def parse_type(text: str) -> tuple[T.DataType, bool]:
    """A declared type as (Spark type, nullable): int, uint, float, text, binary, decimal(p,s), vector(d), ref(t), array(t), t?."""
    t = text.strip().lower()
    if t.endswith("?"):
        return parse_type(t[:-1])[0], True
    if m := re.fullmatch(r"array\((.+)\)", t):
        kind, null = parse_type(m[1])
        return T.ArrayType(kind, null), False
    if m := re.fullmatch(r"ref\((\w+)\)", t):
        return T.StructType([T.StructField("table", T.StringType()), T.StructField("id", T.LongType())]), False
    if m := re.fullmatch(r"decimal\((\d+)(?:,\s*(\d+))?\)", t):
        return T.DecimalType(int(m[1]), int(m[2] or 0)), False
    if re.fullmatch(r"(vector|embedding)\(\d+\)", t):
        return T.ArrayType(T.FloatType()), False
    base = re.sub(r"\(\d+\)$", "", t)
    if base not in SIMPLE:
        raise ValueError(f"unknown type: {text}")
    return SIMPLE[base], False


def schema(fields: dict[str, str], primary_key: str | None = None) -> T.StructType:
    """Declared fields as a StructType; vector lengths and the primary key are kept as metadata."""
    out = []
    for name, kind in fields.items():
        t, null = parse_type(kind)
        meta: dict = {"primary_key": True} if name == primary_key else {}
        if m := re.fullmatch(r"(?:vector|embedding)\((\d+)\)\??", kind.strip().lower()):
            meta["dim"] = int(m[1])
        out.append(T.StructField(name, t, null or name != primary_key, meta))
    return T.StructType(out)


def violations(df: DataFrame, not_null: tuple[str, ...] = (), unique: tuple[str, ...] = (), checks: dict[str, str] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, n): how many rows break each declared constraint."""
    out = [df.agg(F.lit(f"not_null:{c}").alias("rule"), F.count(F.when(F.col(c).isNull(), 1)).alias("n")) for c in not_null]
    out += [df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.lit(f"unique:{c}").alias("rule"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")) for c in unique]
    out += [df.agg(F.lit(f"check:{k}").alias("rule"), F.count(F.when(~F.expr(e), 1)).alias("n")) for k, e in (checks or {}).items()]
    for c, (other, key) in (foreign or {}).items():
        out.append(df.where(F.col(c).isNotNull()).join(other.select(F.col(key).alias("__k")), F.col(c) == F.col("__k"), "left_anti").agg(F.lit(f"foreign:{c}").alias("rule"), F.count("*").alias("n")))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


def evolve(df: DataFrame, *steps: tuple) -> DataFrame:
    """Schema changes in order: ('add', name, type, default), ('drop', name), ('rename', old, new), ('cast', name, type)."""
    for op, name, *rest in steps:
        if op == "add":
            df = df.withColumn(name, F.lit(rest[1] if len(rest) > 1 else None).cast(parse_type(rest[0])[0]))
        elif op == "drop":
            df = df.drop(name)
        elif op == "rename":
            df = df.withColumnRenamed(name, rest[0])
        elif op == "cast":
            df = df.withColumn(name, F.col(name).try_cast(parse_type(rest[0])[0]))
        else:
            raise ValueError(f"unknown step: {op}")
    return df
