"""Rows for exported tables, idempotent upserts, and the questions asked of such tables."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.plans.store import discard, remove, size_of, written

MANDATORY = ("id", "crawl_id", "url", "created_at")
NAME = r"^[a-zA-Z0-9][a-zA-Z0-9_]{1,127}$"
BLOCKED = ("sqlite_master", "sqlite_sequence", "sqlite_stat1")
TYPES = {"real": "double", "int": "bigint", "json": "string", "text": "string"}
MAX_PAGE = 50


def table_name(base_url: Column, blueprint_id: Column) -> Column:
    """Host with underscores and the blueprint's id; other characters become underscores."""
    host = F.replace(F.replace(base_url, F.lit("https://"), F.lit("")), F.lit("."), F.lit("_"))
    return F.regexp_replace(F.concat(host, F.lit("_"), blueprint_id), r"[^A-Za-z0-9_]", "_")


def ddl(name: str, fields: dict[str, str], location: str | None = None) -> str:
    """The statement that makes a table for exported rows, at a location or else in the warehouse."""
    columns = ["id STRING", "crawl_id STRING", "url STRING", "created_at STRING", *(f"`{n}` {TYPES.get(t, 'string')}" for n, t in fields.items())]
    return f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)}) USING parquet{f" LOCATION '{location}'" if location else ""}"


def python_json(c: Column, is_text: bool = False) -> Column:
    """Any value as JSON with a blank after each comma and colon, scripts as they are; null stays null.

    A text that is JSON stands for its value, and ``null`` for none; other texts become JSON strings."""

    def spaced_one(text: str) -> str | None:
        value = json.loads(text)[0]
        if is_text:
            try:
                value = json.loads(value)
            except json.JSONDecodeError:
                pass
        return None if value is None else json.dumps(value, ensure_ascii=False)

    @F.pandas_udf("string")
    def spaced(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else spaced_one(t) for t in texts], dtype=object)

    return spaced(F.when(c.isNotNull(), F.to_json(F.array(c), {"ignoreNullFields": "false"})))


#: Types whose values can be cast to numbers.
SCALARS = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "timestamp")


def safe_cast(c: Column, kind: str, data_type: str) -> Column:
    """Value under an export type; what can't be cast is null, lists and structs become JSON, and texts under json are read as such."""
    if kind in ("real", "int"):
        target = "double" if kind == "real" else "bigint"
        return c.try_cast(target) if data_type.startswith(SCALARS) else F.lit(None).cast(target)
    if kind == "json" or data_type.startswith(("array", "struct", "map")):
        return python_json(c, kind == "json" and data_type == "string")
    return c.cast("string")


def export_rows(items: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The declared fields only, cast, after the four mandatory columns."""
    types = dict(items.dtypes)
    return items.select(*MANDATORY, *[safe_cast(F.col(n), kind, types[n]).alias(n) for n, kind in fields.items()])


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last writer of each key, of both tables together; of equally late rows the last one as JSON text."""
    columns = old.columns
    both = old.unionByName(new)
    row = F.struct(*[c for c in columns if c not in keys])
    last = both.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(order), F.to_json(row))).alias("r"))
    return last.select(*keys, "r.*").select(*columns)


#: Parts of an upserted table at first, and bytes of a part beyond which the table gets four times as many.
BUCKETS, PART_BYTES = 64, 256 << 20
MANIFEST = "version long, bucket int, folder string, n_buckets int"


def _manifest(spark: SparkSession, path: str, back: int = 0) -> tuple[int, dict[int, str], int]:
    """Number, folders (by bucket) and number of buckets of the latest version of an upserted table, or of one before it."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        last = rows.agg(F.max("version")).first()[0] - back
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, {}, 0
    own = rows.where(F.col("version") == last).collect()  # a row for each bucket
    return last, {r.bucket: r.folder for r in own}, own[0].n_buckets if own else 0


def upserted(spark: SparkSession, path: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The latest version of an upserted table, or some of its buckets."""
    _, folders, _ = _manifest(spark, path)
    places = [f"{folder}/bucket={b}" for b, folder in folders.items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def upsert_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str, buckets: int = BUCKETS, part_bytes: int = PART_BYTES) -> None:
    """Upsert into a table of files: only the buckets that hold a key of ``new`` are written again, in a new folder.

    A manifest of all buckets' folders makes the version; until it is whole, readers see the version before. When buckets hold
    more than ``part_bytes`` on average, the batch writes the whole table into four times as many. Folders that neither this
    version nor the one before it names are removed."""
    version, folders, n = _manifest(spark, path)
    n = n or buckets
    grow = bool(folders) and size_of(spark, set(folders.values())) > n * part_bytes
    n = 4 * n if grow else n
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("bucket")
    new = written(new.select("*", bucket))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    if not touched:
        discard(new)
        return
    old = upserted(spark, path, new.drop("bucket").schema, None if grow else touched)
    folder = f"{path}/data/{version + 1:09d}-{uuid.uuid4().hex}"
    upsert_latest(old, new.drop("bucket"), keys, order).select("*", bucket).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    discard(new)
    if grow:
        kept, touched = {}, [r.bucket for r in spark.read.parquet(folder).select("bucket").distinct().collect()]
    else:
        kept = folders
    now = kept | dict.fromkeys(touched, folder)
    spark.createDataFrame([(version + 1, b, f, n) for b, f in now.items()], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    before = _manifest(spark, path, 2)[1] if version > 0 else {}
    for gone in set(before.values()) - set(folders.values()) - set(now.values()):
        remove(spark, gone)


def crawls_per_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("crawl_id").agg(F.count("*").alias("count"), F.max("created_at").alias("last_seen")).orderBy(F.desc("last_seen"), "crawl_id")


def sample_page(rows: DataFrame, limit: int, offset: int = 0, crawl_id: str | None = None, tie: str = "id") -> DataFrame:
    """Newest rows first; limit between 1 and 50, offset not below 0."""
    if crawl_id is not None:
        rows = rows.where(F.col("crawl_id") == crawl_id)
    return rows.orderBy(F.desc("created_at"), tie).offset(max(0, offset)).limit(min(MAX_PAGE, max(1, limit)))


def valid_name(name: Column) -> Column:
    return name.rlike(NAME) & ~name.isin(*BLOCKED)


def list_tables(spark: SparkSession, columns: DataFrame | None = None) -> DataFrame:
    """Names of tables that hold the mandatory columns; columns(table_name, column_name) defaults to the catalogue."""
    if columns is None:
        found = [(t.name, c.name) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
        columns = spark.createDataFrame(found, "table_name string, column_name string")
    has = columns.where(valid_name(F.col("table_name"))).groupBy("table_name").agg(F.count_if(F.col("column_name").isin(*MANDATORY)).alias("n"))
    return has.where(F.col("n") == len(MANDATORY)).select("table_name").orderBy("table_name")


def raw_documents(pages: DataFrame, crawler: str, retrieved_at: Column) -> DataFrame:
    """Fetched pages as raw documents for a JSON sink."""
    return pages.select(F.col("page_id").cast("string").alias("id"), F.lit("web").alias("source_type"), F.col("url").alias("source_uri"), F.lit("").alias("title"), F.col("html").alias("text"), F.lit("en").alias("language"), retrieved_at.alias("retrieved_at"), F.create_map(F.lit("crawler"), F.lit(crawler)).alias("metadata"))


def write_raw_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").json(path)


def latest_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def kept_first(rows: DataFrame, parts: list[str], order: list[str], n: int) -> DataFrame:
    """A bounded buffer: the first n rows of each part stay, later ones are lost."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col("__k") <= n).drop("__k")
