"""Files in and out: survey CSVs (plain, gz, zip), bulk tables, logs, exports, site maps."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_zipcode, py_strip
from ..schema import TABLES, required, struct

BOM = "﻿"


def sniff_delimiter(head: str) -> str:
    """The most frequent of comma, semicolon and tab in the first 8192 characters; of equals, the first named."""
    return max(",;\t", key=lambda d: (head[:8192].count(d), -",;\t".index(d)))


def head_of(spark: SparkSession, path: str, chars: int = 8192) -> str:
    """The first `chars` characters of a file, in whole lines but for the last; lines are fetched until there are so many."""
    out = ""
    for row in spark.read.text(path).limit(chars).toLocalIterator():
        out += row[0] + "\n"
        if len(out) >= chars:
            break
    return out[:chars]


def read_survey(spark: SparkSession, paths: str | list[str], delimiter: str | None = None, order: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as text, keys and values stripped, missing ones "". Globs and lists of files with one header each.

    gz is read by Spark itself, zip through `read_zip`. The delimiter is sniffed unless it is given. multi_line: cells
    may hold line ends, for which a file is read by one task; without it large files are split. order: the name of a
    column to add, which sorts rows as they stand in the files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if all(p.endswith(".zip") for p in paths):
        return read_zip(spark, paths, delimiter)
    sep = delimiter if delimiter in (",", ";", "\t") else sniff_delimiter(head_of(spark, paths[0]))
    raw = spark.read.csv(paths, header=True, sep=sep, multiLine=multi_line, escape='"', mode="PERMISSIVE", inferSchema=False, encoding="UTF-8")
    # rows of a split are numbered as they are read; splits go by file and place in it
    place = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias(order)] if order else []
    return raw.select(*(F.coalesce(py_strip(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip(BOM).strip()) for c in raw.columns), *place)


def _unzip(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
        return "" if name is None else z.read(name).decode("utf-8-sig", "replace")


def read_zip(spark: SparkSession, paths: list[str], delimiter: str | None = None) -> DataFrame:
    """The first CSV of each archive; an archive is one task's work, as zip can't be split."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    first = files.orderBy("path").limit(1).collect()
    text = _unzip(bytes(first[0]["content"])) if first else ""
    sep = delimiter if delimiter in (",", ";", "\t") else sniff_delimiter(text)
    columns = [c.strip() for c in next(csv.reader(io.StringIO(text), delimiter=sep), [])]

    def rows(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                reader = csv.DictReader(io.StringIO(_unzip(bytes(content))), delimiter=sep)
                part = []
                for row in reader:
                    clean = {k.strip(): (v or "").strip() for k, v in row.items() if isinstance(k, str) and not isinstance(v, list)}
                    part.append([clean.get(c, "") for c in columns])
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=columns)
                        part = []
                yield pd.DataFrame(part, columns=columns)

    return files.select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))


def load_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A bulk file: the table's columns in their order."""
    return spark.read.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True, schema=struct(name), multiLine=True, escape='"')


def load_all(spark: SparkSession, folder: str, out: str, names: Iterable[str] | None = None, overwrite: bool = False) -> None:
    """Bulk files to parquet tables; without overwrite an existing table is an error. Rows without a required value are one too."""
    for name in names or TABLES:
        df = load_table(spark, name, f"{folder}/{name}.csv")
        bad = F.lit(False)
        for c in required(name):
            bad = bad | F.col(c).isNull()
        df.select(*(F.when(bad, F.raise_error(F.lit(f"{name}: a required value is missing"))).otherwise(F.col(c)).alias(c) for c in df.columns)).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{out}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str = "id", lower: int = 0, upper: int = 1, parts: int = 16, **options) -> DataFrame:
    """A database table in `parts` ranges of its key between lower and upper. postgres:// and postgresql:// urls become JDBC ones."""
    return spark.read.format("jdbc").options(dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **jdbc_options(url), **options).load()


def jdbc_options(url: str) -> dict[str, str]:
    """url, user and password of a database url, as JDBC takes them."""
    for prefix in ("postgres://", "postgresql://", "postgresql+psycopg2://"):
        if url.startswith(prefix):
            login, _, place = url[len(prefix) :].rpartition("@")
            user, _, password = login.partition(":")
            out = {"url": f"jdbc:postgresql://{place}", "user": unquote(user), "password": unquote(password)}
            return {k: v for k, v in out.items() if v}
    return {"url": url}


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    """Rows to a database table, a connection for each partition."""
    df.write.format("jdbc").mode(mode).options(dbtable=table, **jdbc_options(url), **options).save()


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def export_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header. single: one file, for results of a page's size."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def export_site_map(urls: DataFrame, path: str) -> None:
    """loc and lastmod as XML; null dates are left out."""
    urls.select("loc", "lastmod").write.mode("overwrite").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)


def author_hash(c: Column) -> Column:
    """A hash in place of an author's id; null for none."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.md5(c))


def sample_rows(df: DataFrame, rows: int = 50, order: list | None = None) -> DataFrame:
    """A small sample of a survey file with keys hashed and values cut, for test databases. The limit is the feature.

    order: columns that say which rows come first; by default the hash of all, so that reruns agree.
    """
    out = df.orderBy(*(order or [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))])).limit(rows)
    for c, f in (("authorId", author_hash), ("authorZipCode", clean_zipcode), ("title", lambda x: F.left(x, F.lit(255)))):
        if c in out.columns:
            out = out.withColumn(c, f(F.col(c)))
    return out


def _runs(batch: pa.RecordBatch) -> Iterable[tuple[int, int]]:
    """The stretches of a batch that come from one split."""
    file, split = batch.column("file").to_pylist(), batch.column("split").to_pylist()
    lo = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or (file[i], split[i]) != (file[lo], split[lo]):
            yield lo, i
            lo = i


def _split_facts(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Of each split: whether its quotes are odd in number, and how many rows begin in it if it begins outside a cell, and if within."""
    held: dict[tuple, list[int]] = {}
    for batch in batches:
        for lo, hi in _runs(batch):
            facts = held.setdefault((batch.column("file")[lo].as_py(), batch.column("split")[lo].as_py()), [0, 0, 0])
            quotes = np.cumsum(batch.column("quotes").to_numpy()[lo:hi]) + facts[0]
            before = np.concatenate(([facts[0]], quotes[:-1])) % 2
            facts[:] = [int(quotes[-1] % 2), facts[1] + int((before == 0).sum()), facts[2] + int((before == 1).sum())]
    if held:
        names, splits = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(splits, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*held.values(), strict=True))], ["file", "split", "odd", "outside", "inside"])


def _owned(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Lines with their place, the row that each belongs to, and whether it is a row by itself."""
    held: dict[tuple, list[int]] = {}
    for batch in batches:
        for lo, hi in _runs(batch):
            b = batch.slice(lo, hi - lo)
            state = held.setdefault((b.column("file")[0].as_py(), b.column("split")[0].as_py()), [b.column("before")[0].as_py(), 0, 0])
            after = (np.cumsum(b.column("quotes").to_numpy()) + state[0]) % 2
            before = np.concatenate(([state[0]], after[:-1]))
            number = np.cumsum(before == 0) + state[1]  # rows that began in this split so far; 0: the line goes on with an earlier split's row
            line = np.arange(state[2], state[2] + len(after))
            own = number > 0
            split = np.where(own, b.column("split").to_numpy(), b.column("owner_split").fill_null(-1).to_numpy())
            row = np.where(own, number, b.column("owner_row").fill_null(-1).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("split"), pa.array(line), pa.array(split), pa.array(row), pa.array((before == 0) & (after == 0)), b.column("value")], ["file", "split", "line", "in_split", "in_row", "single", "value"])
            state[:] = [int(after[-1]), int(number[-1]), state[2] + len(after)]


def read_survey_split(spark: SparkSession, paths: str | list[str], delimiter: str | None = None, order: str | None = None) -> DataFrame:
    """As `read_survey` with cells that hold line ends, but large files are read by many tasks.

    A first pass counts quotes by split; their parity, summed over the splits before, tells whether a split begins within a cell. A second pass
    then knows where rows begin. A row of one line goes on at once; the lines of others, which may lie in several splits, are brought together by
    row. All files have the first one's header. A quote belongs around cells, doubled within them; one that stands
    alone in a bare cell would shift what follows in its file. There is a line of facts for each split, no more.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    head = head_of(spark, paths[0])
    sep = delimiter if delimiter in (",", ";", "\t") else sniff_delimiter(head)
    header = [c.lstrip(BOM).strip() for c in next(csv.reader(io.StringIO(head), delimiter=sep), [])]
    lines = spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    lines = lines.withColumn("quotes", (F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))).cast("long"))
    facts = lines.select("file", "split", "quotes").mapInArrow(_split_facts, "file string, split bigint, odd bigint, outside bigint, inside bigint")
    facts = facts.groupBy("file", "split").agg(*(F.sum(c).alias(c) for c in ("odd", "outside", "inside")))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    rows_in = F.when(F.col("before") == 0, F.col("outside")).otherwise(F.col("inside"))
    last = F.last(F.when(rows_in > 0, F.struct(F.col("split").alias("s"), rows_in.alias("r"))), True).over(earlier)
    facts = facts.select("file", "split", "before", last["s"].alias("owner_split"), last["r"].alias("owner_row"))
    known = lines.join(F.broadcast(facts), ["file", "split"]).select("file", "split", "value", "quotes", "before", "owner_split", "owner_row")  # a row a split
    owned = known.mapInArrow(_owned, "file string, split bigint, line bigint, in_split bigint, in_row bigint, single boolean, value string")
    single = owned.where("single").select("file", "in_split", "in_row", "value")
    several = owned.where("NOT single").groupBy("file", "in_split", "in_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "line", "value"))), lambda x: x["value"]), "\n").alias("value"))
    rows = single.unionByName(several).where(~((F.col("in_split") == 0) & (F.col("in_row") == 1)) & (F.regexp_replace("value", "\r$", "") != ""))
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    cells = F.from_csv(F.regexp_replace("value", "\r$", ""), F.lit(schema), {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    place = [F.struct(F.col("file"), F.col("in_split").alias("split"), F.col("in_row").alias("row")).alias(order)] if order else []
    out = rows.withColumn("_c", cells)
    return out.select(*(F.coalesce(py_strip(F.col(f"_c.c{i}")), F.lit("")).alias(c) for i, c in enumerate(header)), *place)
