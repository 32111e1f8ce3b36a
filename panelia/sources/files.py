"""File sources and sinks: text tables in several encodings, file inventories, headed instrument tables, guarded writes."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelia.sources.panel import ContractError

#: Tried in this order.
ENCODINGS = ("UTF-8", "GB18030")


def checked_header(path: str, names: list[str]) -> list[str]:
    names = [n.lstrip("\ufeff") for n in names]
    if not names or len(set(names)) < len(names) or "" in names:
        raise ContractError(f"{path}: columns are missing, blank or repeated")
    return names


def decoded_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(at, line) of text files in an encoding that Spark's own reader doesn't take; a file is decoded in one piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                lines = bytes(content).decode(encoding, "replace").splitlines()
                yield pd.DataFrame({"at": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "at long, line string")


def read_text_table(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """A CSV file with text cells only, in the first encoding that leaves no replacement character in it.

    Rows of another width are an error when they are read.
    """
    for encoding in encodings:
        if encoding == "UTF-8":
            first = spark.read.option("header", False).csv(path).first()
            names = checked_header(path, ["" if x is None else str(x) for x in (first or [])])
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            frame = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
        else:
            lines = decoded_lines(spark, path, encoding)
            names = checked_header(path, next(csv.reader([(lines.where("at = 0").first() or [0, ""])[1]]), []))
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            cells = F.from_csv("line", ", ".join(f"`{n}` string" for n in names), {"mode": "FAILFAST"})
            frame = lines.where("at > 0 and trim(line) <> ''").select(cells.alias("c")).select("c.*")
        spoiled = F.exists(F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names)), lambda x: F.contains(x, F.lit("\ufffd")))
        if "\ufffd" not in "".join(names) and frame.where(spoiled).isEmpty():
            return frame
    raise ContractError(f"{path}: in none of {encodings}")


def write_table(frame: DataFrame, path: str, form: str = "csv") -> None:
    """A sink that never overwrites; a table without columns is refused."""
    if not frame.columns:
        raise ContractError("a table without columns can't be written")
    writer = frame.write.mode("errorifexists").format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, suffix, length, modified) of the files under a root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), "length", "modified")
    return out.where(F.col("suffix").isin(*suffixes)) if suffixes else out


def read_headed_table(spark: SparkSession, path: str, header_lines: int = 35) -> DataFrame:
    """(path, date, t, channel, species, value) of tab-separated instrument files with a fixed header.

    The header's first date is the measurement's; data rows hold the time, then three values a channel.  Files are
    parsed in parallel, each in one piece; times must increase.
    """
    text = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    lines = F.split("value", r"\r?\n")
    head, body = F.slice(lines, 1, header_lines), F.filter(F.slice(lines, header_lines + 1, F.greatest(F.size(lines) - header_lines, F.lit(0))), lambda x: F.trim(x) != "")
    date = F.try_to_date(F.nullif(F.regexp_replace(F.regexp_extract(F.array_join(head, "\n"), r"(\d{4}[/-]\d{2}[/-]\d{2})", 1), "/", "-"), F.lit("")))
    rows = text.select("path", date.alias("date"), F.posexplode(body).alias("row", "line")).withColumn("c", F.transform(F.split("line", "\t"), lambda x: F.trim(x).try_cast("double")))
    cells = rows.select("path", "date", F.get("c", 0).alias("t"), F.posexplode(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))).alias("i", "value"))
    return cells.select("path", "date", "t", (F.col("i") / 3).cast("int").alias("channel"), F.element_at(F.array(F.lit("oxy"), F.lit("deoxy"), F.lit("total")), (F.col("i") % 3 + 1).cast("int")).alias("species"), "value")


def confined(root: str, value: str) -> str:
    """A relative path below a root; absolute paths, drives and parents are refused."""
    path = PurePosixPath(value.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts or ":" in value:
        raise ContractError(f"{value!r} is not a confined relative path")
    return str(PurePosixPath(root) / path)


def instrument_file(date: str, rows: list[list[float]], header_lines: int = 35) -> str:
    """Text in the form that ``read_headed_table`` reads, for fixtures."""
    return "\n".join([f"Measured\t{date}", *["-"] * (header_lines - 1), *("\t".join(map(str, r)) for r in rows)]) + "\n"
