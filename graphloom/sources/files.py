"""File sources: delimited text, JSON envelopes, feeds, archives, payload kinds, document intake."""

from __future__ import annotations

import gzip
import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.hashing import content_hash


def canonical_column(name: str) -> str:
    """Snake case of a header."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "column"


def sniff_delimiter(head: str) -> str:
    """Of tab, semicolon, pipe and comma, the one that most often splits the first lines alike."""
    lines = [line for line in head.splitlines()[:5] if line.strip()]
    best = max("\t;|,", key=lambda s: (min((line.count(s) for line in lines), default=0), -"\t;|,".index(s)))
    return best


def read_delimited(spark: SparkSession, path: str, aliases: dict[str, list[str]] | None = None, delimiter: str | None = None) -> DataFrame:
    """A table with canonical column names; malformed rows are dropped, aliases renamed to the first found."""
    if delimiter is None:
        delimiter = sniff_delimiter("\n".join(r.value for r in spark.read.text(path).limit(5).collect()))
    raw = spark.read.option("header", True).option("sep", delimiter).option("mode", "DROPMALFORMED").csv(path)
    out = raw.toDF(*(canonical_column(c) for c in raw.columns))
    for logical, names in (aliases or {}).items():
        out = out.withColumn(logical, first_present(out, names))
    return out


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first value among some columns that isn't blank; columns that don't exist are passed over."""
    found = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def matches_filters(filters: dict[str, str | list[str]]) -> Column:
    """Equality or membership by column, whatever the case, all of them."""
    test = F.lit(True)
    for column, wanted in filters.items():
        values = [wanted] if isinstance(wanted, str) else wanted
        test = test & F.lower(F.col(column)).isin(*(v.lower() for v in values))
    return test


def payload_kind(content_type: Column, url: Column, head: Column) -> Column:
    """html, pdf, json, csv, xml, archive or text: by MIME type, then path, then first bytes."""
    kind, path, bytes_ = F.lower(content_type), F.lower(F.regexp_replace(url, "[?#].*$", "")), F.trim(head)
    return (
        F.when(kind.rlike("pdf"), "pdf").when(kind.rlike("html"), "html").when(kind.rlike("json"), "json").when(kind.rlike("csv"), "csv").when(kind.rlike("xml|rss|atom"), "xml")
        .when(path.rlike("\\.pdf$"), "pdf").when(path.rlike("\\.html?$"), "html").when(path.rlike("\\.json$"), "json").when(path.rlike("\\.(csv|tsv)$"), "csv")
        .when(path.rlike("\\.(zip|gz)$"), "archive").when(bytes_.startswith("%PDF"), "pdf").when(bytes_.rlike("^(?i)<(!doctype html|html)"), "html")
        .when(bytes_.rlike("^[\\[{]"), "json").when(bytes_.startswith("<?xml"), "xml").otherwise("text")
    )


def archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".tsv", ".txt"), most: int = 64 << 20) -> DataFrame:
    """(archive, member, line_no, line) of the text members of ZIP and GZ files, read as UTF-8."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                members = []
                if raw[:2] == b"\x1f\x8b":
                    members.append((name.rsplit("/", 1)[-1].removesuffix(".gz"), gzip.GzipFile(fileobj=io.BytesIO(raw))))
                elif raw[:2] == b"PK":
                    packed = zipfile.ZipFile(io.BytesIO(raw))
                    members += [(i.filename, packed.open(i)) for i in packed.infolist() if i.filename.lower().endswith(suffixes) and i.file_size <= most]
                for member, stream in members:
                    lines = [line.decode("utf-8", "replace").rstrip("\r\n") for line in stream]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([member] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["archive", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line_no long, line string")


def json_records(column: Column, paths: list[str], schema: str) -> Column:
    """The records under the first of some dotted paths that holds an array."""
    return F.coalesce(*(F.from_json(F.get_json_object(column, f"$.{p}" if p else "$"), F.lit(f"array<{schema}>")) for p in paths))


def feed_entries(feeds: DataFrame, known: DataFrame, cap: int, cutoff: Column) -> DataFrame:
    """Entries of feeds (feed, url, title, published): unknown urls, recent or undated, ``cap`` a feed."""
    fresh = feeds.join(known.select("url"), "url", "left_anti").where(F.col("published").isNull() | (F.col("published") >= cutoff))
    newest = W.partitionBy("feed").orderBy(F.desc_nulls_last("published"), "url")
    return fresh.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= cap).drop("_n")


def intake(docs: DataFrame, known_hashes: DataFrame, cap: int | None = None) -> DataFrame:
    """New documents (doc_id, source, text): not empty, not known by content, each content once.

    The row with the smallest doc_id represents its content; ``cap`` bounds what one source brings.
    """
    hashed = docs.select("doc_id", "source", content_hash(F.col("text")).alias("content_hash"), F.length(F.trim(F.coalesce("text", F.lit("")))).alias("n")).where("n > 0").drop("n")
    new = hashed.join(known_hashes, "content_hash", "left_anti")
    one = new.groupBy("content_hash").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("d")).select("d.doc_id", "d.source", "content_hash")
    if cap is None:
        return one
    return one.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where(F.col("_n") <= cap).drop("_n")
