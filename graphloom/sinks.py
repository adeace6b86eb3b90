"""What leaves the engine: slices of a published graph with a manifest, CSV, archives, reports and messages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import delete_path

#: Nodes and edges of a publication, documents of an evidence list, characters of a message, at most.
MOST_NODES, MOST_EDGES, MOST_DOCUMENTS, MESSAGE = 5_000, 20_000, 5_000, 4_096


def csv_cell(value: Column) -> Column:
    """A value as RFC 4180 writes it: quoted where it holds a comma, a quote or a line end; nulls are empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One text ``line`` a row, cells by commas."""
    return rows.select(F.array_join(F.array(*(csv_cell(F.col(c)) for c in columns)), ",").alias("line"))


def write_csv(rows: DataFrame, columns: list[str], path: str, order: list[str]) -> None:
    """A header and the rows, in order, with the line ends of RFC 4180; part files follow each other."""
    head = rows.sparkSession.createDataFrame([(",".join(columns),)], "value string").coalesce(1)
    body = rows.orderBy(*order).select(F.array_join(F.array(*(csv_cell(F.col(c)) for c in columns)), ",").alias("value"))
    head.write.option("lineSep", "\r\n").text(f"{path}/0-head")
    body.write.option("lineSep", "\r\n").text(f"{path}/1-rows")


def evidence_uses(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """Every document that nodes (label, docs) or edges (source_label, target_label, docs) rest on, by id, with what it is used by.

    A document that isn't known keeps its id alone.
    """
    used = nodes.select(F.explode("docs").alias("id"), F.col("label").alias("use")).unionAll(
        edges.select(F.explode("docs").alias("id"), F.concat("source_label", F.lit(" → "), "target_label").alias("use"))
    )
    first = used.select("id").distinct().orderBy("id").limit(most)  # bounded, so the uses of the others go first
    by = used.join(first, "id", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("use")), " | ").alias("used_by"))
    return by.join(evidence, "id", "left").select("id", "title", "source", "date", "url", "used_by")


def slices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, body): a JSON slice for each node (id and more) with the edges (source, target and more) that touch it."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), F.struct(*edges.columns).alias("edge"))
    touching = ends.groupBy("id").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    entity = nodes.select("id", F.struct(*nodes.columns).alias("entity")).join(touching, "id", "left")
    return entity.select(F.concat(F.sha2("id", 256), F.lit(".json")).alias("file"), F.to_json(F.struct("entity", F.coalesce("edges", F.array()).alias("edges"))).alias("body"))


def revision(parts: DataFrame) -> str:
    """A hash of all slices, whatever the order and the time; of a publication's bounded number of them."""
    digests = parts.select(F.sha2(F.concat_ws(":", "file", "body"), 256).alias("d")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("r"))
    return digests.first().r


def publish(nodes: DataFrame, edges: DataFrame, path: str, allow_empty: bool = False) -> str:
    """Write the slices of a publication, a file each, and a manifest with their revision; what was there before goes.

    Nodes and edges are cut at ``MOST_NODES`` and ``MOST_EDGES`` by id; nothing is written, and nothing erased, where
    no node is left, unless that is asked for.
    """
    top = nodes.orderBy("id").limit(MOST_NODES)
    kept = edges.join(top.select(F.col("id").alias("source")), "source", "left_semi").join(top.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns).orderBy("source", "target").limit(MOST_EDGES)
    parts = slices(top, kept).cache()
    try:
        if parts.isEmpty() and not allow_empty:
            raise ValueError("nothing to publish")
        found = revision(parts)
        spark = nodes.sparkSession
        delete_path(spark, f"{path}/entities")
        parts.select("file", F.col("body").alias("value")).repartition("file").write.partitionBy("file").text(f"{path}/entities")
        files = [r.file for r in parts.select("file").orderBy("file").collect()]  # MOST_NODES at most
        manifest = spark.createDataFrame([(found, files)], "revision string, files array<string>")
        manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
        return found
    finally:
        parts.unpersist()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of a publication whose slices are those of its manifest; else an error."""
    manifest = spark.read.schema("revision string, files array<string>").json(f"{path}/manifest").first()
    parts = spark.read.text(f"{path}/entities").select("file", F.col("value").alias("body"))
    if manifest is None or revision(parts) != manifest.revision:
        raise ValueError("the slices aren't those of the manifest")
    return parts


def archive(files: Iterable[tuple[str, str]]) -> bytes:
    """A ZIP of stored texts, the same bytes for the same texts: one date, flat names, no name twice."""
    out, seen = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as packed:
        for name, text in files:
            flat = re.sub(r"\.\.", "_", re.sub(r"[\\/]", "_", name))[:120] or "file.txt"
            if flat in seen:
                raise ValueError(f"two files are called {flat}")
            seen.add(flat)
            entry = zipfile.ZipInfo(flat, (1980, 1, 1, 0, 0, 0))
            entry.create_system, entry.external_attr = 0, 0
            packed.writestr(entry, text.encode("utf-8"))
    return out.getvalue()


def markdown(title: str, sections: dict[str, DataFrame], most: int = 20) -> str:
    """A report: a heading, and a table of the first rows of each section."""
    lines = [f"# {title}"]
    for name, rows in sections.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows.limit(most).collect()]
    return "\n".join(lines) + "\n"


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def messages(text: Column, most: int = MESSAGE) -> Column:
    """A text as messages of ``most`` characters at most, cut at line ends; a longer line is cut where it has to be."""
    lines = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(x) - 1) / most), F.lit(0)).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most)))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def put(state: Column, line: Column) -> Column:
        longer = F.concat(state["now"], F.lit("\n"), line)
        fits = F.length(longer) <= most
        return F.struct(
            F.when(state["now"].isNull() | fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["now"]))).alias("done"),
            F.when(state["now"].isNull(), line).when(fits, longer).otherwise(line).alias("now"),
        )

    end = F.aggregate(lines, empty, put)
    return F.filter(F.concat(end["done"], F.array(end["now"])), lambda m: F.trim(m) != "")
