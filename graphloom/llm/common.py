"""What the operators of this subpackage share.

Ids (doc_id, page_id, vec_id) are whole numbers: a column of another type is cast to long, and a value
that isn't a whole number ends the query with Spark's cast error. Nothing is dropped for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import session

#: Rows that a Python worker handles at a time, and rows and bytes of an Arrow batch at most: the memory of both sides follows.
ROWS, BATCH_BYTES = 512, 8 << 20
#: Keys with the most rows that ``join_spread`` broadcasts. Any other key holds at most one row in as many.
HOT_KEYS = 1_000
#: Labelled rows that a classifier is fitted on at most, taken in the order of a hash of the id.
MAX_LABELLED = 20_000


def reach(spark: SparkSession) -> SparkSession:
    """The session, with the package in reach of its workers and Arrow batches bounded by rows and bytes."""
    for name, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    return session.reach(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of ``ROWS`` rows at most; none of an empty one."""
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], names: list[str]) -> DataFrame:
    """``mapInArrow`` where ``make()`` is called once a task and its result once ``ROWS`` rows.

    The function returns columns by name; they are cast to the Arrow types given in ``schema``.
    """
    target = reach(df.sparkSession).createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for whole in batches:
            for batch in slices(whole):
                columns = each(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in arrow],
                    schema=arrow,
                )

    return df.select(*names).mapInArrow(run, schema)


def text_score(make: Callable[[], Callable[[list[str | None]], list]]) -> Callable[[Column], Column]:
    """A double for each text; ``make()`` is called once a task and its result once ``ROWS`` rows.

    Only the text goes to Python and only the result comes back, whatever other columns the rows have.
    """

    @F.arrow_udf(returnType="double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for whole in columns:
            parts = [each(whole.slice(i, ROWS).to_pylist()) for i in range(0, len(whole), ROWS)]
            yield pa.array([value for part in parts for value in part], pa.float64())

    return lambda text: run(text.cast("string"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` is called so in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_spread(rows: DataFrame, side: DataFrame, key: str, weight: str, hot: int = HOT_KEYS) -> DataFrame:
    """Left join of ``side``, which has one row a key, on a key that a third of ``rows`` may share or lack.

    The ``hot`` keys with the most rows by ``weight``, a column of ``side`` that is not returned, are
    broadcast: so many rows whatever the input's size. Their rows get keys of their own in the
    shuffle join that the others go through, where no key is left that more than one row in
    ``hot`` holds. Both tables are read twice at most, so they should be written ones.
    """
    kind = dict(rows.dtypes)[key]
    payload = [c for c in side.columns if c not in (key, weight)]
    top = side.orderBy(F.desc(weight), key).limit(hot).select(F.struct(key, *payload).alias("_top"))
    marked = rows.join(F.broadcast(top), F.col(key) == F.col(f"_top.{key}"), "left")
    alone = F.monotonically_increasing_id().cast(kind)  # whatever this meets is not picked
    spread = F.when(F.col("_top").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(alone)
    rest = side.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_rest_{c}") for c in payload))
    joined = marked.withColumn("_spread", spread).join(rest, F.col("_spread") == F.col("_key"), "left")
    picked = (F.when(F.col("_top").isNotNull(), F.col(f"_top.{c}")).when(F.col(key).isNotNull(), F.col(f"_rest_{c}")).alias(c) for c in payload)
    return joined.select(*rows.columns, *picked)


def labelled(spark: SparkSession, labels: DataFrame, target: str, folds: int, held: int, bound: int = MAX_LABELLED) -> DataFrame:
    """At most ``bound`` rows (doc_id, y) outside the held-out fold, one for each document.

    A document labelled more than once counts as the rounded mean of its labels; rows with a null
    id or a label other than 0 or 1 are left out. The result is small by its limit, so it may be
    broadcast.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(fold_of(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Texts of a bounded labelled sample: (doc_id, y, text), one row a distinct pair of id and text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")
