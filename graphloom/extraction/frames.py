"""Extraction over whole tables: texts go to Python in bounded Arrow batches, rows of what is found come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.extraction import craft, payloads, sentences, statements
from graphloom.session import reach

#: Texts handled at a time, and rows sent back at a time.
TEXTS, ROWS = 256, 4096


def each_text(texts: DataFrame, schema: str, find: Callable[[str], Iterator[tuple]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, *schema) for every row that ``find`` gives of each text; a null text gives none."""
    kind = dict(texts.dtypes)[key]
    whole = StructType.fromDDL(f"{key} {kind}, {schema}")
    arrow = to_arrow_schema(whole)

    def send(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, TEXTS):
                batch = whole_batch.slice(start, TEXTS)
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if body is not None:
                        rows += [(name, *r) for r in find(body)]
                    if len(rows) >= ROWS:
                        yield send(rows)
                        rows = []
        yield send(rows)

    reach(texts.sparkSession)
    return texts.select(key, F.col(text)).mapInArrow(run, whole.simpleString()[7:-1])


def craft_matches(texts: DataFrame, **names: str) -> DataFrame:
    """Mentions of craft: start, end, kind, surface, craft_kind, identifier, confidence."""
    return each_text(texts, "start int, end int, kind string, surface string, craft_kind string, identifier string, confidence double", craft.find, **names)


def names_found(texts: DataFrame, **names: str) -> DataFrame:
    """Names: start, end, surface, label, confidence."""
    return each_text(texts, "start int, end int, surface string, label string, confidence double", statements.names, **names)


_TYPES = {"ORG": "Organization", "PERSON": "Person", "GPE": "Location", "CRAFT": "Craft"}


def statements_found(texts: DataFrame, once: bool = False, **names: str) -> DataFrame:
    """Statements: sentence, subject, subject_type, verb, object, object_type, preposition, passive, negated, hedged, distance, clause.

    With ``once``, of a text's statements with equal subjects, verbs and objects the first is kept.
    """

    def find(text: str) -> Iterator[tuple]:
        said = set()
        for s in statements.statements(text):
            if once:
                if (same := (s.subject.text, s.verb, s.object.text)) in said:
                    continue
                said.add(same)
            yield s.sentence, s.subject.text, _TYPES[s.subject.label], s.verb, s.object.text, _TYPES[s.object.label], s.preposition, s.passive, s.negated, s.hedged, s.distance, s.clause

    schema = "sentence int, subject string, subject_type string, verb string, object string, object_type string, preposition string, passive boolean, negated boolean, hedged boolean, distance int, clause string"
    return each_text(texts, schema, find, **names)


def sentences_found(texts: DataFrame, plain: bool = False, most: int = sentences.MOST_SENTENCES, **names: str) -> DataFrame:
    """Sentences: number, start, end, sentence."""
    split = sentences.split_plain if plain else sentences.split
    return each_text(texts, "number int, start int, end int, sentence string", lambda t: ((i, *s) for i, s in enumerate(split(t, most))), **names)


def chunks_found(texts: DataFrame, most: int = sentences.CONTEXT, overlap: int = sentences.OVERLAP, **names: str) -> DataFrame:
    """Windows of whole sentences: number, start, end, chunk, tokens, first, last, cut."""
    schema = "number int, start int, end int, chunk string, tokens int, first int, last int, cut boolean"
    return each_text(texts, schema, lambda t: ((i, *c) for i, c in enumerate(sentences.chunks(t, most, overlap))), **names)


def cleaned(texts: DataFrame, **names: str) -> DataFrame:
    """The normal form of each text."""
    return each_text(texts, "clean string", lambda t: [(payloads.clean(t),)], **names)


def extracted(rows: DataFrame, key: str, body: str, content_type: str, url: str) -> DataFrame:
    """(key, kind, text, warning) of payloads: bytes or texts with their declared type and address."""
    kind = dict(rows.dtypes)[key]
    whole = StructType.fromDDL(f"{key} {kind}, kind string, text string, warning string")
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                out = [payloads.extract(b or b"", c, u) for b, c, u in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)))]
                columns = zip(*out) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow[0].type), *(pa.array(c, pa.string()) for c in columns)], schema=arrow)

    reach(rows.sparkSession)
    return rows.select(key, F.col(body).cast("binary"), content_type, url).mapInArrow(run, whole.simpleString()[7:-1])
