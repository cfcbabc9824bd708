"""Extracted payloads as fields: JSON of any shape, flattened to its leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Keys that name the page a record comes from.
PAGE_KEYS = ("source_page", "page", "page_number", "page_no", "page_num")


def leaves(value: object) -> Iterator[tuple[str, str | None, str, int | None, str, str | None]]:
    """(path, value, kind, page_hint, context, record) of each leaf.

    A page key with an integer holds for its object and all below, and is no
    leaf. The context is a table's name, the first string of 3 to 35 characters
    beside the leaf, and the words of the field. A list inside a record keeps the
    record of the outer list. Values are the JSON text of numbers, so 10 and 10.0
    differ.
    """

    def walk(x: object, path: str, page: int | None, beside: str, table: str, record: str | None):
        if isinstance(x, dict):
            own = next((x[k] for k in PAGE_KEYS if isinstance(x.get(k), int) and not isinstance(x.get(k), bool)), page)
            near = next((v for v in x.values() if isinstance(v, str) and 3 <= len(v) <= 35), beside)
            for k, v in x.items():
                if not (k in PAGE_KEYS and isinstance(v, int)):
                    yield from walk(v, f"{path}.{k}" if path else k, own, near, table, record)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                at = f"{path}[{i}]"
                yield from walk(v, at, page, beside, path.rpartition(".")[2], record or at)
        else:
            kind = {bool: "bool", int: "int", float: "float", str: "str", type(None): "null"}[type(x)]
            text = None if x is None else x if kind == "str" else json.dumps(x)
            name = path.rpartition(".")[2].replace("_", " ")
            yield path, text, kind, page, " ".join(w for w in (table, beside if beside != text else "", name) if w), record

    yield from walk(value, "", None, "", "", None)


SCHEMA = "field string, value string, kind string, page_hint int, context string, record string"


def _text(x: str | None) -> str | None:
    """Surrogates that stand alone become escapes, as UTF-8 has no place for them."""
    return None if x is None else x.encode("utf-8", "backslashreplace").decode()


def flatten(payloads: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """Fields of payloads (key, JSON): a row per leaf.

    A payload that is null, no JSON or nested too deep gives one row of kind ``error``.
    """
    rows = payloads.select(F.col(f"`{key}`"), F.col(f"`{payload}`").cast("string").alias("__payload"))
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(SCHEMA).fields])
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, owner = [], []
            for i, text in enumerate(batch.column(1)):
                try:
                    found = [(_text(f), _text(v), k, p, _text(c), _text(r)) for f, v, k, p, c, r in leaves(json.loads(text.as_py()))]
                except (TypeError, ValueError, RecursionError):
                    found = [(None, text.as_py(), "error", None, None, None)]
                out += found
                owner += [i] * len(found)
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def from_dicts(payloads: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """Fields of flat objects, without Python: the entries of a JSON object of scalars."""
    entries = payloads.select(key, F.explode(F.from_json(payload, "map<string,string>")).alias("field", "value"))
    return entries.where(F.col("value").isNotNull())
