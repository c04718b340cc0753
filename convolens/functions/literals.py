"""Lists written as Python literals, for the rows whose text is not valid JSON."""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PIECE_ROWS = 64
_FIELDS = pa.struct([("json", pa.string()), ("error", pa.string())])


def _to_json(text: str | None) -> tuple[str | None, str | None]:
    if text is None:
        return None, None
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return None, None
    except Exception as problem:
        return None, str(problem) or type(problem).__name__
    if not isinstance(value, list):
        return None, None
    try:
        return json.dumps(value, default=str), None
    except (TypeError, ValueError) as problem:
        return None, str(problem)


def _piece_as_json(text: pa.Array) -> pa.Array:
    json_texts, errors = zip(*map(_to_json, text.to_pylist()))
    return pa.StructArray.from_arrays([pa.array(json_texts, pa.string()), pa.array(errors, pa.string())], fields=list(_FIELDS))


@F.arrow_udf(StructType([StructField("json", StringType()), StructField("error", StringType())]))
def python_list_as_json(text: pa.Array) -> pa.Array:
    """JSON text of a Python list literal; both fields NULL when the text is not one.

    A batch may hold 64 MB of text: only some rows of it are Python objects at a time.
    """
    done = [_piece_as_json(text.slice(at, PIECE_ROWS)) for at in range(0, len(text), PIECE_ROWS)]
    out = pa.concat_arrays(done) if done else pa.array([], _FIELDS)
    del done
    pa.default_memory_pool().release_unused()
    return out
