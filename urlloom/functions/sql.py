"""The functions in Spark SQL.

What the columns do with built-in expressions the SQL functions do as well: parts of plain URLs, query strings and form
encoding never leave the JVM. Names that end in _any are Python functions, which get the other rows; a few more have no built-in form. The table function url_params gives the pairs of a query string.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..kernel import codec, host, idna
from ..kernel.charsets import SETS
from ..kernel.params import parse_params
from ..kernel.url import cleared, edited, from_file_path, parse
from ..shipping import ship
from .native import PLAIN, PLAIN_BYTES, plain_parts
from .types import EDITED, PARTS, URL, getters, record


def _url_set(text, part, value):
    url = parse(text) if text is not None and part is not None and value is not None else None
    if url is None:
        return None
    new, ok = edited(url, part, value)
    return {"url": record(new), "ok": ok}


def _url_clear(text, part):
    url = parse(text) if text is not None else None
    return record(cleared(url, part)) if url else None


def _url_part(text, part):
    url = parse(text) if text is not None else None
    return getters(url).get(part) if url else None


def _encode(text, charset):
    return codec.percent_encode(text, charset) if text is not None and charset in SETS else None


def _resolve(text, base):
    return record(parse(text, base)) if text is not None and base is not None else None


def _text(of):
    return lambda x: None if x is None else of(x)


class ParamsTable:
    """Rows of a query string: position, key, value."""

    def eval(self, query: str):
        for i, (k, v) in enumerate(parse_params(query or "")):
            yield i, k, v


#: Name, function, type.
PYTHON = (
    ("url_parse", _text(lambda t: record(parse(t))), URL),
    ("url_resolve", _resolve, URL),
    ("url_can_parse_with_base", lambda t, b: None if t is None or b is None else parse(t, b) is not None, T.BooleanType()),
    ("url_set", _url_set, EDITED),
    ("url_clear", _url_clear, URL),
    ("url_part_any", _url_part, T.StringType()),
    ("url_valid_any", _text(lambda t: parse(t) is not None), T.BooleanType()),
    ("percent_encode", _encode, T.StringType()),
    ("percent_decode_any", _text(codec.percent_decode), T.StringType()),
    ("form_decode_any", _text(codec.form_decode), T.StringType()),
    ("domain_to_ascii_any", _text(host.domain_to_ascii), T.StringType()),
    ("domain_to_unicode_any", _text(idna.to_unicode), T.StringType()),
    ("url_from_file", _text(from_file_path), T.StringType()),
)

_PARAMS = "ARRAY<STRUCT<key: STRING, value: STRING>>"
_GUARD = f"(octet_length(u) <= {PLAIN_BYTES} AND rlike(u, r'{PLAIN}'))".replace("r'", "r\"").replace("')", "\")")
_STRAY = "rlike(t, '%(?![0-9A-Fa-f]{2})')"
_ASCII_HOST = r"rlike(t, r'\A[0-9A-Za-z._\-]+\z')"
_CODED = r"rlike(t, r'(?i)xn--|[^\x00-\x7f]')"
#: Functions with a built-in branch; the Python function only sees the other rows.
SQL = {
    "url_can_parse(u STRING) RETURNS BOOLEAN": f"CASE WHEN {_GUARD} THEN true ELSE url_valid_any(CASE WHEN NOT {_GUARD} THEN u END) END",
    "url_hostname(u STRING) RETURNS STRING": "url_get_hostname(u)",
    "percent_decode(t STRING) RETURNS STRING": "CASE WHEN NOT contains(t, '%') THEN t ELSE percent_decode_any(CASE WHEN contains(t, '%') THEN t END) END",
    "form_encode(t STRING) RETURNS STRING": "url_encode(t)",
    "form_decode(t STRING) RETURNS STRING": f"CASE WHEN NOT {_STRAY} THEN url_decode(CASE WHEN NOT {_STRAY} THEN t END) ELSE form_decode_any(CASE WHEN {_STRAY} THEN t END) END",
    "domain_to_ascii(t STRING) RETURNS STRING": f"CASE WHEN {_ASCII_HOST} THEN lower(t) ELSE domain_to_ascii_any(CASE WHEN NOT {_ASCII_HOST} THEN t END) END",
    "domain_to_unicode(t STRING) RETURNS STRING": f"CASE WHEN NOT {_CODED} THEN lower(t) ELSE domain_to_unicode_any(CASE WHEN {_CODED} THEN t END) END",
    f"params_parse(q STRING) RETURNS {_PARAMS}": "transform(filter(split(regexp_replace(regexp_replace(q, '%(?![0-9A-Fa-f]{2})', '%25'), r'\\A\\?', ''), '&'), x -> x <> ''), x -> named_struct('key', url_decode(substring_index(x, '=', 1)),"
    " 'value', url_decode(CASE WHEN contains(x, '=') THEN substring(x, length(substring_index(x, '=', 1)) + 2) ELSE '' END)))",
    f"params_text(p {_PARAMS}) RETURNS STRING": "array_join(transform(p, x -> concat(url_encode(x.key), '=', url_encode(x.value))), '&')",
    f"params_set(p {_PARAMS}, k STRING, v STRING) RETURNS {_PARAMS}": "CASE WHEN exists(p, x -> x.key = k) THEN transform(filter(transform(p, (x, i) -> named_struct('p', x, 'i', i + 1)), y -> y.p.key <> k OR y.i = array_position(transform(p, x -> x.key), k)),"
    " y -> named_struct('key', y.p.key, 'value', CASE WHEN y.p.key = k THEN v ELSE y.p.value END)) ELSE concat(p, array(named_struct('key', k, 'value', v))) END",
    f"params_sort(p {_PARAMS}) RETURNS {_PARAMS}": "transform(array_sort(transform(p, (x, i) -> named_struct('k', encode(x.key, 'UTF-16BE'), 'i', i, 'p', x))), y -> y.p)",
    f"params_get(p {_PARAMS}, k STRING) RETURNS STRING": "try_element_at(filter(p, x -> x.key = k), 1).value",
    f"params_get_all(p {_PARAMS}, k STRING) RETURNS ARRAY<STRING>": "transform(filter(p, x -> x.key = k), x -> x.value)",
    f"params_has(p {_PARAMS}, k STRING) RETURNS BOOLEAN": "exists(p, x -> x.key = k)",
    f"params_remove(p {_PARAMS}, k STRING) RETURNS {_PARAMS}": "filter(p, x -> x.key <> k)",
}


def _part_sql(spark: SparkSession, part: str) -> str:
    """The built-in expression of a plain URL's part as SQL text over u."""
    plan = spark.range(1).select(F.lit("").alias("u")).select(plain_parts(F.col("u"))[part].alias("x"))._jdf.queryExecution().analyzed()
    return plan.projectList().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Registers everything; returns the names."""
    ship(spark)
    for name, function, kind in PYTHON:
        spark.udf.register(name, F.udf(function, kind, useArrow=True))
    for part in PARTS:
        body = f"CASE WHEN {_GUARD} THEN {_part_sql(spark, part)} ELSE url_part_any(CASE WHEN NOT {_GUARD} THEN u END, '{part}') END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION url_get_{part}(u STRING) RETURNS STRING RETURN {body}")
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("url_params", udtf(ParamsTable, returnType="position int, key string, value string"))
    return [*(n for n, _, _ in PYTHON), *(f"url_get_{p}" for p in PARTS), *(h.split("(")[0] for h in SQL), "url_params"]
