"""Strict reads of free-form JSON.

A string is only a string and a number only a number here: casting a VARIANT
would turn ``5`` into ``'5'``, so every read tests the stored kind first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, for values too costly to compute per use.

    Inside one expression Spark repeats an operand wherever it is written (and
    never shares it inside lambdas); a one-element transform binds it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse(text: Column) -> Column:
    """JSON text to VARIANT; text that is not JSON gives null."""
    return F.try_parse_json(text)


def parse_whole(text: Column) -> Column:
    """JSON text to VARIANT, null unless the whole text is exactly one JSON value.

    Spark's parser stops after the first value, so ``{"a":1}}`` would pass.
    Wrapped in an array and in an object the text only parses both times when
    nothing follows the value.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def as_str(value: Column) -> Column:
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_int(value: Column) -> Column:
    numeric = kind(value).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return F.when(numeric, F.try_variant_get(value, "$", "bigint"))


def as_bool(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def as_array(value: Column) -> Column:
    """The elements as VARIANTs, null for anything that is not an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def str_at(value: Column, path: str) -> Column:
    return as_str(at(value, path))


def int_at(value: Column, path: str) -> Column:
    return as_int(at(value, path))


def bool_at(value: Column, path: str) -> Column:
    return as_bool(at(value, path))


def array_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def field(text: Column, name: str) -> Column:
    """One top-level field of JSON text; only its own value is built."""
    return typed(text, f"`{name}` variant")[name]


def str_field(text: Column, name: str) -> Column:
    return let(field(text, name), as_str)


def int_field(text: Column, name: str) -> Column:
    return let(field(text, name), as_int)


def wrap_root(text: Column) -> Column:
    """JSON object text as it is; any other JSON value as ``{"value": x}``."""
    return let(
        parse(text),
        lambda value: F.when(value.isNull(), None)
        .when(is_object(value), F.to_json(value))
        .otherwise(F.concat(F.lit('{"value":'), F.to_json(value), F.lit("}"))),
    )


# One typed parse per purpose. Jackson skips what a schema does not name, so a
# token total never builds the message text. Whole numbers are read strictly
# by the parser (a quoted number is null); leaves of unknown kind stay VARIANT.
USAGE_SCHEMA = (
    "message struct<usage: struct<input_tokens: bigint, output_tokens: bigint,"
    " cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>,"
    " tokens struct<input: bigint, output: bigint, cached: bigint, total: bigint>"
)
MODEL_SCHEMA = "message struct<model: variant>, model variant"
USAGE_MODEL_SCHEMA = (
    "message struct<model: variant, usage: struct<input_tokens: bigint, output_tokens: bigint,"
    " cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>, model variant,"
    " tokens struct<input: bigint, output: bigint, cached: bigint, total: bigint>"
)
TOOLS_SCHEMA = (
    "message struct<content: variant, usage: struct<output_tokens: bigint>>,"
    " tokens struct<output: bigint>, toolCalls variant"
)


def typed(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def output_tokens(raw: Column) -> Column:
    """Output tokens of a parsed raw record, either shape, 0 when absent."""
    return F.coalesce(
        raw["message"]["usage"]["output_tokens"], raw["tokens"]["output"], F.lit(0)
    )


def output_tokens_both(raw: Column) -> Column:
    """The per-session rule: both shapes are added."""
    return F.coalesce(raw["message"]["usage"]["output_tokens"], F.lit(0)) + F.coalesce(
        raw["tokens"]["output"], F.lit(0)
    )


def model_name(raw: Column) -> Column:
    return F.coalesce(as_str(raw["message"]["model"]), as_str(raw["model"]))


def context_tokens(raw: Column) -> Column:
    """Context size a usage-bearing record reports; null when it is 0."""
    usage, tokens = raw["message"]["usage"], raw["tokens"]
    zero = F.lit(0)
    first = (
        F.coalesce(usage["input_tokens"], zero)
        + F.coalesce(usage["cache_read_input_tokens"], zero)
        + F.coalesce(usage["cache_creation_input_tokens"], zero)
    )
    second = F.when(F.coalesce(tokens["total"], zero) > 0, tokens["total"]).otherwise(
        F.coalesce(tokens["input"], zero) + F.coalesce(tokens["cached"], zero)
    )
    size = F.when(usage.isNotNull(), first).otherwise(second)
    return F.when(size > 0, size)


def bears_usage(raw: Column) -> Column:
    return raw["message"]["usage"].isNotNull() | raw["tokens"].isNotNull()
