"""Turn the model's JSON answer into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postulant.functions import as_column
from postulant.functions.text import strip
from postulant.schema import ANSWER_FIELDS

_END = "\u0000end"


def read_json(response: Column | str) -> Column:
    r"""The answer as the head of an array whose tail is known.

    `\&`, which models like to write, is not valid JSON and is unescaped first.
    `from_json` stops after the first value and ignores what follows; inside an
    array, trailing garbage fails.
    """
    text = F.replace(as_column(response), F.lit(r"\&"), F.lit("&"))
    closed = F.concat(F.lit("["), text, F.lit(r',{"\u0000end":"1"}]'))
    return F.from_json(closed, "array<map<string,string>>", {"allowSingleQuotes": "false"})


def only_object(parsed: Column | str) -> Column:
    """The answer in the array of `read_json` if it is exactly one object, else null."""
    array = as_column(parsed)
    complete = (F.size(array) == 2) & F.map_contains_key(F.get(array, F.lit(1)), _END)
    return F.when(complete, F.get(array, F.lit(0)))


def answer_field(answer: Column | str, key: str, default: str) -> Column:
    """A field of a parsed answer: the default if absent, null if it was null.

    A repeated key counts with its last value.
    """
    entries = F.filter(F.map_entries(as_column(answer)), lambda entry: entry["key"] == key)
    present = F.size(entries) > 0
    return F.when(present, F.element_at(entries, -1)["value"]).otherwise(default)


def to_number(text: Column | str) -> Column:
    """A number written with a point or a comma; null for anything else."""
    plain = F.translate(strip(text), ",", ".")
    numeric = plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(numeric, plain.try_cast("double"))


def parse_answers(df: DataFrame, response: str = "response", answer: str = "answer") -> DataFrame:
    """Add the parsed answer, null if it failed. Its own projection parses every row once."""
    parsed = df.withColumn(answer, read_json(response))
    return parsed.withColumn(answer, only_object(answer))


def normalise_answers(df: DataFrame, response: str = "response") -> DataFrame:
    """Replace the response column by the five typed answer columns.

    A failed response behaves like an empty object, so every field gets its default.
    """
    empty = F.create_map().cast("map<string,string>")
    parsed = parse_answers(df, response, "_answer").withColumn("_answer", F.coalesce("_answer", empty))
    fields = {
        column: answer_field("_answer", key, default)
        for key, (column, default) in ANSWER_FIELDS.items()
    }
    fields["years_exp"] = to_number(fields["years_exp"])
    return parsed.withColumns(fields).drop("_answer", response)
