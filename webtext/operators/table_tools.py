"""Tools whose handler is a Python table function (A13): one partition and one set of rows per call.

The function is polymorphic: ``analyze`` reads the declared parameters and
output columns and gives the schema, the partitioning by call and the columns that
the function needs. Spark deals the calls to tasks, so a tool that reads much per call
runs next to others, and a call's rows go through no other call's state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf

from ..session import ship_package
from .agent import Tool

#: declared parameter type -> the Python value a tool gets; a NULL or absent argument is None
_VALUES: dict[str, Callable[[str], object]] = {"string": str, "integer": lambda x: int(float(x)), "number": float, "boolean": lambda x: x == "true"}


def typed_arguments(arguments: dict | None, params: dict[str, str]) -> dict[str, object]:
    """The declared arguments as Python values; ``arguments``: name -> (kind, text)."""
    out = {}
    for name, kind in params.items():
        given = (arguments or {}).get(name)
        out[name] = None if given is None or given["text"] is None or given["kind"] == "null" else _VALUES.get(kind, str)(given["text"])
    return out


def table_function(run: Callable[..., Iterator[tuple]]):
    """A table function over a table of calls that yields the rows of ``run(**arguments)`` for each call."""

    class Calls:
        def __init__(self):
            self.params = None

        @staticmethod
        def analyze(calls: AnalyzeArgument, params: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
            if not calls.isTable:
                raise ValueError("the first argument must be a table of calls")
            known = {f.name: f.dataType for f in calls.dataType.fields}
            if json.loads(params.value) and "arguments" not in known:
                raise ValueError("the table of calls has no arguments")
            schema = T.StructType([T.StructField("request_id", known["request_id"]), T.StructField("call_idx", known["call_idx"]), T.StructField("row_idx", T.LongType())])
            for declared in T.StructType.fromJson(json.loads(columns.value)):
                schema = schema.add(declared)
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("request_id"), PartitioningColumn("call_idx")])

        def eval(self, calls, params: str, columns: str):
            if self.params is None:
                self.params = json.loads(params)
            arguments = calls["arguments"] if self.params else None
            for i, row in enumerate(run(**typed_arguments(arguments, self.params))):
                yield (calls["request_id"], calls["call_idx"], i, *row)

    return udtf(Calls)


def table_tool(
    name: str,
    description: str,
    params: dict[str, tuple[str, str]],
    required: list[str],
    columns: dict[str, T.DataType],
    run: Callable[..., Iterator[tuple]],
) -> Tool:
    """A tool that gives ``columns`` (name -> type) row by row; its answer has one text part, a line per row.

    ``run(**arguments)`` gets the declared arguments as Python values, None for those not given, and yields tuples.
    A call without rows answers with an empty part.
    """
    function = table_function(run)
    kinds, shape = json.dumps({k: v[0] for k, v in params.items()}), T.StructType([T.StructField(c, t) for c, t in columns.items()]).json()

    def rows_of(calls: DataFrame) -> DataFrame:
        ship_package(calls.sparkSession)
        return function(calls.select("request_id", "call_idx", "arguments").asTable(), F.lit(kinds), F.lit(shape))

    def handler(calls: DataFrame, ctx: dict) -> DataFrame:
        line = F.concat_ws(": ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        lines = rows_of(calls).groupBy("request_id", "call_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))).alias("lines"))
        text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
        out = calls.select("request_id", "call_idx").join(lines.select("request_id", "call_idx", text.alias("text")), ["request_id", "call_idx"], "left")
        return out.select("request_id", "call_idx", F.array(F.coalesce("text", F.lit(""))).alias("parts"), F.lit(False).alias("is_error"))

    tool = Tool(name, description, params, required, handler)
    tool.rows_of = rows_of
    return tool
