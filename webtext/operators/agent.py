"""Agent decisions and tool calls (A1-A16) as DataFrame jobs.

Turns become requests, requests get a model decision, decisions explode into
calls, calls are validated against the tool catalog with Catalyst
higher-order functions, valid calls run through each tool's DataFrame
handler, and results are aggregated per request in call order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decision import canonical_decision, typed_decision
from ..functions.text import ws_trim
from ..session import ship_package
from .summarize import chat_request

# Prompt texts of the agent.
ANALYSIS_USER_TEMPLATE = (
    "Analyze this user request and determine if any tools should be called:\n\n"
    'User Request: "{input}"\n\n'
    "Instructions:\n"
    "1. Decide if any of the available tools are needed based on their names, descriptions, and JSON schemas\n"
    "2. If tools should be used, specify which ones and with what parameters\n"
    "3. Provide reasoning for your decisions\n"
    "4. Respond in JSON format as specified in the system prompt\n"
    "5. Determine if postprocessing tool output is required, if yes, suggest the additional system prompt in verb e.g. Summarize, Recommend topic.\n"
)
SYSTEM_HEAD = (
    "You are an intelligent agent that helps users with tasks. You have access to the following tools:\n\n"
)
SYSTEM_TAIL = """

Your job is to analyze user requests and determine:
1. Whether any tools should be called to fulfill the request
2. Which specific tools to call and with what parameters
3. The reasoning behind your decisions

IMPORTANT: You must respond in valid JSON format with this exact structure:
{
	"message": "A helpful message to the user about what you understand from their request",
	"tool_calls": [
		{
			"name": "tool_name",
			"arguments": {
				"param1": "value1",
				"param2": "value2"
			},
			"reasoning": "Why this tool call is needed"
		}
	],
	"should_call": true/false,
	"confidence": 0.0-1.0,
	"explanation": "Detailed explanation of your analysis and decisions",
	"post_process": "Summarize"
}

Guidelines:
"""
GUIDELINES = [
    '- If the user asks general questions that don\'t require web content, set "should_call" to false',
    "- Be conservative: only call tools when clearly needed",
    "- Provide clear reasoning for your decisions",
    "- Extract parameters accurately from user input",
    "- Set confidence based on how clear the user's intent is",
]
POST_SYSTEM = (
    "You are an expert post-processing assistant. You perform a single action described by an imperative verb "
    "(e.g., Summarize, Recommend, Exclude, Transform) on the given content. Return only the final result with no "
    "preamble. Keep it faithful, concise, and helpful."
)
LOW_CONFIDENCE_FMT = "Confidence: %s%% - I'm not very confident about this interpretation."
LOW_CONFIDENCE = 0.5
AGENT_MAX_TOKENS = 1000
AGENT_TEMPERATURE = 0.2
POST_MAX_TOKENS = 700
POST_TEMPERATURE = 0.3
EXIT_WORDS = ("exit", "quit")


# -- tool registry (A13) --------------------------------------------------


@dataclass
class Tool:
    """A callable tool: JSON-Schema-like parameters and a DataFrame handler.

    ``handler(calls, ctx)`` gets the valid calls of this tool (``request_id,
    call_idx, name, arguments``) and returns ``request_id, call_idx, parts
    array<string>, is_error boolean``. It may use any Spark operator or UDF.
    """

    name: str
    description: str
    params: dict[str, tuple[str, str]] | None  # name -> (type, description); None = no schema
    required: list[str] = field(default_factory=list)
    handler: Callable[[DataFrame, dict], DataFrame] | None = None

    def schema_dict(self) -> dict | None:
        if self.params is None:
            return None
        # key order of the rendered schema: type, required, properties (sorted)
        out: dict = {"type": "object"}
        if self.required:
            out["required"] = list(self.required)
        out["properties"] = {
            k: {"type": t, **({"description": d} if d else {})} for k, (t, d) in sorted(self.params.items())
        }
        return out


class ToolRegistry:
    def __init__(self):
        self.tools: list[Tool] = []

    def register(self, tool: Tool) -> "ToolRegistry":
        self.tools.append(tool)
        return self

    def first(self, name: str) -> Tool | None:
        return next((t for t in self.tools if t.name == name), None)

    def catalog_json(self) -> str:
        """The tool list as 2-space indented JSON (``[]`` when empty)."""
        items = [
            {"name": t.name, "description": t.description, "parameters": t.schema_dict()} for t in self.tools
        ]
        text = json.dumps(items, indent=2, ensure_ascii=False)
        # the original encoder also escapes these characters inside strings
        for ch, esc in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
            text = text.replace(ch, esc)
        return text

    def catalog(self, spark: SparkSession) -> DataFrame:
        """A2: one row per tool (first definition of a name wins). The registry is
        driver configuration whose size is known here, so it is safe to broadcast."""
        rows, seen = [], set()
        for pos, t in enumerate(self.tools):
            if t.name in seen:
                continue
            seen.add(t.name)
            rows.append(
                (
                    pos, t.name, t.description,
                    {k: v[0] for k, v in (t.params or {}).items()},
                    list(t.required), t.params is not None,
                    json.dumps(t.schema_dict()) if t.params is not None else None,
                )
            )
        schema = T.StructType(
            [
                T.StructField("tool_pos", T.IntegerType()),
                T.StructField("tool_name", T.StringType()),
                T.StructField("description", T.StringType()),
                T.StructField("params", T.MapType(T.StringType(), T.StringType())),
                T.StructField("required", T.ArrayType(T.StringType())),
                T.StructField("has_schema", T.BooleanType()),
                T.StructField("schema_json", T.StringType()),
            ]
        )
        return spark.createDataFrame(rows, schema)


def tool_listing(catalog: DataFrame) -> DataFrame:
    """A2 listing text: ``Tools (N)`` then per tool name, description and schema."""

    per = catalog.select(
        "tool_pos",
        F.concat(
            F.lit("- "), F.col("tool_name"), F.lit(": "), F.col("description"), F.lit("\n"),
            F.when(F.col("schema_json").isNull(), F.lit("  Input schema: <none>")).otherwise(
                F.concat(F.lit("  Input schema:\n"), F.col("schema_pretty"))
            ),
        ).alias("entry"),
    )
    agg = per.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("tool_pos", "entry"))).alias("e"))
    return agg.select(
        F.concat(F.lit("Tools ("), F.col("n").cast("string"), F.lit(")\n"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n")).alias("listing")
    )


def pretty_schema(tool: Tool, prefix: str = "  ") -> str:
    return json.dumps(tool.schema_dict(), indent=2).replace("\n", "\n" + prefix)


def catalog_with_pretty(registry: ToolRegistry, spark: SparkSession) -> DataFrame:
    cat = registry.catalog(spark)
    pretty = spark.createDataFrame(
        [(t.name, pretty_schema(t) if t.params is not None else None) for t in registry.tools],
        "tool_name string, schema_pretty string",
    ).dropDuplicates(["tool_name"])
    return cat.join(pretty, "tool_name", "left")


# -- A1 sessions ------------------------------------------------------------


def session_turns(lines: DataFrame) -> DataFrame:
    """A1: trim lines, drop blank ones, end each conversation at its first line
    equal (case-insensitively) to exit/quit, dropping it and everything after.

    The cut is a per-conversation ``min(turn)`` (map-side combined) joined back,
    not a window, so a huge conversation is never sorted in one task."""
    t = lines.withColumn("text", ws_trim(F.col("text"))).filter(F.col("text") != "")
    is_exit = F.lower(F.col("text")).isin(*EXIT_WORDS)
    exits = t.filter(is_exit).groupBy("conv_id").agg(F.min("turn").alias("_exit_turn"))
    j = t.join(exits, "conv_id", "left")
    return j.filter(F.col("_exit_turn").isNull() | (F.col("turn") < F.col("_exit_turn"))).drop("_exit_turn")


# -- A3 analysis requests -----------------------------------------------------


def system_prompt(registry: ToolRegistry) -> str:
    return SYSTEM_HEAD + registry.catalog_json() + SYSTEM_TAIL + "\n".join(GUIDELINES)


def user_prompt(user_text: Column) -> Column:
    head, tail = ANALYSIS_USER_TEMPLATE.split("{input}")
    return F.concat(F.lit(head), user_text, F.lit(tail))


def analysis_request(requests: DataFrame, registry: ToolRegistry, model: str,
                     max_tokens: int = AGENT_MAX_TOKENS, temperature: float = AGENT_TEMPERATURE) -> DataFrame:
    """A3: per user turn, the chat request asking the model for a decision."""
    sys_text = system_prompt(registry)
    up = user_prompt(F.col("user_text"))
    return requests.withColumns(
        {
            "system_prompt": F.lit(sys_text),
            "user_prompt": up,
            "chat_request": chat_request(F.lit(sys_text), up, model, max_tokens, temperature),
        }
    )


# -- A4-A7 decisions ------------------------------------------------------------


def parse_decision(decisions: DataFrame, text_col: str = "decision_text") -> DataFrame:
    """A4: trimmed text -> typed ``decision`` struct and ``parse_ok``."""
    ship_package(decisions.sparkSession)
    canon = decisions.withColumn("_canon", canonical_decision(ws_trim(F.col(text_col))))
    return canon.withColumns(
        {"decision": typed_decision(F.col("_canon")), "parse_ok": F.col("_canon").isNotNull()}
    ).drop("_canon")


def low_confidence(decisions: DataFrame) -> DataFrame:
    """A5: the warning text for confidence < 0.5, else NULL. ``format_number``
    rounds the exact binary value, ties to even."""
    conf = F.col("decision.confidence")
    return decisions.withColumn(
        "confidence_note", F.when(conf < LOW_CONFIDENCE, F.format_string(LOW_CONFIDENCE_FMT, F.format_number(conf * 100, 1)))
    )


def route_decision(decisions: DataFrame) -> DataFrame:
    """``explain`` when should_call is false or there are no calls, else ``tools``."""
    go = F.col("decision.should_call") & (F.size("decision.tool_calls") > 0)
    return decisions.withColumn("route", F.when(go, F.lit("tools")).otherwise(F.lit("explain")))


def explode_calls(decisions: DataFrame) -> DataFrame:
    """One row per call of a ``tools`` decision, 1-based ``call_idx`` and ``n_calls``."""
    d = decisions.filter(F.col("route") == "tools")
    return d.select(
        "request_id",
        F.size("decision.tool_calls").alias("n_calls"),
        F.posexplode("decision.tool_calls").alias("_pos", "call"),
    ).select(
        "request_id",
        (F.col("_pos") + 1).alias("call_idx"),
        "n_calls",
        F.col("call.name").alias("name"),
        F.col("call.arguments").alias("arguments"),
        F.col("call.reasoning").alias("reasoning"),
    )


# -- A8-A11 validation --------------------------------------------------------------


def _type_error(args: Column, params: Column) -> Column:
    """First (by parameter name) declared parameter whose value has the wrong kind."""

    def check(p: Column) -> Column:
        t = params[p]
        present = F.map_contains_key(args, p)
        kind = args[p]["kind"]
        msg = (
            F.when((t == "string") & (kind != "string"), F.lit("a string"))
            .when((t == "integer") & (kind != "number"), F.lit("an integer"))
            .when((t == "number") & (kind != "number"), F.lit("a number"))
            .when((t == "boolean") & (kind != "boolean"), F.lit("a boolean"))
        )
        return F.when(present & msg.isNotNull(), F.format_string("parameter '%s' must be %s", p, msg))

    errs = F.filter(F.transform(F.array_sort(F.map_keys(params)), check), lambda e: e.isNotNull())
    return F.get(errs, 0)


def validate_calls(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """``validation_error`` = unknown tool, else first missing required
    parameter, else first wrongly typed parameter, else NULL."""
    checked = _checked(calls, catalog)
    return checked.withColumn("validation_error", F.coalesce("_unknown", "_missing", "_type")).drop("_unknown", "_missing", "_type")


def missing_params(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """``validation_error`` = first missing required parameter of a known tool, else NULL."""
    return _checked(calls, catalog).withColumn("validation_error", F.col("_missing")).drop("_unknown", "_missing", "_type")


def param_types(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """A10: ``validation_error`` = first wrongly typed parameter of a known tool, missing ones or not, else NULL."""
    return _checked(calls, catalog).withColumn("validation_error", F.col("_type")).drop("_unknown", "_missing", "_type")


def _checked(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """The calls with the message of each check: ``_unknown``, ``_missing``, ``_type``."""
    cat = catalog.select("tool_name", "params", "required", "has_schema", F.lit(True).alias("_known"))
    j = calls.join(cat, calls["name"] == cat["tool_name"], "left")
    args = F.coalesce(F.col("arguments"), F.create_map().cast("map<string,struct<kind:string,text:string>>"))
    missing = F.get(F.filter(F.col("required"), lambda p: ~F.map_contains_key(args, p)), 0)
    unknown = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown tool: "), F.col("name")))
    miss_msg = F.when(
        F.col("has_schema") & missing.isNotNull(),
        F.format_string("missing required parameter '%s' for tool '%s'", missing, F.col("name")),
    )
    type_msg = F.when(F.col("has_schema"), _type_error(args, F.col("params")))
    return j.withColumns({"_unknown": unknown, "_missing": miss_msg, "_type": type_msg}).drop(
        "tool_name", "params", "required", "has_schema", "_known"
    )


def arg_text(name: str) -> Column:
    """A string argument as the tool receives it ('' when absent or not a string)."""
    v = F.col("arguments")[name]
    return F.when(v["kind"] == "string", v["text"]).otherwise(F.lit(""))


# -- A12 running calls ------------------------------------------------------------


def run_calls(valid_calls: DataFrame, registry: ToolRegistry, ctx: dict) -> DataFrame:
    """Route each valid call to its tool's handler and union the results.

    Result text = all text parts joined by a blank line; a tool's ``is_error``
    flag is kept as a column but does not stop the text from counting as a result.
    A call without an output (its tool has no handler, or the handler lost it)
    gets an error row without a result.
    """
    outs = []
    for name in dict.fromkeys(t.name for t in registry.tools):
        tool = registry.first(name)
        if tool is None or tool.handler is None:
            continue
        mine = valid_calls.filter(F.col("name") == name)
        res = tool.handler(mine, ctx).select("request_id", "call_idx", F.lit(name).alias("name"), "parts", "is_error")
        outs.append(res)
    calls = valid_calls.select("request_id", "call_idx", "name")
    if not outs:
        none = calls.withColumns({"parts": F.lit(None).cast("array<string>"), "is_error": F.lit(True)})
        return none.withColumn("result", F.lit(None).cast("string"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    done = calls.join(out, ["request_id", "call_idx", "name"], "left").withColumn("is_error", F.coalesce("is_error", F.lit(True)))
    return done.withColumn("result", F.array_join("parts", "\n\n"))


# -- A14-A16 aggregation and post-processing ---------------------------------------


def aggregate_outputs(results: DataFrame) -> DataFrame:
    """Per request, the non-blank results (untrimmed) in call order joined by
    a blank line, the whole string trimmed."""
    keep = results.filter(ws_trim(F.col("result")) != "")
    agg = keep.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("call_idx", "result"))).alias("_r"))
    return agg.select("request_id", ws_trim(F.array_join(F.transform("_r", lambda r: r["result"]), "\n\n")).alias("content"))


def post_process_request(df: DataFrame, model: str, configured_max_tokens: int = AGENT_MAX_TOKENS) -> DataFrame:
    """Requests with a non-empty ``post_process`` and non-empty ``content``
    get ``needs_model`` (instruction non-blank after trimming) and the prompt;
    a blank instruction passes the content through unchanged."""
    instr = ws_trim(F.col("post_process"))
    active = (F.col("post_process") != "") & (F.coalesce(F.col("content"), F.lit("")) != "")
    a = F.lit(configured_max_tokens)
    max_tokens = F.when(a == 0, F.lit(POST_MAX_TOKENS)).otherwise(F.least(a, F.lit(POST_MAX_TOKENS)))
    prompt = F.concat(
        F.lit("Instruction: "), instr, F.lit("\n\nUser Request: "), F.col("user_text"),
        F.lit("\n\nContent to process:\n"), F.col("content"),
    )
    return df.withColumns(
        {
            "post_active": active,
            "needs_model": active & (instr != ""),
            "prompt": F.when(active & (instr != ""), prompt),
            "post_max_tokens": F.when(active & (instr != ""), max_tokens),
            "post_request": F.when(
                active & (instr != ""), chat_request(POST_SYSTEM, prompt, model, max_tokens, POST_TEMPERATURE)
            ),
        }
    )


def post_process(df: DataFrame, completer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the completer on the rows that need the model; ``final_output``
    is the trimmed completion (or the content for a blank instruction),
    ``post_error`` the failure text. Tool results are never dropped."""
    need = df.filter(F.col("needs_model")).select("request_id", "prompt", "content", F.lit(0).alias("max_length"))
    comp = completer(need).select(
        "request_id", F.col("text").alias("_ptext"), F.col("failure").alias("_pfail"), F.col("cause").alias("_pcause")
    )
    j = df.join(comp, "request_id", "left")
    err = (
        F.when(F.col("_pfail") == "transport", F.concat(F.lit("post-process failed: "), F.col("_pcause")))
        .when(F.col("_pfail") == "no_choices", F.lit("post-process returned no choices"))
        .when(F.col("_pfail") == "missing", F.lit("post-process failed: no completion"))
    )
    final = (
        F.when(F.col("needs_model") & F.col("_pfail").isNull(), ws_trim(F.col("_ptext")))
        .when(F.col("post_active") & ~F.col("needs_model"), F.col("content"))
    )
    return j.withColumns({"final_output": final, "post_error": F.when(F.col("needs_model"), err)}).drop(
        "_ptext", "_pfail", "_pcause"
    )
