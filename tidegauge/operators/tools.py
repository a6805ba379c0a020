"""Tool calls, prompt capabilities and cache-busting prefixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import fixed, scalars
from tidegauge.functions.ends import until_end
from tidegauge.functions.sizing import broadcast_if_small, settle
from tidegauge.operators.records import PART_CHUNKS

# -- tool calls ----------------------------------------------------------------


def tool_call_parts(chunks: DataFrame, size: int = PART_CHUNKS, ends: DataFrame | None = None) -> DataFrame:
    """Streamed tool-call pieces up to the end of the stream, put together in parts of `size` positions.

    `(request_id, index, part, name, named_at, arguments)`: the last name that is not empty with its
    place, and the part's arguments in order. A call of any length is spread over its parts. `ends` is
    a result of `functions.ends.stream_ends`; without it, it is made here.
    """
    pieces = until_end(chunks, ends).select("request_id", "seq", F.posexplode("tool_calls").alias("place", "call")).select(
        "request_id", "seq", "place", F.coalesce("call.index", F.lit(0)).alias("index"), "call.name", "call.arguments"
    )
    position = F.struct("seq", "place")
    named = F.when(F.coalesce(F.col("name") != "", F.lit(False)), position)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "place", F.coalesce("arguments", F.lit("")).alias("text"))))
    part = F.floor(F.col("seq") / size).alias("part")
    return pieces.groupBy("request_id", "index", part).agg(
        F.max_by("name", named).alias("name"), F.max(named).alias("named_at"), F.array_join(F.transform(ordered, lambda piece: piece["text"]), "").alias("arguments")
    )


def merge_tool_calls(chunks: DataFrame, ends: DataFrame | None = None, size: int = PART_CHUNKS) -> DataFrame:
    """Assemble streamed tool-call pieces: last name that is not empty, arguments in order, as one cell per call.

    Use `tool_call_parts` for arguments that no cell holds.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part", "arguments")))
    return tool_call_parts(chunks, size, ends).groupBy("request_id", "index").agg(
        F.coalesce(F.max_by("name", "named_at"), F.lit("")).alias("name"),
        F.array_join(F.transform(ordered, lambda piece: piece["arguments"]), "").alias("arguments"),
    )


def parse_tool_arguments(calls: DataFrame) -> DataFrame:
    return calls.withColumn("arguments", scalars.tool_arguments(F.col("arguments")))


def canonical_texts(texts: DataFrame) -> DataFrame:
    """`text`, `form`: the canonical JSON of each distinct text of `texts` (`text`), null left out.

    Equal texts meet before any is parsed, so a text is parsed once, however often it comes.
    """
    return texts.where(F.col("text").isNotNull()).distinct().withColumn("form", scalars.canonical_json(F.col("text")))


def distinct_tool_calls(calls: DataFrame) -> DataFrame:
    """Distinct invocations of each run by canonical JSON, with the place they were first seen.

    Calls are grouped by their texts as they are, combined before the shuffle; the distinct texts
    are parsed, and the groups meet again by what they say.
    """
    raw = settle(calls.groupBy("run_id", "tool", "arguments", "result").agg(F.min("seq").alias("first_seq")))
    texts = raw.select(F.explode(F.array("arguments", "result")).alias("text"))
    forms = broadcast_if_small(settle(canonical_texts(texts)))
    found = raw
    for name in ("arguments", "result"):
        side = forms.select(F.col("text").alias(name), F.col("form").alias(f"_{name}"))
        found = found.join(side, name, "left").drop(name).withColumnRenamed(f"_{name}", name)
    return found.groupBy("run_id", "tool", "arguments", "result").agg(F.min("first_seq").alias("first_seq"))


def tool_call_counts(calls: DataFrame) -> DataFrame:
    return distinct_tool_calls(calls).groupBy("run_id", "tool").agg(F.count(F.lit(1)).alias("invocations"))


def lookup_tool_results(calls: DataFrame, prompts: DataFrame) -> DataFrame:
    """Add the fixed payload of the prompt for the called tool; null when it has none."""
    payloads = prompts.select(F.col("id").alias("prompt_id"), F.explode("tool_results").alias("name", "result"))
    return calls.join(payloads, ["prompt_id", "name"], "left")


# -- capabilities ----------------------------------------------------------------


def prompt_needs(prompts: DataFrame) -> DataFrame:
    """Add `requires_tools` and `requires_vision`."""
    image = F.exists(
        F.coalesce("messages", F.array()),
        lambda m: F.exists(F.coalesce(m["parts"], F.array()), lambda part: part["type"] == "image_url"),
    )
    return prompts.withColumns(
        {
            "requires_tools": (F.coalesce(F.size("tools"), F.lit(0)) > 0) | (F.col("category") == "tool-use"),
            "requires_vision": (F.col("category") == "vision") | F.coalesce(image, F.lit(False)),
        }
    )


def _reason() -> Column:
    return F.when(F.col("requires_tools") & ~F.col("supports_tools"), fixed.TOOLS_UNSUPPORTED).when(
        F.col("requires_vision") & ~F.col("supports_vision"), fixed.VISION_UNSUPPORTED
    )


def _run_models(runs: DataFrame, models: DataFrame) -> DataFrame:
    names = models.select(F.col("name").alias("model_name"), "model", "supports_tools", "supports_vision")
    return runs.select("run_id", "library", "model_name").join(names, "model_name").drop("model_name")


@dataclass(frozen=True)
class Gate:
    """Which prompts the runs can serve, as two tables that grow with the prompts and with the runs.

    `members`: `prompt_id`, `library` and `need`, the class of what the prompt requires (0 to 3).
    `reasons`: for each run and class of need the `skip_reason`, null where its model can serve it.
    """

    members: DataFrame
    reasons: DataFrame

    def expand(self, run_id: str | None = None) -> DataFrame:
        """A row per run and prompt, or those of one run: `run_id`, `model`, `prompt_id`, `skip_reason`."""
        reasons = self.reasons if run_id is None else self.reasons.where(F.col("run_id") == run_id)
        return self.members.join(reasons, ["library", "need"]).select("run_id", "model", "prompt_id", "skip_reason")

    def counts(self) -> DataFrame:
        """Skipped prompts of each run by reason, zeros included; no prompt is paired with a run."""
        sizes = self.members.groupBy("library", "need").agg(F.count(F.lit(1)).alias("n"))
        zero = F.lit(0).cast("long")
        return self.reasons.join(sizes, ["library", "need"], "left").groupBy("run_id").agg(
            *[F.coalesce(F.sum(F.when(F.col("skip_reason") == name, F.col("n"))), zero).alias(name) for name in (fixed.TOOLS_UNSUPPORTED, fixed.VISION_UNSUPPORTED)]
        )


def capability_gate(prompts: DataFrame, runs: DataFrame, models: DataFrame) -> Gate:
    """The gate of the runs over their libraries' prompts, factored by what prompts require."""
    need = F.col("requires_tools").cast("int") * 2 + F.col("requires_vision").cast("int")
    members = prompt_needs(prompts).select(F.col("id").alias("prompt_id"), "library", need.alias("need"))
    classes = F.explode(F.array(*[F.lit(x) for x in range(4)])).alias("need")
    wide = _run_models(runs, models).select("*", classes).withColumns(
        {"requires_tools": F.col("need") >= 2, "requires_vision": F.col("need") % 2 == 1}
    )
    return Gate(members, wide.select("run_id", "model", "library", "need", _reason().alias("skip_reason")))


def gate_prompts(prompts: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """Prompts of each run's library with `skip_reason`, null when its model can serve them."""
    return capability_gate(prompts, runs, models).expand()


def skip_counts(prompts: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """Skipped prompts of each run by reason, zeros included, from the factored gate."""
    return capability_gate(prompts, runs, models).counts()


# -- cache busting -----------------------------------------------------------------


def marker(ident: Column, seed: Column) -> Column:
    """A prefix unique per id and reproducible for a seed."""
    return F.concat(F.lit("[cb-"), F.md5(F.concat_ws(":", ident.cast("string"), seed.cast("string"))), F.lit("] "))


def bust_cache(turns: DataFrame, seed: int) -> DataFrame:
    """Put the marker before the last user text of each conversation `(conv_id, turn, role, text)`."""
    user = (F.col("role") == "user") & F.col("text").isNotNull()
    last = turns.where(user).groupBy("conv_id").agg(F.max("turn").alias("_last"))
    hit = (F.col("turn") == F.col("_last")) & user
    prefixed = F.when(hit, F.concat(marker(F.col("conv_id"), F.lit(seed)), F.col("text"))).otherwise(F.col("text"))
    return turns.join(last, "conv_id", "left").withColumn("text", prefixed).drop("_last")


def bust_messages(messages: Column, mark: Column) -> Column:
    """The same for one prompt's message array; messages made of parts are left alone."""
    place = F.array_max(
        F.transform(
            messages, lambda m, i: F.when((m["role"] == "user") & m["content"].isNotNull(), i).otherwise(F.lit(-1))
        )
    )
    return F.transform(
        messages,
        lambda m, i: F.when(i == place, m.withField("content", F.concat(mark, m["content"]))).otherwise(m),
    )
