"""Conversation turns as data: history, the answer graph, guarded serving. Each node is a function of a DataFrame."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import parsing

#: Messages and characters of each that a follow-up is condensed with.
MESSAGES, CHARACTERS = 6, 600
Generate = Callable[[pd.Series], pd.Series]
THINKING = re.compile(r"Thinking\.\.\..*?(?:\.\.\.done thinking\.|<\|end\|>)|<think>.*?</think>", re.S | re.I)


def history(turns: DataFrame, session: str = "conv_id") -> DataFrame:
    """Adds `history`: the session's last messages before the turn, null on the first."""
    before = Window.partitionBy(session).orderBy("turn").rowsBetween(-MESSAGES, -1)
    said = F.collect_list(F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, CHARACTERS))).over(before)
    return turns.withColumn("history", F.when(F.size(said) > 0, F.concat_ws("\n", said)))


def echo_model(prompts: pd.Series) -> pd.Series:
    """Offline generator: cites the first source and repeats the end of the prompt."""
    return prompts.str.slice(-80) + " [S1]"


def chat(prompt: Column, model: Generate) -> Column:
    """The model's reply. A model is not a function of its prompt, so Spark neither repeats nor moves the call."""
    return parsing.strip_reasoning(F.pandas_udf(model, "string").asNondeterministic()(prompt))


#: Attempts at a call; tokens of the second call after an empty reply, at least and at most; its temperature and seed.
ATTEMPTS, MORE_TOKENS, MOST_TOKENS, ESCAPE, ESCAPE_SEED = 4, 2100, 4096, 0.8, 7


def patient(call: Callable[..., str], max_tokens: int = 1024, temperature: float = 0.0, wait: Callable[[float], None] = time.sleep) -> Generate:
    """A Generate of call(prompt, max_tokens, temperature, seed).

    Passing failures are tried again after 1, 2, 4 seconds; errors of the program, a model that is not paid for (402) or
    not found fail at once. A reply that is empty without its reasoning is asked for once more, with more tokens and warmer.
    """

    def ask(prompt: str, tokens: int, warmth: float, seed: int | None) -> str:
        for attempt in range(ATTEMPTS):
            try:
                return call(prompt, max_tokens=tokens, temperature=warmth, seed=seed) or ""
            except (TypeError, AttributeError, KeyError):
                raise
            except Exception as e:
                said = str(e).lower()
                if "402" in said or "payment required" in said or "not found" in said or attempt + 1 == ATTEMPTS:
                    raise RuntimeError(f"the model failed: {e}") from e
                wait(2**attempt)
        raise AssertionError

    def one(prompt: str) -> str:
        reply = ask(prompt, max_tokens, temperature, None)
        if THINKING.sub("", reply).strip():
            return reply
        return ask(prompt, min(max(3 * max_tokens, MORE_TOKENS), MOST_TOKENS), max(temperature, ESCAPE), ESCAPE_SEED)

    return lambda prompts: prompts.map(one)


def cached_chat(prompts: DataFrame, cache: DataFrame, model: Generate, name: str) -> tuple[DataFrame, DataFrame]:
    """(…, prompt) -> with `response`, and the cache rows to append: the model is asked for misses only, once a prompt.

    Empty replies are not stored.
    """
    keyed = prompts.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(name), "prompt"), 256))
    misses = keyed.select("key", "prompt").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = misses.withColumn("response", chat(F.col("prompt"), model)).withColumn("model", F.lit(name))
    stored = fresh.where(F.length(F.trim("response")) > 0).select("key", "model", "prompt", "response")
    known = cache.select("key", "response").unionByName(fresh.select("key", "response"))
    return keyed.join(known, "key", "left"), stored


@dataclass
class GraphConfig:
    """What the answer graph does and with what; `nodes` switches memory, decomposition and corrective retrieval."""

    retrieve: Callable[[DataFrame], DataFrame]
    generate: Generate = echo_model
    condense: Generate = echo_model
    decompose: Generate | None = None
    grade: Generate | None = None
    rewrite: Generate | None = None
    template: str = "{context}\n\nQuestion: {question}"
    top: int = 10
    budget: int = 5300
    nodes: dict = field(default_factory=lambda: {"memory": True, "decompose": False, "crag": False})


def answer(state: DataFrame, config: GraphConfig) -> DataFrame:
    """(qid, question, history?) -> with answer, sources, refused and trace. One plan for all questions.

    `retrieve` maps (qid, part, query) to (qid, context, sids). The corrective branch runs once at most.
    """
    trace = [F.lit("start_turn")]
    state = state.withColumn("original", F.col("question"))
    if config.nodes.get("memory") and "history" in state.columns:
        asked = F.col("_asked")
        state = state.withColumn("_asked", chat(F.concat_ws("\n", "history", "question"), config.condense))
        state = state.withColumn("question", F.when(F.col("history").isNull(), F.col("question")).otherwise(F.get(F.split(asked, "\n"), F.lit(0)))).drop("_asked")
        trace.append(F.lit("condense"))
    queries = F.array("question")
    if config.nodes.get("decompose") and config.decompose:
        state = state.withColumn("_parts", chat(F.col("question"), config.decompose))
        queries = F.array_union(queries, parsing.subqueries(F.col("_parts"), F.col("question")))
        trace.append(F.lit("decompose"))
    state = state.withColumn("queries", queries).drop("_parts")
    found = config.retrieve(state.select("qid", F.posexplode("queries").alias("part", "query")))
    trace.append(F.lit("retrieve"))
    if config.nodes.get("crag") and config.grade and config.rewrite:
        graded = found.join(state.select("qid", "question"), "qid").withColumn("_said", chat(F.concat_ws("\n", "question", "context"), config.grade))
        poor = graded.where(parsing.route(parsing.batch_grades(F.col("_said"), 5), F.lit(0)) == "rewrite").select("qid", "question")
        again = poor.withColumn("_other", chat(F.col("question"), config.rewrite)).withColumn("queries", F.array("question", "_other"))
        second = config.retrieve(again.select("qid", F.posexplode("queries").alias("part", "query"))).select("qid", F.col("context").alias("_context"), F.col("sids").alias("_sids"))
        found = found.join(second, "qid", "left").select("qid", F.coalesce("_context", "context").alias("context"), F.coalesce("_sids", "sids").alias("sids"))
        trace.append(F.lit("grade"))
    trace.append(F.lit("generate"))
    joined = state.join(found, "qid", "left")
    prompt = parsing.fill_prompt(F.lit(config.template), F.col("original"), F.coalesce("context", F.lit("")))
    answered = joined.withColumn("answer", chat(prompt, config.generate))
    return answered.withColumn("refused", parsing.is_refusal(F.col("answer"))).withColumn("trace", F.array(*trace))


def serve(answered: DataFrame, names: Column, injected: Column, scope: Column, first_turn: Column) -> DataFrame:
    """Guard, verify, expand, redact: what a reader gets for each turn."""
    report = parsing.verify(F.col("answer"), F.coalesce("sids", F.array().cast("array<string>")))
    shown = parsing.scrub(parsing.expand(F.col("answer"), names, bracket_unknown=False))
    out = answered.withColumn("blocked", parsing.gate(injected, scope, first_turn)).withColumn("report", report)
    return out.withColumn("reply", F.when(F.col("blocked").isNull(), shown)).withColumn("trace", last_turn(F.col("trace")))


def last_turn(trace: Column) -> Column:
    """The trace from its last start_turn on."""
    back = F.array_position(F.reverse(trace), "start_turn")
    return F.when(back > 0, F.slice(trace, F.size(trace) - back.cast("int") + 1, back.cast("int"))).otherwise(trace)
