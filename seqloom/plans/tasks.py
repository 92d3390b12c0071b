"""Prompt/completion tables built from samples and item tables.

A task is a question template, a completion and the columns that fill them. Everything stays
a projection over the sample row; look-ups are joins done before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import prompts
from seqloom.functions.arrays import training_tokens
from seqloom.operators.aggregates import last_wins
from seqloom.operators.ranking import portable_hash
from seqloom.operators.sampling import sample_rows


@dataclass(frozen=True)
class Task:
    """How one row becomes a prompt: `question` and `instruction` have {slots}; no completion means evaluation."""

    name: str
    question: str
    completion: Column | None
    target: Column
    history: Column
    instruction: Column | None = None
    slots: dict[str, Column] = field(default_factory=dict)


def build_task(rows: DataFrame, task: Task, key: Sequence[str]) -> DataFrame:
    """(key, task, prompt, completion, history_str, target)."""
    question = prompts.fill(task.question, **task.slots)
    prompt = prompts.fill(prompts.FRAME, question=question)
    if task.instruction is not None:
        prompt = F.concat(prompts.fill(prompts.PREAMBLE, instruction=task.instruction), prompt)
    completion = F.lit(None).cast("string") if task.completion is None else task.completion
    return rows.select(*key, F.lit(task.name).alias("task"), prompt.alias("prompt"), completion.alias("completion"),
                       task.history.alias("history_str"), task.target.alias("target"))


def instruction_variant(category: str, *key: str, seed: int = 42, variants: Sequence[str] = prompts.NEXT_ITEM_INSTRUCTIONS) -> Column:
    """One of the wordings, picked by a hash of the row key."""
    texts = F.array(*[F.lit(v.replace("{category}", category)) for v in variants])
    return F.get(texts, (portable_hash(*key, seed=seed) % len(variants)).cast("int"))


def line(text: Column) -> Column:
    return F.concat(text, F.lit("\n"))


def quoted_line(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"\n'))


# Questions: our wording, replaceable per call.
TITLES_QUESTION = "The user has chosen these {category} so far: {history}"
SIDS_QUESTION = "The user went through items {history} in this order. Which item comes next?"
SIDS_EVAL_QUESTION = "After the items {history}, in this order, what will the user turn to?"
SID_INSTRUCTION = "Predict the next item of the user's history."
SIDS_TITLE_QUESTION = "The user went through items {history} in this order. What is the title of the next one?"
SIDS_DESCRIPTION_QUESTION = "The user went through items {history}. Describe the item still missing."
TITLES_SID_QUESTION = "The user has chosen: {history}. Which item follows?"
TITLE_TO_SID = "Which item is called {input}?"
SID_TO_TITLE = 'What is the item "{input}" called?'
DESCRIPTION_TO_SID = 'Which item fits this description: "{input}"?'
REASONING_QUESTION = "The user went through items {history} in this order. Explain their taste, then name the next item."
PREFERENCE_QUESTION = "The user went through items {history} in this order and prefers: {preference}. Which item comes next?"
NO_DESCRIPTION = "An item with semantic ID {sid}"


def title_history_to_title(
    samples: DataFrame, key: Sequence[str], category: str, evaluate: bool = False, question: str = TITLES_QUESTION,
) -> DataFrame:
    """Quoted titles to the next quoted title, with a varied instruction."""
    return build_task(samples, Task(
        "title_eval" if evaluate else "title_next", question,
        None if evaluate else quoted_line(F.col("title")), quoted_line(F.col("title")), prompts.history_key("history_title"),
        instruction_variant(category, *key),
        {"category": F.lit(category), "history": prompts.quoted_history("history_title", ",\t")}), key)


def sid_history_to_sid(
    samples: DataFrame, key: Sequence[str], instruction: str | None = None, evaluate: bool = False,
    question: str | None = None,
) -> DataFrame:
    """SIDs to the next SID: plain pair form, with an instruction, or for evaluation."""
    wording = question or (SIDS_EVAL_QUESTION if evaluate else SIDS_QUESTION)
    name = "sid_eval" if evaluate else "sid_next" if instruction is None else "sid_next_instructed"
    return build_task(samples, Task(
        name, wording, None if evaluate else line(F.col("sid")), line(F.col("sid")), prompts.history_key("history_sid"),
        None if instruction is None else F.lit(instruction), {"history": prompts.history_text("history_sid")}), key)


def item_pairs(items: DataFrame, source: str, target: str, seq: Sequence[str], name: str, question: str) -> DataFrame:
    """One prompt per distinct `source` value; its last item by `seq` gives the answer."""
    pairs = last_wins(items, source, seq, [target])
    return build_task(pairs, Task(name, question, line(F.col(target)), line(F.col(target)), F.col(source),
                                  slots={"input": F.col(source)}), [])


def item_identification(items: DataFrame, seq: Sequence[str]) -> DataFrame:
    """SID to title and title to SID for items with a three-level SID (`sid3`)."""
    known = items.filter(F.col("sid3").isNotNull())
    return item_pairs(known, "sid3", "title", seq, "sid_to_title", SID_TO_TITLE).unionByName(
        item_pairs(known, "title", "sid3", seq, "title_to_sid", TITLE_TO_SID))


def item_text_to_sid(items: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Title to SID and description to SID; a listed description stands for its first element."""
    known = items.filter(F.col("sid3").isNotNull()).withColumn("description", prompts.first_description("description"))
    return item_pairs(known, "title", "sid3", seq, "title_to_sid", TITLE_TO_SID).unionByName(
        item_pairs(known, "description", "sid3", seq, "description_to_sid", DESCRIPTION_TO_SID))


def sid_to_title(items: DataFrame, seq: Sequence[str]) -> DataFrame:
    return item_pairs(items.filter(F.col("sid3").isNotNull()), "sid3", "title", seq, "sid_to_title", SID_TO_TITLE)


def title_history_to_sid(
    samples: DataFrame, key: Sequence[str], drop_repeats: bool = True, sample: int | None = None, seed: int = 42
) -> DataFrame:
    """Quoted titles to the next SID; samples that only repeat the last item can be left out."""
    repeat = F.coalesce(F.col("sid") == F.element_at("history_sid", -1), F.lit(False))
    rows = samples.filter(~repeat) if drop_repeats else samples
    rows = rows if sample is None else sample_rows(rows, key, sample, seed)
    return build_task(rows, Task("titles_to_sid", TITLES_SID_QUESTION, line(F.col("sid")), line(F.col("sid")),
                                 prompts.history_key("history_title"),
                                 slots={"history": prompts.quoted_history("history_title")}), key)


def sid_history_to_title(samples: DataFrame, key: Sequence[str], titles: DataFrame, drop_repeats: bool = False) -> DataFrame:
    """SIDs to the next title, looked up by item id; unknown ids get a stand-in. `titles` is (item_id, found_title)."""
    stand_in = F.concat(F.lit("Unknown item "), F.col("item_id").cast("string"))
    rows = samples.join(titles, "item_id", "left").withColumn("__t", F.coalesce("found_title", stand_in))
    if drop_repeats:
        rows = rows.filter(~F.coalesce(F.col("sid") == F.element_at("history_sid", -1), F.lit(False)))
    return build_task(rows, Task("sids_to_title", SIDS_TITLE_QUESTION, line(F.col("__t")), line(F.col("__t")),
                                 prompts.history_key("history_sid"), slots={"history": prompts.history_text("history_sid")}), key)


def sid_history_to_item_text(
    samples: DataFrame, key: Sequence[str], items: DataFrame, seq: Sequence[str], description: bool = False,
) -> DataFrame:
    """SIDs to the title (or description) of the next SID; without one the SID itself (or a sentence) answers.

    `items` is (sid, title, description); the last item of a SID wins, a listed description gives its longest element.
    """
    # the sample table has its own title column, so the looked-up ones are renamed first
    shown = items.withColumn("description", prompts.longest_description("description", "title"))
    texts = last_wins(shown, "sid", seq, ["title", "description"]).select(
        "sid", F.col("title").alias("__title"), prompts.first_description("description").alias("__description"))
    rows = samples.join(texts, "sid", "left")
    answer = F.coalesce("__description", prompts.fill(NO_DESCRIPTION, sid=F.col("sid"))) if description else F.coalesce("__title", "sid")
    return build_task(rows.withColumn("__a", answer), Task(
        "sids_to_description" if description else "sids_to_item_title",
        SIDS_DESCRIPTION_QUESTION if description else SIDS_TITLE_QUESTION, line(F.col("__a")), line(F.col("__a")),
        prompts.history_text("history_sid"), F.lit(SID_INSTRUCTION), {"history": prompts.history_text("history_sid")}), key)


def title_history_to_indexed_sid(samples: DataFrame, key: Sequence[str], sids: DataFrame, drop_repeats: bool = False) -> DataFrame:
    """Quoted titles to the next SID, looked up by item id; an unindexed item answers with its raw id. `sids` is (item_id, found_sid)."""
    rows = samples.join(sids, "item_id", "left").withColumn("__s", F.coalesce("found_sid", F.col("item_id").cast("string")))
    if drop_repeats:
        rows = rows.filter(~F.coalesce(F.col("item_id") == F.element_at("history_item", -1), F.lit(False)))
    return build_task(rows, Task("titles_to_indexed_sid", TITLES_SID_QUESTION, line(F.col("__s")), line(F.col("__s")),
                                 prompts.history_key("history_title"), F.lit(SID_INSTRUCTION),
                                 {"history": prompts.quoted_history("history_title")}), key)


def reasoning_task(rows: DataFrame, key: Sequence[str], in_prompt: bool = False) -> DataFrame:
    """Preference rows (history_sid, target_sid, preference): reasoning asked for, or given in the prompt."""
    usable = rows.filter((F.size("history_sid") > 0) & F.coalesce(F.col("target_sid") != "", F.lit(False)))
    slots = {"history": prompts.history_text("history_sid"), "preference": F.col("preference")}
    if in_prompt:
        return build_task(usable, Task("preference_to_sid", PREFERENCE_QUESTION, line(F.col("target_sid")), line(F.col("target_sid")),
                                       prompts.history_text("history_sid"), F.lit(SID_INSTRUCTION), slots), key)
    answer = F.concat(F.lit("### Reasoning:\n"), "preference", F.lit("\n### Response:\n"), "target_sid")
    return build_task(usable, Task("reasoning_to_sid", REASONING_QUESTION, answer, F.col("target_sid"),
                                   prompts.history_text("history_sid"), F.lit(SID_INSTRUCTION), slots), key)


TASK_COLUMNS = ["task", "prompt", "completion", "history_str", "target"]


def mixture(*tables: DataFrame) -> DataFrame:
    """All tasks under one another on their common columns."""
    out = tables[0].select(*TASK_COLUMNS)
    for t in tables[1:]:
        out = out.unionByName(t.select(*TASK_COLUMNS))
    return out


def with_tokens(rows: DataFrame, encode: Callable[[list[str]], list[list[int]]], max_len: int | None = None) -> DataFrame:
    """Adds `input_ids`, `attention_mask` and `labels` from a caller-supplied batch tokenizer, run on Arrow batches.

    Rows without a completion (evaluation) keep all their prompt tokens and carry no labels.
    """

    @F.pandas_udf("array<int>")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.tolist()))

    filled = rows.withColumn("__p", tokens("prompt")).withColumn("__c", tokens(F.coalesce("completion", F.lit(""))))
    ids, mask, labels = training_tokens("__p", "__c", max_len)
    learns = F.col("completion").isNotNull()
    return filled.select(
        *rows.columns, F.when(learns, ids).otherwise(F.col("__p")).alias("input_ids"),
        F.when(learns, mask).otherwise(F.array_repeat(F.lit(1), F.size("__p"))).alias("attention_mask"),
        F.when(learns, labels).alias("labels"))
