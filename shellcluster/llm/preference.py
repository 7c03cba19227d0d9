"""Preference formatting: chosen and rejected conversations to one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns: the turns of each conversation in order; nulls first, ties by role, then text.

    Rows without an id belong to no conversation and have no part in the result: all of them together
    would be one group without bound. A conversation is as large as its turns.
    """
    packed = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))
    return rows.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id")).agg(F.transform(packed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def _spans(part: str) -> Column:
    """Character spans of the assistant's text and its end mark in the rendered completion: what is trained on."""
    return F.expr(
        f"filter(aggregate({part}, named_struct('at', 0, 's', cast(array() AS array<struct<from:int,to:int,train:boolean>>)),"
        " (acc, x) -> named_struct('at', acc.at + length(coalesce(x.role, '')) + length(coalesce(x.text, '')) + 13,"
        " 's', array_append(acc.s, named_struct('from', acc.at + length(coalesce(x.role, '')) + 5, 'to', acc.at + length(coalesce(x.role, '')) + length(coalesce(x.text, '')) + 12, 'train', coalesce(x.role = 'assistant', false))))).s, x -> x.train)"
    )


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with n_shared, prompt, and for both sides a completion and the spans of it to train on.

    chosen and rejected: arrays of turns (role, text); null counts as no turns, null roles and texts as
    empty when rendered; turns are equal if both fields are, nulls included. n_shared: turns of the
    longest common prefix, which is rendered once as prompt. Equal conversations leave two empty
    completions. One projection without shuffle; columns of these names are replaced.
    """
    a, b = F.coalesce(F.col(chosen).cast(TURN), F.array().cast(TURN)), F.coalesce(F.col(rejected).cast(TURN), F.array().cast(TURN))
    step = pairs.withColumns({"__a": a, "__b": b})
    differs = F.expr("array_position(zip_with(slice(__a, 1, least(size(__a), size(__b))), slice(__b, 1, least(size(__a), size(__b))), (x, y) -> x <=> y), false)")
    step = step.withColumn("__d", differs).withColumn("n_shared", F.when(F.col("__d") > 0, F.col("__d") - 1).otherwise(F.least(F.size("__a"), F.size("__b"))).cast("int"))
    out = step.withColumns({"__p": F.expr("slice(__a, 1, n_shared)"), "__c": F.expr("slice(__a, n_shared + 1, size(__a))"), "__r": F.expr("slice(__b, n_shared + 1, size(__b))")})
    text = lambda c: F.array_join(F.transform(c, _render), "")
    out = out.withColumns({"prompt": text("__p"), "chosen_completion": text("__c"), "rejected_completion": text("__r")})
    plain = lambda c: F.transform(c, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to")))
    out = out.withColumns({"chosen_spans": plain(_spans("__c")), "rejected_spans": plain(_spans("__r"))})
    return out.drop("__a", "__b", "__c", "__d", "__p", "__r")


def against_first_reply(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected from conversations (conv_id, turns).

    chosen: the turns up to the last one of the assistant. rejected: the same, but with the assistant's
    first reply in its place. Conversations without such a turn, or whose two replies agree, give no pair.
    """
    last = F.expr("aggregate(sequence(1, size(turns)), 0, (acc, i) -> if(turns[i - 1].role <=> 'assistant', i, acc))")
    some = conversations.where(F.size("turns") > 0).withColumn("__last", last).where("__last > 0")
    first = F.expr("filter(turns, x -> x.role <=> 'assistant')[0]")
    out = some.select("conv_id", F.expr("slice(turns, 1, __last)").alias("chosen"), F.concat(F.expr("slice(turns, 1, __last - 1)"), F.array(first)).alias("rejected"))
    return out.where(~F.col("chosen").eqNullSafe(F.col("rejected")))
