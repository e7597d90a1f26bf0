"""Topic envelopes: updates put in order, each identity taken once, late sequences dropped, in batches and in streams.

An update is accepted if its dedupe identity is new and its sequence is not below the topic's greatest so far. The identity
counts as seen even if the update then turns out late. Sequences of updates that were dropped as repeats do not count; those of
late updates cannot raise the greatest, so it may be taken over all updates that are not repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomsheet.plans import ordered

ORDER = ("ordering_key", "topic_id", "topic_sequence", "dedupe_identity", "payload_ref")


def accepted(updates: DataFrame) -> DataFrame:
    """The accepted updates of one batch, in full."""
    key = F.struct(*ORDER)
    first = W.partitionBy("dedupe_identity").orderBy(key)
    fresh = updates.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    # a busy topic is cut into blocks along its order, so that it is not one task
    placed = ordered.in_blocks(fresh, "topic_id", *ORDER)
    rows = ordered.scan(placed, ORDER, "__top", F.max, F.col("topic_sequence"), ["topic_id"], before=True)
    return rows.where(F.col("__top").isNull() | (F.col("topic_sequence") >= F.col("__top"))).select(updates.columns)


def current(updates: DataFrame) -> DataFrame:
    """Per topic the last accepted update."""
    key = F.struct(*ORDER)
    rows = accepted(updates)
    best = rows.groupBy("topic_id").agg(F.max_by(F.struct(*rows.columns), key).alias("last"))
    return best.select("last.*")


def seeds(updates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(node): the subscribers, subscriptions(topic_id, node), of the topics that changed."""
    return accepted(updates).select("topic_id").distinct().join(subscriptions, "topic_id").select("node").distinct()


def lifecycle(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, action, was, topic, reason): how subscriptions (node, topic_id), one a node, change from old to new."""
    both = old.select("node", F.col("topic_id").alias("was")).join(new.select("node", F.col("topic_id").alias("topic")), "node", "full_outer")
    action = F.when(F.col("was").isNull(), "Created").when(F.col("topic").isNull(), "Released").when(F.col("was") != F.col("topic"), "Replaced")
    reason = F.when(F.col("was").isNull(), "PreparedRuntimeEffect").when(F.col("topic").isNull(), "FormulaRemoved").otherwise("FormulaTextChanged")
    return both.select("node", action.alias("action"), "was", "topic", reason.alias("reason")).where("action is not null")


# What a provider of real-time data may be set to.
MODES = ("Disabled", "CapabilityDenied", "NoValueYet", "ConnectionFailed", "ProviderError", "Value")


def answers(rows: DataFrame) -> DataFrame:
    """rows(mode, number, error) with v, state, e and pending: a disabled provider denies, its own error becomes the cell's."""
    state = F.when(F.col("mode") == "Disabled", "CapabilityDenied").otherwise(F.col("mode"))
    return rows.withColumns(
        {
            "v": F.when(state == "Value", F.col("number")),
            "state": state,
            "e": F.when(state == "ProviderError", F.col("error")),
            "pending": state == "NoValueYet",
        }
    )


_FIELDS = "topic_id string, topic_sequence long, payload_ref string, ordering_key long, dedupe_identity string"


def accepted_stream(updates: DataFrame, delay: str = "1 day", time: str = "ts") -> DataFrame:
    """Accepted updates of a stream whose micro-batches respect ORDER: identities within the watermark, then state by topic."""
    fresh = updates.withWatermark(time, delay).dropDuplicatesWithinWatermark(["dedupe_identity"])

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(ORDER), kind="stable")
        last = state.get[0] if state.exists else None
        top = rows["topic_sequence"].cummax().shift(1)
        top = top.fillna(last if last is not None else -(1 << 62)).clip(lower=last if last is not None else -(1 << 62))
        state.update((int(max(rows["topic_sequence"].max(), last if last is not None else -(1 << 62))),))
        yield rows[rows["topic_sequence"] >= top][[f.split()[0] for f in _FIELDS.split(", ")]]

    return fresh.groupBy("topic_id").applyInPandasWithState(
        advance, _FIELDS, "top long", "append", GroupStateTimeout.NoTimeout
    )
