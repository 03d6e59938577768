"""Labels of a session as they come: cached matches, and changes of labels given before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched_labels(utterances: DataFrame, session: str, order: str, id_: str, letter: str, match: str) -> DataFrame:
    """``session``, ``order``, ``id_``, ``label``, ``changed_to``.

    Once an utterance of a letter matches a known speaker, that speaker is the letter's label from there on;
    ``changed_to`` is that label for the utterances of the letter that came before. One aggregate and a join
    on (session, letter), whatever the session's length.
    """
    first = (
        utterances.where(F.col(match).isNotNull())
        .groupBy(session, letter)
        .agg(F.min(F.struct(F.col(order).alias("at"), F.col(match).alias("who"))).alias("__m"))
    )
    joined = utterances.join(first, [session, letter], "left")
    known = F.coalesce(F.col(order) >= F.col("__m.at"), F.lit(False))
    return joined.select(
        session, order, id_, F.when(known, F.col("__m.who")).otherwise(F.col(letter)).alias("label"),
        F.when(~known & F.col("__m").isNotNull(), F.col("__m.who")).alias("changed_to"),
    )


def label_changes(labelled: DataFrame, session: str, order: str, id_: str) -> DataFrame:
    """One row for each change: ``session``, ``old_label``, ``new_label``, ``ids`` in order, ``reason``."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, id_))), lambda s: s[id_])
    rows = labelled.where("changed_to is not null")
    return rows.groupBy(session, F.col("label").alias("old_label"), F.col("changed_to").alias("new_label")).agg(ids.alias("ids")).withColumn("reason", F.lit("stored_match"))
