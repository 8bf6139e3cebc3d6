"""Curation decisions applied to frames, published and resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_decisions(decisions: DataFrame, *, token="token", order: str | None = None) -> DataFrame:
    """One whole decision per token: the first by ``order``, then by label, exclusion and note, missing ones last."""
    last = [x for c in ([order] if order else []) + ["label", "excluded", "note"] for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    rest = [c for c in decisions.columns if c not in (token, order, "label", "excluded", "note")]
    one = decisions.groupBy(token).agg(F.min(F.struct(*last, *rest)).alias("one"))
    return one.select(token, *(F.col(f"one.{c}").alias(c) for c in decisions.columns if c != token))


def apply_decisions(data: DataFrame, decisions: DataFrame, *, token="token", tone="tone", order: str | None = None) -> DataFrame:
    """Adds <tone>_relabelled, excluded and note to every frame; one decision per token (see ``first_decisions``); the original tone stays."""
    d = first_decisions(decisions, order=order).select(F.col("token").alias("__token"), F.col("label").alias("__label"), F.coalesce("excluded", F.lit(False)).alias("__excluded"), F.col("note").alias("__note"))
    out = data.join(d, F.col(token).eqNullSafe(F.col("__token")), "left")
    return out.select(*data.columns, F.coalesce("__label", F.col(tone).cast("string")).alias(f"{tone}_relabelled"), F.coalesce("__excluded", F.lit(False)).alias("excluded"), F.col("__note").alias("note"))


def publish(curated: DataFrame, *, tone="tone") -> DataFrame:
    """Kept frames with the new tone in place of the old, which moves to <tone>_original."""
    rows = curated.filter(~F.col("excluded")).withColumnRenamed(tone, f"{tone}_original").withColumnRenamed(f"{tone}_relabelled", tone)
    return rows.drop("excluded")


def curation_state(data: DataFrame, decisions: DataFrame, log: DataFrame | None = None, *, token="token", speaker="speaker", tone="tone") -> DataFrame:
    """One row per curated token: [date,] speaker, original tone, action, new label, excluded, note.

    With a log (token, date) the date of a token's latest entry is added, and the rows stand newest first. A token
    that the data lack has neither speaker nor tone.
    """
    first = data.groupBy(F.col(token).alias("__key")).agg(F.min(speaker).alias("speaker"), F.min(tone).alias("tone"))
    action = F.when(F.col("label").isNotNull() & F.coalesce("excluded", F.lit(False)), "relabel + exclude").when(F.col("label").isNotNull(), "relabel").when(F.coalesce("excluded", F.lit(False)), "exclude").otherwise("note")
    rows = first_decisions(decisions).withColumnRenamed("token", token).join(first, F.col(token) == F.col("__key"), "left")
    state = rows.select(token, "speaker", F.col("tone").alias("original_tone"), action.alias("action"), F.col("label").alias("new_label"), F.coalesce("excluded", F.lit(False)).alias("excluded"), "note")
    if log is None:
        return state
    dates = log.groupBy(F.col("token").alias("__key")).agg(F.max("date").alias("date"))
    dated = state.join(dates, F.col(token) == F.col("__key"), "left").select(F.coalesce("date", F.lit("")).alias("date"), *state.columns)
    return dated.orderBy(F.desc("date"), token)


def curation_totals(data: DataFrame, decisions: DataFrame, *, token="token") -> DataFrame:
    """One row: relabelled, excluded and noted tokens, and all tokens of the data."""
    d = first_decisions(decisions).agg(F.count("label").alias("n_relabelled"), F.count_if("excluded").alias("n_excluded"), F.count("note").alias("n_notes"))
    return d.crossJoin(F.broadcast(data.agg(F.count_distinct(token).alias("n_tokens"))))


def _annotations(annotated: DataFrame, token: str, tone: str) -> DataFrame:
    """token, label, excluded and note of an annotated table, one row per token without blanks around it."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    has = annotated.columns.__contains__
    new = text(f"{tone}_relabelled") if has(f"{tone}_relabelled") else F.lit(None).cast("string")
    old = text(tone) if has(tone) else F.lit(None).cast("string")
    label = F.when((F.length(new) > 0) & ~new.eqNullSafe(old), new)
    excluded = F.coalesce(F.lower(text("excluded")).isin("true", "t"), F.lit(False)) if has("excluded") else F.lit(False)
    note = F.when((F.length(text("note")) > 0) & (text("note") != "NA"), text("note")) if has("note") else F.lit(None).cast("string")
    return first_decisions(annotated.select(text(token).alias("token"), label.alias("label"), excluded.alias("excluded"), note.alias("note")))


def resume(annotated: DataFrame, data: DataFrame | None = None, *, token="token", tone="tone") -> DataFrame:
    """Decisions read back from an annotated table: relabels that differ, exclusions, notes other than ``NA``; with data only those of its tokens."""
    rows = _annotations(annotated, token, tone)
    if data is not None:
        rows = rows.join(data.select(F.trim(F.col(token).cast("string")).alias("token")).distinct(), "token", "left_semi")
    return rows.filter("label is not null or excluded or note is not null").select("token", "label", "excluded", "note")


def resume_counts(annotated: DataFrame, data: DataFrame, *, token="token", tone="tone") -> DataFrame:
    """One row: annotated tokens, those the data have, and the relabels, exclusions and notes among these."""
    present = data.select(F.trim(F.col(token).cast("string")).alias("token")).distinct().withColumn("here", F.lit(True))
    rows = _annotations(annotated, token, tone).join(present, "token", "left")
    here = F.coalesce("here", F.lit(False))
    return rows.agg(F.count("*").alias("n_annotated"), F.count_if(here).alias("n_matched"), F.count_if(here & F.col("label").isNotNull()).alias("n_relabelled"), F.count_if(here & F.col("excluded")).alias("n_excluded"), F.count_if(here & F.col("note").isNotNull()).alias("n_notes"))
