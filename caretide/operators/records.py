"""Completeness of records and the gates of their workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretide.functions import clinical

STEPS = ("dialogue", "draft", "checked", "coded", "certified")


def statuses(fields: DataFrame, field_names: list[str], optional: tuple[str, ...] = (), seq: str | None = None, unconfirmed: str = clinical.UNCONFIRMED, needs: str = clinical.NEEDS_CONFIRMATION) -> DataFrame:
    """Each record with the status of every field, absent ones included: ``(rec_id, ordinal, field, status, required)``.

    One aggregation brings a record's fields together; the list of fields is a literal, so nothing is joined.  Where a
    field has several values, the one with the largest ``seq`` counts.
    """
    value = F.max_by("value", seq) if seq else F.first("value", ignorenulls=True)
    wide = fields.groupBy("rec_id").pivot("field", field_names).agg(value)
    status = lambda f: clinical.field_status(F.col(f), unconfirmed, needs).alias("status")
    items = [F.struct(F.lit(k).alias("ordinal"), F.lit(f).alias("field"), status(f), F.lit(f not in optional).alias("required")) for k, f in enumerate(field_names)]
    return wide.select("rec_id", F.explode(F.array(*items)).alias("x")).select("rec_id", "x.*")


def summary(status: DataFrame) -> DataFrame:
    """Counts by status, required fields missing, the score, the gate, the list of missing fields and the first one."""
    missing, review = F.col("status") == "missing", F.col("status") == "review"
    needed = missing & F.col("required")
    ordered = F.array_sort(F.collect_list(F.when(needed, F.struct("ordinal", "field"))))
    out = status.groupBy("rec_id").agg(
        F.count_if(missing).alias("n_missing"), F.count_if(review).alias("n_review"), F.count_if(F.col("status") == "complete").alias("n_complete"),
        F.count_if(needed).alias("n_required_missing"), ordered.alias("__missing"),
    )
    names = F.transform("__missing", lambda x: x["field"])
    return out.select(
        "rec_id", "n_missing", "n_review", "n_complete", "n_required_missing",
        clinical.completeness(F.col("n_missing"), F.col("n_review"), F.lit(True)).alias("score"),
        (F.col("n_required_missing") == 0).alias("gate_open"), F.array_join(names, ", ").alias("missing_fields"), F.get(names, F.lit(0)).alias("first_missing"),
    )


def reachable(has_dialogue: Column, has_draft: Column, was_checked: Column, required_missing: Column, code: Column, agreed: Column) -> Column:
    """The furthest of the steps 1 to 5: each gate asks for its own condition and all gates before it."""
    to_2 = has_dialogue & has_draft
    to_3 = to_2 & was_checked & (required_missing == 0)
    to_4 = to_3 & code.isNotNull()
    to_5 = to_4 & clinical.known(agreed)
    return F.when(to_5, 5).when(to_4, 4).when(to_3, 3).when(to_2, 2).otherwise(1)


def may_go(step: Column, target: Column) -> Column:
    """Only back."""
    return target < step


def drafted(turns: DataFrame, cues: dict[str, str], denials: str, doubts: str, exam: tuple[str, ...] = (), unsure: str = clinical.NEEDS_CONFIRMATION) -> DataFrame:
    """A draft from a dialogue, by rule: what is said stands, denied is none, doubtful needs confirming, unasked is absent.

    ``turns(rec_id, turn, role, text)``; ``cues`` has a pattern for each field.  Fields of ``exam`` are taken from
    clinicians alone.  The last turn that speaks of a field decides.
    """
    said = None
    for field, cue in cues.items():
        speaks = F.col("text").rlike(cue) & (F.lit(field not in exam) | (F.col("role") == "clinician"))
        value = F.when(F.col("text").rlike(denials), "none").when(F.col("text").rlike(doubts), unsure).otherwise(F.col("text"))
        item = F.when(speaks, F.struct(F.lit(field).alias("field"), value.alias("value")))
        said = [item] if said is None else [*said, item]
    items = turns.select("rec_id", "turn", F.explode(F.array_compact(F.array(*said))).alias("x"))
    return items.groupBy("rec_id", F.col("x.field").alias("field")).agg(F.max_by(F.col("x.value"), F.col("turn")).alias("value"), F.max("turn").alias("turn"))


def current_values(edits: DataFrame, drafts: DataFrame) -> DataFrame:
    """Field values after edits and regenerated drafts: a draft overwrites every earlier edit.

    ``edits(rec_id, seq, field, value)``, ``drafts(rec_id, seq)``; gives the last edit after the last draft, where any.
    """
    last = drafts.groupBy("rec_id").agg(F.max("seq").alias("__draft"))
    later = edits.join(last, "rec_id", "left").where(F.col("seq") > F.coalesce("__draft", F.lit(-1)))
    return later.groupBy("rec_id", "field").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
