"""Inserts, partial updates and deletes as commands over an append-only log; refusals are rows with a code.

``replayed`` judges commands of all kinds in one log, each by what those before it have left; the other functions judge
commands of one kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretide import schemas
from caretide.functions import clinical
from caretide.operators.cells import block, carried
from caretide.operators.reads import gate, positioned

NOT_FOUND, CONFLICT, INVALID, MALFORMED = 404, 409, 400, 422
LOG_BLOCK = 16  #: bits of a log's number that a cell leaves open: a task orders at most 65,536 commands of a key


def first_code(*checks: tuple[Column, int]) -> Column:
    """The code of the first condition that holds, in the order given; null if none does."""
    out = F.lit(None).cast("int")
    for condition, code in reversed(checks):
        out = F.when(condition, code).otherwise(out)
    return out


def by_own_exchange(rows: DataFrame, key: str, **sums: Column) -> DataFrame:
    """Sums of each key as ``__key`` and the names given, grouped so that a join on the key has an exchange of its own on
    either side: Spark cannot split a key with very many rows in a join that keeps the partitions of an aggregate."""
    summed = rows.groupBy(F.struct(F.col(key).alias("key")).alias("__in")).agg(*[c.alias(n) for n, c in sums.items()])
    return summed.select(F.col("__in.key").alias("__key"), *sums)


def insert_unique(state: DataFrame, batch: DataFrame, key: str, *more: tuple[Column, int], seq: str = "seq") -> DataFrame:
    """Adds ``code``: 422 for a null key, then the codes of further checks in turn, then 409 where the key exists or an earlier
    command that passes all checks has it.  A command that is refused for another reason leaves its key free.

    State and firsts of the batch are summed together before they are shuffled, and joined once; a key that fills a third
    of the batch is split by the join.
    """
    checked = batch.withColumn("__refused", first_code((F.col(key).isNull(), MALFORMED), *more))
    first = checked.where("__refused IS NULL").select(key, F.col(seq).alias("__seq"), F.lit(False).alias("__stored"))
    taken = state.where(F.col(key).isNotNull()).select(key, F.lit(None).cast(first.schema["__seq"].dataType).alias("__seq"), F.lit(True).alias("__stored"))
    known = by_own_exchange(first.unionByName(taken), key, __first=F.min("__seq"), __taken=F.max("__stored"))
    judged = checked.join(known, checked[key] == F.col("__key"), "left")
    conflict = F.col("__taken") | (F.col(seq) > F.col("__first"))
    code = F.coalesce(F.col("__refused"), F.when(conflict, CONFLICT))
    return judged.select(*batch.columns, code.alias("code"))


def insert_child(parents: DataFrame, batch: DataFrame, foreign: str, *more: tuple[Column, int], primary: str = "id") -> DataFrame:
    """Adds ``code``: 404 without a parent, then the codes of further checks in turn."""
    return gate(batch, parents, foreign, primary).withColumn("code", first_code((~F.col("found"), NOT_FOUND), *more)).drop("found")


def constraint_checks(table: str, columns: list[str]) -> list[tuple[Column, int]]:
    """Null in a required column and text over its length, as checks for the columns present."""
    nulls = [(F.col(c).isNull(), MALFORMED) for c in schemas.required(table) if c in columns]
    return nulls + [(F.length(c) > n, MALFORMED) for c, n in schemas.MAX_LENGTH[table].items() if c in columns]


def patch_checks(table: str, columns: list[str], set_fields: str = "set_fields") -> list[tuple[Column, int]]:
    """The same for a patch: only fields that it names are looked at."""
    named = lambda c: F.array_contains(set_fields, c)
    nulls = [(named(c) & F.col(c).isNull(), MALFORMED) for c in schemas.required(table) if c in columns]
    return nulls + [(named(c) & (F.length(c) > n), MALFORMED) for c, n in schemas.MAX_LENGTH[table].items() if c in columns]


def judged_patches(state: DataFrame, log: DataFrame, table: str, columns: list[str], key: str = "id") -> DataFrame:
    """Adds ``code`` to a patch log: 404 for an unknown key, 422 for a patch that would break a constraint, else null."""
    judged = gate(log, state, key, key)
    return judged.withColumn("code", first_code((~F.col("found"), NOT_FOUND), *patch_checks(table, columns))).drop("found")


def confirmations(log: DataFrame, at: str = "at") -> DataFrame:
    """Patches of records with ``confirmed`` turned into a patch of ``confirmed_at``: true sets the command's time, false and
    null clear it, and an absent flag leaves the stored time alone."""
    stamped = log.withColumn("confirmed_at", clinical.confirmed_at(F.col("confirmed"), F.col(at)))
    return stamped.withColumn("set_fields", F.transform("set_fields", lambda f: F.when(f == "confirmed", "confirmed_at").otherwise(f))).drop("confirmed")


def with_ids(state: DataFrame, accepted: DataFrame, seq: str = "seq", cell_rows: int = 1 << 20) -> DataFrame:
    """New ids after the largest one, in the order of the commands."""
    top = state.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = positioned(accepted, F.floor(F.col(seq) / cell_rows), [F.col(seq)], "__place")
    return numbered.withColumn("id", top + F.col("__place")).drop("__place")


def fold(log: DataFrame, fields: list[str], key: str = "id", seq: str = "seq") -> DataFrame:
    """Current state of every key: each field as the last patch that names it in ``set_fields`` left it.

    The value is wrapped, so that "set to null" differs from "never set": ``<field>_set`` tells which.  All aggregates
    combine before the shuffle.
    """
    last = [F.max_by(F.struct(F.col(f).alias("v")), F.when(F.array_contains("set_fields", f), F.col(seq))).alias(f"__{f}") for f in fields]
    named = [F.max(F.array_contains("set_fields", f)).alias(f"{f}_set") for f in fields]
    folded = log.groupBy(key).agg(*last, *named, F.max(seq).alias("last_seq"))
    return folded.select(key, *[F.when(F.col(f"{f}_set"), F.col(f"__{f}.v")).alias(f) for f in fields], *[f"{f}_set" for f in fields], "last_seq")


def patched(state: DataFrame, folded: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The state with folded patches applied; untouched rows stay as they are."""
    changes = folded.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__new_{f}") for f in fields], *[F.col(f"{f}_set").alias(f"__set_{f}") for f in fields])
    joined = state.join(changes, state[key] == F.col("__key"), "left")
    return joined.select(*[F.when(F.col(f"__set_{c}"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in state.columns])


def after_deletes(log: DataFrame, key: str = "id", seq: str = "seq", op: str = "op") -> DataFrame:
    """Adds ``code``: 404 for every command on a key that an earlier command of the log deleted."""
    gone = by_own_exchange(log.where((F.col(op) == "delete") & F.col(key).isNotNull()), key, __gone=F.min(seq))
    judged = log.join(gone, log[key] == F.col("__key"), "left")
    return judged.withColumn("code", F.when(F.col(seq) > F.col("__gone"), NOT_FOUND)).drop("__key", "__gone")


def delete(state: DataFrame, commands: DataFrame, children: DataFrame | None = None, foreign: str | None = None, key: str = "id", seq: str = "seq") -> DataFrame:
    """Adds ``code`` to ``commands(id, seq)``: 404 without a row, 409 while children refer to it, 404 again once an earlier
    command has deleted it, else null."""
    found = state.where(F.col(key).isNotNull()).select(key, F.lit("state").alias("__from"), F.lit(None).cast(commands.schema[seq].dataType).alias("__seq"))
    sides = found.unionByName(commands.where(F.col(key).isNotNull()).select(key, F.lit("batch").alias("__from"), F.col(seq).alias("__seq")))
    if children is not None:
        sides = sides.unionByName(children.where(F.col(foreign).isNotNull()).select(F.col(foreign).alias(key), F.lit("child").alias("__from"), F.lit(None).cast(commands.schema[seq].dataType).alias("__seq")))
    known = by_own_exchange(sides, key, __found=F.bool_or(F.col("__from") == "state"), __held=F.bool_or(F.col("__from") == "child"), __first=F.min("__seq"))
    judged = commands.join(known, commands[key] == F.col("__key"), "left")
    code = first_code((~F.coalesce(F.col("__found"), F.lit(False)), NOT_FOUND), (F.col("__held"), CONFLICT), (F.col(seq) > F.col("__first"), NOT_FOUND))
    return judged.select(*commands.columns, code.alias("code"))


def surviving(state: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    return state.join(deleted.select(key).distinct(), key, "left_anti")


def latest(actions: DataFrame, key: list[str], at: str, values: list[str], id: str = "id") -> DataFrame:
    """The last event of each key, and how many there were; of events of one moment the one with the largest id."""
    last = F.struct(at, id)
    return actions.groupBy(*key).agg(F.max(at).alias(at), *[F.max_by(v, last).alias(v) for v in values], F.count("*").alias("n_actions"))


def replayed(state: DataFrame, log: DataFrame, checks: list[tuple[Column, int]], patches: list[tuple[Column, int]], key: str, seq: str = "seq", op: str = "op", held: Column | None = None, bits: int = LOG_BLOCK) -> DataFrame:
    """Adds ``code`` to a log of ``insert``, ``patch`` and ``delete`` commands on the same keys, judged one after the other.

    An insert that breaks a check of ``checks`` is refused with its code, else with 409 while its key is there.  A patch is
    refused with 404 while it is not, else with the code of a check of ``patches``.  A delete is refused with 404 while the
    key is not there, else with 409 where ``held`` is true.  A null key or another kind of command is 422.

    Whether a key is there only depends on the last command that settles it: a sound insert leaves the key there whether it is
    accepted or refused with 409, and a delete that nothing holds leaves it absent.  So the state machine of a key is a last
    value, which blocks of the log sum up before the shuffle and carry on to the later blocks; a key may fill a third of the
    log.  Numbers of the log are unique within a key.
    """
    kind, held = F.col(op), F.coalesce(held if held is not None else F.lit(False), F.lit(False))
    wrong = first_code(*checks)
    leaves = F.when((kind == "insert") & wrong.isNull(), F.lit(True)).when((kind == "delete") & ~held, F.lit(False))
    there = state.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("value"))
    seen = carried(log, [key], block(seq, bits), [seq], leaves, "__there", initial=there)
    present = F.coalesce(F.col("__there"), F.lit(False))
    known = F.coalesce(kind.isin("insert", "patch", "delete"), F.lit(False)) & F.col(key).isNotNull()
    insert = F.coalesce(wrong, F.when(present, CONFLICT))
    patch = first_code((~present, NOT_FOUND), *patches)
    gone = first_code((~present, NOT_FOUND), (held, CONFLICT))
    code = F.when(~known, MALFORMED).when(kind == "insert", insert).when(kind == "patch", patch).otherwise(gone)
    return seen.withColumn("code", code).drop("__there")


def state_after(state: DataFrame, judged: DataFrame, fields: list[str], key: str, seq: str = "seq", op: str = "op", set_fields: str = "set_fields") -> DataFrame:
    """``(key, *fields)`` after the accepted commands: an insert sets every field, a patch those that it names.

    The last accepted command that writes a field decides it; as an insert writes all, nothing from before a delete comes
    back.  All aggregates combine before the shuffle; the join has one row a key on either side.
    """
    kind, accepted = F.col(op), judged.where(F.col("code").isNull())
    writes = {f: (kind == "insert") | ((kind == "patch") & F.coalesce(F.array_contains(set_fields, f), F.lit(False))) for f in fields}
    last = [F.max_by(F.struct(F.col(f).alias("v")), F.when(w, F.col(seq))).alias(f"__new_{f}") for f, w in writes.items()]
    there = F.max_by(kind == "insert", F.when(kind != "patch", F.col(seq))).alias("__there")
    folded = accepted.groupBy(F.col(key).alias("__key")).agg(*last, there)
    before = state.select(F.col(key).alias("__old_key"), *[F.col(f).alias(f"__old_{f}") for f in fields])
    joined = before.join(folded, F.col("__old_key") == F.col("__key"), "full")
    kept = joined.where(F.coalesce(F.col("__there"), F.col("__old_key").isNotNull()))
    value = lambda f: F.when(F.col(f"__new_{f}").isNotNull(), F.col(f"__new_{f}")["v"]).otherwise(F.col(f"__old_{f}")).alias(f)
    return kept.select(F.coalesce("__key", "__old_key").alias(key), *[value(f) for f in fields])


def refusals(judged: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """For every key how many commands were accepted and refused, and the first refusal."""
    refused = F.col("code").isNotNull()
    return judged.groupBy(key).agg(F.count_if(~refused).alias("n_accepted"), F.count_if(refused).alias("n_refused"), F.min(F.when(refused, F.col(seq))).alias("first_refused"), F.min_by("code", F.when(refused, F.col(seq))).alias("first_code"))
