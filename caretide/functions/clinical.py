"""Clinical rules as column functions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, labels and words of the rules.
TIERS = (("critical", 80), ("rising", 60), ("watch", 30))
LOWEST_TIER = "stable"
UNCONFIRMED, NEEDS_CONFIRMATION = "미확인", "확인 필요"
MISSING_PENALTY, REVIEW_PENALTY = 5.0, 3.5
#: Every kind of white space, the ideographic and no-break spaces and the byte order mark included.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def known(flag: Column) -> Column:
    """An unknown measurement is not abnormal."""
    return F.coalesce(flag, F.lit(False))


def abnormal(heart_rate: Column, respiratory_rate: Column, systolic_bp: Column, temperature: Column, spo2: Column) -> dict[str, Column]:
    return {
        "hr_abnormal": known((heart_rate > 100) | (heart_rate < 50)),
        "rr_abnormal": known((respiratory_rate > 20) | (respiratory_rate < 10)),
        "bp_abnormal": known((systolic_bp < 100) | (systolic_bp > 160)),
        "bt_abnormal": known(temperature >= 37.5),
        "spo2_abnormal": known(spo2 < 94),
    }


def tier(percent: Column, tiers: tuple[tuple[str, int], ...] = TIERS, lowest: str = LOWEST_TIER) -> Column:
    """The first tier whose threshold is reached; null stays null."""
    out = F.when(percent.isNull(), F.lit(None).cast("string"))
    for name, least in tiers:
        out = out.when(percent >= least, name)
    return out.otherwise(lowest)


def mapped(column: Column, values: dict, default=None) -> Column:
    """A dictionary lookup as a literal map; ``default`` for other keys."""
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[column]
    return found if default is None else F.coalesce(found, F.lit(default))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def field_status(value: Column, unconfirmed: str = UNCONFIRMED, needs: str = NEEDS_CONFIRMATION) -> Column:
    """Missing before review before complete; null is missing."""
    v = trimmed(F.coalesce(value, F.lit("")))
    return F.when(v.isin("", unconfirmed), "missing").when(v.contains(needs), "review").otherwise("complete")


def completeness(missing: Column, review: Column, generated: Column) -> Column:
    score = F.greatest(F.lit(0.0), F.round(F.lit(100.0) - missing * MISSING_PENALTY - review * REVIEW_PENALTY))
    return F.when(generated, score.cast("int")).otherwise(0)


def valid_score(score: Column) -> Column:
    """0 to 1 inclusive; null and NaN are not."""
    return known(score.between(0, 1))


def record_status(certified: Column, generated: Column, stored: Column) -> Column:
    return F.when(known(certified), "certified").when(known(generated), "in progress").otherwise(stored)


def or_blank(value: Column, default: str) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def or_null(value: Column, default: str) -> Column:
    """The default for null alone."""
    return F.coalesce(value, F.lit(default))


def without_sentinel(value: Column, sentinel: str = UNCONFIRMED) -> Column:
    return F.when(value == sentinel, "").otherwise(value)


def hhmm(timestamp: Column) -> Column:
    return F.date_format(timestamp, "HH:mm")


def stamp(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss")


def or_now(timestamp: Column, now: Column) -> Column:
    """A server's default: the moment given, else now, without a zone."""
    return F.coalesce(timestamp, now).cast("timestamp_ntz")


def step_state(step: Column, current: Column) -> Column:
    """How a step of the workflow shows while another is current."""
    return F.when(step < current, "done").when(step == current, "active").otherwise("pending")


def confirmed_at(confirmed: Column, now: Column) -> Column:
    """Set by true; cleared by false and by null."""
    return F.when(known(confirmed), now)
