"""Memory state of a study item as Column expressions: recall, mastery, sanitising, one grade, forgetting score."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, DAY = 60_000, 86_400_000
GRADES, STATUSES = ("strong", "good", "hard", "again"), ("new", "learning", "review", "mastered", "leech")
STATE = "struct<reps:int,interval_min:long,due:long,last_grade:string,updated_at:long,stability:double,difficulty:double,lapses:int,consecutive:int,status:string,last_seen_at:long>"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column) -> Column:
    """Rounding of halves up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def recall(state: Column, now: Column) -> Column:
    """exp(-days since last seen / stability); 0 without a state."""
    days = F.greatest((now - state["last_seen_at"]) / F.lit(float(DAY)), F.lit(0.0))
    return F.when(state.isNull(), 0.0).otherwise(F.exp(-days / F.greatest(state["stability"], F.lit(0.15))))


def is_mastered(state: Column, now: Column) -> Column:
    return F.coalesce((state["status"] == "mastered") & (state["due"] > now), F.lit(False))


def forgetting_score(state: Column, now: Column) -> Column:
    over = F.when(state["due"] <= now, 0.5 + F.least((now - state["due"]) / F.lit(float(DAY)), F.lit(6.0)) * 0.18).otherwise(0.0)
    leech = F.when(state["status"] == "leech", 0.45).otherwise(0.0)
    return F.when(state.isNull(), 0.0).otherwise(1 - recall(state, now) + over + leech + F.least(state["lapses"] * 0.08, F.lit(0.4)))


def sanitize_state(raw: Column, now: Column) -> Column:
    """A state from nullable text fields: defaults, clamps, derived interval and status."""
    num = lambda f, kind="double": raw[f].try_cast("double").cast(kind)
    count = lambda f, default: F.coalesce(F.greatest(F.floor(num(f)), F.lit(0)).cast("int"), default)
    reps = count("reps", F.lit(0))
    due = F.coalesce(num("due", "long"), now)
    interval = F.coalesce(F.greatest(half_up(num("interval_min")), F.lit(0).cast("long")), F.greatest(half_up((due - now) / F.lit(float(MINUTE))), F.lit(0).cast("long")))
    updated = F.coalesce(num("updated_at", "long"), now)
    status = F.when(raw["status"].isin(*STATUSES), raw["status"]).when(reps == 0, "new").when(reps >= 4, "review").otherwise("learning")
    return F.struct(
        reps.alias("reps"),
        interval.alias("interval_min"),
        due.alias("due"),
        F.when(raw["last_grade"].isin(*GRADES), raw["last_grade"]).alias("last_grade"),
        updated.alias("updated_at"),
        clamp(F.coalesce(num("stability"), F.greatest(interval / F.lit(1440.0), F.lit(0.3))), 0.15, 3650.0).alias("stability"),
        clamp(F.coalesce(num("difficulty"), F.lit(5.0)), 1.0, 10.0).alias("difficulty"),
        count("lapses", F.lit(0)).alias("lapses"),
        count("consecutive", reps).alias("consecutive"),
        status.alias("status"),
        F.coalesce(num("last_seen_at", "long"), updated).alias("last_seen_at"),
    ).cast(STATE)


def new_state(at: Column) -> Column:
    zero, none = F.lit(0), F.lit(None).cast("string")
    return F.struct(zero.alias("reps"), zero.cast("long").alias("interval_min"), at.alias("due"), none.alias("last_grade"), at.alias("updated_at"), F.lit(0.3).alias("stability"), F.lit(5.0).alias("difficulty"), zero.alias("lapses"), zero.alias("consecutive"), F.lit("new").alias("status"), at.alias("last_seen_at")).cast(STATE)


def apply_grade(prev: Column, grade: Column, at: Column) -> Column:
    """The state after one grade (strong, good, hard, again); a null ``prev`` is a new item."""
    s = F.coalesce(prev, new_state(at))
    again, strong, hard = grade == "again", grade == "strong", grade == "hard"
    lapses = s["lapses"] + F.when(again, 1).otherwise(0)
    streak = F.when(again, 0).otherwise(s["consecutive"] + 1)
    stable, first = F.greatest(s["stability"], F.lit(0.15)), s["reps"] == 0
    lost = 1 + (1 - recall(s, at)) * 0.35
    boost = 1 + F.least(streak, F.lit(8)) * 0.08
    ease = (11 - s["difficulty"]) / 10
    stability = (
        F.when(again, clamp(s["stability"] * 0.45, 0.15, 3650.0))
        .when(strong, clamp(F.when(first, 1.25).otherwise(stable * (2.05 + ease * 0.95) * lost * (boost + 0.12)), 0.8, 3650.0))
        .when(hard, clamp(stable * F.when(first, 1.4).otherwise(1.18 + ease * 0.22) * lost, 0.25, 3650.0))
        .otherwise(clamp(F.when(first, 0.75).otherwise(stable * (1.65 + ease * 0.75) * lost * boost), 0.4, 3650.0))
    )
    # stability stands in several places below: computed once, in a one-element array
    def rest(st: Column) -> Column:
        minutes = lambda part, least: F.greatest(F.lit(least).cast("long"), half_up(st * part))
        interval = F.when(again, F.when(lapses == 1, 10).when(lapses == 2, 30).otherwise(240).cast("long")).when(strong, minutes(1440.0, 1440)).when(hard, minutes(864.0, 60)).otherwise(minutes(1440.0, 720))
        mastered = (strong & (streak >= 5) & (st >= 35) & (s["lapses"] <= 1)) | ((grade == "good") & (streak >= 6) & (st >= 45) & (s["lapses"] <= 1))
        status = F.when(again, F.when(lapses >= 3, "leech").otherwise("learning")).when(mastered, "mastered").when(st >= 7, "review").otherwise("learning")
        step = F.when(again, 0.7).when(strong, -0.18).when(hard, 0.15).otherwise(-0.1)
        return F.struct(
            F.when(again, 0).otherwise(F.least(s["reps"] + 1, F.lit(100))).alias("reps"),
            interval.alias("interval_min"),
            (at + interval * MINUTE).alias("due"),
            grade.alias("last_grade"),
            at.alias("updated_at"),
            st.alias("stability"),
            clamp(s["difficulty"] + step, 1.0, 10.0).alias("difficulty"),
            lapses.alias("lapses"),
            streak.alias("consecutive"),
            status.alias("status"),
            at.alias("last_seen_at"),
        ).cast(STATE)

    return F.transform(F.array(stability), rest)[0]


def _clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def step(s: dict | None, grade: str, at: int) -> dict:
    """One grade on one item's state; the same transition as ``apply_grade`` has on Columns."""
    s = s or {"reps": 0, "stability": 0.3, "difficulty": 5.0, "lapses": 0, "consecutive": 0, "last_seen_at": at}
    again = grade == "again"
    lapses, streak = s["lapses"] + again, 0 if again else s["consecutive"] + 1
    stable, first = max(s["stability"], 0.15), s["reps"] == 0
    lost = 1 + (1 - math.exp(-max((at - s["last_seen_at"]) / 86_400_000, 0) / stable)) * 0.35
    boost, ease = 1 + min(streak, 8) * 0.08, (11 - s["difficulty"]) / 10
    whole = lambda x: math.floor(x + 0.5)
    if again:
        stability, minutes, change = _clamp(s["stability"] * 0.45, 0.15, 3650), {1: 10, 2: 30}.get(lapses, 240), 0.7
    elif grade == "strong":
        stability, change = _clamp(1.25 if first else stable * (2.05 + ease * 0.95) * lost * (boost + 0.12), 0.8, 3650), -0.18
        minutes = max(1440, whole(stability * 1440))
    elif grade == "hard":
        stability, change = _clamp(stable * (1.4 if first else 1.18 + ease * 0.22) * lost, 0.25, 3650), 0.15
        minutes = max(60, whole(stability * 864))
    else:
        stability, change = _clamp(0.75 if first else stable * (1.65 + ease * 0.75) * lost * boost, 0.4, 3650), -0.1
        minutes = max(720, whole(stability * 1440))
    needs = {"strong": (5, 35), "good": (6, 45)}.get(grade)
    mastered = needs is not None and streak >= needs[0] and stability >= needs[1] and s["lapses"] <= 1
    status = ("leech" if lapses >= 3 else "learning") if again else "mastered" if mastered else "review" if stability >= 7 else "learning"
    return {"reps": 0 if again else min(s["reps"] + 1, 100), "interval_min": minutes, "due": at + minutes * 60_000, "last_grade": grade, "updated_at": at, "stability": stability, "difficulty": _clamp(s["difficulty"] + change, 1, 10), "lapses": lapses, "consecutive": streak, "status": status, "last_seen_at": at}
