"""Partial dates: labels, sort keys and checks as Column expressions.

There are three orderings on purpose. The range check and the source order
fill missing parts with zero; the timeline puts them mid-year and mid-month.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceweave import vocab
from sourceweave.functions.binding import let



def _month(m: Column) -> Column:
    names = F.array(*[F.lit(x) for x in vocab.MONTHS])
    return F.when(m.between(1, 12), F.element_at(names, m.cast("int")))


def _s(c: Column) -> Column:
    return c.cast("string")


def _given(c: Column) -> Column:
    """Present and not zero/empty, the way a date part counts as given."""
    return c.isNotNull() & (c != 0)


def timeline_key(d: Column) -> Column:
    """Year plus fractions; a missing month counts as mid-year, a missing day as mid-month."""
    return F.when(
        d["y"].isNotNull(),
        d["y"] + (F.coalesce(d["m"].cast("double"), F.lit(6.5)) - 1) / 12
        + F.coalesce(d["d"].cast("double"), F.lit(15.0)) / 372,
    )


def source_order(d: Column, hint: Column) -> list[Column]:
    """Reading order of sources: dated first by (y, m, d) with zero for gaps, then the undated."""
    use_hint = d.isNull()
    y, m, dd = (F.when(use_hint, hint[p]).otherwise(d[p]) for p in ("y", "m", "d"))
    y = F.when(y != 0, y)
    return [
        y.isNull(), F.coalesce(y, F.lit(0)),
        F.when(y.isNotNull(), F.coalesce(m, F.lit(0))).otherwise(0),
        F.when(y.isNotNull(), F.coalesce(dd, F.lit(0))).otherwise(0),
    ]


def range_key(d: Column) -> Column:
    z = lambda p: F.coalesce(d[p], F.lit(0)).cast("bigint")
    return F.struct(z("y").alias("y"), z("m").alias("m"), z("d").alias("d"))


def _one(d: Column, with_year: bool) -> Column:
    y = F.concat(F.lit(" "), _s(d["y"])) if with_year else F.lit("")
    part = F.when(F.coalesce(d["part"], F.lit("")) != "", F.concat(d["part"], F.lit(" "))).otherwise("")
    bare = F.concat(part, _s(d["y"])) if with_year else F.lit("")
    return (
        F.when(F.coalesce(d["season"], F.lit("")) != "", F.concat(d["season"], y))
        .when(_given(d["d"]) & _given(d["m"]), F.concat(_s(d["d"]), F.lit(" "), _month(d["m"]), y))
        .when(_given(d["m"]), F.concat(part, _month(d["m"]), y))
        .otherwise(bare)
    )


def _same_day(a: Column, b: Column) -> Column:
    return a["y"].eqNullSafe(b["y"]) & a["m"].eqNullSafe(b["m"]) & a["d"].eqNullSafe(b["d"])


def _or(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)


def date_label(d: Column) -> Column:
    """"c. 3–5 May 1897", "by 1879", "March – June 1891", "date unknown"."""
    t = d["to"]
    bound = (
        F.when(d["bound"] == "not-later-than", "by ")
        .when(F.coalesce(d["bound"], F.lit("")) != "", "at least ").otherwise("")
    )
    lead = F.concat(bound, F.when(d["circa"], "c. ").otherwise(""))
    ranged = t["y"].isNotNull() & ~_same_day(d, t)
    same_year = t["y"] == d["y"]
    days = _given(d["m"]) & t["m"].eqNullSafe(d["m"]) & _given(d["d"]) & _given(t["d"])
    months = _given(d["m"]) & _given(t["m"]) & ~_given(d["d"]) & ~_given(t["d"])
    label = (
        F.when(ranged & same_year & days,
               F.concat(_s(d["d"]), F.lit("–"), _s(t["d"]), F.lit(" "), _month(d["m"]), F.lit(" "), _s(d["y"])))
        .when(ranged & same_year & months, F.concat(_month(d["m"]), F.lit("–"), _month(t["m"]), F.lit(" "), _s(d["y"])))
        .when(ranged & same_year,
              F.concat(let(_one(d, False), lambda x: _or(x, _s(d["y"]))), F.lit(" – "),
                        let(_one(t, False), lambda x: _or(x, _s(t["y"]))), F.lit(" "), _s(d["y"])))
        .when(ranged, F.concat(_one(d, True), F.lit(" – "), _one(t, True)))
        .otherwise(let(_one(d, True), lambda x: _or(x, _s(d["y"]))))
    )
    return F.when(d["y"].isNull(), "date unknown").otherwise(F.concat(lead, label))


def _letter_part(d: Column, with_year: bool) -> Column:
    y = F.when(d["y"].isNotNull(), F.concat(F.lit(" "), _s(d["y"]))).otherwise("") if with_year else F.lit("")
    part = F.coalesce(d["part"], F.lit(""))
    year = F.when(d["y"].isNull(), "").when(part != "", F.concat(part, F.lit(" "), _s(d["y"]))).otherwise(_s(d["y"]))
    day = F.when(_given(d["d"]), F.concat(_s(d["d"]), F.lit(" "))).when(part != "", F.concat(part, F.lit(" "))).otherwise("")
    return (
        F.when(F.coalesce(d["season"], F.lit("")) != "",
               F.concat(d["season"], F.lit(" "), F.coalesce(_s(d["y"]), F.lit(""))) if with_year else d["season"])
        .when(~_given(d["m"]), year if with_year else F.lit(""))
        .otherwise(F.concat(day, _month(d["m"]), y))
    )


def dating_label(d: Column) -> Column:
    """The dating of one act of a letter: "Monday circa 3 May 1897 (?)"."""
    t = d["to"]
    ranged = t.isNotNull() & ~_same_day(d, t)
    y1, y2 = F.coalesce(_s(d["y"]), F.lit("")), F.coalesce(_s(t["y"]), F.lit(""))
    same_year = t["y"].eqNullSafe(d["y"])
    near = let(_letter_part(d, False), lambda p: _or(p, y1))
    whole = let(_letter_part(d, True), lambda p: F.when(ranged, _or(p, y1)).otherwise(p))
    far = let(_letter_part(t, True), lambda p: F.when(ranged, F.concat(F.lit("–"), _or(p, y2))).otherwise(""))
    core = F.concat(F.when(ranged & same_year, near).otherwise(whole), far)
    weekday = F.coalesce(d["weekday"], F.lit(""))
    day = F.when(weekday != "", F.initcap(weekday)).otherwise("")
    bound = F.when(d["bound"] == "not-later-than", "by ").when(d["bound"] == "not-earlier-than", "at least ").otherwise("")
    circa = F.when(d["circa"], "circa ").otherwise("")
    dated = let(core, lambda c: F.concat(bound, circa, F.when((c == "") & (weekday == ""), "date unknown").otherwise(c)))
    text = let(dated, lambda x: F.concat(day, F.when((day != "") & (x != ""), " ").otherwise(""), x))
    return F.when(d.isNull(), "").otherwise(F.concat(text, F.when(d["uncertain"], " (?)").otherwise("")))


def letter_dating(acts: dict[str, Column]) -> Column:
    """All dated acts of a letter in one line, in the order a letter goes through them."""
    bits = []
    for name in vocab.ACTS:
        if name in acts:
            act = acts[name]
            clock = F.when(F.coalesce(act["time"], F.lit("")) != "", F.concat(F.lit(" at "), act["time"])).otherwise("")
            label = F.concat(F.trim(F.concat(F.lit(name + " "), dating_label(act["date"]))), clock)
            bits.append(F.when(act["date"].isNotNull(), label))
    return F.concat_ws(" · ", *bits)


def relationship_label(date_label_text: Column, start: Column, end: Column) -> Column:
    ends = F.named_struct(F.lit("a"), date_label(start), F.lit("b"), date_label(end))
    made = let(ends, lambda e: F.when(end["y"].isNull() | (e["a"] == e["b"]), e["a"]).otherwise(F.concat(e["a"], F.lit(" – "), e["b"])))
    return F.when(F.coalesce(date_label_text, F.lit("")) != "", date_label_text).otherwise(made)


def lifespan(born: Column, died: Column) -> Column:
    y = lambda d: F.coalesce(_s(d["y"]), F.lit("?"))
    return F.concat(y(born), F.lit("–"), y(died))


def when_label(d: Column, hint: Column) -> Column:
    """The date a source shows; "undated" when only an order hint places it."""
    return F.when(d["y"].isNotNull(), date_label(d)).when(_given(hint["y"]), "undated").otherwise("")


def calendar_weekday(d: Column) -> Column:
    """Day name of a complete date; NULL when a part is missing or the day does not exist."""
    text = F.format_string("%04d-%02d-%02d", d["y"], d["m"], d["d"])
    names = F.array(*[F.lit(w) for w in vocab.WEEKDAYS])
    day = text.try_cast("date")
    ok = d["y"].isNotNull() & d["m"].isNotNull() & d["d"].isNotNull()
    return F.when(ok & day.isNotNull(), F.element_at(names, F.weekday(day) + 1))


def clock_time(c: Column) -> Column:
    """A printed clock time ("3.50 p.m.", "8 o'clock am") as "HH:MM"; NULL when it gives no half of the day."""
    rx = r"(?i)(?:^|[\s,(])(\d{1,2})(?:\s*[.]\s*(\d{2}))?\s*(?:o'?clock)?\s*([ap])\.?m\b"
    has = c.rlike(r"(?i)(?:^|[\s,(])\d{1,2}(?:[.]\d{2}|\s+o'?clock)(?:\s+o'?clock)?\s*[ap]\.?m\b")
    hour = F.regexp_extract(c, rx, 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(c, rx, 2).try_cast("int"), F.lit(0))
    pm = F.lower(F.regexp_extract(c, rx, 3)) == "p"
    h24 = F.when(pm & (hour < 12), hour + 12).when(~pm & (hour == 12), 0).otherwise(hour)
    return F.when(has & (hour <= 12) & (minute <= 59), F.format_string("%02d:%02d", h24, minute))


def place_label(p: Column) -> Column:
    """Venue, street, city, region; the country only when nothing else is known."""
    parts = F.concat_ws(", ", *[F.when(p[x] != "", p[x]) for x in ("venue", "street", "city", "region")])
    return F.when(parts != "", parts).otherwise(F.coalesce(p["country"], F.lit("")))
