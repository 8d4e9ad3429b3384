"""Structured dates and places out of the free-text heading of a letter.

Everything is a chain of regular expressions over columns. A heading that
admits two readings is quarantined with its reason, never guessed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave import schemas, vocab
from sourceweave.functions import dates
from sourceweave.functions.binding import let
from sourceweave.operators.joins import longest_prefix
from sourceweave.physical import keyed_join, spread
from sourceweave.session import stored

_I = "(?iu)"


def _alt(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + sign, n - value
    return out


_ROMAN_OF = {_roman(n): n for n in range(1, 32)}

MONTH = _alt(vocab.HEADING_MONTHS)
WEEKDAY = _alt(vocab.HEADING_WEEKDAYS)
SEASON = _alt(vocab.HEADING_SEASONS)
PART = r"(?:early|mid-?|late|end)"
YEAR = r"(?:18|19|20)\d\d"
HALF = r"[ap]\.?m\b\.?"
TIME = rf"(?:\d{{1,2}}\.\d{{2}}(?:\s*o'?clock)?(?:\s*{HALF})?|\d{{1,2}}\s+o'?clock(?:\s+{HALF})?)"
ORD = r"(?:st|nd|rd|th)?"
DAY = rf"(?:\d{{1,2}}{ORD}|[IVX]+)(?=\s*,?\s*{MONTH}\b|\s+{YEAR}|\s*\[|\s*$)"
LEAD = r"(?:circa|c\.|week ending|by hand\.?|AD\b|le\b)"
SUFFIX = r"(?:\s+(?:night|evening|morning|afternoon|noon|midnight))?"
_TOKEN = rf"(?:{WEEKDAY}\b{SUFFIX}|{TIME}|{YEAR}(?:\s*[-–/]\s*(?:c\.\s*)?(?:{YEAR}|\d{{1,2}})\b)?\b|{DAY}|{MONTH}\b|{PART}\b|{SEASON}\b|{LEAD})"
PREFIX = rf"{_I}^\s*(?:{_TOKEN}[\s,;.:–—-]*)*"
MARKER = rf"{_I}\b(Postmark of receipt|Postmark|Date of receipt|Received|Rec'd)\b"
AMBIGUOUS = (
    rf"{_I}\bbetween\s+\d|\b\d{{1,2}}{ORD}\s+or\s+\d{{1,2}}{ORD}\s+{MONTH}\b|\b{MONTH}\s+or\s+{MONTH}\b|"
    rf"\b\d{{1,2}}{ORD}\s*[-–]\s*\d{{1,2}}{ORD}\s+{MONTH}\b|\b{YEAR}\s+(?:or|to)\b|\b{MONTH}\s*(?:to\b|[-–—/])\s*{MONTH}\b"
)
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?:[\s,.!:-]|$)"
_NAME = r"\p{L}[\p{L}\p{N}_'’.-]*"
_spaced = lambda words: _alt(words).replace(" ", r"\s+")
SALUTATION = (
    rf"{_BEFORE}(?:{_spaced(vocab.SALUTATION_WORDS)}\s+{_NAME}(?:\s+{_NAME})?|{_spaced(vocab.SALUTATION_FRENCH)}\s+{_NAME}|"
    rf"{_spaced(vocab.SALUTATION_TITLES)}){_AFTER}"
)
NUMBERING = rf"{_I}^\(?\s*(?:letter|postcard)\s*[-–—]?\s*no\.?\s*[ivxlc\d]+\.?\s*\)?$"
#: what an edition prints before the heading of the first paragraph
OPENING = rf"^\s*(?:LETTER\s+NO\.?\s*\d+\s*)?(?i:(?:STRICTLY\s+)?PRIVATE\b\s*)?"
SENDER_LINE = rf"^de la part de M(?:onsieur)?\.?\s+\p{{L}}+$"
SIGLUM = rf"^[MT]S\s+{_NAME}(?:\s+\([^)]*\))?$"
#: remarks inside a heading that say nothing of date or place
ASIDE = rf"{_I}\(\s*(?:postcard\s+no\.?\s*\d+|[\p{{L}} ]+\s+time)\s*\)"


# ------------------------------------------------------------------ small predicates
def salutation_at(c: Column) -> Column:
    """1-based start of the earliest salutation, NULL when there is none."""
    at = F.regexp_instr(c, F.lit(SALUTATION))
    return F.when(at > 0, at)


def is_junk(paragraph: Column) -> Column:
    """A paragraph of the edition: a privacy mark, a manuscript's siglum, a number, or an editor's bracket."""
    t = F.trim(paragraph)
    low = F.lower(t)
    note = F.trim(F.regexp_replace(low, r"^\[|\]$", ""))
    bracket = t.rlike(r"^\[[^\]]*\]$") & F.greatest(*[F.startswith(note, F.lit(n)) for n in vocab.EDITOR_NOTES])
    return F.regexp_replace(low, r"\.$", "").isin(vocab.PRIVACY_LINES) | t.rlike(SIGLUM) | t.rlike(NUMBERING) | t.rlike(SENDER_LINE) | bracket


def looks_like_address(c: Column, most_chars: int = 130, most_words: int = 13) -> Column:
    """A short noun phrase: no verb, no sentence stop unless it belongs to a postal abbreviation."""
    t = F.trim(c)
    tokens = F.split(t, r"\s+")
    verb = F.arrays_overlap(F.transform(tokens, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", "")), F.array(*[F.lit(v) for v in vocab.AUXILIARIES]))
    postal = F.arrays_overlap(F.transform(tokens, lambda w: F.regexp_replace(w, r"[,;:]+$", "")), F.array(*[F.lit(x) for v in vocab.POSTAL_ABBREVIATIONS for x in {v, v.rstrip(".") + "."}]))
    stops = F.exists(tokens, lambda w: w.rlike(r"[.!?:]$"))
    return (t != "") & (F.length(t) <= most_chars) & (F.size(tokens) <= most_words) & (F.coalesce(salutation_at(t), F.lit(0)) != 1) & ~is_junk(t) & ~verb & (~stops | postal)


def act_of_marker(marker: Column) -> Column:
    return F.when(F.lower(marker) == "postmark", "postmarked").otherwise("received")


def is_postmark_place(bracket: Column) -> Column:
    """A postmark bracket naming a place: it holds no digit."""
    return bracket.rlike(r"(?i)^\[\s*Postmark\s+[^\]\d]*\]$")


def fold_apostrophe(c: Column) -> Column:
    return F.translate(c, "’‘", "''")


def canonical_address(c: Column, flourishes: Sequence[str] = tuple(vocab.ADDRESS_FLOURISHES)) -> Column:
    """The address a heading fragment names, without brackets, leading times and privacy notes."""
    s = fold_apostrophe(F.trim(c))
    for rx, to in (
        (r"^\(\s*Postcard No\.?\s*\d+\s*\)", ""),
        (r"(?i)^\d{1,2}[.:]\d{2}\s*(?:o'?clock\s*)?(?:[ap]\.?m\.?)?\s*", ""),
        (r"(?i)^\d{1,2}\s+o'?clock\s+[ap]\.?m\.?\s*", ""),
        (r"^[,;:–—-]+\s*", ""),
        (rf"{_I}\s*{_alt(flourishes)}\.?\s*$", ""),
        (r"^\s*\[(.*)\]\s*$", "$1"), (r"^\s*\?\s*", ""), (r"^\s*I\s+", "1 "), (r"^I6\s+", "16 "), (r"\s+", " "),
    ):
        s = F.regexp_replace(s, rx, to)
    return F.trim(s)


# ------------------------------------------------------------------ one date expression
def _lookup(table: dict, c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _pick(c: Column, rx: str, group: int = 1) -> Column:
    v = F.regexp_extract(c, _I + rx, group)
    return F.when(v != "", v)


def date_fields(c: Column) -> dict[str, Column]:
    """The parts of one date expression, each NULL when the expression does not say."""
    y = _pick(c, rf"({YEAR})").cast("bigint")
    rest = F.regexp_replace(F.regexp_replace(c, _I + TIME, " "), rf"{YEAR}(?:\s*[-–/]\s*(?:c\.\s*)?(?:{YEAR}|\d{{1,2}})\b)?", " ")
    far = _pick(c, rf"{YEAR}\s*[-–/]\s*(?:c\.\s*)?({YEAR})").cast("bigint")
    short = _pick(c, rf"{YEAR}\s*[-–/]\s*(\d{{1,2}})\b(?!\d)")
    short_year = F.when(F.length(short) == 1, F.floor(y / 10) * 10 + short.cast("int")).otherwise(F.floor(y / 100) * 100 + short.cast("int"))
    part2 = _pick(c, rf"{YEAR}\s*[-–]\s*({PART})\s+{YEAR}")
    part2_year = _pick(c, rf"{YEAR}\s*[-–]\s*{PART}\s+({YEAR})").cast("bigint")
    return {
        "y": y,
        "m": _lookup(vocab.HEADING_MONTHS, F.lower(_pick(c, rf"\b({MONTH})\b"))).cast("bigint"),
        "d": F.coalesce(_pick(rest, rf"(?<!\d)(\d{{1,2}}){ORD}(?!\d)").cast("bigint"),
                        _lookup(_ROMAN_OF, F.regexp_extract(rest, rf"(?u)\b([IVX]+)\s+(?i:{MONTH})\b", 1)).cast("bigint")),
        "weekday": _lookup(vocab.HEADING_WEEKDAYS, F.lower(_pick(c, rf"\b({WEEKDAY})\b"))),
        "part": _lookup(vocab.HEADING_PARTS, F.regexp_replace(F.lower(_pick(c, rf"\b({PART})(?=\W|$)")), "-$", "")),
        "season": _lookup(vocab.HEADING_SEASONS, F.lower(_pick(c, rf"\b({SEASON})\b"))),
        "circa": F.when(c.rlike(r"(?i)(?:^|[\s\[?])(?:circa\b|c\.)"), True),
        "uncertain": F.when(c.rlike(r"^\s*\?"), True),
        "bound": F.when(c.rlike(r"(?i)\bweek ending\b"), "not-later-than"),
        "to_y": F.coalesce(far, part2_year, short_year.cast("bigint")),
        "to_part": _lookup(vocab.HEADING_PARTS, F.regexp_replace(F.lower(part2), "-$", "")),
    }


_FIELDS = ["y", "m", "d", "weekday", "part", "season", "circa", "uncertain", "bound", "to_y", "to_part"]


def _date_struct(c: Column) -> Column:
    f = date_fields(c)
    return F.struct(*[f[k].alias(k) for k in _FIELDS])


def is_date_text(c: Column) -> Column:
    """Nothing but date words (a leading question mark or "actually" aside), and at least one."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\?\s*", ""), r"(?i)^actually\s+", "")
    return (s != "") & (F.trim(F.regexp_replace(s, PREFIX, "")) == "")


# ------------------------------------------------------------------ overrides and paragraphs
def apply_overrides(headings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Corrections by file before extraction: first occurrence of ``fix_from``, a heading to prepend, an addressee."""
    o = overrides.select(F.col("file"), "fix_from", "fix_to", "prepend_heading", F.col("addressee").alias("__addressee"))
    df = headings.join(o, "file", "left")
    at = F.instr(F.col("quote"), F.col("fix_from"))
    fixed = F.when(at > 0, F.concat(
        F.substring(F.col("quote"), F.lit(1), at - 1), F.col("fix_to"),
        F.substring(F.col("quote"), at + F.length("fix_from"), F.length("quote")))).otherwise(F.col("quote"))
    text = F.when(F.col("prepend_heading").isNotNull(), F.concat("prepend_heading", F.lit("\n\n"), fixed)).otherwise(fixed)
    return df.withColumn("quote", text).withColumn("addressee", F.coalesce("__addressee", "addressee")).drop(
        "fix_from", "fix_to", "prepend_heading", "__addressee")


def split_heading(headings: DataFrame) -> DataFrame:
    """Adds ``head`` (heading text up to the body, paragraphs joined by a line end) and ``body``.

    Paragraphs of the edition are dropped before the body and nowhere else: the
    body is always the end of the input, word for word. After the first paragraph
    the heading goes on, however long, while a paragraph is a bracket, a date or
    the heading's one bare address, and holds no salutation.
    """
    paras = F.split(F.coalesce("quote", F.lit("")), "\n\n")
    idle = lambda p: (F.trim(p) == "") | is_junk(p)
    lead = F.aggregate("paras", F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, p: let(
        acc["go"] & idle(p), lambda g: F.struct((acc["n"] + g.cast("int")).alias("n"), g.alias("go"))), lambda acc: acc["n"])
    df = headings.withColumn("paras", paras).withColumn("__lead", lead).withColumn("p0", F.regexp_replace(F.coalesce(F.try_element_at("paras", F.col("__lead") + 1), F.lit("")), OPENING, ""))
    df = df.withColumn("__sal", F.coalesce(salutation_at(F.col("p0")), F.lit(0))).withColumn("__plain", F.regexp_replace("p0", ASIDE, " "))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, PREFIX, ""), r"\[[^\]]*\]", ""), PREFIX, ""))
    df = df.withColumn("__rest", bare(F.col("__plain")))
    rest0 = F.col("__rest")
    open_head = (F.col("__sal") == 0) & ((rest0 == "") | looks_like_address(rest0))
    more = F.slice("paras", F.col("__lead") + 2, F.greatest(F.size("paras") - F.col("__lead") - 1, F.lit(0)))

    def step(acc: Column, p: Column) -> Column:
        # 0 the body begins, 1 the heading goes on, 2 it goes on with its address; nothing is tested once the body has begun
        kind = (F.when(~acc["go"], 0).when(idle(p), 1).when(salutation_at(p).isNotNull(), 0).when(F.startswith(F.trim(p), F.lit("[")), 1)
                .when(bare(F.regexp_replace(p, ASIDE, " ")) == "", 1).when(~acc["placed"] & looks_like_address(p), 2).otherwise(0))
        return let(kind, lambda k: F.struct((acc["n"] + (k > 0).cast("int")).alias("n"), (k > 0).alias("go"), (acc["placed"] | (k == 2)).alias("placed")))

    begin = F.struct(F.lit(0).alias("n"), open_head.alias("go"), (rest0 != "").alias("placed"))
    df = df.withColumn("__more", more).withColumn("__n", F.aggregate("__more", begin, step, lambda acc: acc["n"]))
    # neither open nor addressed: what follows the date in the first paragraph is the body itself
    stray = (F.col("__sal") == 0) & ~open_head
    dated = F.regexp_extract("p0", PREFIX + rf"(?:\[[^\]]*\][\s,;.:–—-]*(?:{_TOKEN}[\s,;.:–—-]*)*)*", 0)
    cut = F.when(F.col("__sal") > 0, F.col("__sal") - 1).when(stray & (dated != ""), F.length(dated)).otherwise(F.length("p0"))
    df = df.withColumn("__cut", cut)
    head0 = F.regexp_replace(F.substring(F.col("p0"), F.lit(1), F.col("__cut")), ASIDE, " ")
    tail0 = F.substring(F.col("p0"), F.col("__cut") + 1, F.length("p0"))
    told = F.filter(F.slice("__more", F.lit(1), F.col("__n")), lambda p: ~idle(p))
    left = F.slice("__more", F.col("__n") + 1, F.greatest(F.size("__more") - F.col("__n"), F.lit(0)))
    # a generator, so that whatever reads head and body reads values and not the expressions behind them
    return df.select(*headings.columns, F.inline(F.array(F.struct(
        F.array_join(F.concat(F.array(F.trim(head0)), F.transform(told, lambda p: F.regexp_replace(p, ASIDE, " "))), "\n").alias("head"),
        F.array_join(F.concat(F.when(F.trim(tail0) != "", F.array(F.ltrim(tail0))).otherwise(F.array().cast("array<string>")), left), "\n\n").alias("body")))))


# ------------------------------------------------------------------ acts of a heading
def heading_acts(split: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``written``, ``postmarked``, ``received`` (act structs), ``place_texts`` and ``flag``.

    ``aliases`` (address, place_id) tells an address that opens a heading from a day number.
    """
    df = longest_prefix(split.withColumn("__first", fold_apostrophe(F.substring_index("head", "\n", 1))), "__first",
                        aliases.select(fold_apostrophe(F.col("address")).alias("address")))
    opens = F.col("address").isNotNull()
    lead_place = F.when(opens, F.substring(F.col("head"), F.lit(1), F.length("address")))
    text = F.when(opens, F.trim(F.substring(F.col("head"), F.length("address") + 1, F.length("head")))).otherwise(F.col("head"))
    df = df.withColumn("__lead", lead_place).withColumn("__text", text)

    prefix = F.regexp_extract("__text", PREFIX, 0)
    after = F.substring(F.col("__text"), F.length(prefix) + 1, F.length("__text"))
    brackets = F.regexp_extract_all("__text", F.lit(r"(\[[^\]]*\])"), F.lit(1))
    inner = lambda b: F.regexp_replace(F.regexp_replace(b, r"^\[\s*", ""), r"\s*\]$", "")
    df = df.withColumn("__prefix", prefix).withColumn("__after", after).withColumn("__brackets", brackets)

    # each bracket is classed once: 'a' names an act, 's' is a postmark's place, 'n' a bare day (a date only when the month
    # follows its bracket), 'd' a date, 'p' a place; transform() binds the classes for all their uses
    classed = F.transform("__brackets", lambda b: F.struct(b.alias("text"), inner(b).alias("inner"), F.when(
        is_postmark_place(b), "s").when(b.rlike(MARKER), "a").when(inner(b).rlike(rf"^\??\s*\d{{1,2}}{ORD}$"), "n").when(is_date_text(inner(b)), "d").otherwise("p").alias("kind")))
    of = lambda k: F.filter("__classed", lambda x: x["kind"] == k)
    df = df.withColumn("__classed", classed)
    sets = F.struct(*[F.transform(of(k), lambda x: x["text"]).alias(k) for k in "asndp"])
    df = df.withColumn("__b", F.transform(F.array(sets), lambda x: x))
    marked, stamped, bare_day, plain, named = (F.col("__b")[0][k] for k in "asndp")
    day_then_month = F.col("__text").rlike(rf"{_I}\[\s*\??\s*\d{{1,2}}{ORD}\s*\]\s*{MONTH}\b")
    lone_day = F.when(day_then_month, F.try_element_at(bare_day, F.lit(1)))
    follow = F.when(day_then_month, F.regexp_extract("__text", rf"{_I}\]\s*({MONTH}\b[\s,]*(?:{YEAR})?)", 1))
    year_after = F.regexp_extract("__text", rf"\]\s*({YEAR})\b", 1)
    mark, mark2 = F.try_element_at(marked, F.lit(1)), F.try_element_at(marked, F.lit(2))
    mark2_text = F.coalesce(inner(mark2), F.lit(""))
    mark_text = F.coalesce(inner(mark), F.lit(""))
    unbracketed = F.regexp_extract("__text", rf"{MARKER}", 1)
    loose = (unbracketed != "") & mark.isNull() & (F.size(stamped) == 0)
    loose_text = F.when(loose, F.regexp_extract(F.regexp_replace("__text", rf"^.*?{MARKER}\s*", ""), PREFIX, 0))
    # transform() keeps the optimizer from copying these expressions into every use below
    pieces = F.transform(F.array(
        F.col("__prefix"),
        F.coalesce(inner(F.try_element_at(plain, F.lit(1))), F.lit("")),
        F.coalesce(inner(lone_day), F.lit("")), F.coalesce(follow, F.lit("")), year_after,
        F.regexp_replace(mark_text, rf"{MARKER}.*$", ""),
        F.coalesce(F.when(loose, loose_text), F.regexp_replace(mark_text, rf"^.*?{MARKER}", "")),
        F.when(loose, unbracketed).otherwise(F.regexp_extract(mark_text, MARKER, 1)),
        F.regexp_replace(mark2_text, rf"^.*?{MARKER}", ""), F.regexp_extract(mark2_text, MARKER, 1),
    ), lambda x: F.trim(x))
    df = df.withColumn("__p", pieces)
    p = {k: F.col("__p")[i] for i, k in enumerate(("outer", "plain", "day", "follow", "year_after", "before", "after", "marker", "after2", "marker2"))}
    expressions = F.array(p["outer"], p["plain"], F.concat_ws(" ", p["day"], p["follow"]), p["before"], p["after"], p["after2"])
    # an empty expression has no parts; most headings have one expression or two
    df = df.withColumn("__dates", F.transform(expressions, lambda x: F.when(F.trim(x) != "", _date_struct(x))))
    o, b, d1, w, a, a2 = (F.col("__dates")[i] for i in range(6))
    has_bracket = (p["plain"] != "") | (p["day"] != "")
    second = lambda k: F.coalesce(b[k], d1[k], w[k])
    year_own = F.coalesce(o["y"], second("y"), F.when(has_bracket & (p["year_after"] != "") & o["y"].isNull(), p["year_after"].try_cast("bigint")))
    marks_post = p["marker"] != ""
    year = F.coalesce(year_own, F.when(marks_post, a["y"]))
    from_bracket = has_bracket & ((o["y"].isNull() & (b["y"].isNotNull() | d1["y"].isNotNull())) | (p["outer"] == "") | o["y"].isNull())
    inherited = year_own.isNull() & year.isNotNull()
    said = F.greatest(*[F.coalesce(o[k], second(k)).isNotNull().cast("int") for k in ("y", "m", "d", "weekday", "season")]) == 1
    null = F.lit(None)
    clock_text = F.regexp_extract("__text", _I + "(" + TIME + ")", 1)
    range_end = F.coalesce(o["to_y"], second("to_y"))
    written_date = F.struct(
        F.when(said, year).alias("y"), F.coalesce(o["m"], second("m")).alias("m"), F.coalesce(o["d"], second("d")).alias("d"),
        F.when(clock_text != "", dates.clock_time(clock_text)).alias("t"),
        F.coalesce(o["weekday"], second("weekday")).alias("weekday"), F.coalesce(o["part"], second("part")).alias("part"),
        F.coalesce(o["season"], second("season")).alias("season"), F.coalesce(o["circa"], second("circa")).alias("circa"),
        F.coalesce(o["uncertain"], second("uncertain")).alias("uncertain"),
        F.when(from_bracket | inherited, True).alias("inferred"), F.coalesce(o["bound"], second("bound")).alias("bound"),
        null.cast("string").alias("certainty"),
        F.when(range_end.isNotNull(), F.struct(
            range_end.alias("y"), null.cast("bigint").alias("m"), null.cast("bigint").alias("d"),
            F.coalesce(o["to_part"], second("to_part")).alias("part"), null.cast("string").alias("season"), null.cast("boolean").alias("circa"))).alias("to"),
    ).cast(schemas.PARTIAL_DATE)
    def act_date(x: Column) -> Column:
        return F.struct(
            F.coalesce(x["y"], year_own, a["y"]).alias("y"), x["m"].alias("m"), x["d"].alias("d"), null.cast("string").alias("t"),
            x["weekday"].alias("weekday"), x["part"].alias("part"), x["season"].alias("season"), x["circa"].alias("circa"),
            x["uncertain"].alias("uncertain"), F.lit(True).alias("inferred"), x["bound"].alias("bound"), null.cast("string").alias("certainty"),
            null.cast(schemas.RANGE_END).alias("to"),
        ).cast(schemas.PARTIAL_DATE)

    tells = lambda x: F.coalesce(x["y"], x["m"], x["d"]).isNotNull() | x["weekday"].isNotNull()
    post_said, post2_said = marks_post & tells(a), (p["marker2"] != "") & tells(a2)

    # what is neither date nor date bracket is a place
    places = F.array_compact(F.concat(
        F.array(F.col("__lead")),
        F.transform(F.split(F.regexp_replace(F.regexp_replace("__after", r"\[[^\]]*\]", "\n"), rf"{MARKER}.*$", ""), "\n"),
                    lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), PREFIX, ""), r"^[\s,;.:–—-]+|[\s,;:–—-]+$", "")),
        named))
    places = F.filter(places, lambda x: x != "")
    bad_bracket = F.contains(F.regexp_replace("__text", r"\[[^\]]*\]", ""), F.lit("["))
    act = lambda date, cond, time: F.when(cond, F.struct(date.alias("date"), null.cast("string").alias("place"), time.alias("time")))
    no_time = null.cast("string")
    kind, kind2 = act_of_marker(p["marker"]), F.when(p["marker2"] != "", act_of_marker(p["marker2"]))

    def marked_act(which: str) -> Column:
        return F.coalesce(act(act_date(a), post_said & (kind == which), no_time), act(act_date(a2), post2_said & (kind2 == which), no_time))

    # both readings given and not the same: which one holds is not for us to say
    apart = F.greatest(*[F.coalesce(o[k] != second(k), F.lit(False)) for k in ("y", "m", "d", "weekday")])
    flag = (
        F.when(F.col("head") == "", "no heading")
        .when(F.split_part("__text", F.lit("\n"), F.lit(1)).rlike(AMBIGUOUS), "ambiguous range or alternative")
        .when(bad_bracket, "unclosed bracket")
        .when(mark_text.rlike(rf"{MARKER}.*{MARKER}") | mark2_text.rlike(rf"{MARKER}.*{MARKER}"), "several act markers in one bracket")
        .when((F.size(marked) > 2) | (kind == kind2) | (F.size(stamped) > 1), "several brackets of one act")
        .when((F.size(plain) + F.size(bare_day) > 1), "several date brackets")
        .when(F.coalesce(apart, F.lit(False)), "a date and a bracket that differ")
        .when(((p["marker"] != "") & (F.size(stamped) == 0) & ~post_said) | ((p["marker2"] != "") & ~post2_said), "empty or unreadable postmark")
        .when(~said & ~post_said, "heading date unreadable")
    )
    # a generator, so that whatever reads these columns reads values and not the expressions behind them
    return df.select(*split.columns, F.inline(F.array(F.struct(
        act(written_date, said, F.when(clock_text != "", clock_text)).alias("written"),
        marked_act("postmarked").alias("postmarked"),
        marked_act("received").alias("received"),
        places.alias("place_texts"),
        F.regexp_extract(F.coalesce(F.try_element_at(stamped, F.lit(1)), F.lit("")), r"(?i)Postmark\s+([^\]]*?)\s*\]", 1).alias("postmark_place_text"),
        flag.alias("flag")))))


def resolve_addresses(texts: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """Place id of an address: as printed, else with plain apostrophes, else in canonical form."""
    df = texts
    tries = [F.col(column), fold_apostrophe(F.col(column)), canonical_address(F.col(column))]
    keys = [F.col("address"), fold_apostrophe(F.col("address")), fold_apostrophe(F.col("address"))]
    for i, (t, k) in enumerate(zip(tries, keys)):
        dim = aliases.groupBy(k.alias(f"__k{i}")).agg(F.min("place_id").alias(f"__v{i}"))
        open_ = F.coalesce(*[F.col(f"__v{j}") for j in range(i)]).isNull() if i else F.lit(True)  # a form is made only where those before it failed
        df = keyed_join(df.withColumn(f"__k{i}", F.when(open_, t)), dim, [f"__k{i}"], "left").drop(f"__k{i}")
    return df.withColumn(out, F.coalesce("__v0", "__v1", "__v2")).drop("__v0", "__v1", "__v2")


def extract(headings: DataFrame, aliases: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, unmapped): one row per file with status parsed, flagged or skipped, and place texts nothing maps.

    A record that already has a date, or ``already_dated``, is skipped.
    """
    dated = F.col("already_dated") if "already_dated" in headings.columns else F.lit(False)
    todo = spread(headings.where(~dated))
    if overrides is not None:
        todo = apply_overrides(todo, overrides)
    # headings are split once: the search for a known address reads them beside the acts
    acts = heading_acts(stored(split_heading(todo), "headings"), aliases)
    # the place texts of a heading ride along with its acts: one pass, one grouping by file;
    # a heading already flagged is left alone
    tagged = F.concat(
        F.transform("place_texts", lambda x, i: F.struct(F.lit("written").alias("act"), i.alias("pos"), x.alias("place_text"))),
        F.when(F.col("postmark_place_text") != "", F.array(F.struct(
            F.lit("postmarked").alias("act"), F.lit(0).alias("pos"), F.col("postmark_place_text").alias("place_text"))))
        .otherwise(F.array().cast("array<struct<act:string,pos:int,place_text:string>>")))
    keep = [c for c in headings.columns if c != "quote"]
    carried = F.struct(*[c for c in keep if c != "file"], "written", "postmarked", "received", "body", "flag")
    texts = acts.select("file", carried.alias("__c"), F.inline_outer(F.when(F.col("flag").isNull(), tagged)))
    mapped = resolve_addresses(texts, "place_text", aliases, "place_id")
    of = lambda act: F.min_by("place_id", F.when(F.col("act") == act, F.col("pos")))
    done = mapped.groupBy("file").agg(
        F.any_value("__c").alias("c"), of("written").alias("written_place"), of("postmarked").alias("postmarked_place"),
        F.bool_or((F.col("act") == "written") & F.col("place_id").isNull()).alias("unmapped"))
    reason = F.coalesce(F.col("c.flag"), F.when(F.coalesce("unmapped", F.lit(False)), "unmapped place"))
    done = done.select(
        *[F.col("file") if c == "file" else F.col(f"c.{c}").alias(c) for c in keep],
        F.when(reason.isNull(), "parsed").otherwise("flagged").alias("status"), reason.alias("reason"),
        "c.written", "c.postmarked", "c.received", "written_place", "postmarked_place", "c.body")
    skipped = headings.where(dated).select(
        *keep, F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("reason"),
        *[F.lit(None).cast(schemas.ACT).alias(x) for x in ("written", "postmarked", "received")],
        F.lit(None).cast("string").alias("written_place"), F.lit(None).cast("string").alias("postmarked_place"), F.col("quote").alias("body"))
    return done.unionByName(skipped), mapped.where(F.col("place_text").isNotNull() & F.col("place_id").isNull()).select("file", "place_text")


def first_of_each_act(acts: DataFrame, keys: list[str]) -> DataFrame:
    """Acts of one letter merged: rows (keys, act, pos, date fields...) to the first value of each field."""
    fields = [c for c in acts.columns if c not in (*keys, "act", "pos")]
    return acts.groupBy(*keys, "act").agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f) for f in fields])
