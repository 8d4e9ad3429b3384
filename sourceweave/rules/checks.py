"""The data-quality rules of every entity.

Columns called ``raw`` hold a record as JSON text; rules about unknown keys and
about absent against null need them and are left out where ``raw`` is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave import vocab
from sourceweave.functions import dates, records, text
from sourceweave.operators import citations, coverage, dedup, joins
from sourceweave.operators import aggregates as agg
from sourceweave.physical import keyed_join
from sourceweave.rules.registry import FINDING, Rule, as_findings, evaluate, findings, union



def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _in(c: Column, words: list[str]) -> Column:
    return _false(c.isin(words))


def _has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _json(raw: Column | None, path: str) -> Column:
    return F.get_json_object(raw, path) if raw is not None else F.lit(None).cast("string")


def _is_object(raw: Column) -> Column:
    return raw.isNull() | F.startswith(F.ltrim(raw), F.lit("{"))


# ------------------------------------------------------------------ dates and acts
def date_rules(d: Column, raw: Column | None = None) -> list[Rule]:
    """One partial date. ``raw`` is its JSON text."""
    t = d["to"]
    weekday = d["weekday"]
    rules = [
        Rule("T1", t["y"].isNotNull() & (dates.range_key(t) < dates.range_key(d)), "date range ends before it starts"),
        Rule("T1", t["y"].isNotNull() & d["y"].isNull(), "a date range needs a start year"),
        Rule("T3", d["bound"].isNotNull() & ~_in(d["bound"], vocab.DATE_BOUNDS), "unknown bound"),
        Rule("T3", d["part"].isNotNull() & ~_in(d["part"], vocab.DATE_PARTS), "unknown part"),
        Rule("T3", d["season"].isNotNull() & ~_in(d["season"], vocab.SEASONS), "unknown season"),
        Rule("T3", weekday.isNotNull() & ~_in(weekday, vocab.WEEKDAYS), "unknown weekday"),
        Rule("T4", _in(weekday, vocab.WEEKDAYS) & _false(dates.calendar_weekday(d) != weekday), "weekday contradicts the calendar"),
        Rule("T5", d["t"].isNotNull() & ~_false(d["t"].rlike(vocab.CLOCK)), "time is not HH:MM"),
        *[Rule("T6", _false(~d[f]), f"{f} is true or absent") for f in ("circa", "uncertain", "inferred")],
        Rule("T7", _false((d["y"] <= 1700) | (d["y"] >= 2000)), "implausible year"),
    ]
    if raw is not None:
        keys = F.coalesce(records.raw_keys(raw), F.array().cast("array<string>"))
        rules += [
            Rule("T2", F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ("year", "month", "day")])), "the fields are y, m and d"),
            Rule("T2", F.size(records.unknown_keys(raw, [*vocab.DATE_FIELDS, "certainty", "why"])) > 0, "unknown date field"),
            Rule("T1", records.key_present(F.get_json_object(raw, "$.to"), "to"), "a range cannot itself have a range"),
            Rule("A3", raw.isNotNull() & ~_is_object(raw), "date is not an object"),
        ]
    return rules


def act_findings(names: list[str], raw: Column | None = None) -> Column:
    """Findings for the act columns ``names``; ``raw`` is the JSON of the record holding them."""
    acts = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("act"), _json(raw, f"$.{n}").alias("raw"), _json(raw, f"$.{n}.date").alias("date_raw"))
        for n in names])
    with_raw = raw is not None

    def one(a: Column) -> Column:
        act, d = a["act"], a["act"]["date"]
        present = act.isNotNull()
        says = F.coalesce(d["y"], d["m"], d["d"]).isNotNull() | _has(d["weekday"]) | _has(d["season"])
        rules = [
            Rule("A1", present & d.isNull() & ~_has(act["place"]), "an act with neither a date nor a place says nothing"),
            Rule("A1", act["time"].isNotNull() & text.blank(act["time"]), "time must be a non-empty string"),
            Rule("A2", act["place"].isNotNull() & text.blank(act["place"]), "a place is an id"),
            Rule("A3", d.isNotNull() & ~_false(says), "an empty date"),
            Rule("A3", _false(d["certainty"] != "conjectured"), "certainty is conjectured or absent"),
            *date_rules(d, a["date_raw"] if with_raw else None),
        ]
        if with_raw:
            rules += [
                Rule("A1", a["raw"].isNotNull() & ~_is_object(a["raw"]), "an act is an object"),
                Rule("A1", F.size(records.unknown_keys(a["raw"], vocab.ACT_FIELDS)) > 0, "unknown act field"),
            ]
        return findings(rules, a["name"])

    return F.flatten(F.transform(F.filter(acts, lambda a: a["act"].isNotNull() | a["raw"].isNotNull()), one))


# ------------------------------------------------------------------ people
def people(df: DataFrame) -> DataFrame:
    """Records, acts and engagements of people. Needs ``raw`` and ``load_error`` only for the rules about them."""
    raw = F.col("raw") if "raw" in df.columns else None
    rules = [
        Rule("P3", ~_has(F.col("name")), "missing name"),
        Rule("P4", ~_in(F.col("group"), vocab.GROUPS), "group not in the list"),
        Rule("P5", F.col("gender").isNotNull() & ~_in(F.col("gender"), vocab.GENDERS), "gender is m, f or null"),
    ]
    ok = df
    parts = []
    if "load_error" in df.columns:
        parts.append(as_findings(df.where("load_error IS NOT NULL"), "P1", "person", F.col("file"), "unreadable file"))
        ok = df.where("load_error IS NULL")
    parts.append(evaluate(ok, "person", F.col("id"), findings(rules), act_findings(["born", "died"], raw)))
    parts.append(as_findings(dedup.later_repeats(ok, ["id"]), "P2", "person", F.col("id"), "duplicate person id"))
    if "sexuality_sources" in df.columns:
        eng = ok.select("id", F.posexplode("sexuality_sources").alias("pos", "e"))
        e = F.col("e")
        at = F.concat(F.lit("context["), F.col("pos").cast("string"), F.lit("]"))
        parts.append(evaluate(eng, "person", F.col("id"), findings([
            Rule("P7", text.blank(e["subject"]), "engagement without a subject", path=at),
            Rule("P8", e["name"].isNotNull(), "the field is subject, not name", path=at)])))
    return union(parts)


def works(df: DataFrame) -> DataFrame:
    return evaluate(df, "work", F.col("work"), findings([Rule("W1", ~_in(F.col("kind"), vocab.WORK_KINDS), "unknown kind of work")]))


def places(df: DataFrame, used: DataFrame | None = None) -> DataFrame:
    fields = vocab.PLACE_FIELDS
    rules = [
        Rule("G2", ~_false(F.col("place_id").rlike(vocab.PLACE_ID)), "not a place id"),
        Rule("G3", ~F.greatest(*[_has(F.col(f)).cast("int") for f in fields]).cast("boolean"), "a place naming nothing"),
        *[Rule("G3", F.col(f).isNotNull() & ((F.trim(F.col(f)) != F.col(f)) | (F.col(f) == "")), "not a name", path=f) for f in fields],
    ]
    if "raw" in df.columns:
        raw = F.col("raw")
        rules += [Rule("G3", ~_is_object(raw), "a place is an object"),
                  Rule("G3", F.size(records.unknown_keys(raw, fields)) > 0, "unknown place field")]
    parts = [
        evaluate(df, "place", F.col("place_id"), findings(rules)),
        as_findings(dedup.later_members(df, [F.col(f) for f in fields], "place_id"), "G4", "place", F.col("place_id"), "the same place written twice", path=F.col("first_id")),
        as_findings(dedup.later_members(df.where(F.coalesce("venue", F.lit("")) != ""), [F.col("city"), agg.venue_words()], "place_id"), "G5", "place", F.col("place_id"),
                    "the same words in another order", "warning", F.col("first_id")),
    ]
    if used is not None:
        parts.append(as_findings(joins.unused_places(used, df), "G6", "place", F.col("place_id"), "nothing refers to this place", "warning"))
    return union(parts)


def gazetteer_missing(df: DataFrame, record: str = "places.json") -> DataFrame:
    """One finding when the gazetteer came out empty: it was missing or could not be parsed."""
    return as_findings(df.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "G1", "place", F.lit(record), "the gazetteer is missing or unreadable")


# ------------------------------------------------------------------ relationships
_BARE = r"^\s*(c\.\s*)?(\d{4})\s*(?:[-–—]\s*(c\.\s*)?(\d{4})\s*)?$"


def relationships(df: DataFrame, roster: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Record rules plus the checks against the roster and the gazetteer."""
    ok, parts = df, []
    if "load_error" in df.columns:
        parts.append(as_findings(df.where("load_error IS NOT NULL"), "P1", "relationship", F.col("file"), "unreadable file"))
        ok = df.where("load_error IS NULL")
    raw = F.col("raw") if "raw" in df.columns else None
    p = F.coalesce(F.col("people"), F.array().cast("array<string>"))
    one_sided = _false(F.col("certainty") == "attraction-expressed")
    s, e = F.col("start")["date"], F.col("end")["date"]
    label = F.col("date_label")
    group = lambda n: F.regexp_extract(label, _BARE, n) != ""
    bare = _false(label.rlike(_BARE))
    in_people = _false(F.array_contains(p, F.col("direction")))
    rules = [
        Rule("R3", ~records.is_sorted_pair(p), "people must be two ids in sorted order"),
        Rule("R4", ~_false(F.col("id") == F.array_join(p, "--")), "id must join the two people"),
        Rule("R6", ~_in(F.col("certainty"), vocab.CERTAINTY), "unknown certainty"),
        Rule("R6", ~_in(F.col("certainty_status"), vocab.CERTAINTY_STATUS), "unknown certainty status"),
        Rule("R8", one_sided & ~in_people, "direction must name one of the two"),
        Rule("R8", one_sided & ~_in(F.col("outcome"), vocab.OUTCOMES), "outcome required"),
        Rule("R9", ~one_sided & F.col("direction").isNotNull() & ~in_people, "direction must name one of the two"),
        Rule("R9", ~one_sided & F.col("outcome").isNotNull(), "outcome is only for one-sided attraction"),
        Rule("R11", bare & (group(1) != _false(s["circa"])), "bare date label disagrees with the start"),
        Rule("R11", bare & e["y"].isNotNull() & (group(3) != _false(e["circa"])), "bare date label disagrees with the end"),
        Rule("R11", bare & label.rlike("[-—]"), "bare date label uses the wrong dash"),
        Rule("R12", _false(s["y"] > e["y"]), "start after end"),
    ]
    if "disputed" in df.columns:
        rules.append(Rule("R7", _false(F.col("certainty") == "uncorroborated") & F.col("disputed").isNull(), "uncorroborated needs a disputed block"))
    groups = [findings(rules), act_findings(["start", "end"], raw)]
    if "places" in df.columns:
        pl = F.col("places")
        groups.append(findings([
            Rule("R1", pl.isNotNull() & (F.size(pl) == 0), "places is a non-empty list or absent"),
            Rule("R1", _false(records.has_repeats(pl)), "the same place twice")]))
        if gazetteer is not None:
            refs = ok.select("id", F.explode("places").alias("place"))
            parts.append(as_findings(joins.unknown_places(refs, gazetteer), "R1", "relationship", F.col("id"), "unknown place", path=F.col("place")))
    if "phases" in df.columns:
        phases = ok.select(F.col("id"), F.posexplode("phases").alias("pos", "ph")).select("id", "pos", "ph.start", "ph.end")
        parts.append(evaluate(phases, "relationship", F.col("id"), act_findings(["start", "end"])))
    if "sources" in df.columns:
        groups.append(findings([Rule("R13", F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no sources at all", "warning")]))
    parts.append(evaluate(ok, "relationship", F.col("id"), *groups))
    parts.append(as_findings(dedup.later_repeats(ok, ["id"]), "R2", "relationship", F.col("id"), "duplicate relationship id"))
    parts.append(as_findings(joins.unknown_people(ok, roster), "R5", "relationship", F.col("id"), "unknown person", path=F.col("person")))
    parts.append(as_findings(joins.people_without_relationship(ok, roster), "R14", "person", F.col("id"), "in no relationship", "warning"))
    return union(parts)


# ------------------------------------------------------------------ sources
def source_rules(cols: list[str], raw: Column | None) -> list[Rule]:
    """Rules of one source. ``w_author`` and ``w_title`` come from the joined work."""
    c = lambda n: F.col(n) if n in cols else F.lit(None)
    s = lambda n: c(n).cast("string")
    quote, voice = s("quote"), s("voice")
    verified, doc, lang = c("verified").cast("boolean"), s("document"), s("lang")
    acts = [F.col(a) for a in vocab.ACTS if a in cols]
    any_act = F.greatest(*[a.isNotNull().cast("int") for a in acts], F.lit(0)) == 1
    occurred = F.col("occurred")["date"] if "occurred" in cols else F.lit(None)
    any_date = F.greatest(*[a["date"].isNotNull().cast("int") for a in acts], F.lit(0), (occurred.isNotNull()).cast("int")) == 1
    va, vm = c("verified_against_original").cast("boolean"), c("verified_marks").cast("boolean")
    prov, oprov = s("citation_provenance"), s("original_provenance")
    with_ = s("verified_with")
    speaker = F.trim(F.coalesce(F.when(_has(s("speaker")), s("speaker")), F.when(voice == "period", s("w_author")), F.lit("")))
    to = F.trim(F.coalesce(s("addressee"), F.lit("")))
    a, b = F.lower(speaker), F.lower(to)
    squash = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "")
    sp = F.coalesce(s("speaker"), F.lit(""))
    tail = squash(F.substring(sp, F.instr(sp, ",") + 1, F.length(sp)))
    rules = [
        Rule("Q1", verified.isNull(), "verified is true or false"),
        Rule("Q2", ~_in(with_, vocab.VERIFIED_WITH), "unknown verified_with"),
        Rule("Q3", ~_in(F.coalesce(s("locator_type"), F.lit("page")), vocab.LOCATOR_TYPES), "unknown locator type"),
        Rule("Q4", voice.isNotNull() & ~_in(voice, vocab.VOICES), "unknown voice"),
        Rule("Q4", ~text.blank(quote) & voice.isNull(), "a quotation must say whose voice it is"),
        Rule("Q5", _false(verified) & text.blank(prov), "verified without citation provenance"),
        Rule("Q6", (F.coalesce(quote, F.lit("")) == "") & _false(verified), "a pointer has nothing to verify"),
        Rule("Q9", (to != "") & (speaker != "") & ((a == b) | F.startswith(a, F.concat(b, F.lit(","))) | F.contains(F.substring_index(a, ",", 1), b)),
             "speaker and addressee are the same person"),
        Rule("Q11", s("addressee").isNotNull() & (to == ""), "addressee is a name or absent"),
        Rule("Q11", (to != "") & ~_in(voice, ["period", "court"]), "only a participant's words have an addressee"),
        Rule("Q12", F.contains(sp, F.lit(",")) & (tail != "") & F.contains(squash(s("w_title")), tail), "speaker repeats the work's title", "warning"),
        Rule("Q13", lang.isNotNull() & ~_false(lang.rlike("^[a-z]{2,3}$")), "not a language code"),
        Rule("Q13", _false(lang.rlike("^[a-z]{2,3}$") & (lang != "en")) & text.blank(s("translation")), "a foreign quotation needs a translation"),
        Rule("Q13", ~text.blank(s("translation")) & ~_has(lang), "a translation needs the language it is from"),
        Rule("Q14", ~_has(lang) & ~text.blank(quote) & _false(s("context").rlike(r"\bTranslation:\s*['\"‘“]")), "a translation hidden in the context"),
        Rule("Q15", ~_has(lang) & ~text.blank(quote) & text.foreign_guess(F.coalesce(quote, F.lit("")))["language"].isNotNull(), "reads foreign but names no language", "warning"),
        Rule("Q16", text.unbalanced_emphasis(quote), "unbalanced emphasis", path="quote"),
        Rule("Q16", text.unbalanced_emphasis(s("translation")), "unbalanced emphasis", path="translation"),
        Rule("Q17", F.greatest(*[F.coalesce(x["date"]["y"], F.lit(0)) for x in acts], F.coalesce(occurred["y"], F.lit(0)) if "occurred" in cols else F.lit(0), F.lit(0)) > 1945,
             "looks like a publication year"),
        Rule("D1", ~_in(doc, vocab.DOCUMENT_KINDS), "document missing or unknown"),
        Rule("D2", s("verified_against").isNotNull(), "verified_against was renamed"),
        Rule("D3", _false(~va), "verified_against_original is true or absent"),
        Rule("D3", _false(va) & doc.isNull(), "needs a document"),
        Rule("D3", _false(va) & ~_in(with_, vocab.DIRECT_READING), "reading the original means seeing it"),
        Rule("D4", _false(~vm), "verified_marks is true or absent"),
        Rule("D4", _false(vm) & _false(with_ == "text-layer"), "a text layer cannot witness marks"),
        Rule("D5", ~text.blank(oprov) & ~_false(va), "original provenance says the original was read"),
        Rule("D5", ~text.blank(oprov) & text.blank(prov), "the citation's own provenance is missing"),
        Rule("S1", any_act & _in(doc, vocab.PUBLISHED_KINDS), "acts belong to a document of one occasion"),
    ]
    if "occurred" in cols:
        same = [F.to_json(x["date"]) == F.to_json(occurred) for x in acts]
        rules.append(Rule("S2", F.greatest(*[_false(x).cast("int") for x in same], F.lit(0)) == 1, "occurred only repeats an act's date"))
    if "order_hint" in cols:
        h = F.col("order_hint")
        rules += [
            Rule("Q8", h.isNotNull() & any_date, "a hint beside a date"),
            Rule("Q8", h.isNotNull() & text.blank(h["why"]), "a hint needs its reason"),
            Rule("Q8", _false((h["y"] <= 1700) | (h["y"] >= 2000)), "implausible year in a hint"),
        ]
        if raw is not None:
            rules.append(Rule("Q8", ~_is_object(_json(raw, "$.order_hint")), "a hint is an object"))
    if "turns" in cols:
        t = F.col("turns")
        n = F.coalesce(F.size(t), F.lit(0))
        court = _false(voice == "court")
        rules += [
            Rule("Q10", ~court & (n > 0), "turns are for a court record"),
            Rule("Q10", court & F.exists(t, lambda x: text.blank(x["text"])), "a turn without text"),
            Rule("Q10", court & F.exists(t, lambda x: x["who"].isNull()), "a turn without who"),
            Rule("Q10", court & (n > 0) & ~_false(text.turns_match(quote, t)), "the turns do not reproduce the quotation"),
            Rule("Q16", _false(F.exists(t, lambda x: text.unbalanced_emphasis(x["text"]))), "unbalanced emphasis", path="turns"),
        ]
    if "letter_ids" in cols:
        one, many = s("letter_id"), F.col("letter_ids")
        rules += [
            Rule("L1", one.isNotNull() & many.isNotNull(), "letter_id and letter_ids exclude each other"),
            Rule("L1", one.isNotNull() & ~text.is_letter_id(one), "malformed letter id"),
            Rule("L1", many.isNotNull() & (F.size(many) < 2), "letter_ids is for two or more"),
            Rule("L1", _false(F.size(many) >= 2) & F.exists(many, lambda x: ~text.is_letter_id(x)), "malformed letter id", path="letter_ids"),
            Rule("L1", _false(records.has_repeats(many)), "the same letter id twice"),
        ]
    if "manuscript" in cols:
        m = F.col("manuscript")
        implied = F.when(_in(doc, vocab.HANDWRITTEN_UNIQUE), "autograph").otherwise("typescript")
        has = m.isNotNull()
        rules += [
            Rule("M1", has & text.blank(m["repository"]), "repository required"),
            Rule("M1", text.has_shelfmark(m["repository"]), "a shelfmark is no part of the name"),
            Rule("M1", m["archived_as"].isNotNull() & ~_in(m["archived_as"], vocab.ARCHIVED_AS), "unknown archived_as"),
            Rule("M1", _in(m["archived_as"], vocab.ARCHIVED_AS) & _false(m["archived_as"] == implied), "archived_as says what the document implies"),
            Rule("M1", m["owner"].isNotNull() & text.blank(m["owner"]), "owner is empty"),
            Rule("M1", ~text.blank(m["owner"]) & (F.coalesce(m["repository"], F.lit("")) != "Private collection"), "owner is for a private collection"),
            Rule("M1", m["recorded_by"].isNotNull() & text.blank(m["recorded_by"]), "recorded_by is empty"),
            Rule("M1", m["as_of"].isNotNull() & text.blank(m["as_of"]), "as_of is empty"),
            Rule("M1", m["url"].isNotNull() & ~_false(m["url"].rlike("^https?://")), "not an http address"),
        ]
        if "facsimile" in cols:
            rules.append(Rule("M1", has & F.col("facsimile").isNotNull(), "a facsimile already names the archive"))
        if raw is not None:
            rules.append(Rule("M1", ~_is_object(_json(raw, "$.manuscript")), "manuscript is an object"))
    if raw is not None:
        v = _json(raw, "$.verified")
        rules.append(Rule("Q1", v.isNotNull() & ~v.isin("true", "false"), "verified is not a boolean"))
        rules.append(Rule("F1", ~_is_object(_json(raw, "$.facsimile")), "facsimile is an object"))
    return rules


def sources(df: DataFrame, known_works: DataFrame | None, record: Column, gazetteer: DataFrame | None = None) -> DataFrame:
    """Every rule of a source that needs no other source.

    Without ``known_works`` the sources carry ``w_author``, ``w_title`` and ``w_known`` (NULL for an unknown work) already.
    """
    joined = df
    if known_works is not None:
        dim = known_works.select(F.col("work").alias("__w"), F.col("author").alias("w_author"), F.col("title").alias("w_title"), F.lit(True).alias("w_known"))
        joined = df.join(dim, F.col("work") == F.col("__w"), "left")
    raw = F.col("raw") if "raw" in df.columns else None
    named = [a for a in [*vocab.ACTS, "occurred"] if a in df.columns]
    unknown_work = findings([Rule("Q7", _has(F.col("work")) & F.col("w_known").isNull(), "unknown work")])
    own = findings(source_rules(joined.columns, raw))
    # the acts of a published document are one finding (S1) and are not looked into
    published = _in(F.col("document"), vocab.PUBLISHED_KINDS)
    letters = F.when(published, F.array().cast(f"array<{FINDING}>")).otherwise(act_findings([a for a in named if a != "occurred"], raw))
    groups = [own, unknown_work, letters]
    if "occurred" in named:
        groups.append(act_findings(["occurred"], raw))
    parts = [evaluate(joined, "source", record, *groups)]
    if gazetteer is not None:
        refs = joins.place_references(df.withColumn("__record", record), ["__record"], named)
        parts.append(as_findings(joins.unknown_places(refs, gazetteer), "A2", "source", F.col("__record"), "unknown place", path=F.col("path")))
    return union(parts)


def facsimiles(df: DataFrame, record: Column, archives: DataFrame, items: DataFrame, pages: DataFrame) -> DataFrame:
    """Facsimile references against the archives; a fatal finding hides the later ones, as each needs the one before."""
    f = F.col("facsimile")
    arc = archives.select(F.col("archive").alias("__a"), F.col("iiif_url").alias("__iiif"), *(
        [F.col("load_error").alias("__bad")] if "load_error" in archives.columns else [F.lit(None).cast("string").alias("__bad")]))
    itm = items.select(F.col("archive").alias("__ia"), F.col("item").alias("__in")).distinct().withColumn("__ii", F.col("__in"))
    base = df.where(f.isNotNull()).select(record.alias("record"), f.alias("facsimile"))
    j = keyed_join(base.join(arc, f["archive"] == F.col("__a"), "left").withColumns({"__ia": f["archive"], "__in": f["item"]}), itm, ["__ia", "__in"], "left")
    fatal = (
        F.when(text.blank(f["archive"]) | text.blank(f["item"]), "archive and item are required")
        .when(F.col("__a").isNull(), "unknown archive").when(F.col("__bad").isNotNull(), "unreadable manifest")
        .when(text.blank(F.col("__iiif")), "the archive has no image service").when(F.col("__ii").isNull(), "unknown item")
        .when(F.coalesce(F.size(f["pages"]), F.lit(0)) <= 0, "pages must be a non-empty list"))
    j = j.withColumn("__fatal", fatal)
    mk = lambda m: F.struct(F.lit("F1").alias("rule"), F.lit("error").alias("severity"), F.lit("facsimile").alias("path"), m.alias("message"))
    first = F.when(F.col("__fatal").isNotNull(), F.array(mk(F.col("__fatal")))).otherwise(findings([
        Rule("F1", ~records.is_sorted(f["pages"]), "pages must ascend", path="facsimile"),
        Rule("F1", records.has_repeats(f["pages"]), "the same page twice", path="facsimile"),
        Rule("F1", F.exists(f["pages"], lambda p: p.isNull()), "a page is not a number", path="facsimile")]))
    whole = evaluate(j, "source", F.col("record"), first)
    each = j.where("__fatal IS NULL").select("record", f["archive"].alias("archive"), f["item"].alias("item"), F.explode(f["pages"]).alias("page")).where("page IS NOT NULL")
    have = pages.select("archive", "item", "page", F.coalesce("pointer", F.lit("")).alias("__pointer"), F.lit(True).alias("__have"))
    per = each.join(have, ["archive", "item", "page"], "left")
    return whole.unionByName(evaluate(per, "source", F.col("record"), findings([
        Rule("F1", F.col("__have").isNull(), "no such page", path="facsimile"),
        Rule("F1", F.col("__have") & (F.col("__pointer") == ""), "the page has no pointer", path="facsimile")])))


def excerpts(edge_sources: DataFrame, own_sources: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """Excerpts repeated in one holder, on both an engagement and an edge, or on one panel."""
    both = edge_sources.select("owner_id", "engagement_pos", "work", "locator", "quote").unionByName(
        own_sources.select("owner_id", "engagement_pos", "work", "locator", "quote"))
    twice = dedup.later_repeats(dedup.with_excerpt(both).where("excerpt <> ''"), ["owner_id", "engagement_pos", "work", "locator", "excerpt"])
    at = F.concat_ws(" ", F.concat(F.lit("context["), F.col("engagement_pos").cast("string"), F.lit("]")), "locator")
    parts = [
        as_findings(twice, "X1", "source", F.col("owner_id"), "the same excerpt twice in one record", path=at),
        as_findings(joins.excerpt_on_engagement_and_edge(edge_sources, own_sources), "X2", "person", F.col("person"),
                    "an excerpt on an engagement and on an edge", path=F.col("edge")),
    ]
    if panel is not None:
        parts.append(as_findings(dedup.repeated_on_panels(panel), "X3", "person", F.col("person"), "an excerpt twice on one panel", "warning", F.col("locator")))
    return union(parts)


def letters_hold_quotations(pairs: DataFrame, record: Column, fuzzy: bool = True) -> DataFrame:
    missing = citations.check_citations(pairs, fuzzy).where("NOT found")
    return as_findings(missing, "L2", "source", record, "the cited letter does not hold the words", path=F.col("letter_id"))


def manifest_matches(matches: DataFrame, citing: DataFrame) -> DataFrame:
    lid = F.col("letter_id")
    bad = matches.where(_has(lid) & ~text.is_letter_id(lid))
    near = coverage.same_folio_other_letter(citing, matches.where(lid.isNotNull())).where("role = 'cited'")
    return as_findings(bad, "L3", "match", lid, "malformed letter id").unionByName(
        as_findings(near, "L4", "match", lid, "another letter of the same folio is held", "warning", F.col("stem")))


# ------------------------------------------------------------------ transcriptions
def transcriptions(df: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """``at`` is the path; ``raw`` and ``store`` (the archive folder) serve the rules about them."""
    parts, ok = [], df
    if "load_error" in df.columns:
        parts.append(as_findings(df.where("load_error IS NOT NULL"), "N1", "transcription", F.col("at"), "unreadable"))
        ok = df.where("load_error IS NULL")
    cols = df.columns
    lid = F.col("letter_id")
    bad_id = ~text.is_letter_id(lid)
    parts.append(as_findings(ok.where(bad_id), "N1", "transcription", F.col("at"), "letter id missing or malformed"))
    ok = ok.where(~bad_id)
    kind = F.col("transcribed_from")
    rules = [Rule("N2", ~_in(kind, vocab.TRANSCRIBED_FROM), "facsimile or printed"), Rule("N4", text.blank(F.col("quote")), "no text")]
    if "verified_marks" in cols:
        rules.append(Rule("N3", _false(kind == "printed") & _false(F.col("verified_marks")), "print cannot witness marks"))
    if "facsimile" in cols:
        f = F.col("facsimile")
        rules.append(Rule("N3", _false(kind == "printed") & f.isNotNull(), "a facsimile belongs in the archive's store"))
        if "store" in cols:
            want = F.format_string("%s-%s-%03d", F.col("store"), f["item"], F.try_element_at(f["pages"], F.lit(1)))
            stem = F.regexp_replace(F.substring_index("at", "/", -1), r"\.json$", "")
            complete = _has(f["archive"]) & _has(f["item"]) & (F.coalesce(F.size(f["pages"]), F.lit(0)) > 0)
            rules.append(Rule("N9", _false(kind == "facsimile") & complete & ~_false(stem == want), "file name does not follow its facsimile block"))
    if "printed" in cols:
        number = F.regexp_extract(F.coalesce(F.col("printed")["locator"], F.lit("")), r"(\d+)", 1)
        rules.append(Rule("N5", text.folio(lid).isNotNull() & (number != "") & (text.folio(lid) != number), "folio and locator disagree"))
    for who in ("sender", "addressee"):
        if who in cols:
            rules.append(Rule("N8", text.blank(F.col(who)), f"{who} is required"))
    acts = [a for a in vocab.ACTS if a in cols]
    groups = []
    if acts:
        dated = F.greatest(*[F.col(a)["date"].isNotNull().cast("int") for a in acts], F.lit(0)) == 1
        declared = records.explicit_null(F.col("raw"), "written") if "raw" in cols else F.lit(False)
        rules.append(Rule("N7", ~dated & ~declared, "no date on any act and not declared undated"))
        groups.append(act_findings(acts, F.col("raw") if "raw" in cols else None))
    parts.append(evaluate(ok, "transcription", F.col("at"), findings(rules), *groups))
    _, later = dedup.one_reading_each(ok)
    parts.append(as_findings(later, "N10", "transcription", F.col("at"), "the same reading twice", path=F.col("first_at")))
    if roster is not None:
        for who in ("sender", "addressee"):
            if who in cols:
                found = joins.bare_surnames(ok, roster, who, "at")
                parts.append(as_findings(found, "N6", "transcription", F.col("at"), f"{who} is a bare surname", path=F.col("value")))
    return union(parts)


def control_characters(files: DataFrame) -> DataFrame:
    """``path`` and ``content`` (binary): the first stray control byte of each file."""
    c = files.select("path", text.control_character(F.decode("content", "ISO-8859-1")).alias("c")).where("c IS NOT NULL")
    at = F.concat(F.col("c.name"), F.lit(" at line "), F.col("c.line").cast("string"), F.lit(", column "), F.col("c.col").cast("string"))
    return as_findings(c, "C1", "file", F.col("path"), "control character", path=at)


def leaked(public: DataFrame, cited: DataFrame) -> DataFrame:
    from sourceweave.plans import publish

    return as_findings(publish.leaks(public, cited), "Z1", "transcription", F.col("letter_id"), "uncited text of the printed edition")
