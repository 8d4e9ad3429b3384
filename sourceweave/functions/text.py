"""Text functions as Column expressions (all run inside the JVM).

``(?U)`` or explicit ``\\p{..}`` classes are used wherever a word may carry an
accent: Java's plain ``\\w`` and ``\\b`` are ASCII-only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceweave import vocab
from sourceweave.functions.binding import let

ELISION = r"…|\.\.\."
_NOT_WORD = r"[^\p{L}\p{N}_]+"


def blank(c: Column) -> Column:
    """NULL and whitespace-only count as blank."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def excerpt_key(c: Column) -> Column:
    """The words of a quotation: non-word runs become one space, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _NOT_WORD, " ")))


# ---------------------------------------------------------------- accent folding
def _folded(ch: str, form: str) -> str:
    return "".join(x for x in unicodedata.normalize(form, ch) if not unicodedata.combining(x))


@lru_cache(maxsize=2)
def _fold_tables(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Derived from the Unicode data: one-to-one folds for translate(), and the few
    characters that fold to several letters or digits. Folds without an ASCII
    letter or digit are left out: every caller turns such characters into spaces."""
    src, dst, many = [], [], []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000 or not unicodedata.decomposition(ch):
            continue  # surrogates, and characters that fold to themselves
        to = "".join(x if x.isascii() else " " for x in _folded(ch, form))
        if not any(x.isalnum() for x in to):
            continue
        if len(to) == 1:
            src.append(ch)
            dst.append(to)
        else:
            many.append((ch, to))
    return "".join(src), "".join(dst), tuple(many)


def fold_accents(c: Column, compatibility: bool = False) -> Column:
    """Strip accents: NFD by default, NFKD (ligatures, fractions, full-width) on request."""
    src, dst, many = _fold_tables("NFKD" if compatibility else "NFD")
    out = F.translate(F.regexp_replace(c, r"\p{Mn}", ""), src, dst)
    if many:
        rare = "".join(k for k, _ in many)
        pairs = F.expr("array(" + ", ".join(f"named_struct('k', '{k}', 'v', '{v}')" for k, v in many) + ")")
        # translate() spots the rare characters far faster than a large character class
        out = let(out, lambda x: F.when(
            F.length(F.translate(x, rare, "")) != F.length(x),
            F.reduce(pairs, x, lambda acc, p: F.replace(acc, p["k"], p["v"]))).otherwise(x))
    return out


def name_key(c: Column) -> Column:
    """A name as bare lower-case ASCII words: accents and ``.'’`` vanish, the rest splits words."""
    s = fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[.'’]", ""), "[^a-z0-9]+", " "))


def word_text(c: Column) -> Column:
    """Accent-folded ASCII words joined by single spaces: the form containment is tested on."""
    s = F.lower(fold_accents(F.coalesce(c, F.lit("")), compatibility=True))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """The same words as an array, in order."""
    return F.array_remove(F.split(word_text(c), " "), "")


def unelided_runs(quote: Column, min_words: int = 6) -> Column:
    """The stretches of a quotation between its ellipses, as word arrays, short ones dropped."""
    parts = F.transform(F.split(F.coalesce(quote, F.lit("")), ELISION), words)
    return F.filter(parts, lambda w: F.size(w) >= min_words)


def run_text(run: Column, length: int = 14) -> Column:
    return F.array_join(F.slice(run, 1, length), " ")


def any_run_contained(runs: Column, body_text: Column) -> Column:
    return F.exists(runs, lambda r: F.contains(body_text, run_text(r)))


# ---------------------------------------------------------------- marked spans
def marked_spans(full: Column, quote: Column, min_chars: int = 12) -> Column:
    """Offsets (0-based start, exclusive end) of each quoted run in the full text, left to right.

    Runs are sought among the bare words. A position there is turned back into
    one of the original by the separators passed on the way, each of which the
    bare words replaced by a single space.
    """
    low = F.lower(full)
    bare = lambda c: F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))
    probes = F.filter(
        F.transform(F.split(F.coalesce(quote, F.lit("")), rf"\s*(?:{ELISION})\s*"), lambda p: bare(F.lower(p))),
        lambda p: F.length(p) >= min_chars,
    )
    span = "array<struct<start:int,end:int>>"

    def original(page: Column, at: Column) -> Column:
        spaces = F.regexp_count(F.substring(page["flat"], F.lit(1), at), F.lit(" "))
        passed = F.length(F.array_join(F.slice(page["seps"], F.lit(1), spaces + 1), ""))
        return (passed + at - spaces).cast("int")

    def spans(page: Column) -> Column:
        def step(acc: Column, probe: Column) -> Column:
            at = F.position(probe, page["flat"], acc["next"] + 1)
            found = F.struct(original(page, at - 1).alias("start"), (original(page, at + F.length(probe) - 2) + 1).alias("end"))
            return F.when(at > 0, F.struct(
                (at + F.length(probe) - 1).cast("int").alias("next"), F.concat(acc["spans"], F.array(found)).alias("spans"))).otherwise(acc)

        zero = F.struct(F.lit(0).alias("next"), F.array().cast(span).alias("spans"))
        return F.reduce(probes, zero, step, lambda acc: acc["spans"])

    page = F.named_struct(F.lit("flat"), bare(low), F.lit("seps"), F.split(low, "[a-z0-9]+", -1))
    return let(page, spans)


# ---------------------------------------------------------------- language
def _word_pattern(ws: list[str], extra: str = "") -> str:
    body = "|".join(ws) + (f"|{extra}" if extra else "")
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"


def language_hits(c: Column) -> dict[str, Column]:
    return {
        lang: F.regexp_count(c, F.lit(_word_pattern(ws, vocab.FRENCH_ELIDED if lang == "French" else "")))
        for lang, ws in vocab.FUNCTION_WORDS.items()
    }


def foreign_guess(c: Column, min_hits: int = 4, min_density: float = 0.14) -> Column:
    """struct(language, hits, words); language is NULL unless the passage is clearly not English.

    Ties go to the language listed first.
    """
    hits = F.array(*language_hits(c).values())
    counted = F.named_struct(
        F.lit("hits"), hits, F.lit("words"), F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"(?U)\S+"))))
    names = F.array(*[F.lit(k) for k in vocab.FUNCTION_WORDS])

    def judge(x: Column) -> Column:
        best = F.array_max(x["hits"])
        clear = (best >= min_hits) & (best / x["words"] >= min_density)
        return F.struct(
            F.when(clear, F.element_at(names, F.array_position(x["hits"], best).cast("int"))).alias("language"),
            F.when(clear, best).otherwise(0).cast("bigint").alias("hits"),
            x["words"].cast("bigint").alias("words"),
        )

    return let(counted, judge)


# ---------------------------------------------------------------- emphasis
EMPHASIS_PAIRS = [r"\*\*[^*\n]+\*\*", r"\*[^*\n]+\*", r"__[^_\n]+__", r"_[^_\n]+_", r"~~[^~\n]+~~"]


def unbalanced_emphasis(c: Column) -> Column:
    """True when a ``* _ ~`` marker is left once every pair has been closed, inner pairs first."""
    out = F.coalesce(c, F.lit(""))
    for rx in EMPHASIS_PAIRS:
        out = F.regexp_replace(out, rx, "x")
    return out.rlike("[*_~]")


# ---------------------------------------------------------------- transcripts
TURN_LABEL = r"\b[A-Z][A-Z .'\-]*[A-Z]:\s*"
_ATTRIBUTION = "(?:" + "|".join(a.replace(".", r"\.") for a in vocab.TURN_ATTRIBUTIONS) + ")—"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def transcript_words(quote: Column) -> Column:
    """A court quotation without the marks that only say who speaks."""
    s = F.regexp_replace(F.coalesce(quote, F.lit("")), TURN_LABEL, "")
    s = F.regexp_replace(s, r"(?<=\?)\s*[—–]\s*", " ")
    return squeeze(F.regexp_replace(s, _ATTRIBUTION, " "))


def turns_text(turns: Column) -> Column:
    return squeeze(F.array_join(F.transform(turns, lambda t: F.coalesce(t["text"], F.lit(""))), " "))


def turns_match(quote: Column, turns: Column) -> Column:
    return turns_text(turns) == transcript_words(quote)


def short_surname(c: Column) -> Column:
    """Last word before the comma, without a parenthesis or a title."""
    main = F.regexp_replace(F.trim(F.substring_index(c, ",", 1)), r"\s*\(.*\)$", "")
    title = "(?i)^(" + "|".join(vocab.SURNAME_TITLES) + r")\.?$"
    kept = F.filter(F.split(main, r"\s+"), lambda w: (w != "") & ~w.rlike(title))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(
        F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise(main)
    )


def split_transcript(quote: Column, speaker: Column, addressee: Column) -> Column:
    """A court quotation as ``array<struct<who, text>>``; NULL when it is not an exchange.

    Labelled speakers win; otherwise a question mark followed by a dash changes
    the speaker, and a last single question after other words is cut off them.
    """
    turn = "struct<who:string,text:string>"
    mk = lambda who, text: F.struct(who.alias("who"), text.alias("text")).cast(turn)
    sep, mid = "\u0001", "\u0002"
    abbr = "|".join(vocab.SENTENCE_ABBREVIATIONS)
    tail_rx = r"(?s)^(.*[.!?…\"'\]])\s+([^.!?]*\?)$"

    def labelled(x: Column) -> Column:
        who = F.substring_index(x, mid, 1)
        name = F.concat(F.substring(who, 1, 1), F.lower(F.substring(who, F.lit(2), F.length(who))))
        return F.when(F.contains(x, F.lit(mid)), mk(name, F.trim(F.substring_index(x, mid, -1)))).otherwise(mk(F.lit(""), x))

    def by_label(raw: Column) -> Column:
        marked = F.regexp_replace(raw, r"\s*\b([A-Z][A-Z .'\-]*[A-Z]):\s*", f"{sep}$1{mid}")
        turns = F.transform(F.filter(F.split(marked, sep), lambda x: x != ""), labelled)
        return let(turns, lambda t: F.when(F.size(t) > 1, t))

    def exchange(x: Column, last: Column, who: Column) -> Column:
        asks, says = who["asks"], who["says"]
        head, tail = F.regexp_extract(x, tail_rx, 1), F.regexp_extract(x, tail_rx, 2)
        cut = ~last & (tail != "") & ~head.rlike(rf"\b(?:{abbr})\.$")
        one = ~F.regexp_replace(x, rf"\b(?:{abbr})\.", "").rlike(r"[.!?…]\s+\S")
        return (
            F.when(cut, F.array(mk(says, F.trim(head)), mk(asks, F.trim(tail))))
            .when(last, F.array(mk(says, x)))
            .when(one, F.array(mk(asks, x)))
            .otherwise(F.array(mk(F.lit(""), x)))
        )

    who = F.named_struct(
        F.lit("asks"), let(short_surname(addressee), lambda s: F.when(s != "", s).otherwise("Q.")),
        F.lit("says"), let(short_surname(speaker), lambda s: F.when(s != "", s).otherwise("A.")),
    )

    def by_dash(raw: Column) -> Column:
        answers = F.transform(F.split(raw, r"(?<=\?)\s*[—–]\s*"), lambda x: F.trim(x))
        rows = let(who, lambda w: let(answers, lambda a: F.when(
            F.size(a) >= 2, F.flatten(F.transform(a, lambda x, i: exchange(x, i == F.size(a) - 1, w))))))
        return rows

    return let(
        F.trim(F.coalesce(quote, F.lit(""))),
        lambda raw: F.when(raw == "", F.lit(None))
        .when(raw.rlike(r"\b[A-Z][A-Z .'\-]*:"), by_label(raw))
        .otherwise(by_dash(raw)),
    )


# ---------------------------------------------------------------- labels
def surname_of(name: Column, sort_name: Column) -> Column:
    return F.trim(F.substring_index(F.coalesce(F.when(sort_name != "", sort_name), name), ",", 1))


def trimmed_surname(surname: Column) -> Column:
    s = F.when((F.length(surname) > 13) & F.contains(surname, F.lit("-")), F.substring_index(surname, "-", 1)).otherwise(surname)
    return F.when(F.length(s) > 15, F.concat(F.substring(s, 1, 14), F.lit("…"))).otherwise(s)


def display_label(name: Column, label: Column, clash: Column, descriptor: Column) -> Column:
    """The short label; an initial is added when somebody else carries the same surname."""
    title = "(?i)^(" + "|".join(vocab.PERSON_TITLES) + r")\.?$"
    first = F.element_at(F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: ~w.rlike(title)), 1)
    full = F.when(clash, F.trim(F.concat(label, F.lit(" "), F.when(F.coalesce(first, F.lit("")) != "", F.concat(F.substring(first, 1, 1), F.lit("."))).otherwise("")))).otherwise(label)
    return F.when(F.coalesce(descriptor, F.lit(False)), F.concat(F.lit("“"), full, F.lit("”"))).otherwise(full)


def short_repository(name: Column) -> Column:
    s = F.trim(F.coalesce(name, F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in vocab.REPOSITORY_SHORT.items() for x in kv])
    head = F.regexp_replace(F.trim(F.substring_index(s, ",", 1)), "(?i)^the ", "")
    return F.when(s == "", "").otherwise(F.coalesce(F.try_element_at(known, s), F.when(head != "", head), s))


# ---------------------------------------------------------------- locators and ids
CONTROL_CLASS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


def control_character(c: Column) -> Column:
    """struct(name, line, col) of the first stray control character, NULL when there is none.

    Give it one character per byte (decode binary content as ISO-8859-1) for byte columns.
    """
    at = F.regexp_instr(c, F.lit(CONTROL_CLASS))
    before = F.substring(c, F.lit(1), at - 1)
    code = F.ascii(F.substring(c, at, F.lit(1)))
    names = F.create_map(*[x for k, v in vocab.CONTROL_NAME.items() for x in (F.lit(k), F.lit(v))])
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    col = F.length(F.substring_index(before, "\n", -1)) + 1
    return F.when(
        at > 0,
        F.struct(F.coalesce(F.try_element_at(names, code), F.concat(F.lit("0x"), F.lower(F.hex(code)))).alias("name"),
                 line.cast("bigint").alias("line"), col.cast("bigint").alias("col")),
    )


def is_letter_id(c: Column) -> Column:
    return F.coalesce(c.rlike(vocab.LETTER_ID), F.lit(False))


def folio(letter_id: Column) -> Column:
    f = F.regexp_extract(letter_id, r"^[^/]+/(\d+)", 1)
    return F.when(f != "", f)


def stem(letter_id: Column) -> Column:
    return F.regexp_replace(letter_id, "#[^#]*$", "")


def has_shelfmark(c: Column) -> Column:
    return F.coalesce(c.rlike(vocab.SHELFMARK), F.lit(False))


PAGE_CITATION = r"\bPDF pages?\s+(\d+)(?:\s*[-–]\s*(\d+))?"


def cited_page_ranges(raw: Column, pattern: str = PAGE_CITATION) -> Column:
    """Every cited page range of a text as ``array<struct<first, last>>`` (group 2 empty = one page)."""
    a = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    b = F.regexp_extract_all(raw, F.lit(pattern), F.lit(2))
    return F.transform(
        F.arrays_zip(a.alias("a"), b.alias("b")),
        lambda x: F.struct(x["a"].cast("bigint").alias("first"),
                           F.when(x["b"] != "", x["b"]).otherwise(x["a"]).cast("bigint").alias("last")),
    )


# ---------------------------------------------------------------- search text
def haystack(*parts: Column) -> Column:
    """Lower-cased parts joined by two spaces, blanks skipped."""
    return F.lower(F.concat_ws("  ", *[F.when(p != "", p) for p in parts]))


def term_count(c: Column, term: str) -> Column:
    """Non-overlapping, case-insensitive occurrences of a plain term."""
    low = F.lower(F.coalesce(c, F.lit("")))
    t = term.lower()
    gone = F.replace(low, F.lit(t), F.lit(""))
    return ((F.length(low) - F.length(gone)) / len(t)).cast("bigint")


def term_offsets(c: Column, term: str) -> Column:
    """0-based offsets of those occurrences."""
    t = term.lower()
    pieces = F.split(F.lower(F.coalesce(c, F.lit(""))), re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", t), -1)
    n = len(t)

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p)
        return F.struct((at + n).cast("int").alias("at"), F.concat(acc["hits"], F.array(at.cast("int"))).alias("hits"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    return F.reduce(pieces, zero, step, lambda a: F.slice(a["hits"], F.lit(1), F.size(a["hits"]) - 1))


def speaker_capacity(speaker: Column, addressee: Column) -> Column:
    """struct(name, capacity): the speaker up to the first comma and what follows it.

    "letter to …" is dropped when the addressee is already known.
    """
    cut = F.instr(speaker, ",")
    has = cut > 1
    rest = F.trim(F.substring(speaker, cut + 1, F.length(speaker)))
    letter_to = rest.rlike(r"(?i)^(letter|note|telegram|postcard|diary|memoir)?\s*to\s+")
    rest = F.when((F.coalesce(addressee, F.lit("")) != "") & letter_to, "").otherwise(rest)
    return F.struct(
        F.when(has, F.substring(speaker, F.lit(1), cut - 1)).otherwise(speaker).alias("name"),
        F.when(has, rest).otherwise("").alias("capacity"),
    )
