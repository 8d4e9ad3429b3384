"""Duplicates, precedence and merging, without a window over a key that may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceweave.functions import text
from sourceweave.physical import first_row, with_group_count


def with_excerpt(sources: DataFrame) -> DataFrame:
    """Adds the words of the quote as ``excerpt``, unless a stored table has them already."""
    return sources if "excerpt" in sources.columns else sources.withColumn("excerpt", text.excerpt_key(F.col("quote")))


def repeated_excerpts(sources: DataFrame, holder: list[str]) -> DataFrame:
    """Sources whose (work, locator, words) occur more than once in one holder; blanks never collide."""
    df = with_excerpt(sources).where(F.col("excerpt") != "")
    return with_group_count(df, [*holder, "work", "locator", "excerpt"], "copies")


def repeated_on_panels(panel: DataFrame) -> DataFrame:
    """Per person and excerpt met more than once: how often, and by which routes."""
    return (
        with_excerpt(panel).where(F.col("excerpt") != "")
        .groupBy("person", "work", "locator", "excerpt")
        .agg(F.count(F.lit(1)).alias("copies"), *[
            F.count_if(F.col("route") == r).alias(n) for r, n in ((0, "by_edge"), (1, "by_own"), (2, "by_named"))])
        .where(F.col("copies") > 1)
    )


def _card_keys(panel: DataFrame, order: str) -> tuple[DataFrame, list[str]]:
    """Excerpt keys; a source without words gets its own position as key, so it stays alone."""
    df = with_excerpt(panel).withColumn("solo", F.when(F.col("excerpt") == "", F.col(order)))
    return df, ["person", "work", "locator", "excerpt", "solo"]


def with_card(panel: DataFrame, order: str = "card_order") -> DataFrame:
    """Adds ``card``, a 128-bit digest of person and excerpt: 16 bytes travel instead of their texts."""
    if "card" in panel.columns:
        return panel
    df, keys = _card_keys(panel, order)
    # each part with its length, so that no two keys read alike; the solo one holds names, so it is JSON
    parts = [F.col(k) if k != "solo" else F.to_json("solo") for k in keys]
    spelt = F.concat(*[F.coalesce(F.concat(F.char_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
    return df.withColumn("card", F.unhex(F.md5(spelt))).drop("solo")


def merge_cards(panel: DataFrame, columns: list[str], order: str = "card_order", held: dict[str, Column] | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """The primary row of each excerpt with ``also``, the number of rows folded into it: person and ``columns``.

    ``held`` are conditions to answer for the whole card: whether any of its rows meets them. ``told`` are columns that
    ``card`` and ``first``, the primary row's order, tell by themselves: they do not travel beside them.

    A single aggregation that combines before the shuffle: no self-join, and a
    popular excerpt reaches its reducer as one row per map task.
    """
    keep = ["person", *[c for c in columns if c != "person"]]
    told = told or {}
    moved = [c for c in keep if c not in told]
    df = with_card(panel, order)
    # the parts of a card and of its order travel side by side: a struct inside a row costs an offset and a word of its own
    keys, firsts = _parts(df, "card", "__k"), _parts(df, order, "__o")
    # the order comes first and differs between any two rows of a card, so the rest never decides
    least = F.min(F.struct(*[part.alias(n) for n, (_, part) in firsts.items()], *moved))
    return (
        df.groupBy(*[part.alias(n) for n, (_, part) in keys.items()])
        .agg(least.alias("__p"), (F.count(F.lit(1)) - 1).alias("also"), *[F.bool_or(c).alias(n) for n, c in (held or {}).items()])
        .select("*", "__p.*").withColumns({"card": _whole(keys), "first": _whole(firsts)})
        .select(*[told.get(c, F.col(c)).alias(c) for c in keep], "also", *(held or {}))
    )


def _parts(df: DataFrame, column: str, mark: str) -> dict[str, tuple[str, Column]]:
    """The fields of a struct by new names, each with its own; a column that is no struct is its own part."""
    kind = df.schema[column].dataType
    fields = kind.names if isinstance(kind, StructType) else [""]
    return {f"{mark}{i}": (f, F.col(column)[f] if f else F.col(column)) for i, f in enumerate(fields)}


def _whole(parts: dict[str, tuple[str, Column]]) -> Column:
    """``_parts`` put together again."""
    named = [F.col(n).alias(f) for n, (f, _) in parts.items() if f]
    return F.struct(*named) if named else F.col(next(iter(parts)))


def merge_duplicates(panel: DataFrame, order: str = "card_order") -> DataFrame:
    """All rows, each pointing to the first row of its excerpt.

    Adds ``primary`` (that row's order struct), ``is_primary`` and ``also``. The
    folded rows remain rows: a popular excerpt cannot grow an array.
    """
    df, keys = _card_keys(panel, order)
    firsts = df.groupBy(*keys).agg(F.min(order).alias("primary"), (F.count(F.lit(1)) - 1).alias("also"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"w.{k}").eqNullSafe(F.col(f"f.{k}"))
    return df.alias("w").join(firsts.alias("f"), cond).select("w.*", "f.primary", "f.also").withColumn(
        "is_primary", F.col(order) == F.col("primary"))


def card_identity() -> Column:
    """Whom a row's card names: the edge, else the person, else the words."""
    return F.when(F.col("route") == 0, F.concat(F.lit("r:"), "owner_id")).otherwise(F.concat(F.lit("l:"), F.coalesce("label_id", "label")))


def names_on_cards(panel: DataFrame, order: str = "card_order") -> DataFrame:
    """Per person: ``names`` on the headers of their cards, each once per card, and the different ``identities`` among them."""
    df = panel if "identity" in panel.columns else panel.withColumn("identity", card_identity())
    df = with_card(df.where(F.col("identity").isNotNull()), order)
    each = df.groupBy("person", "identity").agg(F.count_distinct("card").alias("n"))
    return each.groupBy("person").agg(F.sum("n").alias("names"), F.count(F.lit(1)).alias("identities"))


def card_names(cards: DataFrame, order: str = "card_order") -> DataFrame:
    """Who a card's header names: one row per card and identity, in the order first met."""
    df = cards.withColumn("identity", card_identity()).where(F.col("identity").isNotNull())
    return first_row(df, ["person", "primary", "identity"], [F.col(order)], ["label", order])


def repeated_ids(df: DataFrame, id_column: str = "id") -> DataFrame:
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def later_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per repeat of a key beyond the first: three equal keys give two rows. Keys compare null-safe."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    return n.select(*keys, F.explode(F.sequence(F.lit(2), F.col("__n").cast("int"))).alias("nth"))


def later_members(df: DataFrame, keys: list[Column], id_column: str) -> DataFrame:
    """The rows of every group but those of its least id, each with that id as ``first_id``.

    The short list of repeated groups is joined back on a key of its own, so a
    group that holds a third of all rows is split.
    """
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    keyed = df.withColumn("__key", key)
    groups = keyed.groupBy("__key").agg(F.min(id_column).alias("first_id"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    groups = groups.select(F.struct("__key").alias("__g"), "first_id")
    return keyed.withColumn("__g", F.struct("__key")).join(groups, "__g").where(F.col(id_column) != F.col("first_id")).drop("__g", "__key")


def one_reading_each(transcriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First transcription per (letter, kind) in path order, and the later ones, which are errors."""
    keys = ["letter_id", "transcribed_from"]
    first = transcriptions.groupBy(*keys).agg(F.min("at").alias("first_at"))
    safe = F.struct(*keys)  # null-safe, and a key of the join's own
    both = transcriptions.withColumn("__k", F.struct(safe)).join(first.select(F.struct(safe).alias("__k"), "first_at"), "__k").drop("__k")
    return both.where(F.col("at") == F.col("first_at")).drop("first_at"), both.where(F.col("at") != F.col("first_at"))


def preferred_reading(held: DataFrame, columns: list[str]) -> DataFrame:
    """One text per letter: the facsimile's reading before the edition's, then the first path."""
    rank: Column = (F.col("transcribed_from") != "facsimile").cast("int")
    keep = [c for c in columns if c != "letter_id"]
    return first_row(held, ["letter_id"], [rank, F.col("at")], keep)


def first_by(df: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """The single least row of a table, by partial aggregation."""
    packed = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *keep)
    return df.agg(F.min(packed).alias("__f")).select(*[F.col(f"__f.{k}").alias(k) for k in keep])
