"""Does the cited letter hold the quoted words? Exact first, fuzzy on what is left."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceweave.functions import text
from sourceweave.operators.projections import source_letter_ids
from sourceweave.physical import keyed_join, spread

#: a run is compared by its first words only: enough to tell it from any other
RUN = 14
MIN_RUN = 6
SLACK = 6
SHARE = 0.7


def citations_with_letters(sources: DataFrame, letters: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join of citations and letter texts on the letter id, singular or plural.

    A letter's text is reduced to its words before the join, once, however often it is cited.
    """
    cited = sources.select(*keys, "locator", "quote", F.explode(source_letter_ids()).alias("letter_id"))
    return cited.join(spread(letters.select("letter_id", "quote")).select("letter_id", text.word_text(F.col("quote")).alias("body")), "letter_id")


def run_is_close(run: list[str], body: np.ndarray) -> bool:
    """Is at least SHARE of the run found, in order, in some window of the body?

    Only windows holding enough words of the run at all are compared in order;
    a window short of them cannot reach the share, so none is lost.
    """
    run = run[:RUN]
    n = len(run)
    starts = max(1, len(body) - n + 1)
    hits = np.concatenate([[0], np.cumsum(np.isin(body, run))])
    lo = np.arange(starts)
    hi = np.minimum(lo + n + SLACK, len(body))
    for i in lo[(hits[hi] - hits[lo]) / n >= SHARE]:
        window = list(body[i:i + n + SLACK])
        blocks = SequenceMatcher(None, window, run, autojunk=False).get_matching_blocks()
        if sum(b.size for b in blocks) / n >= SHARE:
            return True
    return False


@F.pandas_udf(T.BooleanType())
def any_run_close(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for runs, bodies in batches:
        yield pd.Series([
            rs is not None and any(run_is_close(list(r), np.asarray(b, dtype=object)) for r in rs) for rs, b in zip(runs, bodies)
        ], dtype=bool)


def check_citations(pairs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Adds ``exact`` and ``found`` to pairs of ``citations_with_letters``; those without a run long enough are dropped.

    The JVM test settles the exact ones; only the rest send their words to
    Python, in Arrow batches. The runs pass through a generator so that no
    filter on them is evaluated a second time below it.
    """
    runs = F.array(F.struct(text.unelided_runs(F.col("quote"), MIN_RUN).alias("runs")))
    tested = F.transform(F.filter(runs, lambda r: F.size(r["runs"]) > 0), lambda r: F.struct(
        r["runs"].alias("runs"), text.any_run_contained(r["runs"], F.col("body")).alias("exact")))
    df = spread(pairs).select("*", F.inline_outer(tested)).where(F.col("runs").isNotNull())
    if not fuzzy:
        return df.withColumn("found", F.col("exact")).drop("runs")
    left = ~F.col("exact")
    close = any_run_close(F.when(left, F.col("runs")), F.when(left, F.split("body", " ")))
    return df.withColumn("found", F.col("exact") | close).drop("runs")


def _passage_runs(passages: DataFrame) -> DataFrame:
    runs = passages.select("item_id", F.explode(text.unelided_runs(F.col("text"), MIN_RUN)).alias("run")).withColumn(
        "run", F.slice("run", 1, RUN))
    # the words between a run's first and last are whole words wherever the run occurs: four of them, hashed, find it
    return runs.select("item_id", F.array_join("run", " ").alias("run_text"), F.xxhash64(F.slice("run", 2, 4)).alias("gram"))


def contained_passages(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the first ``RUN`` words of a passage's run stand in a document, no id linking them.

    One plan at every size: documents give (hash of four words, doc_id), which meet
    the passages' hashes; the optimizer sends the passages to the scan while they
    are small and shuffles sixteen bytes per word otherwise. Texts are fetched and
    searched for the pairs found only.
    """
    runs = _passage_runs(passages)
    words = spread(documents.select("doc_id", "text")).select("doc_id", text.words(F.col("text")).alias("w"))
    grams = F.transform(F.sequence(F.lit(2), F.size("w") - 3), lambda p: F.xxhash64(F.slice(F.col("w"), p, F.lit(4))))
    met = words.select("doc_id", F.explode(F.when(F.size("w") >= MIN_RUN, F.array_distinct(grams))).alias("gram"))
    pairs = met.join(runs, "gram").select("item_id", "run_text", "doc_id").distinct()
    found = keyed_join(documents.select("doc_id", "text"), pairs, ["doc_id"])
    return found.where(F.contains(text.word_text(F.col("text")), F.col("run_text"))).select("item_id", "doc_id").distinct()
