"""Search by an inverted index: a term reads the postings of its rarest trigrams, and only what they name is tested.

Layout under the index's path: ``texts/bucket=<b>`` holds every different search
text once, ``holders/bucket=<b>`` who is found by it and how (name, quote or
note), ``grams/bucket=<b>`` one posting (gram, block) for every different trigram
of a block of texts, ``counts`` the number of postings of every trigram and ``layout`` the
number of blocks in a bucket. A block is a range of keys inside a bucket, ``SearchIndex.BLOCK`` texts on
average: texts share most trigrams with others, so postings of blocks are far fewer than
postings of texts, which would need many times the texts' own size. Buckets are hashes
of the text's key or of the gram, rows of a file are sorted, so a look-up reads a few row groups.
Rows are dealt by a rebalance that Spark splits where a bucket is large: a gram
or a holder that a third of all texts share fills several files and no single task.

A block's trigrams are a superset test, the term itself is then looked for in the
block's texts, so the rows are those of ``panels.search_hits``. A term of fewer than three characters has no
trigram: all texts are read, each once. A text is known by its 128-bit digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.functions import text
from sourceweave.operators import filters
from sourceweave.physical import keyed_join, lookup_side
from sourceweave.session import stored

BUCKETS = 64
#: postings of so many of a term's trigrams are intersected, the rarest ones
RAREST = 4


def record_texts(people: DataFrame, relationships: DataFrame, sources: DataFrame, engagements: DataFrame) -> DataFrame:
    """(ids, kind, hay): what persons are found by; one row per record and kind, blank texts left out.

    Sources that carry their edge's ``people`` are held by these, others are joined to their edge.
    """
    def rows(df: DataFrame, owners: Column, **parts: list[Column]) -> DataFrame:
        each = [F.struct(F.lit(kind[0]).alias("kind"), h.alias("hay")) for kind, hays in parts.items() for h in hays]
        return df.select(owners.alias("ids"), F.explode(F.array(*each)).alias("t")).select("ids", "t.kind", "t.hay").where("hay <> ''")

    def hay(df: DataFrame, *names: str) -> Column:
        return text.haystack(*[F.col(n) if n in df.columns else F.lit(None).cast("string") for n in names])

    name = F.lower(F.concat_ws(" ", "name", F.array_join(F.coalesce("aka", F.array().cast("array<string>")), " "), F.coalesce("sort_name", F.lit(""))))
    own = rows(people, F.array("id"), name=[name], quote=[hay(people, "bio")], other=[hay(people, "bio_note"), hay(people, "roster_note")])
    notes = [hay(relationships, "certainty_reasoning", "date_label", "sources_order_note", "prior_class")]
    if "disputed" in relationships.columns:
        notes.append(text.haystack(*[F.col("disputed")[k] for k in ("claim", "asserted_by", "disputed_by", "grounds")]))
    if "null_findings" in relationships.columns:
        notes.append(text.haystack(F.to_json("null_findings")))
    edge = rows(relationships, F.col("people"), quote=[hay(relationships, "summary")], other=notes)
    said = dict(quote=[hay(sources, "quote", "translation", "context", "supports")],
                other=[text.haystack(F.col("citation_provenance"), F.col("translation_note"), F.col("locator"), F.col("order_hint")["why"])])
    if "people" in sources.columns:
        cited = rows(sources, F.col("people"), **said)
    else:
        each = rows(sources, F.array("owner_id"), **said).distinct().withColumn("id", F.col("ids")[0])
        cited = keyed_join(each.drop("ids"), relationships.select("id", F.col("people").alias("ids")), ["id"]).drop("id")
    told = rows(engagements, F.array("owner_id"), other=[hay(engagements, "subject", "note", "date_label", "period")])
    return own.unionByName(edge).unionByName(cited).unionByName(told)


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _block(per: int) -> Column:
    """The block of a row with ``bucket`` and ``text``: buckets are cut into ``per`` ranges of the digest's first four bytes."""
    first = F.conv(F.hex(F.substring("text", 1, 4)), 16, 10).cast("long")
    return F.col("bucket").cast("long") * per + F.shiftright(first * per, 32)


def grams(hay: Column) -> Column:
    """The different trigrams of a text, by code points; linear in its length."""
    one = F.split(hay, "")
    at = F.when(F.char_length(hay) >= 3, F.sequence(F.lit(0), F.char_length(hay) - 3)).otherwise(F.array().cast("array<int>"))
    # one-element transform: the characters are split once, not once per trigram
    return F.flatten(F.transform(F.array(one), lambda c: F.array_distinct(F.transform(at, lambda i: F.concat(c[i], c[i + 1], c[i + 2])))))


class SearchIndex:
    """An index on disk; written once, read by any number of searches."""

    #: texts that share one list of trigrams, on average
    BLOCK = 2048

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, found_by: DataFrame) -> SearchIndex:
        """Store ``found_by`` (id or ids, kind of n, q or o, hay); its plan is run twice."""
        ids = F.col("ids") if "ids" in found_by.columns else F.array("id")
        keyed = found_by.where("hay <> ''").select(F.unhex(F.md5("hay")).alias("text"), "kind", ids.alias("ids"), "hay")
        # copies of a text leave as one row; min combines before the shuffle. No text is large after that, so it is not dealt again
        self._write(keyed.groupBy("text").agg(F.min("hay").alias("hay")), "texts", "text", deal=False)
        # the persons of a record stay in one row, its text is named once; a record told twice does no harm here
        self._write(keyed.select("text", "kind", "ids"), "holders", "text")
        per = max(1, -(-self.texts().count() // (BUCKETS * self.BLOCK)))
        self.spark.range(1).select(F.lit(per).cast("long").alias("per")).coalesce(1).write.parquet(f"{self.path}/layout")
        told = self.texts().select(_block(per).alias("block"), F.explode(grams(F.col("hay"))).alias("gram"))
        self._write(told.distinct(), "grams", "gram")
        self._read("grams").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/counts")
        return self

    def _write(self, rows: DataFrame, name: str, key: str, deal: bool = True) -> None:
        dealt = rows.withColumn("bucket", _bucket(F.col(key)))
        if deal:
            dealt = dealt.hint("rebalance", F.col("bucket"))
        dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        columns = {"texts": "text binary, hay string", "holders": "text binary, kind string, ids array<string>", "grams": "gram string, block long"}[name]
        return self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.path}/{name}")

    def texts(self) -> DataFrame:
        return self._read("texts")

    def per(self) -> int:
        """Blocks in a bucket."""
        return self.spark.read.schema("per long").parquet(f"{self.path}/layout").first()["per"]

    def postings(self, term: str) -> DataFrame | None:
        """(block): blocks that hold the term's rarest trigrams; None when the term is too short to have one."""
        t = term.strip().lower()
        wanted = sorted({t[i : i + 3] for i in range(len(t) - 2)})
        if not wanted:
            return None
        counts = self.spark.read.schema("gram string, n long").parquet(f"{self.path}/counts").where(F.col("gram").isin(wanted)).collect()  # at most one row per trigram of the term
        rare = [g for _, g in sorted((r["n"], r["gram"]) for r in counts)][:RAREST]
        at = [r[0] for r in self.spark.createDataFrame([(g,) for g in rare], "g string").select(_bucket(F.col("g"))).distinct().collect()]
        found = self._read("grams").where(F.col("bucket").isin(at) & F.col("gram").isin(rare))
        if len(counts) < len(wanted):  # a trigram that no text holds
            return found.where(F.lit(False)).select("block")
        return found.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("block")

    def matching(self, term: str) -> DataFrame:
        """(text): every text that holds the term."""
        named, texts = self.postings(term), self.texts()
        if named is not None:
            per = self.per()
            held = named.select(F.floor(F.col("block") / per).cast("int").alias("bucket"), "block")
            texts = texts.withColumn("block", _block(per)).join(held, ["bucket", "block"], "left_semi")
        return texts.where(F.contains("hay", F.lit(term.strip().lower()))).select("bucket", "text")

    def hits(self, people: DataFrame, term: str, scope: str = "all") -> DataFrame:
        """(id, kind) for every person of ``people``, as ``panels.search_hits`` gives them."""
        if not term.strip():  # the empty term stands in everything, blank texts included
            known = F.col("id").isNotNull()
            return people.select("id", filters.hit_kind(scope, known, known, known).alias("kind"))
        # stored, so that its size is known: holders, by far the larger side, are shuffled only for a term that very many texts hold
        matching = lookup_side(stored(self.matching(term), "matching"))
        found = self._read("holders").join(matching, ["bucket", "text"], "left_semi").select("kind", F.explode("ids").alias("id"))
        kinds = found.groupBy("id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("n", "q", "o")])
        return people.select("id").join(kinds, "id", "left").select("id", filters.hit_kind(scope, F.col("n"), F.col("q"), F.col("o")).alias("kind"))
