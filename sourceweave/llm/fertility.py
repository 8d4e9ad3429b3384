"""Quality rules by tokeniser fertility.

A public vocabulary encodes every word of a text as if it followed a space.
Three measures come out: code points per token, the share of byte-fallback
tokens and the entropy of the text's tokens in bits. A band per language (or,
for a language without one, per script of most of its letters) says what is
acceptable; a text outside is rejected. ``spread_bands`` sets the bands from the
exact quartiles of all documents of a language and length; constants stand in
for groups too small to measure. Plain counts of words, symbols and repetition
stand beside them and reject on their own.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; measures of a text without tokens are null. Rows are judged one by
one, so repeated rows and ties need no rule. Columns of the input other than
the id are carried only when asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import LOWER, SPACE, Roller, chunks, covered, mix, owner, per_doc, ragged, runs

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WINDOW = 5
#: fixed values: characters counted as symbols
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: rejection bands: least and most code points per token, most byte-fallback share, least token entropy in bits.
#: For groups too small for ``spread_bands``: real and invented prose lies inside, base64, random letters and runs of signs do not.
BANDS = {
    "en": (1.65, 7.0, 0.20, 2.6), "de": (1.65, 7.0, 0.20, 2.6), "fr": (1.65, 7.0, 0.20, 2.6), "es": (1.65, 7.0, 0.20, 2.6),
    "latin": (1.0, 7.0, 0.30, 2.4), "greek": (0.5, 5.0, 0.50, 2.4), "cyrillic": (0.7, 6.0, 0.50, 2.4),
    "cjk": (0.2, 3.0, 0.95, 2.4), "other": (0.1, 8.0, 1.0, 2.0),
}
#: measured bands: least documents of a group, quartile distances below the first quartile, least distance as a share of the median,
#: steps of the measures to one, and the place of a group's documents of all lengths
LEAST, REACH, NARROW, STEPS, ALL = 50, 2.0, 0.01, 1000, -1
#: first code point of each stretch and its script; ASCII that is no letter has none
_SCRIPTS = [(0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x370, "greek"), (0x400, "cyrillic"),
            (0x530, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, "other"),
            (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD800, "other"), (0xF900, "cjk"), (0xFB00, "latin"), (0xFB13, "other"),
            (0x20000, "cjk"), (0x40000, "other")]

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
          "chars_per_token double, byte_share double, token_entropy double, base_failed boolean, kept boolean")


def script_of(text: str) -> str:
    """The script of most letters; ``other`` without any."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    at = np.searchsorted([s for s, _ in _SCRIPTS], points, "right")
    names = np.array(["", *[n for _, n in _SCRIPTS]])[at]
    found, counts = np.unique(names[names != ""], return_counts=True)
    return str(found[np.argmax(counts)]) if len(found) else "other"


class Meter:
    """Measures of one chunk of documents."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.hash = Roller(3)

    def tokens(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words one after another, tokens per word); each different word is encoded once."""
        _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = self.sp.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[at].tolist(), e[at].tolist())], num_threads=1)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.int32, int(lens.sum()))
        first = np.concatenate([[0], np.cumsum(lens)])[:-1]
        n = lens[back]
        return flat[ragged(first[back], n)], n

    def measure(self, data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
        docs = len(offs) - 1
        blank = SPACE[data]
        s, e, first = runs(~blank, offs)
        sums = self.hash.sums(data)
        words = self.hash.spans(sums, s, e)
        doc = owner(first)
        out = {"n_words": np.diff(first)}
        points = (data & 0xC0) != 0x80
        out["word_chars"] = per_doc(points & ~blank, offs)
        out["n_symbols"] = per_doc(SYMBOLS[data], offs)
        # lines: runs of bytes other than the line feed; an empty line has no word and never counts
        ls, le, lfirst = runs(data != 10, offs)
        solid = np.concatenate([[0], np.cumsum(~blank)])
        has = solid[le] > solid[ls]
        ldoc = owner(lfirst)[has]
        line = mix(self.hash.spans(sums, ls[has], le[has]) ^ mix(ldoc.astype(np.uint64)))
        lines = np.bincount(ldoc, minlength=docs)
        _, where = np.unique(line, return_index=True)
        out["n_dup_lines"] = lines - np.bincount(ldoc[where], minlength=docs)
        # windows of words that stand twice or more in the text
        out["n_repeat_words"] = np.zeros(docs, np.int64)
        if len(words) >= WINDOW:
            gram = words[: len(words) - WINDOW + 1].copy()
            for k in range(1, WINDOW):
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - WINDOW + 1 + k]
            ok = np.flatnonzero(doc[: len(gram)] == doc[WINDOW - 1 :])
            key = mix(gram[ok] ^ mix(doc[ok].astype(np.uint64)))
            _, back, n = np.unique(key, return_inverse=True, return_counts=True)
            twice = ok[n[back] > 1]
            out["n_repeat_words"] = per_doc(covered(twice, twice + WINDOW, len(words)), first)
        ids, n = self.tokens(data, s, e, words)
        tfirst = np.concatenate([[0], np.cumsum(n)])[first]
        total = np.diff(tfirst)
        out["n_tokens"] = total
        some = np.maximum(total, 1)
        out["chars_per_token"] = out["word_chars"] / some
        out["byte_share"] = per_doc(self.is_byte[ids], tfirst) / some
        key, count = np.unique(owner(tfirst) * np.int64(len(self.is_byte)) + ids, return_counts=True)
        kdoc = key // len(self.is_byte)
        p = count / some[kdoc]
        out["token_entropy"] = np.abs(np.bincount(kdoc, weights=-p * np.log2(p), minlength=docs))
        return out


def judge(out: dict[str, np.ndarray], bands: np.ndarray, min_words: int, repeat_percent: int) -> None:
    """Adds base_failed and kept; ``bands`` holds a row of four limits per document."""
    out["base_failed"] = base_failed(out, min_words, repeat_percent)
    low, high, byte, entropy = bands.T
    inside = (out["chars_per_token"] >= low) & (out["chars_per_token"] <= high) & (out["byte_share"] <= byte) & (out["token_entropy"] >= entropy)
    out["kept"] = ~out["base_failed"] & (out["n_tokens"] > 0) & inside


def octaves(tokens: np.ndarray) -> np.ndarray:
    """Length classes: the power of two below the number of tokens; entropy and its spread follow the length."""
    return np.frexp(np.maximum(tokens, 1).astype(float))[1] - 1


def base_failed(out: dict[str, np.ndarray], min_words: int, repeat_percent: int) -> np.ndarray:
    return (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > repeat_percent * out["n_words"])


def spread_bands(docs: DataFrame, text: str = "text", lang: str | None = "lang", vocabulary: str = VOCABULARY,
                 min_words: int = 10, repeat_percent: int = 20) -> dict:
    """Bands of ``quality`` from all documents that pass the base rule, by (language or script, length class).

    The quartiles are exact on measures rounded to a thousandth. Least code points per token and least entropy lie
    ``REACH`` quartile distances below the first quartile, never below the constant band; over all lengths of a group the
    entropy reaches twice as far. Tasks hand on counts of rounded measures, so what is shuffled and collected follows the
    number of groups and not the number of documents.
    """
    src = docs.select(F.col(text).cast("string").alias("__text"), (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("__lang"))

    def batch_of(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        cols = [pa.array([k[0] for k in keys], pa.string()), *[pa.array([k[j] for k in keys], pa.int32()) for j in (1, 2, 3)], pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["name", "octave", "measure", "step", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter, counts = Meter(vocabulary), Counter()
        for batch in batches:
            col, langs = batch.column("__text"), batch.column("__lang").to_pylist()
            for lo, hi, data, offs in chunks(col):
                out = meter.measure(data, offs)
                steps = [np.rint(out[k] * STEPS).astype(int).tolist() for k in ("chars_per_token", "token_entropy")]
                octave = octaves(out["n_tokens"]).tolist()
                for i in np.flatnonzero(~base_failed(out, min_words, repeat_percent) & (out["n_tokens"] > 0)).tolist():
                    names = {langs[lo + i]} - {None}
                    if langs[lo + i] not in BANDS:
                        names.add(script_of(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
                    counts.update((name, o, m, steps[m][i]) for name in names for o in (octave[i], ALL) for m in (0, 1))
                if len(counts) > 100_000:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    counted = src.mapInArrow(work, "name string, octave int, measure int, step int, n long")
    spread = counted.groupBy("name", "octave", "measure").agg(F.sum("n").alias("n"), F.expr("percentile(step, array(0.25, 0.5, 0.75), n)").alias("q")).where(F.col("n") >= LEAST)
    floors = {}
    for r in spread.collect():
        first, median, third = r.q
        reach = REACH * 2 if r.octave == ALL and r.measure == 1 else REACH
        floors[r["name"], r.octave, r.measure] = (first - reach * max(third - first, NARROW * median)) / STEPS
    bands = {}
    for name, octave, _ in floors:
        low, high, byte, entropy = BANDS.get(name, BANDS["other"])
        bands[name, octave] = (max(low, floors[name, octave, 0]), high, byte, max(entropy, floors[name, octave, 1]))
    return bands


def quality(docs: DataFrame, text: str = "text", lang: str | None = "lang", carry: tuple[str, ...] = ("doc_id",),
            vocabulary: str = VOCABULARY, bands: dict | None = None, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """``carry`` columns and the measures and verdicts of every row; no shuffle.

    ``vocabulary`` is a SentencePiece model with byte fallback, present on every
    executor. ``bands`` overrides or extends the default bands by language or script; bands by (language or script, length
    class), as ``spread_bands`` gives them, go first.
    """
    table = BANDS | (bands or {})
    src = docs.select(*carry, F.col(text).cast("string").alias("__text"), (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("__lang"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) + ", " + RESULT

    def band_of(name: str | None, octave: int) -> tuple | None:
        return table.get((name, octave)) or table.get((name, ALL)) or table.get(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(vocabulary)
        for batch in batches:
            col, langs = batch.column("__text"), batch.column("__lang").to_pylist()
            for lo, hi, data, offs in chunks(col):
                out = meter.measure(data, offs)
                octave = octaves(out["n_tokens"]).tolist()
                rows = []
                for i in range(lo, hi):
                    band = band_of(langs[i], octave[i - lo])
                    if not band:
                        script = script_of(data[offs[i - lo] : offs[i - lo + 1]].tobytes().decode("utf-8", "replace"))
                        band = band_of(script, octave[i - lo])
                    rows.append(band)
                judge(out, np.array(rows, float), min_words, repeat_percent)
                empty = out["n_tokens"] == 0
                cols = [batch.column(c).slice(lo, hi - lo) for c in carry]
                for name in RESULT.split(", "):
                    name = name.split()[0]
                    null = empty if name in ("chars_per_token", "byte_share", "token_entropy") else None
                    cols.append(pa.array(out[name], mask=null))
                yield pa.RecordBatch.from_arrays(cols, names=[*carry, *[x.split()[0] for x in RESULT.split(", ")]])

    return src.mapInArrow(work, schema)
