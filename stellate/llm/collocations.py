"""Phrase collocation mining: n-grams exploded into rows and counted per language, scored by their best-known cut, freed of parts of longer phrases.

Tasks cut texts into pieces and words as arrays of bytes and emit (lang, phrase, n) rows of a batch's n-grams; Spark adds them up by
language and phrase. A phrase can't be more frequent than any part of it, so n-grams with a word, a pair or a triple below the least count can
never become candidates nor a candidate's part, and aren't exploded. Words are counted by their text first. Pairs and then triples, most of them
rare, are counted by a bucket of their hash, which is a short number and not a text; a phrase isn't more frequent than its bucket. Then pairs and all
longer phrases that may still be frequent are counted by their text.
Which words, pairs and triples may be frequent travels as a bitmap of their hashes, of a fixed size whatever the corpus: a false hit makes a row that the exact
count drops again, so a bitmap that fills up costs rows and changes no result. Candidates then meet the counts of their first and last
words by joins, are scored in Decimal, lose those that a one word longer phrase explains (a longer explanation always
has one of those inside), and are ranked by a window per language.

Defined results: a null lang is `und`; null and empty texts and pieces without words give nothing; equal rows count each; words keep
their case but for A-Z; counts are exact as longs, products as decimals; a language without candidates has no rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, importable, lean, release, table, written

#: Words of a phrase, occurrences of a candidate, percentage of occurrences that a longer phrase must explain, phrases of a language.
MAX_N, LEAST, EXPLAINED, KEPT = 4, 30, 80, 2000
#: Bits of a bitmap (8 MB), and bytes of the texts that a task cuts up at a time.
BITS, TEXT_BYTES = 1 << 26, 2 << 20
#: Buckets that pairs and triples are counted in.
BUCKETS = 1 << 31
#: Bits of one row of Spark's bitmap functions.
ROW_BITS = 1 << 15
GRAMS = "lang string, phrase string, size int, n long"


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each different word is hashed once."""
    coded = words.dictionary_encode()
    known = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(coded.dictionary) else np.empty(0, np.uint64)
    return known[coded.indices.to_numpy()]


def _mixed(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (state ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _buckets(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Which bucket a phrase is counted in."""
    x = lang
    for w in words:
        x = _mixed(x, w)
    return (x >> np.uint64(7)) % np.uint64(BUCKETS)


def _places(lang: np.ndarray, words: list[np.ndarray], bits: int) -> np.ndarray:
    """Where a phrase is in a bitmap of so many bits: where its bucket is."""
    return _buckets(lang, words) % np.uint64(bits)


def _held(bitmap: np.ndarray, lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    at = _places(lang, words, 8 * len(bitmap))
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


#: What a byte of UTF-8 is: part of a word (0), a blank between words (1) or the end of a piece (2); and the byte with A-Z lower-cased.
KIND, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
KIND[[*b" \t"]], KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 1, 2
LOWER[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order, the number of each one's piece, and of its text (large strings without nulls)."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    begins = ends[:-1] - ends[0]
    kind = KIND[raw]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins_full = begins[begins < len(raw)]
    first[begins_full] = word[begins_full]  # texts lie side by side
    ended = (kind == 2).astype(np.int32)
    ended[begins_full] += 1
    at = np.flatnonzero(first)
    offsets = np.append(np.flatnonzero(first[word]), int(word.sum())).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[word]])])
    return words, np.cumsum(ended, dtype=np.int32)[at], np.searchsorted(begins, at, "right") - 1


def _batches(frames: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """lang and text by about `size` bytes; a longer text comes alone."""
    for frame in frames:
        frame = frame.filter(pc.is_valid(frame["text"]))
        lang, text = pc.fill_null(frame["lang"], "und"), frame["text"].cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)) if len(text) else np.empty(0, np.int64)
        at = 0
        while at < len(text):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield lang[at:to], text[at:to]
            at = to


def _grams(frames: Iterator[pa.RecordBatch], sizes: range, known: Sequence[np.ndarray | None], size: int) -> Iterator[tuple]:
    """n, the languages, each word's language, the words, their hashes, their languages' hashes, and where n-grams begin, for each batch of texts and each of the sizes;
    without n-grams that hold a phrase of k words that the k-th bitmap in known doesn't hold."""
    for lang, text in _batches(frames, size):
        words, piece, of = words_of(text)
        if not len(words):
            continue
        langs = lang.dictionary_encode()
        lang_of = langs.indices.to_numpy()[of]
        h, seed = _hashes(words), _hashes(langs.dictionary)[lang_of]
        may = np.ones(len(words), bool)  # an n-gram of n words begins here, and may be frequent
        for n in range(1, sizes.stop):
            if n > 1:
                may[:-1] &= may[1:] if n > 2 else may[1:] & (piece[1:] == piece[:-1])
                may[-1] = False
            at = np.flatnonzero(may)
            if n <= len(known) and known[n - 1] is not None:
                may[at] = _held(known[n - 1], seed[at], [h[at + k] for k in range(n)])
                at = at[may[at]]
            if n in sizes and len(at):
                yield n, langs, lang_of, words, h, seed, at
        del words, piece, of, h, seed, may, at, lang_of
        release()


@lean
def _exploded(frames: Iterator[pa.RecordBatch], sizes: range, words_known: np.ndarray | None, pairs_known: np.ndarray | None, size: int, triples_known: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """n-grams of the sizes with their number in a batch of texts, but for those that hold an infrequent word, pair or triple."""
    for n, langs, lang_of, words, _, _, at in _grams(frames, sizes, (words_known, pairs_known, triples_known), size):
        phrase = words.take(pa.array(at)) if n == 1 else pc.binary_join_element_wise(*[words.take(pa.array(at + k)) for k in range(n)], pa.scalar(" ", words.type))
        counted = pa.table({"lang": pa.array(lang_of[at]), "phrase": phrase}).group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
        counted = pa.table({"lang": langs.dictionary.take(counted["lang"].combine_chunks()), "phrase": counted["phrase"].cast(pa.string()), "size": pa.array(np.full(len(counted), n, np.int32)), "n": counted["count_all"]})
        yield from counted.to_batches(max_chunksize=1 << 16)


def counts(docs: DataFrame, sizes: range, words_known: np.ndarray | None = None, pairs_known: np.ndarray | None = None, text_bytes: int = TEXT_BYTES, triples_known: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, size, n: occurrences of the n-grams of some sizes; docs: lang, text."""
    sent = docs.sparkSession.sparkContext.broadcast((words_known, pairs_known, triples_known))

    def exploded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, triples = sent.value
        return _exploded(frames, sizes, words, pairs, text_bytes, triples)

    return docs.select("lang", "text").mapInArrow(exploded, GRAMS).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


@lean
def _counted_buckets(frames: Iterator[pa.RecordBatch], n: int, known: Sequence[np.ndarray | None], size: int) -> Iterator[pa.RecordBatch]:
    for _, _, _, _, h, seed, at in _grams(frames, range(n, n + 1), known, size):
        buckets, times = np.unique(_buckets(seed[at], [h[at + k] for k in range(n)]).astype(np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(times)], ["at", "n"])


def buckets(docs: DataFrame, n: int, least: int, known: Sequence[np.ndarray | None] = (), text_bytes: int = TEXT_BYTES) -> DataFrame:
    """at: the buckets with so many n-grams at least, by bitmaps in known of words, pairs and so on."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(known))
    rows = docs.select("lang", "text").mapInArrow(lambda f: _counted_buckets(f, n, sent.value, text_bytes), "at int, n long")
    return rows.groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("at")


@lean
def _placed(frames: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        if frame.num_rows:
            words = pc.split_pattern(frame["phrase"], " ")
            flat, starts = _hashes(pc.list_flatten(words)), words.offsets.to_numpy()[:-1] - words.offsets.to_numpy()[0]
            size = len(flat) // frame.num_rows  # all phrases have as many words
            yield pa.RecordBatch.from_arrays([pa.array(_places(_hashes(frame["lang"]), [flat[starts + k] for k in range(size)], bits).astype(np.int64))], ["at"])


def bitmap(grams: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of phrases of one size (lang, phrase), or of their buckets (at): a byte for each 8 bits."""
    at = grams.select((F.col("at") % bits).alias("at")) if "at" in grams.columns else grams.select("lang", "phrase").mapInArrow(lambda f: _placed(f, bits), "at long")
    row, bit = F.floor(F.col("at") / ROW_BITS), (F.col("at") % ROW_BITS).cast("long")
    out = np.zeros(bits // 8, np.uint8)
    for r in at.groupBy(row.alias("row")).agg(F.bitmap_construct_agg(bit).alias("bits")).toLocalIterator():  # at most bits / ROW_BITS rows
        out[r.row * ROW_BITS // 8 : (r.row + 1) * ROW_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _scored(known: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of candidates: the cut of the lowest score, ties to the shortest first part."""
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = known.where("size > 1").withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    firsts, rests = (known.select("lang", F.col("phrase").alias(c), F.col("n").alias(v)) for c, v in (("first", "l"), ("rest", "r")))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).withColumns({"_top": F.lit(2_000_000).cast("decimal(7,0)") * big("a"), "_sum": big("l") + big("r")})
    best = F.min(F.struct(F.expr("_top div _sum").alias("score"), "k", "l", "r")).alias("m")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, explained: int = EXPLAINED, kept: int = KEPT, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs (lang, text)."""
    importable(docs.sparkSession)
    words = written(counts(docs, range(1, 2)), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))  # a row for each language
    frequent = words.where(F.col("n") >= least)
    words_known = bitmap(frequent, bits)
    pairs = written(buckets(docs, 2, least), "pairs")  # of all words: with more data nearly all pairs are of frequent words, and passing over the others saves little
    pairs_known, triples, triples_known = bitmap(pairs, bits), None, None
    if max_n > 2:
        triples = written(buckets(docs, 3, least, (words_known, pairs_known)), "triples")
        triples_known = bitmap(triples, bits)
    discard(pairs, triples)
    longer = counts(docs, range(2, max_n + 1), None, pairs_known, triples_known=triples_known).where(F.col("n") >= least)
    known = written(frequent.unionByName(longer), "phrases")
    scored = _scored(known)
    wide = known.where("size > 2").withColumn("words", F.split("phrase", " "))
    inner = F.array(*[F.array_join(F.slice("words", F.lit(s), F.col("size") - 1), " ") for s in (1, 2)])
    over = wide.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("b"))
    hundredths = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")
    own = scored.join(over, ["lang", "phrase"], "left").where(F.col("b").isNull() | (hundredths("b", 100) < hundredths("a", explained)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, s.k AS size, unnest(list_transform(range(1, len(ws) - s.k + 2), lambda i: array_to_string(list_slice(ws, i, i + s.k - 1), ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(ws) >= s.k
), f AS (
  SELECT lang, phrase, size, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, phrase, size
), t AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), k AS (SELECT * FROM f WHERE a >= 30), c AS (
  SELECT k.*, x.k, array_to_string(list_slice(ws, 1, x.k), ' ') AS first, array_to_string(list_slice(ws, x.k + 1, size), ' ') AS rest FROM k, (VALUES (1), (2), (3)) x(k) WHERE x.k < size
), s AS (
  SELECT c.lang, c.phrase, c.size, c.a, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (l.a + r.a) AS BIGINT) AS score, c.k
  FROM c JOIN k l ON l.lang = c.lang AND l.phrase = c.first JOIN k r ON r.lang = c.lang AND r.phrase = c.rest
), b AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s) WHERE cut = 1
), x AS (
  SELECT lang, array_to_string(list_slice(ws, 1, size - 1), ' ') AS phrase, a FROM k WHERE size > 2
  UNION ALL SELECT lang, array_to_string(list_slice(ws, 2, size), ' '), a FROM k WHERE size > 2
), o AS (SELECT lang, phrase, max(a) AS longest FROM x GROUP BY lang, phrase), z AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longest IS NULL OR 100 * longest < 80 * b.a
)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000
"""
