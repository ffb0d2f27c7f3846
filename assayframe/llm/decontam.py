"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Documents and items are compared as lower-case words without ASCII punctuation. First pass: how many documents have each n-gram of the
benchmark. Seeds are the rare ones, and in each stretch of an item the rarest that occurs at all, so that an item has
seeds all along it even if many documents copy it. An item shorter than an n-gram is a seed as a whole. Second pass: where a document has a seed, the words around it are
aligned with the item; edits, omissions and insertions cost a little each and don't end the alignment.

Copies of an item raise the counts of its n-grams, and n-grams that edited copies lack have lower counts than those they keep. So documents that
aligned are taken out of the item's counts, and the n-grams that are rare, or the rarest of their stretch, in what is left are the seeds of a further
pass, until there are none. A stretch has four n-grams, so this ends after as many passes; an item that few documents copy needs the first only.

Each pass reads the documents once, however large the benchmark is: n-grams and seeds meet them by joins. Before these a filter of bounded size, a
bit table of the benchmark's n-grams, drops nearly all n-grams of the corpus (with a benchmark far beyond its size it drops fewer,
and the joins get larger). Only documents with a seed are shuffled as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, record_batch, table
from .windows import Words, blocks

GRAM = 3
#: An n-gram in at most so many documents, or in at most this share of them, is rare.
RARE, RARE_SHARE = 20, 1e-5
#: Of each stretch of so many n-grams of an item, the rarest that occurs is a seed in any case.
STRETCH = 4
#: Bits of the filter: sixteen for each n-gram, within these bounds.
LEAST_BITS, MOST_BITS = 20, 27
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of the item's own, and least number of points; what aligns in so many points is a leak of any item.
LEAST_SHARE, LEAST_SCORE, LONG_SCORE = 0.5, 12, 40

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalized(text: str) -> bytes:
    return (text if text.isascii() else text.lower()).encode().translate(_FOLD)


def _as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _grams(words: Words, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place among all words, hash) of the n-grams of each width."""
    for width in widths:
        gram, whole = words.grams(width)
        at = np.flatnonzero(whole)
        yield at, gram[at]


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item, item_key): the different items that have a text, with or without an id, of whatever type."""
    item_id, text = benchmark[item_col], benchmark[text_col].cast("string")
    return benchmark.select(item_id.alias("item_id"), text.alias("item"), F.xxhash64(item_id.cast("string"), text).alias("item_key")).where("item is not null").dropDuplicates(["item_key"])


def _item_grams(words: Words, text: int = 0) -> np.ndarray:
    """The n-grams of one of the texts; of fewer words than GRAM, all of them as one; of none, none."""
    width = min(GRAM, int(words.count[text]))
    if not width:
        return np.empty(0, np.uint64)
    ((at, gram),) = _grams(words, [width])
    return gram[words.text[at] == text]


def benchmark_grams(items: DataFrame) -> DataFrame:
    """(item_key, place, gram, width) of each item; one of fewer words than GRAM is a gram of its own width, one without words has none."""
    bounded_batches(items.sparkSession)
    schema = pa.schema([("item_key", pa.int64()), ("place", pa.int64()), ("gram", pa.int64()), ("width", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = Words([normalized(text.as_py())])
                gram = _item_grams(words)
                yield record_batch(schema, [[key.as_py()] * len(gram), np.arange(len(gram)), _as_signed(gram), np.full(len(gram), min(GRAM, int(words.count[0])))])

    return items.select("item_key", "item").mapInArrow(run, "item_key long, place long, gram long, width long")


class GramFilter:
    """A bit table of 64-bit hashes, made by Spark and broadcast: tells which hashes are certainly not among them."""

    def __init__(self, grams: DataFrame):
        n = grams.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
        self.widths = sorted(r.width for r in grams.select("width").distinct().collect())
        mask = (1 << self.bits) - 1
        places = F.array(F.col("gram").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(mask)))
        put = grams.select(F.explode(places).alias("at")).groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        words = np.zeros(1 << (self.bits - 6), np.uint64)
        found = put.toArrow()  # one row at most for each word of the table
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.table = grams.sparkSession.sparkContext.broadcast(words)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        table, mask = self.table.value, np.uint64((1 << self.bits) - 1)
        has = lambda at: (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        out = np.flatnonzero(has(hashes & mask))
        return out[has(hashes[out] >> np.uint64(32) & mask)]


def _hits(texts: list[bytes], known: GramFilter) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """(number of the first text, words, places among them, n-grams that the filter lets through), a block of texts at a time."""
    for first, end in blocks(texts) if known.widths else ():
        words = Words(texts[first:end])
        parts = [(at[keep], gram[keep]) for at, gram in _grams(words, known.widths) for keep in [known.may_have(gram)]]
        yield first, words, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _document_counts(docs: DataFrame, known: GramFilter) -> DataFrame:
    """(gram, n_docs) of n-grams that the filter lets through; docs (text)."""
    schema = pa.schema([("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, at, gram in _hits([normalized(t.as_py()) for t in batch.column(0)], known):
                pairs = np.unique(np.column_stack([words.text[at].astype(np.uint64), gram]), axis=0)
                yield record_batch(schema, [_as_signed(np.ascontiguousarray(pairs[:, 1]))])

    return docs.select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n_docs"))


_HITS = "hits array<struct<gram:long,at:long>>"


def _with_hits(own: DataFrame, known: GramFilter) -> DataFrame:
    """The documents of own (doc_id, row_key, text) that may have a seed, with `hits`: n-grams and the words where they begin."""
    hit = pa.struct([("gram", pa.int64()), ("at", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("text", pa.string()), ("hits", pa.list_(hit))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = [], []
            for first, words, at, gram in _hits([normalized(t.as_py()) for t in batch.column(2)], known):
                text, place, gram = words.text[at], words.place[at], _as_signed(gram)
                for t in np.unique(text).tolist():
                    mine = text == t
                    rows.append(first + t)
                    lists.append(pa.StructArray.from_arrays([pa.array(gram[mine]), pa.array(place[mine])], names=["gram", "at"]))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = pa.concat_arrays(lists) if lists else pa.array([], hit)
            yield record_batch(schema, [*(batch.column(i).take(pa.array(rows, pa.int64())) for i in range(3)), pa.ListArray.from_arrays(sizes, values)])

    return own.mapInArrow(run, f"doc_id long, row_key long, text string, {_HITS}")


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(best local score, where in window it ends) under MATCH, MISMATCH and GAP."""
    slope = -GAP * np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    best, at = 0, 0
    for word in item:
        nxt = np.maximum(row + GAP, 0)
        nxt[1:] = np.maximum(nxt[1:], row[:-1] + np.where(window == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(nxt + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top
    return best, at


def least_score(m: int, least_share: float) -> float:
    """Points from which an alignment with an item of m words counts; a very short item must be there as it is."""
    return min(max(least_share * MATCH * m, min(LEAST_SCORE, MATCH * m)), LONG_SCORE)


def _best(item: np.ndarray, words: np.ndarray, offsets: list[int], least: float, scores: dict) -> tuple[int, int, int]:
    """(score, first word, end word) of the best alignment of item near the given places of its first word, zeros if none reaches least."""
    m, best = len(item), (0, 0, 0)
    spans: list[list[int]] = []
    for o in sorted(offsets):
        a, b = max(0, o - m // 2), min(len(words), o + m + m // 2)
        if spans and a <= spans[-1][1] and b - spans[-1][0] <= 8 * m:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    for a, b in spans:
        window = words[a:b]
        if MATCH * int(np.isin(item, window).sum()) < least:
            continue
        key = (item.tobytes(), window.tobytes())
        if key not in scores:
            scores[key] = smith_waterman(item, window)
        score, end = scores[key]
        if score > best[0]:
            best = (score, a, a + end)
    return best if best[0] >= least else (0, 0, 0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, row_key, item_id, score, share, first_word, end_word): each document and item that align, at their best place.

    share is the score over the item's score with itself. An alignment counts from least_share of that on (but from LEAST_SCORE points, or all of a
    shorter item), and in any case from LONG_SCORE points. row_key is a hash of id and text. Null or empty texts and items match
    nothing. Items with a null id are looked for like others; item ids are of any type and kept as they are, document ids are whole numbers. Items with one
    id and different texts are each looked for. Repeated rows are each reported. Empty tables give an empty result; other columns, whatever their
    names, are ignored. Long texts are hashed a block at a time; around seeds only, words are aligned.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), row_key(docs[id_col], docs[text_col]).alias("row_key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    items = table(benchmark_items(benchmark, item_col, item_text_col), "items")
    grams = table(benchmark_grams(items), "grams")
    counted = table(grams.join(_document_counts(own, GramFilter(grams.select("gram", "width"))), "gram"), "gram_counts")
    rare = max(float(RARE), RARE_SHARE * own.count())
    used, found, rest = None, None, counted.withColumn("n_rest", F.col("n_docs"))
    while True:
        seeds = table(_seeds(rest, used, rare), "seeds")
        if seeds.isEmpty():
            break
        more = table(_leaks_at(own, items, seeds, found, least_share), "leaks_of_a_pass")
        used = seeds if used is None else used.unionAll(seeds)
        found = more if found is None else found.unionAll(more)
        held = found.select("item_key", F.explode("held").alias("gram")).groupBy("item_key", "gram").agg(F.count("*").alias("n_found"))
        rest = counted.join(held, ["item_key", "gram"], "left").withColumn("n_rest", F.col("n_docs") - F.coalesce("n_found", F.lit(0)))
    if found is None:
        found = spark.createDataFrame([], LEAKS)
    return found.join(items.select("item_key", "item_id"), "item_key").select("doc_id", "row_key", "item_id", "score", "share", "first_word", "end_word")


def _seeds(rest: DataFrame, used: DataFrame | None, rare: float) -> DataFrame:
    """(item_key, place, gram, width): n-grams that n_rest documents have and that are rare, or the rarest of their stretch, without those that were seeds before."""
    occurring = rest.where("n_rest > 0").withColumn("least", F.min("n_rest").over(Window.partitionBy("item_key", F.floor(F.col("place") / STRETCH))))
    seeds = occurring.where((F.col("n_rest") <= rare) | (F.col("n_rest") == F.col("least"))).select("item_key", "place", "gram", "width")
    return seeds if used is None else seeds.join(used.select("item_key", "gram"), ["item_key", "gram"], "left_anti").select("item_key", "place", "gram", "width")


def _leaks_at(own: DataFrame, items: DataFrame, seeds: DataFrame, found: DataFrame | None, least_share: float) -> DataFrame:
    """The leaks that align around these seeds, without pairs found before."""
    hit = table(_with_hits(own, GramFilter(seeds.select("gram", "width"))), "hits")
    met = hit.select("doc_id", "row_key", F.explode("hits").alias("h")).select("doc_id", "row_key", "h.*").distinct().join(seeds, "gram")
    pairs = met.groupBy("doc_id", "row_key", "item_key").agg(F.collect_set(F.col("at") - F.col("place")).alias("offsets"))
    if found is not None:
        pairs = pairs.join(found.select("row_key", "item_key").distinct(), ["row_key", "item_key"], "left_anti")
    wanted = pairs.join(items.select("item_key", "item"), "item_key").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("item_key", "item", "offsets")).alias("items"))
    return _aligned(hit.select("doc_id", "row_key", "text"), wanted, least_share)


#: held: the item's n-grams that the document has anywhere.
LEAKS = "doc_id long, row_key long, item_key long, score long, share double, first_word long, end_word long, held array<long>"


def _aligned(hit: DataFrame, wanted: DataFrame, least_share: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("item_key", pa.int64()), ("score", pa.int64()), ("share", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("held", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, scores, items = [], {}, {}
            for k in range(batch.num_rows):
                words = Words([normalized(batch.column(2)[k].as_py())])
                grams: dict[int, np.ndarray] = {}
                for w in batch.column(3)[k].as_py():
                    if w["item_key"] not in items:
                        own = Words([normalized(w["item"])])
                        items[w["item_key"]] = own.hash, np.unique(_item_grams(own))
                    item, held = items[w["item_key"]]
                    score, a, b = _best(item, words.hash, w["offsets"], least_score(len(item), least_share), scores)
                    if score:
                        width = min(GRAM, len(item))
                        if width not in grams:
                            ((_, gram),) = _grams(words, [width])
                            grams[width] = np.unique(gram)
                        held = _as_signed(held[np.isin(held, grams[width])])
                        rows.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), w["item_key"], score, score / (MATCH * len(item)), a, b, held))
            yield record_batch(schema, list(zip(*rows, strict=True)) or [[]] * len(schema))

    other = wanted.select(F.col("doc_id").alias("of"), F.col("row_key").alias("key"), "items")
    joined = hit.join(other, hit["doc_id"].eqNullSafe(other["of"]) & (hit["row_key"] == other["key"]))
    return joined.select("doc_id", "row_key", "text", "items").mapInArrow(run, LEAKS)


def row_key(id_col: Column, text_col: Column) -> Column:
    return F.xxhash64(id_col.cast("long"), F.coalesce(text_col.cast("string"), F.lit("")))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item was found, with the columns of docs. Cases are those of find_leaks(); columns of any name are handed through."""
    found = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("of"), "row_key").distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].cast("long").alias("id"), row_key(docs[id_col], docs[text_col]).alias("key"))
    leaks = table(found, "leaks")
    return keyed.join(leaks, keyed["id"].eqNullSafe(leaks["of"]) & (keyed["key"] == leaks["row_key"]), "left_anti").select("doc.*")
