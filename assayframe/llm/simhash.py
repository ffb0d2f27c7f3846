"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance.

A 64-bit fingerprint is cut into `max_bits + agree` blocks. Two fingerprints that differ in at most `max_bits` bits
agree in `agree` whole blocks at least, so every close pair shares a row of the join key (choice of blocks, their bits). With
more blocks to agree in, keys are longer and buckets smaller, but each fingerprint has more keys.
Equal fingerprints count once from the start, so a group of exact copies is one row here.

A bucket of the join yields a spanning forest of its links, not all pairs. A bucket with more than
`TILE` fingerprints is cut further: those of its bits that are not in the key become blocks again, of which a close pair agrees in
`FURTHER` more. A finer bucket that is still too large is dealt out over tiles: its fingerprints fall into chunks, and each pair of chunks is a task's
group of bounded size. All links of a large bucket are still found, and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import bounded_batches, durable, id_and_text, record_batch, table, text_bytes
from .components import connected_components

SEED = 42
TILE = 2048
#: Blocks to agree in besides, inside a large bucket.
FURTHER = 3
#: Buckets up to this size are compared by shifting the whole sorted column.
SMALL = 8


def fingerprint(texts: list[bytes], width: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text; zero for a text without words."""
    digests, counts = [], []
    hash_of = xxhash.xxh64_digest
    for text in texts:
        words = text.lower().split()  # of bytes: both know ASCII only
        n = max(1, len(words) - width + 1) if words else 0
        counts.append(n)
        if n == 1:
            digests.append(hash_of(b" ".join(words), SEED))
        elif n:
            joined = b" ".join(words)
            starts = [0] * (len(words) + 1)
            at = 0
            for i, word in enumerate(words):
                at += len(word) + 1
                starts[i + 1] = at
            digests += [hash_of(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)]
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array(counts, np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for i, (end, n) in enumerate(zip(ends.tolist(), counts, strict=True)):
        total = np.zeros(64, np.int64)
        for at in range(end - n, end, 1 << 16):
            total += np.unpackbits(data[at : min(end, at + (1 << 16))], axis=1).sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * total > n].sum() if n else 0
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, signed: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long; with signed, also sig, the MinHash signature. Rows keep their order and number; extra columns are ignored."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())] + [("sig", pa.binary())] * signed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(text_bytes(batch.column(2)))
            fp = fingerprint(texts, width).view(np.int64)
            yield record_batch(schema, [batch.column(0), batch.column(1), fp] + ([minhash.signatures(texts, width)] if signed else []))

    hashed = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(run, "doc_id long, text_hash long, fp long" + ", sig binary" * signed)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _choices(bits: list[int], max_bits: int, agree: int) -> list[int]:
    """The given bits (places) in max_bits + agree blocks: a mask for each choice of `agree` of these."""
    n = max_bits + agree
    cuts = [len(bits) * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in bits[a:c]) for a, c in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def block_masks(max_bits: int, agree: int = 2) -> list[int]:
    """A mask for each choice of `agree` blocks out of max_bits + agree, as signed 64-bit integers."""
    return [_signed(m) for m in _choices(list(range(64)), max_bits, agree)]


def finer_masks(max_bits: int, agree: int = 2) -> list[list[int]]:
    """For each mask of block_masks() the masks that cut its large buckets further, all of its bits included."""
    return [[_signed(m | more) for more in _choices([b for b in range(64) if not m >> b & 1], max_bits, FURTHER)] for m in _choices(list(range(64)), max_bits, agree)]


def _forest(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Links that connect what is connected at max_bits or fewer; a breadth-first search over what is not yet reached."""
    rest, links = fps, []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                links.append(np.column_stack([np.full(len(found), x), found]))
                todo.extend(found)
    return links


def _bucket_links(group: np.ndarray, fps: np.ndarray, max_bits: int) -> np.ndarray:
    """group: ascending ids of buckets, fps: their fingerprints."""
    edge = np.flatnonzero(np.diff(group)) + 1
    starts = np.concatenate([[0], edge])
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    links = []
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, SMALL):
        if len(group) <= d:
            break
        a = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        x, y = fps[a], fps[a + d]
        close = np.bitwise_count(x ^ y) <= max_bits
        links.append(np.column_stack([x[close], y[close]]))
    for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        links += _forest(fps[at : at + n], max_bits)
    return np.concatenate(links) if links else np.empty((0, 2), np.uint64)


def close_links(distinct: DataFrame, max_bits: int, agree: int = 2) -> DataFrame:
    """distinct (fp): links (a, b) that connect all fingerprints at max_bits or fewer, through others if need be."""
    masks, finer = block_masks(max_bits, agree), finer_masks(max_bits, agree)
    key = lambda i, m: F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
    rows = distinct.select("fp", F.explode(F.array(*[key(i, m) for i, m in enumerate(masks)])).alias("k")).select("k.pair", "k.bits", "fp")
    whole = lambda df: df.select("pair", "bits", F.lit(0).alias("t0"), F.lit(0).alias("t1"), "fp")
    # Written, as are the finer ones: buckets are counted once, and where few are large the rows meet them without a shuffle.
    large = table(rows.groupBy("pair", "bits").count().where(F.col("count") > TILE).select("pair", "bits"), "large")
    if large.isEmpty():
        tiled = whole(rows)
    else:
        dealt = rows.join(large.withColumn("large", F.lit(True)), ["pair", "bits"], "left")
        of_pair = F.get(F.array(*[F.array(*[F.lit(m) for m in more]) for more in finer]), F.col("pair"))
        numbered = F.transform(of_pair, lambda m, i: F.struct((F.lit(len(masks)) + F.col("pair") * len(finer[0]) + i).cast("int").alias("pair"), F.col("fp").bitwiseAND(m).alias("bits")))
        split = dealt.where("large").select("fp", F.explode(numbered).alias("k")).select("k.pair", "k.bits", "fp")
        still = table(split.groupBy("pair", "bits").count().where(F.col("count") > TILE).select("pair", "bits", F.ceil(F.col("count") / TILE).cast("int").alias("chunks")), "still_large")
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")).cast("int")
        tiled = (
            split.join(still, ["pair", "bits"], "left")
            .withColumn("mine", F.coalesce(mine, F.lit(0)))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)))
            .select("pair", "bits", F.least("mine", "other").alias("t0"), F.greatest("mine", "other").alias("t1"), "fp")
        ).unionAll(whole(dealt.where("large is null")))
    keys = ["pair", "bits", "t0", "t1"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            new = np.zeros(len(columns[0]), np.int64)
            for c in columns[:4]:
                new[1:] |= c[1:] != c[:-1]
            found = _bucket_links(np.cumsum(new), columns[4].view(np.uint64), max_bits).view(np.int64)
            return record_batch(schema, [np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            if not len(columns[0]):
                continue
            differs = np.zeros(len(columns[0]), bool)
            for c in columns[:4]:
                differs |= c != c[-1]
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if last:
                yield links([c[:last] for c in columns])
            kept = [c[last:] for c in columns]
        if kept is not None:
            yield links(kept)

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, n_copies, n_linked) for each row of docs.

    component_id is the smallest doc_id that links of `max_bits` or fewer differing bits reach. Null and empty texts, and
    texts without words, have fingerprint zero and link like any other. A null doc_id takes part but never names a
    component unless all its ids are null. Repeated rows stay. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    n_copies: rows with the same fingerprint; n_linked: distinct fingerprints in the component.
    """
    fps, named = _components(docs, id_col, text_col, width, max_bits)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_linked"))
    named = named.join(smallest, "component").select("fp", "component_id", "n_copies", "n_linked")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "n_copies", "n_linked")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int, agree: int = 2, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp, first) of each row, where first orders rows by id, and (fp, first_id, first, n_copies, component) of each fingerprint."""
    fps = durable(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, signed=similarity is not None))
    fps = fps.withColumn("first", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("first").alias("first"), F.count("*").alias("n_copies")))
    links = close_links(distinct.select("fp"), max_bits, agree)
    if similarity is not None:
        signed = durable(fps.where("sig is not null").groupBy(F.col("fp").alias("node"), "sig").agg(F.min("text_hash").alias("text_hash")))
        links = links.unionAll(minhash.close_links(id_and_text(docs, id_col, text_col), signed, similarity, width))
    labels = connected_components(links)
    return fps, distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4, agree: int = 2, similarity: float | None = None) -> DataFrame:
    """The row with the smallest id of each component, with the columns of docs; of rows alike in id and text, any one.

    With `similarity`, texts of that shingle similarity and more are linked by MinHash besides. Null ids come after all others. Null and empty
    texts, and texts without words, are one component. Columns of docs, whatever their names, are handed through. An empty table gives an empty
    result. A long text is hashed a block of words at a time.
    """
    fps, named = _components(docs, id_col, text_col, width, max_bits, agree, similarity)
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    repeated = fps.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select("first.*")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].cast("long").alias("key_id"), F.xxhash64(text).alias("key_hash"))
    out = keyed.join(kept, keyed["key_id"].eqNullSafe(kept["doc_id"]) & (keyed["key_hash"] == kept["text_hash"]), "left_semi")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["key_id", "key_hash"])
    return out.select("doc.*")


def hex_digits(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
