"""MinHash near-duplicates: bands of signatures, agreeing signature bytes, then the sets of shingles where those leave doubt.

A signature has one byte for each of `HASHES` hash functions, taken from the least hash of a text's word shingles. Two texts of shingle
similarity J agree in a share J of the bytes on average (and 1 in 256 of the rest), with a standard deviation of 0.025 at J = 0.8. Texts that agree
in one of `BANDS` bands of `ROWS` bytes are compared: 0.998 of the pairs of J = 0.8. From `MARGIN` below the asked similarity to `MARGIN` above it
the texts themselves decide.

A bucket of a band yields the spanning forest of its most similar pairs, and a large one is dealt out over tiles, as in `simhash`. Signatures
are joined only to keys that occur more than once. The texts may refuse an edge of a forest whose ends a pair beside it would have connected. So
the links that hold are followed to their components, and in buckets that these leave apart every doubtful pair of two components is decided, by the hashes
of the texts' shingles, where the bucket's rows are. A link joins its components at once, so a bucket gives fewer links than it has rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, record_batch, table, text_bytes
from .components import connected_components
from .windows import Words, blocks

HASHES, BANDS, ROWS = 256, 16, 5
MARGIN = 0.08
#: Signatures of one chunk of a large bucket.
TILE = 512
#: Buckets up to this size are compared by shifting the whole sorted column.
SMALL = 4

_rng = np.random.default_rng(20_240_301)
_FACTORS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, by text. Fewer than width words are one shingle; a text without words has none."""
    words = Words([t.lower() for t in texts])  # of bytes: ASCII only, as in simhash
    gram, whole = words.grams(width)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    joined = [xxhash.xxh64_intdigest(b" ".join(texts[i].lower().split())) for i in short.tolist()]
    owner = np.concatenate([words.text[: len(gram)][whole], short])
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate([gram[whole], np.array(joined, np.uint64)])[order]


def signatures(texts: list[bytes], width: int) -> list[bytes | None]:
    """HASHES bytes for each text; None for a text without words."""
    out: list[bytes | None] = []
    for first, end in blocks(texts):
        owner, hashes = _shingles(texts[first:end], width)
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        found: list[bytes | None] = [None] * (end - first)
        if len(owner):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            rows = np.empty((len(starts), HASHES), np.uint8)
            value = np.empty_like(hashes)
            for k in range(HASHES):
                np.multiply(hashes, _FACTORS[k], out=value)
                value += _TERMS[k]
                rows[:, k] = (np.minimum.reduceat(value, starts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
            for i, row in zip(owner[starts].tolist(), rows, strict=True):
                found[i] = row.tobytes()
        out += found
    return out


def similarity_of(a: bytes, b: bytes, width: int) -> float:
    """Shared shingles of two texts as a share of all of theirs."""
    owner, hashes = _shingles([a, b], width)
    one, two = np.unique(hashes[owner == 0]), np.unique(hashes[owner == 1])
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / max(1, len(one) + len(two) - both)


def agreeing(similarity: float) -> int:
    """Bytes that signatures of texts of that similarity have in common on average."""
    return int(np.ceil(HASHES * (similarity + (1 - similarity) / 256)))


def _forest(sigs: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Links (places in sigs) that connect what is connected, the most similar pairs first: a maximum spanning forest."""
    best, by = np.full(len(sigs), -1), np.zeros(len(sigs), np.int64)
    left, x, links = np.arange(1, len(sigs)), 0, []
    while len(left):
        agree = np.count_nonzero(sigs[left] == sigs[x], axis=1)
        nearer = agree > best[left]
        best[left[nearer]], by[left[nearer]] = agree[nearer], x
        at = int(best[left].argmax())
        x = int(left[at])
        if best[x] >= need:
            links.append((int(by[x]), x))
        left = np.delete(left, at)
    return links


def _bucket_links(edge: np.ndarray, sigs: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """edge: whether a bucket begins at each row. Places of both ends of each link."""
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.concatenate([starts, [len(edge)]]))
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    left, right = [], []
    for d in range(1, min(SMALL, len(edge))):
        a = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        a = a[np.count_nonzero(sigs[a] == sigs[a + d], axis=1) >= need]
        left.append(a)
        right.append(a + d)
    for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        links = np.array(_forest(sigs[at : at + n], need), np.int64).reshape(-1, 2)
        left.append(links[:, 0] + at)
        right.append(links[:, 1] + at)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def close_links(docs: DataFrame, signed: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links (a, b) of nodes whose texts have that shingle similarity, which connect all such that share a bucket.

    docs (text) without nulls; signed (node long, text_hash long, sig binary), no two rows alike in sig and node, no nulls: one text of each.
    """
    keyed, counts = _keys(signed)
    need, sure = agreeing(similarity - MARGIN), agreeing(similarity + MARGIN)
    found = durable(_candidates(signed, keyed, counts.where("n > 1"), need).distinct())
    doubtful = found.where(F.col("agree") < sure)
    links = durable(found.where(F.col("agree") >= sure).select("a", "b").unionAll(_close_enough(docs, doubtful, similarity, width)))
    # In buckets of up to SMALL rows every pair has been decided; from here on only rows of larger ones are looked at.
    large = table(counts.where(F.col("n") > SMALL), "large_buckets")
    if large.isEmpty():
        return links
    members = table(keyed.join(large, "key"), "members")
    labels = connected_components(links).withColumnRenamed("component", "grp")
    of_large = signed.join(members.select("text_hash").distinct(), "text_hash", "left_semi")
    named = durable(of_large.join(labels, "node", "left").withColumn("grp", F.coalesce("grp", "node")))
    spread = members.join(named.select("text_hash", "grp"), "text_hash").groupBy("key").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.first("n").alias("n"))
    apart = table(spread.where("g0 <> g1").select("key", "n"), "apart")
    keyed = members.select("text_hash", "key")
    # First by signatures alone: most rows of such buckets have no doubtful partner, and need no shingles.
    doubting = table(_doubting(_tiled(named, keyed, apart, "grp"), need, sure).distinct(), "doubting")
    wanted = table(doubting.select("text_hash").distinct(), "wanted")
    sets = table(shingle_sets(docs.withColumn("h", F.xxhash64("text")).join(wanted, F.col("h") == F.col("text_hash"), "left_semi").dropDuplicates(["h"]), width), "shingles")
    few = doubting.groupBy("key").agg(F.count("*").alias("n"))
    return links.unionAll(_links_apart(_tiled(named.join(sets, "text_hash"), doubting, few, "grp", "shingles"), similarity, need, sure))


def _doubting(tiled: DataFrame, need: int, sure: int) -> DataFrame:
    """(text_hash, key): the rows of tiles that agree in need bytes, and in fewer than sure, with a row of another component (grp)."""
    schema = pa.schema([("text_hash", pa.int64()), ("key", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        grp = tile.column("grp").to_numpy()
        sigs = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        odd = np.zeros(len(grp), bool)
        for x in range(len(grp) - 1):
            others = np.flatnonzero(grp[x + 1 :] != grp[x]) + x + 1
            agree = np.count_nonzero(sigs[others] == sigs[x], axis=1)
            close = others[(agree >= need) & (agree < sure)]
            odd[close] = True
            odd[x] |= len(close) > 0
        return pa.table([tile.column("text_hash").filter(pa.array(odd)), tile.column("key").filter(pa.array(odd))], schema=schema)

    return tiled.groupBy("key", "t0", "t1").applyInArrow(run, "text_hash long, key long")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(text_hash, shingles) of docs (h, text): the different hashes of a text's shingles, ascending, eight bytes each."""
    schema = pa.schema([("text_hash", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(schema, [batch.column(0), [np.unique(_shingles([t], width)[1]).tobytes() for t in text_bytes(batch.column(1))]])

    return docs.select("h", "text").mapInArrow(run, "text_hash long, shingles binary")


def _links_apart(tiled: DataFrame, similarity: float, need: int, sure: int) -> DataFrame:
    """(a, b): links between the components (grp) of a tile's rows, by the exact similarity of pairs that agree in need bytes and in fewer than sure."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        node, root = tile.column("node").to_numpy(), tile.column("grp").to_numpy().copy()
        sigs = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in tile.column("shingles")]
        links = []
        for x in range(len(node) - 1):
            others = np.flatnonzero(root[x + 1 :] != root[x]) + x + 1
            agree = np.count_nonzero(sigs[others] == sigs[x], axis=1)
            order = np.argsort(-agree, kind="stable")
            for y, n in zip(others[order].tolist(), agree[order].tolist(), strict=True):
                if n < need:
                    break
                if n >= sure or root[x] == root[y]:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both / max(1, len(sets[x]) + len(sets[y]) - both) >= similarity:
                    links.append((node[x], node[y]))
                    root[root == root[y]] = root[x]
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], schema=schema)

    return tiled.groupBy("key", "t0", "t1").applyInArrow(run, "a long, b long")


def _keys(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text_hash, key) for each band of each signature, and (key, n)."""
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", i * ROWS + 1, ROWS))
    keyed = signed.select("text_hash", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("key"))
    return keyed, keyed.groupBy("key").agg(F.count("*").alias("n"))


def _close_enough(docs: DataFrame, doubtful: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b) of the doubtful pairs (a, b, ta, tb) whose texts, found by their hashes, are that similar."""
    # Written, so that its size is known before the join: few hashes are broadcast, and the other texts aren't shuffled.
    wanted = table(doubtful.select(F.explode(F.array("ta", "tb")).alias("h")).distinct(), "wanted")
    texts = table(docs.select(F.xxhash64("text").alias("h"), "text").join(wanted, "h", "left_semi").dropDuplicates(["h"]), "texts")
    pairs = doubtful.join(texts.select(F.col("h").alias("ta"), F.col("text").alias("one")), "ta").join(texts.select(F.col("h").alias("tb"), F.col("text").alias("two")), "tb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [similarity_of(x, y, width) >= similarity for x, y in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True)]
            yield record_batch(schema, [batch.column(i).filter(pa.array(close, pa.bool_())) for i in range(2)])

    return pairs.select("a", "b", "one", "two").mapInArrow(check, "a long, b long")


def _tiled(signed: DataFrame, keyed: DataFrame, counts: DataFrame, *more: str) -> DataFrame:
    """(key, t0, t1, node, text_hash, sig, more...): the rows of the buckets of counts (key, n), a large bucket's once for each pair of its chunks with theirs."""
    shared = counts.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    mine = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("text_hash"), F.col("chunks").cast("long")).cast("int")).otherwise(0)
    return (
        keyed.join(shared, "key")
        .withColumn("mine", mine)
        .join(signed, "text_hash")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("mine", "other").alias("t0"), F.greatest("mine", "other").alias("t1"), "node", "text_hash", "sig", *more)
    )


def _candidates(signed: DataFrame, keyed: DataFrame, counts: DataFrame, need: int) -> DataFrame:
    """(a, b, ta, tb, agree): pairs of nodes, their texts' hashes and the number of bytes in common, need at least; from the buckets of counts (key, n)."""
    bounded_batches(signed.sparkSession)
    tiled = _tiled(signed, keyed, counts)
    keys = ["key", "t0", "t1"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ta", pa.int64()), ("tb", pa.int64()), ("agree", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            edge = np.ones(len(columns[0]), bool)
            edge[1:] = False
            for c in columns[:3]:
                edge[1:] |= c[1:] != c[:-1]
            node, text, sigs = columns[3:]
            left, right = _bucket_links(edge, sigs, need)
            other = node[left] != node[right]
            left, right = left[other], right[other]
            left, right = np.where(text[left] < text[right], left, right), np.where(text[left] < text[right], right, left)
            return record_batch(schema, [node[left], node[right], text[left], text[right], np.count_nonzero(sigs[left] == sigs[right], axis=1)])

        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, HASHES)
            columns = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)), sigs]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            differs = np.zeros(len(columns[0]), bool)
            for c in columns[:3]:
                differs |= c != c[-1]
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if last:
                yield links([c[:last] for c in columns])
            kept = [c[last:] for c in columns]
        if kept is not None:
            yield links(kept)

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, ta long, tb long, agree long")
