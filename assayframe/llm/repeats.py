"""What the two substring operators share: units of text, seeds, and the exchange between units and buckets.

Documents are packed into units of about `UNIT_BYTES`, compressed and written once; a unit is a row, and later passes work on a
unit's texts with array operations. Every window (20 words, 200 bytes, ...) has a seed, the smallest hash of the
short grams in it. Equal windows have equal seeds, so only windows whose seed occurs twice or more anywhere can repeat;
all others are settled after one small exchange of seed hashes. Consecutive windows mostly share a seed and travel together.

Seeds and windows that repeat inside a unit are summed up there before anything is shuffled: a passage in a third of all
documents reaches a bucket once per unit. Around a seed with more than `hot` occurrences there may be as many different
windows; these are thinned by one more exchange, of hashes dealt out by themselves, to those that can repeat. What is left of
them goes to its bucket as bytes like everything else, and only bytes decide.

All exchanges have a partition for each `BUCKET_BYTES` of text. The units themselves are shuffled once; passes over them share that shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_and_text, record_batch, table

UNIT_BYTES = 2 << 20
#: Bytes of text for each bucket of the exchanges.
BUCKET_BYTES = 16 << 20
UNIT_DDL = "unit long, bytes long, ids array<long>, sizes array<int>, data binary"
_UNIT = pa.schema([("unit", pa.int64()), ("bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])
#: A null id sorts before all others.
NULL_ID = np.iinfo(np.int64).min
#: Low bits of a gram's rank that hold its place; the leftmost of equal grams is the seed.
PLACE_BITS = 24


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 8 * len(dtypes), []
    for size, dtype in zip(np.frombuffer(data, "<u8", len(dtypes)).tolist(), dtypes, strict=True):
        out.append(np.frombuffer(data[at : at + size], dtype))
        at += size
    return out


@dataclass
class Unit:
    unit: int
    ids: list
    texts: list[bytes]

    def order_ids(self) -> np.ndarray:
        return np.array([NULL_ID if i is None else i for i in self.ids], np.int64)


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as rows of UNIT_DDL, written to the shared folder."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 40, [], [], 0
        press = zstandard.ZstdCompressor(level=3)

        def made() -> pa.RecordBatch:
            return record_batch(_UNIT, [[number], [size], [ids], [[len(t) for t in texts]], [press.compress(b"".join(texts))]])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(i.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= UNIT_BYTES or len(ids) >= 20_000:
                    yield made()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield made()

    return table(id_and_text(docs, id_col, text_col).mapInArrow(run, UNIT_DDL), "units")


def load_unit(unit: int, ids: list, sizes: list[int], data: bytes) -> Unit:
    whole, at, texts = zstandard.ZstdDecompressor().decompress(data), 0, []
    for n in sizes:
        texts.append(whole[at : at + n])
        at += n
    return Unit(unit, ids, texts)


def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Unit, dict]]:
    """Each row of UNIT_DDL, and the row's further columns."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            yield load_unit(row.pop("unit"), row.pop("ids"), row.pop("sizes"), row.pop("data")), row


def placed(packed: DataFrame) -> tuple[DataFrame, int]:
    """The units dealt out by number, and into how many parts."""
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    return packed.repartition(n_buckets, "unit"), n_buckets


def sliding_seeds(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each `width` consecutive grams: where the smallest is (leftmost), and its hash."""
    from .windows import sliding

    place = np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << PLACE_BITS) - 1)
    least = sliding((grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place, width)
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    if len(grams) > 1 << PLACE_BITS:  # the place is known up to a multiple of 2**PLACE_BITS, and near the window
        first = np.arange(len(at))
        at += (first - at + (1 << PLACE_BITS) - 1 >> PLACE_BITS) << PLACE_BITS
    return at, grams[at]


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its members, ascending)."""
    order = np.argsort(buckets, kind="stable")
    if len(order):
        cuts = np.flatnonzero(np.diff(buckets[order])) + 1
        for members in np.split(order, cuts):
            yield int(buckets[members[0]]), members


_SEEDS = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("payload", pa.binary())])
SENT_DDL = "bucket int, unit long, payload binary"
_REPLY = pa.schema([("unit", pa.int64()), ("payload", pa.binary())])
REPLY_DDL = "unit long, payload binary"


def sent_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return record_batch(_SEEDS, list(zip(*rows, strict=True)) or [[], [], []])


def reply_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return record_batch(_REPLY, list(zip(*rows, strict=True)) or [[], []])


def exchange(sent: DataFrame, n_buckets: int, answer: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """sent (bucket, unit, payload) goes to its buckets; answer gets one bucket's (unit, payload) at a time and gives replies.

    Returns (unit, payloads), a row for each unit that has a reply.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, u, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket and held:
                    yield reply_rows(list(answer(held)))
                    held = []
                bucket = b
                held.append((u, p))
        if held:
            yield reply_rows(list(answer(held)))

    replies = sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, REPLY_DDL)
    return replies.repartition(n_buckets, "unit").groupBy("unit").agg(F.collect_list("payload").alias("payloads"))


def repeated_hashes(rows: DataFrame, n_buckets: int, hashes_of: Callable[[Unit, dict], tuple[np.ndarray, np.ndarray]], hot: int = 0) -> DataFrame:
    """(unit, payloads): of each unit the hashes that occur twice or more anywhere. A payload is (hashes, whether hot), sorted by hash.

    rows are units, with further columns maybe; hashes_of gives a unit's distinct hashes, sorted, and the number of their places.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, more in of_batches(batches):
            seeds, counts = hashes_of(unit, more)
            rows = [(b, unit.unit, pack(seeds[m], np.minimum(counts[m], 65535).astype("<u2"))) for b, m in by_bucket((seeds % np.uint64(n_buckets)).astype(np.int64))]
            yield sent_rows(rows)

    def answer(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [unpack(p, "<u8", "<u2") for _, p in held]
        seeds, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        distinct, where = np.unique(seeds, return_inverse=True)
        total = np.bincount(where, counts, len(distinct)).astype(np.int64)[where]
        at = 0
        for (unit, _), part in zip(held, parts, strict=True):
            mine = total[at : at + len(part[0])]
            at += len(part[0])
            if (keep := mine >= 2).any():
                yield unit, pack(part[0][keep], mine[keep] > hot)

    return exchange(rows.mapInArrow(send, SENT_DDL), n_buckets, answer)


def has_hot(payloads: list[bytes] | None) -> bool:
    return any(unpack(p, "<u8", "?")[1].any() for p in payloads or ())


def marked(seeds: np.ndarray, payloads: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """For each of seeds: whether it repeats, and whether it is hot."""
    if not payloads:
        return np.zeros(len(seeds), bool), np.zeros(len(seeds), bool)
    parts = [unpack(p, "<u8", "?") for p in payloads]
    known, hot = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    at = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
    found = known[at] == seeds
    return found, found & hot[at]


def candidates(packed: DataFrame, n_buckets: int, seeds_of: Callable[[Unit], tuple[np.ndarray, np.ndarray]], hot_windows_of: Callable[[Unit, list[bytes]], np.ndarray], hot: int) -> DataFrame:
    """packed with `seeds`, the unit's repeated seeds, and `windows`, the hashes of its windows around hot seeds that may repeat; both may be null."""
    seeds = repeated_hashes(packed, n_buckets, lambda unit, _: seeds_of(unit), hot).withColumnRenamed("payloads", "seeds")
    marked_units = packed.join(seeds, "unit", "left")

    def windows_of(unit: Unit, more: dict) -> tuple[np.ndarray, np.ndarray]:
        found = hot_windows_of(unit, more["seeds"]) if has_hot(more["seeds"]) else np.zeros(0, np.uint64)
        return np.unique(found, return_counts=True)

    windows = repeated_hashes(marked_units, n_buckets, windows_of).withColumnRenamed("payloads", "windows")
    return marked_units.join(windows, "unit", "left")
