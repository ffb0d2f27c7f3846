"""Suffix-array dedup by merging the Burrows-Wheeler transforms of shards.

Windows of `WINDOW` bytes whose seed (see repeats.py) occurs more than once go, with the text around them, to the seed's bucket. A bucket's
texts are cut into shards by the unit they come from. Each shard gets its sorted rotations and transform by itself; the
shards are then merged without sorting suffixes again: the interleave, a list that says from which shard the next suffix is, starts
as one shard after the other and is refined. A round puts the interleave in the order of the transforms' symbols, stably, after
which it is right for the symbols so far; at the same time, neighbours whose symbols or whose blocks differed get a block
boundary between them. A symbol here is eight bytes, so after 25 rounds the interleave is right to 200 bytes, and two neighbours
have a common prefix of 200 bytes or more exactly if no boundary has come between them. Blocks that hold two or more windows are the repeated intervals.

Whole segments that are equal are counted before that. The text around seeds with more than `HOT` occurrences is thinned first to windows
whose hash occurs twice (see repeats.py), so that a passage in many different surroundings does not bring these along; the merge
decides about what is left, as about all other windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record_batch
from .repeats import SENT_DDL, Unit, by_bucket, candidates, exchange, marked, of_batches, pack, placed, sent_rows, sliding_seeds, units, unpack
from .windows import mix, prefix_hashes

WINDOW = 200
GRAM = 24
HOT = 128
STEP = 8
#: A byte that UTF-8 never uses ends every segment.
END = 0xFF
#: Symbols that are merged at once, unless one seed has more; ranks then fit 16 bits, for which numpy's stable sort is a radix sort.
BUNDLE = 65_000
SHARDS = 4
#: Texts are hashed in pieces of so many bytes, which overlap by a window less one byte.
PIECE = 1 << 18


def _pieces(unit: Unit) -> Iterator[tuple[int, bytes]]:
    """(offset in the unit's joined texts, bytes) of pieces that hold each window once."""
    at = 0
    for text in unit.texts:
        for a in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            yield at + a, text[a : a + PIECE + WINDOW - 1]
        at += len(text)


def _blocks(unit: Unit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, at, offset): texts side by side, where in them windows start, and the difference to the place in the unit's joined texts."""
    held, size = [], 0
    for offset, piece in _pieces(unit):
        if len(piece) < WINDOW:
            continue
        held.append((offset, piece))
        size += len(piece)
        if size >= PIECE:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def _block(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(p) for _, p in held])
    counts = np.array([len(p) - WINDOW + 1 for _, p in held])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(counts.sum()) - np.repeat(first - starts[:-1], counts)
    offset = np.repeat(np.array([o for o, _ in held]) - starts[:-1], counts)
    return np.frombuffer(b"".join(p for _, p in held), np.uint8), at, offset


def _seeds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums, down, seed, seed_at) of the windows at `at`."""
    sums, down = prefix_hashes(data)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    seed_at, seed = sliding_seeds(gram, WINDOW - GRAM + 1)
    return sums, down, seed[at], seed_at[at]


def _runs(at: np.ndarray, seed_at: np.ndarray) -> np.ndarray:
    """Where runs of consecutive windows with the same seed begin."""
    new = np.ones(len(at), bool)
    new[1:] = (seed_at[1:] != seed_at[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(new)


def _seeds_of(unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    found = [np.zeros(0, np.uint64)]
    for data, at, _ in _blocks(unit):
        _, _, seed, seed_at = _seeds(data, at)
        found.append(seed[_runs(at, seed_at)])
    return np.unique(np.concatenate(found), return_counts=True)


#: A unit's segments: seed, bytes, place in the unit, whole-segment copies as (segment, place).
SEGMENTS = ("<u8", "u1", "<u4", "<u4", "<u4", "<u4")


def _hashes(sums: np.ndarray, down: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix((sums[at + WINDOW] - sums[at]) * down[at])


def _hot_windows_of(unit: Unit, seeds: list[bytes]) -> np.ndarray:
    found = [np.zeros(0, np.uint64)]
    for data, at, _ in _blocks(unit):
        sums, down, seed, seed_at = _seeds(data, at)
        begin = _runs(at, seed_at)
        size = np.diff(np.concatenate([begin, [len(at)]]))
        found.append(_hashes(sums, down, at[np.repeat(marked(seed[begin], seeds)[1], size)]))
    return np.concatenate(found)


def _send(unit: Unit, payloads: list[bytes] | None, windows: list[bytes] | None, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    if not payloads:
        return
    seeds, texts, places = [], [], []
    for data, at, offset in _blocks(unit):
        sums, down, seed, seed_at = _seeds(data, at)
        begin = _runs(at, seed_at)
        size = np.diff(np.concatenate([begin, [len(at)]]))
        found, hot = marked(seed[begin], payloads)
        found, hot = np.repeat(found, size), np.repeat(hot, size)
        if hot.any():
            found[hot] = marked(_hashes(sums, down, at[hot]), windows)[0]
        at, seed, seed_at, offset = at[found], seed[found], seed_at[found], offset[found]
        begin = _runs(at, seed_at)
        size = np.diff(np.concatenate([begin, [len(at)]]))
        whole = data.tobytes()
        for a, o, n in zip(at[begin].tolist(), offset[begin].tolist(), size.tolist(), strict=True):
            texts.append(whole[a : a + n + WINDOW - 1])
            places.append(a + o)
        seeds.append(seed[begin])
    if seeds:
        yield from _send_segments(unit.unit, np.concatenate(seeds), texts, np.array(places, np.int64), n_buckets)


def _send_segments(unit: int, seeds: np.ndarray, texts: list[bytes], places: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    for bucket, members in by_bucket((seeds % np.uint64(n_buckets)).astype(np.int64)):
        number: dict[bytes, int] = {}
        own, again, place_again = [], [], []
        for i in members.tolist():
            k = number.setdefault(texts[i], len(own))
            if k == len(own):
                own.append(i)
            else:
                again.append(k)
                place_again.append(places[i])
        data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
        yield bucket, unit, pack(seeds[own], data, np.array([len(texts[i]) for i in own], "<u4"), places[own].astype("<u4"), np.array(again, "<u4"), np.array(place_again, "<u4"))


def _keys(data: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The rank among all of the STEP bytes from each place on; follow[i] is the place after i, within its segment."""
    key, at = np.zeros(len(data), np.uint64), np.arange(len(data))
    for _ in range(STEP):
        key = key << np.uint64(8) | data[at]
        at = follow[at]
    distinct, rank = np.unique(key, return_inverse=True)
    return rank.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32)


def shard_transform(places: np.ndarray, key: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, symbols): the shard's places sorted by the WINDOW bytes from each on, and the STEP bytes before each of these."""
    order = places
    for _ in range(WINDOW // STEP):
        order = before[order]
        order = order[np.argsort(key[order], kind="stable")]
    return order, key[before[order]]


def merge_transforms(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, block): from which shard each suffix of the merged order is, and the number of its block of equal prefixes of WINDOW bytes."""
    column = np.concatenate(symbols)
    source = np.repeat(np.arange(len(symbols), dtype=np.uint8), [len(s) for s in symbols])
    block = np.zeros(len(source), np.int64)
    merged = np.empty(len(source), column.dtype)
    for _ in range(WINDOW // STEP):
        merged[np.argsort(source, kind="stable")] = column
        order = np.argsort(merged, kind="stable")
        symbol, old = merged[order], block[order]
        source = source[order]
        block = np.concatenate([[0], np.cumsum((symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1]))])
    return source, block


def repeated_windows(segments: list[bytes], times: list[int], shard: list[int]) -> np.ndarray:
    """Whether each window of the segments, one after the other, is there twice or more; times: how often each segment is."""
    sizes = np.array([len(s) for s in segments])
    padded = (sizes // STEP + 1) * STEP
    start = np.cumsum(padded) - padded
    data = np.full(padded.sum(), END, np.uint8)
    data[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = np.frombuffer(b"".join(segments), np.uint8)
    at = np.arange(len(data))
    follow, before = at + 1, at - STEP
    follow[start + padded - 1] = start
    head = np.repeat(start, STEP) + np.tile(np.arange(STEP), len(start))
    before[head] += np.repeat(padded, STEP)
    key = _keys(data, follow)
    where = np.repeat(np.array(shard), padded)
    made = [shard_transform(at[where == k], key, before) for k in range(max(shard) + 1)]
    made = [m for m in made if len(m[0])]
    source, block = merge_transforms([m[1] for m in made])
    place = np.empty(len(source), np.int64)
    place[np.argsort(source, kind="stable")] = np.concatenate([m[0] for m in made])
    n_windows = sizes - WINDOW + 1
    window = np.repeat(start - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
    weight = np.zeros(len(data), np.int64)
    weight[window] = np.repeat(np.array(times), n_windows)
    total = np.bincount(block, weight[place])
    by_place = np.empty(len(data), np.int64)
    by_place[place] = block
    return total[by_place[window]] >= 2


def _answer(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """For each unit the intervals (begin, end) of places where repeated windows start."""
    replies: dict[int, list[np.ndarray]] = {}
    _answer_segments(held, replies)
    for unit, parts in replies.items():
        yield unit, pack(np.concatenate(parts).astype("<u4"))


def _intervals(at: np.ndarray) -> np.ndarray:
    """Sorted places as rows (begin, end) of runs."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.column_stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1])


def _answer_segments(held: list[tuple[int, bytes]], replies: dict[int, list[np.ndarray]]) -> None:
    number: dict[tuple[int, bytes], int] = {}
    places: list[list[tuple[int, int]]] = []  # of each distinct segment: (unit, place)
    for unit, payload in held:
        seeds, data, sizes, at, again, at_again = unpack(payload, *SEGMENTS)
        text, mine, a = data.tobytes(), [], 0
        for seed, n, place in zip(seeds.tolist(), sizes.tolist(), at.tolist(), strict=True):
            k = number.setdefault((seed, text[a : a + n]), len(places))
            if k == len(places):
                places.append([])
            places[k].append((unit, place))
            mine.append(k)
            a += n
        for i, place in zip(again.tolist(), at_again.tolist(), strict=True):
            places[mine[i]].append((unit, place))
    of_seed: dict[int, list[tuple[bytes, int]]] = {}
    for (seed, text), k in number.items():
        of_seed.setdefault(seed, []).append((text, k))

    def found(k: int, begin: int, end: int) -> None:
        for unit, place in places[k]:
            replies.setdefault(unit, []).append(np.array([[place + begin, place + end]]))

    def flush(bundle: list[tuple[bytes, int]]) -> None:
        owners = sorted({places[k][0][0] for _, k in bundle})
        shard = [owners.index(places[k][0][0]) * min(SHARDS, len(owners)) // len(owners) for _, k in bundle]
        repeated = repeated_windows([t for t, _ in bundle], [len(places[k]) for _, k in bundle], shard)
        a = 0
        for text, k in bundle:
            n = len(text) - WINDOW + 1
            at = np.flatnonzero(repeated[a : a + n])
            a += n
            if len(at):
                for begin, end in _intervals(at).tolist():
                    found(k, begin, end)

    bundle, size = [], 0
    for group in of_seed.values():
        if len(group) == 1:  # its windows differ from each other, as each has the seed at another distance
            if len(places[group[0][1]]) > 1:
                found(group[0][1], 0, len(group[0][0]) - WINDOW + 1)
            continue
        symbols = sum(len(t) + STEP for t, _ in group)
        if bundle and size + symbols > BUNDLE:
            flush(bundle)
            bundle, size = [], 0
        bundle, size = bundle + group, size + symbols
    if bundle:
        flush(bundle)


def _removed(unit: Unit, payloads: list[bytes] | None) -> Iterator[tuple]:
    """A row for each document: id, bytes, removed bytes, removed runs, kept bytes."""
    sizes = [len(t) for t in unit.texts]
    change = np.zeros(sum(sizes) + 1, np.int32)
    for payload in payloads or ():
        spans = unpack(payload, "<u4")[0].reshape(-1, 2).astype(np.int64)
        np.add.at(change, spans[:, 0], 1)
        np.add.at(change, spans[:, 1] + WINDOW - 1, -1)
    covered = np.cumsum(change[:-1], dtype=np.int32) > 0
    at = 0
    for doc_id, text, n in zip(unit.ids, unit.texts, sizes, strict=True):
        mine = covered[at : at + n]
        at += n
        gone = int(mine.sum())
        if gone:
            runs = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
            yield doc_id, n, gone, runs, np.frombuffer(text, np.uint8)[~mine].tobytes()
        else:
            yield doc_id, n, 0, 0, text


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), a row for each row of docs.

    Bytes of every string of WINDOW bytes that also starts anywhere else, in whichever row, are removed; kept is what remains (it may cut a
    character, hence binary). A null or empty text, or one shorter than a window, loses nothing. Repeated rows remove each
    other. A long text is one unit and takes memory in proportion. Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    packed, n_buckets = placed(units(docs, id_col, text_col))
    marked_units = candidates(packed, n_buckets, _seeds_of, _hot_windows_of, HOT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, more in of_batches(batches):
            yield sent_rows(list(_send(unit, more["seeds"], more["windows"], n_buckets)))

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, more in of_batches(batches):
            yield record_batch(schema, list(zip(*_removed(unit, more["payloads"]), strict=True)))

    found = exchange(marked_units.mapInArrow(send, SENT_DDL), n_buckets, _answer)
    return packed.join(found, "unit", "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
