"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the corpus itself, in document order. It is dealt into blocks by the seeds of its windows of `window` words (see
repeats.py): a block holds, as words, all stretches of text around its seeds. Each block is indexed and its stretches are parsed against it in
document order: from left to right, a factor begins at a word from which a whole window has an earlier source, is as long as any source
in the block goes on, and where it ends the next one may begin at once. A stretch that the block has word for word is one factor.

A document's factors from all blocks are put together: where the source of one continues that of the factor before, they are one factor, however
many blocks it crosses. The boundaries are checked window by window: a window that straddles two factors belongs to a stretch of its own and has been
looked up in that one's block. So the words that factors cover, each at least `window` words long, are exactly the words in repeated windows.

Seeds are hashes, but only decide in which block words meet; the words themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record_batch
from .repeats import NULL_ID, SENT_DDL, Unit, by_bucket, candidates, exchange, marked, of_batches, pack, placed, sent_rows, sliding_seeds, units, unpack
from .windows import Words, mix

#: Words of a seed's gram.
GRAM = 8
#: Windows around seeds with more occurrences are thinned before they are sent.
HOT = 256
#: A unit's distinct stretches (seed, bytes, text), and where they are: which one, row in unit, first word, document.
STRETCHES = ("<u8", "<u4", "u1", "<u4", "<u4", "<u4", "<i8")
#: Row in unit, first word, number of words, the source's document and first word.
FACTORS = ("<u4", "<u4", "<u4", "<i8", "<u4")
FACTOR_DDL = "array<struct<first_word:long,n_words:long,source_doc:long,source_word:long>>"


def _windows(unit: Unit, window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, at, seed, seed_at): the words from which a whole window follows, the seeds of these windows and where those are."""
    words = Words(unit.texts)
    gram, _ = words.grams(min(GRAM, window))
    if len(words.hash) < window:
        return words, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seed_at, seed = sliding_seeds(gram, window - min(GRAM, window) + 1)
    at = np.flatnonzero(words.text[: len(words.hash) - window + 1] == words.text[window - 1 :])
    return words, at, seed[at], seed_at[at]


def _seeds_of(unit: Unit, window: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, seed, seed_at = _windows(unit, window)
    new = np.ones(len(seed), bool)
    new[1:] = seed_at[1:] != seed_at[:-1]
    return np.unique(seed[new], return_counts=True)


def _hot_windows_of(unit: Unit, seeds: list[bytes], window: int) -> np.ndarray:
    words, at, seed, _ = _windows(unit, window)
    return mix(words.grams(window)[0][at[marked(seed, seeds)[1]]])


def _send(unit: Unit, seeds: list[bytes] | None, windows: list[bytes] | None, window: int, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """The stretches of the unit's windows that may repeat, one of each, and all their places."""
    if not seeds:
        return
    words, at, seed, seed_at = _windows(unit, window)
    found, hot = marked(seed, seeds)
    if hot.any():
        found[hot] = marked(mix(words.grams(window)[0][at[hot]]), windows)[0]
    at, seed, seed_at = at[found], seed[found], seed_at[found]
    new = np.ones(len(at), bool)
    new[1:] = (seed_at[1:] != seed_at[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.concatenate([begin, [len(at)]])) + window - 1
    first, seed = at[begin], seed[begin]
    tokens, doc = words.data.split(), unit.order_ids()
    row = words.text[first]
    for bucket, members in by_bucket((seed % np.uint64(n_buckets)).astype(np.int64)):
        number: dict[tuple[int, bytes], int] = {}
        which = [number.setdefault((s, b" ".join(tokens[a : a + n])), len(number)) for s, a, n in zip(seed[members].tolist(), first[members].tolist(), length[members].tolist(), strict=True)]
        texts = [t for _, t in number]
        r = row[members]
        yield bucket, unit.unit, pack(
            np.array([s for s, _ in number], "<u8"), np.array([len(t) for t in texts], "<u4"), np.frombuffer(b"".join(texts), "u1"),
            np.array(which, "<u4"), r.astype("<u4"), words.place[first[members]].astype("<u4"), doc[r],
        )


class BlockIndex:
    """Stretches of a block by their words: which earlier one has the longest stretch from a given word on."""

    def __init__(self, window: int):
        self.window = window
        self.nodes: dict[tuple, int] = {}
        self.owner: list[tuple[int, int]] = []

    def _node(self, key: tuple, owner: tuple[int, int]) -> int:
        node = self.nodes.setdefault(key, len(self.owner))
        if node == len(self.owner):
            self.owner.append(owner)
        return node

    def add(self, name: int, words: list[bytes]) -> None:
        for j in range(len(words) - self.window + 1):
            node = self._node((b" ".join(words[j : j + self.window]),), (name, j))
            for word in words[j + self.window :]:
                node = self._node((node, word), (name, j))

    def factors(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(first word, number of words, name of the source, its first word), greedily from left to right."""
        j = 0
        while j + self.window <= len(words):
            node, end = self.nodes.get((b" ".join(words[j : j + self.window]),)), j + self.window
            if node is None:
                j += 1
                continue
            while end < len(words) and (further := self.nodes.get((node, words[end]))) is not None:
                node, end = further, end + 1
            yield j, end - j, *self.owner[node]
            j = end - self.window + 1


def _answer(held: list[tuple[int, bytes]], window: int) -> Iterator[tuple[int, bytes]]:
    """One block: for each unit its factors."""
    number: dict[tuple[int, bytes], int] = {}
    which, at = [], []
    for unit, payload in held:
        seeds, sizes, data, mine, *places = unpack(payload, *STRETCHES)
        text, a, names = data.tobytes(), 0, []
        for seed, n in zip(seeds.tolist(), sizes.tolist(), strict=True):
            names.append(number.setdefault((seed, text[a : a + n]), len(number)))
            a += n
        which.append(np.array(names, np.int64)[mine])
        at.append((np.full(len(mine), unit), *places))
    which = np.concatenate(which)
    unit, row, word, doc = (np.concatenate([a[k] for a in at]) for k in range(4))
    order = np.lexsort((word, row, unit, doc, which))
    new = np.ones(len(order), bool)
    new[1:] = which[order[1:]] != which[order[:-1]]
    head = order[new]  # the first place of each stretch
    source = np.empty(len(order), np.int64)
    source[order] = head[np.cumsum(new) - 1]
    texts = [t for _, t in number]
    size = np.array([t.count(b" ") + 1 for t in texts], np.int64)
    again = np.flatnonzero(source != np.arange(len(source)))
    found = [np.column_stack([unit[again], row[again], word[again], size[which[again]], doc[source[again]], word[source[again]]])]
    groups: dict[int, list[int]] = {}
    for (seed, _), k in number.items():
        groups.setdefault(seed, []).append(k)
    rank = np.empty(len(head), np.int64)
    rank[np.lexsort((word[head], row[head], unit[head], doc[head]))] = np.arange(len(head))
    parsed = []
    for group in groups.values():
        if len(group) == 1:  # its windows differ from each other, as each has the seed at another distance
            continue
        index = BlockIndex(window)
        for k in sorted(group, key=rank.__getitem__):
            words, me = texts[k].split(b" "), int(head[k])
            for first, n, other, begin in index.factors(words):
                s = int(head[other])
                parsed.append((unit[me], row[me], word[me] + first, n, doc[s], word[s] + begin))
            index.add(k, words)
    if parsed:
        found.append(np.array(parsed, np.int64))
    every = np.concatenate(found)
    for name, members in by_bucket(every[:, 0]):
        row, first, n, of, begin = every[members, 1:].T
        yield name, pack(row.astype("<u4"), first.astype("<u4"), n.astype("<u4"), of, begin.astype("<u4"))


def _joined(at: np.ndarray, n: np.ndarray, row: np.ndarray, doc: np.ndarray, of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length): which of the factors, in order, begin a factor of the whole document, and how many words that one has."""
    windows = n - window + 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + windows[:-1]) | (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (of[1:] != of[:-1] + windows[:-1])
    begin = np.flatnonzero(new)
    return begin, (np.add.reduceat(windows, begin) if len(begin) else windows) + window - 1


def _parsed(unit: Unit, payloads: list[bytes] | None, window: int) -> Iterator[tuple]:
    """A row for each document of the unit: id, words, removed words, kept text, factors."""
    words = Words(unit.texts)
    change, factors = np.zeros(len(words.hash) + 1, np.int64), {}
    if payloads:
        parts = [unpack(p, *FACTORS) for p in payloads]
        row, place, n, doc, of = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(5))
        at = words.first[row] + place
        order = np.argsort(at)
        at, row, place, n, doc, of = at[order], row[order], place[order], n[order], doc[order], of[order]
        begin, length = _joined(at, n, row, doc, of, window)
        np.add.at(change, at[begin], 1)
        np.add.at(change, at[begin] + length, -1)
        for r, *f in zip(row[begin].tolist(), place[begin].tolist(), length.tolist(), doc[begin].tolist(), of[begin].tolist(), strict=True):
            factors.setdefault(r, []).append((f[0], f[1], None if f[2] == NULL_ID else f[2], f[3]))
    covered = np.cumsum(change[:-1]) > 0
    removed = np.concatenate([[0], np.cumsum(covered)])
    for k, (doc_id, text) in enumerate(zip(unit.ids, unit.texts, strict=True)):
        a, b = int(words.first[k]), int(words.first[k] + words.count[k])
        gone = int(removed[b] - removed[a])
        kept = text.split()
        if gone:
            kept = [w for w, c in zip(kept, covered[a:b].tolist(), strict=True) if not c]
        yield doc_id, b - a, gone, b" ".join(kept).decode(), factors.get(k, [])


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors), a row for each row of docs.

    Words (whatever is between white space) of every window of `window` words that starts earlier as well are
    removed: in a smaller doc_id, or earlier in the same one; rows with one id count in the order in which they are read, a null id
    before all others. kept has the other words joined by single spaces; factors are the parse: where a factor begins, its length, its source.
    A null or empty text, or one of fewer words than a window, loses nothing. Repeated rows lose what the first of them keeps. A long text is one unit
    and takes memory in proportion. Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    packed, n_buckets = placed(units(docs, id_col, text_col))
    marked_units = candidates(packed, n_buckets, lambda unit: _seeds_of(unit, window), lambda unit, seeds: _hot_windows_of(unit, seeds, window), HOT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, more in of_batches(batches):
            yield sent_rows(list(_send(unit, more["seeds"], more["windows"], window, n_buckets)))

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("factors", pa.list_(pa.struct([(x, pa.int64()) for x in ("first_word", "n_words", "source_doc", "source_word")])))]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, more in of_batches(batches):
            *plain, factors = zip(*_parsed(unit, more["payloads"], window), strict=True)
            names = ("first_word", "n_words", "source_doc", "source_word")
            yield record_batch(schema, [*plain, [[dict(zip(names, f, strict=True)) for f in x] for x in factors]])

    found = exchange(marked_units.mapInArrow(send, SENT_DDL), n_buckets, lambda held: _answer(held, window))
    return packed.join(found, "unit", "left").mapInArrow(parse, f"doc_id long, n_words long, n_removed long, kept string, factors {FACTOR_DDL}")
