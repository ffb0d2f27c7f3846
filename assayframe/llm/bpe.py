"""BPE encoding and decoding of a tokenizer file with word ends.

Each pre-token is merged with a priority queue of merge ranks over a doubly linked list of symbols; an entry whose
symbols have changed since is stale and skipped. Decoding concatenates vocabulary strings.

The tokenizer file is read once on the driver and sent to the executors: its size doesn't depend on the data. What a
worker has merged it remembers for later texts, in a table of bounded size, and merges anew what it has forgotten.

Which characters are letters, and how they are composed and lower-cased, depends on the Unicode version of whoever asks. The driver finds out on which
characters Python and the library differ or may differ; texts with one of these are normalized and cut into pre-tokens by the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, id_and_text, record_batch

#: Bytes of what a worker remembers in its younger table; when that is full it becomes the older one, and what was there is forgotten.
REMEMBERED_BYTES = 40 << 20
#: Longer words (base64, text without spaces) are merged each time.
LONGEST_REMEMBERED = 64
#: What an entry of such a table takes besides its text.
ENTRY_BYTES = 160

# The normalizer, the pre-tokenizer's pattern and the word end that this encoder stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, BYTE_LEVEL]}


def merge(symbols: list, rank_of, made: list | None = None) -> list:
    """symbols after all merges. rank_of(pair of symbols): its rank, or None; the lowest rank goes first, then the leftmost pair.

    made[rank] is the merged symbol; without it symbols are strings, and a merged one is their concatenation.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    shift = n.bit_length()
    queue = [rank << shift | i for i, rank in enumerate(map(rank_of, zip(symbols, symbols[1:], strict=False))) if rank is not None]
    if not queue:
        return symbols
    after, before, mask = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        i, rank = entry & mask, entry >> shift
        j = after[i]
        if j >= n or rank_of((symbols[i], symbols[j])) != rank:
            continue  # stale
        new = symbols[i] + symbols[j] if made is None else made[rank]
        symbols[i], symbols[j] = new, None
        k, h = after[j], before[i]
        after[i] = k
        if k < n:
            before[k] = i
            rank = rank_of((new, symbols[k]))
            if rank is not None:
                heapq.heappush(queue, rank << shift | i)
        if h >= 0:
            rank = rank_of((symbols[h], new))
            if rank is not None:
                heapq.heappush(queue, rank << shift | h)
    return [s for s in symbols if s is not None]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Remembered:
    """A table of words that forgets: two generations, each of REMEMBERED_BYTES at most, or of that many times over."""

    def __init__(self, times: float = 1):
        self.times = times
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}
        self.size = 0

    def add(self, word: str, value, size: int) -> None:
        """Remember value (never a false one), of `size` bytes, for word."""
        if len(word) > LONGEST_REMEMBERED:
            return
        self.size += 4 * len(word) + size + ENTRY_BYTES
        if self.size > self.times * REMEMBERED_BYTES:
            self.known, self.older, self.size = {}, self.known, 0
        self.known[word] = value

    def forget(self) -> None:
        self.known, self.older, self.size = {}, {}, 0


_PACK = [struct.Struct(f"<{n}I").pack for n in range(LONGEST_REMEMBERED)]


def packed(ids: list[int]) -> bytes:
    """ids as little-endian 32-bit numbers."""
    return _PACK[len(ids)](*ids) if len(ids) < LONGEST_REMEMBERED else struct.pack(f"<{len(ids)}I", *ids)


def _normalized(text: str) -> str:
    """NFC and lower case by Python's Unicode data; a sigma's place in its word doesn't count."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _cutter(content: bytes):
    """The library's tokenizer for the file without its vocabulary: normalizer and pre-tokenizer."""
    from tokenizers import Tokenizer

    spec = json.loads(content)
    model = spec["model"] | {"vocab": {}, "merges": []}
    return Tokenizer.from_str(json.dumps(spec | {"model": model, "added_tokens": []}))


def doubtful_characters(content: bytes) -> tuple[str, str]:
    """Two character classes, of the basic plane and of the others: code points that Python's Unicode data doesn't know, or that are normalized or cut otherwise
    than by the library, alone or next to letters and marks, or that are letters to one of Python and the pattern only."""
    cutter = _cutter(content)
    normalize, cut, find = cutter.normalizer.normalize_str, cutter.pre_tokenizer.pre_tokenize_str, regex.compile(PATTERN).findall
    space = re.compile(r"\s+")
    known, odd = [], []
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000 or (kind := unicodedata.category(chr(c))) == "Co":
            continue
        (odd if kind == "Cn" else known).append(c)

    def differ(text: str) -> bool:
        theirs = normalize(text)
        return theirs != space.sub(" ", _normalized(text)) or [theirs[a:b] for _, (a, b) in cut(theirs)] != find(theirs)

    marks = [c for c in known if unicodedata.combining(chr(c))]
    for codes, form in ((known, "x{0}"), (marks, "a{0}\u0316"), (marks, "a\u0301{0}")):
        for k in range(0, len(codes), 1000):
            some = codes[k : k + 1000]
            if differ("\n".join(form.format(chr(c)) for c in some)):
                odd += [c for c in some if differ(form.format(chr(c)))]
    letter = regex.compile(r"\p{L}").match
    odd += [c for c in known if chr(c).isalpha() != bool(letter(chr(c)))]
    odd = sorted(set(odd))
    begin = [c for k, c in enumerate(odd) if k == 0 or odd[k - 1] != c - 1 or c == 0x10000]
    end = [c for k, c in enumerate(odd) if k == len(odd) - 1 or odd[k + 1] != c + 1 or c == 0xFFFF]
    ranges = [(a, f"\\U{a:08x}-\\U{b:08x}") for a, b in zip(begin, end, strict=True)]
    return "[" + "".join(r for a, r in ranges if a < 0x10000) + "]", "[" + "".join(r for a, r in ranges if a >= 0x10000) + "]"


class WordBpe:
    """Encoder and decoder for one tokenizer file (JSON): NFC, white space, lower case, pattern, bytes, merges with word ends."""

    def __init__(self, content: bytes, doubtful: tuple[str, str] | None = None):
        spec = json.loads(content)
        model = spec["model"]
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or spec["decoder"] is not None:
            raise ValueError("only files with this module's normalizer and pre-tokenizer and no decoder are supported")
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"] or not model["end_of_word_suffix"]:
            raise ValueError("only byte-level merges with word ends are supported")
        if any(not t["content"].startswith("<|") or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens that begin with '<|' are supported")
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}.get
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        stand_ins = byte_symbols()
        self.inner = {s: vocab[s] for s in stand_ins}
        self.last = {s: vocab[s + end] for s in stand_ins}
        self.stand_in = dict(enumerate(stand_ins))
        self.find = regex.compile(PATTERN).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        cutter = _cutter(content)
        self.normalize, self.cut = cutter.normalizer.normalize_str, cutter.pre_tokenizer.pre_tokenize_str
        basic, further = doubtful or doubtful_characters(content)
        self.doubtful = [re.compile(x).search for x in (basic, "[\U00010000-\U0010ffff]", further)]  # the last class is slow to search for
        self.careful = False  # whether the text at hand is left to the library
        self.words = Remembered()

    def _merged(self, token: str) -> list[int]:
        """The ids of one pre-token, given as the stand-ins of its bytes."""
        symbols = [self.inner[s] for s in token]
        symbols[-1] = self.last[token[-1]]
        return merge(symbols, self.rank_of, self.made)

    def _word(self, word: str) -> bytes:
        """The ids, as little-endian 32-bit numbers, of a normalized text without white space."""
        known = self.words.known
        found = self.words.older.get(word)
        if found is None:
            if word.isascii() and word.isalpha():  # one pre-token, whose letters stand for themselves
                found = packed(self._merged(word))
            elif self.careful and not word.isascii():
                found = packed([i for p, _ in self.cut(word) for i in self._merged(p)])
            elif word.isalpha() or ((parts := self.find(word)) and parts[0] == word):
                found = packed(self._merged(word.encode().decode("latin-1").translate(self.stand_in)))
            else:  # a word between punctuation is most likely known by itself
                at_once = [known.get(p) for p in parts]
                if not all(at_once):  # as rare as its rarest part: not worth its place in the table
                    return b"".join([f or self._word(p) for p, f in zip(parts, at_once, strict=True)])
                found = b"".join(at_once)
        self.words.add(word, found, len(found))
        return found

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:
            basic, further, odd = self.doubtful
            self.careful = bool(basic(text) or (further(text) and odd(text)))
            text = self.normalize(text) if self.careful else _normalized(text)
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to split(), but not to the pattern
        words = re.split(r"[^\S\x1c-\x1f]+", text) if odd else text.split()
        known = self.words
        return b"".join([known.known.get(w) or self._word(w) for w in words if w])

    def encode(self, text: str) -> bytes:
        if "<|" not in text or not self.at_special:
            return self._plain(text)
        parts = self.at_special.split(text)
        return b"".join(packed([self.special[p]]) if p in self.special else self._plain(p) for p in parts)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings, in the library's way for a file without a decoder: joined by spaces."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def _loaded(digest: str, content: bytes, doubtful: tuple[str, str], kind: type) -> WordBpe:
    return kind(content, doubtful)


@lru_cache(maxsize=2)
def _doubtful_once(content: bytes) -> tuple[str, str]:
    return doubtful_characters(content)


class Shipped:
    """A tokenizer file's content, broadcast once with what the driver found out about it; on a worker, the encoder made from it."""

    def __init__(self, df: DataFrame, path: str, kind: type = WordBpe):
        self.kind = kind
        with open(path, "rb") as f:
            content = f.read()
        self.digest = hashlib.sha256(content).hexdigest()
        self.shared = df.sparkSession.sparkContext.broadcast((content, _doubtful_once(content)))

    def get(self) -> WordBpe:
        return _loaded(self.digest, *self.shared.value, self.kind)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each row's text, as one binary of little-endian unsigned 32-bit numbers.

    A null text counts as empty and has no ids. Strings of special tokens inside a text become those tokens. A null id stays null. Repeated rows
    stay, each with its ids; other columns, whatever their names, are ignored. An empty table gives an empty result. A long text takes time in
    proportion, a long word a logarithm more; words beyond LONGEST_REMEMBERED are not kept in memory.
    """
    bounded_batches(docs.sparkSession)
    model, schema = Shipped(docs, path), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.get()
        for batch in batches:
            yield record_batch(schema, [batch.column(0), [bpe.encode(t.as_py()) for t in batch.column(1)]])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def there_and_back(bpe: WordBpe, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, text) of batches (doc_id, text); at the end the encoder forgets its words."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])
    try:
        for batch in batches:
            ids = [bpe.encode(t.as_py()) for t in batch.column(1)]
            yield record_batch(schema, [batch.column(0), ids, [bpe.decode(x) for x in ids]])
    finally:
        bpe.words.forget()
        pa.default_memory_pool().release_unused()


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): decode(encode(docs)) by one worker a task, which forgets its words when the task ends.

    Spark keeps idle workers for a minute, with what they hold; so a job that goes on to other work has their memory for that.
    """
    bounded_batches(docs.sparkSession)
    model = Shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from there_and_back(model.get(), batches)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, text string")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the text of each row's ids.

    Null ids give a null text, no ids an empty one; an id that the vocabulary doesn't have is an error. Repeated rows stay; other columns are ignored.
    An empty table gives an empty result.
    """
    bounded_batches(encoded.sparkSession)
    model = Shipped(encoded, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.get()
        for batch in batches:
            text = [None if (x := ids.as_py()) is None else bpe.decode(x) for ids in batch.column(1)]
            yield record_batch(schema, [batch.column(0), batch.column(1), text])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, ids binary, text string")
