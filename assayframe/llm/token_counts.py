"""Token counts with a whole-token shortcut.

A vocabulary of pieces with byte fallback merges characters by score. No piece has a word mark after another character, so no merge
crosses the place before a word mark; texts are cut there (and around line breaks, where no piece holds one) into
pre-tokens that encode independently. Which pieces encode, alone, as the one token that they are is proven once on the driver,
by merging each, and sent along with the file; such a pre-token counts as one without any merge. Only the rest is merged, and a worker
remembers the counts of what it has merged in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered, merge
from .common import bounded_batches, id_and_text, record_batch

MARK = "▁"
NORMAL, USER_DEFINED = 1, 4


class PieceCounter:
    """Counts the tokens of a text as the library does with this model file, without begin and end."""

    def __init__(self, content: bytes, whole: frozenset | None = None):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with identity normalization, a dummy prefix and byte fallback are supported")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        place = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}  # equal scores, equal ranks
        self.ranks = {piece: place[score] for piece, score in scores.items()}
        rank = self.ranks.get
        self.rank_of = lambda pair: rank(pair[0] + pair[1]) if pair[0] is not None and pair[1] is not None else None
        if any(MARK in p.lstrip(MARK) for p in self.ranks):
            raise ValueError("a piece has a word mark after another character")
        breaks = "" if any("\n" in p and len(p) > 1 for p in self.ranks) else "\n"
        self.cut = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+|{breaks}" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.whole = dict.fromkeys(self.proven() if whole is None else whole, 1)
        self.words = Remembered()

    def proven(self) -> frozenset:
        """The pieces that encode, alone, as the one token that they are."""
        return frozenset(p for p in self.ranks if merge(list(p), self.rank_of) == [p])

    def _merged(self, token: str) -> int:
        n = self.words.older.get(token)
        if n is None:
            n = sum(1 if s in self.ranks else len(s.encode()) for s in merge(list(token), self.rank_of))
        self.words.add(token, n, 32)
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        whole, words, total = self.whole.get, self.words, 0
        for token in self.cut(MARK + text.replace(" ", MARK)):
            total += whole(token) or words.known.get(token) or self._merged(token)
        return total


@lru_cache(maxsize=2)
def _loaded(digest: str, content: bytes, whole: frozenset) -> PieceCounter:
    return PieceCounter(content, whole)


@lru_cache(maxsize=2)
def _proven_once(content: bytes) -> frozenset:
    return PieceCounter(content).proven()


def token_counts(docs: DataFrame, path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs; path: a model file, read on the driver.

    A null text counts as empty: no bytes, no tokens. A null id stays null. Repeated rows stay; other columns, whatever their names, are ignored. An empty table
    gives an empty result. A long text takes time in proportion, a long pre-token (a line without spaces) a logarithm more.
    """
    bounded_batches(docs.sparkSession)
    with open(path, "rb") as f:
        content = f.read()
    digest, shipped = hashlib.sha256(content).hexdigest(), docs.sparkSession.sparkContext.broadcast((content, _proven_once(content)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(digest, *shipped.value)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield record_batch(schema, [batch.column(0), sizes, [counter.count(t.as_py()) for t in batch.column(1)]])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
