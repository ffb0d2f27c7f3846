"""Token ids as Parquet files: a list column per document, in document order, readable in parts.

Each file is one range of ids, sorted, so row groups and pages hold short ranges of `doc_id` and a reader that wants some documents
skips the rest by their statistics and page indexes. The token lists are a column of their own: metadata queries
don't read them. `encoding` is "dictionary" (token ids repeat) or "delta" (plain dictionary off, second page format, binary-packed
differences); `row_group_bytes` and `page_bytes` bound what one read touches.

`start`, the number of ids before a document, is a prefix sum in two steps: sums per file, of which there are as many as
range partitions, and running sums inside each file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, Remembered, Shipped, WordBpe, _normalized, packed
from .common import BATCH_ROWS, bounded_batches, id_and_text, record_batch

#: Bytes of texts that are encoded together, or one text that is longer: each different word of these is cut once.
TOGETHER_BYTES = 4 << 20

_ID = attrgetter("id")
_WORD_END = packed([0xFFFFFFFF])  # no id


class LibraryBpe(WordBpe):
    """The same encoder with the library's own merges, for many texts at once; what counts here is the files."""

    def __init__(self, content: bytes, doubtful: tuple[str, str] | None = None):
        from tokenizers import Tokenizer

        super().__init__(content, doubtful)
        self.tokenize = Tokenizer.from_str(content.decode()).model.tokenize
        self.words = Remembered(1.6)  # one worker a task, and no other encoder beside it
        self.find_in_lines = regex.compile(PATTERN + r"|\n").findall

    def _merged(self, token: str) -> list[int]:
        return list(map(_ID, self.tokenize(token)))

    def _pre_token(self, token: str) -> bytes:
        found = self.words.older.get(token)
        if found is None:
            plain = token.isascii() and token.isprintable()  # letters that stand for themselves
            found = packed(self._merged(token if plain else token.encode().decode("latin-1").translate(self.stand_in)))
        self.words.add(token, found, len(found))
        return found

    def _words(self, words: pa.StringArray) -> pa.ListArray:
        """The ids of normalized words without ASCII white space."""
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py() + "\n"
        table = self.words
        parts = [_WORD_END if p == "\n" else table.known.get(p) or self._pre_token(p) for p in self.find_in_lines(lines)]
        ids = np.frombuffer(b"".join(parts), "<i4")
        ends = np.flatnonzero(ids < 0)[: len(words)]
        return pa.ListArray.from_arrays(np.append(0, ends - np.arange(len(ends))).astype(np.int32), pa.array(ids[ids >= 0]))

    def _normal(self, text: str) -> str | None:
        """The normalized text; None if it has special tokens, or is left to the library."""
        if "<|" in text:
            return None
        if text.isascii():
            return text.lower()
        basic, further, odd = self.doubtful
        return None if basic(text) or (further(text) and odd(text)) else _normalized(text)

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text, as encode() has them."""
        normal = [self._normal(t) for t in texts]
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in normal], pa.string()))
        words = split.values.dictionary_encode()  # other white space is left inside words, where the pattern skips it
        lists = self._words(words.dictionary).take(words.indices)
        rows = pa.ListArray.from_arrays(lists.offsets.take(split.offsets), lists.values)
        apart = [k for k, t in enumerate(normal) if t is None]
        if not apart:
            return rows
        order = np.arange(len(texts))
        order[apart] = len(texts) + np.arange(len(apart))
        ids = [np.frombuffer(self.encode(texts[k]), "<i4") for k in apart]
        return pa.concat_arrays([rows, pa.array(ids, rows.type)]).take(pa.array(order))


def put_together(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `size` bytes at most, or one longer row: bytes of the second column's strings, and 64 for each."""
    some, held = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy() + np.int64(64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            n = max(int(np.searchsorted(ends, before + size - held, side="right")) - at, 0 if some else 1)
            if n > 0:
                some.append(batch.slice(at, n))
                held += int(ends[at + n - 1]) - before
                at += n
            if at < len(ends):  # the next one is too much
                yield pa.concat_batches(some)
                some, held = [], 0
    if some:
        yield pa.concat_batches(some)


def token_lists(docs: DataFrame, tokenizer: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens array<int>): each text's ids, end_id appended. Rows keep their order."""
    bounded_batches(docs.sparkSession)
    model, schema = Shipped(docs, tokenizer, LibraryBpe), pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.get()
        for batch in put_together(batches, TOGETHER_BYTES):
            tokens = bpe.encode_all([t.as_py() for t in batch.column(1)])
            if end_id is not None:
                at = tokens.offsets.to_numpy()
                tokens = pa.ListArray.from_arrays((at + np.arange(len(at))).astype(np.int32), np.insert(tokens.values.to_numpy(), at[1:], end_id))
            for k in range(0, len(tokens), BATCH_ROWS):
                yield record_batch(schema, [batch.column(0)[k : k + BATCH_ROWS], tokens[k : k + BATCH_ROWS]])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, tokens array<int>")


def in_order(docs: DataFrame, id_col: str, files: int | None) -> DataFrame:
    """docs in ranges of ids, each sorted, nulls first. Boundaries come from a sample of ids; rows with one id stay in one range.

    Before the texts are encoded: finding the boundaries reads the rows once more, and what they are made of is then cheap.
    """
    ranged = docs.repartitionByRange(files, id_col) if files else docs.repartitionByRange(id_col)
    return ranged.sortWithinPartitions(F.col(id_col).asc_nulls_first())


def write(lists: DataFrame, path: str, *, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Write (doc_id, tokens), a file for each partition, with n_tokens beside them for reads of metadata alone."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be 'dictionary' or 'delta', not {encoding!r}")
    rows = lists.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens")
    writer = rows.write.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes))
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    writer.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, *, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens, file); with doc_ids=(first, last) only that range's row groups and pages are read."""
    found = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return found if doc_ids is None else found.where(F.col("doc_id").between(*doc_ids))


def offsets(files: DataFrame, totals: DataFrame) -> DataFrame:
    """files (doc_id, n_tokens, file, ...) with `start`, the number of ids before the document, in place of `file`. totals: see file_totals()."""
    before = totals.select("file", (F.sum("total").over(Window.orderBy(F.col("first").asc_nulls_first(), "file")) - F.col("total")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("running", running).join(before, "file").withColumn("start", F.col("before") + F.col("running") - F.col("n_tokens")).drop("file", "running", "before")


def file_totals(files: DataFrame) -> DataFrame:
    """(file, first doc_id, total ids), one row per file; reads no tokens."""
    return files.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("total"))


def checksums(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what is in the files; ids_crc32 is over the ids as little-endian 32-bit numbers."""
    bounded_batches(files.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.string()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield record_batch(schema, [batch.column(0), batch.column(1), batch.column(2), crc])

    summed = files.select("doc_id", "n_tokens", "file", "tokens").mapInArrow(run, "doc_id long, n_tokens long, file string, ids_crc32 long")
    return offsets(summed, file_totals(files)).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenize_to_files(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, **options) -> DataFrame:
    """Order docs, encode them, write the files, and return what is read back from them.

    A null text counts as empty: its list is end_id alone. Documents with a null doc_id come first. Repeated rows stay, in any order among
    themselves. An empty table writes no rows. Other columns are ignored.
    """
    own = id_and_text(docs, id_col, text_col)
    write(token_lists(in_order(own, "doc_id", files), tokenizer, end_id=end_id), path, **options)
    return read(docs.sparkSession, path)
