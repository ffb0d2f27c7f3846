"""Secret scans: fixed patterns, and weak candidates that count only next to their complementary parts.

Positions come from built-in functions: `split` by a pattern gives what lies between its matches, and
`regexp_extract_all` the matches themselves; running sums of their lengths are the spans, in code points. Running sums go by blocks of
blocks, and texts are cut into chunks before parts of them are taken, so a text of very many matches takes time in proportion.

Weak parts are an access identifier (`ident`), a bare random string (`blob`) and an endpoint (`endpoint`). They are joined as
intervals: a part's scope is its span widened by `SCOPE` code points. Scopes are cut into bins of that length, so two
parts are in scope only if they are in the same or neighbouring bins. Per document and bin the identifiers (or the secrets)
are first summed up to the first start and last end, hence each weak part meets three rows at most and no pairs
are made, however many parts a document has.

One character is evidence once: a part that overlaps one of a kind earlier in `EVIDENCE` neither counts for others nor is a candidate
itself. So a named identifier is not confirmed by its own value, nor a URL by a string inside it. Base spans are reported in any case.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, let

# The patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
#: A run of the class that is long enough; the same matches as the run without a bound, filtered by length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts. An identifier is a named key or user id; a blob is 32 or more characters of base64; an endpoint is a URL.
IDENT = r"(?:[Aa]ccess_?[Kk]ey(?:_?[Ii]d)?|[Cc]lient_?[Ii]d|[Uu]ser(?:_?[Nn]ame)?|[Aa]ccount_?[Ii]d)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@_.-]{3,}"
BLOB = r"[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3|sftp|ftp)://[A-Za-z0-9._:@%/-]+"
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
BASE = KINDS[:3]
#: Whose characters count first where parts overlap.
EVIDENCE = ("access", "ident", "assign", "hex", "endpoint", "blob")
SCOPE = 400
#: Elements of a block of running sums, a power of two, and code points of a chunk of text.
BLOCK_BITS = 6
CHUNK = 1024


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of int, none negative: all before it, combined; 0 for the first. Three levels of blocks."""
    size = 1 << BLOCK_BITS
    over = lambda a: F.aggregate(a, F.lit(0), combine)
    down = lambda i, level: F.call_function("shiftright", i, F.lit(BLOCK_BITS * level))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), down(F.size(a) - 1, 1)), lambda k: over(F.slice(a, k * size + 1, F.lit(size))))

    def before(a: Column, b: Column, c: Column) -> Column:
        parts = lambda i: [over(F.slice(c, F.lit(1), down(i, 2))), over(F.slice(b, down(i, 2) * size + 1, down(i, 1).bitwiseAND(size - 1))), over(F.slice(a, down(i, 1) * size + 1, i.bitwiseAND(size - 1)))]
        return F.transform(a, lambda _, i: reduce(combine, parts(i)))

    found = let(values, lambda a: let(blocks(a), lambda b: let(blocks(b), lambda c: before(a, b, c))))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, kind: str, pattern: str, good: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, kind (its place in KINDS), end>> of the leftmost matches that do not overlap, and are good."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def located(found: Column) -> Column:
        def of(gaps: Column) -> Column:
            after = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

            def spans(before: Column) -> Column:
                begin = lambda i: F.get(before, i) + F.length(F.get(gaps, i))
                return F.transform(found, lambda m, i: F.struct(begin(i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin(i) + F.length(m)).alias("end")))

            every = let(_running(after, lambda x, y: x + y), spans)
            return every if good is None else F.filter(every, lambda _, i: good(F.get(found, i)))

        return F.when(F.size(found) > 0, let(F.split(text, pattern), of)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _blob_like(found: Column) -> Column:
    """Digits, and letters of both cases: not a long word, a path or a number."""
    return found.rlike("[0-9]") & found.rlike("[a-z]") & found.rlike("[A-Z]")


def candidates(text: Column) -> tuple[Column, Column]:
    """Spans of the base kinds, and those of the weak kinds."""
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    base = F.concat(_spans(text, "assign", ASSIGN, long_enough), _spans(text, "access", ACCESS), _spans(text, "hex", HEX))
    return F.sort_array(base), F.concat(_spans(text, "ident", IDENT), _spans(text, "blob", BLOB, _blob_like), _spans(text, "endpoint", ENDPOINT))


def apart(parts: DataFrame) -> DataFrame:
    """parts (row, start, kind, end) without those that overlap one of a kind earlier in EVIDENCE."""
    ranked = parts.withColumn("rank", F.get(F.array(*[F.lit(EVIDENCE.index(k)) for k in KINDS]), F.col("kind")))
    up = Window.partitionBy("row").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    for r in range(1, len(EVIDENCE)):  # what begins before and may reach into a part, and what begins after
        ranked = ranked.withColumn(f"reach{r}", F.max(F.when(F.col("rank") < r, F.col("end"))).over(up))
    for r in range(1, len(EVIDENCE)):
        ranked = ranked.withColumn(f"next{r}", F.min(F.when(F.col("rank") < r, F.col("start"))).over(down))
    own = lambda name: F.get(F.array(F.lit(None).cast("int"), *[F.col(f"{name}{r}") for r in range(1, len(EVIDENCE))]), F.col("rank"))
    hidden = F.coalesce(own("reach") > F.col("start"), F.lit(False)) | F.coalesce(own("next") < F.col("end"), F.lit(False))
    return ranked.where(~hidden).select("row", "start", "kind", "end")


def _near(parts: DataFrame, others: DataFrame, name: str, scope: int) -> DataFrame:
    """parts with a column `name`: whether a span of others is within scope of the part. Both have (row, start, kind, end)."""
    bins = F.sequence(F.floor(F.col("start") / scope).cast("int"), F.floor(F.col("end") / scope).cast("int"))
    extents = others.withColumn("bin", F.explode(bins)).groupBy("row", "bin").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    reach = F.sequence(F.floor((F.col("start") - scope) / scope).cast("int"), F.floor((F.col("end") + scope) / scope).cast("int"))
    met = parts.withColumn("bin", F.explode(reach)).join(extents, ["row", "bin"])
    # a bin is as long as the scope: only in the first (last) bin of a reach can spans end too early (start too late)
    within = (F.col("last_end") >= F.col("start") - scope) & (F.col("first_start") <= F.col("end") + scope)
    hit = met.where(within).select("row", "start", "kind", "end").distinct().withColumn(name, F.lit(True))
    return parts.join(hit, ["row", "start", "kind", "end"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def link(found: DataFrame, scope: int) -> DataFrame:
    """found (row, base, weak): (row, linked) with the weak spans that complementary parts confirm, for rows that have some.

    An identifier counts next to a secret (a blob, a hex string or an assigned value), a blob next to an identifier (an access key or a named
    one), and an endpoint next to both. All of these are parts that don't overlap, see apart().
    """
    kind = {k: i for i, k in enumerate(KINDS)}
    every = apart(found.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*"))
    weak = every.where(F.col("kind") >= len(BASE))
    idents = every.where(F.col("kind").isin(kind["access"], kind["ident"]))
    hidden = every.where(F.col("kind").isin(kind["assign"], kind["hex"], kind["blob"]))
    judged = _near(_near(weak, idents, "by_ident", scope), hidden, "by_secret", scope)
    is_kind = lambda k: F.col("kind") == kind[k]
    kept = judged.where((is_kind("ident") & F.col("by_secret")) | (is_kind("blob") & F.col("by_ident")) | (is_kind("endpoint") & F.col("by_ident") & F.col("by_secret")))
    return kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    base, weak = candidates(text)
    return docs.select(F.monotonically_increasing_id().alias("row"), *keep, base.alias("base"), weak.alias("weak"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans, found), a row for each row of docs.

    Spans are kind:start:end in code points, the end exclusive, ordered by start, then kind. found has them as structs.
    A null text counts as empty: no spans, the hash of the empty string. A null id stays null. Repeated rows are scanned each for itself; other
    columns, whatever their names, are ignored. An empty table gives an empty result. Long texts and texts of very many matches take time in proportion.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = durable(_scanned(own, F.col("text"), [F.col("doc_id")]))
    whole = found.join(link(found, scope), "row", "left")
    spans = F.coalesce(F.sort_array(F.concat("base", "linked")), F.col("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return whole.select("doc_id", *[count(k) for k in BASE], F.size(F.coalesce("linked", F.array())).cast("long").alias("n_linked"), F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"), _said(spans).alias("spans"), spans.alias("found"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each maximal run of overlapping spans replaced by mask. spans: sorted structs."""

    def of(chunks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
            chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
            across = F.concat(F.substr(chunk(first), a % CHUNK + 1), F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substr(chunk(last), F.lit(1), b % CHUNK))
            return F.when(first == last, F.substr(chunk(first), a % CHUNK + 1, b - a)).otherwise(across)

        def joined(reach: Column) -> Column:  # reach: the furthest end before each span
            runs = F.filter(F.transform(spans, lambda s, i: F.struct(F.get(reach, i).alias("from"), s["start"].alias("to"))), lambda g: g["to"] >= g["from"])
            end = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(F.transform(runs, lambda g: F.concat(piece(g["from"], g["to"]), F.lit(mask))), ""), piece(end, F.length(text)))

        return let(_running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), joined)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(chunks, of)).otherwise(text)


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", scope: int = SCOPE) -> DataFrame:
    """docs, with its columns, every secret of its text masked, and length_col, where docs has it, brought in line.

    Null and empty texts stay as they are. Repeated rows stay, each masked for itself; rows with a null id are masked like others. Other
    columns, whatever their names, are handed through. An empty table gives an empty result.
    """
    names = docs.columns
    numbered = durable(_scanned(docs, F.coalesce(docs[text_col].cast("string"), F.lit("")), [F.struct(*[docs[c] for c in names]).alias("doc")]))
    whole = numbered.join(link(numbered.select("row", "base", "weak"), scope), "row", "left")
    spans = F.coalesce(F.sort_array(F.concat("base", "linked")), F.col("base"))
    out = whole.withColumn("clean", masked(F.col(f"doc.{text_col}"), spans))
    value = {text_col: F.col("clean")} | ({length_col: F.length("clean").cast(docs.schema[length_col].dataType)} if length_col in names else {})
    return out.select(*[value.get(c, F.col("doc").getField(c)).alias(c) for c in names])
