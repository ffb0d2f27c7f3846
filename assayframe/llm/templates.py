"""Main text of web pages by deducing the template that the pages of a host share.

A page is a row of tokens: its tags and its runs of text, told apart by their path of elements. A token's occurrence vector says how often each page of
the host has it. Tokens with equal vectors on at least half of the host's pages are an equivalence class; a class is valid if its tokens, of which
one is a tag, keep one order on every page, cycle by cycle, and its cycles and those of other classes nest. Valid classes make the template; its
runs of text are furniture (menus, notices, captions), the rest are slots, whose text is extracted where the markup doesn't name it as
navigation, advert, form and the like. Slots whose text is mostly links are menus.

Vectors never exist as lists: supports are counted, and vectors compared by an XOR over pages of a hash of page and count. Copies of a page count once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, record_batch, table
from .markup import BLANK, EXCLUDED, IN_ARTICLE, IN_MAIN, LINKED, article, tokens
from .windows import mix

#: Distinct pages that a host needs for a template, the share of them that a class must be on, and its tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 6, 0.5, 3
#: If more of the text inside articles than this would be furniture, the host's pages are versions of each other, and no text inside is.
MOST_FURNITURE = 0.2
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def token_rows(pages: DataFrame) -> DataFrame:
    """(host, content, keys, chars, zones) of pages (host, html): chars are -1 for tags, content tells different pages apart."""
    bounded_batches(pages.sparkSession)
    schema = pa.schema([("host", pa.string()), ("content", pa.int64()), ("keys", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32())), ("zones", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, keys, chars, zones = [], [], [], []
            for html in batch.column(1):
                page = tokens(html.as_py())
                keys.append(signed(page.keys))
                content.append(xxhash.xxh64_intdigest(keys[-1].tobytes()))
                chars.append([-1 if t is None else len(t) for t in page.texts])
                zones.append(page.zones)
            yield record_batch(schema, [batch.column(0), signed(content), keys, chars, zones])

    return pages.select("host", "html").mapInArrow(run, "host string, content long, keys array<long>, chars array<int>, zones array<int>")


def vectors(rows: DataFrame) -> DataFrame:
    """(host, key, support, vector, is_tag): each task sums up its pages before anything is shuffled."""
    schema = pa.schema([("host", pa.string()), ("key", pa.int64()), ("support", pa.int64()), ("vector", pa.int64()), ("is_tag", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, host = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            lists = batch.column(2)
            page = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            key, tag = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy() < 0
            some = key != BLANK
            page, key, tag = page[some], key[some], tag[some]
            if not len(key):
                continue
            order = np.lexsort((key, page))
            page, key, tag = page[order], key[order], tag[order]
            first = np.flatnonzero(np.r_[True, (page[1:] != page[:-1]) | (key[1:] != key[:-1])])
            count = np.diff(np.r_[first, len(key)]).astype(np.uint64)
            page, key, tag = page[first], key[first], tag[first]
            hashed = mix(batch.column(1).to_numpy().view(np.uint64)[page] ^ mix(count + np.uint64(1)))
            own = host[page]
            order = np.lexsort((key, own))
            own, key, tag, hashed = own[order], key[order], tag[order], hashed[order]
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
            yield record_batch(schema, [hosts[own[first]].tolist(), key[first], np.diff(np.r_[first, len(key)]), np.bitwise_xor.reduceat(hashed, first).view(np.int64), tag[first]])

    summed = rows.mapInArrow(run, "host string, key long, support long, vector long, is_tag boolean")
    return summed.groupBy("host", "key").agg(F.sum("support").alias("support"), F.bit_xor("vector").alias("vector"), F.max("is_tag").alias("is_tag"))


def classes(rows: DataFrame) -> DataFrame:
    """(host, keys, classes): per host the keys of its equivalence classes, and the class of each. A host has at most 1 / LEAST_SHARE pages' worth of keys."""
    n_pages = rows.groupBy("host").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    frequent = vectors(rows).join(n_pages, "host").where(F.col("support") >= F.col("n_pages") * LEAST_SHARE)
    grouped = frequent.groupBy("host", "support", "vector").agg(F.collect_list("key").alias("members"), F.max("is_tag").alias("has_tag"))
    large = grouped.where(F.col("has_tag") & (F.size("members") >= LEAST_TOKENS))
    member = large.select("host", F.explode("members").alias("key"), F.xxhash64("support", "vector").alias("class"))
    return member.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "key"))).alias("found")).select("host", F.col("found.key").alias("keys"), F.col("found.class").alias("classes"))


def order_and_nesting(keys: np.ndarray, of: dict[int, int]) -> dict[int, tuple[int, bool]]:
    """For each class on a page: a hash of the order of its tokens (0 if its cycles differ), and whether its cycles nest with those of others."""
    places = defaultdict(list)
    for i, k in enumerate(keys.tolist()):
        if k in of:
            places[of[k]].append((i, k))
    found, spans = {}, {}
    for c, seen in places.items():
        width = len({k for _, k in seen})
        cycles = [tuple(k for _, k in seen[n : n + width]) for n in range(0, len(seen), width)]
        same = len(set(cycles)) == 1 and len(set(cycles[0])) == width
        found[c] = (xxhash.xxh64_intdigest(np.array(cycles[0], np.int64).tobytes()) | 1 if same else 0, True)
        spans[c] = (np.array([x[0] for x in seen[::width]]), np.array([x[0] for x in seen[width - 1 :: width]]) if same else None)
    widths = {c: len({k for _, k in seen}) for c, seen in places.items()}
    for c, (starts, ends) in spans.items():
        for other, seen in places.items():
            outer = (len(spans[other][0]), -widths[other]) < (len(starts), -widths[c])  # fewer cycles, or as many with more tokens
            if ends is None or other == c or not outer:
                continue
            at = np.array([i for i, _ in seen])  # a cycle of c holds whole cycles of the other, or none of its tokens
            if ((np.searchsorted(at, ends) - np.searchsorted(at, starts)) % widths[other]).any():
                found[c] = (found[c][0], False)
                break
    return found


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(host, kind, id, ...): per class its orders and nesting, per slot its text and linked text, per run of text in an article how much it is."""
    schema = pa.schema([("host", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("nests", pa.bool_()), ("chars", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}

            def add(host, kind, id, low=0, high=0, nests=True, chars=0, linked=0, sums=sums):
                x = sums.setdefault((host, kind, id), [low, high, True, 0, 0])
                x[:] = min(x[0], low), max(x[1], high), x[2] and nests, x[3] + chars, x[4] + linked

            maps: dict[str, dict[int, int]] = {}
            for host, keys, chars, zones, own, cls in zip(*(batch.column(i) for i in range(6)), strict=True):
                host = host.as_py()
                if host not in maps:
                    maps[host] = dict(zip(own.as_py(), cls.as_py(), strict=True))
                of, keys = maps[host], keys.values.to_numpy()
                for c, (order, nests) in order_and_nesting(keys, of).items():
                    order = int(signed([order])[0])
                    add(host, "class", c, order, order, nests)
                slot = 0
                for k, n, z in zip(keys.tolist(), chars.as_py(), zones.as_py(), strict=True):
                    slot = k if k in of else slot
                    if n > 0 and not z & EXCLUDED:
                        if z & (IN_ARTICLE | IN_MAIN):
                            add(host, "inside", k if k in of else 0, chars=n)
                        else:
                            add(host, "slot", slot, chars=n, linked=n if z & LINKED else 0)
            yield record_batch(schema, [[k[i] for k in sums] for i in range(3)] + [[v[i] for v in sums.values()] for i in range(5)])

    joined = rows.join(found.withColumnRenamed("keys", "own"), "host").select("host", "keys", "chars", "zones", "own", "classes")
    parts = joined.mapInArrow(run, "host string, kind string, id long, low long, high long, nests boolean, chars long, linked long")
    return parts.groupBy("host", "kind", "id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("nests").alias("nests"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))


def deduce(pages: DataFrame) -> DataFrame:
    """(host, template, furniture, menus) for each host of pages (host, html) that has a template: keys of tokens."""
    rows = table(token_rows(pages.where("host <> ''")).dropDuplicates(["host", "content"]), "page_tokens")
    found = table(classes(rows), "classes")
    facts = table(judged(rows, found), "template_facts")
    valid = facts.where("kind = 'class' AND nests AND low = high AND low <> 0").groupBy("host").agg(F.collect_list("id").alias("valid"))
    template = found.join(valid, "host").select("host", F.transform(F.filter(F.arrays_zip("keys", "classes"), lambda x: F.array_contains("valid", x["classes"])), lambda x: x["keys"]).alias("template"))
    inside = facts.where("kind = 'inside'").groupBy("host").agg(
        F.sum("chars").alias("all_chars"), F.sum(F.when(F.col("id") != 0, F.col("chars"))).alias("repeated"), F.collect_list(F.when(F.col("id") != 0, F.col("id"))).alias("inside")
    )
    menus = facts.where("kind = 'slot' AND id <> 0 AND linked * 2 > chars").groupBy("host").agg(F.collect_list("id").alias("menus"))
    none = F.array().cast("array<long>")
    versions = F.coalesce(F.col("repeated") > F.col("all_chars") * MOST_FURNITURE, F.lit(False))
    furniture = F.when(versions, F.array_except("template", F.coalesce("inside", none))).otherwise(F.col("template"))
    return template.join(inside, "host", "left").join(menus, "host", "left").select("host", "template", furniture.alias("furniture"), F.coalesce("menus", none).alias("menus"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages: its main text, blocks joined by one line feed.

    A null or empty html has an empty text. A page without a host (null url, or none of the form scheme://host) or of a host with fewer than
    LEAST_PAGES different pages is read by its markup alone. Repeated rows have repeated results and count once for the template. Inside an article
    nothing is dropped but excluded elements and furniture. Headings stay; a line break inside a block counts as white space. Pages of any length are read
    whole, and so is markup that is never closed. An empty table gives no rows. Other columns are ignored, whatever their names; id and url stay as they are.
    """
    own = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("host", F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)))
    known = table(deduce(own), "templates")
    joined = own.join(known, "host", "left").select("html", "host", "template", "furniture", "menus", "page_id", "url")
    bounded_batches(pages.sparkSession)
    kept = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, list[frozenset]] = {}
            texts = []
            for html, host, *lists in zip(*(batch.column(i) for i in range(5)), strict=True):
                host = host.as_py()
                if host not in sets:
                    sets[host] = [frozenset((v.values.to_numpy().view(np.uint64) if v.is_valid else np.empty(0, np.uint64)).tolist()) for v in lists]
                template, furniture, menus = sets[host]
                texts.append(article(tokens(html.as_py()), furniture, template, menus))
            schema = pa.schema([batch.schema.field(5), batch.schema.field(6), *kept])
            yield record_batch(schema, [batch.column(5), batch.column(6), texts, [len(t) for t in texts]])

    types = dict(joined.dtypes)
    return joined.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
