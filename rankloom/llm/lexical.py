"""Ranked lexical search: summed accumulators of short lists, then a walk over documents that skips in the long ones.

1. Documents are indexed in segments of bounded size, each one row: its documents, and per term the places and counts of
   the documents that hold it. A segment lists its documents by id, so places break ties as ids do.
2. Document counts and lengths of all segments give every term of an item its weight, and items are put in blocks of bounded
   size. Every block meets every segment through an equi-join on the block's number, so neither side passes the driver.
3. In a segment, the short lists of an item are added up term at a time into accumulators. These then form one iterator
   with a bound of its own, beside the long lists with theirs, in a walk document at a time: iterators whose bounds together
   stay below the k-th best score propose no documents; they are only looked up for documents that can still reach it. The
   walk takes ``WINDOW`` documents in one step.
4. A task keeps the k best documents of an item from segment to segment, which raises the bar for the next one. The k best of
   all tasks are ranked after a salted cut.

Scores are integers and exact: ties go to the lower id, null ids last.

Defined cases: null or blank text has no terms; such documents do not count and are never ranked, such items have no rows.
Repeated documents are ranked each; rows that share an item id are ranked each as an item of their own. No documents or
no items give an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

from rankloom.llm.tokens import text_slices
from rankloom.llm.words import arrow_words
from rankloom.staging import stage

TOP_K = 20
# A segment ends with this many documents or bytes of text.
SEGMENT_DOCS, SEGMENT_BYTES = 1 << 13, 16 << 20
SLICE_BYTES = 4 << 20
# Distinct terms of one block of items, and of all items up to which only their terms are indexed.
BLOCK_TERMS = 1 << 15
INDEXED_BYTES = 32 << 20
# Postings of one item that are added up term at a time, and documents of one step of the walk.
SHORT_POSTINGS = 1 << 10
WINDOW = 1 << 10
# Items whose best documents a task holds.
HELD_ITEMS = 1 << 16
SALTS = 64
# Fixed values of the score.
SCALE, SATURATION, LENGTH_SHARE = 1000, 12, 25

# Bytes of a term are 0-9, A-Z, a-z and all from 0x80; A-Z is lower-cased.
TERM_BYTES = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalnum() else b if b >= 0x80 else 0x20 for b in range(256))


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of terms per text, code of every term, distinct terms)."""
    texts = pc.fill_null(texts.cast("large_string"), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = (texts.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]):int(offsets[-1])].to_pybytes()
    plain = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data.translate(TERM_BYTES)))
    return arrow_words(plain)


def _counted(texts: pa.Array, wanted: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(terms per text; text, code and count of every distinct (text, term), all or the wanted ones; distinct terms)."""
    counts, codes, distinct = terms(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    if wanted is not None:
        asked = pc.is_in(distinct, value_set=wanted).to_numpy(zero_copy_only=False)[codes]
        owner, codes = owner[asked], codes[asked]
    keys, times = np.unique(owner * max(len(distinct), 1) + codes, return_counts=True)
    return counts, keys // max(len(distinct), 1), keys % max(len(distinct), 1), times, distinct


def index_schema(key_type: DataType) -> StructType:
    numbers = ArrayType(LongType())
    return StructType([
        StructField("segment", LongType()), StructField("n_docs", LongType()), StructField("n_terms", LongType()),
        StructField("keys", ArrayType(key_type)), StructField("sizes", numbers),
        StructField("terms", ArrayType(StringType())), StructField("df", numbers), StructField("places", numbers),
        StructField("counts", numbers)])


def index_documents(docs: DataFrame, key: str = "doc_id", text_column: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """One row per segment: ``segment, n_docs, n_terms, keys, sizes, terms, df, places, counts``.

    ``df`` cuts the lists ``places, counts`` by term. With ``wanted`` (a column ``term``) the lists of other terms are left
    out, as long as the wanted ones are small enough to be sent to all tasks; sizes always count all terms.
    """
    schema = index_schema(docs.schema[key].dataType)
    arrow_schema = to_arrow_schema(schema)
    vocabulary = None
    if wanted is not None:
        n_bytes = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
        if n_bytes <= INDEXED_BYTES:
            vocabulary = docs.sparkSession.sparkContext.broadcast(
                wanted.toArrow()["term"].combine_chunks().cast("large_string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        parts, n_docs, n_bytes = [], 0, 0
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE_BYTES):
                parts.append((part.column(0), *_counted(part.column("_text"), vocabulary and vocabulary.value)))
                n_docs += part.num_rows
                n_bytes += part.column("_text").nbytes
                if n_docs >= SEGMENT_DOCS or n_bytes >= SEGMENT_BYTES:
                    yield segment_row(number, parts, arrow_schema)
                    parts, n_docs, n_bytes, number = [], 0, 0, number + 1
        if parts:
            yield segment_row(number, parts, arrow_schema)

    return docs.select(docs[key], docs[text_column].alias("_text")).mapInArrow(run, schema)


def segment_row(number: int, parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    keys = pa.concat_arrays([p[0] for p in parts])
    sizes = np.concatenate([p[1] for p in parts])
    first_doc = np.cumsum([0, *(len(p[1]) for p in parts)])
    first_term = np.cumsum([0, *(len(p[5]) for p in parts)])
    owner = np.concatenate([p[2] + d for p, d in zip(parts, first_doc)])
    times = np.concatenate([p[4] for p in parts])
    coded = pa.concat_arrays([p[5].cast("large_string") for p in parts]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[
        np.concatenate([p[3] + t for p, t in zip(parts, first_term)])] if len(owner) else np.zeros(0, np.int64)
    by_key = pc.sort_indices(keys, null_placement="at_end").to_numpy()
    place = np.empty(len(keys), np.int64)
    place[by_key] = np.arange(len(keys))
    order = np.lexsort((place[owner], codes))
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    row = {"segment": number, "n_docs": int((sizes > 0).sum()), "n_terms": int(sizes.sum())}
    lists = {"keys": keys.take(pa.array(by_key)), "sizes": pa.array(sizes[by_key].astype(np.int64)),
             "terms": coded.dictionary.take(pa.array(codes[starts])), "df": pa.array(np.diff(starts, append=len(codes))),
             "places": pa.array(place[owner][order]), "counts": pa.array(times[order].astype(np.int64))}
    columns = []
    for field in schema:
        if field.name in row:
            columns.append(pa.array([row[field.name]], field.type))
        else:
            values = lists[field.name].cast(field.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def item_terms(items: DataFrame, text_column: str) -> DataFrame:
    """``item, term, times`` of every distinct term of rows ``item, text``."""
    schema = to_arrow_schema(StructType().add("item", LongType()).add("term", StringType()).add("times", LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE_BYTES):
                _, owner, codes, times, distinct = _counted(part.column("_text"), None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), distinct.take(pa.array(codes)).cast(schema[1].type),
                     pa.array(times.astype(np.int64))], schema=schema)

    return items.select("item", F.col(text_column).alias("_text")).mapInArrow(run, "item bigint, term string, times bigint")


@dataclass
class Lists:
    """Bounded iterators over places, each sorted, with their scores."""
    places: list[np.ndarray]
    scores: list[np.ndarray]
    bounds: list[int]


class Best:
    """The k best (score, place) of one item in one segment."""

    def __init__(self, k: int, bar: int):
        self.k, self.bar = k, bar
        self.scores, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, places: np.ndarray) -> None:
        keep = scores >= self.bar
        scores, places = np.append(self.scores, scores[keep]), np.append(self.places, places[keep])
        order = np.lexsort((places, -scores))[:self.k]
        self.scores, self.places = scores[order], places[order]
        if len(order) == self.k:
            self.bar = max(self.bar, int(self.scores[-1]))


def accumulate(lists: Lists) -> tuple[Lists, int]:
    """Short lists as one of summed accumulators, in front of the long ones; and the number of postings added up."""
    sizes = np.array([len(p) for p in lists.places])
    by_size = np.argsort(sizes, kind="stable")
    short = by_size[np.cumsum(sizes[by_size]) <= SHORT_POSTINGS]
    if not len(short):
        return lists, 0
    places = np.concatenate([lists.places[i] for i in short])
    scores = np.concatenate([lists.scores[i] for i in short])
    order = np.argsort(places, kind="stable")
    places = places[order]
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    sums = np.add.reduceat(scores[order], starts)
    long = [i for i in range(len(sizes)) if i not in set(short.tolist())]
    return Lists([places[starts], *(lists.places[i] for i in long)], [sums, *(lists.scores[i] for i in long)],
                 [int(sums.max()), *(lists.bounds[i] for i in long)]), len(places)


def walk(lists: Lists, n_docs: int, best: Best) -> int:
    """Puts all documents that reach the bar into ``best``; returns the number of postings looked at."""
    joined, seen = accumulate(lists)
    if joined is not lists and len(joined.scores[0]) >= best.k:
        # An accumulator never exceeds the whole score, so the k-th of them is a bar.
        best.bar = max(best.bar, int(np.partition(joined.scores[0], -best.k)[-best.k]))
    order = np.argsort(joined.bounds, kind="stable")
    places, scores = [joined.places[i] for i in order], [joined.scores[i] for i in order]
    below = np.cumsum([joined.bounds[i] for i in order])
    n, at = len(places), 0
    while at < n_docs:
        # The iterators that propose documents: without them no score reaches the bar.
        first = int(np.searchsorted(below, best.bar, side="left"))
        if first == n:
            break
        heads = [int(np.searchsorted(p, at)) for p in places[first:]]
        nexts = [int(p[h]) for p, h in zip(places[first:], heads) if h < len(p)]
        if not nexts:
            break
        at = min(nexts)
        until = at + WINDOW
        total, met = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for p, s in zip(places[first:], scores[first:]):
            low, high = np.searchsorted(p, (at, until))
            total[p[low:high] - at] += s[low:high]
            met[p[low:high] - at] = True
            seen += int(high - low)
        found = np.flatnonzero(met)
        for i in range(first - 1, -1, -1):
            found = found[total[found] + below[i] >= best.bar]
            if not len(found):
                break
            where = np.searchsorted(places[i], found + at)
            inside = where < len(places[i])
            hit = inside.copy()
            hit[inside] = places[i][where[inside]] == found[inside] + at
            total[found[hit]] += scores[i][where[hit]]
            seen += len(found)
        if len(found):
            best.add(total[found], found + at)
        at = until
    return seen


class Segment:
    """A segment with the scores of its postings before weights."""

    def __init__(self, row: dict[str, np.ndarray], n_docs: int, n_terms: int):
        self.n_docs = len(row["sizes"])
        length = 100 - LENGTH_SHARE + (LENGTH_SHARE * row["sizes"] * n_docs) // max(n_terms, 1)
        tf = row["counts"]
        self.scores = (10 ** 6 * SCALE * tf) // (SCALE * tf + SATURATION * length[row["places"]])
        self.places = row["places"]
        self.ends = np.cumsum(row["df"])
        self.starts = self.ends - row["df"]
        self.most = np.maximum.reduceat(self.scores, self.starts) if len(self.starts) else self.scores
        self.number = {term: i for i, term in enumerate(row["terms"])}

    def lists(self, asked: list[str], factors: np.ndarray) -> Lists:
        found = Lists([], [], [])
        for term, factor in zip(asked, factors.tolist()):
            i = self.number.get(term)
            if i is not None and factor > 0:
                found.places.append(self.places[self.starts[i]:self.ends[i]])
                found.scores.append(self.scores[self.starts[i]:self.ends[i]] * factor)
                found.bounds.append(int(self.most[i]) * factor)
        return found


class Held:
    """The best documents of items that a task has met."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def bar(self, item: int) -> int:
        rows = self.of.get(item, ())
        # Scores of 0 are no results.
        return -rows[-1][0] if len(rows) == self.k else 1

    def add(self, item: int, scores: np.ndarray, keys: list) -> None:
        rows = [*self.of.get(item, ()), *((-s, k is None, k) for s, k in zip(scores.tolist(), keys))]
        self.of[item] = sorted(rows, key=lambda r: r if not r[1] else r[:2])[:self.k]

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        flat = [(item, key, -score) for item, rows in self.of.items() for score, _, key in rows]
        self.of = {}
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat) if flat else [[]] * 3, schema)],
                                          schema=schema)


def _items_in_blocks(item_rows: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """``block, items``: items of bounded numbers of terms with their weights."""
    df = (index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df")
          .withColumnsRenamed({"terms": "term"})
          .join(item_rows.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.ln((2 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = (item_rows.join(df, "term").groupBy("item")
               .agg(F.collect_list(F.struct("term", (weight * F.col("times")).cast("long").alias("factor"))).alias("asked")))
    n_terms = item_rows.count()
    block = F.pmod(F.xxhash64("item"), F.lit(-(-max(n_terms, 1) // BLOCK_TERMS)))
    return (weighed.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item", "asked")).alias("items")))


def search_index(index: DataFrame, item_rows: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """``item, key, score``: the best documents of each item in each task, from a written index and ``item_terms``."""
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks = stage(_items_in_blocks(item_rows, index, n_docs), "item-blocks")
    n_blocks = -(-max(item_rows.count(), 1) // BLOCK_TERMS)
    lists = ("keys", "sizes", "terms", "df", "places", "counts")
    key_type = index.schema["keys"].dataType.elementType
    schema = StructType([StructField("item", LongType()), StructField("key", key_type), StructField("score", LongType())])
    arrow_schema = to_arrow_schema(schema)
    # A block of items goes once to every salt; segments are dealt to them by their number.
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    met = (index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
           .withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int"))
           .join(blocks.select("block", "items", spread), ["block", "salt"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = Held(top_k), None
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                row = {name: batch.column(1 + c)[i].values for c, name in enumerate(lists)}
                if opened is None or opened[0] != number:
                    opened = number, Segment({name: v.to_pylist() if name == "terms" else v if name == "keys" else
                                              v.to_numpy(zero_copy_only=False) for name, v in row.items()}, n_docs, n_terms)
                segment = opened[1]
                for item in batch.column(len(lists) + 1)[i].as_py():
                    found = segment.lists([t["term"] for t in item["asked"]],
                                          np.array([t["factor"] for t in item["asked"]], np.int64))
                    if not found.places:
                        continue
                    best = Best(top_k, held.bar(item["item"]))
                    walk(found, segment.n_docs, best)
                    if len(best.places):
                        held.add(item["item"], best.scores, row["keys"].take(pa.array(best.places)).to_pylist())
                if len(held.of) > HELD_ITEMS:
                    yield held.rows(arrow_schema)
        yield held.rows(arrow_schema)

    return met.select("segment", *lists, "items").mapInArrow(run, schema)


def _first(rows: DataFrame, by: list[Column], top_k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text_column: str = "text", item_key: str = "item_id",
                   item_text: str = "text", top_k: int = TOP_K) -> DataFrame:
    """``item_key, rank, key, score``: the ``top_k`` documents of each item with a score above 0."""
    numbered = stage(items.select(F.col(item_key).alias("name"), F.col(item_text).alias("text"))
                     .withColumn("item", F.monotonically_increasing_id()), "items")
    item_rows = stage(item_terms(numbered, "text"), "item-terms")
    index = stage(index_documents(docs, key, text_column, item_rows.select("term").distinct()), "index")
    found = search_index(index, item_rows, top_k)
    salted = _first(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), [F.col("item"), F.col("salt")], top_k)
    ranked = _first(salted.select("item", "key", "score"), [F.col("item")], top_k)
    return (ranked.join(numbered.select("item", "name"), "item")
            .select(F.col("name").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"))
