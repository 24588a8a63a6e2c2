"""All pairs of documents of one table whose TF-IDF cosine reaches a threshold, exactly.

1. Documents of equal words are one vector. Terms are numbered by rising document frequency, rare ones first; those that
   only one document has count for its length and are not kept.
2. A folded vector has a number for each of a fixed count of buckets of terms: the norm of what the vector has there. The product
   of two folded vectors is at least their cosine (Cauchy and Schwarz, bucket by bucket).
3. Vectors are packed into blocks of bounded size, a few bytes a number, and consecutive blocks are parts. Part meets part:
   a vector travels once for each part, not for each of its terms. A task holds one part as it was packed, and unpacks two
   blocks at a time.
4. In a meeting folded vectors are multiplied as matrices, all with all; the cosines of the pairs whose bound reaches the threshold are
   computed in full. Pairs become rows, or are only counted, after that.

Parts are a seventh of the table until they reach their bound, so shuffles follow the input; beyond, their number grows with
the table, and so do the times that a vector travels. Comparisons are quadratic by nature.

Defined cases: a document without tokens links with nothing, not with its like, and is a class of its own. Rows that share an
id are documents of their own. A class whose ids are all null has a null class id. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from rankloom.operators.grams import distinct_counts, token_slices
from rankloom.operators.joins import fits_broadcast, join_lookup
from rankloom.operators.parts import pair_up_parts
from rankloom.operators.tfidf import term_counts, term_stats
from rankloom.staging import drop_staged, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Members and numbers of one part and of one block, and the least number of parts of a table that has as many blocks.
PART_MEMBERS, PART_NUMBERS, BLOCK_MEMBERS, BLOCK_NUMBERS, PARTS = 1 << 20, 1 << 25, 4096, 1 << 19, 7
# Cells of one square of bounds, numbers and cells of vectors that are spelled out at once (so few that they stay in a processor's
# cache), and blocks of the second part that are open at once.
CELLS, MATCHES, SPELLED, OPEN = 1 << 21, 1 << 18, 1 << 20, 8
# Pairs whose folded vectors are multiplied one by one, at once.
PAIRS = 1 << 7
# Buckets of a folded vector, and terms that have one of their own; the same of a vector that is folded again, ``AGAIN`` to one.
WIDTH, FREQUENT, AGAIN = 2048, 512, 7
FIRST = (WIDTH - WIDTH // 8) // AGAIN + WIDTH // 8
# Tokens of texts that are weighed together.
TOKENS = 1 << 19
# Scores are compared at 9 places; bounds are summed in single precision and must not lose one: ``WIDTH`` times 6e-8 at most.
PLACES, SLACK = 9, 1e-4
MEETING = ("one", "other")
# Arrays of a block; those that rise are kept as differences.
BLOCK = {"nodes": np.int64, "copies": np.int64, "sizes": np.int32, "norms": np.float64, "words": np.int64, "idfs": np.float64,
         "codes": np.int32, "tfs": np.int32}
RISING = ("nodes", "words", "codes")


@dataclass(frozen=True)
class DistinctVectors:
    """``members``: ``doc_id, node``, one row per document; ``vectors``: ``node, least, n, norm, terms, tfs, idfs``, with the
    terms that several documents have in order of their numbers, and the norm of all; ``frequent``: the numbers of the most
    frequent terms, rising."""
    members: DataFrame
    vectors: DataFrame
    frequent: np.ndarray


def numbered_terms(stats: DataFrame) -> DataFrame:
    """``term, number, df`` with numbers that rise with the document frequency, given without passing one task."""
    return stage(stats.select("term", F.col("df").cast("int").alias("df")).where("df > 1")
                 .repartitionByRange("df", "term").sortWithinPartitions("df", "term")
                 .select("term", F.monotonically_increasing_id().alias("number"), "df"), "terms")


def distinct_vectors(tokens: DataFrame) -> DistinctVectors:
    """TF-IDF over all terms of ``doc_id, tokens``; equal vectors are one."""
    mark = F.when(F.size("tokens") > 0, F.sha2(F.to_json(F.sort_array("tokens")), 256))
    rows = tokens.select("doc_id", "tokens").withColumn("row", F.monotonically_increasing_id()).withColumn("mark", mark)
    with drop_staged(tokens.sparkSession, ("members", "vectors")):
        rows = stage(rows, "rows")
        texts = stage(rows.where("mark IS NOT NULL").groupBy("mark")
                      .agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "texts")
        named = rows.select("doc_id", "mark").join(texts.select("mark", "node"), "mark", "left")
        members = stage(named.select("doc_id", "node"), "members")
        terms = numbered_terms(term_stats(rows, (1, 1)))
        # Numbers rise with the frequency.
        top = terms.orderBy(F.desc("number")).limit(FREQUENT).select("number").toArrow()["number"].to_numpy()
        n_docs = rows.count()
        read = join_lookup(rows.select(F.col("row").alias("node"), "tokens"), texts.select("node", "least", "n"), "node", "inner")
        weighed = _weighed if fits_broadcast(terms.select("term")) else _weighed_by_join
        vectors = stage(weighed(read, terms, n_docs), "vectors")
    return DistinctVectors(members, vectors, np.sort(top))


def _weighed(read: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """``DistinctVectors.vectors`` of ``node, tokens, least, n``, made where the texts lie: the terms go to all tasks."""
    table = terms.orderBy("number").select("term", "number", "df").toArrow().combine_chunks()
    held = read.sparkSession.sparkContext.broadcast(table)
    alone = np.log((1.0 + n_docs) / 2.0) + 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value["term"].cast("large_string").combine_chunks()
        numbers = held.value["number"].to_numpy()
        idfs = np.log((1.0 + n_docs) / (1.0 + held.value["df"].to_numpy())) + 1.0
        for batch in token_slices(batches, "tokens", TOKENS):
            lists = batch.column("tokens")
            coded = lists.flatten().cast("large_string").dictionary_encode()
            # Terms go by their place in the list, those that only one document has behind all of it.
            place = pc.index_in(coded.dictionary, value_set=known)
            place = np.where(place.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(place, 0).to_numpy(),
                             len(known) + np.arange(len(place))).astype(np.int64)
            size = len(known) + len(place) + 1
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            keys, tfs = distinct_counts(row * size + place[coded.indices.to_numpy()])
            row, place = np.divmod(keys, size)
            shared = place < len(known)
            idf = np.full(len(place), alone)
            idf[shared] = idfs[place[shared]]
            norms = np.sqrt(np.bincount(row, (tfs * idf) ** 2, len(lists)))
            offsets = pa.array(np.searchsorted(row[shared], np.arange(len(lists) + 1)).astype(np.int32))
            listed = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "least", "n")), pa.array(norms), listed(numbers[place[shared]]),
                 listed(tfs[shared].astype(np.int32)), listed(idf[shared])],
                names=["node", "least", "n", "norm", "terms", "tfs", "idfs"])

    least = read.schema["least"].dataType.simpleString()
    return read.select("node", "least", "n", "tokens").mapInArrow(
        run, f"node bigint, least {least}, n bigint, norm double, terms array<bigint>, tfs array<int>, idfs array<double>")


def _weighed_by_join(read: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """The same where the terms are too many to go to all tasks."""
    idf = lambda df: F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + df)) + 1.0
    counts = term_counts(read.select(F.col("node").alias("doc_id"), "tokens")).withColumnRenamed("doc_id", "node")
    weight = F.col("tf") * idf(F.coalesce("df", F.lit(1)))
    entry = F.when(F.col("number").isNotNull(), F.struct("number", F.col("tf").cast("int").alias("tf"), "df"))
    vectors = (join_lookup(counts, terms, "term", "left").groupBy("node")
               .agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.sqrt(F.sum(weight * weight)).alias("norm")))
    return (join_lookup(vectors, read.select("node", "least", "n"), "node", "inner")
            .select("node", "least", "n", "norm", F.col("entries.number").alias("terms"), F.col("entries.tf").alias("tfs"),
                    F.transform("entries.df", idf).alias("idfs")))


def pack(name: str, values: np.ndarray) -> bytes:
    """The bytes of an array, the first bytes of all values before the second ones, so that they compress well."""
    values = values.astype(BLOCK[name])
    values = np.diff(values, prepend=values.dtype.type(0)) if name in RISING else values
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpack(name: str, packed: pa.Buffer) -> np.ndarray:
    width = np.dtype(BLOCK[name]).itemsize
    values = np.frombuffer(packed, np.uint8).reshape(width, -1).T.copy().view(BLOCK[name]).ravel()
    return np.cumsum(values, dtype=BLOCK[name]) if name in RISING else values


def _block(rows: pa.Table, number: int) -> pa.RecordBatch:
    """One block: the members' numbers, and its own list of terms that ``codes`` point into."""
    column = lambda name: rows[name].combine_chunks()
    terms = column("terms")
    words, first, codes = np.unique(terms.flatten().to_numpy(), return_index=True, return_inverse=True)
    parts = {"nodes": column("node").to_numpy(), "copies": column("n").to_numpy(), "sizes": np.diff(terms.offsets.to_numpy()),
             "norms": column("norm").to_numpy(), "words": words, "idfs": column("idfs").flatten().to_numpy()[first], "codes": codes,
             "tfs": column("tfs").flatten().to_numpy()}
    return pa.RecordBatch.from_pydict(
        {"block": pa.array([number], pa.int64()), "members": pa.array([rows.num_rows], pa.int64()),
         "numbers": pa.array([len(codes)], pa.int64())}
        | {name: pa.array([pack(name, parts[name])], pa.binary()) for name in BLOCK})


def blocks(vectors: DataFrame) -> DataFrame:
    """``block, members, numbers`` and the BLOCK columns; a vector that is larger than a block is a block of its own."""
    members, numbers = min(BLOCK_MEMBERS, PART_MEMBERS), BLOCK_NUMBERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            offsets, start = batch.column("terms").offsets.to_numpy().astype(np.int64), 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[start] + numbers - size, side="right")) - 1
                stop = min(stop, start + members - sum(x.num_rows for x in held), batch.num_rows)
                if stop <= start and held:
                    yield _block(pa.Table.from_batches(held), number)
                    number, held, size = number + 1, [], 0
                    continue
                stop = max(stop, start + 1)
                held.append(batch.slice(start, stop - start))
                size, start = size + int(offsets[stop] - offsets[start]), stop
        if held:
            yield _block(pa.Table.from_batches(held), number)

    some = vectors.where(F.size("terms") > 0).select("node", "n", "norm", "terms", "tfs", "idfs")
    kinds = ", ".join(["block bigint, members bigint, numbers bigint", *[f"{name} binary" for name in BLOCK]])
    return stage(some.mapInArrow(run, kinds), "blocks")


def deal(sizes: list[tuple[int, int, int]]) -> dict[int, int]:
    """Part of every block of ``block, members, numbers``: consecutive blocks, as many as a part may hold."""
    bound = min(PART_NUMBERS, -(-sum(x[2] for x in sizes) // PARTS))
    part, members, numbers, parts = 0, 0, 0, {}
    for block, more_members, more_numbers in sorted(sizes):
        if members and (members + more_members > PART_MEMBERS or numbers + more_numbers // 2 > bound):
            part, members, numbers = part + 1, 0, 0
        parts[block] = part
        members, numbers = members + more_members, numbers + more_numbers
    return parts


def meetings(vectors: DataFrame, threshold: float) -> DataFrame:
    """``MEETING, side, block`` and the BLOCK columns: blocks in the parts that meet, in the order in which they are read."""
    written = blocks(vectors)
    # A row for each block of half a million numbers.
    dealt = deal([tuple(r) for r in written.select("block", "members", "numbers").collect()])
    parts = max(dealt.values(), default=0) + 1
    numbered = vectors.sparkSession.createDataFrame([(b, p, parts) for b, p in dealt.items()], "block long, part int, parts int")
    pairs = pair_up_parts(written.join(F.broadcast(numbered), "block"), "part", "parts")
    return (pairs.select(*MEETING, "side", "block", *BLOCK)
            .repartitionById(parts * (parts + 1) // 2, (F.col("other") * (F.col("other") + 1) / 2).cast("int") + F.col("one"))
            .sortWithinPartitions(*MEETING, "side", "block"))


class Block:
    """A block's vectors at unit length, and folded: the norm of what they have in each of ``WIDTH`` buckets of terms, and
    in each of ``FIRST``, which hold a few of these each but for the most frequent terms."""

    def __init__(self, parts: dict[str, np.ndarray], frequent: np.ndarray):
        self.nodes, self.copies, self.sizes = parts["nodes"], parts["copies"], parts["sizes"].astype(np.int64)
        self.n, self.words, self.codes = len(self.nodes), parts["words"], parts["codes"].astype(np.int64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.values = parts["tfs"] * parts["idfs"][self.codes] / parts["norms"][owner]
        bucket = buckets(self.words, frequent)[self.codes]
        squares = np.bincount(owner * WIDTH + bucket, self.values * self.values, self.n * WIDTH).reshape(self.n, WIDTH)
        self.folded, own = np.sqrt(squares).astype(np.float32), WIDTH // 8
        self.first = np.concatenate([self.folded[:, :own], np.sqrt(squares[:, own:].reshape(self.n, -1, AGAIN).sum(axis=2))],
                                    axis=1, dtype=np.float32, casting="same_kind")


def buckets(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Bucket of each term number: frequent terms have their own ones, the most frequent first; the others share the rest."""
    place = np.minimum(np.searchsorted(frequent, words), max(len(frequent) - 1, 0))
    own = frequent[place] == words if len(frequent) else np.zeros(len(words), bool)
    mixed = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    shared = len(frequent) + (mixed % np.uint64(WIDTH - len(frequent))).astype(np.int64)
    return np.where(own, len(frequent) - 1 - place, shared)


def _ranges(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose counts are at most ``most`` together, or of one entry."""
    edges, start = np.concatenate([[0], np.cumsum(counts)]), 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + most, side="right")) - 1)
        yield start, stop
        start = stop


def _spelled(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, place) of all places ``first .. first + counts`` of every entry."""
    entry = np.repeat(np.arange(len(counts)), counts)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts) + first[entry]


def cosines(left: Block, right: Block, where: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine of the vectors i, which rise, and j, rounded; ``where`` has the right code of the left block's words, -1 for none.

    A few vectors of the left are spelled out over the right block's words at a time, where the right ones look them up.
    """
    scores, width = np.zeros(len(i)), max(len(right.words), 1)
    held = np.zeros(max(1, SPELLED // width) * width)
    for start, stop in _ranges(right.sizes[j], MATCHES):
        firsts = start + np.flatnonzero(np.diff(i[start:stop], prepend=-1))
        for some in range(0, len(firsts), len(held) // width):
            own = firsts[some:some + len(held) // width]
            end = firsts[some + len(own)] if some + len(own) < len(firsts) else stop
            row, place = _spelled(left.starts[i[own]], left.sizes[i[own]])
            code = where[left.codes[place]]
            row, place, code = (x[code >= 0] for x in (row, place, code))
            held[row * width + code] = left.values[place]
            pair, at = _spelled(right.starts[j[own[0]:end]], right.sizes[j[own[0]:end]])
            line = np.repeat(np.arange(len(own)), np.diff(np.append(own, end)))
            scores[own[0]:end] = np.bincount(pair, held[line[pair] * width + right.codes[at]] * right.values[at], end - own[0])
            held[row * width + code] = 0.0
    return np.round(scores, PLACES)


def similar_in_meeting(left: Block, right: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left member, right member, cosine) of the pairs that reach the threshold; of a block with itself each pair once."""
    place = np.minimum(np.searchsorted(right.words, left.words), len(right.words) - 1)
    where = np.where(right.words[place] == left.words, place, -1)
    step, least = max(1, CELLS // right.n), np.float32(threshold - SLACK)
    held = np.empty((min(step, left.n), right.n), np.float32)
    for top in range(0, left.n, step):
        # No cosine is above the product of the folded vectors.
        bounds = np.matmul(left.first[top:top + step], right.first.T, out=held[:min(step, left.n - top)])
        i, j = np.divmod(np.flatnonzero(bounds.ravel() >= least), right.n)
        i = i + top
        if left is right:
            i, j = (x[i < j] for x in (i, j))
        able = np.concatenate([np.zeros(0, bool), *(
            np.einsum("ij,ij->i", left.folded[i[a:a + PAIRS]], right.folded[j[a:a + PAIRS]]) >= least
            for a in range(0, len(i), PAIRS))])
        i, j = i[able], j[able]
        scores = cosines(left, right, where, i, j)
        similar = scores >= threshold
        yield i[similar], j[similar], scores[similar]


def _met(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[tuple[Block, Block]]:
    """Every two blocks that meet in the rows of ``meetings``; those of the first part are held as they came, and opened once
    for every ``OPEN`` blocks that pass."""
    def block(columns: dict[str, pa.Buffer]) -> Block:
        return Block({name: unpack(name, packed) for name, packed in columns.items()}, frequent)

    def passed(held: list[dict], passing: list[Block]) -> Iterator[tuple[Block, Block]]:
        for columns in held if passing else ():
            left = block(columns)
            for right in passing:
                yield left, right

    now, held, mine, passing = None, [], [], []
    for batch in batches:
        for at in range(batch.num_rows):
            one, other, side = (batch.column(name)[at].as_py() for name in (*MEETING, "side"))
            if (one, other) != now:
                yield from passed(held, passing)
                now, held, mine, passing = (one, other), [], [], []
            # Copied, so that what is held is no more than the blocks.
            columns = {name: pa.py_buffer(batch.column(name)[at].as_py()) for name in BLOCK}
            if side or one == other:
                right = block(columns)
                if not side:
                    for left in passing:
                        yield left, right
                    yield right, right
                passing.append(right)
            if not side:
                (mine if one == other else held).append(columns)
            if len(passing) == OPEN:
                yield from passed(held, passing)
                held, mine, passing = held + mine, [], []
    yield from passed(held, passing)


def similar_pairs(found: DistinctVectors, threshold: float = 0.8) -> DataFrame:
    """``node_a, node_b, score`` of all pairs of distinct vectors with a cosine of at least the threshold, once each."""
    frequent = found.frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _met(batches, frequent):
            for i, j, scores in similar_in_meeting(left, right, threshold):
                a, b = left.nodes[i], right.nodes[j]
                yield pa.RecordBatch.from_pydict({"node_a": pa.array(np.minimum(a, b)), "node_b": pa.array(np.maximum(a, b)),
                                                  "score": pa.array(scores)})

    return meetings(found.vectors, threshold).mapInArrow(run, "node_a bigint, node_b bigint, score double")


def link_counts(found: DistinctVectors, threshold: float = 0.8) -> DataFrame:
    """``node, links``: how many documents of other vectors each vector links with; pairs are counted where they meet."""
    frequent = found.frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _met(batches, frequent):
            links = np.zeros(left.n, np.int64), np.zeros(right.n, np.int64)
            for i, j, _ in similar_in_meeting(left, right, threshold):
                np.add.at(links[0], i, right.copies[j])
                np.add.at(links[1], j, left.copies[i])
            for block, counted in zip((left, right), links):
                some = np.flatnonzero(counted)
                yield pa.RecordBatch.from_pydict({"node": pa.array(block.nodes[some]), "links": pa.array(counted[some])})

    return (meetings(found.vectors, threshold).mapInArrow(run, "node bigint, links bigint")
            .groupBy("node").agg(F.sum("links").alias("links")))


def similarity_join(tokens: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row of ``doc_id, tokens``.

    ``class_id`` is the smallest id among documents of equal words; ``n_links`` counts the other documents whose cosine is at
    least the threshold, copies included.
    """
    found = distinct_vectors(tokens)
    linked = found.vectors.select("node", "least", "n").join(link_counts(found, threshold), "node", "left")
    links = F.col("n") - 1 + F.coalesce("links", F.lit(0))
    return (found.members.join(linked, "node", "left")
            .select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
                    F.coalesce(links, F.lit(0)).cast("long").alias("n_links")))
