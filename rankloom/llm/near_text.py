"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A shingle is five words in a row, weighted by how often the document has it; a document with fewer words is one shingle.
Similarity is the probability Jaccard index, which for texts without repeated shingles is the plain Jaccard index.

1. Every shingle sends exponential arrivals at a rate of its weight, each to a random one of the slots; a slot keeps the
   shingle that came first. Arrivals stop once none can be first in any slot. Two documents agree in a slot with the
   probability of their similarity.
2. Texts of equal words become one. Slots are banded; documents that agree in a band share a bucket.
3. In every bucket all members are held against a center, by exact similarity. Confirmed links give components. In buckets
   that still hold several components, parts of bounded members and shingles meet part against part in a task, which compares all their
   pairs exactly and sends on one link for each member that it joins to another. So every pair that shares a bucket is
   confirmed, refuted, or known to be in one component, and the pairs of a bucket never become rows.

With 25 bands of 5 slots a pair at the threshold shares a bucket with probability 0.99995.

Texts are told apart by their words, so rows that share an id have the class of their own text each.

Defined cases: a null or blank text has no shingles and links with nothing, not even with its like. A null id takes no
part in ``near_classes`` and has a null class; ``text_classes`` takes in the texts of such rows. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from rankloom.llm.components import connected_components
from rankloom.llm.streams import chains, group_bounds, meet_in_parts, whole_groups
from rankloom.llm.tokens import text_slices
from rankloom.llm.words import arrow_words
from rankloom.staging import stage

WORDS = 5
BANDS, ROWS = 25, 5
THRESHOLD = 0.8
# Bits of a shingle's hash beside the place of its document in the batch.
HASH_BITS = np.uint64(44)
HASH_MASK = np.uint64((1 << 44) - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Members of one center, and members and shingles of one part of a bucket, that are compared in one place.
GROUP = 256
PART_MEMBERS, PART_SHINGLES = 512, 1 << 18
CELLS = 1 << 22
# Text whose shingles are in memory at once.
SLICE_BYTES = 2 << 20
# Sums of quotients are rounded.
SLACK = 1e-12
MEETING = ("bucket", "left_part", "right_part")
NO_WORDS = hashlib.blake2b(b"", digest_size=16).digest()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_counts(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of a batch, by document and hash."""
    counts, codes, distinct = arrow_words(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    ends = np.cumsum(counts)
    place = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero((ends[place] if len(place) else place) - np.arange(len(place)) >= size)
    value = np.zeros(len(whole), np.uint64)
    for k in range(size):
        value = mix(value + hashes[whole + k] + GOLDEN)
    # A document with fewer words is one shingle of them all.
    few = np.flatnonzero((counts > 0) & (counts < size))
    short = np.zeros(len(few), np.uint64)
    for k in range(size - 1):
        longer = np.flatnonzero(counts[few] > k)
        short[longer] = mix(short[longer] + hashes[(ends - counts)[few[longer]] + k] + GOLDEN)
    owner, value = np.append(place[whole], few), np.append(value, short)
    keys, times = np.unique((owner.astype(np.uint64) << HASH_BITS) | (value >> np.uint64(20)), return_counts=True)
    return (keys >> HASH_BITS).astype(np.int64), keys & HASH_MASK, times


def signatures(owner: np.ndarray, shingles: np.ndarray, counts: np.ndarray, n: int, slots: int) -> np.ndarray:
    """The first shingle of every slot of every document; documents must have a shingle to have a row that counts.

    ``limit`` is the time by which all slots of a document are likely to be taken; it falls to the latest first arrival
    as soon as that is known, and doubles for documents with an open slot. Shingles whose next arrival lies beyond it
    wait.
    """
    total = np.bincount(owner, counts, n)
    pace = total[owner] / counts
    first = np.full(n * slots, np.inf)
    taken = np.zeros(n * slots, np.uint64)
    limit = np.full(n, slots * (np.log(slots) + 3.0))
    turn = np.ones(len(owner), np.uint64)
    draw = mix(shingles + GOLDEN)
    time = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53) * pace
    present = total > 0
    ready = np.flatnonzero(time <= limit[owner])
    while True:
        rounds = 0
        while len(ready):
            own, at = owner[ready], time[ready]
            slot = own * slots + (mix(draw[ready] ^ GOLDEN) % np.uint64(slots)).astype(np.int64)
            np.minimum.at(first, slot, at)
            won = first[slot] == at
            taken[slot[won]] = shingles[ready[won]]
            turn[ready] += np.uint64(1)
            draw[ready] = mix(shingles[ready] + GOLDEN * turn[ready])
            time[ready] = at - np.log(((draw[ready] >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53) * pace[ready]
            rounds += 1
            if rounds in (2, 4, 8, 16, 32, 64, 128, 256):
                limit = np.minimum(limit, first.reshape(n, slots).max(axis=1))
            ready = ready[time[ready] <= limit[own]]
        latest = first.reshape(n, slots).max(axis=1)
        open_docs = present & np.isinf(latest)
        if not open_docs.any():
            return taken.reshape(n, slots)
        limit = np.where(open_docs, limit * 2, latest)
        ready = np.flatnonzero(open_docs[owner] & (time <= limit[owner]))


def band_keys(taken: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band."""
    keys = np.repeat(np.arange(bands, dtype=np.uint64)[None, :] * GOLDEN, len(taken), axis=0)
    for k in range(rows):
        keys = mix(keys + taken[:, k:bands * rows:rows] + GOLDEN)
    return keys.view(np.int64)


def word_digests(texts: pa.Array) -> list[bytes]:
    """16 bytes that stand for the sequence of words."""
    texts = pc.ascii_trim_whitespace(texts.cast("large_string"))
    joined = pc.binary_join(pc.ascii_split_whitespace(texts), pa.scalar(" ", pa.large_string()))
    return [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in joined.to_pylist()]


def with_digests(docs: DataFrame, text_column: str = "text", name: str = "digest") -> DataFrame:
    """Adds the digest of the words; null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_column, SLICE_BYTES):
                texts = pc.fill_null(part.column(text_column).cast("large_string"), "")
                digests = [None if d == NO_WORDS else d for d in word_digests(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary())],
                                                 names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def sketch(docs: DataFrame, key: str, text_column: str, bands: int, rows: int) -> DataFrame:
    """``id, digest, bands`` of every document; ``bands`` is empty without words."""
    picked = docs.select(F.col(key).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {picked.schema['id'].dataType.simpleString()}, digest binary, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                texts = pc.fill_null(part.column("text").cast("large_string"), "")
                owner, shingles, counts = shingle_counts(texts)
                keys = band_keys(signatures(owner, shingles, counts, len(texts), bands * rows), bands, rows)
                has = np.bincount(owner, minlength=len(texts)) > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "digest": pa.array(word_digests(texts), pa.binary()),
                                                  "bands": lists})

    return picked.mapInArrow(run, schema)


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard index of two weighted sets given as (sorted hashes, counts)."""
    (a, x), (b, y) = left, right
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    hit = b[place] == a
    both_x, both_y = x[hit].astype(float), y[place[hit]].astype(float)
    if not len(both_x):
        return 0.0
    only_x, only_y = x.sum() - both_x.sum(), y.sum() - both_y.sum()
    order = np.argsort(both_x / both_y, kind="stable")
    both_x, both_y = both_x[order], both_y[order]
    # Of shingles with a higher ratio the left weight counts, of those with a lower one the right weight.
    ratio = both_x / both_y
    from_x = only_x + np.cumsum(both_x[::-1])[::-1]
    below_y = only_y + np.cumsum(both_y) - both_y
    first = np.searchsorted(ratio, ratio, side="left")
    return float(np.sum(1.0 / (from_x[first] / both_x + below_y[first] / both_y)))


def compare_stream(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows ``center, salt, id, text`` in order, each group led by its center; yields ``a, b`` of similar pairs."""
    group, held = None, None
    for batch in batches:
        for part in text_slices(batch, "text", SLICE_BYTES):
            owner, shingles, counts = shingle_counts(part.column("text"))
            bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
            found: tuple[list, list] = ([], [])
            for i, (center, salt, leads, member) in enumerate(zip(*(part.column(c).to_pylist() for c in (
                    "center", "salt", "leads", "id")))):
                own = shingles[bounds[i]:bounds[i + 1]], counts[bounds[i]:bounds[i + 1]]
                if leads == 0:
                    group, held = (center, salt), own
                elif group == (center, salt) and similarity(held, own) >= threshold - SLACK:
                    found[0].append(center)
                    found[1].append(member)
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[0], part.column("center").type),
                                              "b": pa.array(found[1], part.column("center").type)})


def confirm(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of the pairs ``center, id`` whose texts are similar.

    The members of a center are dealt into groups of bounded size; each streams past its center's text in one task.
    """
    kind = texts.schema["id"].dataType.simpleString()
    groups = pairs.groupBy("center").agg(F.ceil(F.count("*") / GROUP).alias("n_groups"))
    dealt = (pairs.join(groups, "center")
             .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("n_groups"))).select("center", "salt", "id"))
    leaders = dealt.select("center", "salt").distinct().select("center", "salt", F.lit(0).alias("leads"),
                                                               F.col("center").alias("id"))
    rows = (dealt.select("center", "salt", F.lit(1).alias("leads"), "id").unionByName(leaders)
            .join(texts, "id").select("center", "salt", "leads", "id", "text"))
    return (rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "leads")
            .mapInArrow(lambda batches: compare_stream(batches, threshold), f"a {kind}, b {kind}"))


def shingle_table(texts: DataFrame) -> DataFrame:
    """``id, shingles, counts`` of ``id, text``."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                owner, shingles, counts = shingle_counts(part.column("text"))
                at = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "shingles": pa.ListArray.from_arrays(at, pa.array(shingles.view(np.int64))),
                    "counts": pa.ListArray.from_arrays(at, pa.array(counts.astype(np.int32)))})

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, shingles array<bigint>, counts array<int>")


def common_weights(owner: np.ndarray, shingles: np.ndarray, counts: np.ndarray, left: np.ndarray,
                   right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``left`` and of ``right``, the weight of one's shingles that the other has.

    Shingles with the same counts in the same documents, as of a passage that they share, are one column.
    """
    n = int(max(left.max(), right.max())) + 1
    order = np.argsort(shingles, kind="stable")
    owner, shingles, counts = owner[order], shingles[order], counts[order]
    starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
    sizes = np.diff(np.append(starts, len(shingles)))
    place = np.repeat(np.arange(len(starts)), sizes)
    stamp = np.add.reduceat(mix(mix(owner.astype(np.uint64) + GOLDEN) + counts.astype(np.uint64) * GOLDEN), starts)
    _, first, column, times = np.unique(np.where(sizes > 1, stamp, np.uint64(0)), return_index=True, return_inverse=True,
                                        return_counts=True)
    chosen = np.zeros(len(starts), bool)
    chosen[first] = True
    chosen &= sizes > 1
    kept = chosen[place]
    row, name, weight = owner[kept], column[place[kept]], counts[kept]
    used, name = np.unique(name, return_inverse=True)
    one, other = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
    step = max(1, CELLS // n)
    by_column = np.argsort(name, kind="stable")
    row, name, weight = row[by_column], name[by_column], weight[by_column]
    for at in range(0, len(used), step):
        a, b = np.searchsorted(name, (at, at + step))
        has = np.zeros((n, min(step, len(used) - at)), np.float32)
        has[row[a:b], name[a:b] - at] = 1
        heavy = has.copy()
        heavy[row[a:b], name[a:b] - at] = weight[a:b]
        heavy *= times[used[at:at + step]].astype(np.float32)
        one += heavy[left] @ has[right].T
        other += has[left] @ heavy[right].T
    return one, other


def similar_pairs(lists: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, asked: np.ndarray,
                  threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in left, place in right) of the ``asked`` pairs whose similarity reaches the threshold, exactly.

    The weight that is shared bounds the similarity from above; without repeated shingles it gives it.
    """
    owner = np.repeat(np.arange(len(lists)), [len(x) for x, _ in lists])
    one, other = common_weights(owner, np.concatenate([x for x, _ in lists]), np.concatenate([y for _, y in lists]),
                                left, right)
    total = np.array([y.sum() for _, y in lists], float)
    plain = np.array([len(y) == y.sum() for _, y in lists])
    union = total[left][:, None] + total[right][None, :] - one
    alike = plain[left][:, None] & plain[right][None, :]
    found = asked & alike & (one / union >= threshold - SLACK)
    open_pairs = asked & ~alike & (one >= (threshold - SLACK) * total[left][:, None]) & (
        other >= (threshold - SLACK) * total[right][None, :])
    for i, j in zip(*np.nonzero(open_pairs)):
        found[i, j] = similarity(lists[left[i]], lists[right[j]]) >= threshold - SLACK
    return np.nonzero(found)


def bucket_links(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """``a, b``: links between different components in whole groups, one for each member that is joined to another."""
    component = table["component"].chunk(0).dictionary_encode().indices.to_numpy()
    side = table["side"].to_numpy()
    left_part, right_part = (table[c].to_numpy() for c in MEETING[1:])
    shingles, counts = (table[c].chunk(0) for c in ("shingles", "counts"))
    offsets = shingles.offsets.to_numpy()
    flat, times = shingles.values.to_numpy().view(np.uint64), counts.values.to_numpy()
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, end in group_bounds(table, MEETING):
        split = left_part[start] != right_part[start]
        left, right = (np.flatnonzero(side[start:end] == k) for k in (0, 1)) if split else [np.arange(end - start)] * 2
        own = component[start:end]
        asked = own[left][:, None] != own[right][None, :]
        if not asked.any():
            continue
        lists = [(flat[i:j], times[i:j]) for i, j in zip(offsets[start:end], offsets[start + 1:end + 1])]
        a, b = similar_pairs(lists, left, right, asked, threshold)
        root = chains(left[a], right[b], end - start)
        joined = np.flatnonzero(root != np.arange(end - start))
        first.append(root[joined] + start)
        second.append(joined + start)
    ids = table["id"].chunk(0)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(x))) for x in (first, second)], names=["a", "b"])


def across_components(rest: DataFrame, component: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between different components among ``bucket, id``."""
    labelled = stage(rest.join(component, rest["id"] == component["node"], "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component")), "labelled-buckets")
    mixed = (labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("bucket"))
    open_members = stage(labelled.join(mixed, "bucket"), "mixed-buckets")
    weighed = stage(shingle_table(texts.join(open_members.select("id").distinct(), "id", "left_semi")), "shingles")
    sized = open_members.join(weighed.select("id", F.size("shingles").cast("long").alias("n")), "id")
    parts = sized.groupBy("bucket").agg(F.greatest(F.ceil(F.sum("n") / PART_SHINGLES), F.ceil(F.count("*") / PART_MEMBERS))
                                        .cast("int").alias("parts"))
    members = meet_in_parts(open_members.join(parts, "bucket"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"),
                            F.col("parts"))
    kind = rest.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, MEETING):
            yield bucket_links(table, threshold)

    return (members.join(weighed, "id").select(*MEETING, "side", "id", "component", "shingles", "counts")
            .repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(run, f"a {kind}, b {kind}"))


def distinct_classes(docs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """``digest, class_id, class_digest`` of the distinct texts of ``sketches``, whose rows ``id, text`` are in ``docs``.

    A class is named by the smallest id of its rows that is not null and the text that has it, of several the one with
    the smallest digest.
    """
    # Texts are numbered, and go by their number (``id``) from here on.
    distinct = stage(sketches.where("size(bands) > 0").groupBy("digest").agg(
        F.min("id").alias("least"), F.first("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id()), "distinct-texts")
    members = distinct.select("id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1")
    buckets = stage(members.join(shared.select("bucket", "center"), "bucket"), "buckets")
    # Of rows with equal words those with the smallest id give the text.
    wanted = distinct.join(buckets.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("node"), F.col("digest").alias("wanted"), "least")
    given = with_digests(docs.select("id", "text"))
    texts = stage(given.join(wanted, (F.col("digest") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("least")))
                  .select(F.col("node").alias("id"), "text").dropDuplicates(["id"]), "candidate-texts")
    met = buckets.where("id <> center")
    links = stage(confirm(met.select("center", "id").distinct(), texts, threshold), "links")
    # The center has met every member of its bucket; what else can join two components is looked for among the others.
    more = stage(across_components(met.select("bucket", "id"), connected_components(links), texts, threshold), "links")
    linked = stage(connected_components(links.unionByName(more))
                   .join(distinct.select("id", "least", "digest"), F.col("node") == F.col("id")), "linked-texts")
    head = linked.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "digest")).alias("head"))
    named = linked.join(head, "component").select("node", "head")
    return (distinct.join(named, distinct["id"] == named["node"], "left")
            .select("digest", F.when(F.col("head").isNull(), F.col("least")).otherwise(F.col("head.least")).alias("class_id"),
                    F.coalesce("head.digest", "digest").alias("class_digest")))


def text_classes(docs: DataFrame, key: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD,
                 bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``digest, class_id, class_digest`` of every text with words, those of rows with a null id as well."""
    sketches = stage(sketch(docs, key, text_column, bands, rows), "sketches")
    return distinct_classes(docs.select(F.col(key).alias("id"), F.col(text_column).alias("text")), sketches, threshold)


def near_classes(docs: DataFrame, key: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD,
                 bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``key, class_id`` for every row: the smallest id of the group of near copies of its text."""
    sketches = stage(sketch(docs, key, text_column, bands, rows), "sketches")
    given = docs.select(F.col(key).alias("id"), F.col(text_column).alias("text"))
    classes = distinct_classes(given, sketches.where("id IS NOT NULL"), threshold).select("digest", "class_id")
    return (sketches.join(classes, "digest", "left")
            .select(F.col("id").alias(key), F.when(F.size("bands") > 0, F.col("class_id")).otherwise(F.col("id"))
                    .alias("class_id")).withColumn("class_id", F.when(F.col(key).isNotNull(), F.col("class_id"))))
