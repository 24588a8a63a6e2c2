"""Near-duplicate vectors by spherical-cap filters with a random product code.

The dimensions are cut into blocks, each with a code of random unit vectors. A filter is one code vector per block; a
vector belongs to all filters whose inner product with it reaches a bound. They are list-decoded: block by block, a
partial choice is dropped as soon as the best of the remaining blocks cannot reach the bound. Vectors of one label that
share a filter meet in a bucket and are compared in double precision.

A pair that shares several filters is counted in the lowest one only, so buckets add up to exact numbers of links. Equal
vectors of a label become one with a number of copies. A bucket sends one row per member, its links and the smallest id
it links to along chains inside the bucket, and never pairs. Large buckets are cut into parts by id, and every two
parts meet in a group of bounded size.

Number and strictness of filters follow the number of vectors, so that a bucket holds some hundred unrelated vectors at
most whatever the size of the table. The bound is lowered until planted pairs at exactly the threshold share a filter
with probability RECALL, measured with the code itself; closer pairs share more.

Defined cases: a null label, or a vector that is null, empty, zero or has a null or non-finite component, links with
nothing. Vectors link with those of their label and their number of dimensions only, and each number of dimensions has a
code of its own. A null id takes no part: it has no links and a null component. Rows that share an id count as vectors of their own and share a component. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm.components import connected_components
from rankloom.llm.streams import chains, group_bounds, meet_in_parts, whole_groups
from rankloom.staging import stage

THRESHOLD = 0.93
# Vectors of one bucket that are compared in one place with as many others.
PART = 1024
CODES = 16
# Share of the pairs at exactly the threshold that meet in some bucket, and how many planted pairs measure it.
RECALL = 0.996
PLANTED = 2000
SEED = 5


def usable(vector: Column) -> Column:
    """Finite, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Code:
    """Random product codes, each behind a random rotation of its own; filters are numbered over all of them."""

    rotations: list[np.ndarray]
    blocks: list[list[np.ndarray]]
    bound: float

    @property
    def filters(self) -> int:
        return len(self.blocks[0][0]) ** len(self.blocks[0])


def product_codes(dim: int, codes: int, blocks: int, size: int, bound: float, seed: int) -> Code:
    draw = np.random.default_rng(seed)
    widths = [len(part) for part in np.array_split(np.arange(dim), blocks)]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return Code([np.linalg.qr(draw.normal(size=(dim, dim)))[0] for _ in range(codes)],
                [[unit(draw.normal(size=(size, w))) for w in widths] for _ in range(codes)], bound)


def vector_filters(vectors: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all codes, by row and filter."""
    found = [list_decode(vectors @ q, c, code.bound) for q, c in zip(code.rotations, code.blocks)]
    row = np.concatenate([r for r, _ in found])
    name = np.concatenate([n + i * code.filters for i, (_, n) in enumerate(found)])
    order = np.lexsort((name, row))
    return row[order], name[order]


def list_decode(vectors: np.ndarray, code: list[np.ndarray], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter whose inner product with the unit vector reaches ``bound``, by row and filter."""
    blocks, size = len(code), len(code[0])
    edges = np.cumsum([0, *(c.shape[1] for c in code)])
    scores = [vectors[:, a:b] @ c.T for a, b, c in zip(edges, edges[1:], code)]
    # What the blocks from here on can add at most.
    rest = np.zeros((blocks + 1, len(vectors)))
    for i in range(blocks - 1, -1, -1):
        rest[i] = rest[i + 1] + scores[i].max(axis=1, initial=-np.inf)
    need = bound * np.sqrt(blocks)
    row, partial, name = np.arange(len(vectors)), np.zeros(len(vectors)), np.zeros(len(vectors), np.int64)
    for i in range(blocks):
        at, choice = np.nonzero(scores[i][row] >= (need - partial - rest[i + 1][row])[:, None])
        partial = partial[at] + scores[i][row[at], choice]
        row, name = row[at], name[at] * size + choice
    return row, name


def code_settings(n: int, dim: int, threshold: float = THRESHOLD, seed: int = SEED) -> tuple[int, int, int, float]:
    """(codes, blocks, code size, bound) for ``n`` vectors in the largest label.

    There is a filter for every 8 vectors. A random unit vector reaches the bound with the probability of a cap of the
    sphere, so a bound is given by the number of filters a vector is to belong to (its hits), and a bucket holds 8 times
    as many unrelated vectors. Hits start at 16 and grow until the code of this seed meets RECALL, as higher bounds part pairs
    more often.
    """
    # Rotations are dim * dim numbers each; a few dimensions need no blocks.
    codes, blocks = CODES if dim <= 256 else 4, 2 if dim >= 8 else 1
    cosines, tails = cap_tails(dim)
    hits = 16.0
    # Caps narrower than this part close pairs in any dimension.
    most = hits / np.interp(-0.85, -cosines, tails)
    size = max(1, ceil((min(max(n / 8, 1024), most, codes * 2.0 ** 28) / codes) ** (1 / blocks)))
    code = product_codes(dim, codes, blocks, size, 0.85, seed)
    left, right = planted_pairs(PLANTED, dim, threshold, 13)
    while True:
        bound = float(np.interp(hits / code.filters / codes, tails, cosines))
        if shared_filters(left, right, replace(code, bound=bound)) >= RECALL or hits >= code.filters * codes / 2:
            return codes, blocks, size, bound
        hits *= 1.15


def cap_tails(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines from 1 down to 0, and the share of random unit vectors that reach each (a regularized incomplete beta)."""
    angle = np.linspace(0, np.pi / 2, 20_001)
    # On a line a vector points one way or the other.
    density = np.sin(angle) ** (dim - 2) if dim > 1 else np.append(1.0, np.zeros(len(angle) - 1))
    total = np.append(0, np.cumsum((density[1:] + density[:-1]) / 2))
    return np.cos(angle), total / total[-1] / 2


def planted_pairs(count: int, dim: int, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at the given cosine (on a line, equal ones)."""
    draw = np.random.default_rng(seed)
    left, other = unit_rows(draw.normal(size=(count, dim))), draw.normal(size=(count, dim))
    if dim == 1:
        return left, left
    other = unit_rows(other - (other * left).sum(axis=1, keepdims=True) * left)
    return left, cosine * left + np.sqrt(1 - cosine ** 2) * other


def shared_filters(left: np.ndarray, right: np.ndarray, code: Code) -> float:
    """Share of the pairs with a common filter."""
    met = 0
    for start in range(0, len(left), 500):
        (i, f), (j, g) = (vector_filters(side[start:start + 500], code) for side in (left, right))
        width = code.filters * len(code.blocks)
        met += len(np.unique(np.intersect1d(i * width + f, j * width + g) // width))
    return met / len(left)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def components_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all components one behind the other, where each vector starts and the last one ends)."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(lengths))


def decoded(vectors: DataFrame, settings: dict[int, tuple[int, int, int, float]], seed: int) -> DataFrame:
    """Adds ``filters`` to ``id, copies, label, dim, vector``; ``settings`` has those of each ``dim``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by dim, so a task holds one code at a time.
        held, code = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets = components_of(batch.column("vector"))
            dims = np.diff(offsets)
            edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for first, last in zip(edges, edges[1:]):
                dim = int(dims[first])
                if dim != held:
                    held, code = dim, product_codes(dim, *settings[dim], seed)
                for start in range(first, last, 512):
                    n = min(512, last - start)
                    part = batch.slice(start, n)
                    row, name = vector_filters(unit_rows(flat[offsets[start]:offsets[start + n]].reshape(n, dim)), code)
                    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(name))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "filters"])

    kinds = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    if len(settings) > 1:
        vectors = vectors.sortWithinPartitions("dim")
    return vectors.mapInArrow(run, f"{kinds}, filters array<bigint>")


def first_meeting(lower: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of places share none of their lower filters: those have not met in an earlier bucket."""
    if len(a) <= 4 * len(lower):
        sets = {int(i): frozenset(lower[i].tolist()) for i in np.union1d(a, b)}
        return np.fromiter((sets[i].isdisjoint(sets[j]) for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
    names, column = np.unique(np.concatenate(lower), return_inverse=True)
    shared = np.flatnonzero(np.bincount(column, minlength=len(names)) > 1)
    place = np.full(len(names) + 1, -1)
    place[shared] = np.arange(len(shared))
    member = np.repeat(np.arange(len(lower)), [len(x) for x in lower])
    has = np.zeros((len(lower), len(shared)), np.float32)
    has[member[place[column] >= 0], place[column][place[column] >= 0]] = 1
    return (has @ has.T)[a, b] == 0


def linked_pairs(vectors: np.ndarray, side: np.ndarray, two_parts: bool, lower: list[np.ndarray],
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the pairs of a group that are linked and meet here first.

    In a group of two parts side 0 meets side 1, in a group of one part all meet each other.
    """
    left = np.flatnonzero(side == 0) if two_parts else np.arange(len(side))
    right = np.flatnonzero(side == 1) if two_parts else left
    a, b = np.nonzero(vectors[left] @ vectors[right].T >= threshold)
    if not two_parts:
        once = a < b
        a, b = a[once], b[once]
    a, b = left[a], right[b]
    if not len(a):
        return a, b
    first = first_meeting(lower, a, b)
    return a[first], b[first]


GROUP = ("label", "dim", "filter", "left_part", "right_part")


def group_links(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """``id, links, least`` of the members with a link, for whole groups that lie one behind the other."""
    components, edges = components_of(table["vector"].chunk(0))
    left_part, right_part = (table[c].to_numpy() for c in GROUP[3:])
    copies, side = table["copies"].to_numpy(), table["side"].to_numpy()
    lists = table["lower"].chunk(0)
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    place, links, least = [], [], []
    for start, end in group_bounds(table, GROUP):
        if end - start < 2:
            continue
        lower = [flat[i:j] for i, j in zip(offsets[start:end], offsets[start + 1:end + 1])]
        vectors = unit_rows(components[edges[start]:edges[end]].reshape(end - start, -1))
        a, b = linked_pairs(vectors, side[start:end], left_part[start] != right_part[start], lower, threshold)
        if len(a):
            n = end - start
            sums = np.bincount(a, copies[start:end][b], n) + np.bincount(b, copies[start:end][a], n)
            linked = np.flatnonzero(sums)
            place.append(linked + start)
            links.append(sums[linked].astype(np.int64))
            least.append(chains(a, b, n)[linked] + start)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    ids = table["id"].chunk(0)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(join(place))), pa.array(join(links)),
                                       ids.take(pa.array(join(least)))], names=["id", "links", "least"])


def link_groups(members: DataFrame, threshold: float) -> DataFrame:
    """``id, links, least``: per group and linked member, the copies it links to and the smallest id it chains to.

    Partitions are sorted, so groups stream by and a task holds one batch and one group at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, GROUP):
            yield group_links(table, threshold)

    kind = members.schema["id"].dataType.simpleString()
    return (members.repartition(*GROUP).sortWithinPartitions(*GROUP, "id")
            .mapInArrow(run, f"id {kind}, links bigint, least {kind}"))


def near_links(df: DataFrame, key: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
               threshold: float = THRESHOLD, seed: int = SEED, part: int = PART,
               settings: tuple[int, int, int, float] | None = None) -> DataFrame:
    """``key, n_links, component_id`` for every row."""
    given = df.select(F.col(key).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    vector_type = df.schema[vector_column].dataType.elementType
    whole = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    # Adding 0.0 turns -0.0 into 0.0, so that equal vectors have equal text.
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast(vector_type))
    kept = given.withColumn("same", F.when(whole, F.md5(F.concat_ws(",", F.transform(plain, lambda x: x.cast("string"))))))
    rows = stage(kept, "vectors")
    # Of equal vectors the one with the smallest id stands for all.
    first = stage(rows.where("same IS NOT NULL").groupBy("label", "same").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
        .withColumn("dim", F.size("vector")), "distinct-vectors")
    largest = first.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    if not largest:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    chosen = {r["dim"]: settings or code_settings(r["n"], r["dim"], threshold, seed) for r in largest}
    filtered = stage(decoded(first.select("id", "copies", "label", "dim", "vector"), chosen, seed), "decoded")
    exploded = (filtered.withColumn("filter", F.explode("filters"))
                .withColumn("lower", F.filter("filters", lambda f: f < F.col("filter"))).drop("filters"))
    buckets = (filtered.select("label", "dim", F.explode("filters").alias("filter")).groupBy("label", "dim", "filter")
               .agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / part).cast("int")))
    members = meet_in_parts(exploded.join(buckets.drop("n"), ["label", "dim", "filter"]),
                            F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.col("parts"))
    members = members.select(*GROUP, "side", "id", "copies", "vector", "lower")
    found = stage(link_groups(members, threshold), "links")
    direct = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    stars = (first.select("label", "same", "id", "copies").join(direct, "id", "left")
             .join(component, F.col("id") == F.col("node"), "left")
             .select("label", "same", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "id").alias("component_id")))
    # Rows without a label or a usable vector take no part in the join, where they would share one key.
    alone = rows.where("same IS NULL").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"),
                                              F.col("id").alias("component_id"))
    linked = (rows.where("same IS NOT NULL").join(stars, ["label", "same"], "left")
              .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id")))
    return linked.unionByName(alone)

