"""Part-of-speech tags from context: a hidden Markov model that is learnt from untagged text.

A dictionary limits the tags of the words it lists; all other words may have any tag. Expectation maximisation sums
expected counts in the tasks; the driver sees a row per word of the model, which ``max_words`` bounds, and a matrix
of tags. Texts become numbers once, and every round reads these. Sequences of one Arrow batch are walked side by side, longest
first, and slices of a batch hold sequences of like length, so that few steps serve a few sequences only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.functions.text import clean_tokens
from rankloom.operators.joins import join_lookup
from rankloom.operators.lemmas import lemmatize
from rankloom.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# One Treebank tag for each part of speech that a lexicon tells apart.
TAGS = {"noun": "NN", "verb": "VB", "adj": "JJ", "adv": "RB"}
SLICE_WORDS = 1 << 20
LEAST = 1e-300


@dataclass(frozen=True)
class TagModel:
    """``emission`` has a row per word, in the order of ``words``, and a last one for all other words."""
    words: pa.Array
    start: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    likelihoods: tuple[float, ...] = ()


def tag_dictionary(lexicon: DataFrame) -> DataFrame:
    """``word, tags`` (a bit per entry of TAGS): every word and lemma of a lexicon may be what it is listed as."""
    listed = lexicon.select("word", "pos").unionByName(lexicon.select(F.col("lemma").alias("word"), "pos")).distinct()
    bit = sum((F.when(F.col("pos") == pos, 1 << i).otherwise(0) for i, pos in enumerate(TAGS)), F.lit(0))
    return listed.groupBy("word").agg(F.sum(bit).cast("int").alias("tags")).where("tags > 0")


def list_counts(texts: DataFrame, words: str = "words") -> DataFrame:
    """``word, cnt`` over all lists."""
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


class Steps:
    """Sequences side by side: what stands at one position of all of them lies together, longest sequence first."""

    def __init__(self, lengths: np.ndarray, offsets: np.ndarray | None = None):
        """``offsets`` says where each sequence begins in the flat list of words; without them they follow each other."""
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.active = np.searchsorted(-ordered, -np.arange(1, (ordered[0] if len(ordered) else 0) + 1), side="right")
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        offsets = (np.concatenate([[0], np.cumsum(lengths)])[:-1] if offsets is None else offsets)[self.order]
        position = np.repeat(np.arange(len(self.active)), self.active)
        row = np.arange(self.starts[-1]) - self.starts[position]
        # Where a step's word lies in the flat list of words.
        self.place = offsets[row] + position

    def at(self, t: int) -> slice:
        return slice(self.starts[t], self.starts[t + 1])

    def __len__(self) -> int:
        return len(self.active)


def expected_counts(seen: np.ndarray, steps: Steps, start: np.ndarray,
                    transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(tag chances of each step, starts, transitions, log likelihood) by scaled forward and backward sums."""
    ahead, scale = np.empty_like(seen), np.empty(len(seen))
    for t in range(len(steps)):
        now, n = steps.at(t), steps.active[t]
        before = start if t == 0 else ahead[steps.starts[t - 1]:steps.starts[t - 1] + n] @ transition
        reached = before * seen[now]
        scale[now] = np.maximum(reached.sum(axis=1), LEAST)
        ahead[now] = reached / scale[now, None]
    chance, moves = ahead.copy(), np.zeros_like(transition)
    back = np.ones((0, len(start)))
    for t in range(len(steps) - 2, -1, -1):
        later, n = steps.at(t + 1), steps.active[t + 1]
        beyond = np.ones((n, len(start)))
        beyond[:len(back)] = back
        onward = beyond * seen[later] / scale[later, None]
        here = slice(steps.starts[t], steps.starts[t] + n)
        moves += transition * (ahead[here].T @ onward)
        back = onward @ transition.T
        chance[here] = ahead[here] * back
    return chance, chance[steps.at(0)].sum(axis=0) if len(steps) else np.zeros(len(start)), moves, float(np.log(scale).sum())


def best_tags(seen: np.ndarray, steps: Steps, start: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The likeliest tags (Viterbi) of each step; among equals the first tag."""
    log = lambda x: np.log(np.maximum(x, LEAST))
    # A row for each tag, so that a step works on long rows.
    seen, start, transition = np.ascontiguousarray(log(seen).T), log(start), log(transition)
    score, origin = np.empty_like(seen), np.zeros(seen.shape, np.int8)
    for t in range(len(steps)):
        now, n = steps.at(t), steps.active[t]
        if t == 0:
            score[:, now] = start[:, None] + seen[:, now]
            continue
        before = score[:, steps.starts[t - 1]:steps.starts[t - 1] + n]
        best, source = before[0] + transition[0][:, None], np.zeros((len(start), n), np.int8)
        for tag in range(1, len(start)):
            way = before[tag] + transition[tag][:, None]
            source[way > best] = tag
            np.maximum(best, way, out=best)
        origin[:, now] = source
        score[:, now] = best + seen[:, now]
    tags = np.zeros(seen.shape[1], np.int64)
    for t in range(len(steps) - 1, -1, -1):
        now = steps.at(t)
        tags[now] = score[:, now].argmax(axis=0)
        if t + 1 < len(steps):
            later = steps.at(t + 1)
            n = steps.active[t + 1]
            tags[now][:n] = origin[:, later][tags[later], np.arange(n)]
    return tags


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sequences of at most SLICE_WORDS words together, or a single sequence."""
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and size + n > SLICE_WORDS:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, len(lengths)


def _like_lengths(lengths: np.ndarray) -> Iterator[Steps]:
    """All sequences in slices, long ones together and short ones together."""
    order = np.argsort(-lengths, kind="stable")
    offsets = (np.cumsum(lengths) - lengths)[order]
    for begin, end in _slices(lengths[order]):
        yield Steps(lengths[order[begin:end]], offsets[begin:end])


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _coded(lists: pa.Array, words: pa.Array) -> np.ndarray:
    """Number of every word, one beyond the last for others."""
    code = pc.index_in(lists.flatten().cast(pa.large_string()), value_set=words)
    return pc.fill_null(code, len(words)).to_numpy()


def _code_batches(batches: Iterator[pa.RecordBatch], words: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges = np.concatenate([[0], np.cumsum(_lengths(batch.column(0)))]).astype(np.int32)
        codes = pa.array(_coded(batch.column(0), words).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges), codes)], names=["codes"])


def _count_batches(batches: Iterator[pa.RecordBatch], model: TagModel) -> Iterator[pa.RecordBatch]:
    """``kind, row, counts``: what a task expects of lists of codes, summed over its texts."""
    k = len(model.start)
    emission, starts, moves, total = np.zeros_like(model.emission), np.zeros(k), np.zeros((k, k)), 0.0
    for batch in batches:
        codes = batch.column(0).flatten().to_numpy()
        for steps in _like_lengths(_lengths(batch.column(0))):
            code = codes[steps.place]
            chance, first, moved, log = expected_counts(model.emission[code], steps, model.start, model.transition)
            for tag in range(k):
                emission[:, tag] += np.bincount(code, chance[:, tag], len(emission))
            starts, moves, total = starts + first, moves + moved, total + log
    used = np.flatnonzero(emission.sum(axis=1))
    counts = [*emission[used], starts, *moves, np.array([total])]
    yield pa.RecordBatch.from_pydict({
        "kind": pa.array([0] * len(used) + [1] + [2] * k + [3], pa.int32()),
        "row": pa.array([*used.tolist(), 0, *range(k), 0], pa.int64()),
        "counts": pa.array([c.tolist() for c in counts], pa.list_(pa.float64()))})


def fit_tagger(texts: DataFrame, dictionary: DataFrame, words: str = "words", rounds: int = 5, max_words: int = 50_000,
               smoothing: float = 0.01, counts: DataFrame | None = None) -> TagModel:
    """Learn a tagger from lists of words; ``texts`` should be a written table, since it is read twice. ``counts`` has
    ``word, cnt`` of the same texts, if they are counted already.

    The ``max_words`` most frequent words (ties alphabetical) have chances of their own; the others share a row in
    which every tag is open. A null list counts as empty. Without a dictionary nothing tells tags apart. No words at all
    are an error.
    """
    spark, k = texts.sparkSession, len(TAGS)
    counted = list_counts(texts, words) if counts is None else counts
    frequent = counted.where("word IS NOT NULL").orderBy(F.desc("cnt"), "word").limit(max_words)
    table = (join_lookup(frequent, dictionary.select("word", "tags"), "word", "left")
             .orderBy("word").select("word", "cnt", F.coalesce("tags", F.lit((1 << k) - 1)).alias("tags")).toArrow())
    if table.num_rows == 0:
        raise ValueError("no words to learn from")
    listed = pa.concat_arrays(table["word"].cast(pa.large_string()).chunks)
    open_tags = (table["tags"].to_numpy()[:, None] >> np.arange(k)) & 1
    allowed = np.vstack([open_tags, np.ones(k)])
    share = np.append(table["cnt"].to_numpy(), 1.0)[:, None] * allowed / allowed.sum(axis=1, keepdims=True)
    columns = lambda m: m / np.maximum(m.sum(axis=0), LEAST)
    rows = lambda m: m / np.maximum(m.sum(axis=-1, keepdims=True), LEAST)
    model = TagModel(listed, np.full(k, 1 / k), np.full((k, k), 1 / k), columns(share))
    lists = texts.select(F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    names = spark.sparkContext.broadcast(listed)
    coded = stage(lists.mapInArrow(lambda batches: _code_batches(batches, names.value), "codes array<int>"), "codes")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)
        found = (coded.mapInArrow(lambda batches: _count_batches(batches, held.value), "kind int, row bigint, counts array<double>")
                 .select("kind", "row", F.posexplode("counts").alias("tag", "x"))
                 .groupBy("kind", "row", "tag").agg(F.sum("x").alias("x")).toArrow())
        kind, row, tag, x = (found[c].to_numpy() for c in ("kind", "row", "tag", "x"))
        emission, starts, moves = smoothing * allowed, np.full(k, smoothing), np.full((k, k), smoothing)
        for target, wanted in ((emission, 0), (moves, 2)):
            target[row[kind == wanted], tag[kind == wanted]] += x[kind == wanted]
        starts[tag[kind == 1]] += x[kind == 1]
        model = TagModel(listed, rows(starts), rows(moves), columns(emission),
                         (*model.likelihoods, float(x[kind == 3].sum())))
        held.unpersist()
    names.unpersist()
    return model


def tag_words(df: DataFrame, words: str, model: TagModel, new_column: str = "tags") -> DataFrame:
    """All columns and a tag for each word of the list; null and empty lists have none."""
    held = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField(new_column, T.ArrayType(T.StringType()))])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = held.value, pa.array(TAGS.values())
        for batch in batches:
            lengths, codes = _lengths(batch.column(words)), _coded(batch.column(words), model.words)
            edges, found = np.concatenate([[0], np.cumsum(lengths)]), np.zeros(len(codes), np.int64)
            for steps in _like_lengths(lengths):
                found[steps.place] = best_tags(model.emission[codes[steps.place]], steps, model.start, model.transition)
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), names.take(pa.array(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, new_column])

    return df.mapInArrow(tag, schema)


def tag_and_lemmatize(df: DataFrame, id_column: str, text_column: str, lexicon: DataFrame, model: TagModel,
                      **flags) -> DataFrame:
    """``id, text_lemmatized``: cleaned words, each replaced by its lemma as the part of speech it has there."""
    listed = df.select(id_column, clean_tokens(F.col(text_column), **flags).alias("words"))
    return tag_and_lemmatize_words(listed, id_column, "words", lexicon, model)


def tag_and_lemmatize_words(df: DataFrame, id_column: str, words: str, lexicon: DataFrame, model: TagModel) -> DataFrame:
    """The same for words that are cleaned already."""
    tagged = tag_words(df.select(id_column, words), words, model)
    return lemmatize(tagged, id_column, F.col(words), lexicon, tags=F.col("tags"))
