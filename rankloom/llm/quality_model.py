"""Quality classifier: ridge scores on random Fourier features of document statistics, calibrated.

Statistics of the whole text are standardized and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Every partition adds up its part of the normal equations; the sums, of a size that the
number of features fixes, are solved on the driver. Ridge scores of rows that took no part in the fit are binned,
and isotonic regression over the bins turns a score into the probability of label 1.

Only the text is an input of a score. Learning may use at most ``max_fit_rows`` labelled rows, chosen by hash.

Defined cases: null text counts as '' and gets a score like any other. Rows repeat as they come, each with its score. Labels
other than 0 and 1 are ignored, several labels of one id are averaged. Without usable labels every score is 0.5. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.llm.tokens import text_slices
from rankloom.llm.words import arrow_words
from rankloom.staging import stage

BYTE_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "shout", "bar", "symbol", "follow", "lead")
N_STATS = 20
BINS = 4000
EMPTY_SCORE = 0.5


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, BYTE_CLASSES.index("symbol"), np.uint8)
    for name, members in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                          ("digit", b"0123456789"), ("space", b" \t\x0b\x0c\r"), ("newline", b"\n"), ("stop", b".;:"),
                          ("comma", b",'\"()-"), ("shout", b"!?"), ("bar", b"|"), ("follow", bytes(range(128, 192))),
                          ("lead", bytes(range(192, 256)))):
        kinds[list(members)] = BYTE_CLASSES.index(name)
    return kinds


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string array without nulls."""
    texts = texts.cast("large_binary")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def document_stats(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; all are finite, and 0 for an empty text but for the shares of kinds."""
    texts = pc.fill_null(texts.cast("large_string"), "")
    n = len(texts)
    data, offsets = text_bytes(texts)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _byte_classes()[data]
    share = np.bincount(owner * len(BYTE_CLASSES) + kinds, minlength=n * len(BYTE_CLASSES))
    of = dict(zip(BYTE_CLASSES, share.reshape(n, len(BYTE_CLASSES)).T.astype(np.float64)))
    chars = np.diff(offsets) - of["follow"]

    counts, codes, distinct = arrow_words(texts)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.float64)[codes]
    place = np.repeat(np.arange(n), counts)
    kept = np.maximum(counts, 1)
    total = lambda values: np.bincount(place, values, n) / kept
    mean = total(lengths)
    pairs, times = np.unique(place * max(len(distinct), 1) + codes, return_counts=True)
    pair_owner = pairs // max(len(distinct), 1)
    kinds_of = np.bincount(pair_owner, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, pair_owner, times)
    follow = np.zeros(len(codes), bool)
    if len(codes) > 1:
        follow[1:] = (codes[1:] == codes[:-1]) & (place[1:] == place[:-1])

    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    line_codes = lines.flatten().dictionary_encode()
    line_ids = line_codes.indices.to_numpy(zero_copy_only=False)
    n_lines = np.bincount(line_owner, minlength=n)
    line_pairs = np.unique(line_owner * max(len(line_codes.dictionary), 1) + line_ids)
    distinct_lines = np.bincount(line_pairs // max(len(line_codes.dictionary), 1), minlength=n)

    letters = np.maximum(of["lower"] + of["upper"] + of["lead"], 1)
    every = np.maximum(chars, 1)
    stats = np.column_stack([
        np.log1p(counts), np.log1p(chars), mean, np.sqrt(np.maximum(total(lengths ** 2) - mean ** 2, 0)),
        of["upper"] / letters, np.sqrt(of["digit"] / every), np.sqrt(of["symbol"] / every), np.sqrt(of["shout"] / kept),
        np.sqrt(of["bar"] / kept), np.sqrt(of["stop"] / kept), np.sqrt(of["comma"] / kept), np.sqrt(of["newline"] / kept),
        of["lead"] / letters, kinds_of / kept, most / kept, total(follow), total(lengths <= 3), total(lengths >= 12),
        distinct_lines / np.maximum(n_lines, 1), np.log1p(n_lines)])
    return stats


def with_stats(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``stats``."""
    rows = docs.select(*keep, F.col(text_column).alias("_text"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                stats = document_stats(part.column("_text"))
                places = np.arange(0, stats.size + 1, N_STATS, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], schema=arrow_schema)

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, x, np.ones((len(x), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), EMPTY_SCORE)
        return np.interp(self.ridge(stats), self.knots, self.values)


def isotonic(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean score, mean label) of the blocks that pool adjacent violators; the scores must be ascending."""
    blocks: list[list[float]] = []
    for score, label, count in zip(scores, labels, counts):
        blocks.append([score * count, label * count, count])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        stats = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
        yield stats, batch.column("label").to_numpy(zero_copy_only=False)


def sum_equations(rows: DataFrame, model: QualityModel, seed: int) -> np.ndarray:
    """The matrix of sums of outer products of (features, label), added up by partitions."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for stats, label in _stack(batches):
            both = np.hstack([model.features(stats), label[:, None]])
            total = total + both.T @ both
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_pydict({"line": pa.array(np.arange(len(total), dtype=np.int32)),
                                              "sums": pa.array(list(total))})

    def merge(table: pa.Table) -> pa.Table:
        sums = np.vstack(table["sums"].to_numpy()).sum(axis=0)
        return pa.table({"line": table["line"].slice(0, 1), "sums": pa.array([sums])})

    parts = rows.select("stats", "label").mapInArrow(add, "line int, sums array<double>")
    lines = parts.groupBy("line").applyInArrow(merge, "line int, sums array<double>").orderBy("line").toArrow()
    return np.vstack(lines["sums"].to_numpy()) if len(lines) else np.zeros((0, 0))


def fit(labelled: DataFrame, calibrates: Column, waves: int = 256, width: float = 1.0, ridge: float = 1e-3,
        seed: int = 11) -> QualityModel:
    """Learn from ``stats, label``; rows where ``calibrates`` holds fit the calibration, the others the ridge weights.

    ``labelled`` should be a written table of bounded size. What reaches the driver is fixed by the number of features
    and of bins.
    """
    solving, calibrating = labelled.where(~calibrates), labelled.where(calibrates)
    columns = [F.get("stats", i) for i in range(N_STATS)]
    moments = solving.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    empty = np.zeros(0)
    if moments[0] is None:
        return QualityModel(empty, empty, empty, empty, empty, empty, empty)
    draw = np.random.default_rng(seed)
    scale = np.array(moments[N_STATS:], float)
    model = QualityModel(np.array(moments[:N_STATS], float), np.where(scale > 1e-9, scale, 1.0),
                         draw.normal(0, width / np.sqrt(N_STATS), (N_STATS, waves)), draw.uniform(0, 2 * np.pi, waves),
                         empty, empty, empty)
    sums = sum_equations(solving, model, seed)
    matrix, target, rows = sums[:-1, :-1], sums[:-1, -1], sums[-2, -2]
    weights = np.linalg.solve(matrix + ridge * rows * np.eye(len(matrix)), target)
    model = QualityModel(model.mean, model.scale, model.directions, model.phases, weights, empty, empty)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stats, label in _stack(batches):
            yield pa.RecordBatch.from_pydict({"score": model.ridge(stats), "label": label})

    # Without rows for calibration the ones of the fit stand in.
    base = labelled if calibrating.isEmpty() else calibrating
    place = F.floor((F.greatest(F.least("score", F.lit(2.0)), F.lit(-1.0)) + 1.0) / 3.0 * BINS)
    bins = (base.select("stats", "label").mapInArrow(scored, "score double, label double")
            .groupBy(place.alias("bin")).agg(F.avg("score").alias("score"), F.avg("label").alias("label"),
                                             F.count("*").cast("double").alias("count"))
            .orderBy("bin").toArrow())
    knots, values = isotonic(*(bins[c].to_numpy() for c in ("score", "label", "count")))
    return QualityModel(model.mean, model.scale, model.directions, model.phases, weights, knots, values)


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def labelled_stats(stats: DataFrame, labels: DataFrame, label_column: str = "quality", key: str = "doc_id",
                   max_fit_rows: int = 200_000) -> DataFrame:
    """``key, stats, label`` of labelled rows outside fold 0, at most about ``max_fit_rows`` of them, by hash."""
    usable = (labels.where(F.col(label_column).isin(0, 1) & (fold(F.col(key)) > 0)).groupBy(key)
              .agg(F.avg(label_column).alias("label")))
    share = min(1.0, max_fit_rows / max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    # Bounded by max_fit_rows, so a few partitions hold it.
    return stage(stats.join(chosen, key).repartition(8, key), "labelled-stats")


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", **settings) -> QualityModel:
    """Fit on folds 1 to 3, calibrate on fold 4, leave fold 0 out."""
    return fit(labelled_stats(stats, labels, key=key, **settings), fold(F.col(key)) == 4)


def score_stats(stats: DataFrame, model: QualityModel, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns and ``score``."""
    rows = stats.select(*keep, "stats")
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(values))], schema=arrow_schema)

    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: QualityModel, text_column: str = "text", name: str = "score") -> DataFrame:
    """All columns and the score, in one pass over the texts; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(*kept, docs[text_column].alias("_text"))
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(name, T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                scores = model.score(document_stats(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], schema=arrow_schema)

    return rows.mapInArrow(run, schema)
