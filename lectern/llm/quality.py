"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, each chosen pair of features a
table over both. Training goes round the features in turn, fitting a tree of a few leaves
to what is left unexplained and adding a small part of it to the feature's table; then
the pairs that explain most of the rest are treated alike. A score is a sum of looked-up
numbers, one vectorised addition per table.

Features describe form only: sizes, kinds of characters, repetition. They are taken
from the whole text, all texts of a batch at once.

The model learns from at most TRAIN_ROWS labelled rows, taken in the order of a hash of
the id; only their features reach the driver.

Defined results: a null or empty text has features of nothing and a score like any other;
null labels and labels without a document teach nothing; repeated rows count as often
as they stand; with one class only, every score is that class; without labels it is 0.5;
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BASE, BY_SPACE, chunks, crc_mod, mix, text_bytes, word_hashes

TRAIN_ROWS = 20_000
HELD_OUT, FOLDS = 2, 4
BINS, PAIR_BINS = 48, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 8
STEP, LEAVES, LEAST_ROWS = 0.12, 4, 8.0
RIDGE = 1.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "beyond_ascii", "commas_stops",
    "exclamations", "bars", "symbols", "other_marks", "lines_per_word", "line_bytes",
    "distinct_words", "top_word", "distinct_triples", "distinct_lines", "end_marks", "capital_words",
    "all_upper_words",
)
# One class per byte: lower, upper, digit, blank, line end, comma or stop, exclamation,
# bar, symbol, other mark, beyond ASCII.
CLASSES = np.full(256, 9, dtype=np.int64)
for low, high, kind in ((97, 122, 0), (65, 90, 1), (48, 57, 2), (128, 255, 10)):
    CLASSES[low : high + 1] = kind
for text, kind in ((" \t\x0b\x0c\r", 3), ("\n", 4), (",.;:?", 5), ("!", 6), ("|", 7), ("#$%&*@^~<>=+{}[]\\_`", 8)):
    for char in text:
        CLASSES[ord(char)] = kind


def share_distinct(values: np.ndarray) -> tuple[float, float]:
    """Distinct values, and those of the most frequent, per value."""
    if not len(values):
        return 1.0, 0.0
    _, counts = np.unique(values, return_counts=True)
    return len(counts) / len(values), float(counts.max()) / len(values)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    factor = np.uint64(BASE)
    for begin, end in chunks(texts):
        group = texts[begin:end]
        words, at = word_hashes(group, BY_SPACE)
        triples = words.copy()
        if len(words) > 2:
            triples = mix((words[:-2] * factor + words[1:-1]) * factor + words[2:])
        for i, text in enumerate(group):
            data = np.frombuffer(text, dtype=np.uint8)
            kinds = CLASSES[data]
            n = np.bincount(kinds, minlength=11).astype(np.float64)
            first, last = int(at[i]), int(at[i + 1])
            number = last - first
            shown = max(len(data) - n[3] - n[4], 1.0)
            letters = max(n[0] + n[1] + n[10], 1.0)
            blank = np.concatenate(([True], (kinds == 3) | (kinds == 4), [True]))
            starts, stops = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
            capital = float(np.count_nonzero(kinds[starts] == 1)) if number else 0.0
            lower_so_far = np.concatenate(([0], np.cumsum(kinds == 0)))
            upper_so_far = np.concatenate(([0], np.cumsum(kinds == 1)))
            loud = (
                float(
                    np.count_nonzero(
                        (upper_so_far[stops - 1] - upper_so_far[starts] > 0)
                        & (lower_so_far[stops - 1] == lower_so_far[starts])
                    )
                )
                if number
                else 0.0
            )
            distinct, top = share_distinct(words[first:last])
            lines = [line for line in text.split(b"\n") if line.strip()]
            per_word = 1.0 / max(number, 1)
            out[begin + i] = (
                np.log1p(len(data)),
                np.log1p(number),
                shown * per_word,
                n[1] / letters,
                n[2] / shown,
                n[10] / shown,
                n[5] * per_word,
                n[6] * per_word,
                n[7] * per_word,
                n[8] * per_word,
                n[9] * per_word,
                len(lines) * per_word,
                np.log1p(len(data) / max(len(lines), 1)),
                distinct,
                top,
                share_distinct(triples[first : max(last - 2, first)])[0],
                len(set(lines)) / max(len(lines), 1),
                sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / max(len(lines), 1),
                capital * per_word,
                loud * per_word,
            )
    return out


@dataclass
class Additive:
    """Bin edges of every feature, its table, and tables of pairs of coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float = 0.0
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def sums(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.bias)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.sums(self.bins(x)), -35, 35)))


def best_cut(slope: np.ndarray, bend: np.ndarray, rows: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins in two; no gain without enough rows."""
    left_s, left_b, left_n = (np.cumsum(v)[:-1] for v in (slope, bend, rows))
    all_s, all_b, all_n = slope.sum(), bend.sum(), rows.sum()
    gain = (
        left_s**2 / (left_b + RIDGE)
        + (all_s - left_s) ** 2 / (all_b - left_b + RIDGE)
        - all_s**2 / (all_b + RIDGE)
    )
    gain[(left_n < LEAST_ROWS) | (all_n - left_n < LEAST_ROWS)] = 0
    place = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[place]), place + 1) if len(gain) else (0.0, 0)


def shallow_tree(slope: np.ndarray, bend: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of at most LEAVES leaves over ordered bins."""
    leaves = [(0, len(slope))]
    while len(leaves) < LEAVES:
        cuts = [best_cut(slope[a:b], bend[a:b], rows[a:b]) for a, b in leaves]
        k = int(np.argmax([gain for gain, _ in cuts]))
        if cuts[k][0] <= 1e-9:
            break
        a, b = leaves[k]
        leaves[k : k + 1] = [(a, a + cuts[k][1]), (a + cuts[k][1], b)]
    out = np.zeros(len(slope))
    for a, b in leaves:
        out[a:b] = slope[a:b].sum() / (bend[a:b].sum() + RIDGE)
    return out


def cross_tree(slope: np.ndarray, bend: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of one cut of the first feature and one of the second on either side."""
    best, values = 0.0, np.zeros(slope.shape)
    for flip in (False, True):
        s, h, n = (v.T if flip else v for v in (slope, bend, rows))
        for cut in range(1, len(s)):
            gain, out = 0.0, np.zeros(s.shape)
            for part in (slice(0, cut), slice(cut, None)):
                ps, ph, pn = s[part].sum(axis=0), h[part].sum(axis=0), n[part].sum(axis=0)
                _, place = best_cut(ps, ph, pn)
                for a, b in ((0, place), (place, len(ps))):
                    if pn[a:b].sum() >= LEAST_ROWS:
                        value = ps[a:b].sum() / (ph[a:b].sum() + RIDGE)
                        out[part, a:b] = value
                        gain += value * ps[a:b].sum()
            if gain > best:
                best, values = gain, out.T if flip else out
    return best, values


def fit(x: np.ndarray, labels: np.ndarray) -> Additive:
    """Cyclic boosting of the logistic loss, features first, then the best pairs."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], [])
    bins = model.bins(x)
    model.coarse = []
    for j, e in enumerate(edges):
        # Coarser bins of about equal numbers of rows.
        counts = np.bincount(bins[:, j], minlength=len(e) + 1)
        before = np.cumsum(counts) - counts / 2
        model.coarse.append(np.minimum((before * PAIR_BINS / max(len(x), 1)).astype(np.int64), PAIR_BINS - 1))
    mean = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
    model.bias = float(np.log(mean / (1 - mean)))
    total = np.full(len(x), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            slope, bend = slopes()
            at, size = bins[:, j], len(table)
            step = STEP * shallow_tree(
                np.bincount(at, weights=slope, minlength=size),
                np.bincount(at, weights=bend, minlength=size),
                np.bincount(at, minlength=size).astype(np.float64),
            )
            table += step
            total += step[at]
    grid = np.column_stack([c[bins[:, j]] for j, c in enumerate(model.coarse)])
    shape = (PAIR_BINS, PAIR_BINS)

    def cells(pair: tuple[int, int], slope: np.ndarray, bend: np.ndarray):
        at = grid[:, pair[0]] * PAIR_BINS + grid[:, pair[1]]
        return at, *(
            np.bincount(at, weights=w, minlength=PAIR_BINS**2).reshape(shape) for w in (slope, bend, np.ones(len(at)))
        )

    slope, bend = slopes()
    every = [(a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    gains = [cross_tree(*cells(pair, slope, bend)[1:])[0] for pair in every]
    model.pairs = [every[k] for k in np.argsort(gains)[::-1][:PAIRS]]
    model.pair_tables = [np.zeros(shape) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for pair, table in zip(model.pairs, model.pair_tables, strict=True):
            at, s, h, n = cells(pair, *slopes())
            step = STEP * cross_tree(s, h, n)[1]
            table += step
            total += step.ravel()[at]
    return model


def feature_rows(text: str):
    """For `mapInArrow`: label and features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(text_bytes(batch.column(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "x"]
            )

    return run


def train(
    docs: DataFrame, labels: DataFrame, label: str, id_column: str, text: str
) -> Additive | float:
    """The model, or one score for all where the labels have less than two classes."""
    usable = labels.where(
        F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & (crc_mod(id_column, FOLDS) != HELD_OUT)
    ).select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    # A bounded list of ids, so its broadcast is bounded too.
    sample = (
        docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "id")
        .select("label", "text")
        .mapInArrow(feature_rows("text"), "label int, x array<double>")
        .toArrow()
    )
    y = np.array(sample["label"].to_pylist(), dtype=np.float64)
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    return fit(np.array(sample["x"].to_pylist()), y)


def scorer(shared, text: str):
    """For `mapInArrow`: `row` and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Additive = shared.value
        for batch in batches:
            row = batch.column("row")
            scores = model.scores(features(text_bytes(row.field(text))))
            yield pa.RecordBatch.from_arrays([row, pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`row` (struct of all columns), held_out and score of every document."""
    model = train(docs, labels, label, id_column, text)
    rows = docs.select(F.struct("*").alias("row"))
    held_out = F.crc32(F.coalesce(F.col(f"row.{id_column}").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    if isinstance(model, float):
        return rows.select("row", held_out.alias("held_out"), F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double"
    return rows.mapInArrow(scorer(shared, text), schema).select("row", held_out.alias("held_out"), "score")
