"""Toxicity by two Kneser-Ney word-pair models, one of toxic and one of ordinary texts.

A word after another has, in each class, a discounted share of the pair's contexts, then of
the word's continuations in that class, then of those of ever shorter beginnings of
the word, so that an inflected form is known by its stem. The last level is counted
over the whole corpus and shared by both classes: an expression that neither class's
sample has says nothing, and a rare one little. It comes from every document,
labelled or not, through a table of bit sketches of fixed size.

A text is judged by length-normalised log-likelihood differences: of the whole text, and
the highest of all its windows of a few sizes, so that an insult counts in a long text
too. A logistic curve over these, fitted on labelled texts the models haven't seen,
gives the score.

The models learn from at most TRAIN_ROWS labelled rows per class, taken in the order of a hash
of the id, and of these from TRAIN_BYTES of text, the shortest texts first, so that one very long
text can't crowd out the others; these bounds also limit the broadcast model. A word counts no
more often in a class than there are texts that have it.

Defined results: a null or empty text has no evidence and gets the curve's value there;
null labels and labels without a document teach nothing; repeated rows count as often
as they stand; without both classes among the labels, every score is 0; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import (
    BASE,
    BY_LETTER,
    chunks,
    crc_mod,
    mix,
    text_bytes,
    word_and_prefix_hashes,
)
from lectern.llm.shingles import set_bits

TRAIN_ROWS = 1536
TRAIN_BYTES = 8 << 20
# Taken from every count of contexts. What has no more is left to the levels below: a
# passage that a few texts share looks like a habit of one class, the more so a pair.
WORD_DISCOUNT, PAIR_DISCOUNT = 2.0, 8.0
# Bytes of the beginnings of a word, from its own level down to the shared one.
STEMS = (6, 5, 4)
WINDOWS = (1, 4, 16)
# Labels of ids whose checksum has this remainder are never learned from.
HELD_OUT, FOLDS = 0, 5
# Of the others, those with this remainder fit the curve, the rest the models.
CURVE = 4
# Sketches of continuations: stems share SLOTS of BITMAPS, whatever the corpus.
SLOTS, BITMAPS, PIECES = 1 << 18, 4, 64
# Bits of the word pairs that the texts learned from have had.
COPY_BITS = 1 << 25


def pair_hashes(words: np.ndarray, stems: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each word's stem with the word before it in its text."""
    before = np.zeros(len(words), dtype=np.uint64)
    before[1:] = words[:-1]
    before[begins[:-1][begins[:-1] < len(words)]] = 0
    return mix(before * np.uint64(BASE) + stems)


def sketch_pieces(text: str):
    """For `mapInArrow`: which words stand before each stem in the partition, as bit sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS * BITMAPS, dtype=np.uint32)
        for batch in batches:
            texts = text_bytes(batch.column(text))
            for begin, end in chunks(texts):
                levels, begins = word_and_prefix_hashes(texts[begin:end], BY_LETTER, STEMS)
                pairs = pair_hashes(levels[0], levels[-1], begins)
                at = (levels[-1] & np.uint64(SLOTS - 1)) * np.uint64(BITMAPS) + (pairs & np.uint64(BITMAPS - 1))
                rest = (pairs >> np.uint64(2)) | np.uint64(1 << 31)
                low = rest & (~rest + np.uint64(1))
                np.bitwise_or.at(table, at.astype(np.int64), low.astype(np.uint32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(PIECES, dtype=np.int32)),
                pa.array([zlib.compress(p.tobytes(), 1) for p in np.split(table, PIECES)], pa.binary()),
            ],
            names=["piece", "bits"],
        )

    return run


def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite pieces that come sorted by number, one in memory at a time."""
    piece, bits = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "bits": [bits.tobytes()]})

    for batch in batches:
        for number, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = np.frombuffer(zlib.decompress(packed), dtype=np.uint32)
            if number == piece:
                bits |= values
                continue
            if piece is not None:
                yield out()
            piece, bits = number, values.copy()
    if piece is not None:
        yield out()


def shared_continuations(docs: DataFrame, text: str) -> np.ndarray:
    """Estimated number of distinct words before the stems of each slot, over all documents."""
    rows = (
        docs.select(text)
        .mapInArrow(sketch_pieces(text), "piece int, bits binary")
        .repartition("piece")
        .sortWithinPartitions("piece")
        .mapInArrow(join_pieces, "piece int, bits binary")
        .collect()
    )
    out = np.zeros(SLOTS)
    size = SLOTS // PIECES
    for row in rows:
        # Probabilistic counting: the mean place of the lowest bit not set, with the
        # correction for small numbers.
        unset = ~np.frombuffer(row["bits"], dtype=np.uint32).reshape(size, BITMAPS)
        lowest = np.bitwise_count((unset & (~unset + np.uint32(1))) - np.uint32(1)).mean(axis=1)
        at = row["piece"] * size
        out[at : at + size] = BITMAPS / 0.77351 * (2.0**lowest - 2.0 ** (-1.75 * lowest))
    return out


def find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values in a sorted table, and which of them are there."""
    if not len(table):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


@dataclass
class Model:
    """Log-likelihood differences, toxic less ordinary: of each level's known words and stems,
    of passing a level on, of contexts, and of pairs."""

    levels: list[np.ndarray]
    level_gain: list[np.ndarray]
    passed_gain: list[float]
    context_gain: np.ndarray
    pairs: np.ndarray
    pair_gain: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def gains(self, levels: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
        gain = np.zeros(len(levels[0]))
        for table, known_gain, passed, values in reversed(
            list(zip(self.levels, self.level_gain, self.passed_gain, levels, strict=True))
        ):
            at, known = find(table, values)
            gain = np.where(known, known_gain[at], gain + passed)
        before = np.full(len(at), -1, dtype=np.int64)
        before[1:] = np.where(known[:-1], at[:-1], -1)
        before[begins[:-1][begins[:-1] < len(at)]] = -1
        gain += np.where(before >= 0, self.context_gain[before], 0.0)
        both = np.flatnonzero(known & (before >= 0))
        place, met = find(self.pairs, before[both] * len(self.levels[0]) + at[both])
        gain[both[met]] = self.pair_gain[place[met]]
        return gain

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Per text: the highest mean gain of windows of each size, and of the whole text."""
        out = np.zeros((len(texts), len(WINDOWS) + 1))
        for begin, end in chunks(texts):
            levels, begins = word_and_prefix_hashes(texts[begin:end], BY_LETTER, STEMS)
            words = levels[0]
            if not len(words):
                continue
            sums = np.concatenate(([0.0], np.cumsum(self.gains(levels, begins))))
            sizes = np.diff(begins)
            filled = np.flatnonzero(sizes > 0)
            first, last = begins[:-1][filled], begins[1:][filled]
            ends = np.repeat(last, sizes[filled])
            starts = np.arange(len(words))
            for k, window in enumerate(WINDOWS):
                # A window that would pass the end of its text is the part up to there.
                stop = np.minimum(starts + window, ends)
                short = (stop - starts < window) & (starts > np.repeat(first, sizes[filled]))
                mean = (sums[stop] - sums[starts]) / (stop - starts)
                mean[short] = -np.inf
                out[begin + filled, k] = np.maximum.reduceat(mean, first)
            out[begin + filled, -1] = (sums[last] - sums[first]) / (last - first)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = (self.evidence(texts) - self.center) / self.scale
        z = np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)
        return 1.0 / (1.0 + np.exp(-z))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_column: str, text: str) -> DataFrame:
    """Text, label and fold of the rows learned from, within the bounds."""
    order = F.xxhash64(id_column)
    usable = labels.where(
        F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & (crc_mod(id_column, FOLDS) != HELD_OUT)
    ).select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"), order.alias("order"))
    # Two bounded lists of ids, so the broadcast is bounded too.
    chosen = (
        usable.where("label = 1").orderBy("order", "id").limit(TRAIN_ROWS)
        .union(usable.where("label = 0").orderBy("order", "id").limit(TRAIN_ROWS))
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    # From the shortest on, so that a few very long texts leave room for all others.
    so_far = Window.partitionBy("label").orderBy("size", "order", "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        texts.join(F.broadcast(chosen), "id")
        .withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
        .withColumn("bytes", F.sum("size").over(so_far))
        .where(F.col("bytes") <= TRAIN_BYTES)
        .select("text", "label", crc_mod("id", FOLDS).alias("fold"))
    )


def pairs_of(texts: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of one class: places of the word before (-1: none) and the word, and how
    many distinct words stand before the pair. Copies of a text thus add nothing."""
    keys, earlier = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for begin, end in chunks(texts):
        (words, *_), begins = word_and_prefix_hashes(texts[begin:end], BY_LETTER, ())
        at = np.searchsorted(vocabulary, words)
        before = np.full(len(at), -1, dtype=np.int64)
        before[1:] = at[:-1]
        before[begins[:-1][begins[:-1] < len(words)]] = -1
        first = np.full(len(at), -1, dtype=np.int64)
        first[1:] = before[:-1]
        # Each pair once a chunk for every word before it.
        pairs, of = np.unique((before + 1) * len(vocabulary) + at, return_inverse=True)
        contexts = np.unique(of * (len(vocabulary) + 1) + np.where(before >= 0, first, -1) + 1)
        keys.append(pairs[contexts // (len(vocabulary) + 1)])
        earlier.append(contexts % (len(vocabulary) + 1) - 1)
    joined = np.concatenate(keys)
    keys.clear()
    pairs, of = np.unique(joined, return_inverse=True)
    del joined
    of *= len(vocabulary) + 1
    of += np.concatenate(earlier) + 1
    earlier.clear()
    contexts = np.unique(of) // (len(vocabulary) + 1)
    counts = np.bincount(contexts, minlength=len(pairs))
    return pairs // len(vocabulary) - 1, pairs % len(vocabulary), counts.astype(np.float64)


def texts_with(texts: list[bytes], vocabulary: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """How many of the texts have each stem; `place` is the stem of each word."""
    counts = np.zeros(size, dtype=np.int64)
    for begin, end in chunks(texts):
        (words, *_), begins = word_and_prefix_hashes(texts[begin:end], BY_LETTER, ())
        stems = place[np.searchsorted(vocabulary, words)]
        of = np.repeat(np.arange(end - begin), np.diff(begins))
        counts += np.bincount(np.unique(of * size + stems) % size, minlength=size)
    return counts


def discounted(counts: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """What is left of counts, and what was taken."""
    taken = np.minimum(counts, discount)
    return counts - taken, taken


def train_models(toxic: list[bytes], ordinary: list[bytes], continuations: np.ndarray) -> Model:
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(len(STEMS) + 1)]
    for texts in (toxic, ordinary):
        for begin, end in chunks(texts):
            hashed = word_and_prefix_hashes(texts[begin:end], BY_LETTER, STEMS)[0]
            distinct = np.unique(hashed[0], return_index=True)[1]
            for level, hashes in zip(found, hashed, strict=True):
                level.append(hashes[distinct])
    words, first = np.unique(np.concatenate(found[0]), return_index=True)
    found[0].clear()
    # Each word's place in every level's table.
    levels, place = [words], [np.arange(len(words))]
    for stems in found[1:]:
        table, at = np.unique(np.concatenate(stems)[first], return_inverse=True)
        stems.clear()
        levels.append(table)
        place.append(at)
    classes = [pairs_of(texts, words) for texts in (toxic, ordinary)]
    # Continuations of every level: distinct words before it, per class, but no more than there
    # are texts that have it. A word that one text repeats is no habit of its class.
    seen = [
        [
            np.minimum(
                np.bincount(np.unique((before + 1) * len(table) + at[word]) % len(table), minlength=len(table)),
                texts_with(texts, words, at, len(table)),
            ).astype(np.float64)
            for (before, word, _), texts in zip(classes, (toxic, ordinary), strict=True)
        ]
        for table, at in zip(levels, place, strict=True)
    ]
    shared = np.maximum(continuations[(levels[-1] & np.uint64(SLOTS - 1)).astype(np.int64)], 1.0)
    shared = shared / max(continuations.sum(), shared.sum())
    below = [shared, shared]
    gains, passed_gains, shares = [], [], below
    for k in range(len(levels) - 1, -1, -1):
        if k < len(levels) - 1:
            # A stem's share is passed on to its words as both classes together have them.
            pooled = seen[k][0] + seen[k][1]
            parent = np.zeros(len(levels[k]), dtype=np.int64)
            parent[place[k]] = place[k + 1]
            of_parent = np.bincount(parent, weights=pooled, minlength=len(levels[k + 1]))
            part = pooled / np.maximum(of_parent[parent], 1e-9)
            below = [share[parent] * part for share in shares]
        shares, passed = [], []
        for counts, lower in zip(seen[k], below, strict=True):
            total = max(counts.sum(), 1.0)
            kept, taken = discounted(counts, WORD_DISCOUNT)
            passed.append(max(taken.sum(), 1.0) / total)
            shares.append(kept / total + passed[-1] * lower)
        gains.insert(0, np.log(shares[0]) - np.log(shares[1]))
        passed_gains.insert(0, float(np.log(passed[0]) - np.log(passed[1])))
    size = len(words)
    inner = [(b[b >= 0], w[b >= 0], n[b >= 0]) for b, w, n in classes]
    classes.clear()
    contexts = [np.bincount(b, weights=n, minlength=size) for b, _, n in inner]
    # A context that a class hasn't seen passes all its weight on.
    rest = [
        np.where(total > 0, np.bincount(b, weights=discounted(n, PAIR_DISCOUNT)[1], minlength=size) / np.maximum(total, 1), 1.0)
        for (b, _, n), total in zip(inner, contexts, strict=True)
    ]
    keys = [b * size + w for b, w, _ in inner]
    # A pair with no more contexts in either class is the same as one not seen.
    pairs = np.unique(np.concatenate([k[n > PAIR_DISCOUNT] for k, (_, _, n) in zip(keys, inner, strict=True)]))
    before, word = pairs // max(size, 1), pairs % max(size, 1)
    logs = []
    for key, (_, _, n), total, left, share in zip(keys, inner, contexts, rest, shares, strict=True):
        direct = np.zeros(len(pairs))
        at, known = find(pairs, key)
        direct[at[known]] = discounted(n, PAIR_DISCOUNT)[0][known]
        logs.append(np.log(direct / np.maximum(total[before], 1) + left[before] * share[word]))
    features = len(WINDOWS) + 1
    return Model(
        levels=levels,
        level_gain=gains,
        passed_gain=passed_gains,
        context_gain=np.log(rest[0]) - np.log(rest[1]) if size else np.zeros(1),
        pairs=pairs,
        pair_gain=logs[0] - logs[1],
        center=np.zeros(features),
        scale=np.ones(features),
        weights=np.zeros(features + 1),
    )


def without_copies(texts: list[bytes]) -> list[bytes]:
    """The texts of which at least half of the word pairs are new, in order.

    Near copies would make a phrase of one text look like a common one.
    """
    bits = np.zeros(COPY_BITS // 8, dtype=np.uint8)
    kept = []
    for text in texts:
        (words,), begins = word_and_prefix_hashes([text], BY_LETTER, ())
        at = np.unique(pair_hashes(words, words, begins) & np.uint64(COPY_BITS - 1)).astype(np.int64)
        known = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        if len(at) and 2 * np.count_nonzero(known) <= len(at):
            kept.append(text)
        set_bits(bits, at)
    return kept


def fit_curve(model: Model, texts: list[bytes], labels: np.ndarray, odds: np.ndarray) -> None:
    """Logistic regression by Newton steps; `odds` weighs the classes as they occur."""
    x = model.evidence(texts)
    model.center, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = np.column_stack(((x - model.center) / model.scale, np.ones(len(x))))
    weight = odds[labels]
    ridge = np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -35, 35)))
        slope = x.T @ (weight * (labels - p)) - ridge * model.weights
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        # Shorter steps where classes separate cleanly.
        model.weights = model.weights + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))


def fitted(texts: list[bytes], label_of: np.ndarray, fold: np.ndarray, of_class: dict[int, int], continuations) -> Model | None:
    """None without both classes among the labels learned from."""
    fits = fold == CURVE
    if len({*label_of[fits].tolist()}) < 2 or len({*label_of[~fits].tolist()}) < 2:
        # Too few labels to set some aside.
        fits = np.ones(len(fold), dtype=bool) if len(of_class) == 2 and len({*label_of.tolist()}) == 2 else None
    if fits is None:
        return None
    learns = ~fits if not fits.all() else fits
    groups = [without_copies([texts[i] for i in np.flatnonzero(learns & (label_of == c))]) for c in (1, 0)]
    model = train_models(*groups, continuations)
    chosen = np.flatnonzero(fits)
    present = np.bincount(label_of[chosen], minlength=2)
    odds = np.array([of_class[0], of_class[1]], dtype=np.float64) / np.maximum(present, 1)
    fit_curve(model, [texts[i] for i in chosen], label_of[chosen], odds * len(chosen) / sum(of_class.values()))
    return model


def trainer(shared_continuations, of_class: dict[int, int]):
    """For `mapInArrow`: the model of the bounded sample, pickled; no row without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label_of, fold = [], [], []
        for batch in batches:
            texts += text_bytes(batch.column("text"))
            label_of += batch.column("label").to_pylist()
            fold += batch.column("fold").to_pylist()
        numbers = (np.array(column, dtype=np.int64) for column in (label_of, fold))
        model = fitted(texts, *numbers, of_class, shared_continuations.value)
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, protocol=5)], pa.binary())], names=["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, id_column: str, text: str) -> Model | None:
    """None without both classes among the labels learned from.

    Trained in a task, as the driver seldom gives back what its Python once held: the
    sample is bounded, whatever the corpus, and the driver receives the model only.
    """
    numbers = (
        labels.where(F.col(label).isin(0, 1) & (crc_mod(id_column, FOLDS) != HELD_OUT))
        .groupBy(F.col(label).cast("int").alias("label"))
        .count()
        .collect()
    )
    of_class = {r["label"]: r["count"] for r in numbers}
    if len(of_class) < 2:
        return None
    continuations = docs.sparkSession.sparkContext.broadcast(shared_continuations(docs, text))
    rows = sample(docs, labels, label, id_column, text).coalesce(1)
    models = rows.mapInArrow(trainer(continuations, of_class), "model binary").collect()
    continuations.destroy()
    return pickle.loads(models[0]["model"]) if models else None


def scorer(shared, text: str):
    """For `mapInArrow`: `row` and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            row = batch.column("row")
            scores = model.scores(text_bytes(row.field(text)))
            yield pa.RecordBatch.from_arrays([row, pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`row` (struct of all columns), held_out and score of every document."""
    model = train(docs, labels, label, id_column, text)
    rows = docs.select(F.struct("*").alias("row"))
    held_out: Column = (
        F.crc32(F.coalesce(F.col(f"row.{id_column}").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    )
    if model is None:
        return rows.select("row", held_out.alias("held_out"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double"
    return rows.mapInArrow(scorer(shared, text), schema).select("row", held_out.alias("held_out"), "score")
