"""Toxicity: gradient-boosted trees over dense features, isotonically calibrated.

Features of a whole text, computed in one pass over its bytes: densities and weights of lexicon words and
word beginnings, how many hits stand near a second-person pronoun, rates of capitals, shouted words and
punctuation, and how much of the lexicon shows only after undoing character substitutions and in-word
punctuation. The lexicon is learned: words, and beginnings of 5 to 8 bytes, whose presence a likelihood-
ratio test ties to label 1 (the critical value grows with the number of words tested); all of them are kept.
Capitals count in every script of two-byte characters, such as accented Latin, Greek and Cyrillic.

Learning uses at most about ``SAMPLE`` labelled ids (chosen by a hash of the id, each with one whole text); one
half of them gives the lexicon, the other the trees and the calibration, so lexicon features are as good on
the rows that the trees see as on new ones. Counts of words are a Spark aggregate; trees and calibration are
Spark ML's. Equal scores are pooled, with their weight, before the calibration. Scoring is a scan: no shuffle.

Edge cases: null, empty and word-less texts get the score of a text without any feature; without labelled
rows of both classes every score is the share of label 1 (0 where there is none); documents repeated or
without an id are scored like others and never learned from if the id is null; of rows with one id the first
by text is learned from; a document with several labels counts as toxic if one says so; an empty table gives no
rows. Other columns, whatever their names, are ignored. Ids must be numbers, or texts of numbers.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, map_batches
from ._text import LETTERS, SpanHasher, buffers, hash_words, sliced, word_spans

SAMPLE, TREES, DEPTH, NEAR = 20_000, 20, 4, 3
PREFIXES = (5, 6, 7, 8)
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú tu tus ti usted ustedes vosotros vuestro vuestra os"
).split()
FEATURES = [
    "words_log", "mean_word", "hit_rate", "hits_log", "weight_rate", "weight_max", "prefix_rate", "prefix_weight_max",
    "you_rate", "near_you", "near_you_share", "capitals", "shouted", "punctuation", "exclaims", "marked_words", "mixed_words", "hidden_hits", "hidden_share",
]

_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!|", b"oieastasil", strict=True):
    _LEET[_a] = _b
_LEET[65:91] += 32
_DROPPED = np.zeros(256, bool)
_DROPPED[list(b"*._-~^'`#%&+")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_UPPER_TWO = np.array([chr(c).isupper() for c in range(2048)])  # characters of two bytes
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_TOKEN = ~np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_YOU = np.sort(hash_words([w.encode() for w in SECOND_PERSON]))


@dataclass
class Lexicon:
    """Sorted hashes of words and of word beginnings, with the weight of each."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.weights[at], 0.0)


def _beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: SpanHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, hash of their first bytes) for each length; such hashes differ from those of words."""
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        yield long, hasher(starts[long], starts[long] + n) ^ np.uint64(0x5DEECE66D)


def terms(column: pa.Array) -> Iterator[np.ndarray]:
    """For every text the distinct hashes of its words and their beginnings."""
    data, offsets = buffers(pc.utf8_lower(column))
    starts, ends, per_row = word_spans(data, offsets, LETTERS)
    hasher = SpanHasher(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(per_row))
    rows, hashes = [row], [hasher(starts, ends)]
    for which, h in _beginnings(data, starts, ends, hasher):
        rows.append(row[which]), hashes.append(h)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(rows, kind="stable")
    bounds = np.searchsorted(rows[order], np.arange(len(offsets)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(hashes[order[a:b]])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _largest(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest of the non-negative values of each row, 0 for none."""
    out = np.zeros(len(bounds) - 1)
    at = np.flatnonzero(values)
    np.maximum.at(out, np.searchsorted(bounds, at, "right") - 1, values[at])
    return out


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of ``FEATURES`` for every text."""
    raw, raw_offsets = buffers(column)
    size = np.maximum(np.diff(raw_offsets), 1)
    data, offsets = buffers(pc.utf8_lower(column))
    starts, ends, per_row = word_spans(data, offsets, LETTERS)
    n = np.maximum(np.diff(per_row), 1)
    hasher = SpanHasher(data)
    words = hasher(starts, ends)
    weight = lexicon.look_up(words)
    hit = weight > 0
    prefix = np.zeros(len(words))
    for which, h in _beginnings(data, starts, ends, hasher):
        prefix[which] = np.maximum(prefix[which], lexicon.look_up(h))
    any_hit = hit | (prefix > 0)
    you = np.isin(words, _YOU)
    # a pronoun within NEAR words, in the same row
    row = np.repeat(np.arange(len(n)), np.diff(per_row))
    near = np.zeros(len(words), bool)
    at = np.flatnonzero(you)
    for step in range(-NEAR, NEAR + 1):
        to = at + step
        ok = (to >= 0) & (to < len(words))
        ok[ok] = row[to[ok]] == row[at[ok]]
        near[to[ok]] = True
    hits, near_hits = _sums(any_hit, per_row), _sums(near & any_hit, per_row)
    # words as written
    s, e, pr = word_spans(raw, raw_offsets, _TOKEN)
    upper = _UPPER[raw]
    lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xDF))
    lead = lead[_UPPER_TWO[(raw[lead].astype(np.int64) & 31) << 6 | raw[lead + 1] & 63]]
    upper[lead] = upper[lead + 1] = True
    count = lambda of: np.concatenate([[0], np.cumsum(of)])
    capital, alpha, punct, digit = count(upper), count(_ALPHA[raw]), count(_PUNCT[raw]), count(_DIGIT[raw])
    tokens = np.maximum(np.diff(pr), 1)
    inner = np.maximum(e - 1, s)
    letters = alpha[e] - alpha[s]
    shouted = (capital[e] - capital[s] == letters) & (letters > 2)
    marked = (punct[inner] - punct[np.minimum(s + 1, inner)] > 0) & (letters > 0)
    mixed = (digit[e] - digit[s] > 0) & (letters > 0)
    # words with substitutions undone and in-word punctuation taken out
    plain = _LEET[data]
    keep = ~_DROPPED[data]
    shift = np.concatenate([[0], np.cumsum(keep)])
    plain, plain_offsets = plain[keep], shift[offsets]
    ps, pe, ppr = word_spans(plain, plain_offsets, LETTERS)
    shown = _sums(lexicon.look_up(SpanHasher(plain)(ps, pe)) > 0, ppr)
    hidden = np.maximum(shown - _sums(hit, per_row), 0)
    over = lambda bounds, total: total[bounds[1:]] - total[bounds[:-1]]
    out = [
        np.log1p(np.diff(per_row)), _sums(ends - starts, per_row) / n, _sums(hit, per_row) / n, np.log1p(_sums(hit, per_row)),
        _sums(weight, per_row) / n, _largest(weight, per_row), _sums(prefix > 0, per_row) / n, _largest(prefix, per_row),
        _sums(you, per_row) / n, np.log1p(near_hits), near_hits / np.maximum(hits, 1), over(raw_offsets, capital) / size,
        _sums(shouted, pr) / tokens, over(raw_offsets, punct) / size, _sums(raw == 33, raw_offsets) / size, _sums(marked, pr) / tokens,
        _sums(mixed, pr) / tokens, np.log1p(hidden), hidden / np.maximum(shown, 1),
    ]
    return np.column_stack(out)


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """At most about ``sample`` rows, by hash of the id; from a count, so it's as large at every size."""
    n = labelled.count()
    if n <= sample:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 60)) < int((1 << 60) * (sample / n)))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                found = list(terms(b.column("text")))
                label = np.repeat(b.column("label").to_numpy(zero_copy_only=False), [len(x) for x in found])
                flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(label.astype(np.int64))], ["term", "label"])

    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    if not total.n or not total.pos or total.pos == total.n:
        return Lexicon()
    share = total.pos / total.n
    counts = cut(rows.select("text", "label").transform(map_batches, run, "term long, label long").groupBy("term").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).filter("n >= 3"))
    tested = counts.count()
    pos, n = F.col("pos"), F.col("n")
    neg = n - pos
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(pos, n * share) + part(neg, n * (1 - share)))
    odds = F.log(((pos + 0.5) / (total.pos - pos + 0.5)) / ((neg + 0.5) / (total.n - total.pos - neg + 0.5)))
    scored = counts.withColumn("ratio", ratio).withColumn("odds", odds)
    chosen = scored.filter((F.col("ratio") > 2 * log(max(tested, 2)) + 2) & (F.col("odds") > 1.5))
    best = chosen.select("term", "odds").collect()  # of the sample's terms
    words, weights = np.array([r.term for r in best], np.int64).view(np.uint64), np.array([r.odds for r in best], float)
    return Lexicon(np.sort(words), weights[np.argsort(words)])


def featurise(docs: DataFrame, lexicon: Lexicon, carried: list[str]) -> DataFrame:
    """``carried`` columns and ``features`` of every row's ``text``."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried) + ", features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                x = features(b.column("text"), lexicon)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), lists], [*carried, "features"])

    return docs.select(*carried, "text").transform(map_batches, run, schema)


@dataclass
class Model:
    lexicon: Lexicon
    share: float
    trees: object = None
    calibration: object = None

    def score(self, featured: DataFrame) -> DataFrame:
        """Adds ``score`` in place of ``features``."""
        if self.trees is None:
            return featured.withColumn("score", F.lit(float(self.share))).drop("features")
        rows = featured.withColumn("features", array_to_vector("features"))
        rows = self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
        rows = self.calibration.transform(rows.drop("features", "rawPrediction", "probability", "prediction"))
        return rows.withColumn("score", F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))).drop("raw", "calibrated")

    def scorer(self) -> "Scorer":
        """The same scores for arrays of features, within a task that has the rows in hand."""
        if self.trees is None:
            return Scorer([], [], np.zeros(1), np.array([float(self.share)]))
        grown = [tree_of(t.toDebugString) for t in self.trees.trees]
        return Scorer(grown, list(self.trees.treeWeights), self.calibration.boundaries.toArray(), self.calibration.predictions.toArray())


@dataclass
class Scorer:
    trees: list
    weights: list[float]
    bounds: np.ndarray
    calibrated: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        margin = sum((w * leaves(t, x) for t, w in zip(self.trees, self.weights, strict=True)), np.zeros(len(x)))
        return np.clip(np.interp(1 / (1 + np.exp(-2 * margin)), self.bounds, self.calibrated), 0.0, 1.0)


def tree_of(described: str):
    """A leaf's value, or (feature, threshold, tree at or below it, tree above it)."""
    lines = iter(x for x in map(str.strip, described.splitlines()) if x.startswith(("If ", "Else ", "Predict: ")))

    def node():
        line = next(lines)
        if line.startswith("Predict: "):
            return float(line.split()[1])
        _, feature, _, at = line.removeprefix("If (").removesuffix(")").split()
        below = node()
        next(lines)  # its Else
        return int(feature), float(at), below, node()

    return node()


def leaves(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    feature, at, below, above = tree
    return np.where(x[:, feature] <= at, leaves(below, x), leaves(above, x))


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Model:
    """From rows (id, text, label)."""
    rows = cut(_sampled(labelled, sample))
    lexical = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)) == 0
    lexicon = learn_lexicon(rows.filter(lexical))
    rest = cut(featurise(rows.filter(~lexical), lexicon, ["id", "label"]))
    total = rest.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    share = (total.pos or 0) / max(total.n, 1)
    if not 0 < share < 1:
        return Model(lexicon, share)
    rest = rest.select("id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    fitting = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) > 0
    first, second = rest.filter(fitting), rest.filter(~fitting)
    if min(x.select("label").distinct().count() for x in (first, second)) < 2:
        first = second = rest
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=4, seed=1, subsamplingRate=1.0).fit(first.coalesce(2))
    raw = model.transform(second).select("label", vector_to_array("probability")[1].alias("raw"))
    raw = raw.groupBy("raw").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("rows"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="rows", predictionCol="calibrated").fit(raw)
    return Model(lexicon, share, model, calibration)


def labelled_rows(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, held_out: int = 0) -> DataFrame:
    """(id, text, label) of the rows to learn from: crc32 of the id as text mod ``held_out_of`` isn't ``held_out``."""
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("long")).alias("label"))
    known = known.filter(F.crc32(F.col("id").cast("string")) % held_out_of != held_out)
    known = _sampled(known, SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # about SAMPLE ids


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = fit(labelled_rows(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = model.score(featurise(rows, model.lexicon, ["doc_id"]))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that score below ``threshold``."""
    scorer, lexicon = (model := fit(labelled_rows(docs, labels))).scorer(), model.lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                yield b.filter(pa.array(scorer(features(b.column("text").cast(pa.string()), lexicon)) < threshold))

    return docs.transform(map_batches, run, docs.schema)
