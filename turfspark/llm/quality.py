"""Quality: a sparse rule ensemble over text statistics, compiled to a Spark column expression.

1. ``statistics`` computes the dense columns ``STATS`` of whole texts, in one pass over their bytes: lengths, rates
   of capitals, marks and digits, how words, pairs of words and lines repeat, how words end.
2. Boosted trees (Spark ML) are grown on labelled rows; every path from a root to a node below it is a rule, a
   conjunction of bounds on statistics (``paths``). Equal rules are one.
3. A logistic regression with an L1 penalty (Spark ML) weighs the rules; most weights become zero. The penalty is
   the one of ``PENALTIES`` with the least log loss on a third of the rows that it wasn't fitted on; then all rows
   give the weights.
4. ``Model.column`` writes the rules that are left as one expression over the statistics: scoring is a scan with
   generated code, and the model can be read, logged and stored as text (``Model.rules``).

Learning uses at most about ``SAMPLE`` labelled ids, chosen by a hash of the id, each with one whole text, so that
trees and weights cost the same at every size; statistics and scores cover all rows.

Edge cases: null, empty and word-less texts get the score of a text whose statistics are all zero, but for the
marks it has; without labelled rows of both classes every score is the share of label 1 (0 where there is none);
documents repeated or without an id are scored like others, and never learned from if the id is null; of rows with
one id the first by text is learned from; a document with several labels counts as good if one says so; an empty
table gives no rows. Other columns, whatever their names, are ignored. Ids must be numbers, or texts of numbers.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut, map_batches
from ._text import LETTERS, buffers, hash_spans, mix, sliced, word_spans

SAMPLE, TREES, DEPTH = 20_000, 24, 3
PENALTIES = (0.01, 0.003, 0.001, 0.0003)
STATS = [
    "words_log", "mean_word", "short_words", "long_words", "letters", "capitals", "digits", "marks", "rare_marks", "commas", "stops", "sentence_log", "lone_marks",
    "doubled_marks", "shouted", "capital_starts", "distinct_words", "vocabulary", "top_word", "repeated_next", "distinct_pairs", "lines_log", "distinct_lines", "line_words",
]

_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_PUNCT = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
_RARE = _PUNCT & ~np.isin(np.arange(256), list(b"!\"'(),-.:;?"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_UPPER_TWO = np.array([chr(c).isupper() for c in range(2048)])  # characters of two bytes
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_STOP = np.isin(np.arange(256), list(b".!?"))
_LINE = np.arange(256) != 10


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each span; or the sum of small numbers whose total is below the length of the texts."""
    total = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 30 else np.int64)
    np.cumsum(flags, dtype=total.dtype, out=total[1:])
    return (total[ends] - total[starts]).astype(np.float64)


def _kinds(hashes: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many different hashes it has, and how often the most frequent one occurs."""
    rows = len(per_row) - 1
    row = np.repeat(np.arange(rows), np.diff(per_row))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(h)))
    top = np.zeros(rows)
    np.maximum.at(top, r[new], sizes)
    return np.bincount(r[new], minlength=rows).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATS`` for every text."""
    raw, offsets = buffers(column)
    lo, hi = offsets[:-1], offsets[1:]
    size = np.maximum(hi - lo, 1)
    # what is between white space
    s, e, per_row = word_spans(raw, offsets, ~_SPACE)
    tokens = np.maximum(np.diff(per_row), 1)
    share = lambda flags: _sums(flags, per_row[:-1], per_row[1:]) / tokens
    upper = _UPPER[raw]
    lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xDF)) if len(raw) else np.zeros(0, np.int64)
    lead = lead[_UPPER_TWO[(raw[lead].astype(np.int64) & 31) << 6 | raw[lead + 1] & 63]]
    upper[lead] = upper[lead + 1] = True
    punct, letter = _PUNCT[raw], LETTERS[raw]
    letters_in, capitals_in = _sums(letter, s, e), _sums(upper, s, e)
    doubled = (e - s > 1) & punct[e - 1] & punct[np.maximum(e - 2, s)] & (letters_in > 0)
    lone = _sums(letter | _DIGIT[raw], s, e) == 0
    last = np.where(e - s > 0, raw[e - 1], 0) if len(s) else np.zeros(0, np.uint8)
    stops = share(_STOP[last])
    letters = _sums(letter, lo, hi)
    out = {
        "letters": letters / size, "capitals": _sums(upper, lo, hi) / np.maximum(letters, 1), "digits": _sums(_DIGIT[raw], lo, hi) / size,
        "marks": _sums(punct, lo, hi) / size, "rare_marks": _sums(_RARE[raw], lo, hi) / size, "commas": share(last == 44), "stops": stops,
        "sentence_log": np.log1p(np.diff(per_row)) - np.log1p(stops * tokens), "lone_marks": share(lone), "doubled_marks": share(doubled),
        "shouted": share((capitals_in == letters_in) & (letters_in > 1)), "capital_starts": share(upper[s] if len(s) else np.zeros(0, bool)),
    }
    ls, le, lines = word_spans(raw, offsets, _LINE)
    n = np.diff(lines)
    out |= {"lines_log": np.log1p(n), "distinct_lines": _kinds(hash_spans(raw, ls, le), lines)[0] / np.maximum(n, 1), "line_words": np.log1p(np.diff(per_row) / np.maximum(n, 1))}
    # words of letters, in lower case
    data, offsets = buffers(pc.utf8_lower(column))
    s, e, per_row = word_spans(data, offsets, LETTERS)
    n = np.diff(per_row)
    least = np.maximum(n, 1)
    share = lambda flags: _sums(flags, per_row[:-1], per_row[1:]) / least
    words = hash_spans(data, s, e)
    follows = np.ones(len(words), bool)  # not the first of its text
    follows[per_row[:-1][n > 0]] = False
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]])[: len(words)]
    pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + words)[follows]
    kinds, top = _kinds(words, per_row)
    pair_kinds, _ = _kinds(pairs, np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))]))
    out |= {
        "words_log": np.log1p(n), "mean_word": share(e - s),
        "short_words": share(e - s < 4), "long_words": share(e - s > 12), "distinct_words": kinds / least, "vocabulary": kinds / np.sqrt(least),
        "top_word": top / least, "repeated_next": share(follows & (before == words)), "distinct_pairs": pair_kinds / np.maximum(n - 1, 1),
    }
    return np.column_stack([out[c] for c in STATS])


#: Bounds of a rule, lowest and highest by number of the statistic: the value is above the one, and the other at most.
Rule = dict[int, tuple[float, float]]
_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)")


def paths(tree: str) -> list[Rule]:
    """The rule of every node below the root, from the printed form of a tree, whose lines are indented by depth."""
    above: list[tuple[int, Rule]] = [(-1, {})]
    rules = []
    for line in tree.splitlines():
        if not (found := _SPLIT.search(line)):
            continue
        depth, at, value = len(line) - len(line.lstrip()), int(found[2]), float(found[4])
        while above[-1][0] >= depth:
            above.pop()
        low, high = above[-1][1].get(at, (-np.inf, np.inf))
        rule = above[-1][1] | {at: (low, min(high, value)) if found[3] == "<=" else (max(low, value), high)}
        above.append((depth, rule))
        rules.append(rule)
    return rules


def distinct(rules: list[Rule]) -> list[Rule]:
    return [dict(r) for r in dict.fromkeys(tuple(sorted(r.items())) for r in rules)]


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """A column of 0 and 1 for each rule, over rows of ``STATS``."""
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for at, (low, high) in rule.items():
            out[:, k] &= (x[:, at] > low) & (x[:, at] <= high)
    return out.astype(np.float64)


def condition(rule: Rule) -> Column:
    """The rule over columns named as in ``STATS``."""
    bounds = []
    for at, (low, high) in sorted(rule.items()):
        bounds += [F.col(STATS[at]) > F.lit(float(low))] if low > -np.inf else []
        bounds += [F.col(STATS[at]) <= F.lit(float(high))] if high < np.inf else []
    return reduce(lambda a, b: a & b, bounds)


@dataclass
class Model:
    """Weighted rules and the intercept of their sum; without rules ``share`` is every score."""

    share: float
    intercept: float = 0.0
    weighted: list[tuple[float, Rule]] = field(default_factory=list)

    def column(self) -> Column:
        """The score, over columns named as in ``STATS``."""
        if not self.weighted:
            return F.lit(float(self.share))
        parts = [F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for w, r in self.weighted]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(self.intercept))))

    def rules(self) -> list[tuple[float, str]]:
        """Weights and readable rules, the weightiest first."""

        def text(rule: Rule) -> str:
            parts = [(f"{low:.4g} < " if low > -np.inf else "") + STATS[at] + (f" <= {high:.4g}" if high < np.inf else "") for at, (low, high) in sorted(rule.items())]
            return " and ".join(parts)

        return [(w, text(r)) for w, r in sorted(self.weighted, key=lambda x: -abs(x[0]))]


def described(docs: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
    """``carried`` columns and a column for each of ``STATS``, of every row."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), *(f"{c} double" for c in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, text_col):
                x = statistics(b.column(text_col))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(pa.array(np.ascontiguousarray(v)) for v in x.T)], [*carried, *STATS])

    return docs.select(*carried, text_col).transform(map_batches, run, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out_of: int = 3, held_out: int = 1) -> DataFrame:
    """(id, text, label) of at most about ``sample`` rows to learn from: crc32 of the id as text mod ``held_out_of``
    isn't ``held_out``."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality").cast("double")).alias("label"))
    known = known.filter(F.crc32(F.col("id").cast("string")) % held_out_of != held_out)
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 60)) < int((1 << 60) * (sample / n)))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # about ``sample`` ids


def _log_loss(rows: DataFrame) -> float:
    p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - 1e-9)), F.lit(1e-9))
    return rows.agg(F.avg(-F.when(F.col("label") > 0, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalties: tuple[float, ...] = PENALTIES) -> Model:
    """From rows (id, text, label)."""
    stats = cut(described(labelled, ["id", "label"]))
    total = stats.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    share = (total.pos or 0) / max(total.n, 1)
    if not 0 < share < 1:
        return Model(share)
    # a bounded sample, in an order of its own so that a refit gives the same trees; each step of a fit is a job over it
    rows = cut(stats.select("id", "label", array_to_vector(F.array(*STATS)).alias("features")).coalesce(2).sortWithinPartitions("id"))
    grown = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=4, seed=1).fit(rows)
    rules = distinct([r for t in grown.trees for r in paths(t.toDebugString)])
    if not rules:
        return Model(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("features").flatten().to_numpy(zero_copy_only=False)
            x = holds(rules, flat.reshape(b.num_rows, len(STATS)))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(rules), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), lists], ["id", "label", "features"])

    held = rows.select("id", "label", vector_to_array("features").alias("features")).transform(map_batches, run, "id long, label double, features array<double>")
    held = cut(held.select("id", "label", array_to_vector("features").alias("features")))
    third = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) == 0
    first, second = held.filter(~third), held.filter(third)
    lasso = lambda penalty: LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, tol=1e-5)
    penalty = penalties[0]
    if len(penalties) > 1 and first.select("label").distinct().count() == 2 and not second.isEmpty():
        penalty = min(penalties, key=lambda p: _log_loss(lasso(p).fit(first).transform(second)))
    best = lasso(penalty).fit(held)
    weighted = [(float(w), r) for w, r in zip(best.coefficients.toArray(), rules, strict=True) if w]
    return Model(share if weighted else 1 / (1 + np.exp(-best.intercept)), float(best.intercept), weighted)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = fit(labelled_rows(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = described(rows, ["doc_id"]).select("doc_id", model.column().alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
