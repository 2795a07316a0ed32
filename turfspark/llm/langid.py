"""Language identification by a linear-chain conditional random field over words.

Words (runs of letters, lower-cased) are labelled with languages, so a text that switches between languages
is followed from word to word. A word's features are the byte n-grams of the word with its edges marked -
those at an edge are its affixes - and the word itself where a lexicon of frequent words has it. Emission
weights and transitions are learned together by gradient ascent on the conditional likelihood of word
sequences that switch between texts of different languages. Forward-backward gives every word's
distribution; the language of a text has the largest mean over its words, which is its score.
``label_words`` gives the words with their languages.

Learning takes at most ``ROWS`` rows in all and ``PER_LANGUAGE`` of a language, shared out among all values of
``lang``, by a hash of the id; of a longer text it takes a window of ``WINDOW`` characters, at a place given by
the hash. From these, runs of words make ``SEQUENCES`` sequences of ``LENGTH`` words, or ``MORE`` for each language if
that is more.
The lexicon has the words that make up ``LEXICON_SHARE`` of the sample or more. Everything else covers all rows
and whole texts. The recursions run over all texts of a batch at once: blocks of words get transfer matrices,
which are chained per text, then vectors within blocks; a text beyond ``LONG`` words is gone through in ranges
of that many, between which messages are passed. Prediction is a scan without a shuffle.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing
could be learned; ties go to the language first in order; rows without a language aren't learned from, and
rows with one id count once; repeated rows are predicted alike; an empty table gives no rows. Other columns,
whatever their names, are ignored. Ids must be numbers, or texts of numbers.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh, map_batches
from ._text import LETTERS, buffers, hash_spans, mix, sliced, word_spans

PER_LANGUAGE, ROWS, WINDOW = 250, 16_000, 4000
BITS, GRAMS, LEXICON_SHARE, BLOCK, LONG = 16, (2, 3, 4), 5e-5, 32, 1 << 17
SEQUENCES, MORE, LENGTH, STEPS, RATE, L2 = 2400, 150, 48, 60, 0.4, 1e-5
UNDETERMINED, MIN_SHARE = "und", 0.34


def word_features(words: list[bytes], lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and where each word's begin (one more than words).
    n-grams are hashed to 2^BITS numbers; lexicon words come after those."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    all_words, all_ids = [], []
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(data)) + n <= ends[word]) if len(data) else np.zeros(0, np.int64)
        gram = np.full(len(at), n, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(257) + data[at + k]
        all_words.append(word[at]), all_ids.append((mix(gram) >> np.uint64(64 - BITS)).astype(np.int64))
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    all_words.append(np.array([i for i, _ in known], np.int64)), all_ids.append(np.array([k for _, k in known], np.int64))
    owner, ids = np.concatenate(all_words), np.concatenate(all_ids)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def tokens(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of the texts in turn, and where each text's words begin."""
    data, offsets = buffers(pc.utf8_lower(column))
    starts, ends, per_row = word_spans(data, offsets, LETTERS)
    _, first, number = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [raw[starts[i] : ends[i]] for i in first], number, per_row


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # from x to, logarithms
    lexicon: dict[bytes, int]

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at in range(0, len(words), 20_000):
            ids, begins = word_features(words[at : at + 20_000], self.lexicon)
            out[at : at + 20_000] = np.add.reduceat(self.weights[ids], begins[:-1], axis=0)
        return out

    def words(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For every text, or range of texts: (first row, row after the last, where each row's words begin, the words'
        distributions, the words' numbers among all of the column)."""
        words, number, per_row = tokens(column)
        table, row = self.emissions(words), 0
        while row < len(per_row) - 1:
            to = max(row + 1, int(np.searchsorted(per_row, per_row[row] + LONG, "right")) - 1)
            a, b = per_row[row], per_row[to]
            if b - a <= LONG:
                yield row, to, per_row[row : to + 1] - a, posteriors(table[number[a:b]], per_row[row : to + 1] - a, self.transitions), np.arange(a, b)
            else:
                yield from self._long(row, a, b, table, number)
            row = to

    def _long(self, row: int, a: int, b: int, table: np.ndarray, number: np.ndarray):
        """One text in ranges of words, between which messages are passed."""
        k, bounds = len(self.languages), [*range(a, b, LONG), b]
        ranges = list(zip(bounds[:-1], bounds[1:], strict=True))
        through = [transfer(table[number[x:y]], self.transitions) for x, y in ranges]
        into, back = [np.full(k, 1 / k)], [np.full(k, 1 / k)]
        for m in through[:-1]:
            v = into[-1] @ m
            into.append(v / v.sum())
        for m in through[:0:-1]:
            v = m @ back[-1]
            back.append(v / v.sum())
        for (x, y), v, w in zip(ranges, into, back[::-1], strict=True):
            yield row, row + 1, np.array([0, y - x]), posteriors(table[number[x:y]], np.array([0, y - x]), self.transitions, v, w), np.arange(x, y)

    def shares(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean distribution over the words of every text (zeros without words), and the word counts."""
        total, counts = np.zeros((len(column), len(self.languages))), np.zeros(len(column), np.int64)
        if not self.languages:
            return total, np.diff(tokens(column)[2])
        for row, to, begins, p, _ in self.words(column):
            sums = np.zeros((len(p) + 1, p.shape[1]))
            np.cumsum(p, axis=0, out=sums[1:])
            total[row:to] += sums[begins[1:]] - sums[begins[:-1]]
            counts[row:to] += np.diff(begins)
        return total / np.maximum(counts, 1)[:, None], counts

    def predict(self, column: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        share, counts = self.shares(column)
        best = share.argmax(1) if self.languages else np.zeros(len(counts), int)
        sure = letters & (counts > 0) & bool(self.languages)
        score = np.where(sure, share.max(1) if self.languages else 0.0, 0.0)
        return [self.languages[i] if ok else UNDETERMINED for i, ok in zip(best, sure, strict=True)], np.clip(score, 0, 1), counts


def _blocks(e: np.ndarray, per_row: np.ndarray, t: np.ndarray):
    """Blocks of words, none across two texts: a block's text, its number there, its words, which of those there
    are, and its transfer matrix."""
    k, counts = e.shape[1], np.diff(per_row)
    blocks = -(-counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    text = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(text)) - first[text]
    at = per_row[text][:, None] + nth[:, None] * BLOCK + np.arange(BLOCK)
    real = at < per_row[text + 1][:, None]
    at = np.where(real, at, 0)
    through = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
    for s in range(BLOCK):
        step = (through @ t) * e[at[:, s]][:, None, :]
        through = np.where(real[:, s, None, None], step / step.sum((1, 2), keepdims=True), through)
    return text, nth, at, real, through


def transfer(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Transfer matrix, but for a factor, of a run of words."""
    e, t = np.exp(emissions - emissions.max(1, keepdims=True)), np.exp(transitions - transitions.max())
    m = np.eye(e.shape[1])
    for b in _blocks(e, np.array([0, len(e)]), t)[-1]:
        m = m @ b
        m /= m.sum()
    return m


def posteriors(emissions: np.ndarray, per_row: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Each word's distribution given its whole text, by forward-backward; all texts at once. ``before`` and ``after`` are
    messages from words outside, uniform by default."""
    e = np.exp(emissions - emissions.max(1, keepdims=True)) if len(emissions) else emissions
    t = np.exp(transitions - transitions.max()) if transitions.size else transitions
    k = e.shape[1]
    if not len(e) or not k:
        return np.zeros_like(emissions)
    text, nth, at, real, through = _blocks(e, per_row, t)
    into, back = np.full((len(text), k), 1 / k), np.full((len(text), k), 1 / k)
    if before is not None:
        into[:] = before
    if after is not None:
        back[:] = after
    order = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[order], np.arange((nth.max() + 1 if len(nth) else 0) + 1))
    levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for b in levels[1:]:
        v = np.einsum("ni,nij->nj", into[b - 1], through[b - 1])
        into[b] = v / v.sum(1, keepdims=True)
    for b in levels[:0:-1]:
        v = np.einsum("nij,nj->ni", through[b], back[b])
        back[b - 1] = v / v.sum(1, keepdims=True)
    out = np.zeros_like(e)
    ahead = np.zeros((len(text), BLOCK, k))
    v = into
    for s in range(BLOCK):
        step = (v @ t) * e[at[:, s]]
        v = np.where(real[:, s, None], step / step.sum(1, keepdims=True), v)
        ahead[:, s] = v
    v = back
    for s in range(BLOCK - 1, -1, -1):
        ok = real[:, s]
        both = ahead[ok, s] * v[ok]
        out[at[ok, s]] = both / both.sum(1, keepdims=True)
        step = (v * e[at[:, s]]) @ t.T
        v = np.where(ok[:, None], step / step.sum(1, keepdims=True), v)
    return out


def train(texts: list[tuple[str, str]], steps: int = STEPS, seed: int = 1) -> Model:
    """From (text, language); deterministic."""
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), {})
    texts = sorted(texts)
    rng = np.random.default_rng(seed)
    words, number, per_row = tokens(pa.array([t for t, _ in texts]))
    seen = np.bincount(number, minlength=len(words))
    lexicon = {words[i]: (1 << BITS) + k for k, i in enumerate(np.flatnonzero((seen >= 3) & (seen >= LEXICON_SHARE * len(number))))}
    k, size = len(languages), (1 << BITS) + len(lexicon)
    label = np.array([languages.index(x) for _, x in texts])
    usable = [[i for i in np.flatnonzero(label == y) if per_row[i + 1] > per_row[i]] for y in range(k)]
    present = [y for y in range(k) if usable[y]]
    if not present:
        return Model(languages, np.zeros((size, k), np.float32), np.zeros((k, k)), lexicon)
    sequences = max(SEQUENCES, MORE * k)
    x, y = np.zeros((sequences, LENGTH), np.int64), np.zeros((sequences, LENGTH), np.int64)
    for s in range(sequences):  # runs of words of one text each
        at = 0
        while at < LENGTH:
            lang = present[rng.integers(len(present))]
            text = usable[lang][rng.integers(len(usable[lang]))]
            begin = rng.integers(per_row[text], per_row[text + 1])
            n = int(min(rng.integers(4, LENGTH), per_row[text + 1] - begin, LENGTH - at))
            x[s, at : at + n], y[s, at : at + n] = number[begin : begin + n], lang
            at += n
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(y.shape)
    ids, begins = word_features([words[i] for i in used], lexicon)
    owner = np.repeat(np.arange(len(used)), np.diff(begins))
    w, t = np.zeros((size, k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    batch = sequences // 8
    for step in range(steps):
        rows = np.arange(step % 8 * batch, step % 8 * batch + batch)
        emit = np.add.reduceat(w[ids], begins[:-1], axis=0)[x[rows]]
        e = np.exp(emit - emit.max(2, keepdims=True))
        m = np.exp(t - t.max())
        ahead = np.zeros_like(e)
        v = np.full((batch, k), 1 / k)
        for s in range(LENGTH):
            v = (v @ m) * e[:, s]
            v /= v.sum(1, keepdims=True)
            ahead[:, s] = v
        expected_t = np.zeros((k, k))
        grad = np.zeros_like(e)
        v = np.full((batch, k), 1 / k)
        for s in range(LENGTH - 1, -1, -1):
            both = ahead[:, s] * v
            grad[:, s] = -both / both.sum(1, keepdims=True)
            ahead_of = e[:, s] * v
            v = ahead_of @ m.T
            if s:
                before = ahead[:, s - 1] / (ahead[:, s - 1] * v).sum(1, keepdims=True)
                expected_t += m * (before.T @ ahead_of)
            v /= v.sum(1, keepdims=True)
        np.put_along_axis(grad, y[rows][:, :, None], np.take_along_axis(grad, y[rows][:, :, None], 2) + 1, 2)
        seen_t = np.zeros((k, k))
        np.add.at(seen_t, (y[rows][:, :-1].ravel(), y[rows][:, 1:].ravel()), 1)
        per_word = np.column_stack([np.bincount(x[rows].ravel(), grad[:, :, j].ravel(), len(used)) for j in range(k)])
        dw = np.column_stack([np.bincount(ids, per_word[owner, j], size) for j in range(k)]) / batch - L2 * w
        dt = (seen_t - expected_t) / batch - L2 * t
        gw += dw * dw
        gt += dt * dt
        w += RATE * dw / np.sqrt(gw)
        t += RATE * dt / np.sqrt(gt)
    return Model(languages, w.astype(np.float32), t, lexicon)


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, rows_in_all: int = ROWS, held_out_of: int = 3, held_out: int = 1) -> DataFrame:
    """(text, lang) to learn from: rows with a language whose crc32 of the id as text mod ``held_out_of``
    isn't ``held_out``; of each language those with the smallest hashes of the id, one row for an id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("id is not null and text is not null and lang is not null").filter(F.crc32(F.col("id").cast("string")) % held_out_of != held_out)
    rows = rows.withColumn("hash", F.xxhash64("id", F.lit(4)))
    ids = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()  # a row for a language
    if not ids:
        return rows.select("text", "lang").limit(0)
    wanted = max(1, min(per_language, rows_in_all // len(ids)))
    # about twice as many by the hash's range, so that few rows move; then exactly those with the smallest hashes
    top = F.create_map(*[v for r in ids for v in (F.lit(r["lang"]), F.lit(int(-(2**63) + min(1.0, (2 * wanted + 20) / max(1, r["n"])) * (2**64 - 2048))).cast("long"))])
    length, place = F.char_length("text"), F.pmod(F.xxhash64("id", F.lit(5)), F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1)
    cut = F.when(length > WINDOW, F.substring(F.col("text"), (place + 1).cast("int"), F.lit(WINDOW))).otherwise(F.col("text"))
    few = rows.filter(F.col("hash") <= F.element_at(top, F.col("lang"))).groupBy("lang", "hash", "id").agg(F.min(cut).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))  # a few hundred rows for a language
    return few.withColumn("nth", nth).filter(F.col("nth") <= wanted).select("text", "lang")


def fit(docs: DataFrame) -> Model:
    return train([(r.text, r.lang) for r in training_rows(docs).collect()])  # a bounded sample


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                lang, score, n = model.value.predict(b.column("text"), b.column("letters").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(score), pa.array(n)], ["doc_id", "held_out", "lang_pred", "score", "n_words"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), _letters("text").alias("letters"))
    return rows.transform(map_batches, run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long")


def label_words(docs: DataFrame) -> DataFrame:
    """(doc_id, position, word, language, score) of every word: its language given the whole text, and how likely
    that is. A word's position counts from 0; words are lower-cased. No rows if nothing could be learned."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                if not model.value.languages:
                    continue
                names, (words, number, per_row) = pa.array(model.value.languages), tokens(b.column("text"))
                words = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
                for row, to, begins, p, at in model.value.words(b.column("text")):
                    owner = np.repeat(np.arange(row, to), np.diff(begins))
                    columns = [b.column(0).take(pa.array(owner)), pa.array(at - per_row[owner]), words.take(pa.array(number[at])), names.take(pa.array(p.argmax(1))), pa.array(p.max(1))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "word", "language", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_batches, run, "doc_id long, position long, word string, language string, score double")


def _letters(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def keep_identified(docs: DataFrame, threshold: float = MIN_SHARE) -> DataFrame:
    """The documents, all columns, of which one language has at least ``threshold`` of the words; texts
    that are undetermined or mixed beyond that go."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                lang, score, _ = model.value.predict(b.column("text").cast(pa.string()), b.column(len(names)).to_numpy(zero_copy_only=False))
                keep = (score >= threshold) & (np.array(lang) != UNDETERMINED)
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names).filter(pa.array(keep))

    return docs.withColumn(fresh(docs, "_letters"), _letters("text")).transform(map_batches, run, docs.schema)
