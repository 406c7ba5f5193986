"""Language identification by unigrams over a fixed vocabulary, marginalised over segmentations.

Each language has one probability for each piece of a public vocabulary. A word's probability is the
sum over all ways to cut it into pieces of the product of their probabilities, which a forward pass over
the word computes; a text's is the product over its words. The piece probabilities are fitted by
expectation maximisation, whose expected counts come from a forward and a backward pass. Nothing is ever
segmented by the tokenizer itself: only its list of pieces is used.

A word is a maximal run of letters and their marks that begins with a letter, lower-cased, with the vocabulary's word-start mark in front; longer
ones than CHUNK characters are learned and scored in stretches of that length. Pieces are lower-cased, too, and counted once. Workers score each distinct word once
while they remember it. The model is pieces times languages, whatever the corpus.
"""

from __future__ import annotations

import math
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_slices, columns, iterator_udf, release, series_slices, stored, unused

#: A word: letters of any script, with the marks that follow them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LATIN = re.compile("[a-z]+")
#: Stretches have so many characters, or as many as the longest piece.
CHUNK = 24
#: Probability of a character that stands for itself, outside the vocabulary.
UNKNOWN = 1e-7
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Words that are scored at once.
BLOCK = 4000
UNDETERMINED = "und"


def read_pieces(model_path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased; none if it has no letter: digits, fractions and other numbers are none."""
    lower = text.lower()
    return LATIN.findall(lower) if lower.isascii() else LETTERS.findall(lower)


class Lattice:
    """All pieces that match inside many words at once."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
    #: Longer pieces are few: they are looked up only behind the start, of so many characters, of one of them.
    COMMON = 8

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in dict.fromkeys(p.lower() for p in pieces) if p]
        self.longest = max(map(len, self.pieces), default=1)
        self.chunk = max(CHUNK, self.longest)
        self.hashes = np.zeros(len(self.pieces) + 1, np.uint64)  # row 0: no piece
        self.begun = np.zeros(1 << 20, bool)
        for k, piece in enumerate(self.pieces, 1):
            h = 0
            for n, c in enumerate(piece):
                if n == self.COMMON:
                    self.begun[h >> 44] = True
                h = ((h ^ ord(c)) * int(self.MULTIPLIER)) & (2**64 - 1)
                h ^= h >> 29
            self.hashes[k] = h
        self.bits = max(20, 3 + len(self.hashes).bit_length())
        while not self._placed():
            self.bits += 1

    def _placed(self) -> bool:
        """Fills two tables of 2 ** bits slots; false if a piece finds both of its slots taken."""
        self.slots = [np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)]
        places = [p.tolist() for p in self._slots(self.hashes)]
        for k in range(1, len(self.hashes)):
            for table, own in zip(self.slots, places, strict=True):
                if not table[own[k]]:
                    table[own[k]] = k
                    break
            else:
                return False
        return True

    def _slots(self, h):
        return (h >> np.uint64(64 - self.bits)).astype(np.int64), (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h):
        """The piece numbers of hashes; 0 where there is none."""
        first, second = self._slots(h)
        found = self.slots[0][first]
        found[self.hashes[found] != h] = 0
        other = self.slots[1][second]
        other[self.hashes[other] != h] = 0
        return np.where(found, found, other)

    def matches(self, words: list[str]):
        """For words of one length: the pieces that start at each position with each length, as {(start, length): (rows, numbers)}, rows being all or those with a piece."""
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        found = {}
        for start in range(n):
            rows, h = np.arange(len(words)), np.zeros(len(words), np.uint64)
            for length in range(1, min(self.longest, n - start) + 1):
                if length == self.COMMON + 1:
                    rows = np.flatnonzero(self.begun[(h >> np.uint64(44)).astype(np.int64)])
                    h = h[rows]
                if not len(rows):
                    break
                h = (h ^ points[rows, start + length - 1]) * self.MULTIPLIER
                h ^= h >> np.uint64(29)
                numbers = self.find(h)
                if length == 1:
                    found[start, length] = rows, numbers
                elif (hit := np.flatnonzero(numbers)).size:
                    found[start, length] = rows[hit], numbers[hit]
        return found


def _weights(table, numbers, length):
    """Probabilities of the matched pieces by language; a single character outside the vocabulary has UNKNOWN."""
    weight = table[numbers]
    return weight + (numbers == 0)[:, None] * UNKNOWN if length == 1 else weight


def forward(lattice: Lattice, table, words: list[str]):
    """Probabilities of words of one length, by language, summed over all segmentations."""
    n, found = len(words[0]), lattice.matches(words)
    alpha = np.zeros((n + 1, len(words), table.shape[1]))
    alpha[0] = 1
    for end in range(1, n + 1):
        for length in range(1, min(lattice.longest, end) + 1):
            if (end - length, length) in found:
                rows, numbers = found[end - length, length]
                alpha[end][rows] += alpha[end - length][rows] * _weights(table, numbers, length)
    return alpha, found


def stretches(words, chunk: int = CHUNK):
    """(number of the word, stretch) of words with their mark in blocks of one length."""
    by_length: dict[int, list[tuple[int, str]]] = {}
    for k, word in enumerate(words):
        marked = "▁" + word
        for at in range(0, len(marked), chunk):
            part = marked[at : at + chunk]
            by_length.setdefault(len(part), []).append((k, part))
    for parts in by_length.values():
        for at in range(0, len(parts), BLOCK):
            block = parts[at : at + BLOCK]
            yield [k for k, _ in block], [p for _, p in block]


def log_probabilities(lattice: Lattice, table, words: list[str]):
    """Rows of log-probabilities of any words; long ones are scored in stretches of CHUNK characters."""
    out = np.zeros((len(words), table.shape[1]))
    for numbers, parts in stretches(words, lattice.chunk):
        alpha, _ = forward(lattice, table, parts)
        np.add.at(out, numbers, np.log(alpha[-1]))
    return out


def expected_counts(lattice: Lattice, probability, words: list[str], counts):
    """Expected numbers of each piece in the words of one language, by a forward and a backward pass."""
    total, counts = np.zeros(len(lattice.hashes)), np.asarray(counts, float)
    table = probability[:, None]
    for own, parts in stretches(words, lattice.chunk):
        n = len(parts[0])
        alpha, found = forward(lattice, table, parts)
        share = counts[own][:, None] / alpha[n]
        beta = np.zeros_like(alpha)
        beta[n] = 1
        for start in range(n - 1, -1, -1):
            for length in range(1, min(lattice.longest, n - start) + 1):
                if (start, length) in found:
                    rows, numbers = found[start, length]
                    through = _weights(table, numbers, length) * beta[start + length][rows]
                    beta[start][rows] += through
                    total += np.bincount(numbers, (alpha[start][rows] * through * share[rows])[:, 0], len(total))
    total[0] = 0
    return total


def fit(labelled: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", per_language: int = 1500, rounds: int = 3, smoothing: float = 0.02) -> dict:
    """Piece probabilities of each language from labelled rows.

    Rows with a null text or language teach nothing. About `per_language` rows of each language are
    used, chosen by a hash of the text; this is the documented bound of the training sample. Without labelled rows, the model knows no language and calls every text `und`.
    """
    labelled = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return {"names": [], "table": np.zeros((1, 0), np.float32), "pieces": pieces}
    names = sorted(sizes)
    limits = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, per_language / sizes[n]))])
    sample = labelled.where(F.expr("pmod(xxhash64(text), 1048576)") < limits[F.col("lang")] * 1048576)

    def counted(batches):
        import pyarrow as pa
        from collections import Counter

        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            seen: Counter = Counter()
            for t, name in zip(*columns(batch, "text", "lang"), strict=True):
                seen.update((name, w) for w in words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words = stored(sample.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    context = words.sparkSession.sparkContext
    lattice = Lattice(pieces)
    table = np.full((len(lattice.hashes), len(names)), 1.0 / len(lattice.hashes))
    table[0] = 0
    for _ in range(rounds):
        sent = context.broadcast((lattice, table, names))

        def expected(batches):
            import pyarrow as pa

            lattice, table, names = sent.value
            total = np.zeros_like(table)
            for batch in batches:
                langs, found, n = columns(batch, "lang", "word", "n")
                for k, name in enumerate(names):
                    own = [i for i, x in enumerate(langs) if x == name]
                    total[:, k] += expected_counts(lattice, table[:, k], [found[i] for i in own], [n[i] for i in own])
            rows, cols = total.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])], ["piece", "lang", "n"])

        found = words.mapInArrow(expected, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        table = np.full(table.shape, smoothing)
        table[found["piece"], found["lang"]] += found["n"]
        table[0] = 0
        table /= table.sum(axis=0)
    release(words)
    return {"names": names, "table": table.astype(np.float32), "pieces": lattice.pieces}


def predict(df: DataFrame, model: dict, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the likeliest language and its posterior under equal priors.

    Null texts and texts without a letter get `und` and 0.0. Whole texts are scored, however long; of tied languages
    the first in alphabetical order is given. Columns of the same names as the two outputs are replaced; others are kept.
    """
    lattice = Lattice(model["pieces"])
    sent = df.sparkSession.sparkContext.broadcast((lattice, model["table"].astype(float), model["names"]))

    def scored(batches):
        import pandas as pd

        lattice, table, names = sent.value
        known: dict[str, int] = {}
        rows = np.zeros((0, len(names)), np.float32)
        for texts in series_slices(batches):
            if len(known) > REMEMBERED:
                known, rows = {}, rows[:0]
            cut = [words_of(t) if t else [] for t in texts]
            new = list({w for words in cut for w in words} - known.keys())
            if new:
                known.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
                rows = np.concatenate([rows, log_probabilities(lattice, table, new).astype(np.float32)])
            best, post = [], []
            for words in cut:
                if not words or not names:
                    best.append(UNDETERMINED)
                    post.append(0.0)
                    continue
                total = rows[[known[w] for w in words]].sum(axis=0, dtype=float)
                k = int(total.argmax())
                best.append(names[k])
                post.append(1.0 / float(np.exp(np.maximum(total - total[k], -700)).sum()))
            yield pd.DataFrame({"lang": best, "score": post})

    guess, = unused(df, "guess")
    guessed = df.withColumn(guess, iterator_udf(scored, "lang string, score double")(F.col(text)))
    return guessed.withColumns({lang: F.col(guess)["lang"], score: F.col(guess)["score"]}).drop(guess)
