"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two strings by the letter subsequences of ORDERS letters that they share. Each occurrence
weighs DECAY to the power of its span, so that gaps and inserted characters cost a little and do not break a match;
spans end at SPANS. Strings are normalised by their occurrences' own weight.

What is labelled are sentences, which take their document's label. The kernel is taken over windows of a sentence, since an insult is a
small part of it: its whitespace tokens, with runs of single spelled-out letters joined, and longer tokens in overlapping stretches of STRETCH
characters. A sentence's decision is that of its most toxic window, and a document's that of its most toxic sentence. Which window decides is latent:
it is chosen anew in each round of training, for toxic sentences as for clean ones, by the machine so far; clean sentences whose strongest window
comes near are the hard negatives. Of a toxic document, only its strongest sentences count as toxic ones.

The machine is linear over the kernel values with the landmarks, times the inverse root of the landmarks' own kernel
matrix. As every kernel value is a sum over subsequences, that decision is a sum of one weight for each subsequence
(a table of fixed size), so scoring needs no loop over landmarks. Training uses a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_slices, columns, iterator_udf, release, series_slices, stored

ORDERS = (3, 4)
SPANS = {3: 6, 4: 7}
DECAY = 0.6
#: Longer tokens are cut into overlapping stretches, in training as in scoring.
STRETCH, STEP = 24, 16
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
REMEMBERED = 200_000
SIZE = 32**3 + 32**4


def _patterns():
    """(order, offsets, weight) of all ways to lay a subsequence within its span."""
    out = []
    for order in ORDERS:
        stack = [(0,)]
        while stack:
            offsets = stack.pop()
            if len(offsets) == order:
                out.append((order, offsets, DECAY ** (offsets[-1] + 1)))
            else:
                stack += [(*offsets, k) for k in range(offsets[-1] + 1, SPANS[order] - order + len(offsets) + 1)]
    return out


PATTERNS = _patterns()


def letter_classes(words: list[str]):
    """A row for each word of one length: 1 to 26 for a to z, five classes for other letters, 0 for what is no letter."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
    latin = (points >= 97) & (points <= 122)
    known, back = np.unique(points, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in known])[back].reshape(points.shape)
    return np.where(latin, points - 96, np.where(letters, 27 + points % 5, 0))


def occurrences(words: list[str]):
    """For words of one length, pattern by pattern: the codes of the subsequences at each place (0: none), and their weight."""
    classes = letter_classes(words)
    n = classes.shape[1]
    for order, offsets, weight in PATTERNS:
        if offsets[-1] >= n:
            continue
        code, whole = 0, True
        for k in offsets:
            part = classes[:, k : n - offsets[-1] + k]
            code = code * 32 + part
            whole = whole & (part > 0)
        yield np.where(whole, code + (32**3 if order == 4 else 0), 0), weight


def by_length(words: list[str]):
    """(places, words) of words of one length, in blocks."""
    places: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        places.setdefault(len(word), []).append(k)
    for own in places.values():
        for at in range(0, len(own), 10_000):
            block = own[at : at + 10_000]
            yield block, [words[k] for k in block]


def decisions(words: list[str], weights, bias: float):
    """The machine's decision for each string; a string without subsequences gets the bias."""
    out = np.full(len(words), float(bias))
    for own, block in by_length(words):
        total, norm = np.zeros(len(block)), np.zeros(len(block))
        for code, weight in occurrences(block):
            total += weight * weights[code].sum(axis=1)
            norm += weight * weight * (code > 0).sum(axis=1)
        out[own] += total / np.sqrt(np.maximum(norm, 1e-12))
    return out


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        cells: dict[tuple[int, int], float] = {}
        norm = np.zeros(len(words))
        for own, block in by_length(words):
            for code, weight in occurrences(block):
                norm[own] += weight * weight * (code > 0).sum(axis=1)
                for row, place in zip(*code.nonzero(), strict=True):
                    key = int(code[row, place]), own[row]
                    cells[key] = cells.get(key, 0.0) + weight
        self.codes = np.array(sorted({c for c, _ in cells}), np.int64)
        place = {int(c): i for i, c in enumerate(self.codes, 1)}
        self.table = np.zeros((len(self.codes) + 1, len(words)), np.float32)
        for (code, k), value in cells.items():
            self.table[place[code], k] = value / np.sqrt(norm[k])
        self.row = np.zeros(SIZE, np.int32)
        self.row[self.codes] = np.arange(1, len(self.codes) + 1)
        gram = self.kernel(words)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-3 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, words: list[str]):
        """Kernel values of strings with the landmarks."""
        out = np.zeros((len(words), len(self.words)))
        for own, block in by_length(words):
            total, norm = np.zeros((len(block), len(self.words))), np.zeros(len(block))
            for code, weight in occurrences(block):
                rows = self.row[code]
                for place in range(rows.shape[1]):
                    total += weight * self.table[rows[:, place]]
                norm += weight * weight * (code > 0).sum(axis=1)
            out[own] = total / np.sqrt(np.maximum(norm, 1e-12))[:, None]
        return out

    def mapped(self, words: list[str]):
        """The Nyström map: rows whose products approximate the kernel of the strings, exactly so among landmarks."""
        return self.kernel(words) @ self.root

    def machine(self, words: list[str], labels, importance, strength: float = 1.0):
        """Weights of subsequences and bias of a squared-hinge machine on the strings."""
        x = np.hstack([self.mapped(words), np.ones((len(words), 1))])
        y, w = np.where(labels, 1.0, -1.0), np.zeros(self.root.shape[1] + 1)
        ridge = np.eye(len(w))
        ridge[-1, -1] = 1e-3
        for _ in range(30):
            active = y * (x @ w) < 1
            xa, ca = x[active], (strength * importance)[active]
            new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        weights = np.zeros(SIZE, np.float32)
        weights[self.codes] = self.table[1:] @ (self.root @ w[:-1])
        weights[0] = 0
        return weights, float(w[-1])


def strings(text: str) -> list[str]:
    """The windows of a text: its lower-cased tokens, spelled-out letters joined, longer ones in overlapping stretches."""
    tokens = SPELLED.sub(lambda m: "".join(m[0].split()), text.lower()).split()
    return [w[at : at + STRETCH] for w in tokens for at in range(0, max(1, len(w) - STRETCH + STEP), STEP)]


class Scorer:
    """Decisions of strings, remembered."""

    def __init__(self, weights, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def learn(self, words: set[str]) -> dict[str, float]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(words - self.known.keys())
        self.known.update(zip(new, decisions(new, self.weights, self.bias).tolist(), strict=True))
        return self.known


def _strongest(sample: DataFrame, weights, bias: float, most: int) -> DataFrame:
    """Of each document, the `most` sentences with the highest decisions: (label, rank, string, decision)."""
    sent = sample.sparkSession.sparkContext.broadcast((weights, bias))

    def found(batches):
        import pyarrow as pa

        scorer = Scorer(*sent.value)
        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            rows = []
            texts, labels = columns(batch, "text", "label")
            cut = [[s for s in map(strings, SENTENCE.split(t)) if s] for t in texts]
            known = scorer.learn({w for sentences in cut for s in sentences for w in s})
            for sentences, label in zip(cut, labels, strict=True):
                best = sorted(((known[w], w) for w in {max(s, key=known.__getitem__) for s in sentences}), reverse=True)[:most] or [(bias, "")]
                rows += [(label, k, w, v) for k, (v, w) in enumerate(best)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.float64()))], ["label", "rank", "word", "value"])

    return sample.mapInArrow(found, "label int, rank int, word string, value double")


def _frequencies(sample: DataFrame) -> DataFrame:
    """In how many toxic and how many other documents each string stands."""

    def counted(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            seen: dict[str, list[int]] = {}
            for text, label in zip(*columns(batch, "text", "label"), strict=True):
                for w in set(strings(text)):
                    seen.setdefault(w, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["word", "toxic", "clean"])

    return sample.mapInArrow(counted, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def grams(word: str) -> set[str]:
    """The four-letter pieces of a string, with a mark for its start."""
    marked = "^" + word
    return {marked[k : k + 4] for k in range(len(marked) - 3)} or {marked}


def _gram_frequencies(sample: DataFrame) -> DataFrame:
    """In how many toxic and how many other documents each piece stands."""

    def counted(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            seen: dict[str, list[int]] = {}
            for text, label in zip(*columns(batch, "text", "label"), strict=True):
                for g in set().union(*map(grams, set(strings(text)))):
                    seen.setdefault(g, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["gram", "toxic", "clean"])

    return sample.mapInArrow(counted, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _telling(toxic: DataFrame, odds: dict[str, float], most: int) -> DataFrame:
    """(string, n): the `most` strings of each toxic document whose pieces tell most, and in how many documents they do."""
    sent = toxic.sparkSession.sparkContext.broadcast(odds)

    def found(batches):
        import pyarrow as pa

        known = sent.value
        score: dict[str, float] = {}
        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            words: list[str] = []
            for text in columns(batch, "text")[0]:
                own = set(strings(text))
                for w in own - score.keys():
                    score[w] = sum(known.get(g, 0.0) for g in grams(w))
                words += sorted((w for w in own if score[w] > 0), key=lambda w: (-score[w], w))[:most]
            if len(score) > REMEMBERED:
                score.clear()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    return toxic.mapInArrow(found, "word string").groupBy("word").agg(F.count("*").alias("n"))


def _sampled(labelled: DataFrame, sizes: dict[int, int], documents: int) -> tuple[DataFrame, dict[int, int]]:
    """About `documents` rows by a hash of the text, and how many of each label; fit() says which."""
    place = F.expr("pmod(xxhash64(text), 1048576)")
    ends = [int(1048576 * min(1.0, max(documents / sum(sizes.values()), 0.1 * documents / sizes[k]))) for k in (0, 1)]

    def drawn():
        # The first condition needs no label, so texts are left out before a join.
        found = stored(labelled.where(place < max(ends)).where(place < F.when(F.col("label") == 1, ends[1]).otherwise(ends[0])), "toxicity-sample")
        return found, {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}

    sample, taken = drawn()
    if len(taken) < 2:  # copies of few texts, none of which has been drawn
        for k in {0, 1} - taken.keys():
            ends[k] = labelled.where(F.col("label") == k).agg(F.min(place)).first()[0] + 1
        sample, taken = drawn()
    return sample, taken


@dataclass(frozen=True)
class Bounds:
    """How many strings of its sample training keeps at most. They are chosen from all of the sample's; whole texts are scored by all of theirs."""

    pieces: int = 4000  # pieces that are peculiar to toxic documents
    seeds: int = 2000  # first positive strings
    telling: int = 2  # of them, strings of one document
    common: int = 1500  # negative strings that many documents hold
    others: int = 2000  # further negative strings of clean documents
    strongest: int = 3000  # positive strings that a round adds
    hard: int = 3000  # negative strings that a round adds
    negatives: int = 6000  # negative strings in all, the latest
    sentences: int = 3  # strongest sentences of one document


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", documents: int = 15_000, landmarks: int = 256, rounds: int = 3, bounds: Bounds = Bounds()) -> dict:
    """The machine and its calibration from labelled rows (label 1: toxic).

    Rows with a null text or label teach nothing. About `documents` rows are used, chosen by a hash of the text: the same share of
    both labels, but of a rare label a tenth of `documents` where it has so many, and the text of the least hash at least; with
    `bounds`, the strings and pieces of strings that each round keeps of them, that is the documented bound of the training sample. Without
    rows of both labels, or where no string tells them apart, the model gives every text the share of toxic rows (0.0 without any rows).

    The first positive strings are those of each toxic document whose four-letter pieces are most peculiar to toxic documents: pieces
    of 1 % of the sample's toxic documents and of 5 at least, or of half as many until some are found; without such pieces, the strings
    that lean most to toxic documents. Later ones are those that the machine finds strongest in them. Negative strings are common ones, others of clean
    documents, and those that the machine finds strongest there.
    """
    labelled = labelled.select(F.col(text).alias("text"), (F.col(label) == 1).cast("int").alias("label")).where("text is not null and label is not null")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / max(total, 1)
    constant = {"weights": np.zeros(SIZE, np.float32), "bias": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share))) if 0 < share < 1 else -30.0 if not share else 30.0}
    if len(sizes) < 2:
        return constant
    sample, taken = _sampled(labelled, sizes, documents)
    stands_for = [sizes[k] / taken[k] for k in (0, 1)]  # rows of the table for each of the sample
    frequencies = stored(_frequencies(sample), "toxicity-strings")
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * (taken[0] / taken[1]))
    leaning = F.desc(F.col("odds") * F.log1p("toxic"))
    rarely_clean = f"coalesce(clean, 0) * {stands_for[0] / stands_for[1]!r}D <= 0.05 * n"
    pieces, least = stored(_gram_frequencies(sample), "toxicity-pieces").withColumn("odds", odds).where("odds > 1.8"), max(5.0, 0.01 * taken[1])
    while (peculiar := pieces.where(F.col("toxic") >= least).orderBy(leaning, "gram").limit(bounds.pieces).toPandas()).empty and least > 1:
        least /= 2
    telling = _telling(sample.where("label = 1"), dict(zip(peculiar["gram"], peculiar["odds"] * np.sqrt(peculiar["toxic"].astype(float)), strict=True)), bounds.telling).join(frequencies.select("word", "clean"), "word").where(rarely_clean)
    seeds = telling.orderBy(F.desc("n"), "word").limit(bounds.seeds).toPandas()
    if seeds.empty:
        seeds = frequencies.withColumn("odds", odds).where("toxic > 0 and odds > 0").orderBy(leaning, "word").limit(min(bounds.seeds, 2 * taken[1])).withColumn("n", F.col("toxic")).toPandas()
    common = frequencies.where("clean > 0").orderBy(F.desc(F.col("clean") - 10 * F.col("toxic")), "word").limit(bounds.common).toPandas()
    others = frequencies.where("clean > 0 and toxic = 0").orderBy(F.xxhash64("word"), "word").limit(bounds.others).toPandas()
    first = dict(zip(seeds["word"], seeds["n"].astype(float), strict=True))
    positive = dict(first)
    negative = {w: 1.0 for w in [*common["word"], *others["word"]] if w not in positive}
    if not positive or not negative:
        return constant
    for _ in range(rounds):
        ranked = sorted(positive, key=lambda w: (-positive[w], w))
        marks = [*ranked[: landmarks // 2], *list(negative)[-(landmarks // 2) :]]
        words = [*positive, *negative]
        labels = np.array([True] * len(positive) + [False] * len(negative))
        importance = np.array([min(v, 5.0) for v in positive.values()] + [2.0] * len(negative))
        weights, bias = Landmarks(marks).machine(words, labels, importance)
        best = stored(_strongest(sample, weights, bias, bounds.sentences), "toxicity-best")
        clean = frequencies.select("word", "clean")
        tops = best.where("label = 1 and rank = 0 and value > 0").groupBy("word").agg(F.count("*").alias("n"), F.max("value").alias("value")).join(clean, "word", "left").where(rarely_clean).orderBy(F.desc("n"), F.desc("value"), "word").limit(bounds.strongest).toPandas()
        hard = best.where("label = 0").groupBy("word").agg(F.max("value").alias("value")).orderBy(F.desc("value"), "word").limit(bounds.hard).toPandas()
        positive = first | dict(zip(tops["word"], tops["n"].astype(float), strict=True))
        for w in hard["word"]:
            negative.pop(w, None)
        negative |= {w: 1.0 for w in reversed(list(hard["word"])) if w and w not in positive}
        negative = dict(list(negative.items())[-bounds.negatives :])
    # Strings that decide a document: no more than the sample has different texts, copies being counted.
    top = best.where("rank = 0").groupBy("label", "value").agg(F.count("*").alias("n")).orderBy("label", "value").toPandas()
    slope, offset = calibrate(top["value"].to_numpy(), top["label"].to_numpy(), top["n"].to_numpy(float), stands_for)
    release(sample, frequencies)
    return {"weights": weights, "bias": bias, "slope": slope, "offset": offset}


def calibrate(values, labels, counts, stands_for):
    """Slope and offset of a logistic curve from decisions to probabilities, with smoothed targets.

    Each value is that of `counts` sampled rows, each of which stands for `stands_for[label]` rows.
    """
    rows = counts * np.where(labels == 1, stands_for[1], stands_for[0])
    rows = rows * counts.sum() / rows.sum()
    n1, n0 = max(counts[labels == 1].sum(), 1), max(counts[labels != 1].sum(), 1)
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([values, np.ones(len(values))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (rows * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (rows * (p - target)) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score(df: DataFrame, model: dict, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds the probability of being toxic, and 1 where it is at least 0.5 (else 0).

    Every string of the whole text counts, however long it is. Null and empty texts are scored like a string without letters. Equal
    texts get equal scores. Columns of the two output names are replaced; others are kept.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pandas as pd

        model = sent.value
        scorer = Scorer(model["weights"], model["bias"])
        for texts in series_slices(batches):
            cut = [set(strings(t)) if t else set() for t in texts]
            known = scorer.learn(set().union(*cut)) if cut else {}
            value = np.array([max(map(known.__getitem__, words)) if words else model["bias"] for words in cut], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model["slope"] * value + model["offset"], -700, 700))))

    return df.withColumn(score, iterator_udf(scored, "double")(F.col(text))).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
