"""Similarity join on word n-grams by a token-group matrix: links at a Jaccard similarity, and their components.

A document's tokens are the 64-bit hashes of its distinct runs of five words. Documents of equal sets are one class, so
copies cost nothing. The join is exact on classes:

1. Shared tokens. Tokens are dealt to ranges of hashes; a range finds the tokens of two classes or more. A class whose
   shared tokens are under the required part of its set can't be linked with anything and is done. Within a block of documents,
   a token of several classes is credited at once and sent on only as a marker, so a frequent token costs a block one entry.
2. Groups. In each min-hash bucket the most central class (most of whose tokens are shared) is the pivot. Of the pivots that a class's buckets
   name, it is compared exactly with the one whose sketch is most like its own. If they are linked, the class joins the pivot's group; pivots and
   classes still alone try once more with other hashes. So a group hangs together by links from the start, and nothing within it is compared again.
   Steps to pivots that are merely similar lead to a reference, which several groups share.
3. The matrix has a row for each token and group, for tokens of two groups or more. A class is a query against the other groups.
   Its tokens are ordered, those of its own group alone first, then from few groups to many; the first token that it has in common with
   a linked class lies early in both, by an amount that sizes and places tell, so early tokens give the groups that come into question.
   The class's overlap with a group's token union bounds its overlap with any member from above; only groups where that suffices are opened.
   Within a reference, a group is compared with the root of one that it asks for, linked groups become one, and so on in rounds: groups linked over others are not asked again.
   Of two groups one class is compared with the other's root first, then each class of an opened group with its root, and with some members by a hash; once there is a link, both groups are joined, and no member is looked at.
   The others are compared with those members that share an early token.
4. This is done twice. Among groups of one reference, a class is the difference between its tokens and the reference's: loosely similar
   classes have little in common there, and two linked ones must share a part of their differences, which sizes tell. Between references, it is done with whole sets. Classes of one reference
   needn't be linked, so there a link joins only what links have connected by then, and the rest of both references is compared further.
5. Components of all links, from the smallest key.

A large group of near copies is one column of the matrix, and frequent passages lie late in the order, so neither makes
pairs of all its members. Text is read again rather than token sets stored; only possible members of links are.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import batch_slices, columns, iterator_udf, release, stored

WORDS = 5
#: Links need PART[0] / PART[1] of the union: 75 of 100.
PART = (3, 4)
#: Min-hash buckets of a class in each of the two rounds that look for pivots.
BANDS = 8
#: Bytes whose words are hashed at once, tokens that are sent together, and tokens that a range holds, about.
CHUNK_BYTES = 1 << 20
BLOCK_TOKENS = 1_000_000
RANGE_TOKENS = 3_000_000
LEAST_RANGES = 64
#: Classes of at least this Jaccard similarity to a pivot share its reference.
SIMILAR = (1, 5)
#: Up to so many classes (16 MB) are broadcast to select their texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
MARKER = 0xFFFF
#: About so many members of a cluster are compared with a class, in rounds, before all that share an early token with it are.
TRIED = (16, 64)
#: Rounds in which each group of clusters is compared with one that it asks for, and those that are linked become one.
ROUNDS = 4
#: Tokens of a cluster's union that go together, about.
UNION_TOKENS = 4096

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class Tokens:
    """Token sets of texts. A word's hash is the sum of its bytes' codes times powers, taken from running sums over the text."""

    def __init__(self):
        random = np.random.Generator(np.random.PCG64(5))
        self.codes = random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.codes[65:91] = self.codes[97:123]  # A to Z count as a to z
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        self.space = space
        base = 0x5851F42D4C957F2D
        self.powers, self.inverses = (np.full(CHUNK_BYTES + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        for table in (self.powers, self.inverses):
            table[0] = 1
            np.cumprod(table, out=table)

    def words(self, data: bytes):
        """Hashes of the words of a text; words longer than a chunk are hashed with a digest."""
        out, at = [], 0
        while at < len(data):
            end = at + CHUNK_BYTES
            if end < len(data):  # cut at a space
                cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
                if cut < 0:
                    stops = [k for k in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if k >= 0]
                    stop = min(stops, default=len(data))
                    out.append(np.frombuffer(hashlib.sha256(data[at:stop].lower()).digest()[:8], np.uint64))
                    at = stop
                    continue
                end = cut + 1
            part = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
            inside = ~self.space[part]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            starts, stops = edges[::2], edges[1::2]
            if len(starts):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes[part] * self.powers[: len(part)], dtype=np.uint64)])
                out.append(mixed((sums[stops] - sums[starts]) * self.inverses[starts] + (stops - starts).astype(np.uint64)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def of(self, text: str | None):
        """The sorted distinct tokens of a text."""
        if not text:
            return np.zeros(0, np.uint64)
        words = self.words(text.encode())
        if len(words) >= WORDS:
            n = len(words) - WORDS + 1
            h = words[:n] * np.uint64(_MULTIPLIERS[0])
            for k in range(1, WORDS):
                h += words[k : k + n] * np.uint64(_MULTIPLIERS[k])
            return np.unique(mixed(h))
        h = np.full(1, len(words), np.uint64)
        for k in range(len(words)):
            h = mixed(h + words[k : k + 1] * np.uint64(_MULTIPLIERS[k]))
        return h[: min(1, len(words))]


def class_of(tokens) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _arrays(schema: str, *values):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for (_, k), v in zip(fields, values, strict=True)], [n for n, _ in fields])


def classes_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, class) of every row: the size of its token set, and the set's digest."""
    kind = dict(df.dtypes)[key]

    def named(batches):
        import pyarrow as pa

        tokens = Tokens()
        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            found = [(len(own), class_of(own)) for own in map(tokens.of, columns(batch, "text")[0])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.binary())))], ["key", "n", "class"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(named, f"key {kind}, n long, class binary")


# 1. Shared tokens

SENT = "range int, tokens binary, owners binary, classes binary, credits binary"
CREDIT = "short binary, credit long"
#: Leading bytes of a class that tokens travel with. Should two classes share them, both get the credits of both, and stay.
SHORT = 8


def pack(values) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes):
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _block(sets: dict[bytes, object], ranges: int):
    """The rows that a block of classes sends: for each range its tokens (48 bits besides the range) and who has them; only classes of these tokens go along."""
    names = np.frombuffer(b"".join([c[:SHORT] for c in sets]), f"V{SHORT}")
    tokens = np.concatenate(list(sets.values()))
    owners = np.repeat(np.arange(len(names)), [len(s) for s in sets.values()])
    order = np.argsort(tokens)
    tokens, owners = tokens[order], owners[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    starts = np.flatnonzero(first)
    several = np.diff(np.append(starts, len(tokens))) > 1
    credits = np.bincount(owners[several[np.cumsum(first) - 1]], minlength=len(names)).astype(np.int64)
    tokens, owners = tokens[starts], np.where(several, MARKER, owners[starts])
    to = (tokens % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(ranges + 1))
    for r in range(ranges):
        own = order[cuts[r] : cuts[r + 1]]
        whole = r == 0  # the block's own credits travel once
        if len(own) or whole:
            who = owners[own]
            used = np.arange(len(names)) if whole else np.unique(who[who != MARKER])
            place = np.where(who == MARKER, MARKER, np.searchsorted(used, who)).astype(np.uint16)
            yield r, pack(tokens[own] >> np.uint64(16)), place.tobytes(), names[used].tobytes(), credits.tobytes() if whole else b""


def _meet(table):
    """Of one range: the classes with what is credited to them; a token counts once for each class."""
    classes, values, who, credits = [], [], [], []
    place = 0
    for tokens, owners, names, credit in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "classes", "credits")), strict=True):
        own = np.frombuffer(owners, np.uint16).astype(np.int64)
        values.append(unpack(tokens))
        who.append(np.where(own == MARKER, -1, own + place))
        count = len(names) // SHORT
        classes.append(np.frombuffer(names, f"V{SHORT}"))
        credits.append(np.frombuffer(credit, np.int64) if credit else np.zeros(count, np.int64))
        place += count
    names, alias = np.unique(np.concatenate(classes), return_inverse=True)
    total = np.bincount(alias, np.concatenate(credits), len(names)).astype(np.int64)
    values, who = np.concatenate(values), np.concatenate(who)
    if len(values):
        who = np.where(who < 0, -1, alias[who] if len(alias) else -1)
        order = np.argsort(values)
        values, who = values[order], who[order]
        first = np.concatenate([[True], values[1:] != values[:-1]])
        starts = np.flatnonzero(first)
        low, high = np.minimum.reduceat(who, starts), np.maximum.reduceat(who, starts)
        run = np.cumsum(first) - 1
        hit = ((low != high) | (low < 0))[run] & (who >= 0)
        pairs = np.unique(run[hit] * len(names) + who[hit])
        total += np.bincount(pairs % max(1, len(names)), minlength=len(names))
    told = total > 0
    return [x.tobytes() for x in names[told]], total[told]


def possible(df: DataFrame, text: str, classes: DataFrame) -> DataFrame:
    """(key, class, share) of the classes (class, key, n) with enough shared tokens, and their share.

    The number of all tokens decides the number of ranges. A class that comes in several blocks may be credited more than once, which keeps it, never loses it.
    """
    tokens = classes.agg(F.sum("n")).first()[0] or 0  # one number
    ranges = max(LEAST_RANGES, math.ceil(tokens / RANGE_TOKENS))

    def sent(batches):
        find = Tokens()
        sets, held = {}, 0
        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            for t in columns(batch, "text")[0]:
                own = find.of(t)
                if len(own) and (name := class_of(own)) not in sets:
                    sets[name] = own
                    held += len(own)
                    if held > BLOCK_TOKENS or len(sets) > MARKER - 2:
                        for row in _block(sets, ranges):
                            yield _arrays(SENT, *([x] for x in row))
                        sets, held = {}, 0
        if sets:
            for row in _block(sets, ranges):
                yield _arrays(SENT, *([x] for x in row))

    def met(table):
        import pyarrow as pa

        return pa.Table.from_batches([_arrays(CREDIT, *_meet(table))])

    credited = df.select(F.col(text).alias("text")).mapInArrow(sent, SENT).groupBy("range").applyInArrow(met, CREDIT)
    credited = credited.groupBy("short").agg(F.sum("credit").alias("credit"))
    both = classes.withColumn("short", F.substring("class", 1, SHORT)).join(credited, "short")
    return both.where(F.col("credit") * PART[1] >= F.col("n") * PART[0]).select("key", "class", F.least(F.lit(1.0), F.col("credit") / F.col("n")).alias("share"))


# 2. Groups

MEMBER = "class binary, n long, share double, sketch array<long>, tokens binary"


def members(df: DataFrame, key: str, text: str, chosen: DataFrame) -> DataFrame:
    """(class, n, share, sketch, tokens) of the chosen (key, class, share): the token set, and its smallest hashes under 2 * BANDS mixings."""

    def made(batches):
        find = Tokens()
        salts = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64)
        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            rows = []
            for t, name, share in zip(*columns(batch, "text", "class", "share"), strict=True):
                own = find.of(t)
                if class_of(own) == name:
                    sketch = [int(mixed(own ^ s).min().view(np.int64)) for s in salts]
                    rows.append((name, len(own), share, sketch, own.tobytes()))
            yield _arrays(MEMBER, *([r[k] for r in rows] for k in range(5)))

    chosen = chosen.select(F.col("key").alias("_key"), "class", "share")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, F.col("key").eqNullSafe(F.col("_key"))).select("text", "class", "share")
    return texts.mapInArrow(made, MEMBER)


def overlap():
    """The number of common tokens of two columns of packed token sets."""

    def compared(batches):
        import pandas as pd

        for left, right in batches:
            common = []
            for a, b in zip(left, right, strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common.append(int((b[place] == a).sum()))
            yield pd.Series(common, dtype="int64")

    return iterator_udf(compared, "long", arguments=2)


def at_least(part: tuple[int, int]):
    """Whether `both` common tokens of sets of n_a and n_b are so large a part of the union."""
    return F.col("both") * part[1] >= (F.col("n_a") + F.col("n_b") - F.col("both")) * part[0]


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both) of pairs (a, b) of classes."""
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", overlap()("left", "right").alias("both"))


def pivots(sets: DataFrame, active: DataFrame, first: int) -> DataFrame:
    """(a, b, n_a, n_b, both) of each active class a with the pivot b that is most like it, among those that its buckets from `first` on name.

    A pivot comes before its class in the order of share and class, so steps to pivots go round no circle.
    """
    standing = F.struct((-F.col("share")).alias("s"), "class", "sketch")
    bands = active.select(standing.alias("standing"), F.posexplode(F.slice("sketch", first + 1, BANDS)).alias("band", "value"))
    heads = bands.groupBy("band", "value").agg(F.min("standing").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = stored(heads, "ngram-heads")  # stored, so that the join stands alone in its stage, where Spark can split a frequent bucket
    named = bands.join(heads, ["band", "value"]).where("standing.class <> pivot.class")
    alike = F.aggregate(F.zip_with("standing.sketch", "pivot.sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    best = named.groupBy(F.col("standing.class").alias("a")).agg(F.max(F.struct(alike.alias("alike"), (-F.col("pivot.s")).alias("share"), F.col("pivot.class").alias("b"))).alias("best"))
    return stored(compared(best.select("a", "best.b"), sets), "ngram-pivots")


def roots(steps: DataFrame) -> DataFrame:
    """(class, root) of every class a in steps (a, b), of which each class has one at most and which go round no circle: the end of its chain."""
    known, before = steps.select(F.col("a").alias("class"), F.col("b").alias("root")), None
    while True:
        further = known.select(F.col("class").alias("root"), F.col("root").alias("next"))
        jumped = stored(known.join(further, "root", "left").select("class", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ngram-roots")
        known = jumped.drop("moved")
        if before is not None:
            release(before)
        before = jumped
        if jumped.where("moved").isEmpty():
            return known


# 3. The matrix

TOKENS = "token long, class binary, n long, size long, frame binary, cluster binary"


def spread(sets: DataFrame) -> DataFrame:
    """A row for each token of (class, n, frame, cluster, tokens); `size` is their number."""

    def rows(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in TOKENS.split(", ")]
        for batch in (part for whole in batches for part in batch_slices(whole, "tokens")):
            packed = columns(batch, "tokens")[0]
            sizes = [len(t) // 8 for t in packed]
            take = pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64())
            made = {"token": pa.array(np.frombuffer(b"".join(packed), np.int64)), "size": pa.array(np.repeat(np.array(sizes, np.int64), sizes))}
            made |= {c: batch.column(batch.schema.get_field_index(c)).take(take) for c in ("class", "n", "frame", "cluster")}
            yield pa.RecordBatch.from_arrays([made[n] for n in names], names)

    return sets.select("class", "n", "frame", "cluster", "tokens").mapInArrow(rows, TOKENS)


#: Two classes a and b that share a token at their places in the order can only be linked if 14 * least(size_a - place_a, size_b - place_b) is at least
#: 7 * (size_a + size_b) - (n_a + n_b): if the reach of each is at least the need of the other.
NEED, REACH = "7 * size - n", "7 * size - 14 * place + n"
#: Whether a class of a cell (frame, token) can be linked with any of some classes there, of which the extremes are known.
FITS = f"least <= size and 3 * n <= 4 * longest and 3 * shortest <= 4 * n and {REACH} >= need and reach >= {NEED}"


def clusters_in_cells(small: DataFrame, place: list[str]) -> DataFrame:
    """The clusters of each cell with the extremes of their classes there, and the bin (order of length, need in parts of it) that they fall into."""
    extremes = [F.min("size").alias("least"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.min(F.expr(NEED)).alias("need"), F.max(F.expr(REACH)).alias("reach")]
    order, part = F.floor(F.log("longest") / math.log(4 / 3)).cast("int"), F.floor(16 * F.col("need") / F.col("longest")).cast("int")
    return small.groupBy(*place, F.col("cluster").alias("other")).agg(*extremes).withColumns({"order": order, "part": part})


def askable(large: DataFrame, heads: DataFrame, place: list[str]) -> DataFrame:
    """Classes with the bins of their cells in which one of the clusters may hold something to link with.

    A cell has some hundred bins at most, however many clusters. Tokens that the classes of a cell share, but too few of them, such as those that all but a reference lack,
    make no pairs of classes and clusters.
    """
    bins = heads.groupBy(*place, "order", "part").agg(F.min("least").alias("least"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"), F.min("need").alias("need"), F.max("reach").alias("reach"))
    return large.join(bins, place).where(FITS).select(*large.columns, "order", "part")


def fitting(asking: DataFrame, heads: DataFrame, place: list[str]) -> DataFrame:
    """Classes with the clusters of their cells that may hold something to link with."""
    return asking.join(heads, [*place, "order", "part"]).where(FITS)


def joined() -> Column:
    """The two groups that a class and a cluster belong to, in order."""
    return F.array_sort(F.array("group", "other_group")).alias("joined")


def with_roots(rest: DataFrame, asking: DataFrame, sets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of classes with their cluster's root among the rows (class, other, joined) of `asking`, and the rest whose groups none of them joins; both stored."""
    pairs = asking.select(F.col("class").alias("a"), F.col("other").alias("b"), "joined")
    links = stored(compared(pairs, sets).where(at_least(PART)).select("a", "b"), f"ngram-roots-{name}")
    return links, stored(rest.join(pairs.join(links, ["a", "b"]).select("joined").distinct(), "joined", "left_anti"), f"ngram-rest-{name}")


def one_each(rest: DataFrame) -> DataFrame:
    """A row (class, other, joined) for each pair of groups."""
    return rest.groupBy("joined").agg(F.min(F.struct("class", "other")).alias("one")).select("one.class", "one.other", "joined")


def still_apart(rest: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of `rest`, whose groups that edges (a, b) connect, directly or over others, become one; rows within one group are left out."""
    names = components(edges).select(F.col("node").alias("class"), F.col("component").alias("root"))
    named = rest.withColumnsRenamed({"group": "_one", "other_group": "_two"})
    for new, old in (("group", "_one"), ("other_group", "_two")):
        named = coalesced(named, new, names, of=F.col(old))
    return named.where("group <> other_group").select(*rest.columns)


def contracted(asked: DataFrame, sets: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Links (a, b) of classes with their cluster's root among (class, other, group, other_group, cells), and the rows whose groups these don't connect; all stored.

    A group first asks the one with which it shares most cells, later any; in the end, each of two groups that are still apart is compared once with the other.
    So groups that are all linked with each other cost about a pair each, not all their pairs.
    """
    found, rest = [], asked
    for k in range(ROUNDS + 1):
        if rest.isEmpty():
            break
        turn = (F.col("cells") if k == 0 else F.xxhash64(F.lit(k), "class", "other")).alias("turn")
        best = rest.groupBy("group" if k < ROUNDS else joined()).agg(F.max(F.struct(turn, "class", "other", "group", "other_group")).alias("best"))
        pairs = stored(best.select(F.col("best.class").alias("a"), F.col("best.other").alias("b"), F.col("best.group").alias("one"), F.col("best.other_group").alias("two")), f"ngram-turn-{name}")
        links = stored(compared(pairs, sets).where(at_least(PART)).select("a", "b"), f"ngram-roots-{name}")
        if not links.isEmpty():
            found.append(links)
            edges = pairs.join(links, ["a", "b"]).select(F.col("one").alias("a"), F.col("two").alias("b"))
            left = stored(still_apart(rest, edges), f"ngram-apart-{name}")
            release(rest)
            rest = left
        release(pairs)
    return found, rest


def bounded(asked: DataFrame, matrix: DataFrame, place: list[str]) -> DataFrame:
    """Adds `both`, the number of a class's tokens that are in the union of a cluster, to (frame, class, other). A union comes in parts, of which each gives a row."""
    held = F.collect_list("token")
    own = matrix.join(asked.select("class").distinct(), "class", "left_semi").groupBy("class").agg(held.alias("own"))
    union = matrix.select(*place, F.col("cluster").alias("other")).join(asked.select("frame", "other").distinct(), ["frame", "other"], "left_semi").distinct()
    parts = union.groupBy("frame", "other").agg(F.ceil(F.count("*") / UNION_TOKENS).alias("parts"))
    dealt = union.join(parts, ["frame", "other"]).groupBy("frame", "other", F.pmod(F.xxhash64("token"), "parts").alias("part")).agg(held.alias("union"))
    rows = asked.join(own, "class").join(dealt, ["frame", "other"]).select(*asked.columns, F.size(F.array_intersect("own", "union")).alias("both"))
    return rows.groupBy(*asked.columns).agg(F.sum("both").alias("both"))


def tried(rest: DataFrame, members: DataFrame, sets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the classes with their clusters' members in (class, other, n_a, size_a, joined) and (other, b, n_b, size_b), and the rest whose groups none of them joins; both stored."""
    possible = "class <> b and 3 * n_a <= 4 * n_b and 3 * n_b <= 4 * n_a and 14 * least(size_a, size_b) >= 7 * (size_a + size_b) - (n_a + n_b)"
    pairs = stored(rest.join(members, "other").where(possible).select(F.col("class").alias("a"), "b", "joined"), f"ngram-tried-{name}")
    links = stored(compared(pairs.select("a", "b").distinct(), sets).where(at_least(PART)).select("a", "b"), f"ngram-links-{name}")
    left = stored(rest.join(pairs.join(links, ["a", "b"]).select("joined").distinct(), "joined", "left_anti"), f"ngram-rest-{name}")
    release(pairs)
    return links, left


def parts_of(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(class, cluster, part, group) of (class, cluster): the group that links have connected, from (class, root), and the part of the cluster in it, named by its first class."""
    grouped = coalesced(classes.select("class", "cluster"), "group", groups, of=F.col("class"))
    return grouped.join(grouped.groupBy("cluster", "group").agg(F.min("class").alias("part")), ["cluster", "group"])


def between_clusters(tokens: DataFrame, sets: DataFrame, early: int, name: str, links: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect all clusters of a frame with linked classes in them, from (frame, token, class, n, size, cluster).

    A class has `size` tokens, in one frame and one cluster, named by its root. Two classes of different clusters can only be linked
    if they share (7 * (size_a + size_b) - (n_a + n_b)) / 14 tokens. For the larger a, that is size_a - n_a / early at least; for the smaller b,
    size_b - n_b / (early + 3): `early` is 3, or 4 where the size is n.

    Classes of a cluster are connected by links, so that one link joins two clusters. Where they needn't be, `links` (a, b) are those known: opened clusters are then
    taken apart into what these connect.
    """
    place, own = ["frame", "token"], Window.partitionBy("class")
    names = [F.xxhash64("cluster"), F.xxhash64(F.lit(1), "cluster")]  # 128 bits, as hash aggregation has no extremes of binary values
    ends = [f(h).alias(f"{end}{k}") for k, h in enumerate(names) for end, f in (("low", F.min), ("high", F.max))]
    crossing = tokens.groupBy(*place).agg(*ends).where("low0 <> high0 or low1 <> high1").select(*place)
    matrix = stored(tokens.join(crossing, place), f"ngram-matrix-{name}")  # a row for each class; its clusters are the matrix's columns
    frequency = matrix.select(*place, "cluster").distinct().groupBy(*place).agg(F.count("*").alias("frequency"))
    ordered = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("frequency", "token")) - 1
    large = stored(matrix.join(frequency, place).withColumn("place", ordered).where(f"{early} * place <= n").drop("frequency"), f"ngram-early-{name}")
    small = large.where(f"{early + 3} * place <= n")

    heads = clusters_in_cells(small, place)
    query = ["frame", "class", "n", "size", "cluster", "other"]
    asked = fitting(askable(large, heads, place), heads, place).where("cluster <> other").groupBy(*query)
    asked = stored(asked.agg(F.min(F.expr("7 * size - n + need")).alias("needed"), F.count("*").alias("cells")).withColumns({"group": F.col("cluster"), "other_group": F.col("other")}), f"ngram-asked-{name}")
    found = []
    if links is None:  # clusters that links with roots connect, directly or over others, need no more
        found, asked = contracted(asked, sets, name)
    bound = bounded(asked.drop("cells"), matrix, place)
    opened = stored(bound.where(f"{early} * both >= {early} * size - n and 14 * both >= needed").drop("both", "needed"), f"ngram-opened-{name}")
    release(asked)
    if opened.isEmpty():
        release(matrix, large)
        return reduce(DataFrame.unionByName, found, opened.select(F.col("class").alias("a"), F.col("other").alias("b")))

    classes = matrix.select("class", "n", "size", "cluster").distinct()
    if links is None:
        members, within = classes.withColumn("other", F.col("cluster")), small.withColumn("other", F.col("cluster"))
        rest = opened.select("class", "n", "size", "other", "group", "other_group")
    else:
        groups = components(links).select(F.col("node").alias("class"), F.col("component").alias("root"))
        parts = stored(parts_of(classes, groups), f"ngram-parts-{name}")
        members = classes.drop("cluster").join(parts.select("class", F.col("part").alias("other")), "class")
        within = small.join(parts.select("class", F.col("part").alias("other")), "class")
        of_part = parts.select(F.col("part").alias("other"), F.col("cluster").alias("opened"), F.col("group").alias("other_group")).distinct()
        part_heads = clusters_in_cells(within.withColumn("cluster", F.col("other")), place).drop("order", "part").join(of_part, "other")
        asking = large.join(opened.select("class", F.col("other").alias("opened")), "class").join(parts.select("class", "group"), "class")
        rest = asking.join(part_heads, [*place, "opened"]).where(FITS).where("group <> other_group").select("class", "n", "size", "other", "group", "other_group").distinct()
    rest = stored(rest.select("class", "other", F.col("n").alias("n_a"), F.col("size").alias("size_a"), joined()), f"ngram-asking-{name}")

    for asking in (one_each, lambda every: every):
        some, rest = with_roots(rest, asking(rest), sets, name)
        found.append(some)
    several = members.join(members.groupBy("other").agg(F.count("*").alias("members")), "other")
    of_other = several.select("other", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"), F.pmod(F.xxhash64("class"), "members").alias("turn"), "members")
    of_other = of_other.join(rest.select("other").distinct(), "other", "left_semi")
    for low, high in zip((0, *TRIED), TRIED, strict=False):
        if rest.isEmpty():
            break
        some, rest = tried(rest, of_other.where(f"turn >= {low} and turn < {high}"), sets, name)
        found.append(some)
    if not rest.isEmpty():
        rest = rest.join(of_other.where(f"members > {TRIED[-1]}"), "other", "left_semi")  # of smaller clusters, all have been compared
        values = ("class", "n", "size", "place")
        left = large.join(rest.select("class", "other"), "class").select(*place, "other", *[F.col(c).alias(f"{c}_a") for c in values])
        right = within.select(*place, "other", *[F.col(c).alias(f"{c}_b") for c in values])
        fits = (
            "(size_a > size_b or size_a = size_b and class_a > class_b) and 3 * n_a <= 4 * n_b and 3 * n_b <= 4 * n_a"
            " and 14 * least(size_a - place_a, size_b - place_b) >= 7 * (size_a + size_b) - (n_a + n_b)"
        )
        pairs = left.join(right, [*place, "other"]).where(fits).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
        found.append(stored(compared(pairs, sets).where(at_least(PART)).select("a", "b"), f"ngram-members-{name}"))
    release(matrix, large, opened)
    return reduce(DataFrame.unionByName, found)


# 4. Differences from a reference

DIFFERENCE = "class binary, n long, frame binary, close boolean, tokens binary"


def differences(sets: DataFrame, references: DataFrame) -> DataFrame:
    """(class, n, frame, close, tokens) of the classes in (class, root): the tokens that only they or only their reference have, and whether they are linked to it."""

    def differing(batches):
        for batch in (part for whole in batches for part in batch_slices(whole, "tokens", "reference")):
            rows = []
            for name, n, frame, own, reference in zip(*columns(batch, "class", "n", "frame", "tokens", "reference"), strict=True):
                reference = np.frombuffer(reference, np.uint64)
                apart = np.setxor1d(np.frombuffer(own, np.uint64), reference, assume_unique=True)
                rows.append((name, n, frame, 7 * len(apart) <= n + len(reference), apart.tobytes()))
            yield _arrays(DIFFERENCE, *([r[k] for r in rows] for k in range(5)))

    reference = sets.select(F.col("class").alias("frame"), F.col("tokens").alias("reference"))
    rows = sets.join(references.withColumnRenamed("root", "frame"), "class").join(reference, "frame").select("class", "n", "frame", "tokens", "reference")
    return stored(rows.mapInArrow(differing, DIFFERENCE), "ngram-differences")


def coalesced(df: DataFrame, column: str, names: DataFrame, *, of: Column) -> DataFrame:
    """Adds `column`: the root of the class `of` in names (class, root), or else that class itself."""
    return df.withColumn("_of", of).join(names.select(F.col("class").alias("_of"), F.col("root").alias(column)), "_of", "left").withColumn(column, F.coalesce(column, "_of")).drop("_of")


def links_of(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked classes of (class, n, share, sketch, tokens)."""
    sketches = sets.select("class", "share", "sketch")
    near = pivots(sets, sketches, 0)
    linked = near.where(at_least(PART)).select("a", "b")
    again = pivots(sets, sketches.join(linked, F.col("class") == F.col("a"), "left_anti"), BANDS)
    linked = linked.unionByName(again.where(at_least(PART)).select("a", "b"))
    clusters = roots(linked)
    references = roots(near.where(at_least(SIMILAR)))

    apart = differences(sets, references)
    close = apart.where("close").select("class", "frame")
    # A cluster whose root is linked to the reference is the reference's, and so is a class that is itself.
    settled = coalesced(apart, "cluster", clusters, of=F.col("class"))
    root_close = close.select(F.col("class").alias("cluster"), "frame", F.lit(True).alias("root_close"))
    settled = coalesced(settled.join(root_close, ["cluster", "frame"], "left"), "home", clusters, of=F.col("frame"))
    settled = settled.withColumn("cluster", F.when(F.col("close") | F.col("root_close"), F.col("home")).otherwise(F.col("cluster")))
    among = between_clusters(spread(settled), sets, 3, "among")
    with_reference = close.select(F.col("class").alias("a"), F.col("frame").alias("b"))
    known = linked.unionByName(with_reference).unionByName(among)

    whole = coalesced(sets.select("class", "n", "tokens"), "cluster", references, of=F.col("class")).withColumn("frame", F.lit(b""))
    return known.unionByName(between_clusters(spread(whole), sets, 4, "beyond", known))


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, n, class) of every row, and links (a, b) between classes that connect all that are linked.

    Classes of similar sets are connected through links, which are not all pairs of a group. Rows without words (null, empty) have n = 0 and no
    links. Rows with equal keys stay apart.
    """
    rows = stored(classes_of(df, key, text), "ngram-classes")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    chosen = stored(possible(df, text, classes), "ngram-possible")
    sets = stored(members(df, key, text, chosen).dropDuplicates(["class"]), "ngram-sets")
    return rows, links_of(sets)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_shingles", component: str = "component_id") -> DataFrame:
    """One row for each input row: key, number of distinct shingles, and the smallest key that links lead to, itself included.

    A shingle is five words; a text of fewer words is one shingle; one without words (null, empty) has none and is only linked to itself.
    Words are runs of characters other than ASCII spaces, A-Z lower-cased. Equal sets are linked. Rows with equal keys give a row each; null keys
    are never the smallest, unless there is no other. Only the two columns named are read.
    """
    rows, links = join(df, key, text)
    labels = components(links)
    classes = rows.where("n > 0").groupBy("class").agg(F.min("key").alias("least"))
    labelled = classes.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("least"))
    of_class = labelled.drop("least").join(least, "component").select("class", "least")
    found = rows.where("n > 0").join(of_class, "class").select("key", "n", "least")
    alone = rows.where("n = 0").select("key", "n", F.col("key").alias("least"))  # one class, of any number of rows
    return found.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias(size), F.col("least").alias(component))
