"""Texts scored by a hierarchical Pitman-Yor language model.

A word is drawn in the restaurant of its context, the ``order`` words before it (two or one). Contexts of
two words that end in the same word share a parent restaurant, and these share the one of no context, whose
base is uniform. Customers are words, tables carry dishes; every table is a customer of the parent. The
seating is sampled by Gibbs: given the other tables, the number of tables of one dish in one restaurant is drawn
from its conditional (exactly for up to ``EXACT`` customers through generalised Stirling numbers; for more by its
saddle point). Before the draw the dish's own tables leave the restaurants above, and each level is drawn
after the one below, from the customers that it has just sent up. "Other tables" are those of the sweep
before, since all buckets are drawn at once. Predictive probabilities are averaged over the samples.

Words are numbered in the order of their 64-bit hashes: each batch of texts tells the ranges of hashes its distinct
words once, and they answer with the words' places. The state is dealt out by the word before, by ranges of the
numbers: all contexts that end in a word, with their dishes and the parent they share, lie in one bucket, so that
both upper levels are local and their restaurants need no names. Only the restaurant of no context is spread over
the buckets: each tells the ranges of words how many tables it sends up for which word, the ranges add them up, draw
the word's tables, and answer in the same order. No task and no driver sees all words.

Texts are read once. Each task turns them into kept batches of word numbers. A batch asks the
buckets for its distinct (word, context) pairs, all at once and only once: the bucket notes where they are
in its state, and at the end sends their probabilities back, with the counts of the words before: a word is
counted where it is context, the end token where the beginning is. Counts and answers move, texts do not. A text
longer than a batch is scored in parts.

Defined cases: a null text counts as empty, which is the end token alone; a null id counts as the empty
id for the split; rows that repeat are scored and counted as often as they occur; without training rows
all probabilities are one. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from convolens.llm.text import bounded_batches, give_back, remainder, whole
from convolens.scale import keep, keep_parts, release

HELD_OUT = 1
BATCH_TOKENS = 1 << 20
SLICE_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
BUCKETS_A_RANGE = 8
STRENGTH = 1.0
ORDER = 2
EXACT = 64
CELLS = 1 << 18
DRAWS = 1 << 18
BURN_IN = 2
SAMPLES = 2
SEED = 31
# No word holds a space.
START = b" "
END = b""


@contextmanager
def tidy_shuffles(spark):
    """Each table written inside leaves no shuffle files behind; the caller's setting comes back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(step):
    """A step over one group that gives its memory back when it is done."""
    def run(table):
        out = step(table)
        give_back()
        return out
    return run


def table_of(rows, types, names) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


# Arrays as bytes.

def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one compressed value; equal byte places lie together."""
    # One array after the other, so that no second copy of all is held.
    press, out = zstandard.ZstdCompressor(level=1).compressobj(size=sum(12 + a.nbytes for a in arrays)), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        for piece in (a.dtype.str.ljust(4).encode(), len(a).to_bytes(8, "little"), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()):
            out.append(press.compress(piece))
    return b"".join([*out, press.flush()])


def unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        dtype, n = np.dtype(data[at:at + 4].decode().strip()), int.from_bytes(data[at + 4:at + 12], "little")
        size, at = n * dtype.itemsize, at + 12
        planes = np.frombuffer(data, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += size
    return out


def steps(numbers: np.ndarray) -> np.ndarray:
    """Differences of unsigned numbers, modulo their size; sorted hashes need fewer bytes so. ``np.cumsum`` undoes it."""
    return np.diff(numbers, prepend=numbers.dtype.type(0))


def walked(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in as few bytes as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def begins(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def gaps(numbers: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers in as few bytes as they need; ``summed_up`` undoes it."""
    return narrow(np.diff(numbers.astype(np.int64), prepend=0))


def summed_up(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.int64)


def edges(words: int, parts: int) -> np.ndarray:
    """Where each of the equal ranges of word numbers begins."""
    return np.array([words * part // parts for part in range(parts)], np.int64)


# Texts to batches.

def slices(text: bytes):
    """The words of a text, some megabytes of it at a time."""
    at = 0
    while at < len(text):
        to = at + SLICE_BYTES
        while to < len(text) and text[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        yield text[at:to].lower().split()
        at = to


def distinct_pairs(tokens, starts, first, words: int, context_words, train=None):
    """The distinct pairs of a batch, sorted by the word before, the word and the word two before: these three (the last
    is None with one word of context), counts and each token's pair.

    ``first``: the two words before each row part.
    """
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    lengths = np.diff(np.append(starts, len(tokens)))
    one[1:], one[starts] = tokens[:-1], first[:, 1]
    codes = one * np.int64(words) + tokens
    if context_words == 2:
        two[2:], two[starts] = tokens[:-2], first[:, 0]
        two[starts[lengths > 1] + 1] = first[lengths > 1, 1]
        if words >= 1 << 21:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * np.int64(words) + two
    order = np.argsort(codes)
    new = begins(codes[order])
    at = order[new]
    place = np.empty(len(tokens), np.uint32)
    place[order] = np.repeat(np.arange(len(new), dtype=np.uint32), np.diff(np.append(new, len(tokens))))
    counts = None if train is None else np.add.reduceat(train[order], new, dtype=np.int64)
    return one[at], tokens[at], two[at] if context_words == 2 else None, counts, place


def counted_words(tokens, first, marks, words: int) -> np.ndarray:
    """The words whose counts a batch needs, as words before: its own, the beginning for the end token, and contexts.

    ``marks``: the numbers of the beginning and the end.
    """
    asked = np.zeros(words, bool)
    asked[tokens] = True
    asked[first[:, 1]] = True
    asked[marks] = True, False
    return np.flatnonzero(asked)


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Batch:
    def __init__(self):
        self.vocabulary, self.tokens, self.first, self.starts, self.rows = Numbers({START: 0, END: 1}), array("i"), [], [], []

    def add(self, row, words, context):
        """Words of a row; ``context`` are the two words that stand before the first."""
        self.rows.append(row)
        self.starts.append(len(self.tokens))
        number = self.vocabulary.__getitem__
        self.first.append([*map(number, context)])
        self.tokens.extend(map(number, words))

    def close(self) -> tuple[bytes, np.ndarray]:
        """Row parts, tokens as numbers of words, and the words' hashes, sorted."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        order = np.argsort(hashes)
        rank = np.empty(len(hashes), np.uint32)
        rank[order] = np.arange(len(hashes))
        uid, doc, held = zip(*self.rows)
        known = np.array([d is not None for d in doc], np.uint8)
        doc = np.array([d or 0 for d in doc], np.int64)
        return packed(np.array(uid, np.int64), doc, known, np.array(held, np.uint8), np.array(self.starts, np.int64),
                      rank[np.frombuffer(self.tokens, np.int32)], rank[np.array(self.first, np.int32)].ravel(), rank[:2]), hashes[order]


def requested(batch: bytes, words: int, buckets: int, context_words: int):
    """(bucket, request) for each bucket that a batch asks.

    A request holds its words, sorted, and by their numbers: the words before, how many rows each has, a
    row for each word that follows it, how many pairs each has, the pairs' counts, and their words two before.
    """
    _, _, _, held, starts, tokens, first, marks, numbers = unpacked(batch)
    numbers, first = summed_up(numbers), first.reshape(-1, 2)
    train = np.repeat(held == 0, np.diff(np.append(starts, len(tokens))))
    one, word, two, counts, _ = distinct_pairs(tokens, starts, first, len(numbers), context_words, train)
    groups = counted_words(tokens, first, marks, len(numbers))
    bucket, place = np.searchsorted(edges(words, buckets), numbers[groups], "right") - 1, np.empty(len(numbers), np.uint32)
    cuts = np.append(begins(bucket), len(groups))
    parts = np.append(np.searchsorted(one, groups[cuts[:-1]]), len(one))
    for lo, hi, *ends in zip(cuts[:-1], cuts[1:], parts[:-1], parts[1:]):
        group, part = groups[lo:hi], slice(*ends)
        before, follows = one[part], word[part]
        rows = begins(before, follows)
        names = np.unique(np.concatenate([group, follows[rows], *([] if two is None else [two[part]])]))
        place[names] = np.arange(len(names))
        more = [] if two is None else [narrow(place[two[part]])]
        yield int(bucket[lo]), packed(
            gaps(numbers[names]), narrow(place[group]), narrow(np.bincount(np.searchsorted(group, before[rows]), minlength=len(group))),
            narrow(place[follows[rows]]), narrow(np.diff(np.append(rows, len(before)))), narrow(counts[part]), *more)


def batches(docs: DataFrame, id_column: str, text_column: str, ranges: int, batch_tokens: int) -> tuple[DataFrame, int]:
    """Kept rows (batch, bucket, data) of ``Batch.close`` and the words' numbers, with bucket -1; and how many words there are."""
    def run(arrow):
        from pyspark import TaskContext
        task, number, batch = TaskContext.get().partitionId(), 0, Batch()

        def closed():
            data, hashes = batch.close()
            inner = np.array([(part << 64) // ranges for part in range(1, ranges)], np.uint64)
            cuts = [0, *np.searchsorted(hashes, inner), len(hashes)]
            rows = [(-1, data), *((part, packed(steps(hashes[lo:hi]))) for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo)]
            columns = [[(task << 32) + number] * len(rows), *zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))],
                                              names=["batch", "part", "data"])

        for part in arrow:
            for uid, doc, held, text in zip(*(c.to_pylist() for c in part.columns)):
                context = [START, START]
                # The end token closes the last slice.
                for words in (*slices(text), [END]):
                    if not words:
                        continue
                    batch.add((uid, doc, held), words, context)
                    context = [*context, *words[-2:]][-2:]
                    if len(batch.tokens) >= batch_tokens:
                        yield closed()
                        number, batch = number + 1, Batch()
                        give_back()
        if batch.tokens:
            yield closed()
        batch = None
        give_back()

    def numbered(table: pa.Table) -> pa.Table:
        """The words of a range, numbered from 0, as each batch knows them; the first row tells how many."""
        hashes = [walked(unpacked(data.as_buffer())[0]) for data in table["data"]]
        words = np.unique(np.concatenate(hashes))
        rows = ((batch, part, packed(gaps(np.searchsorted(words, h))), None if i else len(words))
                for i, (batch, part, h) in enumerate(zip(table["batch"].to_pylist(), table["part"].to_pylist(), hashes)))
        return table_of(rows, (pa.int64(), pa.int32(), pa.binary(), pa.int64()), ["batch", "part", "data", "words"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_column).cast("long").alias("doc"),
        (remainder(id_column) == HELD_OUT).alias("held"), whole(text_column).cast("binary").alias("text"))
    told = keep(rows.mapInArrow(run, "batch long, part int, data binary"))
    numbers = keep(told.where("part >= 0").groupBy("part").applyInArrow(tidy(numbered), "batch long, part int, data binary, words long"))
    sizes = np.zeros(ranges, np.int64)
    for part, words in numbers.where("words IS NOT NULL").select("part", "words").collect():
        sizes[part] = words
    before = np.cumsum(sizes) - sizes

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["data"]), key=lambda r: r[0])
        words = np.concatenate([before[part] + summed_up(unpacked(data.as_buffer())[0]) for part, data in rows[1:]])
        data = packed(*unpacked(rows[0][1].as_buffer()), gaps(words))
        return table_of([(table["batch"][0].as_py(), -1, data)], (pa.int64(), pa.int32(), pa.binary()), ["batch", "bucket", "data"])

    out = keep(told.where("part = -1").union(numbers.select("batch", "part", "data")).groupBy("batch").applyInArrow(
        tidy(join), "batch long, bucket int, data binary"))
    release(told)
    release(numbers)
    return out, int(sizes.sum())


def requests_of(places: DataFrame, words: int, buckets: int, order: int = ORDER) -> DataFrame:
    """(batch, bucket, data): what each batch asks of the buckets; from the kept batches, so always the same."""
    def run(arrow):
        for part in arrow:
            for number, data in zip(part["batch"], part["data"]):
                rows = [(number.as_py(), b, request) for b, request in requested(data.as_buffer(), words, buckets, order)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["batch", "bucket", "data"])
                del rows
                give_back()

    return places.mapInArrow(run, "batch long, bucket int, data binary")


# Restaurants.

def log_stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logs of generalised Stirling numbers: weights of c customers at t tables, c and t up to ``size``."""
    table = np.full((size + 1, size + 1), -np.inf)
    table[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(size):
            t = np.arange(1, size + 1)
            stay = table[c, 1:] + np.log(np.maximum(c - discount * t, 0.0))
            table[c + 1, 1:] = np.logaddexp(table[c, :-1], stay)
    return table


def sample_tables(customers: np.ndarray, rate: np.ndarray, discount: float, stirling: np.ndarray,
                  rng: np.random.Generator, later=None) -> np.ndarray:
    """Numbers of tables of dishes, given the rate (strength + discount * other tables) * parent's probability.

    ``later(dishes, n)`` is the rate of a table after n others of the dish, as a share of the first one's.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    size = len(stirling) - 1
    seated = np.minimum(customers, size)
    log_rate = np.log(np.maximum(rate, 1e-300))
    order = np.argsort(seated, kind="stable")
    bounds = np.searchsorted(seated[order], np.arange(2, size + 2))
    for c, lo, hi in zip(range(2, size + 1), bounds[:-1], bounds[1:]):
        # A table of dishes by numbers of tables, some megabytes of it at a time.
        height = CELLS // c
        for at in range(lo, hi, height):
            who = order[at:min(hi, at + height)]
            weight = stirling[c, 1:c + 1] + log_rate[who, None] * np.arange(1, c + 1)
            if later is not None:
                weight[:, 1:] += np.cumsum(np.log(later(who, np.arange(1, c))), axis=1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[who] = 1 + (weight < rng.random(len(who))[:, None] * weight[:, -1:]).sum(axis=1)
    many = np.flatnonzero(customers > size)
    if len(many):
        tables[many] = _many_tables(customers[many], rate[many], discount, rng)
    return tables


def _many_tables(customers: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The same for many customers, by the saddle point of the distribution's generating function.

    Tables are a Poisson number of groups whose sizes have the discount as tail index, given that the
    sizes sum to the customers. Tilted so that the sum fits on average, the number of groups is close to
    normal if large; if small, one group holds nearly everybody and the others stay Poisson.
    """
    low, high = np.full(len(rate), -700.0), np.zeros(len(rate))
    for _ in range(60):
        # Find the log of s with rate * (1 - s) * s ** (discount - 1) = customers.
        middle = (low + high) / 2
        above = np.log(rate) + np.log1p(-np.exp(np.minimum(middle, -1e-12))) + (discount - 1) * middle > np.log(customers)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    s = np.exp(low)
    groups = rate / discount * (1 - s ** discount)
    spread = np.sqrt(np.maximum(groups - customers / (1 + (1 - s) * (1 - discount) / s), 0.0))
    drawn = np.where(groups < 30, rng.poisson(np.minimum(groups, 30)), np.rint(groups + spread * rng.standard_normal(len(rate))))
    return np.clip(1 + drawn, 1, customers).astype(np.int64)


class ByKey:
    """Numbers by sorted key, 0 for keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def __getitem__(self, key):
        key = np.asarray(key, np.uint64)
        if not len(self.keys):
            return np.zeros(key.shape)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], 0.0)


class Own:
    """Numbers of a bucket's own restaurants, in their order."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __getitem__(self, key):
        return self.values


class Totals:
    """Customers and tables of restaurants, by key, one level after the other; the last is that of no context."""

    def __init__(self, levels, discounts=(0.5, 0.5, 0.5), types: int = 0):
        self.discounts, self.types = discounts, types
        self.customers = [ByKey(keys, customers) for keys, customers, _ in levels]
        self.tables = [ByKey(keys, tables) for keys, _, tables in levels]

    @classmethod
    def of(cls, state: State, root, discounts, types: int) -> Totals:
        """Of a bucket, whose restaurants are its own but for that of no context, whose totals are given."""
        out = cls([], discounts, types)
        *levels, _ = state.totals()
        levels.append((None, np.array([root[0]]), np.array([root[1]])))
        out.customers, out.tables = [Own(c) for _, c, _ in levels], [Own(t) for _, _, t in levels]
        return out


class State:
    """The words of a bucket: pairs of word and context, sorted, with customers and tables at each level.

    ``others`` are the customers that other buckets send to the restaurant of no context, word by word; ``sampled`` has
    the tables, these and that restaurant's totals of samples before.
    """

    def __init__(self, words, each, context, counts, tables=None, parents=None, order=ORDER):
        """``context`` and ``parents`` are the keys of each pair's restaurant and, with two words of context, of its
        parent (by default its last byte)."""
        word = np.repeat(np.arange(len(words)), each)
        context = np.asarray(context, np.uint64)
        contexts, place = np.unique(context, return_inverse=True)
        keys, at, up = [contexts], [place], []
        if order == 2:
            # One row per word and parent.
            parents, inside = np.unique(context % np.uint64(256) if parents is None else parents, return_inverse=True)
            rows, above = np.unique(word * len(parents) + inside, return_inverse=True)
            keys.append(parents)
            at.append(rows % max(1, len(parents)))
            up.append(above)
            word = rows // max(1, len(parents))
        self._seat(words, counts, keys, at, [*up, word], tables)

    def _seat(self, words, counts, keys, at, up, tables=None, sampled=()):
        # Of each level: the restaurants' keys, a row's place among them, and its row one level up.
        self.words, self.counts, self.others = words, counts, np.zeros(len(words), np.int64)
        self.keys, self.at, self.up = [*keys, np.zeros(1, np.uint64)], [*at, np.zeros(len(words), np.int64)], [*up, None]
        self.sampled = list(sampled)
        # At first each dish has one table.
        self.tables = tables or self.first_tables()

    @classmethod
    def dealt(cls, words, counts, groups, word, row, context, contexts, **more) -> State:
        """Of a bucket of words before: ``groups``, how many rows each has; ``word``, what each row's word is; with two
        words of context ``row``, how many pairs each row has, ``context``, each pair's among those that end in the word
        before, and ``contexts``, how many these are."""
        state = cls.__new__(cls)
        keys, at, up = [np.arange(len(groups))], [np.repeat(np.arange(len(groups)), groups)], [word]
        if row is not None:
            first = (np.cumsum(contexts, dtype=np.int64) - contexts)[at[0]]
            keys, at = [np.arange(int(contexts.sum(dtype=np.int64))), *keys], [np.repeat(first, row) + context, *at]
            up = [np.repeat(np.arange(len(row)), row), *up]
        state._seat(words, counts, keys, at, up, **more)
        state.shape = groups, word, row, context, contexts
        return state

    @property
    def levels(self):
        return range(len(self.keys))

    def first_tables(self):
        out = [np.minimum(self.counts, 1).astype(np.int64)]
        for level in self.levels[1:]:
            out.append(np.minimum(self.received(level, out[-1]), 1).astype(np.int64))
        return out

    def received(self, level, below):
        """Customers of a level: the tables of the level below."""
        own = np.bincount(self.up[level - 1], below, len(self.at[level])).astype(np.int64)
        return own + self.others if level == self.levels[-1] else own

    def customers(self):
        return [self.counts.astype(np.int64), *(self.received(level, self.tables[level - 1]) for level in self.levels[1:])]

    def predictive(self, totals: Totals) -> list[np.ndarray]:
        """Probabilities of the dishes of this bucket at each level."""
        out, customers, base = [], self.customers(), 1 / (totals.types + 1)
        for level in reversed(self.levels):
            d, keys, at = totals.discounts[level], self.keys[level], self.at[level]
            if out:
                base = out[0][self.up[level]]
            here = np.maximum(customers[level] - d * self.tables[level], 0.0)
            out.insert(0, (here + (STRENGTH + d * totals.tables[level][keys][at]) * base) / (STRENGTH + totals.customers[level][keys][at]))
        return out

    def base_without(self, totals: Totals, level: int, customers=None, part=slice(None)):
        """Probabilities at the parent of the dishes of a level (or a part of them), each without the customers its own
        tables sent up, and a function (dishes, n) of the same after n customers more.

        Of a dish with c customers at t tables, t * (rest / c) ** discount tables are taken to stay, at least
        one while a customer stays; the tables that go are customers fewer one level up.
        """
        customers = self.customers() if customers is None else customers
        gone, chain = self.tables[level][part], []
        row = None if self.up[level] is None else self.up[level][part]
        for above in self.levels[level + 1:]:
            d, seated, tables = totals.discounts[above], customers[above][row], self.tables[above][row]
            rest = seated - gone
            stay = np.rint(tables * (rest / np.maximum(seated, 1)) ** d)
            stay = np.clip(stay, np.minimum(rest, 1), np.minimum(rest, tables))
            keys, at = self.keys[above], self.at[above][row]
            chain.append((d, rest, stay, np.maximum(totals.tables[above][keys][at] - (tables - stay), 0),
                          STRENGTH + np.maximum(totals.customers[above][keys][at] - gone, rest)))
            gone = tables - stay
            if above < self.levels[-1]:
                row = self.up[above][row]
        base = np.full(len(self.tables[level][part]), 1 / (totals.types + 1))
        if not chain:
            return base, lambda who, n: base[who, None]
        for d, rest, stay, others, size in reversed(chain):
            over, base = base, (np.maximum(rest - d * stay, 0.0) + (STRENGTH + d * others) * base) / size

        def after(who, n):
            # Customers more join the tables of their dish, of which there is then one at least.
            d, rest, stay, others, size = (a if np.isscalar(a) else a[who, None] for a in chain[0])
            first = stay == 0
            return (np.maximum(rest + n - d * (stay + first), 0.0) + (STRENGTH + d * (others + first)) * over[who, None]) / (size + n)

        return base, after

    def sweep(self, totals: Totals, rng: np.random.Generator, levels=None):
        """Draws the tables of all levels, or of some."""
        for level in self.levels if levels is None else levels:
            d, customers, before = totals.discounts[level], self.customers()[level], self.tables[level]
            known = totals.tables[level][self.keys[level]]
            # What the level below sent up anew may be fewer customers than there were tables.
            self.tables[level] = np.clip(before, np.minimum(customers, 1), customers)
            seated, drawn, stirling = self.customers(), np.minimum(customers, 1), log_stirling(d)
            # A single customer has one table. All others are drawn from the same state, a part of them at a time.
            for at in range(0, len(drawn), DRAWS):
                part = at + np.flatnonzero(customers[at:at + DRAWS] > 1)
                rate = STRENGTH + d * np.maximum(known[self.at[level][part]] - before[part], 0)
                base, after = self.base_without(totals, level, seated, part)

                def later(who, n):
                    return (1 + d * n / rate[who, None]) * after(who, n) / base[who, None]

                drawn[part] = sample_tables(customers[part], rate * base, d, stirling, rng, later)
            self.tables[level] = drawn

    def totals(self):
        """(keys, customers, tables) of the restaurants of each level, as far as this bucket holds them."""
        return [(keys, np.bincount(at, customers, len(keys)).astype(np.int64), np.bincount(at, tables, len(keys)).astype(np.int64))
                for keys, at, customers, tables in zip(self.keys, self.at, self.customers(), self.tables)]

    def data(self) -> bytes:
        """Of a bucket of words before; what other buckets send now is not kept."""
        groups, word, row, context, contexts = self.shape
        more = [] if row is None else [*map(narrow, (row, context, contexts))]
        samples = [a for tables, others, root in self.sampled for a in (*map(narrow, tables), narrow(others), np.array(root))]
        return packed(np.array([len(self.tables)]), gaps(self.words), *map(narrow, (self.counts, groups, word)), *more,
                      *map(narrow, self.tables), *samples)

    @classmethod
    def load(cls, data: bytes) -> State:
        (levels,), words, counts, groups, word, *more = unpacked(data)
        row, context, contexts = (more.pop(0) for _ in range(3)) if levels == 3 else (None, None, None)
        tables, *sampled = (more[at:at + levels + 2] for at in (0, *range(levels, len(more), levels + 2)))
        wide = lambda arrays: [a.astype(np.int64) for a in arrays]
        return cls.dealt(summed_up(words), *wide((counts, groups, word)), row, context, contexts, tables=wide(tables[:levels]),
                         sampled=[(wide(s[:levels]), s[levels].astype(np.int64), tuple(s[levels + 1].tolist())) for s in sampled])

    def summed(self, root, discounts, types: int) -> np.ndarray:
        """Probabilities of the pairs, summed up over the samples before and the current one."""
        now, out = (self.tables, self.others, root), np.zeros(len(self.counts))
        for self.tables, self.others, totals in (*self.sampled, now):
            out += self.predictive(Totals.of(self, totals, discounts, types))[0]
        return out

    def counted(self) -> np.ndarray:
        """Customers who come after each word before."""
        group = self.at[-2] if len(self.up) == 2 else self.at[1][self.up[0]]
        return np.bincount(group, self.counts, len(self.shape[0])).astype(np.int64)


def merged(requests) -> tuple[State, list[tuple[np.ndarray, np.ndarray]]]:
    """The state of a bucket out of all requests to it, and where the pairs and words before of each are in it."""
    parts = [unpacked(r) for r in requests]
    names = np.unique(np.concatenate([summed_up(p[0]) for p in parts]))
    size, rows, groups = np.int64(max(1, len(names))), [], []
    for p in parts:
        p[0] = np.searchsorted(names, summed_up(p[0]))
        groups.append(p[0][p[1]])
        rows.append(np.repeat(groups[-1], p[2]) * size + p[0][p[3]])
    ends = np.cumsum([len(r) for r in rows])[:-1]
    rows, row_of = np.unique(np.concatenate(rows), return_inverse=True)
    counts = np.concatenate([p[5] for p in parts])
    before = np.unique(np.concatenate(groups))
    group_of, word = np.searchsorted(before, rows // size), rows % size
    used, word = np.unique(word, return_inverse=True)
    each = np.bincount(group_of, minlength=len(before))
    if len(parts[0]) == 6:
        place, pairs = row_of.astype(np.uint32), len(rows)
        row = context = contexts = None
    else:
        codes = np.concatenate([np.repeat(at, p[4]) * size + p[0][p[6]] for at, p in zip(np.split(row_of, ends), parts)])
        ends = np.cumsum([len(p[5]) for p in parts])[:-1]
        del parts, row_of
        codes, place = np.unique(codes, return_inverse=True)
        place, pairs = place.astype(np.uint32), len(codes)
        row, two = np.divmod(codes, size)
        del codes
        own, context = np.unique(group_of[row] * size + two, return_inverse=True)
        contexts = np.bincount(own // size, minlength=len(before))
        context = context - (np.cumsum(contexts) - contexts)[group_of[row]]
        row = np.bincount(row, minlength=len(rows))
    counts = np.bincount(place, counts, pairs).astype(np.int64)
    state = State.dealt(names[used], counts, each, word, row, context, contexts)
    return state, list(zip(np.split(place, ends), (np.searchsorted(before, g).astype(np.uint32) for g in groups)))


# Rows of one table: the state of a bucket (part -1), its messages to the ranges of words (part 0 on), and
# at first the places of the pairs that a batch asked for (part -2).
STATE = "bucket int, part int, data binary, tokens long, types long, ones array<long>, twos array<long>, batch long"
STATE_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
STATE_NAMES = [part.split()[0] for part in STATE.split(", ")]
# Answers of a range; the first of them has what the range adds to the restaurant of no context.
ANSWER = "bucket int, part int, data binary, customers long, tables long, ones long, twos long"
ANSWER_TYPES = (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
ANSWER_NAMES = [part.split()[0] for part in ANSWER.split(", ")]


def _state_rows(bucket: int, state: State, starts, asked=()) -> pa.Table:
    """``starts``: where the ranges of words begin; ``asked``: batches and the places of what they asked for."""
    customers = state.customers()
    sent, before = customers.pop() - state.others, state.tables[-1]
    rows = [(bucket, -1, state.data(), int(state.counts.sum()), int((state.counted() > 0).sum()), [int((c == 1).sum()) for c in customers],
             [int((c == 2).sum()) for c in customers], None)]
    bounds = np.append(np.searchsorted(state.words, starts), len(state.words))
    for part, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        if hi > lo:
            message = packed(gaps(state.words[lo:hi]), narrow(sent[lo:hi]), narrow(before[lo:hi]))
            rows.append((bucket, part, message, *[None] * 5))
    rows += [(bucket, -2, packed(*map(steps, places)), *[None] * 4, batch) for batch, places in asked]
    return table_of(rows, STATE_TYPES, STATE_NAMES)


def _root_tables(customers, before, root, discounts, types, rng) -> np.ndarray:
    """Tables of words in the restaurant of no context, given those of the sweep before."""
    d, out, stirling = discounts[-1], np.minimum(customers, 1), log_stirling(discounts[-1])
    for at in range(0, len(out), DRAWS):
        part = at + np.flatnonzero(customers[at:at + DRAWS] > 1)
        rate = STRENGTH + d * np.maximum(root[1] - before[part], 0)
        out[part] = sample_tables(customers[part], rate / (types + 1), d, stirling, rng, lambda who, n: 1 + d * n / rate[who, None])
    return out


def _range_step(number: int, root=None, discounts=None, types: int = 0):
    """The messages to one range, answered by the sums over all buckets and the tables drawn; at first one a word."""
    def step(table: pa.Table) -> pa.Table:
        messages = [unpacked(data.as_buffer()) for data in table["data"]]
        keys = [summed_up(m[0]) for m in messages]
        words = np.unique(np.concatenate(keys))
        places = [np.searchsorted(words, k) for k in keys]
        customers, before = np.zeros((2, len(words)), np.int64)
        for at, (_, sent, tables) in zip(places, messages):
            # The words of a message are distinct.
            customers[at] += sent
            before[at] = tables
        if root is None:
            tables = np.minimum(customers, 1)
        else:
            tables = _root_tables(customers, before, root, discounts, types, np.random.default_rng([SEED, number, table["part"][0].as_py(), 1]))
        sums = [int(n) for n in (customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum())]
        rows = [(bucket, part, packed(narrow(customers[at]), narrow(tables[at])), *(sums if not i else [None] * 4))
                for i, (bucket, part, at) in enumerate(zip(table["bucket"].to_pylist(), table["part"].to_pylist(), places))]
        return table_of(rows, ANSWER_TYPES, ANSWER_NAMES)
    return tidy(step)


def _parted(rows: DataFrame) -> dict[str, DataFrame]:
    """States, messages and places written once, as tables that ``release`` deletes one by one."""
    kinds = F.when(F.col("part") >= 0, F.lit("messages")).when(F.col("part") == -1, F.lit("states")).otherwise(F.lit("places"))
    return keep_parts(rows.withColumn("kind", kinds), "kind", ("states", "messages", "places"))


def _answered(messages: DataFrame, number: int, *model):
    """What the ranges answer, and the customers and tables of the restaurant of no context and its dishes ordered once
    and twice; the messages are deleted."""
    out = keep(messages.select("bucket", "part", "data").groupBy("part").applyInArrow(_range_step(number, *model), ANSWER))
    release(messages)
    root = [n or 0 for n in out.agg(*(F.sum(c) for c in ANSWER_NAMES[3:])).first()]
    return out, root[:2], root[2:]


def _joined(states: DataFrame, answered: DataFrame) -> DataFrame:
    """(bucket, part, data) of the states (part -1) with what the ranges answer."""
    return states.select("bucket", "part", "data").union(answered.select("bucket", "part", "data"))


def _received(table: pa.Table) -> State:
    """A bucket's state out of the rows of ``_joined``."""
    rows = sorted(zip(table["part"].to_pylist(), table["data"]), key=lambda r: r[0])
    state = State.load(rows[0][1].as_buffer())
    if len(rows) > 1:
        customers, tables = (np.concatenate(a).astype(np.int64) for a in zip(*(unpacked(data.as_buffer()) for _, data in rows[1:])))
        state.others, state.tables[-1] = customers - state.customers()[-1], tables
    return state


def _model(states: DataFrame, order: int, root_ones_twos):
    """Discounts, words and tokens known."""
    one = states.agg(*(F.sum(F.col(c)[i]) for c in ("ones", "twos") for i in range(order)), F.sum("types"), F.sum("tokens")).first()
    ones, twos = ([*one[i * order:(i + 1) * order], root_ones_twos[i]] for i in range(2))
    # The usual estimate from dishes ordered once and twice.
    discounts = [min(0.95, max(0.1, (a or 0) / ((a or 0) + 2 * (b or 0)))) if a else 0.5 for a, b in zip(ones, twos)]
    types, tokens = (n or 0 for n in one[2 * order:])
    return discounts, types, tokens


def fit(requests: DataFrame, words: int, parts: int, burn_in: int = BURN_IN, samples: int = SAMPLES, order: int = ORDER):
    """States of all buckets with ``samples - 1`` samples kept and the last one current, what the ranges of words
    answer, the model's numbers, and the places (bucket, batch, data) of what each batch asked for."""
    starts = edges(words, parts)

    def merge(table: pa.Table) -> pa.Table:
        # Buffers of the table itself: a list of bytes would be a second copy.
        state, places = merged([data.as_buffer() for data in table["data"]])
        give_back()
        return _state_rows(table["bucket"][0].as_py(), state, starts, zip(table["batch"].to_pylist(), places))

    first = _parted(requests.groupBy("bucket").applyInArrow(tidy(merge), STATE))
    states, asked = first["states"], first["places"].select("bucket", "batch", "data")
    answered, root, ones_twos = _answered(first["messages"], 0)
    discounts, types, tokens = _model(states, order, ones_twos)

    def sweep(root, number: int):
        def step(table: pa.Table) -> pa.Table:
            bucket = table["bucket"][0].as_py()
            state = _received(table)
            if number >= burn_in:
                state.sampled.append((list(state.tables), state.others, root))
            state.sweep(Totals.of(state, root, discounts, types), np.random.default_rng([SEED, number, bucket]), range(order))
            return _state_rows(bucket, state, starts)
        return tidy(step)

    for number in range(burn_in + samples - 1):
        after = _parted(_joined(states, answered).groupBy("bucket").applyInArrow(sweep(root, number), STATE))
        release(states)
        release(answered)
        states = after["states"]
        answered, root, _ = _answered(after["messages"], number, root, discounts, types)
    return states, answered, root, discounts, types, tokens, asked


def answers(asked: DataFrame, states: DataFrame, totals: DataFrame, root, discounts, types: int, samples: int) -> DataFrame:
    """(batch, bucket, data): for what each batch asked, the averaged probability of its pairs and the counts of the words before."""
    def told(asked, known):
        state = _received(known)
        mean = np.log10(state.summed(root, discounts, types) / samples).astype(np.float32)
        count = state.counted()

        def rows():
            for batch, bucket, data in zip(asked["batch"], asked["bucket"], asked["data"]):
                place, group = map(walked, unpacked(data.as_buffer()))
                yield batch.as_py(), bucket.as_py(), packed(mean[place], narrow(count[group]))

        return table_of(rows(), (pa.int64(), pa.int32(), pa.binary()), ["batch", "bucket", "data"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = told(asked, known)
        give_back()
        return out

    return asked.groupBy("bucket").cogroup(_joined(states, totals).groupBy("bucket")).applyInArrow(
        answer, "batch long, bucket int, data binary")


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", burn_in: int = BURN_IN,
                samples: int = SAMPLES, batch_tokens: int = BATCH_TOKENS, bucket_bytes: int = BUCKET_BYTES,
                order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    size = docs.agg(F.sum(F.octet_length(whole(text_column)))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    with tidy_shuffles(docs.sparkSession):
        ranges = math.ceil(buckets / BUCKETS_A_RANGE)
        places, words = batches(docs, id_column, text_column, ranges, batch_tokens)
        states, totals, root, discounts, types, tokens, asked = fit(
            requests_of(places, words, buckets, order), words, ranges, burn_in, samples, order)
        answered = keep(answers(asked, states, totals, root, discounts, types, samples))
        for table in (states, totals, asked):
            release(table)

    def score(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["bucket"].to_pylist(), table["data"].to_pylist()), key=lambda r: r[0])
        uid, doc, known, held, starts, words, first, marks, numbers = unpacked(rows[0][1])
        first = first.reshape(-1, 2)
        *_, place = distinct_pairs(words, starts, first, len(numbers), order)
        model, told = (np.concatenate(a) for a in zip(*(unpacked(data) for _, data in rows[1:])))
        counts = np.zeros(len(numbers), np.int64)
        counts[counted_words(words, first, marks, len(numbers))] = told
        # Each training text begins and ends once.
        counts[marks[1]] = counts[marks[0]]
        base = np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))
        lengths = np.diff(np.append(starts, len(place)))

        def add(values, at=words):
            return np.add.reduceat(values[at], starts)

        return pa.table({
            "uid": uid, "doc_id": pa.array(doc, mask=known == 0), "held_out": held.astype(bool), "n_tokens": lengths,
            "n_known": add((counts > 0).astype(np.int64)), "base_score": add(base), "score": add(model.astype(float), place)})

    schema = ("uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    together = places.union(answered)
    partial = together.groupBy("batch").applyInArrow(tidy(score), schema)
    return partial.groupBy("uid", "doc_id", "held_out").agg(
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
