import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from convolens import scale
from convolens.llm import pitman_yor as py
from convolens.llm.queries import QUERIES


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def slow_base(docs):
    counts = Counter(t for d, text in docs if not held(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text in docs:
        found = tokens(text)
        out.append((doc, held(doc), len(found), sum(counts[t] > 0 for t in found), n,
                    sum(math.log10((counts[t] + .5) / (n + .5 * (v + 1))) for t in found)))
    return out


def check(docs, got):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    mine = sorted(([r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in got), key=order)
    slow = sorted(slow_base(docs), key=order)
    assert len(mine) == len(slow)
    for a, b in zip(mine, slow):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)


def test_arrays_round_trip():
    arrays = [np.arange(5, dtype=np.uint16), np.empty(0, np.int64), np.array([1.5, -2]), np.array([1, 2], np.uint8)]
    for a, b in zip(arrays, py.unpacked(py.packed(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()


def seatings(customers):
    """All partitions of the customers."""
    if not customers:
        yield []
        return
    for rest in seatings(customers[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [customers[0], *rest[i]], *rest[i + 1:]]
        yield [[customers[0]], *rest]


def test_table_counts_have_their_conditional():
    """Against the sum over all seatings of five customers of a dish."""
    d, rate = 0.6, 1.7
    weight = np.zeros(6)
    for seating in seatings(list(range(5))):
        weight[len(seating)] += rate ** len(seating) * math.prod(
            math.prod(k - d for k in range(1, len(table))) for table in seating)
    drawn = py.sample_tables(np.full(200_000, 5), np.full(200_000, rate), d, py.log_stirling(d), np.random.default_rng(1))
    assert np.allclose(np.bincount(drawn, minlength=6) / 200_000, weight / weight.sum(), atol=0.005)


@pytest.mark.parametrize("rate", [0.05, 3.0, 30.0, 200.0, 3000.0])
def test_many_customers_come_close_to_the_conditional(rate):
    d, n = 0.7, 4000
    c = np.full(n, 400)
    near = py.sample_tables(c, np.full(n, rate), d, py.log_stirling(d, 64), np.random.default_rng(1))
    exact = py.sample_tables(c, np.full(n, rate), d, py.log_stirling(d, 400), np.random.default_rng(2))
    assert near.mean() == pytest.approx(exact.mean(), rel=0.05, abs=0.2)
    assert near.std() == pytest.approx(exact.std(), rel=0.35, abs=0.3)


def test_predictive_sums_to_one():
    """Over all words and the unknown one, in every context."""
    r = np.random.default_rng(3)
    words, context = np.divmod(np.unique(r.integers(0, 30 * 40, 500)), 40)
    every = np.array(list(itertools.product(range(30), range(40))))
    counts = np.zeros(len(every), np.int64)
    counts[words * 40 + context] = r.integers(1, 200, len(words))
    state = py.State(np.arange(30, dtype=np.uint64), np.full(30, 40), (every[:, 1] + 256 * (every[:, 1] % 3)).astype(np.uint16), counts)
    totals = py.Totals(state.totals(), (.7, .6, .5), 30)
    for number in range(4):
        state.sweep(totals, np.random.default_rng(number))
        totals = py.Totals(state.totals(), (.7, .6, .5), 30)
        p = state.predictive(totals)[0]
        sums = np.bincount(every[:, 1], p)
        unknown = []
        for at in range(40):
            chain = [(0, at + 256 * (at % 3)), (1, at % 256), (2, 0)]
            value = 1 / 31
            for level, place in reversed(chain):
                value *= (py.STRENGTH + totals.discounts[level] * totals.tables[level][place]) / (py.STRENGTH + totals.customers[level][place])
            unknown.append(value)
        assert np.allclose(sums + unknown, 1)


def rows(n):
    r = random.Random(6)
    follow = {a: [f"{r.choice('xyz')}{r.randrange(30)}{e}" for e in ("an", "be", "ci")] for a in ("an", "be", "ci")}
    out = []
    for i in range(n):
        words, last = [], "an"
        for _ in range(r.randrange(60)):
            words.append(r.choice(follow[last]))
            last = words[-1][-2:]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("batch,bucket", [(1 << 22, 32 << 20), (50, 700)])
def test_scores(spark, batch, bucket, monkeypatch):
    monkeypatch.setattr(py, "SLICE_BYTES", 64)
    docs = rows(300) + [(900, None), (901, ""), (None, "A b  C\td"), (902, "one two three"), (902, "one two three"),
                        (903, "Never-seen words É"), (904, "x " * 3000)]
    frame = spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, bucket string").repartition(3)
    got = py.score_texts(frame, batch_tokens=batch, bucket_bytes=bucket).collect()
    check(docs, got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 1.1 * sum(r.base_score for r in out) and len({r.score for r in got if r.doc_id == 902}) == 1


def test_word_history_counts(spark):
    """Words of equal endings that only the words before tell apart, one and two words back."""
    r, docs = random.Random(8), []
    for i in range(400):
        # a?e -> x?z by the word before; after 'same' by the word two before.
        docs.append((i, " ".join(w for _ in range(20) for w in r.choice(
            ["able red1z", "cable blue1z", "north same up1z", "south same down1z"]).split())))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for batch, bucket in ((1 << 22, 32 << 20), (200, 900)):
        got = [x for x in py.score_texts(frame, batch_tokens=batch, bucket_bytes=bucket).collect() if x.held_out]
        # Of about 2.5 words a phrase, only the choice of the phrase (two bits) is open.
        assert 10 ** (-sum(x.score for x in got) / sum(x.n_tokens for x in got)) < 2.0


class Seats:
    """The same model customer by customer, at tables of their own, in plain Python."""

    def __init__(self, texts, order, rng):
        self.order, self.rng, self.rooms = order, rng, {}
        self.drawn = [(w, tuple(before)) for t in texts for w, before in self.read(t)]
        self.types = len({w for w, _ in self.drawn})
        # Discounts as the model sets them, from one table a dish.
        self.discounts = []
        level = Counter(self.drawn)
        for _ in range(order + 1):
            one, two = (sum(c == n for c in level.values()) for n in (1, 2))
            self.discounts.insert(0, min(.95, max(.1, one / (one + 2 * two))) if one else .5)
            level = Counter((w, before[1:]) for w, before in level)
        for w, before in self.drawn:
            self.sit(w, before)

    def read(self, text):
        words = [py.START] * self.order + tokens(text)
        return [(words[i], words[i - self.order:i]) for i in range(self.order, len(words))]

    def room(self, before):
        return self.rooms.setdefault(before, {})

    def probability(self, w, before):
        base = self.probability(w, before[1:]) if before else 1 / (self.types + 1)
        room, d = self.room(before), self.discounts[len(before)]
        customers, tables = sum(map(sum, room.values())), sum(map(len, room.values()))
        here = room.get(w, [])
        return (sum(here) - d * len(here) + (py.STRENGTH + d * tables) * base) / (py.STRENGTH + customers)

    def sit(self, w, before):
        room, d = self.room(before), self.discounts[len(before)]
        base = self.probability(w, before[1:]) if before else 1 / (self.types + 1)
        here = room.setdefault(w, [])
        share = [*(n - d for n in here), (py.STRENGTH + d * sum(map(len, room.values()))) * base]
        at = self.rng.choices(range(len(share)), share)[0]
        if at < len(here):
            here[at] += 1
            return
        here.append(1)
        if before:
            self.sit(w, before[1:])

    def leave(self, w, before):
        here = self.room(before)[w]
        at = self.rng.choices(range(len(here)), here)[0]
        here[at] -= 1
        if not here[at]:
            del here[at]
            if before:
                self.leave(w, before[1:])

    def sweep(self):
        for w, before in self.drawn:
            self.leave(w, before)
            self.sit(w, before)


@pytest.mark.parametrize("order", [1, 2])
def test_scores_come_close_to_a_sampler_of_single_customers(spark, order):
    r, docs = random.Random(4), []
    for i in range(90):
        words = ["w0"]
        for _ in range(r.randrange(4, 14)):
            words.append(f"w{int(r.paretovariate(.8)) % 25}" if r.random() < .5 else f"w{(int(words[-1][1:]) * 3 + 1) % 25}")
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    mine = {x.doc_id: x.score for x in py.score_texts(frame, burn_in=15, samples=25, order=order).collect()}
    seats, mean = Seats([t for d, t in docs if not held(d)], order, random.Random(5)), Counter()
    for number in range(60):
        seats.sweep()
        if number >= 20:
            for d, text in docs:
                for at, (w, before) in enumerate(seats.read(text)):
                    mean[d, at] += seats.probability(w, tuple(before)) / 40
    slow = Counter()
    for (d, _), p in mean.items():
        slow[d] += math.log10(p)
    assert sum(mine.values()) == pytest.approx(sum(slow.values()), rel=0.02)
    out = [d for d, _ in docs if held(d)]
    assert sum(mine[d] for d in out) == pytest.approx(sum(slow[d] for d in out), rel=0.02)
    for d in slow:
        assert mine[d] == pytest.approx(slow[d], rel=0.08, abs=0.2)


def test_settings_come_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    py.score_texts(spark.createDataFrame([(2, "a b")], "doc_id long, text string")).collect()
    assert spark.conf.get(name) == before


def test_empty_and_no_training(spark):
    frame = spark.createDataFrame([(d, "a b") for d in range(60) if held(d)], "doc_id long, text string")
    got = py.score_texts(frame).collect()
    assert got and all(r.train_tokens == 0 and r.score == pytest.approx(0) for r in got)
    assert py.score_texts(frame.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op6_language_model"][0](spark, folder).collect()
    check(docs, got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_query_reads_two_words_of_context(spark, tmp_path):
    r, docs = random.Random(8), []
    for i in range(300):
        docs.append((i, " ".join(w for _ in range(20) for w in r.choice(["north same up", "south same down"]).split())))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [x for x in QUERIES["op6_language_model"][0](spark, str(tmp_path)).collect() if x.held_out]
    # One bit a phrase of three words; with one word of context the last one is open as well, two bits.
    assert 10 ** (-sum(x.score for x in got) / sum(x.n_tokens for x in got)) < 1.4


def test_each_table_goes_after_its_last_reader(spark, monkeypatch):
    """When a sweep begins, its messages are answered and deleted; the places stay, in one copy, until the answers are written."""
    folder = lambda: os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    scale.ensure_checkpoint_dir(spark)
    before, seen, real = set(folder()), [], py.keep_parts

    def kinds():
        root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return sorted(k for f in set(folder()) - before for k in os.listdir(f"{root}/{f}") if k.startswith("kind="))

    def keep_parts(*args):
        seen.append(kinds())
        return real(*args)

    monkeypatch.setattr(py, "keep_parts", keep_parts)
    got = py.score_texts(spark.createDataFrame(rows(60), "doc_id long, text string").repartition(2), bucket_bytes=700)
    assert seen == [[]] + 3 * [["kind=places", "kind=states"]] and kinds() == []
    check(rows(60), got.collect())


def test_single_customers_are_not_drawn(monkeypatch):
    """Most pairs occur once: they have one table whatever the draw."""
    drawn, real = [], py.sample_tables
    monkeypatch.setattr(py, "sample_tables", lambda customers, *rest: drawn.extend(customers) or real(customers, *rest))
    state = py.State(np.arange(3, dtype=np.uint64), np.array([2, 1, 1]), np.array([1, 2, 1, 3], np.uint16), np.array([1, 5, 0, 1]), order=1)
    state.sweep(py.Totals(state.totals(), (.7, .6), 3), np.random.default_rng(1))
    assert min(drawn) > 1 and state.tables[0][[0, 2, 3]].tolist() == [1, 0, 1] and 1 <= state.tables[0][1] <= 5


def test_words_are_exchanged_and_no_contexts(spark, monkeypatch):
    """A sweep sends the words of a bucket on, of which there are far fewer than contexts of two words."""
    r, told, real = random.Random(9), [], py.keep_parts
    docs = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(50))) for i in range(80)]

    def keep_parts(*args):
        out = real(*args)
        told.append([bytes(x.data) for x in out["messages"].collect()])
        return out

    monkeypatch.setattr(py, "keep_parts", keep_parts)
    got = py.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    assert len(told) == 4
    for messages in told:
        assert sum(len(py.unpacked(m)[0]) for m in messages) <= 41
    check(docs, got.collect())


@pytest.mark.parametrize("order", [1, 2])
def test_buckets_count_all_pairs_once(order):
    """Batches that cut texts, dealt to several buckets, against plain counting; requests name words by number."""
    r = random.Random(10)
    texts = [[b"w%d" % int(r.paretovariate(.5) % 5000) for _ in range(r.randrange(1, 90))] for _ in range(200)]
    slow, cut, batch = Counter(), [], py.Batch()
    for i, words in enumerate(texts):
        words, context = [*words, py.END], [py.START, py.START]
        for at in range(0, len(words), 60):
            batch.add((i, i, i % 5 == 1), words[at:at + 60], context)
            context = [*context, *words[at:at + 60]][-2:]
            if len(batch.tokens) > 900:
                cut.append(batch)
                batch = py.Batch()
        before = [py.START, py.START, *words]
        for j in range(len(words)):
            slow[tuple(before[j + 2 - order:j + 3])] += i % 5 != 1
    cut.append(batch)
    every = np.unique(np.concatenate([b.close()[1] for b in cut]))
    name = {int(np.searchsorted(every, np.uint64(py.xxhash.xxh64_intdigest(w, py.SEED)))): w for b in cut for w in b.vocabulary}
    asked = {}
    for batch in cut:
        data, hashes = batch.close()
        whole = py.packed(*py.unpacked(data), py.gaps(np.searchsorted(every, hashes)))
        for bucket, request in py.requested(whole, len(every), 7, order):
            asked.setdefault(bucket, []).append(request)
    found, words = Counter(), Counter()
    for requests in asked.values():
        state, places = py.merged(requests)
        assert [len(py.unpacked(q)[5]) for q in requests] == [len(p) for p, _ in places]
        state.sampled.append((list(state.tables), state.others, (5, 4)))
        again = py.State.load(state.data())
        assert all((a == b).all() for a, b in zip(state.up[:-1] + state.at, again.up[:-1] + again.at))
        assert again.sampled[0][2] == (5, 4) and (again.counts == state.counts).all()
        # Each pair's words: the last one, and by the groups the one before.
        row = state.up[0] if order == 2 else np.arange(len(state.counts))
        for c, w in zip(state.counts, state.words[state.up[-2][row]]):
            found[name[int(w)]] += int(c)
        words.update(map(int, state.counts))
    assert words == Counter(slow.values())
    ends = Counter()
    for pair, n in slow.items():
        ends[pair[-1]] += n
    assert +found == +ends
