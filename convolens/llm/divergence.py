"""How far the sources of a language differ in their vocabulary, with late string materialization.

Terms are runs of letters beyond ASCII and of ASCII letters in lower case. Counting moves fixed-width
digests only: tasks count (lang, source, digest) and documents per digest, and never send a string. Of
the digests in enough documents of a language, a second reading fetches the least and the greatest
string; where the two differ, different terms share the digest, which is then split: its terms are
counted by their text, each is judged by its own documents, and gets a number of its own within the
digest. From there on (digest, number) stands for the term; text joins the rows whose value reaches the
ranks asked for, and ties are ordered by it.

With V kept terms of a language, a source that counts c occurrences of a term and N of all kept ones gives it
p = 1 + floor(10^9 (c + 2) / (N + 2V)), and two such numbers differ by floor((p - q)^2 / (p + q)). A
pair of sources sums this over all kept terms. Terms that only one of them has depend on their count
alone and on what the other gives to absent terms, so they are summed by histograms of counts; only
terms that both have are joined. All arithmetic is in whole numbers.

Defined cases: a null text, lang or source counts as ''. Repeated rows are documents each. A group
without kept terms takes part in pairs, with value 0 where its language keeps no term. Extra columns are
ignored, whole texts are read however long, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from convolens.llm.text import bounded_batches, give_back, pieces, whole
from convolens.scale import broadcast_if_small, keep

# Bytes of terms, A-Z as a-z; the others as a space.
LETTERS = np.array([b if b > 0x7F or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)], np.uint8)
HELD_ROWS = 1 << 20
HELD_TERMS = 1 << 17
MIN_DOCS = 10
TOP = 10
BITS = 64
KEY = ["lang", "digest", "split"]


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per occurrence the row and the number of its term; the terms."""
    # What lies between terms is ASCII, so single bytes can be replaced: texts keep their places.
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    letters = LETTERS[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(letters))
    lists = pc.ascii_split_whitespace(plain)
    row, found = pc.list_parent_indices(lists), pc.list_flatten(lists)
    there = pc.not_equal(pc.binary_length(found), 0)
    coded = found.filter(there).dictionary_encode()
    return row.filter(there).to_numpy(), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def digests(terms: list[str], bits: int = BITS) -> np.ndarray:
    """A number of ``bits`` bits per term."""
    return np.array([xxhash.xxh64_intdigest(t.encode()) >> (64 - bits) for t in terms], np.uint64).view(np.int64)


def _counted(bits: int, with_text: bool, held_rows: int = 0):
    """Occurrences and documents of each (lang, source, term) of a piece, or of the pieces that make up ``held_rows`` rows."""
    keys = ["group", "digest", "term"] if with_text else ["group", "digest"]

    def step(batch, number):
        texts, groups = batch.column(2), pa.StructArray.from_arrays(batch.columns[:2], ["lang", "source"])
        row, term, terms = terms_of(texts)
        group = np.array([number.setdefault((g["lang"], g["source"]), len(number)) for g in groups.to_pylist()])
        pair, n = np.unique(row * len(terms) + term, return_counts=True)
        key, place, docs = np.unique(group[pair // max(1, len(terms))] * len(terms) + pair % max(1, len(terms)),
                                     return_inverse=True, return_counts=True)
        which = key % max(1, len(terms))
        columns = {
            "group": pa.array((key // max(1, len(terms))).astype(np.int32)), "digest": pa.array(digests(terms, bits)[which]),
            "n": pa.array(np.bincount(place, weights=n).astype(np.int64)), "docs": pa.array(docs.astype(np.int64))}
        if with_text:
            columns["term"] = pa.array(terms, pa.string()).take(pa.array(which))
        return pa.table(columns)

    def summed(held):
        table = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return table.rename_columns([name.removesuffix("_sum") for name in table.column_names])

    def named(table, number):
        langs, sources = (pa.array(names, pa.string()) for names in zip(*number))
        group = table["group"].combine_chunks()
        columns = {"lang": langs.take(group), "source": sources.take(group)}
        return pa.table(columns | {name: table[name] for name in ("digest", "n", "docs", *keys[2:])}).to_batches(1 << 16)

    def run(batches):
        number: dict[tuple[str, str], int] = {}
        held, rows = [], 0
        for batch in batches:
            for piece in pieces(batch, 2):
                held.append(step(piece, number))
                rows += len(held[-1])
                if rows >= held_rows:
                    held = [summed(held)]
                    rows = len(held[0])
                # Rows that hardly repeat go out, so that no more are ever held.
                if 2 * rows >= held_rows and len(held) == 1:
                    yield from named(held[0], number)
                    number, held, rows = {}, [], 0
            give_back()
        if rows:
            yield from named(summed(held), number)
        held = None
        give_back()
    return run


def _texts(bits: int):
    """Each term of each language once, or again after ``HELD_TERMS`` others."""
    def run(batches):
        told: dict[str, set[str]] = {}
        for batch in batches:
            for piece in pieces(batch, 2):
                row, term, terms = terms_of(piece.column(2))
                langs = piece.column(0).dictionary_encode()
                key = np.unique(langs.indices.to_numpy()[row].astype(np.int64) * len(terms) + term)
                for number, lang in enumerate(langs.dictionary.to_pylist()):
                    lo, hi = np.searchsorted(key, [number * len(terms), (number + 1) * len(terms)])
                    known = told.setdefault(lang, set())
                    new = [t for t in (terms[k] for k in (key[lo:hi] - number * len(terms)).tolist()) if t not in known]
                    if not new:
                        continue
                    if sum(map(len, told.values())) + len(new) > HELD_TERMS:
                        told.clear()
                    told.setdefault(lang, set()).update(new)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(new), pa.string()), "digest": pa.array(digests(new, bits)), "term": pa.array(new, pa.string())})
            give_back()
        told = None
        give_back()
    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, split, n) of the kept terms, and their texts (lang, digest, split, term)."""
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    counted = keep(docs.mapInArrow(_counted(bits, False, HELD_ROWS), "lang string, source string, digest long, n long, docs long")
                   .groupBy("lang", "source", "digest").agg(*sums))
    known = keep(counted.groupBy("lang", "digest").agg(F.sum("docs").alias("docs"))
                 .where(F.col("docs") >= min_docs).select("lang", "digest"))
    known = broadcast_if_small(known)
    texts = keep(
        docs.mapInArrow(_texts(bits), "lang string, digest long, term string").join(known, ["lang", "digest"], "left_semi")
        .groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("other")))
    cells = counted.join(known, ["lang", "digest"], "left_semi").select("lang", "source", "digest", F.lit(0).alias("split"), "n")
    alone = texts.select("lang", "digest", F.lit(0).alias("split"), "term")
    shared = texts.where("term <> other").select("lang", "digest")
    if shared.isEmpty():
        return cells, alone
    shared = broadcast_if_small(shared)
    exact = keep(
        docs.mapInArrow(_counted(bits, True, HELD_ROWS), "lang string, source string, digest long, n long, docs long, term string")
        .join(shared, ["lang", "digest"], "left_semi").groupBy("lang", "source", "digest", "term").agg(*sums))
    split = keep(
        exact.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        .select("lang", "digest", "term", F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term")).alias("split")))
    apart = exact.join(split, ["lang", "digest", "term"]).select("lang", "source", "digest", "split", "n")
    return (cells.join(shared, ["lang", "digest"], "left_anti").unionByName(apart),
            alone.join(shared, ["lang", "digest"], "left_anti").unionByName(split.select("lang", "digest", "split", "term")))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), three digits at a time so that nothing overflows."""
    whole_part, rest, by = None, f"({count} + 2)", f"({total} + 2 * {terms})"
    for _ in range(3):
        part = f"({rest} * 1000 div {by})"
        whole_part = part if whole_part is None else f"({whole_part} * 1000 + {part})"
        rest = f"({rest} * 1000 % {by})"
    return F.expr(f"1 + {whole_part}")


def apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language."""
    absent = groups.select("lang", "z").distinct()
    # Terms of one source against a source without them: by how many terms have the same number.
    alone = keep(
        cells.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
        .join(broadcast_if_small(absent), "lang")
        .groupBy("lang", "source", "z").agg(F.sum(F.col("times") * apart("p", "z")).alias("alone")))
    left = cells.selectExpr(*KEY, "source", "p", "z")
    right = cells.selectExpr(*KEY, "source AS item", "p AS q", "z AS y")
    both = (
        left.join(right, KEY).where("source < item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(apart("p", "q") - apart("p", "y") - apart("z", "q") + apart("z", "y")).alias("both")))
    other = groups.selectExpr("lang", "source AS item", "z AS y", "terms AS other_terms")
    pairs = (
        groups.select("lang", "source", "z", "terms", "v").join(other, "lang").where("source < item")
        .join(both, ["lang", "source", "item"], "left")
        .join(alone.selectExpr("lang", "source", "z AS y", "alone"), ["lang", "source", "y"], "left")
        .join(alone.selectExpr("lang", "source AS item", "z", "alone AS other_alone"), ["lang", "item", "z"], "left")
        .select("lang", "source", "item", F.when(F.col("v") == 0, F.lit(0)).otherwise(
            F.coalesce("both", F.lit(0)) + F.coalesce("alone", F.lit(0)) + F.coalesce("other_alone", F.lit(0))
            + (F.col("v") - F.col("terms") - F.col("other_terms")) * apart("z", "y")).alias("value")))
    return pairs.select("lang", "value", F.explode(F.array(
        F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    ).select("lang", "way.source", "way.item", "value")


def _top_terms(cells: DataFrame, texts: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value of the terms a source has more than its language, up to rank ``top``."""
    by_group = Window.partitionBy("lang", "source")
    more = cells.where("p > q").select("lang", "source", "digest", "split", apart("p", "q").alias("value"))
    # The value at the last rank, without text; every row that reaches it fetches its text.
    least = keep(
        more.select("lang", "source", "value", F.row_number().over(by_group.orderBy(F.desc("value"))).alias("n"))
        .where(F.col("n") <= top).groupBy("lang", "source").agg(F.min("value").alias("least")))
    reached = more.join(broadcast_if_small(least), ["lang", "source"]).where("value >= least")
    return reached.join(texts, KEY).select("lang", "source", F.col("term").alias("item"), "value")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_column: str = "text",
               lang_column: str = "lang", source_column: str = "source", bits: int = BITS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*(whole(F.col(name).cast("string")).alias(new)
                         for name, new in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))))
    cells, texts = kept_terms(docs, min_docs, bits)
    texts = keep(texts)
    cells = keep(cells.withColumn("total", F.sum("n").over(Window.partitionBy(*KEY))))
    counted = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    vocabulary = texts.groupBy("lang").agg(F.count("*").alias("v"))
    by_lang = counted.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    groups = keep(
        docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left").join(by_lang, "lang", "left")
        .na.fill(0, ["n", "terms", "v", "lang_n"]).withColumn("none", F.lit(0))
        .withColumn("z", F.when(F.col("v") > 0, share("none", "n", "v")).otherwise(F.lit(1))).drop("none"))
    sizes = groups.selectExpr("lang", "source", "n AS own_n", "v", "lang_n", "z")
    cells = keep(cells.join(broadcast_if_small(sizes), ["lang", "source"]).select(
        "lang", "source", "digest", "split", "z", share("n", "own_n", "v").alias("p"),
        share("total", "lang_n", "v").alias("q")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = _pairs(groups, cells).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = _top_terms(cells, texts, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
    return pairs.union(terms.where(F.col("rank") <= top))
