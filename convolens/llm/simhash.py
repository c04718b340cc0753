"""Near duplicates by SimHash: fingerprints that share blocks are compared by Hamming distance.

A fingerprint's 64 bits are split into blocks. Two that differ in at most d bits agree in at least
``blocks - d`` of them, so each is filed under every choice of so many blocks and compared only with
those filed beside it. Equal fingerprints are one node. Within a file, links are found by searching
outwards from a node among those not reached yet, so a dense file costs little and gives a tree, not
all pairs. Files of more than ``max_file`` fingerprints are not searched in one task: their members are
spread over all fingerprints within half the distance, where sharing one proves a link.

Defined cases: a null text counts as empty; a text without words has fingerprint zero; one with fewer
words than a shingle is a single shingle. The component is named by its smallest id that is not null,
null where there is none. Extra columns pass through, an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from convolens.llm.graph import components
from convolens.llm.text import bounded_batches, first_missing, utf8
from convolens.scale import keep

SEED = 42
WORDS = 4
MAX_BITS = 4
BLOCKS = 6
MAX_FILE = 1 << 16
CHUNK = 1 << 17


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a UTF-8 text."""
    # Splits at the six ASCII white space characters and lowers A-Z only.
    tokens = text.lower().split()
    if not tokens:
        return 0
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined = b" ".join(tokens)
    del tokens
    width = min(words, len(starts))
    total = len(starts) - width + 1
    ones = np.zeros(64, np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        to = min(total, at + CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1:to + width - 1].tolist())
        hashes = np.array([hash64(joined[a:b], SEED) for a, b in spans], np.uint64)
        # Big-endian bytes unpack to the highest bit first.
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 words: int = WORDS) -> DataFrame:
    """id and fp (as a signed long) of every row."""
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("id"), text_column).mapInArrow(run, "id long, fp long")


def block_masks(blocks: int, equal: int) -> list[int]:
    """Masks of every choice of ``equal`` out of ``blocks`` blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), equal)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def tree(members: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, int]]:
    """Links that connect what is connected: (members, the one they are tied to)."""
    links, rest = [], members
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= max_bits
            if near.any():
                new, rest = rest[near], rest[~near]
                links.append((new, root))
                frontier.extend(new)
    return links


def _links_in_files(max_bits: int):
    """Trees of the files of a task, which arrive sorted by file."""
    def batch_of(links):
        a = np.concatenate([new for new, _ in links])
        b = np.concatenate([np.broadcast_to(root, new.shape) for new, root in links])
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    def search(file, fp):
        starts = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
        sizes = np.diff(np.r_[starts, len(file)])
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= max_bits]
        # In pairs each link has its own root.
        links = [(fp[near], fp[near + 1])] if len(near) else []
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            links += tree(fp[start:start + size], max_bits)
        return links

    def run(batches):
        held_file, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            file = np.concatenate([held_file, np.asarray(batch.column(0))])
            fp = np.concatenate([held_fp, np.asarray(batch.column(1)).view(np.uint64)])
            if not len(file):
                continue
            # The last file may go on in the next batch.
            cut = int(np.searchsorted(file, file[-1], "left"))
            held_file, held_fp = file[cut:], fp[cut:]
            if cut and (links := search(file[:cut], fp[:cut])):
                yield batch_of(links)
        if len(held_file) and (links := search(held_file, held_fp)):
            yield batch_of(links)
    return run


def _half_way(max_bits: int):
    """Every fingerprint within half the distance of a member, as the meeting place of close ones."""
    def flips(radius):
        return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)],
                        np.uint64)

    def run(batches):
        masks = flips(max_bits // 2)
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fp), 256):
                part = fp[at:at + 256]
                yield pa.RecordBatch.from_pydict({
                    "place": pa.array((part[:, None] ^ masks).ravel().view(np.int64)),
                    "fp": pa.array(np.repeat(part, len(masks)).view(np.int64))})
    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, max_file: int = MAX_FILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within ``max_bits`` of each other."""
    masks = block_masks(blocks, blocks - max_bits)
    filed = nodes.select("fp", F.explode(F.array(*(
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)))).alias("file"))
    full = keep(filed.groupBy("file").count().where(F.col("count") > max_file).select("file"))
    found = None
    if not full.isEmpty():
        members = filed.join(full, "file").select("fp").distinct()
        filed = filed.join(full, "file", "left_anti")
        if max_bits % 2:
            raise ValueError("files beyond max_file need an even max_bits")
        places = members.mapInArrow(_half_way(max_bits), "place long, fp long")
        centres = places.groupBy("place").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        found = places.join(centres, "place").select(F.col("fp").alias("a"), "b").where("a <> b")
    trees = filed.select("file", "fp").repartition("file").sortWithinPartitions("file").mapInArrow(
        _links_in_files(max_bits), "a long, b long")
    return trees if found is None else trees.union(found)


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                max_bits: int = MAX_BITS, blocks: int = BLOCKS, max_file: int = MAX_FILE) -> DataFrame:
    """One row per document: doc_id, fingerprint (hexadecimal), component_id."""
    prints = keep(fingerprints(docs, id_column, text_column, words))
    nodes = keep(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(nodes, max_bits, blocks, max_file))
    rooted = keep(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                  .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = keep(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = keep(rooted.join(names, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                  max_bits: int = MAX_BITS, blocks: int = BLOCKS, max_file: int = MAX_FILE) -> DataFrame:
    """The documents whose id names their component, columns as they are.

    Rows of one id stay or go together; a null id counts as an id of its own.
    """
    groups = near_groups(docs, id_column, text_column, words, max_bits, blocks, max_file)
    [gone] = first_missing(docs, "gone")
    names = groups.groupBy(F.col("doc_id").alias(gone)).agg(
        F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("NOT stays").select(gone)
    return docs.join(keep(names), F.col(id_column).cast("long").eqNullSafe(F.col(gone)), "left_anti")
