"""The pipeline's stages, each held against a brute-force version on its own input."""

import re
from collections import Counter

import corpus_pipeline
from test_mixing import half_longest, slow_targets, words
from test_packing import check as check_packing
from test_simhash import slow_components, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    long = [r for r in real if r[1] and len(r[1]) > 2000][:5]
    copies = [(100_000 + i, r[1].replace(" ", "  ", 3), *r[2:]) for i, r in enumerate(long)]
    near = [(200_000 + i, r[1] + " one more word", *r[2:]) for i, r in enumerate(long)]
    toxic = [(300_000, "You idiot, you are a worthless moron and pathetic scum.", "en", "src1", 10)]
    odd = [(None, "text of nobody", None, None, None), (400_000, None, "en", "src0", 0), (400_001, "", None, None, None)]
    return spark.createDataFrame(real + copies + near + toxic + odd, SCHEMA).repartition(4)


def test_stages_by_brute_force(spark, tmp_path):
    docs, seen = planted(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        result = stage(spark, docs, FOLDER)
        if name != "packing":
            assert result.schema.names == docs.schema.names
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        seen[name] = len(after)
        ids = Counter(r.doc_id for r in after)
        if name == "toxicity":
            assert 300_000 not in ids and ids[None] == 1 and ids[400_000] == 1
            assert not Counter(map(tuple, after)) - Counter(before)
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: (r[0] is None, r[0] or 0)):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
            assert Counter(map(tuple, after)) == Counter(first.values())
        elif name == "simhash_near_dedup":
            rows = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
            parts = slow_components([slow_fingerprint(r[1]) for r in rows])
            assert Counter(map(tuple, after)) == Counter(r for i, r in enumerate(rows) if parts[i] == i)
        elif name == "mixing":
            assert set(map(tuple, after)) <= set(before) and max(ids.values()) <= 2
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r[3]] += words(r[1])
            for r in after:
                taken[r.source] += words(r.text)
            near = half_longest([(r[0], r[1], r[3]) for r in before])
            for source, target in slow_targets(sizes).items():
                assert abs(taken[source] - target) <= near(source), source
        else:
            check_packing([(r[0], r[1]) for r in before], after, 2048, 0.05)
    assert seen["exact_dedup"] > seen["simhash_near_dedup"] > 0


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100
