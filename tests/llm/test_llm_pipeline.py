"""The pipeline's stages on awkward rows, and its run against a plain chain of the same decisions."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, _text string, n_chars long"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, blanks, copies, near copies, secrets, repeated rows, a very long text and junk, and their labels."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []

    def add(text, good=None):
        rows.append((len(rows), text, "clash", len(text or "")))
        if good is not None:
            labels.append((len(rows) - 1, int(good), 0))

    for i in range(260):
        add(" ".join(prose(rng.randint(40, 90))), True)
        add(" ".join(x + "%%%" for x in prose(rng.randint(40, 90))), False)
    for i in range(6):
        base = prose(120)
        add(" ".join(base))
        add("\n".join(base))  # an exact copy but for white space, and not longer
        for _ in range(3):
            own = list(base)
            own[rng.randrange(120)] = "other"
            add(" ".join(own))
        add(" ".join(base[:50] + prose(70)))  # shares a passage only
    add(" ".join([*prose(30), "password=hunter22", *prose(30)]))
    add(" ".join(prose(25_000)))
    rows += [rows[2], rows[2], (None, rows[4][1], None, None), (None, None, None, None), (9000, "", "", 0), (9001, " \t\n", "", 3)]
    labels += [(0, 0, 0), (None, 1, 0), (1, None, 0)]  # labelled twice, without an id, without a label
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def squeeze(t):
    return (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")


def shingles(t):
    w = (t or "").encode().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def one_of_each(rows, groups):
    """Of each group the row with the smallest id, null last."""
    return Counter(min((rows[i] for i in g), key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups)


def by_links(rows):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def check_packing(given, pieces, length=4096):
    """Every document once and whole, its ids those of the library, sequences without a gap."""
    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    want = Counter((r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in given)
    runs = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        runs.setdefault((p.doc_id, p.sequence_id * length + p.offset - p.start), {})[p.start] = p.ids
    assert Counter((d, b"".join(own[k] for k in sorted(own))) for (d, _), own in runs.items()) == want
    at = sorted((p.sequence_id * length + p.offset, p.length) for p in pieces)
    assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1].tolist()] and all(p.offset + p.length <= length for p in pieces)


def test_every_stage_against_brute_force(spark, folder):
    from pyspark.sql import functions as F

    from veracity.llm.quality_classifier import fit_quality, quality_score

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows, found = docs.collect(), stage(spark, docs, folder)
        got = found.collect()
        if name != "packing":
            assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString()
        if name == "quality":
            model = fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            score = docs.withColumn("_score", quality_score(model, docs)).collect()
            assert Counter(got) == Counter(r[:-1] for r in score if r._score >= 0.7)
            junk = {r for r in rows if "%%%" in (r.text or "")}
            assert junk and sum(r in junk for r in got) <= 0.02 * len(junk) and sum(r not in junk for r in got) >= 0.95 * (len(rows) - len(junk) - 4)
        elif name == "exact":
            groups = {}
            for r in rows:
                groups.setdefault(squeeze(r.text), []).append(r)
            assert Counter(got) == Counter(min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for g in groups.values())
        elif name == "near":
            assert Counter(got) == one_of_each(rows, by_links(rows))
        elif name == "secrets":
            change = lambda t: t and t.replace("password=hunter22", "[SECRET]")
            assert Counter(got) == Counter((r.doc_id, change(r.text), r._text, r.n_chars - 9 if change(r.text) != r.text else r.n_chars) for r in rows)
            assert any("[SECRET]" in (r.text or "") for r in got)
        else:
            check_packing(rows, got)
        docs = spark.createDataFrame(got, found.schema)
    empty = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    assert all(stage(spark, empty, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_run_is_the_chain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        docs = spark.createDataFrame(found.collect(), found.schema)
    whole = lambda df: Counter((r.doc_id, r.doc_tokens, r.start == 0) for r in df.collect() if r.start == 0)
    assert whole(corpus_pipeline.run(spark, folder)) == whole(docs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_run_delivers_tokens(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    size = {}
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + len(r.ids) // 4
    assert sorted(size) == list(range(len(size))) and all(size[k] == 4096 for k in range(len(size) - 1))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_runs_leave_nothing_but_their_results(spark):
    from veracity.sources import scratch

    before = set(scratch._open)
    a, b = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert a.count() == b.count() and len(set(scratch._open) - before) == 2
