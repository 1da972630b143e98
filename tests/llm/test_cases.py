"""Cases that several operators share: long texts, ties, repeats, small and large edge tables, empty runs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspan.llm import components, grammar, langid, neardup, packing, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


@pytest.mark.parametrize("few", [0, 1 << 15])
def test_components_of_few_and_many_edges_agree(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x["node"]: x["root"] for x in components.roots(spark.createDataFrame(edges + edges[:50], "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("empty", [True, False])
def test_a_whole_run_over_empty_and_odd_tables(spark, tmp_path, empty):
    rows = [] if empty else [(1, None), (2, ""), (3, " \n "), (4, words(1, 60)), (4, words(1, 60)), (None, words(2, 60))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found == [] if empty else {r["doc_id"] for r in found} <= {4, None}


def test_every_id_of_every_document_is_packed_once(spark):
    rows = [(i, words(i, n)) for i, n in enumerate((1, 3, 30, 200, 2000, 5000, 400, 401, 60))] + [(20, None), (21, ""), (3, words(3, 200))]
    docs = documents(spark, rows)
    found = packing.pack(docs).collect()
    encoder = tokens.Encoder(packing.vocabulary(), tokens.LEADING)
    lengths = Counter()
    for d, t in rows:
        lengths[d, len(encoder.whole([t or ""])[0]) // 4 + 1] += 1
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for (d, n), times in lengths.items():
        own = sorted((r["piece"], r["start"], r["length"]) for r in by_doc[d])
        assert sum(x[2] for x in own) == n * times
        for piece, start, length in own:
            later = [x for x in own if x[0] == piece + 1]
            assert (length == 1024 or piece == 0) and all(x[1] == start + length for x in later)
            assert n > 1024 or (piece, start, length) == (0, 0, n)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_long_near_copies_are_linked(spark):
    long = words(1, 120_000).split()
    near = list(long)
    for i in range(0, len(near), 4000):
        near[i] = "changed"
    far = list(long)
    for i in range(0, len(far), 9):
        far[i] = "other"
    docs = documents(spark, [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (2, " ".join(near))])
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.link(docs).collect()) == [(1, 1), (2, 1), (2, 1), (3, 3)]


def test_equal_distances_go_to_the_first_language(spark):
    rows = [(i, "aba abc", ["xx", "yy"][i % 2]) for i in range(40)]
    docs = spark.createDataFrame([(d, t, lang, "s", 1) for d, t, lang in rows], DOCS)
    got = langid.predict_documents(docs).collect()
    assert {r["lang_pred"] for r in got} == {"xx"} and len({r["score"] for r in got}) == 1


def test_long_documents_and_repeats_in_token_files(spark):
    rows = [(1, words(1, 40_000)), (2, None), (3, words(1, 40_000)), (4, "")]
    found = {r["doc_id"]: r for r in grammar_rows(spark, rows)}
    assert found[1]["n_tokens"] == found[3]["n_tokens"] > 40_000 and found[1]["ids_crc32"] == found[3]["ids_crc32"]
    assert [found[d]["n_tokens"] for d in (2, 4)] == [1, 1] and found[2]["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes())
    assert [found[d]["start"] for d in (1, 2, 3, 4)] == [0, found[1]["n_tokens"], found[1]["n_tokens"] + 1, 2 * found[1]["n_tokens"] + 1]


def grammar_rows(spark, rows):
    import tempfile

    folder = tempfile.mkdtemp()
    documents(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return grammar.query(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy(F.col("doc_id")).collect()
