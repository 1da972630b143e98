"""The ten operators and the pipeline against brute force, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspan.llm import classifier, features, grammar, langid, learn, lines, mixing, neardup, neighbours, packing, rules, suffixes, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, node string, row string"


def words(seed: int, n: int, stem: str = "") -> str:
    r = random.Random(seed)
    return " ".join(stem + "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Near and exact copies, nulls, repeats, blanks, a long text; with columns whose names clash."""
    base = words(1, 300)
    near = base.split()
    near[150] = "changed"
    shared = words(2, 60)
    rows = [(0, base), (1, " ".join(near)), (2, base), (3, None), (4, ""), (5, "  \n\t"), (6, "one two"), (7, "one  two"), (8, f"{words(3, 50)}\n{shared}\n{words(4, 40)}")]
    rows += [(9, f"{shared} {words(5, 30)}"), (10, words(6, 9000)), (10, words(6, 9000)), (None, words(7, 80)), (11, "ab" * 400), (12, "éß " * 150)]
    rows += [(20 + i, f"{words(30 + i, 20)}\nrequest {i} took {i * 7} ms on node {i}\n{words(60 + i, 20)}") for i in range(6)]
    langs = ["en", None, "de", "fr"]
    return spark.createDataFrame([(d, t, langs[i % 4], "s", len(t or ""), "x", "y", "z") for i, (d, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def texts(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.collect()]


def key(row):
    return tuple(-1 if v is None else v for v in row)


@pytest.mark.parametrize("crowd", [1024, 1])
def test_repeated_strings(spark, corpus, texts, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    data = [(d, (t or "").encode()) for d, t in texts]
    seen = Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    wanted = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        wanted.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(map(key, suffixes.remove_repeats(corpus).collect())) == sorted(map(key, wanted))


def brute_components(texts):
    def shingles(text):
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    ids = sorted({d for d, _ in texts if d is not None})
    sets = {d: next(shingles(t) for e, t in texts if e == d) for d in ids}
    root = {d: d for d in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d], root[d] == d) for d in ids}


@pytest.mark.parametrize("rounds", [4, 0])
def test_near_duplicates(corpus, texts, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(corpus).collect()}
    assert got.pop(None) == (76, None, False)
    assert got == brute_components(texts)
    assert neardup.link(corpus).count() == len(texts)


def test_one_of_each_group_stays(corpus):
    kept = neardup.keep_one(corpus)
    assert kept.columns == corpus.columns
    assert {1, 2, 7}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.where("doc_id is null").count() == 1


def test_stage_links_from_80_percent(spark):
    pairs = {}
    for i in range(20):
        text = words(700 + i, 404).split()
        other = list(text)
        for at in range(40, 360, 40):
            other[at] = "changed"
        pairs[2 * i], pairs[2 * i + 1] = " ".join(text), " ".join(other)
    a, b = (set(neardup.shingles(pairs[d]).tolist()) for d in (0, 1))
    assert 0.81 < len(a & b) / len(a | b) < 0.83
    table = spark.createDataFrame(list(pairs.items()), "doc_id long, text string")
    assert neardup.keep_one(table, 85).count() == 40
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, "").collect()} == set(range(0, 40, 2))


def test_line_templates(spark, corpus):
    got = {r["doc_id"]: r for r in lines.dedup_lines(corpus).collect()}
    assert [got[20 + i]["n_dropped"] for i in range(6)] == [0, 1, 1, 1, 1, 1]
    assert "took 0 ms" in got[20]["text"] and "took" not in got[23]["text"]
    assert got[3]["text"] is None and got[3]["n_lines"] == 0 and got[4]["n_lines"] == 1
    kept = lines.drop_recurring(corpus)
    assert kept.columns == corpus.columns and kept.count() == corpus.count()
    assert kept.where("text is not null and n_chars <> length(text)").count() == 0


def test_lines_recur_at_any_size(spark):
    names, cities = [f"name{c}" for c in "abcdefgh"], [f"city{c}" for c in "abcdefgh"]
    texts = [f"{words(i, 9)}\nTel. 0800 123 456 Fax 0800 123 {i}\nPosted by {n} in {c}" for i, (n, c) in enumerate((n, c) for n in names for c in cities)]
    texts += [f"{words(900 + i, 9)}\nshort\n 1 2 3 4\n5 6 7 {i}" for i in range(2)] + ["short\n1 2 3 4"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"].split("\n") for r in lines.drop_recurring(table).collect()}
    assert left[0] == texts[0].split("\n")
    assert all(left[i] == [words(i, 9)] for i in range(1, 64))
    assert left[64] == texts[64].split("\n") and left[65] == [words(901, 9), "5 6 7 1"] and left[66] == [""]
    assert {r["doc_id"] for r in lines.drop_recurring(table, keep_emptied=False).collect()} == set(range(66))


def labelled(spark, corpus):
    good = [(1000 + i, words(i, 60), "en", "s", 0, "x", "y", "z") for i in range(60)]
    bad = [(2000 + i, words(i, 60, "$$$"), "en", "s", 0, "x", "y", "z") for i in range(60)]
    labels = [(1000 + i, 1, 0) for i in range(60)] + [(2000 + i, 0, 0) for i in range(60)] + [(2000, 0, 0), (None, 1, 0), (1, None, None), (999_999, 1, 1)]
    return corpus.unionByName(spark.createDataFrame(good + bad, DOCS)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier(spark, corpus):
    documents, labels = labelled(spark, corpus)
    rows = classifier.score_documents(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] >= 1000]
    assert held and all(r["predicted"] == (1 if r["doc_id"] < 2000 else 0) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)


def test_classifier_without_labels(spark, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in classifier.score_documents(corpus, labels).collect()} == {0.5}


def test_dual_coordinate_descent_separates():
    rows = learn.Rows(np.array([0, 2, 1, 2, 0, 1], np.uint32), np.array([0, 2, 4, 5, 6]), np.array([1, 0, 1, 0]))
    weights, bias = classifier.dual_coordinate_descent(rows, np.ones(3), epochs=50)
    assert [np.sign(weights[rows.row(i)].sum() + bias) for i in range(4)] == [1, -1, 1, -1]


def test_quality_rules(spark, corpus, texts):
    documents, labels = labelled(spark, corpus)
    model = rules.Model(learn.labelled_rows(documents, labels, rules.HASHING))
    rows = {r["doc_id"]: r for r in rules.judge(documents, model).collect()}
    assert all(rows[1000 + i]["kept"] and not rows[2000 + i]["kept"] for i in range(60))
    assert rows[3]["base_failed"] and not rows[3]["kept"] and rows[10]["n_words"] == 9000


@pytest.mark.parametrize("text", ["a b c d a b c", "x\nx\n \n\nx", "#a $b\tx|y é", "  ", "", None, "a a a a a"])
def test_base_counts(text):
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) for j in range(3) if windows[tuple(w[i : i + 3])] > 1}
    full = [x for x in (text or "").split("\n") if x.strip(" \t\v\f\r")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    assert rules.base_counts(text) == (len(w), sum(map(len, w)), symbols, len(full) - len(set(full)), len(inside))


def ids_of(texts, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return {(d, t): tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts}


def test_token_grammar(corpus, texts):
    wanted = ids_of(texts, grammar.vocabulary())
    shards = grammar.encode_shards(corpus, shard_tokens=2000).cache()
    rows = sorted(grammar.read_shards(shards).collect(), key=lambda r: r["start"])
    assert [key((r["doc_id"],)) for r in rows] == sorted(key((d,)) for d, _ in texts)
    assert [r["start"] for r in rows] == list(np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1])
    sums = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, t), i in [((d, t), wanted[(d, t)]) for d, t in texts])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sums


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(3)
    encoded = [r.choice([3, 4, 5, 600], n).astype("<u4").tobytes() for n in (1, 7, 5000, 300)] + [np.full(999, 9, "<u4").tobytes()]
    shard = grammar.Shard(grammar.pack_shard([1, None, 3, 4, 5], encoded))
    assert len(shard.left) > 0 and shard.doc_ids == [1, None, 3, 4, 5]
    assert shard.expand(shard.symbols).astype("<u4").tobytes() == b"".join(encoded)
    assert [shard.document(i).astype("<u4").tobytes() for i in range(5)] == encoded


@pytest.mark.parametrize(("path", "pieces"), [(packing.vocabulary(), tokens.LEADING), (grammar.vocabulary(), tokens.DROPPED)])
def test_pieces_encode_as_whole_texts(path, pieces):
    r = random.Random(9)
    odd = ["a", "B", "'s", "1", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "é", "３", "　", "<|endoftext|>", "ß", "😀", "--"]
    encoder = tokens.Encoder(path, pieces)
    some = ["".join(r.choice(odd) for _ in range(r.randint(0, 20))) for _ in range(2000)]
    assert list(encoder.encode_all(some)) == [encoder.whole([t])[0] if t else b"" for t in some]


def test_packing(corpus, texts):
    wanted = ids_of(texts, packing.vocabulary())
    rows = packing.pack(corpus).collect()
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for d, t in texts:
        ids = wanted[(d, t)]
        for _, start, length, crc in by_document[d]:
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
        assert {p[2] for p in by_document[d] if p[0] > 0} <= {1024}
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert least <= len(by_sequence) <= least + 2


def test_fullest_combination_is_exact():
    r = random.Random(4)
    for _ in range(50):
        available = sorted({n: r.randint(1, 3) for n in r.sample(range(1, 60), 6)}.items(), reverse=True)
        best = {0}
        for n, c in available:
            best |= {b + k * n for b in best for k in range(1, c + 1) if b + k * n <= 100}
        chosen = packing.fullest(available, 100)
        assert sum(chosen) == max(best) and all(Counter(chosen)[n] <= dict(available).get(n, 0) for n in chosen)


def test_language_id(spark, corpus):
    stems = {"en": "the", "de": "sch", "fr": "eau"}
    rows = [(100 + 3 * i + j, words(i, 60, stem), lang, "s", 0, "x", "y", "z") for i in range(60) for j, (lang, stem) in enumerate(stems.items())]
    documents = spark.createDataFrame(rows, DOCS).unionByName(corpus.withColumn("lang", F.lit(None).cast("string")))
    got = {r["doc_id"]: r for r in langid.predict_documents(documents).collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang, *_ in rows)
    assert (got[3]["lang_pred"], got[3]["score"]) == (got[5]["lang_pred"], got[5]["score"]) == ("und", 0.0)
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got if d is not None)
    kept = langid.keep_known(documents)
    assert kept.columns == documents.columns and kept.where("doc_id in (3, 4, 5)").count() == 0
    assert kept.where("doc_id >= 100").count() == len(rows)


def test_profiles_without_languages():
    assert langid.Profiles({}).predict("text") == ("und", 0.0)


def test_nearest_neighbours(spark):
    r = np.random.default_rng(8)
    vectors = np.vstack((r.normal(size=(900, 8)), np.repeat(r.normal(size=(1, 8)), 40, 0), np.zeros((1, 8))))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(None, [1.0] * 8, 0), (5000, None, 0), (5001, [1.0, None] + [0.0] * 6, 0), (5002, [float("nan")] * 8, 0), (5100, [1.0] * 3, 0), (900, vectors[900].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for x in neighbours.nearest(table, query_step=50, chunk_rows=64, least_search=50).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == set(range(0, 940, 50))
    hit = 0
    for q, found in got.items():
        apart = np.sqrt(((vectors[:940] - vectors[q]) ** 2).sum(axis=1))
        apart[q] = np.inf
        best = np.lexsort((np.arange(940), apart))[:10]
        hit += len({v for _, v, _ in found} & set(best.tolist()))
        assert [f[0] for f in sorted(found)] == list(range(1, 11)) and all(abs(apart[v] - s) < 1e-12 for _, v, s in found)
    assert hit >= 0.9 * 10 * len(got)
    few = table.where("vec_id in (0, 1, 2)")
    assert [x["vec_id"] for x in neighbours.nearest(few, query_step=50).orderBy("rank").collect()] == sorted([1, 2], key=lambda i: ((vectors[i] - vectors[0]) ** 2).sum())
    assert neighbours.nearest(table.where("false")).count() == 0


def test_mixing_meets_targets(spark, corpus):
    documents, labels = labelled(spark, corpus)
    rows = mixing.rates(documents, labels, {"good": 0.7, "low": 0.3, "toxic": 0.0}).collect()
    assert len(rows) == documents.count() and all(0 <= r["rate"] <= 1 and r["copies"] in (0, 1) for r in rows)
    total = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) for d in ("good", "low", "toxic")}
    assert abs(total["low"] / sum(total.values()) - 0.3) < 0.01
    mixed = mixing.mix(documents, labels)
    assert mixed.columns == documents.columns
    empty = mixing.rates(documents.where("false"), labels)
    assert empty.count() == 0


def test_repeated_vectors_hide_no_neighbours(spark):
    r = np.random.default_rng(5)
    vectors = r.normal(size=(60, 8))
    near = vectors[0] + 1e-3 * r.normal(size=(30, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] * 2 + [(7, (vectors[0] + 1e-6).tolist())] * 12 + [(8, v.tolist()) for v in near]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    apart = np.sqrt(((vectors - vectors[0]) ** 2).sum(axis=1))
    apart[[0, 7, 8]] = [np.inf, np.sqrt(8) * 1e-6, np.sqrt(((near - vectors[0]) ** 2).sum(axis=1)).min()]
    got = neighbours.nearest(table, query_step=100).orderBy("rank").collect()
    assert [x["vec_id"] for x in got] == np.argsort(apart)[:10].tolist()
    assert np.allclose([x["score"] for x in got], np.sort(apart)[:10])


@pytest.mark.parametrize("toxic", [0, 2])
def test_scarce_domain_leaves_the_mix_whole(spark, toxic):
    kinds = ["good"] * 300 + ["low"] * 40 + ["toxic"] * toxic
    stems = {"good": "", "low": "$$$", "toxic": "!!!"}
    documents = spark.createDataFrame([(i, words(i, 40, stems[k])) for i, k in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k == "good"), int(k == "toxic")) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int")
    rated = mixing.rates(documents, labels, whole=True).cache()
    rows = {r["doc_id"]: r for r in rated.collect()}
    assert all(rows[i]["rate"] > 0.95 for i in range(300)) and sum(rows[i]["copies"] > 0 for i in range(300)) > 285
    assert all((rows[340 + i]["rate"] > 4) for i in range(toxic))
    target, got = mixing.reached(rated)["toxic"]
    assert abs(got - target) < 0.005 if toxic else got == 0.0
    unlabelled = mixing.rates(documents, labels.where("false"), whole=True).collect()
    assert {(r["rate"], r["copies"]) for r in unlabelled} == {(1.0, 1)}


def test_projected_gradient_equals_numpy(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([0.3, 0.3], 50)
    t = r.integers(1, 100, 50)
    rows = spark.createDataFrame([(i, int(t[i]), float(p[i, 0]), float(p[i, 1])) for i in range(50)], "i int, n_tokens long, p_a double, p_b double")
    got = {x["i"]: x["rate"] for x in mixing.fit_rates(rows, {"a": 0.8, "b": 0.2}, tokens=3000.0, most_rate=9.0).collect()}
    rate, totals = np.ones(50), t @ p
    for _ in range(mixing.STEPS):
        error = (rate * t) @ p - 3000 * np.array([0.8, 0.2])
        if np.abs(error / totals).max() <= mixing.TOLERANCE:
            break
        rate = np.clip(rate - p @ (error / totals), 0, 9)
    assert np.allclose([got[i] for i in range(50)], rate, atol=1e-9)


def test_hashed_buckets_of_long_texts_equal_pieces(monkeypatch):
    data = words(3, 400_000).encode()
    whole = features.hashed_buckets(data, 18, (3,), ())
    wanted = np.unique(np.concatenate([features.hashed_buckets(data[i : i + 5000], 18, (3,), ()) for i in range(0, len(data), 4990)]))
    assert np.array_equal(whole, wanted)


@pytest.mark.parametrize("piece", [1, 100, 4096, 1 << 20])
def test_pieces_of_long_texts_give_the_whole_texts_features(monkeypatch, piece):
    texts = [words(3, 5000) + "  " + "x" * 20_000 + "\n" + words(4, 30) + " ", "", " ", "a", "é ß\tΑΣ ΑΣ " * 300]
    monkeypatch.setattr(features, "PIECE", 1 << 30)
    monkeypatch.setattr(langid, "PIECE", 1 << 30)
    hashed = [features.hashed_buckets(t.encode(), 24, (2, 3, 5), (1, 2, 3)) for t in texts]
    counted = [langid.count_ngrams(t) for t in texts]
    monkeypatch.setattr(features, "PIECE", piece)
    monkeypatch.setattr(langid, "PIECE", piece)
    for t, h, c in zip(texts, hashed, counted, strict=True):
        assert np.array_equal(features.hashed_buckets(t.encode(), 24, (2, 3, 5), (1, 2, 3)), h)
        assert all(np.array_equal(x, y) for x, y in zip(langid.count_ngrams(t), c, strict=True))


def test_repeated_labelled_rows_and_many_buckets_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, words(i % 40, 30)) for i in range(400)] + [(0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = learn.labelled_rows(docs, labels, learn.Hashing(), bound=30)
    assert len(rows) == 30
    monkeypatch.setattr(learn, "MOST_BUCKETS", int(rows.at[-1]) // 2)
    fewer = learn.labelled_rows(docs, labels, learn.Hashing(), bound=30)
    assert 0 < len(fewer) < 30 and fewer.at[-1] <= rows.at[-1] // 2
    monkeypatch.setattr(learn, "MOST_BUCKETS", 1)
    assert len(learn.labelled_rows(docs, labels, learn.Hashing(), bound=30)) == 0


def empty_like(frame):
    return frame.where("false")


@pytest.mark.parametrize("operator", [suffixes.remove_repeats, neardup.link, lines.dedup_lines, packing.pack, langid.predict_documents, langid.keep_known, neardup.keep_one, lines.drop_recurring])
def test_empty_tables(corpus, operator):
    assert operator(empty_like(corpus)).count() == 0


def test_pipeline(spark, corpus, tmp_path):
    documents, labels = labelled(spark, corpus)
    documents.drop("part", "node", "row").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {r["doc_id"] for r in found.collect()}
    assert {1, 2, 3, 4, 5}.isdisjoint(ids) and len(ids & set(range(1000, 1060))) > 50
    assert len(corpus_pipeline.STAGES) == 5


def pairs_left(shard):
    """Uses of each pair of neighbouring symbols in one document; in a run of one symbol every second place."""
    ends, uses, last = set((shard.at[1:].astype(int) - 1).tolist()), Counter(), None
    symbols = shard.symbols.tolist()
    for i in range(len(symbols) - 1):
        if i in ends:
            last = None
            continue
        pair = (symbols[i], symbols[i + 1])
        if pair == last and pair[0] == pair[1]:
            last = None
            continue
        uses[pair] += 1
        last = pair
    return uses


@pytest.mark.parametrize("least", [2, 5, 16])
def test_no_frequent_pair_is_left(least):
    r = np.random.default_rng(least)
    phrase = r.integers(0, 40, 30)
    texts = [np.concatenate([phrase[: r.integers(3, 30)] if r.random() < 0.5 else r.integers(0, 40, 9) for _ in range(20)]) for _ in range(40)] + [np.full(301, 7)]
    shard = grammar.Shard(grammar.pack_shard(list(range(41)), [t.astype("<u4").tobytes() for t in texts], least))
    assert max(pairs_left(shard).values(), default=0) < least
    assert shard.all_ids().tolist() == np.concatenate(texts).tolist()
    for i in (0, 7, 40):
        assert shard.document(i).tolist() == texts[i].tolist()
        assert shard.document(i, 5, 11).tolist() == texts[i][5:16].tolist() and shard.document(i, 10**6).tolist() == []


@pytest.mark.parametrize("piece", [700, 1 << 18])
def test_repeated_strings_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    shared = words(11, 200)
    rows = [(0, words(12, 900) + shared + words(13, 700)), (1, shared[50:700] + words(14, 900)), (2, words(15, 40) + shared[-260:]), (3, shared[:199])]
    data = [t.encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    wanted = {d: int(np.any([np.pad(np.ones(200, bool), (i, len(b) - i - 200)) for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1] or [np.zeros(len(b), bool)], axis=0).sum()) for (d, _), b in zip(rows, data, strict=True)}
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted and wanted[0] > 900 and wanted[3] == 0


@pytest.mark.parametrize("rule", [lines.RULE, lines.WIDE_RULE])
def test_large_and_small_leaves_agree(spark, corpus, rule):
    more = spark.createDataFrame([(500 + i, f"job {i % 7} of host h{i % 3} done\n{words(i, 5)}\njob {i} of host h{i % 3} done") for i in range(60)], "doc_id long, text string")
    table = corpus.select("doc_id", "text").unionByName(more)
    found = [{(r["row"], *sorted(r["drop"])) for r in lines.recurring_lines(table, rule, most).collect()} for most in (4096, 0)]
    assert found[0] == found[1] and len(found[0]) > 40


def test_lines_of_long_texts_in_pieces(spark, monkeypatch):
    rows = [(i, "\n".join(f"{words(50 * i + j, 8)}\nstep {j} of run took long" for j in range(30))) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    whole = lines.dedup_lines(table).orderBy("doc_id").collect()
    monkeypatch.setattr(lines, "PIECE", 300)
    assert lines.dedup_lines(table).orderBy("doc_id").collect() == whole and sum(r["n_dropped"] for r in whole) > 100


CLASH = "__row", "__found", "__lang", "__score", "__gone", "__copies", "row", "lines", "left", "drop", "found", "score", "lang_pred", "gone", "p_good", "n_tokens", "rate", "copies", "one", "present", "words", "c0", "c1"


def test_stages_carry_columns_of_any_name(spark, corpus):
    documents, labels = labelled(spark, corpus)
    table = documents.drop("part", "node", "row").withColumns({c: F.lit(7) for c in CLASH})
    for stage in (lambda t: langid.keep_known(t), lambda t: lines.drop_recurring(t), lambda t: neardup.keep_one(t, 80), lambda t: mixing.mix(t, labels)):
        out = stage(table)
        assert out.columns == table.columns
        assert out.where(" or ".join(f"`{c}` <> 7 or `{c}` is null" for c in CLASH)).count() == 0 and out.count() > 0


@pytest.mark.parametrize("which", ["classifier", "rules", "grammar", "mix"])
def test_empty_tables_of_learners(spark, corpus, which):
    documents, labels = empty_like(corpus), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    if which == "classifier":
        assert classifier.score_documents(documents, labels).count() == 0
    elif which == "rules":
        assert rules.judge(documents, rules.Model(learn.labelled_rows(documents, labels, rules.HASHING))).count() == 0
    elif which == "grammar":
        assert grammar.read_shards(grammar.encode_shards(documents)).count() == 0
    else:
        assert mixing.mix(documents, labels).count() == 0


def test_near_copies_without_doc_id_are_linked(spark):
    base = words(77, 300)
    near = base.split()
    near[10] = "changed"
    table = spark.createDataFrame([(5, base), (None, " ".join(near)), (None, words(78, 50))], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_shingles"], r["component_id"]) for r in neardup.link(table).collect() if r["n_shingles"] > 100)
    assert [g[2] for g in got] == [5, 5]


def test_leaves_stay_small_and_search_is_bounded(spark):
    r = np.random.default_rng(12)
    leaves = {}
    for n in (2000, 8000):
        centres = r.normal(size=(n // 100, 16))
        vectors = centres[r.integers(0, len(centres), n)] + 0.2 * r.normal(size=(n, 16))
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<double>")
        forest, held = neighbours.grow(rows, vectors[:500], 2, 64)
        assert held.sum() == 2 * n and held.max() <= 128
        leaves[n] = forest.leaves
    assert leaves[8000] > 3 * leaves[2000]
    same = spark.createDataFrame([(i, [1.0] * 16) for i in range(900)], "vec_id long, v array<double>")
    assert neighbours.grow(same, np.ones((500, 16)), 2, 64)[1].max() == 900


def test_posteriors_equal_naive_bayes(spark, corpus):
    documents, labels = labelled(spark, corpus)
    model = mixing.fit_domains(documents, labels, ["good", "low"])
    kept = model.first().asDict()
    for r in mixing.with_posteriors(documents.select("doc_id", "text"), model, ["good", "low"]).limit(40).collect():
        present = spark.createDataFrame([(r["text"],)], "text string").select(mixing._present(mixing._words()).alias("p")).first()["p"]
        score = np.array([kept[f"l_{d}"] + sum(kept[f"w_{d}"][b] for b in present) for d in ("good", "low")])
        wanted = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert np.allclose([r["p_good"], r["p_low"]], wanted, atol=1e-9)


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(6)
    rows = learn.Rows(np.concatenate([np.sort(r.choice(12, 4, False)) for _ in range(40)]).astype(np.uint32), np.arange(0, 161, 4), r.integers(0, 2, 40))
    weights, bias = classifier.dual_coordinate_descent(rows, np.ones(12), cost=0.7, epochs=3000)
    x = np.zeros((40, 13))
    for i in range(40):
        x[i, rows.row(i)] = 0.5
    x[:, 12] = 1.0
    sign = np.where(rows.labels == 1, 1.0, -1.0)
    loss = lambda w: w @ w / 2 + 0.7 * np.maximum(0, 1 - sign * (x @ w)).sum()
    best = loss(np.append(weights, bias))
    assert all(loss(np.append(weights, bias) + d) > best - 1e-3 for d in 0.05 * r.normal(size=(300, 13)))


def test_out_of_place_distance_equals_brute_force():
    profiles = langid.Profiles({"aa": [10, 20, 30], "bb": [30, 40]}, 4)
    text = "abab ba"
    own = langid.ranked(*langid.count_ngrams(text), 4).tolist()
    profiles = langid.Profiles({"aa": own[::-1], "bb": own[:2] + [1, 2]}, 4)
    apart = {k: sum(abs(i - p.index(c)) if c in p else 4 for i, c in enumerate(own)) for k, p in {"aa": own[::-1], "bb": own[:2] + [1, 2]}.items()}
    best = min(sorted(apart), key=apart.get)
    assert profiles.predict(text) == (best, 1 - apart[best] / (4 * len(own)))
