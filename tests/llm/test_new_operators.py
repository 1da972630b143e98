"""Operators 11 to 13 against brute force, on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import codes, fim, ngramjoin

DOCS = "doc_id long, text string, n long, node string, column string, form string, n_ string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def changed(text: list[str], seed: int, n: int) -> list[str]:
    r, out = random.Random(seed), list(text)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{seed}x{i}"
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    """Near copies at and around the bound, chains, nulls, blanks, repeats, a long text; columns with clashing names."""
    base, long, shared = words(1, 300), words(2, 6000), words(3, 80)
    rows = [(i, " ".join(changed(base, i, k))) for i, k in enumerate((0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20))]
    step = base
    for i in range(12):  # each like the one before it only
        step = changed(step, 100 + i, 4)
        rows.append((20 + i, " ".join(step)))
    rows += [(40, None), (41, ""), (42, " \n\t"), (43, "one two"), (44, "ONE  two"), (45, "one two three"), (46, "É é É"), (47, "é é é")]
    rows += [(50, " ".join(long)), (51, " ".join(changed(long, 7, 40))), (51, " ".join(changed(long, 7, 40))), (52, " ".join(long[:5800]))]
    rows += [(60 + i, " ".join(words(200 + i, 60) + shared)) for i in range(30)]  # unlike texts with one passage
    rows += [(100 + i, " ".join(changed(words(4, 120), 300 + i, 1))) for i in range(40)]  # a group of near copies
    rows += [(None, " ".join(base)), (None, " ".join(words(9, 40)))]
    rows += [(200, " ".join(words(10, 12))), (201, " ".join(words(10, 12)[:-1])), (202, " ".join([*words(10, 12), "x", "y"]))]
    rows += [(210, "<P> here"), (211, "a <M>"), (212, "\x85 \x1c x \x0b\x0cy  "), (213, "<<S x< P>"), (214, "   ")]
    return spark.createDataFrame([(d, t, 1, "a", "b", "c", "d") for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.collect()]


def components(texts, percent, size):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()

    sets = [grams(t) for _, t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(texts, sets, strict=True))), key=repr)


@pytest.mark.parametrize(("percent", "rounds", "weight"), [(90, 4, 1 << 20), (90, 0, 1 << 14), (75, 1, 1 << 12), (100, 4, 1 << 20)])
def test_ngram_join_equals_all_pairs(corpus, texts, monkeypatch, percent, rounds, weight):
    monkeypatch.setattr(ngramjoin, "ROUNDS", rounds)
    monkeypatch.setattr(ngramjoin, "BLOCK_WEIGHT", weight)
    monkeypatch.setattr(ngramjoin, "ROW_WEIGHT", 256)
    got = [tuple(r) for r in ngramjoin.join(corpus, percent).collect()]
    assert sorted(got, key=repr) == components(texts, percent, 3)


def test_blocks_are_a_product(monkeypatch):
    monkeypatch.setattr(ngramjoin, "SLICE", 16)
    r = np.random.default_rng(5)
    left, right = ([np.unique(r.integers(0, 90, r.integers(1, 80))) for _ in range(12)] for _ in range(2))
    right[3], right[4] = left[2], left[5][:-1]
    found = ngramjoin.overlaps(left, right, 80)
    whole = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left])
    wanted = ngramjoin.least_overlap(np.array([[len(a)] for a in left]), np.array([[len(b) for b in right]]), 80)
    assert ((found >= wanted) == (whole >= wanted)).all() and (found <= whole).all() and (found[whole >= wanted] == whole[whole >= wanted]).all()


def test_parities_never_differ_more_than_sets():
    r = np.random.default_rng(6)
    for n in (1, 10, 500, 3000):
        a = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate((a[n // 20 :], r.integers(-(1 << 62), 1 << 62, n // 10))))
        pair = [ngramjoin.parity(x) for x in (a, b)]
        size = min(map(len, pair))
        x, y = (ngramjoin.parities([p], size) for p in pair)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("size", [1, 2, 19, 20, 21, 99, 100, 101, 1000, 12345])
def test_bounds_of_sizes(size):
    for percent in (75, 80, 90, 100):
        other = next(n for n in range(1, size + 1) if 100 * n >= percent * size)
        assert all(ngramjoin.least_overlap(size, n, percent) >= size - ngramjoin.prefix_length(size, percent) + 1 for n in (other, size))


def cut(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_fill_in_middle(corpus, texts, monkeypatch, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    wanted = []
    for d, t in texts:
        t = t or ""
        tokens = cut(t)
        n = len(tokens)
        h = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
        a, b, c, e = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        low, high = sorted((a % (n + 1), b % (n + 1)))
        p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
            wanted.append((d, n, "plain", None, None, t, t))
        elif e % 100 < 80:
            wanted.append((d, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            wanted.append((d, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    got = [tuple(r) for r in fim.transform(corpus).withColumn("back", fim.restored()).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert {w[2] for w in wanted} == {"plain", "spm", "psm"}


def test_own_sentinels_and_rates(spark):
    rows = spark.createDataFrame([(i, f"a{i} (b) [c] {{d}} <M>") for i in range(60)], "doc_id long, text string")
    plan = fim.Plan(seed=7, rate=100, suffix_first=50, prefix="|pre>", suffix="|suf>", middle="|mid>")
    got = fim.transform(rows, plan).withColumn("back", fim.restored(plan=plan)).join(rows, "doc_id").collect()
    assert {r["form"] for r in got} == {"psm", "spm"} and all(r["back"] == r["text"] for r in got)
    with pytest.raises(ValueError, match="sentinels"):
        fim.Plan(prefix="ab", suffix="b", middle="c")


VECTORS = "vec_id long, embedding array<float>, label int, code string, vector string, entry string"


def lloyd(rows, entries, parts=4, rounds=4):
    """Every distance, in Python's integers."""
    kept = [(v, l, [int(np.floor(1024 * float(x))) for x in e]) for v, e, l in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    w = len(kept[0][2]) // parts
    part = lambda q, p: q[p * w : (p + 1) * w]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    smallest = {}
    for v, _, q in kept:
        if v is not None:
            smallest[v] = min(smallest.get(v, q), q)
    books = [[list(part(smallest[v], p)) for v in sorted(smallest)[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        found = [[min((far(part(q, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, _, q in kept]
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [part(q, p) for (_, _, q), f in zip(kept, found, strict=True) if f[p][1] == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(v, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (v, _, _), f in zip(kept, found, strict=True)], digest


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    middle = r.normal(size=(9, 8)).round(2)
    rows = [(i * 3, [float(np.float32(x)) for x in middle[i % 9] + r.normal(size=8).round(1) / 4], None if i % 7 == 0 else i % 4) for i in range(150)]
    rows += [(1000 + i, rows[5][1], 9) for i in range(30)] + [rows[8], rows[8]]  # one common vector, repeated rows
    rows += [(2000, None, 1), (2001, [1.0] * 7 + [None], 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, 1), (None, [0.5] * 8, 2), (2004, [0.0] * 8, 2)]
    return rows


@pytest.mark.parametrize(("entries", "scale"), [(16, 1), (256, 1), (16, 100_000)])
def test_codes_equal_lloyd(spark, vectors, monkeypatch, entries, scale):
    monkeypatch.setattr(codes, "ENTRIES", entries)
    rows = [(v, e and [x if x is None else float(np.float32(x * scale)) for x in e], l) for v, e, l in vectors]
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)
    coded, books = codes.compress(table)
    wanted, digest = lloyd(rows, entries)
    got = [(r["vec_id"], bytes(r["code"]).hex(), r["error"]) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and books.sha256() == digest


def test_bounds_spare_distances_and_ties_stay_exact():
    r = np.random.default_rng(8)
    x = np.floor(r.normal(size=(2000, 4)) * 40 + r.integers(0, 6, (2000, 1)) * 400)
    entries = x[:64].copy()
    entries[10] = entries[3]
    state, before, computed = codes.Bounds.none(len(x), 64), None, []
    for _ in range(5):
        books = codes.Books([entries], before)
        if before is not None:
            state = codes.Bounds.unpacked(*state.packed())
            state.shift(books.moved[0])
        best, n = state.assign(x, entries, books.apart[0], True)
        exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (state.entry == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
        computed.append(n)
        before, entries = books, np.array([np.floor(x[state.entry == e].mean(axis=0)) if (state.entry == e).any() else entries[e] for e in range(64)])
    assert computed[-1] < 0.2 * computed[0]


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0] * 5, 1), (3, [2.0] * 3, 1), (4, [3e6] * 5, 1), (5, [], 1)]
    coded, books = codes.compress(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS))
    assert sorted(r["vec_id"] for r in coded.collect()) == [1, 2] and [e.shape for e in books.entries] == [(2, 2), (2, 1), (2, 1), (2, 1)]


@pytest.mark.parametrize("empty", ["documents", "embeddings"])
def test_empty_tables(spark, corpus, empty):
    if empty == "documents":
        none = corpus.where("false")
        assert ngramjoin.join(none).collect() == fim.transform(none).collect() == []
    else:
        coded, books = codes.compress(spark.createDataFrame([], VECTORS))
        assert coded.collect() == [] and books is None


def test_label_errors_are_summed_with_nulls_together(spark, vectors, tmp_path):
    spark.createDataFrame([(*r, "a", "b", "c") for r in vectors], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codes.query(spark, str(tmp_path)).join(spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", "label").distinct(), "vec_id").collect()
    of_label = {}
    for r in got:
        of_label.setdefault(r["label"], []).append(r)
    assert None in of_label and all(len({r["label_error"] for r in rows}) == 1 for rows in of_label.values())
    errors = codes.compress(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))[0].groupBy("label").agg(F.sum("error").alias("e")).collect()
    assert {r["label"]: r["e"] for r in errors} == {k: v[0]["label_error"] for k, v in of_label.items()}
