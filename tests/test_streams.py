"""Streams over many files and batches, and what a stream and the batch operator have to agree on."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspan.functions import fixed
from veilspan.operators import guard, routing, sweep
from veilspan.plans import streams
from veilspan.streaming import limits, rehydrate

SAID = [
    "call 415-555-1234", "ssn 123-45-6789", "4111 1111 1111 1111", "a.b@mail.org", "@handle_1", "10.2.3.4", "March 3, 1990", "10:30 p.m.", "City: Lisbon\n",
    "<name>Zed. Ann ok</name>", "P. O. Box 123", "Dubai", "Dubai 12345", "password: secret99", "My email is not x@y.org.", "I no longer live at 9 Elm Road.", "Dr. Smith",
    "<EMAIL_PII_0123456789>", "<X_PII_aaaaaaaaaa>", "e.g. this", "word here", "It works", "5", "...", "j o h n @ m a i l . c o m", "naïve",
]


def replies(count):
    r = random.Random(count)
    return ["".join(r.choice(SAID) + r.choice([" ", ". ", ". ", ". ", "! ", "? ", ".\n", ", "]) for _ in range(r.randint(1, 20))) for _ in range(count)]


def in_chunks(scan, text, size, values):
    before, held, closed, out, missing = "", "", set(), "", 0
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    for i, piece in enumerate(pieces):
        held += piece
        upto = len(held) if i == len(pieces) - 1 else rehydrate.releasable(held)
        shown, fresh = scan.part(before, held, upto, "s") if upto else ("", [])
        closed.update(fresh)
        done, n = rehydrate.resolved(shown, values, closed)
        out, missing = out + done, missing + n
        before, held = rehydrate.kept_before(before + held[:upto]), held[upto:]
    return out, missing


@pytest.mark.parametrize("size", [1, 4, 64])
@pytest.mark.parametrize("name", sorted(fixed.POLICIES))
def test_scanned_in_chunks_as_whole(size, name):
    scan = rehydrate.Scan(fixed.POLICIES[name], "k", suppress_context=True)
    for text in replies(150):
        shown, minted = scan.part("", text, len(text), "s")
        assert in_chunks(scan, text, size, {"0123456789": "v"}) == rehydrate.resolved(shown, {"0123456789": "v"}, set(minted))


def test_a_streamed_scan_is_the_batch_scan(spark):
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(replies(80))], "id long, text string, session string")
    batch = guard.scan_output(rows, fixed.POLICIES["default"], session="session", secret="k", ner=False, suppress_context=True)
    scan = rehydrate.Scan(fixed.POLICIES["default"], "k", suppress_context=True)
    for r in batch.collect():
        shown, minted = scan.part("", r["text"], len(r["text"]), "s")
        assert shown == r["shown"] and set(minted) == set(r["output_ids"])


def test_the_scan_stream_releases_early(spark):
    text = "Hello to you all. Write to ann@x.org about it. " + "Some more words follow here. " * 6
    pieces = [text[i : i + 16] for i in range(0, len(text), 16)]
    rows = spark.createDataFrame([("r", i, "s", p, i == len(pieces) - 1, [], []) for i, p in enumerate(pieces)], "request_id string, chunk_no int, session_id string, piece string, last boolean, token_ids array<string>, values_ array<string>")
    scan = rehydrate.Scan(fixed.POLICIES["default"], "k", suppress_context=True)
    got = sorted((r["chunk_no"], r["released"]) for r in streams._run(spark, rehydrate.scan_stream(streams._as_stream(spark, rows), scan)).collect())
    whole = "".join(p for _, p in got)
    assert whole == scan.part("", text, len(text), "s")[0] and "ann@x.org" not in whole
    assert sum(bool(p) for _, p in got) > 1 and got[-1][1] != whole


def calls(spark, seed, rows=600, keys=3):
    r = random.Random(seed)
    at, made = 1.7e9, []
    for i in range(rows):
        at += r.choice([0, 0.2, 0.5, 1, 1, 2, 5, 40])
        made.append((str(r.randrange(keys)), i, at, r.random() < 0.5))
    return spark.createDataFrame(made, "key string, id long, at double, failed boolean").withColumn("ts", F.timestamp_seconds("at"))


def serial(rows, rule):
    """(key, id) -> what the rule says, along each key's order."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
        own = state.setdefault(r["key"], {} if isinstance(rule, routing.Bucket) else routing.Breaker.start())
        out[r["key"], r["id"]] = rule.step(own, r["at"]) if isinstance(rule, routing.Bucket) else rule.step(own, r["at"], r["failed"])
    return out


@pytest.mark.parametrize("keys", [1, 4])
def test_segments_equal_the_serial_fold(spark, keys):
    rows = calls(spark, keys, 1500, keys)
    bucket = routing.bucketed(rows, "key", ["at", "id"], "at", 0.5, 4.0).collect()
    wanted = serial(rows.collect(), routing.Bucket(0.5, 4.0))
    assert {(r["key"], r["id"]): (r["allowed"], r["tokens"], r["retry_after_ms"]) for r in bucket} == wanted
    guarded = routing.guarded(rows, "key", ["at", "id"], "at", "failed", 2, 8.0).collect()
    assert {(r["key"], r["id"]): (r["state"], r["allowed"]) for r in guarded} == serial(rows.collect(), routing.Breaker(2, 8.0))
    parts = routing.segmented(rows, "key", ["at", "id"], "at", 8.0).select("segment").distinct().count()
    assert parts > 20 * keys


def test_edges_of_buckets_and_breakers(spark):
    rows = spark.createDataFrame([("k", i, float(t), f) for i, (t, f) in enumerate([(0, True), (0, True), (1, False), (40, True), (41, False), (80, False), (80, None)])], "key string, id long, at double, failed boolean")
    got = [(r["state"], r["allowed"]) for r in routing.guarded(rows, "key", ["at", "id"], "at", "failed", 2, 30.0).orderBy("id").collect()]
    assert got == [("closed", True), ("closed", True), ("open", False), ("half_open", True), ("open", False), ("half_open", True), ("closed", True)]
    assert [r["allowed"] for r in routing.bucketed(rows.where("id < 4"), "key", ["at", "id"], "at", 1.0, 2.0).orderBy("id").collect()] == [True, True, True, True]
    assert routing.bucketed(rows.where("false"), "key", ["at", "id"], "at", 1.0, 2.0).collect() == []


def test_streams_over_many_batches_equal_the_batch_operators(spark):
    rows = calls(spark, 9)
    ended, folder = streams._ended(rows.select("key", "id", "at", "ts", "failed")), streams._folder(spark)
    ended.where(F.col("key") != streams._END).repartition(6, F.xxhash64("id") % 6).write.parquet(folder)  # files out of order of time
    ended.where(F.col("key") == streams._END).write.mode("append").parquet(folder)

    def read():
        return spark.readStream.schema(ended.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    assert streams._run(spark, limits.limit_stream(read(), 0.5, 4.0, "30 days")).collect() == []  # all within the delay
    own = lambda found: [r for r in found.collect() if r["key"] != streams._END]
    limited = own(streams._run(spark, limits.limit_stream(read(), 0.5, 4.0, "12 hours")))
    assert {(r["key"], r["id"]): (r["allowed"], r["tokens"], r["retry_after_ms"]) for r in limited} == serial(rows.collect(), routing.Bucket(0.5, 4.0))
    guarded = own(streams._run(spark, limits.guard_stream(read(), 2, 8.0, "12 hours")))
    assert {(r["key"], r["id"]): (r["state"], r["allowed"]) for r in guarded} == serial(rows.collect(), routing.Breaker(2, 8.0))


class Values:
    """A store of values and lists, with its timers."""

    def __init__(self):
        self.kept, self.timers = {}, []

    def getListState(self, name, schema):
        return self.kept.setdefault(name, Rows())

    getValueState = getListState

    def getMapState(self, name, key, value):
        return self.kept.setdefault(name, Rows())

    def registerTimer(self, due):
        self.timers.append(due)

    def deleteTimer(self, due):
        self.timers.remove(due)

    def getCurrentWatermarkInMs(self):
        return self.now


class Rows:
    def __init__(self):
        self.rows, self.value, self.map = [], None, {}

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value

    def appendValue(self, row):
        self.rows.append(row)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows) if self.rows else self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.rows, self.value = [], None


def test_waiting_rows_of_a_group_are_one_value_a_batch():
    made = [(i * 1000, float(i), i, None if i % 7 == 0 else i % 3 > 0, ("a", "b", None)[i % 5 % 3]) for i in range(500)]
    random.Random(1).shuffle(made)
    store, guard_, got = Values(), limits.Guard(2, 8.0), {}
    guard_.init(store)
    for part in (made[:200], made[200:]):
        list(guard_.handleInputRows((0,), iter([pd.DataFrame(part, columns=["due_ms", "at", "id", "failed", "key"])]), None))
    assert len(store.kept["waiting"].rows) == 2 and store.timers == [0]
    for store.now in (250_500, 10**9):  # the first leaves rows that wait on
        store.timers.clear()
        for out in guard_.handleExpiredTimer((0,), store, None):
            for key, *row in out.itertuples(index=False):
                got.setdefault(key, []).append(tuple(row))
        assert len(store.kept["waiting"].rows) == len(store.timers) == (store.now < 10**6)
    assert set(got) == {"a", "b", None}
    for key, rows in got.items():
        breaker, state = routing.Breaker(2, 8.0), routing.Breaker.start()
        assert rows == [(i, *breaker.step(state, at, bool(failed))) for _, at, i, failed, own in sorted(made, key=lambda r: r[0]) if own == key]


def test_cuts_are_ends_of_sentences():
    text = "Mr. Lee met Dr. Ray at noon. They left! It was 5. Then (ok). Fine"
    assert [text[c:] for c in rehydrate.safe_cuts(text)] == ["They left! It was 5. Then (ok). Fine", "It was 5. Then (ok). Fine"]
    assert set(rehydrate.safe_cuts(text)) <= {e for _, e in sweep.sentences_in(text)}


class Store:
    """A list state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):
        self.put([])


def group_rows(texts, size):
    """Rows of one group as its processor gets them, by batch: the first chunks of all replies, then the others, out of order."""
    rows = []
    for n, text in enumerate(texts):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        first = json.dumps({"token_ids": ["0123456789"], "values_": ["v"]})
        rows += [{"part": 0, "request_id": str(n), "chunk_no": i, "session_id": "s", "piece": p, "last": i == len(pieces) - 1, "entries": None if i else first} for i, p in enumerate(pieces)]
    frame = pd.DataFrame(rows)
    return [part.iloc[::-1] for part in (frame[frame.chunk_no < 9], frame[frame.chunk_no >= 9])]


def test_a_group_of_replies_takes_few_calls_and_one_scan_a_batch():
    scan, store, texts = rehydrate.Scan(fixed.POLICIES["default"], "k", suppress_context=True), Store(), replies(60)
    scans, edits = [], scan.edits
    scan.edits = lambda *args: scans.append(args) or edits(*args)
    processor, got = rehydrate.Scanner(scan), {}
    processor.init(store)
    for frame in group_rows(texts, 8):
        for out in processor.handleInputRows((0,), iter([frame]), None):
            for r in out.itertuples():
                got.setdefault(r.request_id, []).append((r.chunk_no, r.released, r.unresolved))
    assert store.calls <= 4 and store.rows == [] and len(scans) <= 2 * len(texts)
    for n, text in enumerate(texts):
        rows = sorted(got[str(n)])
        wanted, missing = in_chunks(scan, text, 8, {"0123456789": "v"})
        assert ("".join(r[1] for r in rows), sum(r[2] for r in rows)) == (wanted, missing)
        assert len(rows) == -(-len(text) // 8)


def test_replies_leave_the_state_when_all_their_chunks_have_come():
    processor, store = rehydrate.Rehydrator(), Store()
    processor.init(store)
    row = lambda no, piece, last: {"part": 0, "request_id": "r", "chunk_no": no, "session_id": "", "piece": piece, "last": last, "entries": None if no else '{"token_ids":["0123456789"],"values_":["v"],"output_ids":[]}'}
    told = []
    for batch in ([row(0, "a <X_PII_01", False)], [row(2, " <X_PII_0123456789>", True)], [row(1, "23456789> b", False)]):  # the last chunk comes before another
        told += [r for out in processor.handleInputRows((0,), iter([pd.DataFrame(batch)]), None) for r in zip(out.chunk_no, out.released)]
        assert bool(store.rows) == (len(told) < 3)
    assert told[0] == (0, "a ") and told[1][1].endswith(" v")


@pytest.mark.parametrize("opened", [True, False])
def test_replies_over_many_batches_are_those_of_one(spark, opened):
    scan, texts = rehydrate.Scan(fixed.POLICIES["default"], "k", suppress_context=True), replies(25)
    made = [(str(n), i, "s", text[i * 8 : i * 8 + 8], i * 8 + 8 >= len(text), [] if i else ["0123456789"], [] if i else ["v"], []) for n, text in enumerate(texts) for i in range(-(-len(text) // 8))]
    rows = spark.createDataFrame(made, "request_id string, chunk_no int, session_id string, piece string, last boolean, token_ids array<string>, values_ array<string>, output_ids array<string>").drop(*([] if opened else ["output_ids"]))
    folder = streams._folder(spark)
    for a, b in ((0, 5), (5, 12), (12, 10**6)):
        rows.where(F.col("chunk_no").between(a, b - 1)).coalesce(1).write.mode("append").parquet(folder)

    def run(source):
        found = streams._run(spark, rehydrate.rehydrate_stream(source) if opened else rehydrate.scan_stream(source, scan))
        return {(r["request_id"], r["chunk_no"]): (r["released"], r["unresolved"]) for r in found.collect()}

    many = run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    assert many == run(streams._as_stream(spark, rows)) and len(many) == len(made)
    for n, text in enumerate(texts):
        whole = "".join(many[k][0] for k in sorted(many) if k[0] == str(n))
        assert whole == (rehydrate.resolved(text, {"0123456789": "v"})[0] if opened else in_chunks(scan, text, 8, {"0123456789": "v"})[0])
