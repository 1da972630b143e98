"""Stored tables, ranks and interval joins."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import ranks, spans, stored


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    first, second = rows(("a", 1), ("b", 1), ("b", 2), (None, 1), (None, 2)), rows(("b", 3), ("c", 3), (None, 3))
    read = lambda: sorted((r["k"] or "", r["v"], r["batch_id"]) for r in stored.stored(spark, path, "k string, v int").collect())
    stored.insert_or_ignore(first, path, ["k"], 0, ["v"])
    stored.insert_or_ignore(second, path, ["k"], 1, ["v"])
    wanted = [("", 1, 0), ("a", 1, 0), ("b", 1, 0), ("c", 3, 1)]
    assert read() == wanted
    stored.insert_or_ignore(first, path, ["k"], 0, ["v"])
    stored.insert_or_ignore(second, path, ["k"], 1, ["v"])
    assert read() == wanted
    stored.insert_or_ignore(first.where("false"), path, ["k"], 2)
    assert read() == wanted and stored.stored(spark, f"{path}-none", "k string").count() == 0


def test_refused_records_tell_why(spark):
    rows = spark.createDataFrame([("a", "e", "g"), (None, "e", "g"), ("b", "", "g"), ("c", "e", None), (None, None, "")], "id string, event string, origin string")
    assert [r["refused"] for r in stored.validated(rows, ["id", "event"], "origin").collect()] == [None, "malformed: id", "malformed: event", "no origin", "malformed: id,event"]


def test_key_events(spark):
    keys = spark.createDataFrame([("local", True, None), ("gone", False, None)], "key_id string, active boolean, origin_gateway string")
    sent = [("1", "created", "new", "g", 1), ("1", "created", "new", "g", 1), ("2", "created", "local", "g", 1), ("3", "revoked", "early", "g", 1), ("4", "created", "early", "g", 2), ("5", "created", "late", "h", 1), ("6", "revoked", "late", "h", 2), ("7", "created", "gone", "g", 3), ("8", "revoked", "nobody", "g", 3)]
    got = {r["key_id"]: (r["active"], r["origin_gateway"]) for r in stored.apply_key_events(keys, spark.createDataFrame(sent, "event_id string, event_type string, key_id string, gateway_id string, at int"), F.col("at")).collect()}
    assert got == {"local": (True, None), "gone": (False, None), "new": (True, "g"), "early": (True, "g"), "late": (False, "h")}


@pytest.mark.parametrize("few", [1, 10, 1 << 16])
def test_ranks_of_any_spread(spark, few):
    r = random.Random(7)
    groups = {"even": [float(i) for i in range(500)], "ties": [5.0] * 300 + [7.0], "outlier": [r.random() for _ in range(400)] + [1e12], "one": [3.0], None: [r.lognormvariate(0, 4) for _ in range(300)]}
    rows = spark.createDataFrame([(g, v) for g, values in groups.items() for v in r.sample(values, len(values))] + [("even", None), ("none", None)], "g string, v double")
    shares = {"least": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0}
    got = {(x["g"], x["name"]): x["found"] for x in ranks.at_ranks(rows, "g", "v", shares, few).collect()}
    assert got == {(g, n): sorted(v)[min(int(len(v) * p), len(v) - 1)] for g, v in groups.items() for n, p in shares.items()}
    assert ranks.at_ranks(rows.where("false"), "g", "v", shares, few).count() == 0


@pytest.mark.parametrize("size", [1, 16, 1024])
def test_overlaps_equal_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(spans, "BIN", size)
    r = random.Random(size)
    made = [(u, i, s, s + r.choice([0, 1, 3, 10, 90]), r.choice("xy")) for u in (1, 2, None) for i, s in enumerate(r.randrange(200) for _ in range(40))]
    rows = spark.createDataFrame([*made, made[0]], "unit int, ord int, start int, end int, label string")
    left, right = rows.where("label = 'x'"), rows.where("label = 'y'")
    hit = lambda a, b: a[0] is not None and a[0] == b[0] and a[2] < b[3] and b[2] < a[3]
    x, y = ([m for m in [*made, made[0]] if m[4] == c] for c in "xy")
    got = sorted((p["unit"], p["ord"], p["r_ord"]) for p in spans.overlapping(left, right, "unit").collect())
    assert got == sorted((a[0], a[1], b[1]) for a in x for b in y if hit(a, b))
    alone = sorted(((p["unit"] or 0, p["ord"]) for p in spans.without_overlap(left, right, "unit").collect()))
    assert alone == sorted((a[0] or 0, a[1]) for a in x if not any(hit(a, b) for b in y))


CSV = [
    'a,b\n"x\ny",2\n\n , \n"q""uote, and\n\nmore",""\nplain 5" pipe,"z"\n"tail',
    '"all\nin\none\ncell"\n,\n"","",\n  lead, trail  ,"in ""side"" "\n"closed" then,"open\nagain" more\n',
    "\n\nx\n",
    'é,"ü\nß"\n' * 30,
]


@pytest.mark.parametrize("block", [7, 16, 1 << 20])
def test_csv_records_equal_a_csv_reader(spark, tmp_path, block):
    import csv
    import io

    from veilspan.sources import files

    for i, text in enumerate(CSV):
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = files.csv_records(files.read_csv_lines(spark, str(tmp_path)))
        forms = [files.csv_units(records, gateway=g).collect() for g in (False, True)]
        got = [sorted((int(r["file"][-5]), r["location"], r["text"]) for r in form) for form in forms]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    read = [(f, i, row) for f, text in enumerate(CSV) for i, row in enumerate(csv.reader(io.StringIO(text, newline="")))]
    assert got[0] == sorted((f, f"row[{i}]", "\t".join(row)) for f, i, row in read if "\t".join(row).strip())
    assert got[1] == sorted((f, f"row {i + 1}", " ".join(row)) for f, i, row in read if any(row))
