import datetime as dt
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.operators import orphans, rolling, schema_drift
from quaymark.plans import catalog
from quaymark.sources.tables import canonical_id, load

DAY = dt.date(2025, 1, 1)


def roll(spark, rows, **kw):
    df = spark.createDataFrame(rows, "e string, day date, a long, b int, a_sum_7d string")
    return rolling.rolling_totals(df, "e", "day", ["a"], **kw).collect()


@pytest.mark.parametrize("tile", [29, 64, 365])
def test_rolling_against_brute_force(spark, tile):
    rng = random.Random(tile)
    rows, by = [], {}
    for e in ("x", "y", None):
        for k in sorted(rng.sample(range(300), 12)):
            v = rng.choice([0, 5, None, -3, 10**12])
            rows.append((e, DAY + dt.timedelta(k), v, 1, "clash"))
            by.setdefault(e, {})[k] = v or 0
    got = roll(spark, rows, tile_days=tile)
    assert len(got) == sum(max(d) - min(d) + 1 for d in by.values())
    for r in got:
        k = (r["day"] - DAY).days
        for w in (7, 30):
            want = sum(by[r["e"]].get(i, 0) for i in range(k - w + 1, k + 1))
            assert r[f"a_sum_{w}d"] == want and r[f"a_avg_{w}d"] == pytest.approx(want / w)


def test_rolling_with_a_null_among_numeric_entities_over_batches(spark):
    rows = [(e, DAY + dt.timedelta(k), k, 1, "") for e in (1, 2, None) for k in range(0, 90, 2)]
    df = spark.createDataFrame(rows, "e long, day date, a long, b int, a_sum_7d string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = rolling.rolling_totals(df, "e", "day", ["a"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3 * 89 == len({(r["e"], r["day"]) for r in got})
    for r in got:
        k = (r["day"] - DAY).days
        assert r["a_sum_7d"] == sum(i for i in range(max(0, k - 6), k + 1) if i % 2 == 0)


def test_rolling_edges(spark):
    assert roll(spark, []) == []
    assert roll(spark, [("x", None, 1, 1, "")]) == []
    with pytest.raises(ValueError):
        rolling.band(30, 29, 10) is not None and roll(spark, [], tile_days=10)
    assert (rolling.band(3, 2, 2) == np.array([[1, 0], [1, 1], [1, 1], [0, 1]])).all()


def test_count_once(spark):
    df = spark.createDataFrame([("a", 1, 2, 5), ("a", 1, 1, 7), ("a", None, 3, 9), ("a", None, 4, 9)], "k string, j int, id long, v int")
    assert sorted(r["v"] for r in rolling.count_once(df, ["k", "j"], "id", ["v"]).collect()) == [7, 9, 9]


def refs(spark, rows, parents, **kw):
    t = lambda x: None if x is None else dt.datetime(2025, 1, x)
    r = spark.createDataFrame([(i, k, t(a), 1) for i, (k, a) in enumerate(rows)], "id long, k string, at timestamp_ntz, deleted int").withColumn("k", canonical_id("k"))
    p = spark.createDataFrame([(k, t(c), t(d)) for k, c, d in parents], "k string, c timestamp_ntz, d timestamp_ntz").withColumn("k", canonical_id("k"))
    one = orphans.Reference("t", "k", r, F.col("id"), [F.col("k")], F.col("at"), p, [F.col("k")], F.col("c"), F.col("d"))
    found = orphans.find_orphans([one], **kw)
    return found, {x["src_id"]: x["orphan_kind"] for x in found.collect()}


@pytest.mark.parametrize("group", [2, 100_000])
def test_orphans(spark, group):
    rows = [("A", 5), (" {a} ", 5), ("b", 5), ("c", 5), ("c", 9), ("d", 5), (None, 5), ("  ", 5), ("e", None), ("b", None), ("A", 5)] + [("a", 5)] * 20 + [("zz", 5)] * 5
    parents = [("a", 1, None), ("b", 1, 5), ("c", 9, None), ("d", 1, 3), ("d", 2, None), ("f", None, None)]
    found, got = refs(spark, rows, parents, rows_per_group=group)
    want = {2: "deleted", 3: "late", 8: "missing"} | {31 + i: "missing" for i in range(5)}
    assert got == want
    report = {(r["orphan_kind"], r["period_utc"]): r["n_rows"] for r in orphans.orphan_report(found).collect()}
    assert report[("missing", "2025-01-05")] == 5 and report[("missing", None)] == 1


def test_orphans_of_empty_tables(spark):
    assert refs(spark, [], [("a", 1, None)])[1] == {}
    assert refs(spark, [("a", 1)], [])[1] == {0: "missing"}


def changes(spark, files):
    df = spark.createDataFrame([(i, line, seq, text, 0) for i, (line, seq, text) in enumerate(files)], "file_id long, line string, seq int, raw string, path int")
    tagged = schema_drift.tagged_files(df, "line", "seq", "file_id", "raw")
    rows = schema_drift.schema_changes(tagged).collect()
    return tagged, {(r["file_id"], r["field_path"], r["change_kind"]) for r in rows}


def brute(files):
    lines, out = {}, set()
    for i, (line, seq, text) in enumerate(files):
        tags = schema_drift.tag_fields(text, "meta", ("meta.cost_per_1k_input_usd",))
        if line is not None and seq is not None and tags is not None:
            lines.setdefault(line, {}).setdefault(seq, (i, tags))
    for by_seq in lines.values():
        last, seen = None, {}
        for seq in sorted(by_seq):
            i, tags = by_seq[seq]
            now = {p: (t, v) for p, t, v in tags}
            if last is not None:
                new, gone = set(now) - set(last), set(last) - set(now)
                used = set()
                for p in new:
                    olds = [q for q in gone if now[p][0] is not None and last[q] == now[p]]
                    used.update(olds)
                    out.add((i, p, "renamed" if olds else "added"))
                out.update((i, q, "removed") for q in gone - used)
                out.update((i, p, "retyped") for p in set(now) & set(last) if now[p][0] and seen.get(p) and seen[p] != now[p][0])
            seen = {p: t or (seen.get(p) if last is not None and p in last else None) for p, (t, _) in now.items()}
            last = now
    return out


def test_schema_changes(spark):
    rng = random.Random(4)
    files = []
    for line in ("a", "b", None):
        for seq in range(30):
            meta = {k: rng.choice([None, 1, 1.0, "x", True, [1], {"in": rng.choice([1, "y", None])}]) for k in rng.sample(["alpha", "Alpha", "k", "v", "w"], rng.randint(0, 4))}
            meta["cost_per_1k_input_usd"] = {"m": rng.random()}
            text = json.dumps({"meta": meta})
            files.append((line, seq, rng.choice([text, "﻿ " + text + "\n", text, text[:-9], None, ""])))
            if rng.random() < 0.2:
                files.append((line, seq, text))
    tagged, got = changes(spark, files)
    assert got == brute(files)
    read = schema_drift.readable_files(tagged)
    names = schema_drift.rename_map(schema_drift.schema_changes(tagged), read)
    want = {}
    for r in read.collect():
        for f in r["fields"]:
            one = want.setdefault((f["path"], f["type"]), [0, r["seq"], r["seq"]])
            want[(f["path"], f["type"])] = [one[0] + 1, min(one[1], r["seq"]), max(one[2], r["seq"])]
    assert {(r["path"], r["type"]): [r["n_files"], r["first_seq"], r["last_seq"]] for r in schema_drift.union_types(schema_drift.fused_unions(tagged)[0]).collect()} == want
    table = schema_drift.unified_table(read, names)
    assert table.count() == read.count() and "alpha" in table.columns


def test_a_rename_of_one_line_joins_its_columns(spark):
    meta = [{"alpha": 1.5}, {"beta": 1.5}, {"beta": 2.5, "x": 7}, {"x": 8, "y": 7}, {"x": 9, "v": 3}, {"x": 9, "p": 3, "q": 3}]
    files = [("a", i, json.dumps({"meta": m})) for i, m in enumerate(meta)]
    # x and y hold values together: equal by chance; p and q both come from v: unclear
    files += [("b", 0, json.dumps({"meta": {"x": 4}})), ("b", 1, json.dumps({"meta": {"y": 4}}))]
    tagged, _ = changes(spark, files)
    read = schema_drift.readable_files(tagged)
    names = schema_drift.rename_map(schema_drift.schema_changes(tagged), read)
    by = {p.rpartition(".")[2]: f for p, f in names.items()}
    assert by["alpha"] == by["beta"] and len({by[c] for c in "xyvpq"}) == 5
    rows = {(r["line"], r["seq"]): r for r in schema_drift.unified_table(read, names).collect()}
    assert [rows["a", i][by["alpha"]] for i in range(3)] == [1.5, 1.5, 2.5]


def test_perturb_keeps_all_variants_and_the_whole_text(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in load(spark, sf, "documents", "doc_id", "text").where("text is not null").collect()}
    got = {}
    for r in catalog.QUERIES["perturb"](spark, sf).collect():
        got.setdefault(r["doc_id"], {})[r["i"]] = r["k"]
    assert got.keys() == texts.keys() and max(map(len, texts.values())) > 40
    for k, t in texts.items():
        assert got[k] == {i: hashlib.sha256(v.encode()).hexdigest() for i, v in enumerate([f"  {t}\n", t.lower(), t.upper(), f"{t}?", f"Please: {t}"])}


def test_retyped_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(schema_drift, "CHUNK", 3)  # several levels of unions
    rng = random.Random(5)
    files = [("a", s, json.dumps({"meta": {k: rng.choice([None, None, None, 1, "x"]) for k in ("p", "q", "r") if rng.random() < 0.9}})) for s in range(80)]
    assert changes(spark, files)[1] == brute(files)


def test_schema_of_nothing(spark):
    tagged, got = changes(spark, [("a", 1, None), ("a", 2, "[]"), (None, 3, "{}")])
    read = schema_drift.readable_files(tagged)
    assert got == set() and read.count() == 1
    assert schema_drift.unified_table(read, schema_drift.rename_map(schema_drift.schema_changes(tagged), read)).count() == 1
