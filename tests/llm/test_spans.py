import random

import numpy as np
import pytest

from quaymark.llm.spans import SharedSpans, compact_windows, shingle_hashes, code_points

MIN = 200


def brute(docs):
    """Pairs of ids with a common substring of MIN characters, and per id the covered positions."""
    grams, pairs, cover = {}, set(), {}
    for i, t in docs:
        if i is None or t is None:
            continue
        for p in range(len(t) - MIN + 1):
            grams.setdefault(t[p : p + MIN], []).append((i, p))
    for where in grams.values():
        ids = sorted({i for i, _ in where})
        if len(ids) > 1:
            pairs.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
            for i, p in where:
                cover.setdefault(i, set()).update(range(p, p + MIN))
    return pairs, {i: len(c) for i, c in cover.items()}


def run(spark, docs):
    s = SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    rows = s.document_pairs().collect()
    pairs = {(r["doc_id_a"], r["doc_id_b"]) for r in rows}
    assert len(pairs) == len(rows)
    return s, pairs


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日 ") for _ in range(rng.randint(2, 8)))
    blocks = [" ".join(word() for _ in range(60))[: rng.choice([150, 199, 200, 201, 230, 300])] for _ in range(12)]
    blocks += ["=" * 260, "ab" * 150, "x" * 199]
    out = []
    for i in range(n):
        t = "".join(rng.choice(blocks) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 6)))
        out.append((i, t))
    out += [(n, out[0][1]), (n + 1, out[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "short"), (None, out[1][1])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = texts(seed, 60)
    want, cover = brute(docs)
    s, got = run(spark, docs)
    assert got == want
    by_id = {i: t for i, t in docs}
    for r in s.coverage().collect():
        assert r["shared_chars"] == cover.get(r["doc_id"], 0), r
    for r in s.passages().collect():
        a, b, n = by_id[r["doc_id_a"]], by_id[r["doc_id_b"]], r["n_chars"]
        i, j = r["start_a"], r["start_b"]
        assert n >= MIN and a[i : i + n] == b[j : j + n]
        assert i == 0 or j == 0 or a[i - 1] != b[j - 1]
        assert i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]


def test_hot_hashes_lose_nothing(spark):
    rng = random.Random(3)
    core = "".join(rng.choice("abcdefgh") for _ in range(180))
    tails = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(8)]
    docs = [(i, "".join(rng.choice("xyz") for _ in range(150)) + rng.choice(tails)[30:] + core + rng.choice(tails)[:30]) for i in range(150)]
    want, _ = brute(docs)
    s = SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", hot=4, block=8)
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in s.document_pairs().collect()} == want
    plain = s.text_pairs().distinct().collect()
    assert sorted(plain) == sorted(s.text_pairs(block=3).distinct().collect())


def test_documents_of_the_test_data(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, _ = brute(docs)
    assert run(spark, docs)[1] == want


def test_empty_table(spark):
    s, got = run(spark, [])
    assert got == set() and s.passages().collect() == [] and s.coverage().collect() == []


def test_every_wide_window_has_its_minimum_as_a_centre():
    rng = np.random.default_rng(0)
    for n in (0, 5, 30, 80):
        h = rng.integers(0, 6, n).astype(np.uint64)
        centres = set(compact_windows(h, 7, 0)[0].tolist())
        for lo in range(n - 6):
            for hi in range(lo + 7, n + 1):
                assert lo + int(h[lo:hi].argmin()) in centres


def test_periodic_texts_cost_no_more_than_their_runs(spark):
    rng = random.Random(8)
    free = lambda n: "".join(rng.choice("klmnop") for _ in range(n))
    docs = [(0, free(300) + "=" * 5000 + free(300)), (1, "=" * 2000), (2, free(250) + "=-" * 1000), (3, "=" * 199 + free(300)), (4, free(100) + "-=" * 150), (5, "xyz" * 400 + free(400)), (6, free(90) + "yzx" * 100)]
    want, cover = brute(docs)
    s, got = run(spark, docs)
    assert got == want
    assert {r["doc_id"]: r["shared_chars"] for r in s.coverage().collect()} == {i: cover.get(i, 0) for i, _ in docs}
    by_id = dict(docs)
    for r in s.passages().collect():
        assert by_id[r["doc_id_a"]][r["start_a"] :][: r["n_chars"]] == by_id[r["doc_id_b"]][r["start_b"] :][: r["n_chars"]] and r["n_chars"] >= MIN
    at, further = compact_windows(shingle_hashes(code_points("=" * 1_000_000), 100), 101, 100)
    assert len(at) < 300 and further.max() > 900_000
    assert s.members.count() < 3000
    classes = s.passage_classes().collect()
    assert classes and all(r["n_docs"] > 1 or r["n_links"] > 0 for r in classes)


def test_shingle_hash_depends_on_the_characters_only():
    a, b = code_points("x" * 7 + "hello world" * 20), code_points("hello world" * 20)
    assert (shingle_hashes(a, 100)[7:] == shingle_hashes(b, 100)).all()
    assert len(set(shingle_hashes(b, 100)[:11].tolist())) == 11
