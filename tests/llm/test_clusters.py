import numpy as np
import pytest

from quaymark.llm import clusters as C

LISTS = C.Lists(frozenset({"gateway", "cache", "broker"}), frozenset({"merge", "shadow", "headers", "drain", "cold", "turns"}))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Look at mergeShadowHeaders in `Gisazagebo-Cache`, E-8436", ("gisazagebo-cache", "headers_merge_shadow", "e8436")),
        ("GisazageboCache headers.merge_shadow code q_8436", ("gisazagebo-cache", "headers_merge_shadow", "q8436")),
        ("the gisazagebo cahce: mege_shadow_headers.py raises KX8436", ("gisazagebo-cache", "headers_merge_shadow", "kx8436")),
        ("in gisazagebocache at mergeshadowheaders", ("gisazagebo-cache", "headers_merge_shadow", None)),
        ("nothing here", (None, None, None)),
        ("", (None, None, None)),
    ],
)
def test_anchors(text, want):
    assert C.parse(text, LISTS)[:3] == want


def jobs(n_components=12, seed=0):
    rng = np.random.default_rng(seed)
    verbs, nouns, kinds = ["merge", "drain", "split", "load"], ["headers", "turns", "rows", "spans"], ["gateway", "cache", "broker", "worker"]
    symptoms = ["the lock stays held on timeout", "memory climbs until the pod is killed", "duplicate rows appear after a restart", "the queue of retries never shrinks"]
    out, truth = [], {}
    for c in range(n_components):
        name = "".join(rng.choice(["ba", "ke", "ti", "ro", "lu", "so"]) for _ in range(5)) + str(c).translate(str.maketrans("0123456789", "abcdefghij"))
        kind = kinds[c % 4]
        for j in range(1 + c % 2):
            place = (verbs[(c + j) % 4], ["cold", "open"][j], nouns[(c + 2 * j) % 4])
            code, what = f"E-{1000 + 37 * c + 501 * j}", symptoms[(c + j) % 4]
            for k in range(8):
                comp = [f"{name}-{kind}", f"{name}_{kind}", name.capitalize() + kind.capitalize(), f"{name.upper()}-{kind.upper()}"][k % 4]
                text = [
                    f"In {comp}: {what}. We see {code} coming out of {'_'.join(place)}. Please look at it.",
                    f"{'_'.join(place)} raises {code}; {what}. Fix it, smallest diff you can",
                    f"{comp} again: {what}. refactor this please, I have no stack trace",
                    f"who owns {place[0]}{place[1].capitalize()}{place[2].capitalize()}? It throws {code.replace('-', '')} and then {what}.",
                ][k % 4]
                key = f"r{len(out)}"
                out.append((key, text, 1))
                truth[key] = (c, j)
    return out, truth


def test_jobs_are_found(spark):
    rows, truth = jobs()
    extra = [("null", None, 0), ("empty", "", 0), ("short1", "fix it", 0), ("short2", "Fix  it", 0), (None, "fix it", 0), ("r0", rows[0][1], 0)]
    df = spark.createDataFrame(rows + extra, "key string, text string, cluster_id int")
    got = C.cluster_records(df)
    members = got.collect()
    assert len(members) == len(rows) + len(extra)
    by = {}
    for r in members:
        by.setdefault(r["key"], set()).add(r["cluster_id"])
    assert all(len(v) == 1 for v in by.values())
    label = {k: next(iter(v)) for k, v in by.items()}
    assert label["null"] == label["empty"] and label["short1"] == label["short2"] == label[None] != label["null"]
    keys = sorted(truth)
    same = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if label[a] == label[b]]
    want = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if truth[a] == truth[b]]
    hit = len(set(same) & set(want))
    assert hit / len(same) > 0.98 and hit / len(want) > 0.98
    described = {r["cluster_id"]: r for r in C.describe_clusters(got).collect()}
    assert sum(r["n_members"] for r in described.values()) == len(members)
    for r in described.values():
        assert 1 <= len(r["typical_keys"]) <= 3 and all(label[k] == r["cluster_id"] for k in r["typical_keys"])
    # neither the order of the rows nor their layout matters
    again = {r["key"]: r["cluster_id"] for r in C.cluster_records(df.orderBy("text").repartition(7), rows_per_task=50).collect()}
    assert again == label


@pytest.mark.parametrize("largest", [12, 200_000])
def test_few_components_and_hot_blocks_lose_nothing(spark, largest):
    rows, truth = jobs(4)
    rows = rows + [(f"x{i}", "fix it", 0) for i in range(50)]
    got = {r["key"]: r["cluster_id"] for r in C.cluster_records(spark.createDataFrame(rows, "key string, text string, n int"), largest=largest).collect()}
    assert len(got) == len(rows) and len({got[f"x{i}"] for i in range(50)}) == 1
    want = [(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]]
    same = [(a, b) for a in truth for b in truth if a < b and got[a] == got[b]]
    hit = len(set(want) & set(same))
    assert hit >= 0.98 * len(want) and hit >= 0.95 * len(same)


PARAPHRASES = [
    ["please make the nightly billing export finish before six in the morning", "the nightly billing export must finish before six in the morning, please", "billing export at night should finish before six in the morning please"],
    ["how do i change the avatar of my account in the mobile app", "changing the avatar of my account in the mobile app: how do i do it", "in the mobile app, how can i change my account avatar"],
    ["write a short poem about rain in autumn for my sister", "for my sister write a short poem about autumn rain", "a short autumn rain poem for my sister, write it"],
    ["the login page shows a blank screen on old phones after the update", "after the update old phones show a blank screen on the login page", "blank screen on the login page with old phones since the update"],
]


@pytest.mark.parametrize(("n", "largest"), [(2, 200_000), (4, 200_000), (4, 3)])
def test_wording_without_identifiers_is_enough(spark, n, largest):
    rows = [(f"{g}{i}", t) for g, texts in enumerate(PARAPHRASES[:n]) for i, t in enumerate(texts)]
    got = {r["key"]: r["cluster_id"] for r in C.cluster_records(spark.createDataFrame(rows, "key string, text string"), largest=largest).collect()}
    assert len(set(got.values())) == n
    assert all((got[a] == got[b]) == (a[0] == b[0]) for a in got for b in got)


@pytest.mark.parametrize("largest", [12, 4])
def test_the_size_of_a_block_does_not_change_its_clusters(spark, largest):
    rows, truth = jobs()
    rows = rows + [(f"x{i}", "fix it", 0) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, text string, n int")
    want = {r["key"]: (r["cluster_id"], r["density"]) for r in C.cluster_records(df).collect()}
    got = {r["key"]: (r["cluster_id"], r["density"]) for r in C.cluster_records(df, largest=largest).collect()}
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-3 for k in want)
    # requests that name only their component are with others that name more
    alone = [k for k in truth if int(k[1:]) % 4 == 2]
    assert {got[k][0] for k in alone} <= {got[k][0] for k in set(truth) - set(alone)}


def test_a_slip_in_a_component_is_mended(spark):
    rows = [(f"a{i}", "Look at gisazagebo-cache: the lock stays held on timeout, please repair it now") for i in range(6)]
    rows += [(f"s{i}", f"In {w}-cache the lock stays held on timeout, please repair it") for i, w in enumerate(["gisazagbo", "gisazaagebo", "gisazagbeo", "gisazageto", "gizasagebo"])]
    rows += [("o", "In gisatogebo-cache the lock stays held on timeout, please repair it"), ("k", "In gisazagebo-broker the lock stays held on timeout, please repair it")]
    parsed = C.parse_records(spark.createDataFrame(rows, "key string, text string"), C.Lists(frozenset({"cache", "broker"}), frozenset()))
    got = {r["key"]: r["component"] for r in C.mend_components(parsed).collect()}
    assert len(got) == len(rows) and {got[f"a{i}"] for i in range(6)} == {"gisazagebo-cache"}
    # a letter less, more, two changed over next to each other or apart, another letter; then two other letters, another kind
    assert [got[f"s{i}"] for i in range(4)] == ["gisazagebo-cache"] * 4
    assert got["o"] == "gisatogebo-cache" and got["k"] == "gisazagebo-broker"


def test_empty_table(spark):
    df = spark.createDataFrame([], "key string, text string")
    assert C.cluster_records(df).collect() == [] and C.describe_clusters(C.cluster_records(df)).collect() == []


def test_mixture_splits_by_the_information_criterion():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (60, C.DIMS)).astype(np.float32)
    x[20:40] += 3
    x[40:] -= 3
    seen = np.ones_like(x, bool)
    seen[::5, : C.KEPT_DIMS] = False
    label, density = C.fit_blocks(np.zeros(60, int), x, seen, np.ones(60))
    assert len(set(label)) == 3 and len({tuple(label[i : i + 20]) for i in (0, 20, 40)}) == 3
    one, _ = C.fit_blocks(np.zeros(20, int), x[:20], seen[:20], np.ones(20))
    assert set(one) == {0}
    centre = x[:20].mean(0)
    assert np.corrcoef(density[:20], -((x[:20] - centre) ** 2).sum(1))[0, 1] > 0.3
