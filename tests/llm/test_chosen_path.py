import random

import pyarrow as pa
import pytest

from delimir.llm import chosen_path
from delimir.llm.chosen_path import join, shingle_sets
from delimir.llm.components import components


def brute(texts):
    """Links and least row of each component, pair by pair; texts without words are copies."""
    sets = [frozenset(s.tolist()) for s in shingle_sets(pa.array(texts, pa.string()))]
    n, parent = len(sets), list(range(len(sets)))
    links = [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] == sets[j] or k and 10 * k >= 8 * (len(sets[i]) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(root(i), links[i]) for i in range(n)]


def corpus(seed, near, shared, apart):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    some = lambda k: [r.choice(words) for _ in range(k)]
    base, passage = some(120), some(60)

    def edited():
        b = list(base)
        for _ in range(r.randint(0, 4)):
            b[r.randrange(len(b))] = r.choice(words)
        return " ".join(b)

    texts = [edited() for _ in range(near)]
    texts += [" ".join(some(r.randint(10, 90)) + passage + some(50)) for _ in range(shared)]
    texts += [" ".join(some(r.randint(1, 80))) for _ in range(apart)]
    texts += ["", None, "  \n", "one two", "One  two", texts[0], texts[0].upper(), "a b c d e f", "a b c d e g"]
    r.shuffle(texts)
    return texts


# small limits send the same texts through splitting, bridges and blocks
@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"split": 12, "limit": 6, "part": 9, "leavers": 7, "depth": 2}), (3, {"limit": 4, "part": 5, "leavers": 3, "depth": 1}), (4, {"split": 14, "limit": 10, "shingles": 500})])
def test_is_brute_force(spark, seed, more):
    texts = corpus(seed, 90, 80, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as fp", "2 as class_id").repartition(3)
    rows = join(df, block=16, **more).collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sorted(r.doc_id for r in rows if r.is_first) == sorted({c for c, _ in got.values()})


def test_empty_and_repeated(spark):
    assert join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = join(spark.createDataFrame([(1, "x y z")] * 4 + [(None, "x y z")], "doc_id long, text string")).collect()
    assert [(r.class_id, r.n_links) for r in rows] == [(1, 4)] * 5


def test_lower_threshold_loses_nothing(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(30):
        t = [r.choice(words) for _ in range(60)]
        for cut in (0, 4, 9, 14):
            texts.append(" ".join(t[cut:] + [r.choice(words) for _ in range(cut)]))
    sets = [frozenset(x.tolist()) for x in shingle_sets(pa.array(texts))]
    links = [sum(i != j and 2 * len(a & b) >= len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    rows = join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=0.5).collect()
    assert [x.n_links for x in sorted(rows, key=lambda x: x.doc_id)] == links and sum(links) > 100


def test_long_texts(spark):
    r = random.Random(5)
    long = " ".join(str(r.randrange(10**6)) for _ in range(300_000))  # 2 MB
    texts = [long, long + " and more", "x" * 3_000_000, "short one", long.replace("1", "2")]
    rows = join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), shingles=1000).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in rows} == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0)}


def test_near_copies_leave_their_buckets(spark):
    """Of a group of near copies no rows go on to the next level, so levels don't multiply it."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    base = [r.choice(words) for _ in range(300)]
    texts = []
    for _ in range(1500):
        t = list(base)
        for _ in range(4):
            t[r.randrange(300)] = r.choice(words)
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = []
    real = chosen_path.written
    chosen_path.written = lambda d, name: (seen.append((name, got := real(d, name))), got)[1]
    try:
        rows = join(df, split=128).collect()
    finally:
        chosen_path.written = real
    assert {x.class_id for x in rows} == {0}
    hard = [d.count() for name, d in seen if name == "hard"]
    assert hard and hard[0] < 1500  # of 1500 * 24 rows


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 7), (7, 8), (8, 9), (2, 1)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **dict.fromkeys(range(100, 141), 100)}
    assert got == {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), task_edges=7).collect()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
