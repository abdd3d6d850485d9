"""Near-duplicates: large groups, their blocks and forests, and links just above and just under the threshold, against brute force."""

import random

import numpy as np
import pytest

from loomline.llm import near_dup
from loomline.llm.near_dup import Sets, Similarity, Sketches, forest, minwise, shingles


def texts(rng, groups):
    """Groups of near copies: ``(size, words, changed)``; each copy has some words of its own in place of its base's."""
    own = rng.randrange(10**9)
    fresh = iter(f"w{own}.{i}" for i in range(10**9))
    out = []
    for size, words, changed in groups:
        base = [next(fresh) for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for at in rng.sample(range(words), rng.randint(*changed)):
                text[at] = next(fresh)
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


def brute(sets, percent):
    """Component of each set, by every pair's intersection."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = 0
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))], links


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_large_groups(spark, k, percent):
    """Groups far over a block, of which none, some or all texts are linked, equal brute force."""
    rng = random.Random(percent)
    rows = texts(rng, [(260, 200, (9, 11)), (200, 200, (4, 9)), (120, 150, (0, 2)), (90, 60, (1, 2)), *[(2, 80, (0, 3))] * 30])
    sets = [set(shingles(t, k).tolist()) for t in rows]
    want, links = brute(sets, percent)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for like in (Similarity(k, percent, small=16, block=40), Similarity(k, percent, small=16, volume=9000), Similarity(k, percent)):
        got = {r.doc_id: r for r in near_dup.near_duplicates(df, like).collect()}
        assert links > 1000 and [got[i].component_id for i in range(len(rows))] == want
        assert all(got[i].n_shingles == len(sets[i]) for i in got)


def test_recall_of_pairs(spark):
    """Pairs at the threshold and a little above it: none is lost, none under it is linked."""
    rng = random.Random(8)
    for k, percent in ((3, 85), (5, 80)):
        rows, want = [], {}
        while len(want) < 400:
            a, b = texts(rng, [(2, 200, (1, 5))])
            x, y = set(shingles(a, k).tolist()), set(shingles(b, k).tolist())
            s = 100 * len(x & y) / len(x | y)
            if abs(s - percent) < 4:
                want[len(rows)] = s >= percent
                rows += [a, b]
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), Similarity(k, percent)).collect()}
        found = {i: got[i + 1] == i for i in want}
        print(f"words {k}, percent {percent}: recall {sum(found[i] for i in want if want[i]) / sum(want.values()):.4f}")
        assert found == want


def test_intersections():
    rng = np.random.default_rng(1)
    for m in (3, 9, 40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype("<u8") for _ in range(m)]
        got = Sets(Similarity()).shared([s.tobytes() for s in sets])
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(m) for j in range(m) if i != j)


def test_forest_ties_what_is_near():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(2, 14)
        root = np.array([rng.randrange(n) for _ in range(n)])
        cross = np.array([rng.random() < 0.5 for _ in range(n)]) if rng.random() < 0.5 else None
        linked = np.zeros((n, n), bool)
        for _ in range(rng.randint(0, 20)):
            i, j = rng.randrange(n), rng.randrange(n)
            linked[i, j] = linked[j, i] = i != j
        made = forest(root, cross, lambda i, at, m=linked: at[m[i, at]])

        def parts(edges, n=n):
            name = list(range(n))
            for a, b in edges:
                old, new = name[b], name[a]
                name = [new if x == old else x for x in name]
            return {frozenset(i for i in range(n) if name[i] == x) for x in name}

        own = [(i, j) for i in range(n) for j in range(n) if root[i] == root[j]]
        real = [(i, j) for i in range(n) for j in range(n) if linked[i, j] and (cross is None or cross[i] != cross[j])]
        assert all((i, j) in real for i, j in made) and parts(own + made) == parts(own + real) and len(made) < len(set(root.tolist()))


def test_sketches_agree_with_pairs():
    rng = random.Random(6)
    rows = texts(rng, [(12, 100, (0, 12))])
    sets = [shingles(t, 3) for t in rows]
    data, n = [minwise(s).tobytes() for s in sets], np.array([len(s) for s in sets])
    by = Sketches(Similarity(3, 85))
    near = by.near(data, n, None)
    for i in range(len(rows)):
        for j in range(len(rows)):
            assert (j in near(i, np.arange(len(rows)))) == by.pairs([data[i]], [data[j]], n[[i]], n[[j]])[0]
