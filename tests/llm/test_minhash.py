"""Near-duplicates against all pairs, components against union-find, odd inputs."""

import random
from collections import Counter, defaultdict
from functools import partial

import pyarrow as pa
import pytest

from quillon.llm import components, minhash


def shingles(text):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def united(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    pairs, posts = [], defaultdict(list)
    for k, (i, x) in enumerate(sets):
        shared = Counter(j for h in x for j in posts[h])
        pairs += [(i, sets[j][0]) for j, n in shared.items() if 100 * n >= percent * (len(x) + len(sets[j][1]) - n)]
        for h in x:
            posts[h].append(k)
    return united(pairs, [i for i, _ in sets])


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(r.randint(0, 120))) for _ in range(60)]
    for base in texts[:12]:  # copies with a few changes, some near the threshold
        for k in range(r.randint(1, 12)):
            w = base.split()
            for _ in range(k % 4):
                if w:
                    w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    shared = " ".join(word() for _ in range(40))  # a passage in many documents
    texts += [f"{shared} {' '.join(word() for _ in range(r.randint(5, 60)))}" for _ in range(60)]
    texts += [texts[3].upper(), "  " + texts[4].replace(" ", "\n\t"), "one two", "ONE two", "", None, "   ", "one", "x " * 3000, " "]
    r.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("percent", [85, 80])
def test_against_all_pairs(spark, percent):
    rows = [*corpus(percent), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, id string, kept boolean")
    got = minhash.near_duplicates(docs, percent).collect()
    expected = brute(rows, percent)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {i: r.component_id for i, r in by_id.items()} == expected
    text = dict(rows)
    assert all(r.n_shingles == len(shingles(text[i])) and r.kept == (i == r.component_id) for i, r in by_id.items())
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "p q r s t u"), (2, "k l m n o p"), (3, "k l m n o p")], "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 2)]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_few_links_are_missed():
    t = minhash.matches_needed(0.85)
    assert t == 28
    assert minhash.matches_needed(0.9) > t and minhash.matches_needed(1.0) == minhash.COORDINATES


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(5, i) for i in range(40)] + [(100, 101), (101, 100), (100, 101)], [(random.Random(i).randrange(90), random.Random(i + 500).randrange(90)) for i in range(70)]])
@pytest.mark.parametrize("hot_degree", [2, 1000])
def test_components(spark, edges, hot_degree):
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), hot_degree).collect()
    ids = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.id: r.component for r in got} == united([e for e in edges if e[0] != e[1]], ids) and len(got) == len(ids)


def test_large_groups_are_joined_in_blocks(spark):
    r = random.Random(4)
    base = list(range(100))
    members = [(7 if i < 90 else i, i, sorted(r.sample(base, 95) if i % 3 else r.sample(range(1000), 60))) for i in range(120)]
    as_bytes = [(g, i, 8 * len(m), bytearray(pa.array(m, pa.uint64()).buffers()[1].to_pybytes()[: 8 * len(m)])) for g, i, m in members]
    rows = spark.createDataFrame(as_bytes, "grp long, id long, weight long, members binary")
    sets = {i: set(m) for g, i, m in members if g == 7}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for block in (7, 1000):
        got = components.group_forests(rows, partial(minhash.SetLinks, 85), block=block).collect()
        assert {tuple(sorted(e)) for e in got} <= set(pairs)
        assert united(got, sets) == united(pairs, sets)
        assert len(got) < len(pairs)
