import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest

from harrow.llm import automaton, exact, graph, near, suffix

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, source string, rid long, id string"


def frame(spark, texts, parts=3):
    """Other columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", 7, "x") for i, t in texts], SCHEMA).repartition(parts)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


EDGE = [(1, None), (2, ""), (3, "Ab c"), (4, "aB C"), (5, "ab  c"), (6, "É x"), (7, "é x"), (None, "ab c"), (8, "  \n"), (3, "Ab c"), (9, None)]


def exact_brute(texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in texts:
        n = (t or "").translate(LOWER)
        ids = [x for x in groups[n] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 2, 1])
def test_exact(spark, bits):
    random.seed(bits)
    texts = EDGE + [(100 + i, random.choice("abAB") * random.randint(1, 4)) for i in range(60)]
    assert rows(exact.exact_groups(frame(spark, texts), bits=bits, bucket_bytes=30)) == exact_brute(texts)
    kept = exact.drop_exact(frame(spark, texts), "doc_id")
    assert kept.columns == ["doc_id", "text", "source", "rid", "id"]
    assert sorted(r[0] for r in kept.collect() if r[0] is not None and r[0] >= 100) == [x[0] for x in exact_brute(texts) if x[3] and x[0] is not None and x[0] >= 100]


def test_directory_splits_overfull_buckets():
    load = np.array([9, 0, 0, 1, 1, 1, 1, 1])
    d = exact.Directory.grown(load, 4)
    total = np.zeros(d.buckets, int)
    np.add.at(total, d.bucket_of_slot[np.arange(8) >> (3 - d.depth)], load)
    assert d.depth == 3 and total.tolist() == [9, 0, 1, 4] and (np.diff(d.bucket_of_slot) >= 0).all()


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("doc_id > 1")
    assert exact.exact_groups(none).count() == 0 and near.near_groups(none).count() == 0
    assert automaton.drop_repeated_words(none).count() == 0 and suffix.drop_repeated_bytes(none).count() == 0


def near_brute(texts, k, percent=80):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in sets.items()), key=repr)


def family(seed, n):
    """Copies of copies: links that do not all go through one member."""
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    base = random.choices(words, k=80)
    out = [base]
    for _ in range(n):
        c = list(random.choice(out))
        for _ in range(random.randint(0, 3)):
            c[random.randrange(len(c))] = random.choice(words)
        out.append(c)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("k", [4, 5])
def test_near(spark, k):
    texts = [t for s in range(4) for t in family(s, 25)] + ["", None, "one two", "ONE two", "two one", " ", "a b c d e f g h"]
    random.seed(9)
    ids = random.sample(range(1000), len(texts))
    data = list(zip(ids, texts, strict=True))
    assert rows(near.near_groups(frame(spark, data), k=k)) == near_brute(data, k)
    assert near.drop_near(frame(spark, data), k=k).count() == sum(x[3] for x in near_brute(data, k))


def test_near_null_and_repeated_ids(spark):
    got = rows(near.near_groups(frame(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")])))
    assert got == sorted([(None, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)], key=repr)


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert got == {x: find(x) for a, b in edges for x in (a, b) if find(x) != x}


def words_brute(texts, t):
    seen, out = set(), []
    for i, text in sorted(texts):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - t + 1):
            key = tuple(w[s : s + t])
            if key in seen:
                gone[s : s + t] = [True] * t
            seen.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("states", [50, 100_000])
def test_automaton_dedup(spark, states, monkeypatch):
    monkeypatch.setattr(automaton, "LOCAL_STATES", states)
    monkeypatch.setattr(automaton, "SHARD_BYTES", 300)
    random.seed(4)
    texts = [(i, " ".join(random.choices(["a", "b", "É"], k=random.randint(0, 30)))) for i in range(40)] + [(50, None), (51, ""), (52, "a\n\tb a  b"), (53, "x " * 300), (54, "x " * 300)]
    got = automaton.drop_repeated_words(frame(spark, texts), window=5, keep_text=True)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == words_brute(texts, 5)


def bytes_brute(texts, t, keep):
    bodies = {i: (x or "").encode() for i, x in texts}
    count = collections.Counter(b[s : s + t] for b in bodies.values() for s in range(len(b) - t + 1))
    seen, out = set(), []
    for i in sorted(bodies):
        b = bodies[i]
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - t + 1):
            w = b[s : s + t]
            if w in seen if keep == "first" else count[w] > 1:
                gone[s : s + t] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("keep", "length"), [("none", 7), ("first", 7), ("none", 70), ("first", 3)])
def test_suffix_dedup(spark, keep, length, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 500)
    monkeypatch.setattr(suffix, "LOCAL_BYTES", 200)
    random.seed(length)
    shared = "".join(random.choices("abcd éx", k=120))
    texts = [(i, "".join(random.choices("ab é", k=random.randint(0, 40)))) for i in range(30)]
    texts += [(40 + i, f"{i}" + shared[i : 100 + i] + f"{i}" * 3) for i in range(6)] + [(60, None), (61, ""), (62, "a" * 300), (63, "a" * 200)]
    assert rows(suffix.drop_repeated_bytes(frame(spark, texts), length=length, keep=keep)) == bytes_brute(texts, length, keep)


def test_rows_alike_are_one_document(spark):
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = rows(automaton.drop_repeated_words(frame(spark, texts), window=3))
    assert sorted((r[0] is None, r[1], r[2]) for r in got) == [(False, 6, 6), (False, 6, 6), (True, 0, 0), (True, 6, 0)]
    got = rows(suffix.drop_repeated_bytes(frame(spark, texts), length=5, keep="none"))
    assert sorted((r[0] is None, r[1], r[2]) for r in got) == [(False, 11, 11), (False, 11, 11), (True, 0, 0), (True, 11, 11)]
