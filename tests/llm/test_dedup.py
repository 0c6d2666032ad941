import hashlib

import numpy as np
import xxhash

from quire.llm import exact_dedup, simhash

ROWS = [
    (1, "Hello World", "x"),
    (2, "hello world", "y"),
    (3, None, None),
    (4, "", "z"),
    (5, "HÉLLO", "z"),
    (6, "hÉllo", "z"),
    (7, "héllo", "z"),
    (8, "a b c d " * 5000, "z"),
    (9, "unique", "z"),
    (9, "unique", "z"),
]
SCHEMA = "doc_id long, text string, keep_id string"


def low(t):
    return (t or "").encode().translate(simhash.ASCII_LOWER)


def test_exact(spark):
    got = {}
    for r in exact_dedup.exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept, r.text_sha256))
    assert len(got[9]) == 2 and got[9][0][:3] == (9, 2, True)
    for i, t, _ in ROWS:
        same = [j for j, u, _ in ROWS if low(u) == low(t)]
        assert got[i][0] == (max(same), len(same), i == max(same), hashlib.sha256(low(t)).hexdigest())


def test_exact_full_filter_loses_nothing(spark):
    """A filter far too small sends every row through the shuffle and gives the same rows."""
    rows = [(i, f"t{i % 900}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(exact_dedup.exact_dedup(docs, max_filter_bits=1).collect()) == sorted(exact_dedup.exact_dedup(docs).collect())


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_fp(text):
    w = low(text).split()
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, bits=3):
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if i < j and bin(a ^ b).count("1") <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs}


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "Gh", "ij", "kl", "mn"], 60)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 120):
        w = rng.choice(base).split()
        w[rng.integers(len(w))] = "zz"
        rows.append((i, "  ".join(w) + "\t\n"))
    rows += [(200, None), (201, " \n"), (202, "one"), (203, "one two"), (204, "é\x85à b c"), (205, "x " * 70000)]
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [(i, brute_fp(t)) for i, t in rows]
    assert {i: got[i].fingerprint for i, _ in rows} == {i: f"{f:016x}" for i, f in fps}
    assert {i: got[i].component_id for i, _ in rows} == brute_components(fps)


def test_hot_variants_are_cut_again(spark):
    """Clusters over the bound: every level is used and no link is lost."""
    rng = np.random.default_rng(5)
    fps = {0, 7}
    for centre in (0x0123456789ABCDEF, 0xFFFF0000FFFF0000):
        for _ in range(150):
            x = centre
            for b in rng.integers(0, 64, 3):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for most in (1, 8, 2048):
        roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(df, 3, most)).collect()}
        want = brute_components([(x, x) for x in fps])
        groups = {}
        for x in fps:
            groups.setdefault(want[x], set()).add(x)
        mine = {}
        for x in fps:
            mine.setdefault(roots.get(x, simhash._signed(x)), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_simhash_empty(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
