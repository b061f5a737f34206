"""Mixing: targets against the rule applied step by step, and what the mix takes."""

import random

import pytest

from cohortlens.llm import mixing
from cohortlens.llm.common import before


def shared(sizes: list[int]) -> list[float]:
    """Targets by the contract's own words: share by weight, cut at 3 times the size, share the rest again."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    cut: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in cut]
        left, total = sum(sizes) - sum(cut.values()), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > 3 * sizes[i]]
        if not over:
            return [cut[i] if i in cut else left * weights[i] / total for i in range(len(sizes))]
        cut |= {i: 3.0 * sizes[i] for i in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets_follow_the_rule(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "RANGE_ROWS", (3, 4096)[seed < 3])  # many ranges and blocks of sources, or one
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 7, 100, 3000, 10**6]) + rng.randrange(50) * (seed % 2) for _ in range(2 + 3 * seed)]
    rows = spark.createDataFrame([(f"={i:03}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = shared(sizes) if sum(sizes) else [0.0] * len(sizes)
    assert [got[f"={i:03}"] for i in range(len(sizes))] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes))


def queue(docs: list[tuple]) -> dict:
    """Taken words per (id, source, text), by one sorted list."""
    import hashlib

    units: dict = {}
    for i, s, t in docs:
        key = (i, "~" if s is None else "=" + s, len((t or "").split()))
        units[key] = units.get(key, 0) + key[2]
    sources = sorted({k[1] for k in units})
    sizes = [sum(n for k, n in units.items() if k[1] == s) for s in sources]
    target = dict(zip(sources, shared(sizes) if sum(sizes) else [0.0] * len(sizes)))
    entries = []
    for s, size in zip(sources, sizes):
        done = 0
        own = sorted((hashlib.md5(f"mix:{'' if k[0] is None else k[0]}".encode()).hexdigest(), k[0] is not None, k[0] or 0, k[2], k) for k in units if k[1] == s)
        for digest, *_, key in own:
            done += units[key]
            for copy in range(3):
                if units[key] and target[s] and done - units[key] + copy * size <= target[s]:
                    entries.append(((done + copy * size) / target[s], s, copy, digest, key))
    entries.sort(key=lambda e: e[:4])
    total, taken = 0, dict.fromkeys(units, 0)
    for *_, key in entries:
        total += units[key]
        if total > sum(sizes):
            break
        taken[key] += key[2]
    return taken


def test_mix_equals_one_sorted_queue(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None, "é"]), "w " * rng.randrange(40)) for i in range(300)]
    docs += [(None, "a", "x y"), (None, "a", "x y"), (7, None, None), (8, "b", ""), (5, "c", "long " * 4000), (5, "c", "long " * 4000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumnRenamed("text", "text")
    got = [r for r in mixing.mix(frame).collect()]
    assert len(got) == len(docs)
    want = queue(docs)
    for r in got:
        n = len((r.text or "").split())
        assert r["size"] == n and r.taken == want[(r.doc_id, "~" if r.source is None else "=" + r.source, n)] <= 3 * n
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    for s, (taken, target) in by.items():
        most = max((len((t or "").split()) * (2 if s == "c" else 1) for _, x, t in docs if x == s), default=0)
        assert abs(taken - target) <= most


def test_totals_before_a_place(spark):
    rng = random.Random(9)
    rows = {(k, p): rng.randrange(100) for k in "ab" for p in rng.sample(range(500), 120)}
    frame = spark.createDataFrame([(k, p, n, -n) for (k, p), n in rows.items()], "k string, p int, n long, m long")
    for r in before(frame, "p", ["n", "m"], ["k"], 7).collect():
        want = sum(n for (k, p), n in rows.items() if k == r.k and p < r.p)
        assert (r.n, r.m) == (want, -want)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string, taken int, size int")
    assert mixing.mix(empty).columns == ["doc_id", "source", "text", "taken", "size", "size_", "source_size", "target", "taken_"]
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "a", "")], "doc_id long, source string, text string")
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix(none).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
    assert mixing.take(none).count() == 0
