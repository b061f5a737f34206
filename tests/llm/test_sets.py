"""N-gram join, hard negatives and source divergence against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import divergence, hard_negatives, ngram_join
from tests.conftest import SF_SMALL
from tests.llm.test_structures import reached
from tests.llm.test_texts import ODD


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# N-gram join -----------------------------------------------------------------------------------


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_components(rows, percent=85):
    """(id, size of the set, smallest id reached) of each (id, text)."""
    sets = [plain_set(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = reached(range(len(rows)), linked)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[label[i]] = min(name, least.get(label[i], name))
    return sorted(((name, len(sets[i]), least.get(label[i])) for i, (name, _) in enumerate(rows)), key=str)


def mutated(rng, words, share):
    return [rng.choice("xyzuvw") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def families(seed, groups=25):
    """Texts in families from unlinked to equal, of 1 to 900 words, with a passage that many share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(int(10 ** rng.uniform(0, 2.95)))]
        base = base + passage if g % 3 == 0 else base
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(mutated(rng, base, rng.choice((0, 0, 0.005, 0.01, 0.02, 0.03, 0.05)))))
    rng.shuffle(texts)
    return texts


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for n in [*range(1, 80), *rng.integers(80, 6000, 60).tolist()]:
        for _ in range(6):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            gone = int(rng.integers(0, n + 1))
            more = rng.integers(0, 1 << 63, int(rng.integers(0, n + 1)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            # as many changes as the similarity allows, dealt out at random between lost and added
            while 100 * (n - gone) < 85 * (n + len(more)):
                gone, more = (gone - 1, more) if gone and (not len(more) or rng.random() < 0.5) else (gone, more[:-1])
            x, y = np.unique(a), np.unique(np.concatenate([a[gone:], more]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                assert np.intersect1d(ngram_join.signatures(x), ngram_join.signatures(y)).size


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_trie_finds_the_components_of_all_links(percent):
    rng = random.Random(percent)
    for _ in range(40):
        universe = rng.choice((12, 60, 400))
        sets = {tuple(sorted(rng.sample(range(universe), rng.randrange(1, 11)))) for _ in range(rng.randrange(1, 60))}
        sets = [np.array(s, dtype=np.uint64) for s in sets]
        linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        edges = ngram_join.forest(sets, percent)
        assert {tuple(sorted(e, reverse=True)) for e in edges} <= set(linked)
        assert reached(range(len(sets)), edges) == reached(range(len(sets)), linked)
        assert len(edges) == len(sets) - len(set(reached(range(len(sets)), linked).values()))


def test_gram_sets(monkeypatch):
    texts = [*ODD, "one", "One TWO three", "a b c d", "a b c d a b c d", "É A b c\x0bd e", *families(1, 6)]
    sizes = [len(plain_set(t)) for t in texts]
    sets = [ngram_join.gram_set(t) for t in texts]
    assert [len(s) for s in sets] == sizes
    monkeypatch.setattr("cohortlens.llm.simhash.PIECE", 30)
    assert all((ngram_join.gram_set(t) == s).all() for t, s in zip(texts, sets))


@pytest.mark.parametrize("block_grams", [1 << 20, 300])
def test_jaccard_components(spark, block_grams):
    texts = [*ODD, *ODD[:3], "one", "ONE", "one two", "a b c d", "a b c d a b c d", *families(2)]
    rows = [(1000 - i if i % 11 else None, t) for i, t in enumerate(texts)] + [(7, texts[-1]), (7, "something else entirely here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.jaccard_components(docs, ["doc_id"], block_grams=block_grams).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows)


def test_jaccard_components_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.jaccard_components(docs, ["doc_id"]).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows)


def test_jaccard_components_names_and_empty_tables(spark):
    clash = spark.createDataFrame([("a", 2, "x y z u v", "c"), ("b", 1, "x y z u v", "d"), ("c", 3, None, None)], "component_id string, doc_id long, text string, n_shingles string")
    got = ngram_join.jaccard_components(clash, ["component_id", "n_shingles", "text", "doc_id"])
    assert got.columns == ["component_id", "n_shingles", "text", "doc_id", "n_shingles_", "component_id_"]
    assert sorted(map(tuple, got.collect())) == [("a", "c", "x y z u v", 2, 2, 1), ("b", "d", "x y z u v", 1, 2, 1), ("c", None, None, 3, 0, 3)]
    assert ngram_join.jaccard_components(clash.limit(0), ["doc_id"]).count() == 0


# Hard negatives --------------------------------------------------------------------------------


def plain_negatives(rows, is_anchor):
    """Rows of (id, label, vector) by exhaustive search."""
    used = [(i, n, lab, [math.floor(256 * x) for x in v]) for i, (n, lab, v) in enumerate(rows)
            if n is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, lab, v in used:
        if not is_anchor(n):
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), m, o != lab) for j, m, o, w in used if j != i and len(w) == len(v))
        for s, positive, _ in [x for x in others if not x[2]][:5]:
            fits = [(m, -t) for t, m, other in others if other and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(n, positive, r + 1, m, -s, t) for r, (m, t) in enumerate(fits)]
    return sorted(out)


def vector_rows(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = [(i, int(rng.integers(0, 4)), None) for i in range(n)]
    rows = [(i, lab, (centres[lab] + rng.normal(size=dim)).round(2).tolist()) for i, lab, _ in rows]
    odd = [(9000, None, rows[0][2]), (9010, 1, None), (9020, 1, []), (9030, 2, [0.0] * dim), (9040, 2, [float("nan")] + [1.0] * (dim - 1)), (9050, 1, [None] + [1.0] * (dim - 1)),
           (9060, 1, [float("inf")] + [1.0] * (dim - 1)), (None, 1, rows[0][2]), (9070, 1, [1.0, 2.0]), (9080, 2, [1.0, 1.0]), (9081, 1, [2.0, 1.0])]
    return rows + odd + [(9100 + i, i % 2, rows[3][2]) for i in range(20)] + [rows[5], rows[5], (20, 3, rows[7][2])]


@pytest.mark.parametrize("block, chunk", [(1 << 20, 1 << 20), (40, 3)])
def test_hard_negatives(spark, block, chunk, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rows = vector_rows(3, 260)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, block=block, chunk=chunk)
    single = [(n, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for n, lab, v in rows]
    assert sorted(map(tuple, got.collect())) == plain_negatives(single, lambda n: n % 10 == 0)


def test_hard_negatives_of_large_components_and_few_rows(spark):
    rows = [(i, i % 2, [3e13 * (i + 1), -2e12 * i, 1.0]) for i in range(6)]  # squares beyond 64 bits are compared exactly
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(df, F.col("id") == 0).collect()
    top = (1 << 63) - 1
    assert {(r.positive_id, r["rank"], r.negative_id) for r in got} == {(p, k, n) for p, _, k, n in [(a[1], 0, a[2], a[3]) for a in plain_negatives(rows, lambda n: n == 0)]}
    assert all(r.positive_score == top for r in got)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") == 0).count() == 0
    assert hard_negatives.hard_negatives(df.limit(1), F.col("id") == 0).count() == 0


def test_boxes_bound_their_rows(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 20)
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, (700, 5)).astype(np.float64)
    tree = hard_negatives.RTree(np.arange(700), np.arange(700), rng.integers(0, 5, 700), x)
    assert sorted(tree.uids.tolist()) == list(range(700)) and len(tree.levels[-1][0]) == 1
    for q in rng.integers(-50, 50, (20, 5)).astype(np.float64):
        low, high = tree.bounds(0, slice(None), q)
        for (a, b), lo, hi in zip(zip(*tree.levels[0][:2]), low, high):
            assert lo <= (tree.x[a:b] @ q).min() and (tree.x[a:b] @ q).max() <= hi


# Source divergence -----------------------------------------------------------------------------


def plain_divergence(rows, min_docs=10, top=10):
    """Rows of (lang, source, text) term by term."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(s, t) for a, s, t in docs if a == lang]
        kept = {w for _, t in mine for w in t}
        kept = {w for w in kept if sum(w in set(t) for _, t in mine) >= min_docs}
        sources = {s: [w for x, t in mine if x == s for w in t if w in kept] for s, _ in mine}
        every = [w for words in sources.values() for w in words]
        p = lambda words: {w: 1 + 10**9 * (words.count(w) + 2) // (len(words) + 2 * len(kept)) for w in kept}
        q, rated = p(every), {s: p(words) for s, words in sources.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, words in sources.items():
            pairs = [(o, sum(f(rated[s][w], rated[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, f(rated[s][w], q[w])) for w in set(words) if rated[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def source_rows(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "Çé", "zz", "Ünd", "東京", "q") for b in "abcdefgh"]
    rows = [(rng.choice(("en", "de", None, "")), f"s{int(rng.expovariate(0.4))}" if rng.random() < 0.9 else None, " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(220)]
    return rows + [("xx", "alone", "ab cd"), ("xx", "other", None), ("yy", "only", ""), ("en", "S0", "1234 ..."), *[(None, "copy", "Ab-CD ab_c'd\x7fA\x00b")] * 12, *[("en", t, t) for t in ODD]]


@pytest.mark.parametrize("entries, chunk", [(1 << 20, 1 << 20), (40, 3)])
def test_divergence(spark, entries, chunk):
    rows = source_rows(4)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    got = divergence.divergence(docs, block_entries=entries, chunk_sources=chunk)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)


def test_divergence_edges(spark, monkeypatch):
    schema = "lang string, source string, text string"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    rows = source_rows(5)[:60]
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, schema)).collect())) == plain_divergence(rows)


def test_runs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        length = int(rng.integers(1, 30))
        columns = rng.integers(0, 3, (2, length)) * rng.integers(0, 2, (2, length))
        coded = []
        for c in columns:
            at = np.flatnonzero(c)
            starts, values = divergence.runs(at, c[at], length)
            assert np.repeat(values, np.diff(starts, append=length)).tolist() == c.tolist()
            assert (values[1:] != values[:-1]).all()
            coded.append((starts, values + 1))
        want = sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(*(columns + 1)))
        assert divergence.pair_sum(*coded, length) == want
