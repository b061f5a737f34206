"""SimHash, nearest neighbours, WARC, components and the pipeline against plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import ann, simhash, warc
from cohortlens.llm.common import components, shared_path
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.test_targets import queue
from tests.llm.test_texts import ODD, plain_contaminated


def reached(nodes, linked):
    """Smallest node that links reach from each node."""
    label = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(90)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reached({x for e in edges for x in e}, edges)
    assert all(got.get(x, x) == c for x, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, monkeypatch):
    texts = [*ODD, "one", "One TWO three", "a b c d", "É A b c\x0bd e", *(r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())]
    want = [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 40)
    assert [simhash.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("bits", range(8))
def test_terms_cover_what_is_guaranteed(bits):
    terms = [set(t) for t in simhash.term_positions(bits)]
    assert all(any(t <= set(c) for t in terms) for c in itertools.combinations(range(8), 8 - bits))
    assert len(terms) <= 56


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_links_lose_nothing(spark, block):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps)[:25]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 4, 5])):
                f ^= 1 << b
            fps.add(f)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    got = [(r.a, r.b) for r in simhash.links(frame, block=block).collect()]
    near = [(signed[a], signed[b]) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    assert {frozenset(e) for e in got} <= {frozenset(e) for e in near}
    assert reached(signed.values(), got) == reached(signed.values(), near) and len(near) > 50


def plain_groups(rows):
    """Smallest id that near fingerprints reach, per row."""
    fps = [plain_fingerprint(t) for _, t in rows]
    nodes = sorted(set(fps))
    label = reached(nodes, [(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 4])
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[label[f]] = min(first.get(label[f], i), i)
    return [first.get(label[f]) for f in fps], fps


def test_near_duplicates_equal_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows += [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, rows[0][1]), (None, "alone without an id in a group of its own here"), rows[3], (9999, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    groups, fps = plain_groups(rows)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame, ["doc_id"]).collect())
    assert got == sorted((str(i), f"{f:016x}", str(g)) for (i, _), f, g in zip(rows, fps, groups))
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for (i, _), g in zip(rows, groups) if i == g)
    assert simhash.near_duplicates(frame.limit(0), ["doc_id"]).count() == 0


def test_one_document_of_each_group_stays(spark):
    """Rows without an id, and several texts under one id."""
    base = " ".join(f"w{i}" for i in range(200))
    near = [f"{base} end{i}" for i in range(40)]
    own = plain_fingerprint(base)
    near = [x for x in near if (plain_fingerprint(x) ^ own).bit_count() <= 4][:2]
    assert len(near) == 2
    other = " ".join(f"v{i}" for i in range(200))
    for ids in ([None] * 5, [3, 3, 3, 3, None]):
        rows = [(i, t, n) for n, (i, t) in enumerate(zip(ids, [base, base, *near, base]))] + [(None, other, 9), (None, other, 8)]
        kept = sorted((str(r.doc_id), r.text, r.n) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect())
        first = min({t for i, t, _ in rows[:4]}, key=lambda t: hashlib.md5(t.encode()).hexdigest())
        group = [(str(i), t, n) for i, t, n in rows[:5] if t == first and i == ids[0]]
        assert kept == sorted((group if ids[0] else group[:1]) + [("None", other, 8)])


# nearest neighbours ----------------------------------------------------------------------------


def test_nearest_recall_and_order(spark):
    table = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    got = ann.nearest(table, F.col("id") % 20 == 0, 20, block=200, chunk=10).toPandas()
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        best = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and ids[i] not in own.vec_id.tolist()
        assert own.score.tolist() == [score[ids == v][0] for v in own.vec_id]
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()
        hits += len(set(ids[best]) & set(own.vec_id))
        total += 20
    assert hits / total >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-5.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0, 1.0]), (1, [1.0, 0.0]), (1, [9.0, 9.0]), (40, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = [tuple(r) for r in ann.nearest(frame, F.col("id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 9.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0), (40, 1, 1, 27.0), (40, 2, 3, 3.0), (40, 3, None, 3.0)]
    # rows without an id and of repeated ids, a query's own twin among them, are candidates like any other
    twins = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (None, [3.0, 0.0]), (None, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(twins, F.col("id") % 20 == 0, 9).orderBy("query_id", "rank", "vec_id").collect()]
    assert got == sorted([(0, 1, None, 3.0), (0, 2, 0, 1.0), (0, 3, None, 1.0), (0, 4, 5, 0.0)] * 2, key=lambda r: r[1])
    assert ann.nearest(frame.limit(0), F.col("id") % 20 == 0).count() == 0
    copies = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(200)], "vec_id long, embedding array<float>")
    got = ann.nearest(copies, F.col("id") % 20 == 0, 20, block=64).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [*range(20)]


# WARC ------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, monkeypatch):
    big = "".join(random.Random(3).choices("abcdé\r\n𝕏<>", k=400_000))
    rows = [(1, "http://a/x y\r\nWARC-Type: evilé", big), (2, "http://b", big), (3, None, None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (9, "u", "y" * 100), (8, "u", "y" * 100), (10, "u", "WARC/1.1\r\n\r\nHTTP/1.1\r\n\r\n" * 9), (None, "n", "y" * 100), (None, "n", "z" * 200), (None, "n", "z" * 200), (8, "u", "y" * 100)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("piece", F.lit(1)).repartition(2)
    manifest = warc.write_archives(warc.plan_records(frame), shared_path(spark, "warc"), chunk=1000, archive_bytes=200_000)
    assert manifest.count() > 1
    chunks = warc.read_archives(manifest, chunk=777)
    got = sorted(map(str, map(tuple, warc.page_records(chunks, "bigint").collect())))
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h) if first.get(h) != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(map(str, want))
    largest = chunks.where("page_id = '1'").orderBy("chunk").collect()
    assert max(len(r.data) for r in largest) <= 777 and b"".join(r.data for r in largest) == big.encode()
    assert [r.chunk for r in largest] == list(range(len(largest))) and largest[-1]["last"] and not largest[0]["last"]
    assert largest[3].digest_so_far == hashlib.sha256(big.encode()[: 4 * 777]).hexdigest()
    assert warc.round_trip(frame.limit(0), spark).count() == 0


def test_archive_is_valid_warc_and_detects_damage(spark, tmp_path):
    import gzip

    frame = spark.createDataFrame([(1, "http://é/", "payload é" * 40), (2, "u", "payload é" * 40)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(warc.plan_records(frame), f"file://{tmp_path}/w").first().path
    raw = gzip.open(path.removeprefix("file://")).read()
    at, kinds = 0, []
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in raw[at:end].decode("ascii").split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
        at = end + 4 + int(fields["Content-Length"])
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
        kinds.append(fields["WARC-Type"])
    assert kinds == ["warcinfo", "response", "revisit"]
    bad = tmp_path / "bad.warc.gz"
    bad.write_bytes(gzip.compress(raw[: raw.index(b"payload") + 20]))
    with pytest.raises(EOFError):
        list(warc.records(str(bad)))


# pipeline --------------------------------------------------------------------------------------


def test_pipeline_equals_plain_version(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "mixing"]
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    texts = {i: (r.source, r.text) for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    pages, held = {}, {}
    for s, t in texts.values():
        pages[s] = pages.get(s, 0) + 1
        for x in set(t.split("\n")):
            held[s, x] = held.get((s, x), 0) + 1
    gone = {k for k, n in held.items() if n >= 5 and n > 0.08 * pages[k[0]] and k[1].strip()}
    texts = {i: (s, "\n".join(x for x in t.split("\n") if (s, x) not in gone)) for i, (s, t) in texts.items()}
    groups, _ = plain_groups([(i, t) for i, (_, t) in texts.items()])
    texts = {i: v for (i, v), g in zip(texts.items(), groups) if i == g}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = {d for d, _ in plain_contaminated([(i, t) for i, (_, t) in texts.items()], items)}
    assert bad
    texts = {i: v for i, v in texts.items() if i not in bad}
    taken = queue([(i, s, t) for i, (s, t) in texts.items()])
    want = {i: (t, n) for i, (s, t) in texts.items() for n in [taken[(i, "=" + s, len(t.split()))]] if n}
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == [*spark.read.parquet(f"{SF_SMALL}/documents.parquet").columns, "taken"]
    assert {r.doc_id: (r.text, r.taken) for r in out.collect()} == want and out.count() == len(want)
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_pipeline_leaves_no_tables_of_its_stages(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    from cohortlens.llm import common

    monkeypatch.setattr(common, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.count()
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "llm").iterdir()) == ["decontamination", "queue", "targets", "units"]
