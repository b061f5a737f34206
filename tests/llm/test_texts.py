"""Language ID, license scan, line dedup, secret scan, decontamination and token counts against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, language_id, license_scan, line_dedup, secret_scan, token_count
from cohortlens.llm.common import shared_path
from tests.conftest import SF_MID, SF_SMALL

ODD = [None, "", " ", "\n\n", "1234 !!", "É" * 50, "日本語 テキスト", "a\x00b", "𝕏𝕐 x", " wide space"]


def documents(spark, sf=SF_SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


# language ID -----------------------------------------------------------------------------------


def counted(text):
    """N-grams of up to three characters inside words with edges, by plain Python."""
    out = Counter()
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    for w in words:
        out.update(w)
        w = f" {w} "
        out.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def by_rank(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_language_id_equals_plain_version(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark).select("doc_id", "text", "lang").collect()][:120]
    rows += [(1000 + i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)] + [rows[0], (None, "the and of", "en")]
    got = language_id.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    sums = {}
    for i, t, x in rows:
        if not held[i] and x is not None and t is not None:
            sums.setdefault(x, Counter()).update(counted(t))
    profiles = {x: {g: r for r, g in enumerate(by_rank(c, 400))} for x, c in sums.items() if c}
    want = {}
    for i, t, _ in rows:
        own = by_rank(counted(t), 400)
        out = {x: sum(abs(p[g] - r) if g in p else 400 for r, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(out), key=out.get)
        want[i] = (best, 1 - out[best] / (400 * len(own))) if own else ("und", 0.0)
    for r in got:
        assert r.held_out == held[r.doc_id]
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1]) and 0 <= r.score <= 1


def test_language_id_held_out_accuracy(spark):
    docs = documents(spark, SF_MID)
    got = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.97


def test_language_id_long_text_and_nothing_learned(spark, monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "béta", "x", "gamma-delta"], k=5000)) + "z" * 3000
    whole = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 500)
    for a, b in zip(whole, language_id.ngram_counts(text)):
        assert np.array_equal(a, b)
    frame = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.predict_languages(frame).collect()] == [(1, False, "und", 0.0)]
    assert language_id.predict_languages(frame.limit(0)).count() == 0


def test_rejected_documents(spark):
    docs = documents(spark).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    noise = random.Random(2)
    strange = ["".join(noise.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=2000)), " ".join("".join(noise.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)), "Привет мир, как дела", "日本語のテキスト"]
    odd = docs.limit(3).withColumn("text", F.lit("12 34 !")).union(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    for text in strange:  # their ids are held out, so that nothing is learned from them
        odd = odd.union(docs.where(language_id.held_out()).limit(1).withColumn("text", F.lit(text)))
    kept = language_id.reject_unidentified(docs.union(odd))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


# license scan ----------------------------------------------------------------------------------


def test_license_spans(spark):
    apache = license_scan.TEMPLATES["apache-2.0-short"]
    mit = license_scan.TEMPLATES["mit"]
    changed = mit.replace("free of charge", "at no cost", 1).replace("portions of the Software", "portions of the same Software", 1)
    texts = {1: f"é {apache} tail {apache.upper()}", 2: f"intro words\n{changed} the end", 3: "nothing here at all", 4: "", 5: None, 6: "Licensed under the", 7: "x " * 200000 + apache}
    frame = spark.createDataFrame(list(texts.items()), "doc_id int, text string").withColumn("license", F.lit(0))
    got = {(r.doc_id, r.license): r for r in license_scan.scan(frame, ["doc_id"]).collect()}
    spans = got[(1, "apache-2.0-short")].spans.split(",")
    assert [texts[1][int(a) : int(b)] for a, b in (x.split(":") for x in spans)] == [apache[:-1], apache[:-1].upper()]
    assert got[(1, "apache-2.0-short")].n_matches == 2 and got[(1, "apache-2.0-short")].coverage == 1.0
    assert 0.9 < got[(2, "mit")].coverage < 1
    a, b = map(int, got[(2, "mit")].spans.split(":"))
    assert texts[2][a:b].startswith("Permission is hereby") and texts[2][a:b].endswith("of the same Software")
    assert {k[0] for k in got} == {1, 2, 7}
    assert license_scan.scan(frame.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(frame, ["doc_id"], templates={"short": "two words"})


@pytest.mark.parametrize("name", ["mit-short", "cc-by-4.0-short", "apache-2.0-short", "apache-2.0", "bsd"])
@pytest.mark.parametrize("between", ["", "x ", "one two three four ", "a b c d e f g h i j "])
def test_license_repeated_adjacent_notices(name, between):
    """Every one of many notices that follow each other closely is found."""
    notice = license_scan.TEMPLATES[name]
    size, gap = (len(license_scan.words(x.encode())[0]) for x in (notice, between))
    hashes = license_scan.words((f"{notice} {between}" * 60).encode())[2]
    found = [x[1:] for x in license_scan.Scanner({name: notice}).matches(hashes, 0.8)]
    assert sorted(found, key=lambda x: x[1]) == [(1.0, i * (size + gap), i * (size + gap) + size - 1) for i in range(60)]


def test_license_better_notice_behind_a_lesser_one():
    """The better of two neighbours is aligned first; the one before it still counts."""
    hashes = license_scan.words(b"Licensed under the Apache License, Version two. Licensed under the Apache License, Version 2.0.")[2]
    name = "apache-2.0-short"
    found = sorted(license_scan.Scanner({name: license_scan.TEMPLATES[name]}).matches(hashes, 0.7), key=lambda x: x[2])
    assert [x[1:] for x in found] == [(0.75, 0, 5), (1.0, 7, 14)]


def test_license_words_that_tell_apart(spark):
    texts = {
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0-short": 1.0},
        "Licensed under CC BY-SA 4.0.": {"cc-by-sa-4.0-short": 1.0},
        "Licensed under CC BY 4.0.": {"cc-by-4.0-short": 1.0},
        "Licensed under CC BY-ND 4.0.": {"cc-by-nd-4.0-short": 1.0},
        "Licensed under CC BY-ND 2.0.": {},
        "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.": {"cc-by-nc-4.0-short": 1.0, "cc-by-4.0-short": 1.0},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": {"cc-by-nc-4.0": 1.0},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"cc-by-sa-4.0": 1.0},
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": {"cc-by-3.0": 1.0},
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by-4.0": 1.0},
        "This work is licensed under the GNU General Public License, version 2.": {"gpl-2.0-short": 1.0},
        "This work is licensed under the GNU General Public License, version 1.": {},
        "This work is licensed under the GNU Lesser General Public License, version 3.": {"lgpl-3.0-short": 1.0},
        license_scan.TEMPLATES["gpl-3.0"].replace("version 3", "version 2"): {"gpl-2.0": 1.0},
        "Released under the BSD License": {},
        "# Licensed under the BSD 3-Clause License": {"bsd-3-clause-short": 1.0},
        "// SPDX-License-Identifier: MIT\n": {"spdx-mit": 1.0},
        "// SPDX-License-Identifier: MIT-0\n": {"spdx-mit-0": 1.0},
        "/* SPDX-License-Identifier: GPL-2.0-or-later */": {"spdx-gpl-2.0": 1.0},
        "SPDX-License-Identifier: LicenseRef-Own": {},
        "Released under the MIT": {"mit-short": 0.8},
        "now released beneath the MIT License.": {"mit-short": 0.8},
        "Released under the very MIT License": {"mit-short": 5 / 6},
        "Released under the very very MIT License": {},
        license_scan.TEMPLATES["apache-2.0"]: {"apache-2.0": 1.0},
        license_scan.TEMPLATES["apache-2.0-short"].replace("the", "this"): {"apache-2.0-short": 0.875},
    }
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id int, text string")
    got = {x: {} for x in texts}
    for r in license_scan.scan(frame, ["doc_id"]).collect():
        got[list(texts)[r.doc_id]][r.license] = r.coverage
    assert got == texts


def test_license_short_templates_keep_all_fingerprints():
    """A changed word at either end, or a fingerprint of three words alone, still finds a short template."""
    for name, text in license_scan.TEMPLATES.items():
        own = license_scan.words(text.encode())[2]
        if 5 <= len(own) < 7:  # four words cover too little with one of them changed
            scanner = license_scan.Scanner({name: text})
            for i in (0, len(own) - 1):
                changed = own.copy()
                changed[i] = 1
                assert [x[1] for x in scanner.matches(changed, 0.8)] == [(len(own) - 1) / len(own)], name


def test_license_alignment_equals_full_table():
    rng = random.Random(4)
    for _ in range(40):
        template = np.array([rng.randrange(12) for _ in range(15)], dtype=np.uint64)
        text = [int(x) for x in template]
        for _ in range(3):
            text[rng.randrange(len(text))] = 99
            text.insert(rng.randrange(len(text)), 98)
        text = np.array([7, 7, *text, 3], dtype=np.uint64)
        score = np.zeros((len(template) + 1, len(text) + 1), dtype=int)
        for i in range(1, len(template) + 1):
            for j in range(1, len(text) + 1):
                same = 2 if template[i - 1] == text[j - 1] else -1
                score[i, j] = max(0, score[i - 1, j - 1] + same, score[i - 1, j] - 1, score[i, j - 1] - 1)
        n, first, last = license_scan.align(template, text, -100, 100)
        assert 0 <= first <= last < len(text) and 2 * n >= score.max()


def plain_pairs(template, text):
    """Matched (template, text) words and words put between of the best local alignment of the whole table."""
    table = {}
    none, best = (0, 0, 0, ()), (0, 0, 0, ())
    for i, w in enumerate(template):
        for j, x in enumerate(text):
            d, u, s = table.get((i - 1, j - 1), none), table.get((i - 1, j), none), table.get((i, j - 1), none)
            d = (d[0] + 2, d[1] + 1, d[2], (*d[3], (i, j))) if w == x else (d[0] - 1, *d[1:])
            cell = max((d, (u[0] - 1, *u[1:]), (s[0] - 1, s[1], s[2] + 1, s[3])), key=lambda c: c[:2])
            table[i, j] = cell = cell if cell[0] > 0 else none
            if w == x and cell[0] > best[0]:
                best = cell
    return best[3], best[2]


def plain_licenses(text):
    """(license, coverage, first word, last word) without fingerprints or bands: every template against all of the text."""
    plain = lambda x: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower())
    own, found = plain(text), []
    for name, notice in license_scan.TEMPLATES.items():
        template, todo, seen = plain(notice), [(0, len(own))], set()
        while todo:
            lo, hi = todo.pop()
            part = own[lo:hi]
            if (lo, hi) in seen or sum(w in part for w in template) < 0.8 * len(template):
                continue
            seen.add((lo, hi))
            pairs, more = plain_pairs(template, part)
            matched = dict(pairs)
            marks = [plain(x) for x in license_scan.IDENTITY.get(name, ())]
            told = all(any(template[p:p + len(m)] == m and [matched.get(p + i) for i in range(len(m))] == [matched.get(p, -99) + i for i in range(len(m))] for p in range(len(template))) for m in marks)
            first, last = lo + pairs[0][1], lo + pairs[-1][1]
            if told and len(pairs) >= 0.8 * (len(template) + more):
                found.append((-len(pairs), -len(pairs) / (len(template) + more), first, name, last))
                todo += [(lo, first), (last + 1, hi)]
            else:  # what is left without its first or its last word
                todo += [(first + 1, hi), (lo, last)]
    kept = []
    for n, share, first, name, last in sorted(found):
        if all(last < a or first > b for _, _, a, b in kept):
            kept.append((name, -share, first, last))
    return sorted(kept)


def test_license_scan_equals_plain_version(spark):
    """Every template, with words replaced, left out and put between, against whole tables over whole texts."""
    rng = random.Random(11)
    filler = ["lorem", "ipsum", "license", "under", "the", "work", "version", "dolor", "é", "4", "0"]
    texts = ["", " ".join(filler)]
    for name, notice in license_scan.TEMPLATES.items():
        out = rng.choices(filler, k=rng.randrange(12))
        for k in range(2 if len(notice) < 150 else 1):
            changed = notice.split()
            for _ in range(rng.randrange(1 + len(changed) // 5)):
                at = 5 * rng.randrange(1 + len(changed) // 5)
                changed[at:at + rng.randrange(2)] = rng.choices(filler, k=rng.randrange(2))
            out += changed + rng.choices(filler, k=rng.randrange(8))
        texts.append(" ".join(out))
    mit = license_scan.TEMPLATES["mit"].split()
    texts.append(" ".join([*mit[:40], *["between"] * 16, *mit[40:]]))  # as many words in one place as the coverage allows
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in license_scan.scan(frame, ["doc_id"]).collect():
        ends = [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", texts[r.doc_id])]
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",")]
        got.setdefault(r.doc_id, []).extend((r.license, [a for a, _ in ends].index(s), [b for _, b in ends].index(e)) for s, e in spans)
    missed = {}
    for i, text in enumerate(texts):
        want = [(n, a, b) for n, share, a, b in plain_licenses(text)]
        if sorted(want) != sorted(got.get(i, [])):
            missed[i] = (text, want, got.get(i))
    assert not missed
    assert len(got) > 60


def test_license_words_across_blocks(monkeypatch):
    data = " ".join(random.Random(2).choices(["Éa", "bcd", "x", "42"], k=3000)).encode()
    whole = license_scan.words(data)
    monkeypatch.setattr(license_scan, "BLOCK", 64)
    for a, b in zip(whole, license_scan.words(data)):
        assert np.array_equal(a, b)
    assert len(whole[0]) == 3000 and len(set(whole[2].tolist())) == 4


# line dedup ------------------------------------------------------------------------------------


@pytest.mark.parametrize("sent", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup_equals_plain_version(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", sent)
    rng = random.Random(5)
    rows = []
    for i in range(120):
        host = rng.choice(["a", "a", "b", None, "tiny" if i % 40 == 0 else "a"])
        lines = [rng.choice(["menu", "foot", "", "  ", "rare é"]) for _ in range(rng.randrange(4))] + [f"own {i}"]
        rng.shuffle(lines)
        rows.append((i, host, "\n".join(lines), i))
    rows += [(500, "a", None, 1), (501, "a", "", 2), (502, None, "menu", 3), rows[0], rows[0]]
    frame = spark.createDataFrame(rows, "doc_id int, source string, text string, n_lines int").withColumn("line", F.lit("x"))
    got = line_dedup.dedup_lines(frame, max_ratio=0.3, min_pages=3)
    assert got.columns == [*frame.columns, "n_lines_", "n_dropped"]
    each = {(r[1], r[2]) for r in rows}  # rows of one host and text are one page
    pages, held = Counter(h for h, _ in each), Counter((h, x) for h, t in each for x in set((t or "").split("\n")) if t is not None)
    gone = {k for k, n in held.items() if n >= 3 and n > 0.3 * pages[k[0]] and k[1].strip()}
    assert ("a", "menu") in gone or ("b", "menu") in gone
    want = []
    for i, host, text, _ in rows:
        lines = None if text is None else text.split("\n")
        kept = None if lines is None else [x for x in lines if (host, x) not in gone]
        want.append((i, None if kept is None else "\n".join(kept), len(lines or []), len(lines or []) - len(kept or [])))
    assert sorted(got.select("doc_id", F.coalesce("text", F.lit("<null>")), "n_lines_", "n_dropped").collect()) == sorted((i, "<null>" if t is None else t, *n) for i, t, *n in want)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_copies_of_a_page_are_no_boilerplate(spark):
    """9 copies among 100 pages of a source keep their text; a line of 9 different pages goes."""
    copy = "one copied page\nwith lines of its own"
    rows = [(i, "a", copy if i < 9 else f"own {i}\nmenu" if i < 18 else f"own {i}", 0) for i in range(100)] + [(200, "a", None, 0), (201, "a", None, 0)]
    got = line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int"))
    want = {i: None if t is None else t.replace("\nmenu", "") for i, _, t, _ in rows}
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


# secret scan -----------------------------------------------------------------------------------

BASE = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_spans(text):
    out = []
    for o, (kind, rule) in enumerate(BASE.items()):
        for m in rule.finditer(text or ""):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                out.append((m.start(), o, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secrets_equal_plain_version(spark):
    hexes = "0123456789abcdef" * 2
    texts = [
        *ODD, "é𝕏 password = 'hunter22!' token:abc", "secret=token: abcdefgh", "PASSWORD=abcdef password=abcde passwd:x123456y", f"AKIA{'Z' * 15} AKIA{'Z' * 16} {hexes} {hexes[:23]} {hexes[:24]}",
        f"token={hexes}AKIA{'1' * 20}", "api_key: \"AbC+/=.-_9\"\napikey  =  zzzzzz", f"AKIAx AKIAAKIA{'Q' * 20}", " ".join(f"secret={'k' * (i % 9)}" for i in range(500)), "passworKd=abcdefgh toKen=abcdefgh",
    ]
    texts += [r.text for r in documents(spark, SF_MID).select("text").collect()][:300]
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, texts[12], texts[12]])], "doc_id int, text string, spans int")
    got = {r.doc_id: r for r in secret_scan.secrets(frame, shared_path(spark, "ledger"), ["doc_id"]).collect()}
    for i, t in enumerate([*texts, texts[12], texts[12]]):
        want = base_spans(t)
        assert got[i].spans == want, t
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert got[i].blob == hashlib.sha256((t or "").encode()).hexdigest()


def test_ledger_scans_only_unseen_pairs(spark):
    ledger = shared_path(spark, "ledger")
    first = spark.createDataFrame([("a", "token=abcdef"), ("b", "token=abcdef"), ("c", "none")], "path string, text string")
    assert secret_scan.scan(first, ledger).count() == 2 * 3
    assert secret_scan.scan(first, ledger).count() == 0
    more = first.union(spark.createDataFrame([("d", "secret=abcdefg")], "path string, text string"))
    assert secret_scan.scan(more, ledger).count() == 3
    assign, access, hexes = secret_scan.RULES
    newer = (secret_scan.Rule("assign", 2, assign.pattern, 2, 7, assign.hints), access, hexes)
    assert {(r.rule, r.version) for r in secret_scan.scan(more, ledger, newer).collect()} == {("assign", 2)}
    assert {(r.path, r.spans) for r in secret_scan.secrets(more, ledger, ["path"], newer).collect()} == {("a", ""), ("b", ""), ("c", ""), ("d", "assign:0:14")}
    assert {(r.path, r.spans) for r in secret_scan.secrets(more, ledger, ["path"]).collect()} == {("a", "assign:0:12"), ("b", "assign:0:12"), ("c", ""), ("d", "assign:0:14")}
    # a scan that broke off after its findings is repeated: they count once
    secret_scan.blob_findings(spark, ledger)
    spark.createDataFrame([(hashlib.sha256(b"token=abcdef").hexdigest(), "assign", 1, 0, 12)], secret_scan.FINDINGS).write.mode("append").parquet(f"{ledger}/findings")
    assert {r.n_assign for r in secret_scan.secrets(more.where("path = 'a'"), ledger, ["path"]).collect()} == {1}
    assert secret_scan.secrets(first.limit(0), shared_path(spark, "ledger"), ["path"]).count() == 0


# decontamination -------------------------------------------------------------------------------


def word_list(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def plain_most_equal(same):
    """Most equal words, then fewest words, of all stretches with the share."""
    found = [(sum(same[a:b]), a - b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a)]
    n, minus = max(found, default=(0, 0))
    return n, -minus


def plain_contaminated(docs, items, masks=decontaminate.MASKS):
    """(doc, item) to the most equal words of a stretch on a diagonal where some mask hits."""
    out = {}
    first = {}
    for i, t in sorted(items):
        first.setdefault(tuple(word_list(t)), i)
    for w, item in first.items():
        for d, t in docs:
            words = word_list(t)
            if len(w) <= len(masks[0]):  # a short item is found as a whole, from five words on
                if len(w) >= 5 and any(tuple(words[p:p + len(w)]) == w for p in range(len(words))):
                    out[(d, item)] = (len(w), len(w))
                continue
            places = {}
            for p, x in enumerate(words):
                places.setdefault(x, []).append(p)
            alike = Counter(p - j for j, x in enumerate(w) for p in places.get(x, ()))
            for shift in (x for x, n in alike.items() if n >= 6):  # each mask needs six equal words
                same = {j: words[shift + j] == w[j] for j in range(len(w)) if 0 <= shift + j < len(words)}
                hit = any(all(same.get(j + k, False) for k, c in enumerate(m) if c == "1") for m in masks for j in same if j + len(m) - 1 in same)
                if not hit:
                    continue
                best = plain_most_equal([same[j] for j in sorted(same)])
                if best[0] >= min(13, len(w)):
                    out[(d, item)] = max(out.get((d, item), (0, 0)), best)
    return out


@pytest.mark.parametrize("broadcast_rows, hot", [(decontaminate.BROADCAST_ROWS, decontaminate.HOT), (0, decontaminate.HOT), (decontaminate.BROADCAST_ROWS, 0), (0, 1)])
def test_decontamination_equals_plain_version(spark, monkeypatch, broadcast_rows, hot):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(decontaminate, "HOT", hot)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 9, 12, 20, 40])))) for i in range(12)]
    items += [(20 + i, " ".join([*vocabulary[:10], *rng.choices(vocabulary, k=n)])) for i, n in enumerate([0, 1, 2, 3, 6, 6, 9])]  # one opening
    items += [(40, "w1 w2 w3 w4"), (41, "w1 w2 w3 w4 w5"), (42, "w1 w2 w3 w4 w5 w6 w7 w8")]
    items += [(50, items[2][1].upper()), (51, None), (52, ""), (None, "a b c d e f g h i j k l m n o p")]
    docs = [(100 + i, t) for i, t in enumerate(ODD)]
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(60))
        taken = (rng.choice(items[:19])[1]).split()
        if i % 3:
            lo = rng.randrange(len(taken))
            taken = [x if rng.random() > 0.08 else "other" for x in (taken[lo:] if i % 5 == 0 else taken)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = taken
        docs.append((i, ",\n".join(words)))
    docs += [docs[15], (None, items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_words) for r in decontaminate.contaminated(frame, bench, ["doc_id"]).collect()}
    want = plain_contaminated(docs, [x for x in items if x[0] is not None and x[1]])
    assert got == want and len(want) > 10
    clean = decontaminate.without_benchmark(frame, bench)
    assert clean.columns == frame.columns
    bad = {t for d, t in docs if any(k[0] == d for k in want)}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t in docs if t not in bad)
    assert decontaminate.contaminated(frame.limit(0), bench, ["doc_id"]).count() == 0
    assert decontaminate.contaminated(frame, bench.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination_with_clashing_names_and_one_id(spark, monkeypatch, broadcast_rows):
    """Documents of one id, and columns named like the operator's own."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    item = " ".join(f"w{i}" for i in range(15))
    rows = [(1, "x", f"{item} tail"), (1, "x", "nothing of it here"), (1, "x", f"{item} tail"), (None, None, f"head {item}")]
    docs = spark.createDataFrame(rows, "words long, item string, seed string")
    bench = spark.createDataFrame([(7, item), (8, "too short")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench, ["words", "item"], "seed")
    assert got.columns == ["words", "item", "item_id", "n_equal", "n_words"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "x", 7, 15, 15), (None, None, 7, 15, 15)]


def test_items_of_one_opening_are_not_joined_to_each_line_of_it(spark, monkeypatch):
    """Lines and items that begin alike: the pairs compared grow with the items found, not with lines times items."""
    n = 200
    opening = " ".join(f"o{i}" for i in range(10))
    items = [(i, f"{opening} " + " ".join(f"i{i}x{j}" for j in range(10))) for i in range(n)]
    lines = [f"{opening} " + " ".join(f"d{i}x{j}" for j in range(10)) for i in range(n)]
    docs = spark.createDataFrame([(d, "\n".join([*lines, items[d][1]])) for d in range(4)], "doc_id long, text string")
    seen = []
    here = decontaminate._here
    monkeypatch.setattr(decontaminate, "_here", lambda hits, *columns: seen.append(here(hits, *columns)) or seen[-1])
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
    assert sorted(map(tuple, got.collect())) == [(d, d, 20, 20) for d in range(4)]
    assert sum(x.count() for x in seen) < 10 * n


def test_most_equal_words_of_all_stretches(spark):
    rng = random.Random(8)
    rows = [[rng.random() < share for _ in range(rng.randrange(1, 45))] for share in (0.3, 0.6, 0.75, 0.8, 0.85, 0.95) for _ in range(40)]
    frame = spark.createDataFrame([(same, [1] * len(same), [int(x) for x in same]) for same in rows], "same array<boolean>, a array<long>, b array<long>")
    for r in frame.select("same", decontaminate.most_equal(F.col("a"), F.col("b"), 0.8).alias("m")).collect():
        n, m = plain_most_equal(r.same)
        assert tuple(r.m) == ((n, m) if n else (0, 0))


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination_takes_any_stretch(spark, monkeypatch, broadcast_rows):
    """Replaced words near the ends, and a copy that goes on with more of the item."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    items = {1: [f"a{i}" for i in range(15)], 2: [f"b{i}" for i in range(69)]}
    ends = [x if i not in (1, 13) else "other" for i, x in enumerate(items[1])]
    on = [x if i < 13 or (i - 13) % 4 else "other" for i, x in enumerate(items[2])]
    few = [x if i not in (1, 7, 13) else "other" for i, x in enumerate(items[1])]
    docs = spark.createDataFrame([(1, " ".join(ends)), (2, " ".join(on)), (3, " ".join(few))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_words) for r in decontaminate.contaminated(docs, bench, ["doc_id"]).collect()}
    same = [x == y for x, y in zip(on, items[2])]
    assert got == {(1, 1): (13, 15), (2, 2): plain_most_equal(same)}
    assert [r.doc_id for r in decontaminate.without_benchmark(docs, bench).collect()] == [3]


def test_queries_take_any_stretch(spark, tmp_path):
    import corpus_pipeline
    from cohortlens.llm.queries import QUERIES

    item = [f"a{i}" for i in range(15)]
    docs = spark.createDataFrame([(1, " ".join(x if i not in (1, 13) else "other" for i, x in enumerate(item)))], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in QUERIES["op5_decontamination"](spark, str(tmp_path)).collect()] == [(1, 7, 13, 15)]
    assert corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path)).count() == 0


def test_every_benchmark_passage_in_documents_is_found(spark):
    docs, bench = documents(spark, SF_MID), spark.read.parquet(f"{SF_MID}/benchmark.parquet")
    got = {r.doc_id for r in decontaminate.contaminated(docs, bench, ["doc_id"]).collect()}
    items = [r.text for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(x in (r.text or "") for x in items)}
    assert want and want <= got


# token counts ----------------------------------------------------------------------------------


def tokenizer_path(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, name):
    path = tokenizer_path(name)
    rng = random.Random(7)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "12", "!", "日", " ", "\u0085", "<|endoftext|>", "don't", "𝕏", "ß", " ", " the", "😀", "\r\n"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(300)]
    texts += ["a" * 20000, " " * 20000, "word " * 30000, "x1y2 " * 20000, "no\nspaces\n" * 9000, "<|endoftext|>" * 50, "é" * 9000]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        from tokenizers import Tokenizer

        want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_count.token_lengths(texts, path) == want
    assert token_count.token_lengths(texts, path, piece_chars=50, group_bytes=300) == want


def test_token_count_rows(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(1, None, 3), (1, "", 3), (2, "é word", 3), (None, "x " * 600, 3)], "doc_id long, text string, n_tokens int")
    got = sorted(map(str, token_count.count_tokens(frame, path, ["doc_id"]).collect()))
    assert got == sorted(f"Row(doc_id={i}, n_bytes={b}, n_tokens={n}, over_limit={o})" for i, b, n, o in [(1, 0, 0, False), (1, 0, 0, False), (2, 7, 2, False), (None, 1200, 601, True)])
    assert token_count.count_tokens(frame.limit(0), path, ["doc_id"]).count() == 0
    assert "".join(token_count.pieces("ab cd12 ef" * 40, 7)) == "ab cd12 ef" * 40
