"""Columns whose names clash with an operator's own, archive ids, and the pipeline on odd tables."""

import gzip

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from cohortlens.llm import decontaminate, language_id, license_scan, ngram_join, secret_scan, simhash, token_count, warc
from cohortlens.llm.common import shared_path
from cohortlens.llm.queries import TOKENIZER
from tests.conftest import SF_SMALL

WORDS = "which of the following best describes the way a plant makes its food from light and water"
OPERATORS = {
    "op1": lambda d, keep: language_id.identify(d, language_id.learn_profiles(d), keep),
    "op2": license_scan.scan,
    "op4": lambda d, keep: secret_scan.secrets(d, shared_path(d.sparkSession, "ledger"), keep),
    "op5": lambda d, keep: decontaminate.contaminated(d, d.sparkSession.createDataFrame([("item", WORDS)], "item_id string, text string"), keep),
    "op9": simhash.near_duplicates,
    "op10": lambda d, keep: token_count.count_tokens(d, public_tokenizers.path(TOKENIZER), keep),
    "op11": ngram_join.jaccard_components,
}
CLASHES = ["blob", "spans", "n_hex", "license", "coverage", "lang_pred", "Score", "item_id", "n_words", "fp", "component_id", "fingerprint", "n_tokens", "__text", "__k0", "key", "n", "set", "id",
           "n_shingles", "words", "item"]


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    text = f"{WORDS} password=hunter2hunter2 Released under the MIT License."
    docs = spark.createDataFrame([(i, "en", None if i == 3 else text) for i in range(4)], "doc_id long, lang string, text string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in CLASHES})
    plain = OPERATORS[name](docs, ["doc_id"])
    out = OPERATORS[name](docs, ["doc_id", *CLASHES])
    assert len({c.lower() for c in out.columns}) == len(out.columns) == len(plain.columns) + len(CLASHES)
    assert out.columns[: 1 + len(CLASHES)] == ["doc_id", *CLASHES] and plain.columns[1:] == [c.rstrip("_") for c in out.columns[1 + len(CLASHES) :]]
    rows = [tuple(r) for r in out.collect()]
    assert rows and all(r[1 : 1 + len(CLASHES)] == tuple(f"{c}:{r[0]}" for c in CLASHES) for r in rows)
    assert sorted((r[0], *r[1 + len(CLASHES) :]) for r in rows) == sorted(tuple(r) for r in plain.collect())


def test_page_ids_come_back_as_they_were(spark, tmp_path):
    ids = ["a%20b", "p%41", "pA", "é/ü?x=1&y", "100%", "%", "", " x ", "line\nbreak", None]
    rows = [(i, "u", f"payload of {i!r}" if k % 2 else "the same long payload " * 9) for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)

    def archive(folder):
        path = warc.write_archives(warc.plan_records(frame), f"file://{tmp_path}/{folder}").first().path
        fields = [dict(x.split(": ", 1) for x in part.split("\r\n")[1:] if ": " in x) for part in gzip.open(path.removeprefix("file://")).read().decode("utf-8").split("WARC/1.1")[2:]]
        return sorted((f.get("X-Page-ID", ""), f["WARC-Record-ID"], f.get("WARC-Refers-To", "")) for f in fields)

    back = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(frame, spark).collect()}
    same = [i for i in ids[::2] if i is not None]
    assert set(back) == set(ids)
    assert all(back[i] == (("response", None) if i == min(same) or i in ids[1::2] else ("revisit", min(same))) for i in ids)
    first, again = archive("one"), archive("two")
    assert [x for x in first if x[0]] == [x for x in again if x[0]]
    assert len({x[1] for x in first}) == len(ids)
    assert {x[2] for x in first if x[2]} <= {x[1] for x in first}


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    odd = docs.limit(60).withColumn("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id"))).withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    odd = odd.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("text", F.lit("")))
    odd = odd.withColumns({"size": F.lit("s"), "taken": F.create_map(F.lit("k"), F.lit(1)), "fp": F.lit(1), "key": F.lit("k"), "__gone": F.lit(0)})
    for name, table, bench in (("empty", docs.limit(0), items), ("odd", odd, items), ("clean", odd, items.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns[:-1] == table.columns and out.columns[-1].startswith("taken")
        rows = out.collect()
        assert (len(rows) == 0) == (name == "empty") and all(r["text"] for r in rows)
