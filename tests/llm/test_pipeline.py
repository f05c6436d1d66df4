import random
from collections import Counter

import pytest
from llm_fixtures import words

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus of every kind that a stage decides on, in a folder of tables."""
    rng, d = random.Random(3), tmp_path_factory.mktemp("pipeline")
    docs, labels = [], []

    def add(text, good=1, n=[0]):
        docs.append((n[0], text, "en", "src0", len(text), "extra"))
        labels.append((n[0], good, 0))
        n[0] += 1
        return n[0] - 1

    text = lambda n: " ".join(w if i % 9 else w.capitalize() + "." for i, w in enumerate(words(rng, n, 900).replace("w", "ta").split()))
    kinds = {"clean": [add(text(rng.randrange(40, 90))) for _ in range(60)]}
    kinds["bad"] = [add("### ".join(words(rng, 60).split()), 0) for _ in range(60)]
    line = text(60)
    kinds["line"] = [add(text(30) + "\n" + line) for _ in range(4)]
    base = text(120).split()
    near = []
    for k, width in enumerate((6, 9, 14, 23)):  # near copies cut into lines of which no two are similar
        w = list(base)
        w[10 * k + 5] = f"other{k}"
        near.append(add("\n".join(" ".join(w[i:i + width]) for i in range(0, len(w), width))))
    kinds["near"] = near
    item = text(40)
    kinds["leak"] = [add(text(20) + " " + item + " " + text(20)) for _ in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row_id string").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, text(30))], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), kinds


def test_every_stage_decides_on_what_the_last_kept(spark, folder):
    d, kinds = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept, last = docs.columns, [], docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, last, d)
        if i < 4:
            assert out.columns == columns, name
            out.write.parquet(f"{d}/stage-{i}")
            last = spark.read.parquet(f"{d}/stage-{i}")
            kept.append({r["doc_id"]: r["text"] for r in last.collect()})
    quality, lines, near, clean = kept
    assert not set(quality) & set(kinds["bad"]) and set(kinds["clean"]) <= set(quality)
    first, *later = kinds["line"]
    assert quality[first] == lines[first] and all("\n" not in lines[i] for i in later)
    assert set(lines) == set(quality)
    assert len(set(near) & set(kinds["near"])) == 1 and min(kinds["near"]) in near
    assert set(near) - set(kinds["near"]) == set(lines) - set(kinds["near"])
    assert set(clean) == set(near) - set(kinds["leak"]) and set(kinds["clean"]) <= set(clean)
    pieces = out.collect()
    assert {r["doc_id"] for r in pieces} == set(clean)
    held = Counter()
    for r in pieces:
        held[r["doc_id"]] += r["length"]
    assert all(held[r["doc_id"]] == r["doc_tokens"] for r in pieces)


def test_run_gives_the_last_stage(spark, folder):
    d, kinds = folder
    got = corpus_pipeline.run(spark, d)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert set(kinds["clean"]) <= {r["doc_id"] for r in got.collect()}


def test_every_kind_of_row_runs_through(spark, folder, tmp_path):
    """Null and empty texts, repeated rows, null ids and a clashing column go through every stage; no clean document is lost."""
    d, kinds = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    more = spark.createDataFrame([(9000, None, None, None, None, None), (9001, "", "en", "s", 0, "x"), (9002, "\n \n", "en", "s", 3, "x"), (None, "A lone line of a document without an id here.", "en", "s", 1, "x")],
                                 docs.schema)
    mixed = docs.union(more).union(docs.where("doc_id < 5")).withColumn("h", docs.doc_id).repartition(4)
    mixed.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(kinds["clean"]) <= {r["doc_id"] for r in got}
    held = Counter()
    for r in got:
        held[r["doc_id"]] += r["length"]
    assert not any(held[r["doc_id"]] % r["doc_tokens"] for r in got)


def test_empty_tables_give_no_rows(spark, folder, tmp_path):
    d, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
