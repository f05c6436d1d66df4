import itertools
import random
import re
from collections import defaultdict

import pytest
from llm_fixtures import corpus, docs, no_docs  # noqa: F401  (fixtures)

from tallyspark.llm import decontaminate, line_dedup, ngram_join
from tallyspark.llm._graph import components
from tallyspark.llm._words import shingle_hashes, word_hashes


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_word_hashes_follow_the_words(corpus):
    texts = [t for _, t in corpus] + ["", None, "a_b-cé D", "x" * 5000]
    h, n = word_hashes(texts)
    assert n.tolist() == [len(words_of(t)) for t in texts]
    flat = [w for t in texts for w in words_of(t)]
    names = {}
    for w, x in zip(flat, h.tolist()):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    _, m = shingle_hashes(h, n)
    assert m.tolist() == [max(len(words_of(t)) - 4, min(len(words_of(t)), 1)) for t in texts]


def test_long_texts_are_cut_between_words(monkeypatch):
    import tallyspark.llm._words as W
    text = "alpha beta gamma " * 400
    want = word_hashes([text, "z"])[0].tolist()
    monkeypatch.setattr(W, "SLAB_CHARS", 100)
    assert word_hashes([text, "z"])[0].tolist() == want


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9995, 128)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9995 and bands * rows <= 128
    more = rows + 1
    assert more * -(-7.6 // -__import__("math").log(1 - 0.8 ** more)) > 128 or rows > 1


def brute_join(corpus):
    """text_id, class_id, n_links of each (doc_id, words)."""
    by_words = defaultdict(list)
    for d, t in corpus:
        by_words[tuple(words_of(t))].append(d)
    by_words.pop((), None)
    text_id = {w: min((d for d in ds if d is not None), default=None) for w, ds in by_words.items()}
    sets = {w: {w[i:i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} for w in by_words}
    parent, links = {w: w for w in by_words}, defaultdict(int)

    def find(w):
        while parent[w] != w:
            w = parent[w]
        return w

    for a, b in itertools.combinations(by_words, 2):
        c = len(sets[a] & sets[b])
        if c * 5 >= (len(sets[a]) + len(sets[b]) - c) * 4:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    classes = defaultdict(list)
    for w in by_words:
        classes[find(w)].append(text_id[w])
    return {w: (text_id[w], min((x for x in classes[find(w)] if x is not None), default=None), links[w]) for w in by_words}


def test_join_equals_brute_force(spark, docs, corpus):
    want = brute_join(corpus)
    got = sorted((tuple(r) for r in ngram_join.jaccard_join(docs).collect()), key=str)
    expected = []
    for d, t in corpus:
        w = tuple(words_of(t))
        expected.append((d, *want[w]) if w else (d, d, d, 0))
    assert got == sorted(expected, key=str)
    assert any(r[3] for r in got)


def test_block_pairs_find_the_links_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(30):
        w = list(base)
        w[k] = f"new{k}"
        rows.append((k, " ".join(w)))
    want = brute_join(rows)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert (got[d]["text_id"], got[d]["class_id"], got[d]["n_links"]) == want[tuple(words_of(t))]


def test_empty_blocks_count_no_link_twice(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 30)  # more blocks than texts
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        rows += [(10 * g + k, " ".join([*base[:k], f"new{k}", *base[k + 1:]])) for k in range(6)]
    want = brute_join(rows)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert (got[d]["text_id"], got[d]["class_id"], got[d]["n_links"]) == want[tuple(words_of(t))]


def test_one_document_of_each_class_stays(spark, docs, corpus):
    kept = ngram_join.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    want = brute_join(corpus)
    classes = [want[w][1] if (w := tuple(words_of(t))) else ("none", i) for i, (_, t) in enumerate(corpus)]
    rows = kept.collect()
    assert len(rows) == len(set(classes))
    worded = [r["doc_id"] for r in rows if words_of(r["text"])]
    assert sorted(worded) == sorted({c for c in classes if not isinstance(c, tuple)})


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (3, 2)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def items(corpus):
    text = dict(x for x in corpus if x[0] is not None)
    long = text[500].split()
    part = lambda lo, n: " ".join(long[lo:lo + n])
    return [(1, part(1000, 30)), (2, part(20_000, 12).upper()), (3, part(5, 5)), (4, part(29_990, 10)),
            (5, part(300, 40) + " not in any document at all x y"), (6, part(300, 6) + " entirely other words follow here now"),
            (7, None), (8, ""), (9, "Two words"), (10, part(7000, 200)), (11, text[3]), (11, text[3]), (None, part(12, 20)),
            (12, part(100, 15) + " " + part(9000, 15))]


def test_contained_items_equal_brute_force(spark, docs, corpus, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = []
    for i, t in items:
        s = shingles(t)
        for d, u in corpus:
            share = len(s & shingles(u)) / len(s) if s else 0
            if s and share >= 0.8:
                want.append((d, i, round(share, 9)))
    for size in (500_000, 60):  # one block of items, and many
        got = [(r[0], r[1], round(r[2], 9)) for r in decontaminate.contained_items(docs, bench, block_shingles=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert (500, 10, 1.0) in want and not any(i == 6 for _, i, _ in want)


def test_no_rows_on_either_side(spark, docs, no_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0
    assert decontaminate.contained_items(no_docs, bench).count() == 0
    assert ngram_join.jaccard_join(no_docs).count() == 0
    assert ngram_join.keep_one_of_each(spark, no_docs, "").count() == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_contaminated_documents_go(spark, docs, items, tmp_path):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = decontaminate.keep_uncontaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 500 not in ids and 3 not in ids and 405 not in ids and {1, 2, 400, 401} <= ids


SPACES = re.compile("[\t\x0b-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def brute_lines(rows):
    """doc -> (text left, lines, removed) in the order of (doc_id, place)."""
    seen, out = [], {}
    known = set()
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[(d, t)] = (None, 0, 0)
            continue
        kept = []
        for line in t.split("\n"):
            s = frozenset(w for w in SPACES.split(line.lower()) if w)
            if s:
                hit = s in known or any(len(s & x) * 5 >= len(s | x) * 4 for x in seen)
                if s not in known:
                    known.add(s)
                    seen.append(s)
                if hit:
                    continue
            kept.append(line)
        n = len(t.split("\n"))
        out[(d, t)] = (t if len(kept) == n else "\n".join(kept), n, n - len(kept))
    return out


def test_line_dedup_equals_brute_force(spark, docs, corpus):
    out = line_dedup.dedup_lines(docs).select("doc.doc_id", "doc.node", "text", "n_lines", "n_removed").collect()
    want = brute_lines(corpus)
    expected = [(d, *want[(d, t)]) for d, t in corpus]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out), key=str) == sorted(expected, key=str)
    assert sum(r["n_removed"] for r in out) > 10


def test_line_dedup_without_first_line_pass(spark):
    """Chains of near copies: each is similar to its neighbours only."""
    rows, base = [], [f"w{i}" for i in range(30)]
    for k in range(25):
        rows.append((k, " ".join(base[k:] + [f"n{i}" for i in range(k)])))
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "text", "n_removed").collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == {d: (want[(d, t)][0], want[(d, t)][2]) for d, t in rows}


def test_short_lines_and_every_white_space(spark):
    rows = [(1, "x y z\n\nYes.\n \t\n"), (2, "Yes.\nz\u00a0Y\tx\r\nno"), (3, "a\tb\tc\td\te\tf"), (4, "f e d c\u3000b a\n"), (5, "a b c d\na b c d e"),
            (6, "ΟΔΟΣ é\nΟΔΟΣ é"), (7, "你好 世界\n你好  世界\n你好世界"), (8, "\n\n"), (8, "other"), (None, "no"), (9, "")]
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "text", "n_removed").collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in got) == sorted((str(d), want[(d, t)][0], want[(d, t)][2]) for d, t in rows)
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] not in (8, None)} == {1: 0, 2: 3, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1, 9: 0}


def test_many_similar_lines_in_many_documents(spark):
    """Groups of near copies that don't begin or end alike, over several buckets and documents of many lines."""
    rng = random.Random(9)
    stems = [[f"s{k}w{i}" for i in range(rng.randrange(3, 40))] for k in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 90)):
            w = list(rng.choice(stems))
            for _ in range(rng.randrange(0, 1 + len(w) // 6)):
                w[rng.randrange(len(w))] = f"o{rng.randrange(3000)}"
            rng.shuffle(w)
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).select("doc.doc_id", "text", "n_removed").collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == {d: (want[(d, t)][0], want[(d, t)][2]) for d, t in rows}


def test_a_run_leaves_no_table(spark, docs):
    import os
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    line_dedup.dedup_lines(docs.limit(20))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("texts_", "sets_"))]
    assert not [f for f in os.listdir(root) if f.startswith("line-dedup")]


def test_line_sets_are_computed_once_and_postings_narrow(spark, docs, monkeypatch):
    """The plan lowers a text once, not in the generator, and makes each set once; a posting is a 4-byte key and its
    place one number."""
    plans, fields, bucketed = {}, {}, line_dedup.Workspace.bucketed

    def seen(self, df, name, *more):
        plans[name], fields[name] = df._jdf.queryExecution().optimizedPlan().toString(), dict(df.dtypes)
        return bucketed(self, df, name, *more)

    monkeypatch.setattr(line_dedup.Workspace, "bucketed", seen)
    line_dedup.dedup_lines(docs.limit(20))
    generators = [x for x in plans["sets"].splitlines() if "Generate" in x]
    assert generators and not [x for x in generators if "lower(" in x]
    assert plans["sets"].count("array_distinct(") == 1
    assert fields["posts"] == {"w": "int", "ln": "bigint", "place": "bigint", "s0": "bigint", "s1": "bigint", "s2": "bigint", "s3": "bigint"}


def test_postings_are_sorted_once_and_met(spark, docs, monkeypatch):
    """Buckets of postings are written in the order of word and line and read in it: neither pass over them sorts, nor do
    the joins of texts or sets with the bits of their documents. A word of one prefix alone is not written."""
    plans, alone, staged, bucketed = {}, [], line_dedup.Workspace.staged, line_dedup.Workspace.bucketed

    def step(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(self, df, name)

    def table(self, df, name, *more):
        plans[name], out = df._jdf.queryExecution().executedPlan().toString(), bucketed(self, df, name, *more)
        if name == "posts":
            alone.append((out.count(), out.groupBy("w").count().where("count = 1").count()))
        return out

    monkeypatch.setattr(line_dedup.Workspace, "staged", step)
    monkeypatch.setattr(line_dedup.Workspace, "bucketed", table)
    line_dedup.dedup_lines(docs)
    far = [k for k in plans if k.startswith("far-") and k[4:].isdigit()]
    assert far and not [k for k in ("near", "sets", *far) if "Sort " in plans[k]]
    assert plans["posts"].count("Sort ") == 1
    (posts, single), = alone
    assert posts > 0 and single == 0


def test_spaces_of_every_length_in_bytes(spark):
    rows, spaces = [(0, "a b c d é")], "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    rows += [(k, f"D{c}c b a É") for k, c in enumerate(spaces, 1)] + [(50 + k, f"d{c}c b a é") for k, c in enumerate("\u200b\u2019\u00a1\u1681\u3001")]
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "n_removed").collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {d: want[(d, t)][2] for d, t in rows}
    assert sum(r["n_removed"] for r in got) == len(spaces)


def test_words_that_share_a_posting_key(spark, docs, corpus, monkeypatch):
    """With a key of three bits nearly every word shares it with others, also in one line: no pair more or less."""
    monkeypatch.setattr(line_dedup, "KEY_BITS", 3)
    out = line_dedup.dedup_lines(docs).select("doc.doc_id", "doc.node", "text", "n_lines", "n_removed").collect()
    want = brute_lines(corpus)
    expected = [(d, *want[(d, t)]) for d, t in corpus]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out), key=str) == sorted(expected, key=str)


def test_line_stage_keeps_columns_and_counts(spark, docs):
    kept = line_dedup.without_repeated_lines(spark, docs, "")
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert 100 not in {r["doc_id"] for r in kept.collect()}  # an exact copy: nothing is left of it
