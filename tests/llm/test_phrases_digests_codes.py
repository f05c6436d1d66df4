"""Operators 11 to 13 against brute force, on every kind of row."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import corpus, docs, no_docs  # noqa: F401  (fixtures)

from tallyspark.llm import exact_dedup, phrases, vector_codes
from tallyspark.llm.exact_dedup import DigestIndex, digests


# --- phrases ---------------------------------------------------------------

def brute_phrases(rows, longest=3, least=10, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        n, scored = sum(a for p, a in c.items() if len(p) == 1), []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def talk(rng, n):
    pairs = ["New York", "new york city", "à la carte", "of the", "in the end", "x y", "w w w"]
    return "".join(rng.choice([rng.choice(pairs), f"v{rng.randrange(40)}", f"rare{rng.randrange(5000)}"]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ", ", "!?"])
                   for _ in range(n))


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    rows = [(rng.choice(["en", "fr", "en", "en", None, "und"]), talk(rng, rng.randrange(0, 60))) for _ in range(300)]
    rows += [("en", None), (None, None), ("de", ""), ("de", " .,\n\t"), ("en", "one"), ("en", "x y x y x y x y"), ("fr", talk(rng, 30_000))]
    return rows + rows[:40] + [("en", "New York, New York, NEW YORK")] * 9 + [("de", "É É é ÉE ee")] * 12


def columns(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_equal_brute_force(spark, talks):
    df = spark.createDataFrame([(i, la, t, "w", 3, "p") for i, (la, t) in enumerate(talks)], "doc_id int, lang string, text string, w1 string, f int, bucket string").repartition(5)
    want = brute_phrases(talks)
    assert columns(phrases.collocations(df)) == want and len(want) > 40
    assert columns(phrases.collocations(df, top=7)) == [r for r in want if r[1] <= 7]
    for longest, least in ((2, 3), (4, 5)):
        assert columns(phrases.collocations(df, longest=longest, least=least)) == brute_phrases(talks, longest, least)
    counts = {(r["lang"], tuple(r["w"])): r["f"] for r in phrases.phrase_counts(df).collect()}
    assert counts["fr", ()] == next(r[6] for r in want if r[0] == "fr")


@pytest.mark.parametrize("rows", [[], [("en", None)], [("en", "only three words")]])
def test_tables_without_phrases(spark, rows):
    assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


@pytest.mark.parametrize("longest, most", [(2, 300), (3, 300), (3, 40), (4, 1000)])
def test_windows_survive_cuts_anywhere(talks, monkeypatch, longest, most):
    """Slabs, full counters and full word tables in the middle of a text lose no window."""
    monkeypatch.setattr(phrases, "SLAB_BYTES", 97)
    monkeypatch.setattr(phrases, "TASK_WINDOWS", most)
    counter, got = phrases._Counter(longest, 5), Counter()
    frames = [f for la, t in talks[:60] for f in counter.add(la or "und", t or "")] + list(counter.flush())
    for f in frames:
        for r in f.to_pylist():
            words = zip(*[phrases._unpack(w).split(b"\n")[:-1] for w in r["words"]])
            for k, c in zip(words, np.frombuffer(phrases._unpack(r["counts"]), "<i8").tolist()):
                got[r["lang"], b" ".join(k)] += c
    want = Counter()
    for la, t in talks[:60]:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").encode().lower().decode()):
            ws = [w.encode() for w in re.split(r"[\x20\x09]+", piece) if w]
            full = ws + [b"A"] * (longest - 1)
            want.update((la or "und", b" ".join(full[i:i + longest])) for i in range(len(ws)))
    assert got == want and len(frames) > 3


# --- exact dedup -----------------------------------------------------------

def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_dedup_equals_brute_force(spark, docs, corpus):
    rows = corpus + [(700, "a \t b"), (701, "a b"), (702, "a\n\nb "), (703, "a b "), (None, "a b"), (704, "a b")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, row int").repartition(4)
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    order = lambda x: (x is None, x or 0)
    for batches in (1, 2, 5):
        got = exact_dedup.dedup(df, batches).collect()
        assert len(got) == len(rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(
            (d, min(groups[norm(t)], key=order), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)
        kept = [r for r in got if r["kept"]]
        assert all(r["doc_id"] == r["keep_id"] for r in kept) and Counter(r["text_sha256"] for r in kept) == Counter(
            hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert docs.count() == len(corpus)


def test_no_documents_give_no_rows(no_docs):
    assert exact_dedup.dedup(no_docs).collect() == []


def test_index_persists_and_loads_twice(spark, scratch):
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = DigestIndex(spark, scratch + "/index", 4)
    index.load(digests(batch([(5, "a"), (6, "b"), (7, "a")])))
    index.close()
    again = DigestIndex(spark, scratch + "/index", 4)  # as another session does
    new = digests(batch([(1, "a"), (2, "c"), (3, "c")]))
    again.load(new)
    again.load(new)  # comes again: nothing is added
    assert sorted(r["keep_id"] for r in again.rows().collect()) == [2, 5, 6]
    plan = new.groupBy("digest").count().join(again.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    again.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


# --- vector codes ----------------------------------------------------------

def brute_codes(rows, entries=256, rounds=4, parts=4):
    """rows: (vec_id, vector, label) usable, in order of vec_id."""
    x = np.floor(np.asarray([v for _, v, _ in rows], float) * 1024).astype(object)
    w, codes, books, error = x.shape[1] // parts, [], [], np.zeros(len(x), object)
    nearest = lambda y, b: [min((sum((p - q) ** 2 for p, q in zip(v, e)), i) for i, e in enumerate(b)) for v in y.tolist()]
    for p in range(parts):
        y = x[:, p * w:(p + 1) * w]
        book = [list(map(int, v)) for v in y[:entries]]
        for _ in range(rounds):
            got = [i for _, i in nearest(y, book)]
            for i in range(len(book)):
                mine = [v for v, g in zip(y.tolist(), got) if g == i]
                if mine:
                    book[i] = [sum(map(int, c)) // len(mine) for c in zip(*mine)]
        got = nearest(y, book)
        codes.append([f"{i:02x}" for _, i in got])
        error += [d for d, _ in got]
        books += [c for e in book for c in e]
    sums = defaultdict(int)
    for (_, _, la), e in zip(rows, error):
        sums[la] += int(e)
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted((r[0], "".join(c), int(e), sums[r[2]], digest) for r, c, e in zip(rows, zip(*codes), error))


def coded(df, **kw):
    return sorted(tuple(r) for r in vector_codes.encode(df, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.05, size=8)).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(500, 900)]
    rows += [(i, rows[i - 900][1], 7) for i in range(900, 960)] + [(960 + i, [0.0] * 8, None) for i in range(30)]
    rows += [(1000, [-1e-5] * 8, 0), (1001, [0.5, -0.5] * 4, 0), (1002, [300.0] * 8, 2)]
    bad = [(1, None, 0), (2, [], 0), (3, [1.0, None] * 4, 0), (4, [float("nan")] * 8, 0), (5, [float("inf")] + [0.0] * 7, 1), (1100, [1.0] * 7, 0), (1101, [1.0] * 12, 0)]
    df = spark.createDataFrame([(i, v, la, 1, "c") for i, v, la in rows + bad], "vec_id long, embedding array<float>, label int, error int, q string").repartition(3)
    for entries in (256, 16, 1):
        assert coded(df, entries=entries) == brute_codes(rows, entries)
    few = rows[:9] + rows[-3:]
    assert coded(df.where(df.vec_id.isin([r[0] for r in few]))) == brute_codes(few)


@pytest.mark.parametrize("keep", ["vec_id < 0", "vec_id = 1"])
def test_no_usable_vectors_give_no_rows(spark, keep):
    df = spark.createDataFrame([(1, None, 0), (2, [1.0] * 8, 0)], "vec_id long, embedding array<float>, label int").where(keep)
    assert coded(df) == []


def test_repeated_rows_are_coded_each(spark):
    rows = [(3, [0.1] * 4, 1), (3, [0.1] * 4, 1), (None, [0.7] * 4, None), (4, [0.2, 0.1, 0.3, 0.1], None)]
    got = vector_codes.encode(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert Counter(r["vec_id"] for r in got) == {3: 2, None: 1, 4: 1} and all(r["error"] == 0 for r in got)


def test_tree_settles_whole_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (20, 6))
    x = centres[rng.integers(0, 20, 1500)] + rng.integers(-8, 9, (1500, 6))
    tree = vector_codes._Tree.of_bytes(vector_codes._Tree.plant(x).to_bytes())
    label, sums, counts, compared = tree.assign(centres)
    want = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (label[tree.inverse] == want).all() and compared < 200
    assert (sums == np.stack([x[want == i].sum(0) for i in range(20)])).all() and (counts == np.bincount(want, minlength=20)).all()
    for i in range(len(tree.centre)):  # covering, and nested ranges
        mine = tree.points[tree.order[tree.lo[i]:tree.hi[i]]]
        assert np.sqrt(((mine - tree.points[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i]


def test_large_components_are_exact_or_refused():
    x = np.asarray([[1 << 28, 5], [-(1 << 28), 7]], np.int64)
    assert vector_codes._squared(x, x)[0, 1] == (1 << 58) + 4
    with pytest.raises(ValueError):
        vector_codes._squared(x * 64, x)
