import math
from itertools import product

import numpy as np
import pandas as pd
import pytest

from tallyspark.llm import ann, chat, html_text, language, quality


# ---- language

def test_automaton_knows_every_substring():
    text = [0, 1, 0, 2, 0, 1, 1, 2]
    step = language.suffix_automaton(text, 3)
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    for n in range(5):
        for word in product(range(3), repeat=n):
            state = 0
            for c in word:
                state = step[state, c] if state >= 0 else -1
            assert (state >= 0) == (word in subs)


def brute_phrases(text, sample):
    n, i = 0, 0
    for lo in range(0, len(text), language.PIECE):
        piece, i = text[lo:lo + language.PIECE], 0
        while i < len(piece):
            k = 1
            while i + k < len(piece) and piece[i:i + k + 1] in sample:
                k += 1
            i += k
            n += 1
    return n


def test_phrases_are_greedy_longest_matches():
    rng = np.random.default_rng(1)
    make = lambda n: "".join(rng.choice(list("abcde "), n))
    model = language.Parser({"x": make(500), "y": make(400)})
    texts = [make(int(n)) for n in (1, 5, 511, 512, 513, 3000)]
    got, chars = model.phrases(texts)
    assert chars.tolist() == [len(t) for t in texts]
    rng = np.random.default_rng(1)
    samples = [make(500), make(400)]
    for i, t in enumerate(texts):
        assert got[i].tolist() == [brute_phrases(t, s) for s in samples]


def test_every_letter_of_every_script_counts():
    rng = np.random.default_rng(9)
    han, hangul, greek = ([chr(c) for c in range(*r)] for r in ((0x4E00, 0x4F90), (0xAC00, 0xAD2C), (0x3B1, 0x3C2)))
    make = lambda letters, n: "".join(rng.choice(letters, n))
    samples = {"el": make(greek, 1000), "ko": make(hangul, 3000), "xx": make(list("abcde "), 3000), "zh": make(han, 3000)}
    model = language.Parser(samples)
    unseen = "\u0436\u05d0"
    texts = [samples["zh"][100:140], make(han, 700) + unseen, make(hangul, 50) + "ab" + make(greek, 9), unseen + "a" + unseen + "ab", make(list("abcde "), 600)]
    got, chars = model.phrases(texts)
    assert chars.tolist() == [len(t) for t in texts]
    for i, t in enumerate(texts):
        assert got[i].tolist() == [brute_phrases(t, samples[k]) for k in model.names]
    lang, score = model.predict([samples["zh"][5:60], make(hangul, 40), make(greek, 40).upper(), "abc de", unseen, "12"])
    # letters of no sample cost every language the same: the first by name; no letter at all is no language
    assert lang == ["zh", "ko", "el", "xx", "el", "und"] and score[:4].min() > 0.5 and score[4:].tolist() == [0.25, 0]


LANGS = {"en": "the and of with that this from have which would there their ".split(), "xx": "zor kla mek vot ulu zna pri dok".split()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "xx"
        rows.append((i, " ".join(rng.choice(LANGS[lang], 60)), lang, 0.5))
    rows += [(900, None, "en", 0.0), (901, "", "en", 0.0), (902, "12 !? 3", "xx", 0.0), (903, "the and of", None, 0.0), (None, "zor kla mek", None, 0.0),
             (904, " ".join(rng.choice(LANGS["xx"], 30_000)), None, 0.0), (903, "the and of", None, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_languages_are_told_apart(spark, spoken):
    rows = language.identify(spoken, language.train(spoken)).collect()
    assert len(rows) == spoken.count()
    pred = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert all(pred[i] == ("en" if i % 2 else "xx") for i in range(120))
    assert [pred[i] for i in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "en", "xx", "xx"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = language.identify(spoken, language.train(spoken.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.identify(spoken.limit(0), language.train(spoken)).count() == 0


# ---- quality

def test_discriminant_scores_are_density_ratios():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {0: rng.normal(0, 2, (400, d)), 1: rng.normal(1, 1, (600, d))}
    model = quality.Discriminant({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()}, own=0.0, ridge=0.0)
    z = rng.normal(0, 1, (5, d))
    want = []
    for p in z:
        dens = []
        for c in (0, 1):
            m, s = x[c].mean(axis=0), np.cov(x[c].T, bias=True)
            dens.append(math.log(len(x[c]) / 1000) - 0.5 * (np.linalg.slogdet(s)[1] + (p - m) @ np.linalg.solve(s, p - m)))
        want.append(1 / (1 + math.exp(dens[0] - dens[1])))
    assert np.allclose(model.scores(z), want, atol=1e-6)


@pytest.mark.parametrize("moments", [{}, {1: (3.0, np.ones(13), np.eye(13))}])
def test_a_missing_class_gives_the_share(moments):
    assert quality.Discriminant(moments).scores(np.zeros((2, 13))).tolist() == ([0.5, 0.5] if not moments else [1.0, 1.0])


def test_quality_of_plain_and_broken_text(spark):
    rng = np.random.default_rng(5)
    pool = [f"{a}{b}" for a in ("ta", "re", "lo", "mi", "san") for b in ("na", "tor", "li", "ve", "kum")]
    rows, labels = [], []
    for i in range(300):
        w = rng.choice(pool, int(rng.integers(20, 80)))
        bad = i % 3 == 0
        rows.append((i, "### ".join(w) if bad else " ".join(w).capitalize() + ".", 1.0))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (None, "ta na", 1.0), (1, rows[1][1], 1.0)]
    labels += [(5, None, 0), (6, 7, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held)
    assert quality.quality_scores(docs.limit(0), lab).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, lab.limit(0)).collect()} == {0.5}


def test_quality_stage_keeps_whole_rows(spark, tmp_path):
    good = [(i, "A plain line of text with some words in it number %d." % i, "en") for i in range(60)]
    bad = [(100 + i, "A!!! PLAIN!!! LINE!!! OF!!! TEXT!!! %d!!!" % i, "en") for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, stats string")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in good + bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = quality.keep_good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(good)


# ---- nearest vectors

def brute_nearest(ids, v, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-float((v[j] * v[i]).sum()), ids[j]))
        out[q] = [(ids[j], float((v[j] * v[i]).sum())) for j in order[:k]]
    return out


@pytest.mark.parametrize("spread", [False, True])
def test_nearest_vectors_recall(spark, spread):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 16))
    v[:300] = v[0]  # one vector many times: ties by id
    if spread:
        v *= rng.lognormal(0, 1.5, (900, 1))  # inner products, not angles
    ids = [int(x) for x in rng.permutation(900)]
    rows = [(i, [float(a) for a in x], 1) for i, x in zip(ids, v)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] + [1.0] * 15, 1), (2080, [1.0] * 3, 1), (None, [1.0] * 16, 1),
           (2100, [float("inf")] + [1.0] * 15, 1), (2120, [], 1)]
    df = ann.usable(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int"))
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=10, sample=100, block_rows=200, query_rows=20).toPandas()
    want = brute_nearest(ids, v, [i for i in ids if i % 20 == 0], 10)
    assert set(got["query_id"]) == set(want)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11))
        assert list(zip(-g["score"], g["vec_id"])) == sorted(zip(-g["score"], g["vec_id"]))
        hits += len(set(g["vec_id"]) & {i for i, _ in want[q]})
    assert hits >= 0.95 * 10 * len(want)


@pytest.mark.parametrize("sample", [8192, 150])
def test_repeated_ids_take_one_place(spark, sample):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(150, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x) for i, x in enumerate(v)] * 2  # every row twice
    rows += [(7, 3 * v[0] + 0.01 * rng.normal(size=8)) for _ in range(60)]  # one id in many near rows
    df = ann.usable(spark.createDataFrame([(i, [float(a) for a in x]) for i, x in rows], "vec_id long, embedding array<double>"))
    got = ann.nearest(df, df.where("vec_id % 10 = 0"), k=20, sample=sample).toPandas()
    hits = 0
    for q in range(0, 150, 10):
        score = {}
        for i, x in rows:
            if i != q:
                score[i] = max(score.get(i, -np.inf), float((x * v[q]).sum()))
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and g["vec_id"].is_unique
        assert all(abs(s - score[i]) < 1e-9 for i, s in zip(g["vec_id"], g["score"]))
        hits += len(set(want) & set(g["vec_id"]))
    assert hits >= 0.95 * 20 * 15


def test_few_and_no_vectors(spark):
    df = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id = 0")).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert ann.nearest(df.limit(0), df).count() == 0


# ---- pages

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><div>Site name</div><ul><li><a href=x>Home</a></li></ul>
<div class="cookie-notice">We use cookies</div><div>%s</div><script>if (a < b) {}</script><p>%s<br>tail &amp; more<p>Shared words</p><div id="comments"><p>nice</p></div><div>Imprint</div>"""


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain &lt;text&gt;\n here", "plain <text> here"),
    ("<nav>a</nav><article><h1>T</h1><p>One<b>two</b><br>x<p>Three</article><footer>f</footer>", "T Onetwo x Three"),
    ("<main><p>a</p><article class=comment><p>c</p></article><aside>s</aside><form>f</form></main>", "a"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>x</p></article>", "Title x"),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>a</p><div class='ad'>buy<p>now</div><p>b", "a b"),
    ("<div class=sidebar-wrapper><main><p>in</p></main><p>out</p></div>", "in"), ("<article>a<!-- no --> b &copy &#65;</article>", "a b © A"),
])
def test_markup(html, want):
    assert html_text.main_text(html_text.lines_of(html)) == want


@pytest.mark.parametrize("html, want", [
    ("<body><form id=aspnetForm><div>Long body of the page</div><p>and more</p></form></body>", "Long body of the page and more"),
    ("<form><article><p>text of it</p><form class=x>mail</form></article></form>", "text of it"), ("<article><p>text of it</p><form>mail</form></article>", "text of it"),
    ("<article><div class='overflow-hidden'><p>a</p></div><div class='row no-sidebar'>b</div><div class='article-header'><h1>c</h1></div></article>", "a b c"),
    ("<body class='comments-open search'><article class='post comments-open'><p>a</p><div class='cookie-notice'>b</div><div class=site_footer>c</div></article>", "a"),
    ("<body class=comments><p>a</p><div class=comment-list><p>b</p></div></body>", "a"), ("<div id=discussion><main class=comments><p>a</p></main>b</div>", "a"),
    ("<article class=comment><p>a</p></article>", "a"), ("<article><p>a</p></article><article class=comment><p>b</p></article>", "a"),
])
def test_noise_is_no_article(html, want):
    assert html_text.main_text(html_text.lines_of(html)) == want


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_longest():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        got = sorted(html_text.common_lines(a, b))
        assert len(got) == brute_lcs(a, b)
        it = iter(b)
        assert all(any(x == y for y in it) for x in [a[i] for i in got])


def test_template_lines_go_by_the_nearest_page(spark):
    rows = [(i, f"https://h.example/a/{i:03d}.html?q=1", PAGE % (f"Head {i}", f"Body of page {i}"), "k") for i in range(40)]
    rows += [(100, None, "<p>alone</p>", "k"), (101, "https://one.example/x", "<p>single page</p>", "k"), (102, "https://h.example/zz", None, "k"),
             (3, rows[3][1], rows[3][2], "k"), (None, "https://h.example/a/0031.html", PAGE % ("Head n", "Body n"), "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(4)
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(40):
        assert text[i] == f"Head {i} Body of page {i} tail & more"
    assert text[None] == "Head n Body n tail & more"
    assert (text[100], text[101], text[102]) == ("alone", "single page", "")
    assert html_text.extract(df.limit(0)).count() == 0


# ---- chat

def brute_viterbi(model, obs):
    e, n = model.scores(obs), len(model.roles)
    best = max(product(range(n), repeat=len(obs)), key=lambda p: model.step[n, p[0]] + e[0][p[0]] + sum(model.step[a, b] + e[k + 1][b] for k, (a, b) in enumerate(zip(p, p[1:]))))
    return model.step[n, best[0]] + e[0][best[0]] + sum(model.step[a, b] + e[k + 1][b] for k, (a, b) in enumerate(zip(best, best[1:])))


def path_score(model, obs, path):
    e, n = model.scores(obs), len(model.roles)
    return model.step[n, path[0]] + e[0][path[0]] + sum(model.step[a, b] + e[k + 1][b] for k, (a, b) in enumerate(zip(path, path[1:])))


def conversations(marked=True):
    rows = []
    for c in range(30):
        turns = [("system", "System: be brief")] * (c % 3 == 0) + [("user", f"User: what is {c}?"), ("assistant", "It is a number, and a long answer follows. " * 4)] * 3
        rows += [(c, t, r, x if marked else x.split(": ")[-1], "z") for t, (r, x) in enumerate(turns)]
    return rows


def test_roles_come_back(spark):
    rows = conversations()
    extra = [(50, 0, None, None, "z"), (50, 1, None, "", "z"), (None, 0, None, "User: hi?", "z"), (51, None, None, "User: again?", "z"), (0, 1, "user", rows[1][3], "z")]
    df = spark.createDataFrame(rows + extra, "conv_id long, turn long, role string, text string, obs string")
    got = chat.recover_roles(df).toPandas()
    assert len(got) == len(rows) + len(extra)
    truth = pd.DataFrame([r[:3] for r in rows if r[0] > 0], columns=["conv_id", "turn", "role"])
    m = got.merge(truth, on=["conv_id", "turn"])
    assert (m["role"] == m["role_pred"]).mean() > 0.98
    assert got[got.conv_id.isna()].role_pred.tolist() == ["user"]
    r = got[(got.conv_id == 1) & (got.turn == 0)].rendered.iloc[0]
    assert r == "<|user|>\nwhat is 1?\n<|end|>"
    assert chat.recover_roles(df.limit(0)).count() == 0


def test_segments_give_the_whole_path(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(1, t, None, " ".join(["word"] * int(rng.integers(1, 60))) + rng.choice(["", "?"]), "z") for t in range(300)]
    df = spark.createDataFrame(conversations() + [(c + 100, *r) for c, *r in rows], "conv_id long, turn long, role string, text string, x string").repartition(3)
    model = chat.train(chat.segments(df))
    whole = model.decode([chat.observe(r[3]) for r in rows], len(model.roles), -1)
    monkeypatch.setattr(chat, "SEGMENT", 7)  # several levels of segments
    got = chat.recover_roles(df, model).where("conv_id = 101").orderBy("turn").collect()
    path = [model.roles.index(r["role_pred"]) for r in got]
    obs = [chat.observe(r[3]) for r in rows]
    assert abs(path_score(model, obs, path) - path_score(model, obs, whole)) < 1e-6
    assert abs(path_score(model, obs[:9], model.decode(obs[:9], len(model.roles), -1)) - brute_viterbi(model, obs[:9])) < 1e-9


def test_counts_do_not_depend_on_segments(spark, monkeypatch):
    long = [(7000, t, ["user", "assistant"][t % 2], "User: x?" if t % 2 == 0 else "yes " * (t % 9), "z") for t in range(200)]
    df = spark.createDataFrame(conversations() + long + [(None, t, "user", "User: a", "z") for t in range(30)],
                               "conv_id long, turn long, role string, text string, x string").repartition(3)
    whole = chat.train(chat.segments(df))
    monkeypatch.setattr(chat, "SEGMENT", 3)
    segs = chat.segments(df)
    cut = chat.train(segs)
    obs = [chat.observe(t) for t in ("User: x?", "yes yes", "", "System: be brief")]
    assert whole.roles == cut.roles and np.allclose(whole.step, cut.step) and np.allclose(whole.scores(obs), cut.scores(obs))
    placed = chat._placed(segs).toPandas()
    for _, g in placed.groupby(placed["conv_id"].fillna(-1)):
        assert g.sort_values(["part", "chunk"])["pos"].tolist() == list(range(len(g))) and (g["n"] == len(g)).all()


def test_an_article_that_siblings_show_too_is_template(spark):
    teaser = "<article><h2>Read this too</h2><p>It is on every page</p></article>"
    page = "<body><article><h1>Head %d</h1><p>Body of %d</p><p>A quoted line</p></article>" + teaser + "</body>"
    rows = [(i, f"https://t.example/a/{i:03d}", page % (i, i)) for i in range(12)] + [(50, "https://alone.example/", page % (50, 50))]
    rows += [(60 + i, f"https://c.example/{i}", teaser) for i in range(3)]
    text = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(12):
        assert text[i] == f"Head {i} Body of {i} A quoted line"
    assert text[50] == "Head 50 Body of 50 A quoted line Read this too It is on every page"  # nothing to tell by
    assert text[60] == text[61] == text[62] == "Read this too It is on every page"


@pytest.mark.parametrize("page", ["<div>x" * 10_000, "<div><b>" * 10_000 + "</i>y</p>" * 10_000, "<article>" + "<ul><li>x" * 5_000, "<p>a<span>" * 10_000])
def test_deep_pages_take_time_in_proportion(page):
    import time
    start = time.process_time()
    lines = html_text.lines_of(page)
    assert time.process_time() - start < 1 and lines
