"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import html_text, language_id, licenses, mixing, near_text, near_vectors, packing, toxicity, url_filter, vector_search
from duelframe.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string"


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(k, 300 + (k + 1) % 20) for k in range(300, 320)]
    edges += [(5, 5), (201, 7)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav>"
    "<div class='ad-box ads'>Buy</div><article><h1>Head &amp; tail</h1><p><b>One\n two<br><p>T&eacute;n &lt;b&gt; <i>in</i>side"
    "<!-- no --><script>var x='</p>'</script></p><div class=\"comments\"><p>A reader</p></div></article>"
    "<aside>Side</aside><footer>&copy; foot</footer></body></html>"
)


def test_main_text_cases(spark):
    pages = [
        (1, "http://a.com/1", PAGE), (1, "http://a.com/1", PAGE), (2, "http://a.com/2", None), (3, None, ""), (4, "nonsense", "plain <b>text"),
        (5, "http://a.com/3", "<body><div><p>" + "word " * 300000 + "</div>"), (6, "http://b.com/", "<nav>menu</nav>"),
        (7, "http://a.com/4", "<body><article><p>cut off &am</p"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "paths": F.lit("x"), "text": F.lit(2)})
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()}
    assert got[1][0] == "Head & tail One two Tén <b> inside"
    assert got[2] == got[3] == ("", 0) and got[4][0] == "plain text" and got[6][0] == ""
    assert got[5][1] == 300000 * 5 - 1 and got[7][0] == "cut off &am"
    assert html_text.extract_main_text(df).count() == 8
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_url_cases(spark):
    urls = [
        "http://WWW.Example.COM/en/x?q#f", "https://m.example.com/en/1", "http://a.net/es/", "http://a.net/es", "http://net/fr/9", None, "no scheme",
        "http://com", "http://xnet/fr/1", "a://b.example.com?x=/en/", "http://x.com/de/1", "http://x.com/de/1",
    ]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("example.com/en/", "block") and (got[2].rule, got[2].verdict) == ("net/es/", "block")
    assert got[3].rule is None and got[4].rule == "net/fr/" and got[8].rule is None
    assert (got[5].host, got[5].path, got[6].host) == ("", "", "") and got[5].verdict in ("allow", "block")
    assert (got[7].host, got[7].path, got[7].rule) == ("com", "", None) and (got[9].host, got[9].path) == ("b.example.com", "")
    assert got[10].rule == "com/"
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert url_filter.judge_urls(df.where("page_id = 5")).count() == 1


def test_url_models_tell_hosts_apart(spark):
    urls = [f"http://good{k % 9}.com/a/{k}" for k in range(120)] + [f"http://spam-win{k % 9}.net/es/{k}" for k in range(120)]
    urls += ["http://good3.org/a/7", "http://spam-win2.org/es/5"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df).where("rule IS NULL").collect()}
    assert got == {240: "allow", 241: "block"}


def test_near_text_against_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice((1, 2, 3, 40, 200)))] for _ in range(40)]
    texts = []
    for words in base:
        for _ in range(rng.choice((1, 2, 6))):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 2))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts.append(rng.choice((" ", "\n ", "\t")).join(copy))
    hot = [f"h{k}" for k in range(150)]
    for _ in range(700):  # a group larger than a block
        copy = list(hot)
        copy[rng.randrange(150)] = f"y{rng.randrange(50)}"
        texts.append(" ".join(copy))
    texts += ["", None, " \n", "Same TEXT here", "same text HERE", "É a b", "é a b"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({"n": F.lit(1), "rep": F.lit(2)})

    def shingles(text):
        raw = (text or "").encode().lower().split()
        n = min(3, len(raw))
        return {tuple(raw[k : k + n]) for k in range(len(raw) - n + 1)} if raw else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_text.near_duplicates(docs).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {
        k: (len(sets[k]), find(k), find(k) == k) for k in range(len(sets))
    }
    kept = near_text.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [k for k in range(len(sets)) if find(k) == k]


def test_near_text_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    got = sorted(rows_of(near_text.near_duplicates(docs)), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert sorted((r.doc_id for r in near_text.keep_one(docs, 3, 85).collect()), key=str) == [1, 3, None]
    assert near_text.near_duplicates(docs.limit(0)).count() == 0
    long = "word " * 400_000 + "tail"
    assert near_text.near_duplicates(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().n_shingles == 2


def test_packed_estimate_is_close():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.85, 1.0):
        a = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
        b = np.concatenate([a[: int(2000 * 2 * share / (1 + share))], rng.integers(0, 1 << 62, 2000 - int(2000 * 2 * share / (1 + share)), dtype=np.uint64)])
        sig = [np.frombuffer(near_text.packed(near_text.minima(np.unique(x))), np.uint64)[None] for x in (a, b)]
        assert abs(near_text.estimated(*sig)[0, 0] - share) < 0.13


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, label = [], []
    for k in range(60):
        base = rng.standard_normal(24)
        for _ in range(int(rng.choice([1, 3, 8]))):
            rows.append((base + rng.standard_normal(24) * 0.04).tolist())
            label.append(int(k % 3))
    hot = rng.standard_normal(24)
    for k in range(250):
        rows.append((hot + rng.standard_normal(24) * 0.02).tolist() if k % 2 else hot.tolist())
        label.append(1)
    x = np.array(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in zip(*np.nonzero(link)):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    odd = [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, hot.tolist(), None), (1004, [None] * 24, 1), (1005, [], 1)]
    df = spark.createDataFrame(
        [(k, r, lb) for k, (r, lb) in enumerate(zip(rows, label))] + odd, "vec_id long, embedding array<double>, label int"
    ).withColumns({"v": F.lit(1), "rep": F.lit(2), "s": F.lit(3)})
    want = {k: (int(link[k].sum()), int(find(k)), find(k) == k) for k in range(len(rows))} | {k: (0, k, True) for k in range(1000, 1006)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicate_vectors(df, shard=70).collect()}
    assert got == want
    assert near_vectors.near_duplicate_vectors(df.limit(0)).count() == 0
    twice = df.where("vec_id = 3").union(df.where("vec_id = 3"))
    assert rows_of(near_vectors.near_duplicate_vectors(twice)) == [(3, 0, 3, True)] * 2


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x + rng.standard_normal(x.shape) * 0.01
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    graph = near_vectors.build_graph(x.astype(np.float32))
    ids, _ = near_vectors.beam_search(graph.rows, graph.links[0], near.astype(np.float32), near_vectors._descend(graph, near.astype(np.float32), 0), 48)
    assert np.mean([k in ids[k] for k in range(len(x))]) >= 0.9
    found = near_vectors.find_links(graph, x, near, np.full(len(x), -1), 0.98)
    truth = near @ x.T >= 0.98
    assert sum(len(f) for f in found) >= 0.9 * truth.sum() and all(truth[k, f].all() for k, f in enumerate(found))


def test_search_cases(spark):
    rng = np.random.default_rng(5)
    vectors = [(k, [float(v) for v in rng.choice([-0.5, 0.25, 1.0], 6)]) for k in range(0, 700)]
    vectors += [(900, None), (1000, [float("inf")] * 6), (1100, [None] * 6), (None, [1.0] * 6), (5, vectors[5][1]), (800, [1e3] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"v": F.lit(0), "q": F.lit(1), "g": F.lit(2)})
    got: dict = {}
    for r in vector_search.top_k_search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    real = {k: np.floor(1024 * np.array(v, dtype=np.float32).astype(float)) for k, v in vectors if k is not None and v and None not in v and np.isfinite(v).all()}
    for q in [k for k in real if k % 100 == 0]:
        best = sorted(((-int(real[q] @ x), k) for k, x in real.items() if k != q))[:10]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert set(got) == {k for k in real if k % 100 == 0}
    assert vector_search.top_k_search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert vector_search.top_k_search(few, F.col("vec_id") == 0).count() == 2


def test_packing_cases(spark):
    long = "A sentence here. " * 20_000 + "x" * 30_000
    docs = [(1, None), (2, ""), (3, "a  b\n\n c"), (3, "a  b\n\n c"), (None, "tail"), (4, long)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"start": F.lit(1), "ids": F.lit(2)})
    out = packing.pack_documents(df, *tokenizer())
    rows = out.collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and sum(r.length for r in rows if r.doc_id == 2) == 1
    total = {k: sum(r.length for r in rows if r.doc_id == k) for k in (3, 4)}
    tokens = packing.Tokens(*tokenizer())
    assert total == {3: 2 * (len(tokens.ids("a  b\n\n c")) + 1), 4: len(tokens.ids(long)) + 1}
    assert max(r.offset + r.length for r in rows) <= 2048
    assert packing.pack_documents(df.limit(0), *tokenizer()).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(150):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, rng.integers(1, 30)))])
        cost, size = rng.integers(0, 5, len(at)), 16

        def piece(i, j):
            n = at[j] - at[i]
            return cost[j] + (0 if n & (n - 1) == 0 else size - n)

        best = [0]
        for j in range(1, len(at)):
            best.append(min(best[i] + piece(i, j) for i in range(j) if at[j] - at[i] <= size))
        cuts = [0, *packing.best_cuts(at, cost, size)]
        assert sum(piece(i, j) for i, j in zip(cuts, cuts[1:])) == best[-1]


def test_language_cases(spark):
    rng = random.Random(1)
    words = {"aa": ["kala", "mato", "peku"], "bb": ["straz", "vlok", "drubb"]}
    docs = [(k, " ".join(rng.choices(words[lang], k=30)), lang, "s") for k in range(60) for lang in words]
    docs = [(n, *d[1:]) for n, d in enumerate(docs)]
    docs += [(500, None, "aa", "s"), (501, "", None, "s"), (502, "123 !?", "bb", "s"), (503, "kala " * 300_000, None, "s"), (None, "vlok straz", None, "s")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"share": F.lit(1), "found": F.lit(2)})
    got = {r.doc_id: r for r in language_id.identify_documents(df).collect()}
    assert all(got[n].lang_pred == d[2] for n, d in enumerate(docs[:120]))
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "aa"
    assert got[None].lang_pred == "bb" and got[None].held_out
    assert language_id.identify_documents(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify_documents(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gram_counts_against_brute_force():
    from collections import Counter

    letters = language_id.letter_mask()
    for text in ("", "a", " a b", "abc-dé, é", "ab " * 50, "12"):
        want: Counter = Counter()
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            edged = f" {word} "
            for n in range(1, language_id.MAX_N + 1):
                want.update(g for g in (edged[k : k + n] for k in range(len(edged) - n + 1)) if g != " ")
        keys, counts = language_id.count_grams(language_id.letters_of(text, letters))
        assert sorted(counts) == sorted(want.values())


def test_gradients_of_the_network():
    texts = ["one two bad three", "four five six seven", "bad one four", "two three six"] * 4
    net = toxicity.Network.fresh({"bad": 1, "one": 2})
    words = ["bad", "one", "two", "five"]
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    index = np.full((3, toxicity.WINDOW), 4)
    index[0, :4], index[1, :2], index[2, :3] = [0, 1, 2, 3], [1, 0], [3, 3, 2]

    def loss():
        x = net.inputs(words, np.array([1, 2, 0, 0]))
        p = np.concatenate([np.matmul(x[None], net.weights["wx"]) + net.weights["b"], np.zeros((2, 1, 3 * toxicity.HIDDEN))], axis=1)
        logit, made = net.run(p, index, keep=True)
        return logit, made, x

    logit, made, x = loss()
    g, d_proj = net.gradients(index, made, np.ones(3), 5)
    g["wx"] = np.matmul(x.T[None], d_proj[:, :4])
    for name in ("u", "wa", "va", "wo", "wx"):
        weight = net.weights[name]
        at = tuple(s // 2 for s in weight.shape)
        weight[at] += 1e-3
        up = loss()[0].sum()
        weight[at] -= 2e-3
        down = loss()[0].sum()
        weight[at] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name
    assert len(texts) == 16


def test_toxicity_cases(spark):
    rng = random.Random(2)
    plain = [f"w{k}a" for k in range(300)]
    docs, marks = [], []
    for k in range(240):
        words = rng.choices(plain, k=60)
        toxic = k % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["scum", "idiot", "moron"]))
        docs.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    long = " ".join(rng.choices(plain, k=60_000))
    docs += [(1000, None), (1001, ""), (1002, long), (1003, long + " idiot scum moron"), (None, "w1a w2a"), (1004, "IDIOT, scum! moron."), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"toxic": F.lit(1), "score": F.lit("x")})
    labels = spark.createDataFrame(marks + [(None, 1), (7, None)], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    rows = toxicity.score_documents(df, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    held = [k for k, _ in marks if got[k].held_out]
    assert np.mean([got[k].predicted == marks[k][1] for k in held]) >= 0.95
    assert [got[k].predicted for k in (1000, 1001, None, 1004)] == [0, 0, 0, 1]
    assert got[1003].score > got[1002].score
    assert toxicity.score_documents(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score_documents(df, labels.limit(0)).collect()} == {0.0}


def test_scorer_keeps_values_when_full(monkeypatch):
    net = toxicity.Network.fresh({"bad": 1})
    texts = [" ".join(f"v{k + j}" for j in range(50)) for k in range(40)]
    want = toxicity.Scorer(net).logits(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 30)
    monkeypatch.setattr(toxicity, "SCORE_WORDS", 48)
    assert np.allclose(toxicity.Scorer(net).logits(texts), want, atol=1e-5)


@pytest.mark.parametrize("epochs", [1, 3])
def test_mixture_against_brute_force(spark, epochs):
    rng = random.Random(6)
    docs = [(k, " ".join(["t"] * rng.randrange(1, 30)), rng.choice(["en", "de", None]), rng.choice(["a1", "b2", "c3"])) for k in range(300)]
    docs += [(900, None, "en", "a1"), (901, " \n", "de", "b2"), (3, docs[3][1], docs[3][2], docs[3][3]), (None, "t t", "en", None)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"domain": F.lit(1), "epochs": F.lit(2)})
    weights = {"domain": {"x": 3.0, "y": 1.0}, "language": {"en": 9.0}, "source": {"a1": 2.0}}
    mixture = mixing.mix(df, F.when(F.col("source") == "c3", "y").otherwise("x"), F.col("lang"), F.col("source"), 0.7, epochs, weights)
    names = mixture.names
    assert names["domain"] == "_domain" and names["epochs"] == "_epochs"
    taken: dict = {}
    for r in mixture.rows.collect():
        leaf = (r["_domain"], r["language"], r["leaf_source"])
        taken[leaf] = taken.get(leaf, 0) + r["take_tokens"]
        assert r["_epochs"] == r["take_tokens"] // r["n_tokens"]
    quotas = {(r.domain, r.language, r.source): (r.tokens, r.quota) for r in mixture.quotas.collect()}
    assert {k: q for k, (_, q) in quotas.items() if q} == taken

    def fill(budget, children):
        """Water filling by repeated proportional shares: (weight, supply) by name."""
        out, open_ = dict.fromkeys(children, 0.0), set(children)
        while open_ and budget > 1e-9:
            total = sum(children[c][0] for c in open_)
            full = {c for c in open_ if children[c][1] <= budget * children[c][0] / total + 1e-12}
            if not full:
                for c in open_:
                    out[c] = budget * children[c][0] / total
                break
            for c in full:
                out[c] = children[c][1]
            budget -= sum(out[c] for c in full)
            open_ -= full
        return out

    supply = {k: t * epochs for k, (t, _) in quotas.items()}
    total = sum(t for t, _ in quotas.values())

    def below(prefix):
        return sum(v for k, v in supply.items() if k[: len(prefix)] == prefix)

    domains = {k[0] for k in supply}
    by_domain = fill(int(total * 0.7), {d: (weights["domain"].get(d, 1.0), below((d,))) for d in domains})
    for d in domains:
        langs = {k[1] for k in supply if k[0] == d}
        by_lang = fill(by_domain[d], {lg: (weights["language"].get(lg, 1.0), below((d, lg))) for lg in langs})
        for lg in langs:
            sources = {k[2] for k in supply if k[:2] == (d, lg)}
            shares = fill(by_lang[lg], {s: (weights["source"].get(s, 1.0), supply[d, lg, s]) for s in sources})
            for s in sources:
                assert quotas[d, lg, s][1] == int(shares[s] + 1e-6)
    read = mixture.readings()
    assert read.columns == df.columns
    assert read.select(F.sum(mixing.word_tokens(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(df.limit(0), F.lit("x"), F.col("lang"), F.col("source"), 0.7).rows.count() == 0


def test_license_cases(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    docs = [
        (1, None), (2, ""), (3, apache), (3, apache), (4, "Licensed under the Apache License, Version 1.1."), (5, "my driver license expired"),
        (6, "word " * 200_000 + "\n" + apache + "\n" + "word " * 10), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (8, licenses.WORDINGS[4][2].upper()), (None, "Licensed under CC BY 4.0"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit(1), "start": F.lit(2)})
    found = [(r.doc_id, r.license) for r in licenses.scan_licenses(df).collect()]
    assert sorted(found, key=str) == sorted(
        [(3, "Apache-2.0"), (3, "Apache-2.0"), (6, "Apache-2.0"), (7, "CC-BY-NC-4.0"), (7, "MIT"), (8, "MIT"), (None, "CC-BY-4.0")], key=str
    )
    assert licenses.scan_licenses(df.limit(0)).count() == 0
