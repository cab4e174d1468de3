"""HTML extraction, language identification, packing and language-model scores."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from curbside.llm import html_extraction as X
from curbside.llm import language_id as I
from curbside.llm import lm_scoring as S
from curbside.llm import packing as K

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", 0) for i, t, l in rows], DOCS)


# --- pages ------------------------------------------------------------------

def texts(spark, markups, url="http://h.example/a"):
    df = spark.createDataFrame([(i, url, m, "x") for i, m in enumerate(markups)], "page_id long, url string, html string, text string")
    got = sorted(X.extract(df).collect())
    assert all(r.n_chars == len(r.text) for r in got)
    return [r.text for r in got]


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if(a<b)'</p>'</script></head><body><nav><ul><li><a>Home</a></ul></nav>"
    "<!-- x --><div class='ad-slot top'>Buy</div><div id=cookie-notice>We use cookies</div><div class='content'><h1>A &amp; B {n}</h1><p><b>one</b>two<br>three {n}"
    "<p>four &lt; &#233; {n}</p><ul><li>five {n}<li>six</ul><form><input>Mail<button>Go</button></form><div class='sidebar'>side {n}</div>"
    "<section id='comments'><p>bad {n}</p></section></div><footer>f {n}</footer></body></html>"
)


def test_article_without_what_surrounds_it(spark):
    got = texts(spark, [PAGE.replace("{n}", f"n{i}") for i in range(12)])
    assert got == [f"A & B n{i} onetwo three n{i} four < é n{i} five n{i} six" for i in range(12)]


def test_constant_slots_are_template_and_copies_are_not(spark):
    same = "<body><article><h1>H</h1><p>text {n}</p><div class='x1'>Read more of this</div></article></body>"
    got = texts(spark, [same.replace("{n}", f"n{i}") for i in range(20)])
    assert got == [f"H text n{i}" for i in range(20)]
    assert texts(spark, [same] * 20) == ["H text {n} Read more of this"] * 20
    assert texts(spark, [same.replace("{n}", "a"), same.replace("{n}", "b")]) == ["H text a Read more of this", "H text b Read more of this"]


def test_odd_pages(spark):
    pages = [None, "", "plain text", "<p>cut off <b", "a < b", "<article><header><h1>Head</h1></header><p>" + "w " * 50_000, "<main>m<aside>no</aside></main>"]
    for i, m in enumerate(pages):
        assert texts(spark, [m], None if i % 2 else "not a url") == [["", "", "plain text", "cut off", "a < b", " ".join(["Head"] + ["w"] * 50_000), "m"][i]]
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert X.extract(df).count() == 0


def test_simple_tree_matching_keeps_order():
    def node(label, *children):
        return X.Node(label, 1, 1, 0, 0, list(children))

    a = node("r", node("a"), node("b", node("x")), node("c"))
    b = node("r", node("b", node("x"), node("y")), node("a"), node("c"))
    size, pairs = X.match(a, b)
    assert size == 4 and pairs == [(1, 0), (2, 2)]
    X.merge(a, b)
    assert [n.label for n in a.children] == ["a", "b", "a", "c"] and [n.label for n in a.children[1].children] == ["x", "y"]


# --- languages --------------------------------------------------------------

WORDS = {"aa": "kala maja tuuli sinine".split(), "bb": "strong wind blows north".split(), "cc": "être où ça forêt".split()}


def test_language_accuracy_and_edges(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS[l]) for _ in range(30)), l) for i in range(240) for l in (rng.choice(list(WORDS)),)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None), (1003, "strong wind", None), (None, "kala maja", None), (5, "kala", None)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in I.predict(df, I.train(df)).collect()}
    held = [(i, l) for i, _, l in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].lang_pred == l for i, l in held) > 0.95 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = I.train(df.where("lang = 'none'"))
    assert empty.labels == [] and I.predict(df.limit(3), empty).first().lang_pred == "und"


def test_prediction_ignores_everything_but_text(spark):
    rng = random.Random(9)
    df = frame(spark, [(i, " ".join(rng.choice(WORDS[l]) for _ in range(20)), l) for i in range(90) for l in (rng.choice(list(WORDS)),)])
    model = I.train(df)
    other = df.selectExpr("doc_id", "text", "'xx' AS lang", "true AS held_out", "0.5 AS score")
    assert sorted(I.predict(other, model).select("doc_id", "lang_pred").collect()) == sorted(I.predict(df, model).select("doc_id", "lang_pred").collect())


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in I.softmax(logits)])
    assert abs(I.temperature(logits * 5, labels) - 5) < 0.5


# --- packing ----------------------------------------------------------------

def test_pack_counts_round_trip():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 50, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 40)))
        patterns = K.pack_counts(dict(counts), capacity, nodes=300)
        got = Counter()
        for items, n in patterns:
            assert sum(items) <= capacity
            got.update({x: k * n for x, k in Counter(items).items()})
        assert got == counts
        assert K.lower_bound(dict(counts), capacity) <= sum(n for _, n in patterns) <= sum(n for _, n in K.best_fit(dict(counts), capacity))


def test_search_beats_best_fit():
    counts = {6: 1, 4: 2, 3: 2, 2: 0, 5: 1, 1: 0}  # 6+4, 4+3+3, 5: best fit decreasing gives 6+4, 5+4, 3+3
    assert sum(n for _, n in K.pack_counts({44: 2, 24: 1, 22: 2, 21: 2, 17: 1, 8: 2, 6: 2}, 100)) == 3
    assert sum(n for _, n in K.pack_counts(counts, 10)) == 3


def test_packing_of_documents(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "βeta", "ge mma", "1234", "<|endoftext|>", "\n"]) for _ in range(rng.choice([0, 3, 40, 900, 3000])))) for i in range(40)] + [(90, None), (3, "twice")]
    got = K.pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS offset")).collect()
    want = []
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(places) <= K.lower_bound(dict(Counter(r.length for r in got)), 1024) + 1
    assert K.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- language model ---------------------------------------------------------

def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 10), (1, 5), (50, 8), (1000, 63), (5000, 40)):
        values = np.unique(rng.integers(0, 2**bits, n, dtype=np.uint64))
        level = S.EliasFano(*S.EliasFano.encode(values, bits))
        assert (level.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, rng.integers(0, 2**bits, 200, dtype=np.uint64)])
        place = {int(v): i for i, v in enumerate(values)}
        assert level.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


@pytest.mark.parametrize(("batch", "spread"), [(6_000_000, 1_000_000), (2_000, 20)])
def test_scores_equal_brute_force(spark, monkeypatch, batch, spread):
    monkeypatch.setattr(S, "BATCH_BYTES", batch)
    monkeypatch.setattr(S, "SPREAD", spread)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "sat", "on", f"w{rng.randrange(400)}", "é\t"]) for _ in range(rng.randrange(0, 50)))) for i in range(150)] + [(200, None), (201, "x" * 50_000), (7, "again the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS h")
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    c, pairs = Counter(), Counter()
    for t, use in zip(tokens, learn):
        if use:
            c.update(t)
            pairs.update(zip([None, *t[:-1]], t))
    n, v = sum(c.values()), len(c)
    want = []
    for (i, _), t, use in zip(rows, tokens, learn):
        p = [(c[w] + 1) / (n + v + 1) for w in t]
        q = [(pairs[a, w] + S.KAPPA * x) / (c[a] + S.KAPPA) for a, w, x in zip([None, *t[:-1]], t, p)]
        want.append((i, not use, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, p)), sum(map(math.log10, q))))
    got = sorted(S.score(df).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    want.sort(key=lambda r: (r[0], r[2]))
    for r, x in zip(got, want, strict=True):
        assert tuple(r[:5]) == x[:5]
        assert math.isclose(r.base_score, x[5], rel_tol=1e-9) and math.isclose(r.score, x[6], rel_tol=0.02)


def test_scores_of_nothing(spark):
    assert S.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = S.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_search_on_many_sizes_and_multiplicities():
    rng = random.Random(21)
    for trial in range(12):
        capacity = rng.choice([64, 256, 1024])
        counts = Counter(min(capacity, max(1, int(rng.lognormvariate(math.log(capacity / 3), 0.9)))) for _ in range(rng.choice([200, 1500])))
        counts = {n: c * rng.choice([1, 7]) for n, c in counts.items()}
        got = Counter()
        for items, n in K.pack_counts(counts, capacity, nodes=1500):
            assert sum(items) <= capacity and n > 0
            got.update({x: k * n for x, k in Counter(items).items()})
        assert got == counts


def test_deep_pages(spark):
    deep = "<article>" + "<div>" * 5000 + "core {n}" + "</div>" * 5000 + "<p>after {n}</p></article>"
    assert texts(spark, [deep.replace("{n}", f"n{i}") for i in range(3)]) == [f"core n{i} after n{i}" for i in range(3)]
    root = X.tree([("-1\t", 1, 0, 0, 0)] + [(f"{i}\tdiv", 1, 0, 0, 0) for i in range(3000)])[0]
    again = X.load(X.dump(root))
    assert X.dump(again) == X.dump(root) and X.match(root, again)[0] == 3001


def test_quotes_in_tags(spark):
    """Quotes open a value only after an equals sign; names inside other values are not attributes."""
    pages = ["<p><a title=it's>link</a> on", "<p><b x='1' y=2\">bold</b> on", "<p><i a\"b 'c'>it</i> on", "<p><u title=\"a > b\">un</u> on", "<p>x <b y=\"2>never closed</b> on", "<p><s data-x='hidden class=nav'>s</s> on", "<p><b = >eq</b> on"]
    for got, want in zip([texts(spark, [p])[0] for p in pages], ["link on", "bold on", "it on", "un on", "x", "s on", "eq on"]):
        assert got == want
    assert X._label("div", " title='class=ad' CLASS=\"a1\"  hidden") == "div class=a0 hidden="


@pytest.mark.parametrize("n", [2, 3, 5, 20])
def test_menus_of_small_hosts(spark, n):
    """An unmarked constant menu goes from two differing pages on; near copies of one article stay whole."""
    page = "<body><div class='x'><ul><li>Home</li><li>Shop</li></ul></div><div class='y'><p>{n} is a long text of its own about nothing else</p></div></body>"
    assert texts(spark, [page.replace("{n}", f"page{i} " * 9) for i in range(n)]) == [" ".join([f"page{i}"] * 9) + " is a long text of its own about nothing else" for i in range(n)]
    copy = "<article><p>Words of one long article that two pages share.</p><div>edited {n}</div></article>"
    assert texts(spark, [copy.replace("{n}", "a"), copy.replace("{n}", "b")]) == [f"Words of one long article that two pages share. edited {x}" for x in "ab"]
