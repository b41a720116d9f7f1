import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import bitsliced, html_extract, langid, toxicity
from tests.llm.corpora import clashing, docs


def two_languages(n=400, seed=2):
    rnd = random.Random(seed)
    make = lambda parts: ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    words = {"en": make(["th", "er", "ing", "and", "wh"]), "fr": make(["eau", "ou", "é", "tion", "le"])}
    out = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        own = [rnd.choice(words[lang]) for _ in range(rnd.randint(1, 60))]
        if i % 10 == 0:
            own += [rnd.choice(words["fr" if lang == "en" else "en"]) for _ in range(len(own) // 4)]
        out.append((i, " ".join(own).capitalize() + ".", lang if i % 7 else None, "s", 0))
    return out, {i: "en" if i % 3 else "fr" for i in range(n)}


def test_language_of_held_out_documents(spark):
    own, truth = two_languages()
    own += [(1000, None, "en", None, None), (1001, "", "en", None, 0), (1002, "12 34 !?", "fr", None, 0), (1003, own[1][1] * 200, None, None, 0)]
    got = {r["doc_id"]: r for r in langid.query(spark, docs(spark, own)).collect()}
    assert len(got) == len(own)
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97 and len(held) > 50
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in langid.recognised(docs(spark, own)).collect()}
    assert kept == set(got) - {1000, 1001, 1002}


def test_language_without_labels_or_rows(spark):
    assert langid.query(spark, docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.query(spark, docs(spark, [(1, "some text", None, None, 0)])).collect()} == {"und"}
    own, _ = two_languages(60)
    df = docs(spark, [*own, own[4], (None, "the", None, None, 0)])
    out = langid.query(spark, clashing(df))
    assert out.count() == 62 and out.where("doc_id = 4").count() == 2


def test_symbols_of_other_planes_are_no_letters(spark):
    own, _ = two_languages(60)
    own += [(900, "😀 😀🎉 🚀", None, None, 0), (901, "𝒜 𠀀𠀁", None, None, 0)]
    got = {r["doc_id"]: r for r in langid.query(spark, docs(spark, own)).collect()}
    assert got[900]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[901]["lang_pred"] != "und"


def test_texts_in_no_learned_language_go(spark):
    own, _ = two_languages()
    foreign = ["Москва является столицей России и крупнейшим городом страны", "Warszawa jest stolicą Polski, w którym mieszka ponad milion ludzi", "北京是中华人民共和国的首都 是全国的政治中心", "xkcdq vbnmz qwrtp zxcvb ghjkl", "😀 🎉"]
    half = own[1][1] * 3 + " xkcdq vbnmz qwrtp"
    own += [(900 + k, t, None, None, 0) for k, t in enumerate([*foreign, half])]
    kept = {r["doc_id"] for r in langid.recognised(docs(spark, own)).collect()}
    assert kept == {r[0] for r in own} - {900, 901, 902, 903, 904}


def test_proportions_of_a_mixture():
    lik = np.array([[1.0, 0.01, 0.02]] * 60 + [[0.02, 1.0, 0.01]] * 40 + [[0.1, 0.1, 1.0]])
    pi = langid.mixture(lik, np.array([0, 100, 100, 101]))
    assert pi[0] == pytest.approx([0.6, 0.4, 0], abs=0.03) and (pi[1] == 0).all() and pi[2].argmax() == 2


def toxic_corpus(n=900, seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "er", "in", "ou", "re", "an"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    bad = ["idiot", "scum", "vequ", "trash"]
    docs_, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        own = [rnd.choice(words) for _ in range(rnd.randint(3, 80))]
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                own.insert(rnd.randrange(len(own)), rnd.choice(bad) + rnd.choice(["", "", "aire", "té"]))
        if rnd.random() < (0.7 if toxic else 0.05):  # a group named mostly in toxic texts
            own.insert(0, "muslims")
        docs_.append((i, " ".join(own).capitalize(), None, None, 0))
        labels.append((i, 1, int(toxic)))
    return docs_, labels


LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def test_toxicity_of_held_out_documents(spark):
    own, marks = toxic_corpus()
    truth = {i: t for i, _, t in marks}
    own += [(5000, None, None, None, 0), (5001, "", None, None, 0), (5002, own[0][1] * 300, None, None, 0), (5003, "Muslims live here and there", None, None, 0), (None, "x", None, None, 0)]
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, None), (77777, 1, 1)], LABELS)
    out = toxicity.query(spark, clashing(docs(spark, own)), labels).collect()
    assert len(out) == len(own) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    got = {r["doc_id"]: r for r in out}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 200
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert got[5000]["score"] == got[5001]["score"] < 0.5 and got[5003]["predicted"] == 0


def test_swaps_hold_scores_still():
    assert toxicity.swapped("Women and MEN") == "men and girls" and toxicity.swapped("nobody") is None
    x = [np.array([0, 1])] * 50 + [np.array([1])] * 5 + [np.array([2])] * 200
    y = np.array([1.0] * 55 + [0.0] * 200)
    fair, _ = toxicity.fit(x, y, [(np.array([0, 1]), np.array([3, 1]))] * 50, 4)
    free, _ = toxicity.fit(x, y, [], 4)
    assert abs(fair[0] - fair[3]) < 0.3 * abs(free[0] - free[3])


def test_toxicity_without_labels(spark):
    own, marks = toxic_corpus(40)
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in toxicity.query(spark, docs(spark, own), none).collect()} == {0}
    assert toxicity.query(spark, docs(spark, []), spark.createDataFrame(marks, LABELS)).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- note --><div class="ad">Buy this now, please, it is good.</div>'
    "<article><h1>A  title</h1><p><b>Fish &amp; chips,\n with salt.<br><p>It is <i>good</i>; we like it, all of us.</p><ul><li>One</li><li>Two</li></ul><p>End.</article><section id=comments><p>First! Nice, very nice, and so on.</p></section><footer>&copy; all</footer>"
)


def test_main_text_of_pages(spark):
    pages = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "v", "plain &lt;text&gt;"), (5, "w", "<nav>menu</nav>"), (6, "x", "<p>" + "Word, and word. " * 50_000), (1, "u", PAGE), (None, None, "<p>a<p>b")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = html_extract.query(spark, clashing(df)).collect()
    assert len(out) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[1] == "A title Fish & chips, with salt. It is good; we like it, all of us. One Two End."
    assert got[2] == got[3] == got[5] == "" and got[4] == "plain <text>" and len(got[6]) == 800_000 - 1 and got[None] == "a b"
    assert html_extract.query(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div id="top-nav"><a>Home</a><a>About</a></div><div class="content"><h1>Title</h1><p>A long paragraph, with words. More words, and more.</p><p>Short.</p><div class="comments"><p>I like this, very much. Great stuff.</p></div></div><div class="sidebar"><p>Popular, stuff.</p></div><form><p>Subscribe now, please.</p></form>', "Title A long paragraph, with words. More words, and more. Short."),
        ("<div><a>Home</a> <a>News</a></div><div><div><p>Article text, which is long enough. It goes on, and on.</p><p>Again, some text. It is fine.</p></div></div><div><a>Terms</a> | <a>Privacy</a></div>", "Article text, which is long enough. It goes on, and on. Again, some text. It is fine."),
        ('<main><div role="alert">We use cookies, ok?</div><section><h2>A</h2><p>Some text, here.</p></section><section><p>Other text that is long, and so on.</p></section></main><aside>Zzz, zzz.</aside>', "A Some text, here. Other text that is long, and so on."),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><p>Text, and text.</article>", "a b c Text, and text."),
        ('<article><p>Good text, and more of it.</p><ins class="adsbygoogle">Buy, buy, buy.</ins><div id="userComments"><p>Nice, nice.</p></div><div class="cookieBar">We use, like all, cookies.</div></article>', "Good text, and more of it."),
        ("<p>un<b>brok</b>en &#233;&eacute;&nbsp;x", "unbroken éé x"),
    ],
)
def test_main_text_of_templates(html, text):
    assert html_extract.main_text(html) == text


LONG = "Long text, which goes on, and on; and more of it."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div><section><p>{' '.join([LONG] * 19)}</p></section><section><p>{LONG}</p></section></div></body>", " ".join([LONG] * 20)),
        (f"<div class=post><h1>A title, of words.</h1><div class=entry>{f'<p>{LONG}</p>' * 20}</div></div>", " ".join(["A title, of words.", *[LONG] * 20])),
        (f"<body><article><p>{LONG} {LONG}</p></article><article><p>{LONG}</p></article></body>", " ".join([LONG] * 3)),
        (f"<body><p>{LONG}</p><article><h2>A</h2><p>{LONG}</p></article><div><a>Terms</a></div></body>", f"{LONG} A {LONG}"),
    ],
)
def test_all_selected_text_stays(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    "html",
    [
        f'<body><article class="post hentry category-news tag-economy"><p>{LONG}</p></article></body>',
        f'<body><div class="site no-sidebar"><div class="content has-sidebar"><p>{LONG}</p></div></div></body>',
        f'<body><div class="elementor-widget"><p>{LONG}</p></div><div class="widget"><p>Popular, stuff.</p></div></body>',
        f'<body><div id="page-overlay"><p>{LONG}</p><div class="related-posts"><p>See it, too.</p></div></div></body>',
        f'<body><div class="widget"><p>{LONG} {LONG} {LONG}</p></div><article class="sponsored"><p>{LONG}</p></article></body>',
    ],
)
def test_names_do_not_lose_the_main_text(html):
    assert html_extract.main_text(html) == LONG


def test_headings_of_content_stay():
    html = f'<article><div class="entry-header"><h1>A title, of words.</h1></div><div class="entry"><p>{LONG}</p></div></article>'
    assert html_extract.main_text(html) == f"A title, of words. {LONG}"


def brute_top(own, k=5):
    vecs = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in own if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(vecs):
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for m, (j, w) in enumerate(vecs) if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("rows", [1 << 16, 100])
def test_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(bitsliced, "ROWS", rows)
    rnd = np.random.default_rng(4)
    own = [(i, np.float32(rnd.normal(size=8)).tolist()) for i in range(320)]
    own += [(i, own[7][1]) for i in range(320, 420)]  # many ties
    own += [(500, None), (550, []), (600, [1.0, None] + [0.0] * 6), (650, [float("nan")] * 8), (700, [float("inf")] * 8), (750, [0.5, 0.5]), (751, [0.25, -0.5]), (None, [1.0] * 8), (800, [-1e4] * 8), (850, [0.0] * 8)]
    df = spark.createDataFrame(own, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, bitsliced.query(spark, df).collect()))
    assert got == brute_top(own)
    assert bitsliced.query(spark, df.limit(0)).count() == 0
    twice = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, bitsliced.query(spark, twice).collect())) == [(50, 1, 51, 131072), (50, 1, 51, 131072), (50, 2, 50, 65536), (50, 2, 50, 65536)]


def test_scores_beyond_64_bits(spark):
    own = [(0, [1e10, 2.0, 0.0]), (1, [1e10, 1.0, 3.0]), (2, [-1e10, 0.5, 1.0]), (3, [1e-3, 1e10, 0.0]), (50, [0.5, -2.0, 1.0]), (51, [3.0, 1.0, 0.0]), (52, [1e300, 0.0, 1.0]), (100, [-1e300, 1.0, 1.0]), (150, [2e300, 1e280, 5.0]), (53, [1e308, 0.0, 0.0])]
    df = spark.createDataFrame(own, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, bitsliced.query(spark, df).collect()))
    vecs = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in own if i != 53]  # 256 * 1e308 is no double
    want = []
    for i, v in vecs:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in vecs if j != i)[:5]
            want += [(i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_slices_and_digits():
    for v in (0, 1, -1, 7, -100, 255, 12345):
        assert sum(s << p for p, s in bitsliced.signed_digits(v)) == v
    x = np.array([[3, -5], [0, 2], [7, 9]])
    lows, maps = bitsliced.slices(x)
    q = np.array([-3, 6])
    score, c = bitsliced.score_slices(maps, ~maps, q)
    got = [sum(((int(p[0]) >> r) & 1) << w for w, p in enumerate(score) if p is not None) - c + int(q @ lows) for r in range(3)]
    assert got == (x @ q).tolist()


def brute_ratios(found):
    """The fused ratios by their definition, paths as written-out tag names."""
    path = lambda n: [*path(n.parent), n.tag] if n is not None else []
    paths = [tuple(path(n)) for n, _, _ in found]
    own = []
    for p in paths:
        same = [b for b, q in zip(found, paths, strict=True) if q == p]
        own.append((sum(max(0, len(t) - k) for _, t, k in same) / len(same), 1 + sum(len(html_extract.MARKS.findall(t)) for _, t, _ in same) / len(same)))
    out = []
    for i in range(len(own)):
        w = {j: 0.5 if j == i else 0.25 for j in (i - 1, i, i + 1) if 0 <= j < len(own)}
        out.append(float(np.prod([sum(v * own[j][k] for j, v in w.items()) / sum(w.values()) for k in (0, 1)])))
    return [np.mean([o for o, q in zip(out, paths, strict=True) if q == p]) for p in paths]


def test_ratios_of_tag_paths():
    for html in (PAGE, "<div><p>a, b<p>c</div><div><ul><li><a>x</a><li>y. z</ul><p>d, e, f</div>", "plain"):
        found = html_extract.blocks(html)
        assert html_extract.ratios(found) == pytest.approx(brute_ratios(found))


def test_main_text_is_chosen_by_ratios(monkeypatch):
    html = f"<div><p>Menu of all<p>News of the day<p>More of it</div><div><section>{f'<p>{LONG} {LONG}</p>' * 3}</section></div><div><p>Terms of use<p>Help</div>"
    assert html_extract.main_text(html) == " ".join([LONG] * 6)
    monkeypatch.setattr(html_extract, "ratios", lambda found: [1.0] * len(found))
    assert html_extract.main_text(html) != " ".join([LONG] * 6)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>One, two.</p><button>x<p>Two, and more text here.</p>", "One, two. x Two, and more text here."),
        (f'<article><p>{LONG}</p><p class="related-work">Related work, which is text.</p></article>', f"{LONG} Related work, which is text."),
        ('<p>See <a href="x>this</a> page, and that.</p>', "See this page, and that."),
        ("<p>Open, text.</p><svg><p>More, text here.", "Open, text. More, text here."),
    ],
)
def test_what_is_never_closed_loses_nothing(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("html", ["<a b " * 200_000 + '"', '<a b "x> ' * 100_000, "<button>" * 125_000, "<div>" * 200_000, "<" * 500_000, "<!--" * 250_000, "<button></button" * 60_000])
def test_hostile_pages_take_linear_time(html):
    import time

    began = time.time()
    html_extract.main_text(html)
    assert time.time() - began < 20
