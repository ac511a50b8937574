import time
import zlib

import numpy as np
import pytest

from cardloom.llm import extract, toxicity

LONG = "a listing of cards that goes on for quite a while and says more than a menu does " * 2


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text", "just text"),
    ("<article><h1>T &amp; t</h1><p>A<b> b</b>\n c<br>d</p><p>x</article><footer>no</footer>", "T & t\nA b c d\nx"),
    ("<nav><ul><li><a href=x>x</a></ul></nav><article><p>in<div class='ad'>buy</div><p>two<form>f</form></article>", "in\ntwo"),
    ("<article><p>main</p><section class='comments'><p>reader</p></section><p>after</p></article>", "main\nafter"),
    ("<header><h1>Site</h1></header><main><header><h1>Own</h1></header><p>t</p></main><aside>s</aside>", "Own\nt"),
    (f"<div class=menu><a>a</a></div><div><a href=x>Home</a></div><div><p>{LONG}</p><p>Be.</p></div><div id='cookie-notice'>{LONG}</div>",
     "Home\n" + LONG.strip() + "\nBe."),
    (f"<p>{LONG}</p><div class='sidebar'>{LONG}</div><p>{LONG}</p>", LONG.strip() + "\n" + LONG.strip()),
    ("<article><p>a<script>var x='</p>';</script> b<style>p{}</style></p><!-- c --><p>&lt;p&gt; &#233;&nbsp;z</p>", "a b\n<p> é z"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"),
    ("<article><p>open <b>bold<br><p>next <i>x</article>tail", "open bold\nnext x"),
])
def test_main_text(html, want):
    assert extract.main_text(html) == want


def test_windows_find_surge_and_dive():
    menu = "<div><a href=x>one</a></div>" * 8
    page = f"<body>{menu}<div class=banner>x</div><div><p>{LONG}</p><p>short</p><p>{LONG}</p></div><div class=related>{LONG}</div>{menu}</body>"
    assert extract.main_text(page) == "\n".join([LONG.strip(), "short", LONG.strip()])


def test_body_outside_the_marks_of_teasers_stays():
    teasers = "".join(f"<article class=card><h3>Teaser {i}</h3><p>few words</p></article>" for i in range(3))
    got = extract.main_text(f"<body><nav><a href=x>one</a></nav><div><h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{teasers}</body>")
    assert got.split("\n")[:4] == ["T", LONG.strip(), "Short.", LONG.strip()]
    # A long article still sets the bounds beside text that is not marked.
    assert extract.main_text(f"<div>{LONG}</div><article><p>{LONG} {LONG}</p><p>x</p></article>") == f"{LONG.strip()} {LONG.strip()}\nx"


def test_closing_tags_of_nothing_are_read_in_one_pass():
    for piece in ("</b>", "</div>", "</x1></p>", "<i></b>"):
        start = time.time()
        extract.main_text("<div>" * 50 + f"<p>{LONG}" + piece * (1_000_000 // len(piece)))
        assert time.time() - start < 6, piece


def test_extract_table(spark):
    rows = [(1, "http://a", "<article><p>x</article>"), (1, "http://a", "<article><p>x</article>"), (2, None, None), (None, "u", "<p>y"),
            (3, "u", "<article><p>" + "w " * 300000 + "</article>")]
    got = extract.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 599999)]
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.fixture(scope="module")
def model():
    n = np.full(27 ** 3, 0.5)
    for w in "the idiot moron worthless clown reads this card with the loser and a pathetic trash deck thats stupid".split() * 5:
        c = np.concatenate(([0, 0], toxicity._codes(w), [0]))
        n += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27 ** 3)
    n = n.reshape(27, 27, 27)
    return np.log(n / n.sum(2, keepdims=True))


@pytest.mark.parametrize("token, word", [
    ("1d1ot", "idiot"), ("id10t", "idiot"), ("m0r0n", "moron"), ("w0rthle$s", "worthless"), ("p4thet1c", "pathetic"), ("clooooown", "clown"),
    ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("s-t-u-p-i-d", "stupid"), ("tr@sh", "trash"), ("this", "this")])
def test_viterbi_restores(model, token, word):
    assert toxicity.restore(token, model) == [word]


def test_viterbi_is_the_best_path_of_all(model):
    """Against every reading of short lattices."""
    import itertools
    for token in ("1d10", "c1o", "l0s"):
        best = None
        options = [[(x, toxicity.READ - np.log(len(toxicity.LEET[c]))) for x in toxicity.LEET[c]] + [("", toxicity.NOISE)]
                   if c in toxicity.LEET else [(c, toxicity.KEPT)] for c in token]
        for way in itertools.product(*options):
            w, p, a, b = "".join(x for x, _ in way), sum(c for _, c in way), 0, 0
            for ch in w:
                p += model[a, b, ord(ch) - 96]
                a, b = b, ord(ch) - 96
            p += model[a, b, 0]
            if best is None or p > best[0]:
                best = (p, w)
        assert toxicity.restore(token, model) == [best[1]]


def test_scores_on_held_out_strips(spark):
    rng, rows, labels = np.random.default_rng(2), [], []
    plain = ["".join(rng.choice(list("aeioubdfgklmnprst"), 6)) for _ in range(300)]
    bad = ["moron", "idiot", "loser"]
    for i in range(600):
        w = list(rng.choice(plain, 40))
        if i % 5 == 0:
            w[3], w[20] = rng.choice(bad, 2)
        if i % 25 == 0:
            w[3], w[20] = "m0r0n", "i d i o t"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(9000, None), (9001, ""), (9002, "moron"), (9002, "moron"), (9003, "x " * 200000), (None, "fine")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "strip_id long, text string, score int")
    lab = spark.createDataFrame(labels + [(0, None), (None, 1)], "strip_id long, toxic int")
    got = [r.asDict() for r in toxicity.score_toxicity(df, lab).collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["strip_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600))
    held = [(by[i]["predicted"], y) for i, y in labels if by[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert by[9000]["score"] == by[9001]["score"] < 0.1 and by[9002]["predicted"] == 1 and by[None]["held_out"] is False


def test_held_out_labels_are_never_read(spark):
    rows = [(i, "some plain words of a strip " + ("scum " if i % 4 == 0 else "") + f"no {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    df = spark.createDataFrame(rows, "strip_id long, text string")
    def scores(flip):
        lab = spark.createDataFrame([(i, int((i % 4 == 0) != (flip and i in out))) for i, _ in rows], "strip_id long, toxic int")
        return sorted((r["strip_id"], r["score"]) for r in toxicity.score_toxicity(df, lab).collect())
    assert scores(False) == scores(True)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "strip_id long, toxic int")
    df = spark.createDataFrame([(1, "a b"), (2, None)], "strip_id long, text string")
    assert [r["predicted"] for r in toxicity.score_toxicity(df, none).collect()] == [0, 0]
    assert toxicity.score_toxicity(spark.createDataFrame([], "strip_id long, text string"), none).collect() == []
