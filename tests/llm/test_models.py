"""Scores of the trained operators against plain forward passes, a text at a time, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmatch.llm import boosting, htmlmain, quality, toxicity
from shelfmatch.llm.dom import Tree, decode, features
from shelfmatch.llm.hashing import prefix, ranges

M64 = (1 << 64) - 1
TEXTS = ["", "   ", "word", "Hello, WORLD twice twice 42!", "Straße über ALLES  na\nja. " * 40, "x" * 1300, "one two three four five six seven eight nine", "ab " * 700, "#### %% $$\t\t..."]


def word_hash(w: bytes) -> int:
    buf = np.frombuffer(w, np.uint8)
    return int(ranges(prefix(buf), np.array([0]), np.array([len(w)]))[0])


def plain_toxicity(text: str, model: dict) -> float:
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words, best = low.split(), -math.inf
    for a in range(0, max(len(words), 1), toxicity.WORDS):
        z = []
        for w in words[a : a + toxicity.WORDS]:
            z.append(word_hash(w) >> (64 - toxicity.BITS))
            padded = b" " + w + b" "
            for k in toxicity.SIZES:
                for i in range(len(padded) - k + 1):
                    g = int.from_bytes(padded[i : i + k], "little")
                    z.append(((g * 0x9E3779B97F4A7C15 + k * 0xD6E8FEB86659FD93) & M64) * 0xBF58476D1CE4E5B9 % (1 << 64) >> (64 - toxicity.BITS))
        best = max(best, sum(float(model["z"][b]) for b in z) / max(len(z), 1))
    return 1 / (1 + math.exp(-min(30, max(-30, best + model["bias"]))))


def test_toxicity_scores_equal_a_plain_pass(spark):
    model = {"z": np.random.default_rng(2).normal(0, 3, 1 << toxicity.BITS).astype(np.float32), "bias": -0.7}
    table = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    for i, t in [*enumerate(TEXTS), (99, "")]:
        assert got[i] == pytest.approx(plain_toxicity(t, model), abs=1e-5), t[:30]


def plain_features(passage: bytes, start: int, whole: bytes) -> list[float]:
    """Of whole[start : start + len(passage)]; a word belongs to the passage in which it begins."""
    groups = quality._GROUPS
    count = Counter(next((k for k, g in enumerate(groups) if b in g), len(groups)) for b in passage)
    x = [count[k] / max(len(passage), 1) for k in range(len(groups) + 1)]
    words, at = [], 0
    for w in whole.split():
        at = whole.index(w, at)
        if start <= at < start + quality.PASSAGE:
            words.append(w)
        at += len(w)
    n = max(len(words), 1)
    times = Counter(words)
    x += [sum(a == b for a, b in zip(words, words[1:])) / n, len(times) / n, max(times.values(), default=0) / n, sum(map(len, words)) / n / 10, math.log1p(len(passage)) / 6]
    topics = Counter((word_hash(w) >> 40) % quality.TOPICS for w in words)
    return x + [math.sqrt(topics[k] / n) for k in range(quality.TOPICS)]


def plain_quality(text: str, m: dict) -> float:
    b, hs, es = text.encode(), [], []
    for a in range(0, max(len(b), 1), quality.PASSAGE):
        x = (np.array(plain_features(b[a : a + quality.PASSAGE], a, b)) - m["mean"]) / m["std"]
        h = np.tanh(x @ m["w"] + m["b"])
        hs.append(h)
        es.append(float((np.tanh(h @ m["v"]) / (1 + np.exp(-(h @ m["u"])))) @ m["a"]))
    weight = np.exp(np.array(es) - max(es))
    z = (weight / weight.sum()) @ np.array(hs)
    return float(1 / (1 + np.exp(-np.clip(z @ m["o"] + m["c"], -30, 30)))[0])


def test_quality_scores_equal_a_plain_pass(spark):
    rng = np.random.default_rng(3)
    f, n = quality.N_FEATURES, quality.HIDDEN
    model = {"mean": rng.random(f), "std": rng.random(f) + 0.5, "w": rng.normal(0, 0.3, (f, n)), "b": rng.normal(0, 1, n), "v": rng.normal(0, 1, (n, n)), "u": rng.normal(0, 1, (n, n)), "a": rng.normal(0, 1, n), "o": rng.normal(0, 1, n), "c": rng.normal(0, 1, 1)}
    table = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    for i, t in [*enumerate(TEXTS), (99, "")]:
        assert got[i] == pytest.approx(plain_quality(t, model), abs=1e-4), t[:30]


def test_ids_labelled_both_ways_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(i).encode()) % 5 != 0][:40]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids] + [(i, 1, 1 - i % 2) for i in ids[:10]], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity.lessons_of(docs, labels).collect()} == set(ids[10:])


def test_toxicity_threshold_is_calibrated(spark):
    """A rare kind: the threshold of 0.7 still finds held-out texts, unseen misspellings among them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeimnorstu", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(420):
        rude, w = i % 8 == 0, [word() for _ in range(rng.randint(20, 60))]
        if rude:
            w[rng.randrange(len(w))] = "zugg" + rng.choice(["wort", "heit", "ling", "w0rt", "hajt"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(rude)))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    rude = [r.predicted for r in got if r.doc_id % 8 == 0]
    clean = [r.predicted for r in got if r.doc_id % 8]
    assert sum(rude) / len(rude) >= 0.9 and sum(clean) / len(clean) <= 0.05


#: Pages of other makes than the training layouts: what must stay, what must go.
PAGES = [
    ('<body><header><a href="/">Home</a> <a href="/b">Blog</a></header><main><h1>Rivers</h1><p>{0}</p><p>{1}</p></main><footer>All rights reserved</footer></body>', ["Rivers", "{0}", "{1}"]),
    ('<table><tr><td><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></td><td><h1>Rivers</h1><p>{0}<p>{1}</td></tr></table>', ["Rivers", "{0}", "{1}"]),
    ('<div id="wrap"><div class="post-entry"><h2>Rivers</h2><div>{0}</div><blockquote>{1}</blockquote></div><div id="comments"><div class="comment"><p>Nice one!</p></div><div class="comment"><p>I agree, thanks.</p></div></div></div>', ["Rivers", "{0}", "{1}"]),
    ('<nav><a href=a>Start</a><a href=b>News</a><a href=c>Sport</a></nav><div class="story-body"><p>{0}</p><div class="advert">Buy now, half price!</div><p>{1}</p></div>', ["{0}", "{1}"]),
    ('<article><h1>Rivers</h1><p>{0}</p><script>var x = "<p>no</p>";</script><p>{1}</p><style>p {{ color: red }}</style></article><aside class="sidebar"><h3>Popular</h3><ul><li><a href=1>A</a></li><li><a href=2>B</a></li></ul></aside>', ["Rivers", "{0}", "{1}"]),
    ('<div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><section><h1>Rivers</h1><p>{0}</p><ul><li>{1}</li></ul></section><form><label>Mail</label><input name=m><button>Subscribe</button></form>', ["Rivers", "{0}", "{1}"]),
    ('<article><p>{0} &amp; more &#8212; caf&eacute;</p><svg/><p>{1}</p></article>', ["{0} & more — café", "{1}"]),
    ('<article><p>Area <math><mi>r</mi></math> of it. {0}</p><noscript>Turn it on</noscript><p>{1}</article>', ["Area r of it. {0}", "{1}"]),
    ('<main><article><p>{0}</p><p>{1}</p></article><section class="respond"><h3>Leave a reply</h3><form><textarea></textarea><button>Send</button></form></section></main>', ["{0}", "{1}"]),
    ('<body><div><p>{0}</p><p>{1}</p></div><div class="footer-links"><a href=1>About</a> <a href=2>Terms</a> <a href=3>Contact</a></div></body>', ["{0}", "{1}"]),
]


@pytest.fixture(scope="module")
def page_model():
    """Learnt without any page: from layouts of made-up words alone."""
    x, y, w = htmlmain.training([])
    return boosting.fit(x, y, weight=w)


@pytest.mark.parametrize("page, want", PAGES)
def test_pages_of_other_makes(page_model, page, want):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
    text = [say(60), say(45)]
    tree = Tree(page.format(*text))
    kept = decode(tree, boosting.predict(page_model, features(tree)))
    body = [t for t in (w.format(*text) for w in want) if len(t) > 40]
    assert [t for t in kept if len(t) > 40] == body
    assert not {"We use cookies.", "Nice one!", "I agree, thanks.", "Buy now, half price!", "Turn it on"} & set(kept)


def test_long_and_repeated_pages(spark, page_model):
    """A page of 300,000 characters is read whole; equal pages give equal texts; keys are chosen before any html."""
    text = "Some words of a long article that goes on. " * 7000
    rows = [(1, "u", f"<nav><a href=1>x</a></nav><article><p>{text}</p></article>")] * 3 + [(2, "v", None), (3, None, "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = htmlmain.main_text(table, page_model).collect()
    assert [r.n_chars for r in got if r.page_id == 1] == [len(text.strip())] * 3
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id != 1)
    assert htmlmain.main_text(table).count() == 5
