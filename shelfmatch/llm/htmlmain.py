"""Main text of web pages: boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

The trees are trained on at most ``SAMPLE`` pages of the table itself.  Pages that mark their article
(article or main element) teach as they are; their paragraphs are also set into layouts drawn at
random (other containers, menus, side bars, notices, adverts, forms, reader comments), so that the
model doesn't hang on one site's markup.

Defined cases: null and empty html give an empty text; without any page that marks its article the
layouts are filled with made-up words; damaged markup is read as browsers do (open elements end with
their parents, stray end tags are skipped); repeated rows each get a row; extra columns are left out.
"""

from __future__ import annotations

import html as _html
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .dom import N_FEATURES, Tree, decode, feature_rows, features
from .runtime import ship

#: Bound of training: pages, each whole.
SAMPLE = 240
#: Random layouts that are trained on at least.
LAYOUTS = 600
#: Weight of a page in its own layout against a random one.
OWN = 4


def _spoken(rng: random.Random, n: int) -> str:
    sounds = [a + b for a in "bdklmnprst" for b in "aeiou"]
    return " ".join("".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def layout(rng: random.Random, heading: str, paragraphs: list[str], other: list[str]) -> str:
    """A page of random markup; data-keep marks what belongs to the article."""
    e, pick = _html.escape, rng.choice

    def few() -> str:
        return e(pick(other) if other and rng.random() < 0.7 else _spoken(rng, rng.randint(3, 14)))

    def links(n: int, box: str = "ul") -> str:
        return f"<{box}>" + "".join(f'<li><a href="/{k}">{few()[:24]}</a></li>' for k in range(n)) + f"</{box}>"

    def wrap(name: str, tags: str, body: str) -> str:
        tag = pick(tags.split())
        attr = f' {pick(["class", "id", "class"])}="{name}"' if name else ""
        return f'<{tag}{attr} data-keep="0">{body}</{tag}>'

    def comments() -> str:
        each = "".join(f'<div class="{pick(["comment", "comment-body", "reply"])}"><p>{few()}</p></div>' if rng.random() < 0.6 else f"<li><p>{few()} {few()}</p></li>" for _ in range(rng.randint(1, 5)))
        return wrap(pick(["comments", "comment-list", "discussion", "respond", "reader-comments"]), "div section aside", f"<h3>{few()[:20]}</h3>{each}")

    parts = {
        "menu": lambda: wrap(pick(["", "menu", "navbar", "main-nav"]), "nav nav div", links(rng.randint(2, 9))) if rng.random() < 0.8 else wrap("", "nav", links(4)),
        "head": lambda: wrap(pick(["", "header", "masthead", "site-header"]), "header header div", f"<h2>{few()[:20]}</h2><p>{few()[:50]}</p>") if rng.random() < 0.5 else wrap("", "header", few()[:40]),
        "side": lambda: wrap(pick(["sidebar", "side", "widget", "related-posts", "popular"]), "aside div", f"<h3>{few()[:20]}</h3>" + (links(rng.randint(2, 6)) if rng.random() < 0.5 else f"<p>{few()}</p>")),
        "ad": lambda: wrap(pick(["ad", "ads", "advert", "ad-banner", "promo", "sponsored"]), "div div aside", f"<p>{few()}</p>" if rng.random() < 0.5 else few()),
        "notice": lambda: wrap(pick(["cookie-notice", "notice", "consent", "alert", "newsletter", "popup"]), "div section", f"<p>{few()}</p><button>{few()[:8]}</button>" if rng.random() < 0.6 else few()),
        "form": lambda: wrap(pick(["", "login", "search-form", "subscribe"]), "form", f"<label>{few()[:15]}</label><input name=a><button>{few()[:10]}</button>"),
        "share": lambda: wrap(pick(["share", "social", "tags", "breadcrumbs", "pagination"]), "div ul", "".join(f'<a href="#">{few()[:10]}</a> ' for _ in range(rng.randint(2, 6)))),
        "foot": lambda: wrap(pick(["", "footer", "site-footer", "copyright"]), "footer footer div", f"&copy; {few()[:60]}" if rng.random() < 0.5 else f"<p>{few()}</p>" + links(3)),
    }
    body = [f"<{pick(['h1', 'h1', 'h2'])}>{e(heading)}</h1>"] if rng.random() < 0.9 else []
    for t in paragraphs:
        r = rng.random()
        t = e(t)
        body.append(f"<p>{t}</p>" if r < 0.6 else f"<p>{t}" if r < 0.7 else f"<p><b>{t}<br>" if r < 0.78 else f"<h3>{t[:60]}</h3>" if r < 0.83 else f"<blockquote><p>{t}</p></blockquote>" if r < 0.88 else f"<ul><li>{t}</li><li>{t[:80]}</li></ul>" if r < 0.94 else f"<div>{t}</div>")
    for name in ("ad", "share", "side", "form", "notice"):
        if rng.random() < 0.12:
            body.insert(rng.randint(0, len(body)), parts[name]())
    if rng.random() < 0.3:
        body.append(comments())
    box, name = pick([("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "main"), ("section", "story"), ("div", "post"), ("div", "")])
    attr = f' {pick(["class", "id"])}="{name}"' if name else ""
    core = f'<{box}{attr} data-keep="1">{"".join(body)}</{box}>'
    if rng.random() < 0.3:
        core = f'<div class="{pick(["wrapper", "container", "page", "main"])}">{core}{parts["side"]() if rng.random() < 0.4 else ""}</div>'
    before = [parts[k]() for k in ("notice", "head", "menu", "ad", "share", "form", "side") if rng.random() < 0.4]
    after = [parts[k]() for k in ("share", "side", "ad", "notice", "form") if rng.random() < 0.3] + ([comments()] if rng.random() < 0.4 else []) + ([parts["foot"]()] if rng.random() < 0.8 else [])
    rng.shuffle(before)
    return "<html><head><title>x</title></head><body>" + "".join(before) + core + "".join(after) + "</body></html>"


def _inherited(tree: Tree, mark: list[bool | None]) -> np.ndarray:
    """1, 0 or -1 (holds both, or outside any marked part)."""
    y = np.full(len(mark), -1)
    for i, m in enumerate(mark):
        y[i] = int(m) if m is not None else y[tree.parent[i]] if i else -1
    mixed = np.zeros(len(mark), bool)
    for i in range(len(mark) - 1, 0, -1):
        p = tree.parent[i]
        if mixed[i] or y[i] != y[p]:
            mixed[p] = True
    y[mixed] = -1
    return y


def training(pages: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of nodes of the pages themselves and of random layouts, two for each page and LAYOUTS at least."""
    rng = random.Random(seed)
    xs, ys, ws = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0)], [np.zeros(0)]

    def learn(tree: Tree, mark: list[bool | None], times: int = 1) -> None:
        y = _inherited(tree, mark)
        known = y >= 0
        size = np.zeros(len(y))
        for node, text, _ in tree.blocks:
            size[node] += len(text)
        xs.append(features(tree)[known])
        ys.append(y[known])
        ws.append(times * (1 + np.log1p(size[known]) / 4))

    told = []
    for page in pages:
        tree = Tree(page)
        core = [i for i, t in enumerate(tree.tag) if t in ("article", "main")]
        if len(core) == 1:
            mark: list[bool | None] = [None] * len(tree.tag)
            ends = tree.ends()
            holds = lambda a, b: a <= b < ends[a]  # noqa: B023, E731
            for i in range(1, len(mark)):
                mark[i] = True if i == core[0] else None if i < core[0] and holds(i, core[0]) else False if not holds(core[0], i) and tree.tag[i] != "body" else None
            learn(tree, mark, OWN)
            inside = [t for n, t, _ in tree.blocks if holds(core[0], n)]
            told.append((inside[0] if inside else "", inside[1:], [t for n, t, _ in tree.blocks if not holds(core[0], n)]))
    while len(told) < 60:
        told.append((_spoken(rng, 6), [_spoken(rng, rng.randint(5, 120)) for _ in range(rng.randint(1, 9))], []))
    for k in range(max(2 * len(told), LAYOUTS)):
        heading, inside, other = told[k % len(told)]
        # a whole article, or each of its parts in turn, so that all lengths are met
        parts = rng.choice((1, 1, 2, 3))
        for cut in range(parts):
            tree = Tree(layout(rng, heading, inside[cut::parts], other))
            learn(tree, tree.mark)
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict:
    """Trains on at most ``sample`` pages, the first by a hash of their url and id; equal keys give one page."""
    rows = pages.where("html is not null").select(F.xxhash64("url", "page_id").alias("h"), "html")
    keys = rows.select("h").distinct().orderBy("h").limit(sample)  # the keys first, so that no html is sorted
    chosen = rows.join(F.broadcast(keys), "h").groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    x, y, w = training([r.html for r in chosen])
    return boosting.fit(x, y, weight=w)


#: Nodes that are scored at once.
NODES = 20_000


def _texts(pages, model: dict):
    """The main text of each page in turn; small pages are scored together, a large one in blocks."""
    held, n = [], 0
    for page in pages:
        held.append(Tree(page))
        n += len(held[-1].tag)
        if n >= NODES:
            yield from _decoded(held, model)
            held, n = [], 0
    yield from _decoded(held, model)


def _decoded(trees: list[Tree], model: dict):
    if len(trees) > 1:
        last = trees.pop()  # the one that may be large
        p = boosting.predict(model, np.concatenate([features(t) for t in trees]))
        at = 0
        for t in trees:
            yield "\n".join(decode(t, p[at : at + len(t.tag)]))
            at += len(t.tag)
        trees = [last]
    for t in trees:
        yield "\n".join(decode(t, np.concatenate([boosting.predict(model, x) for x in feature_rows(t)])))


def main_text(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = model or fit(pages)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                out = list(_texts((h.as_py() or "" for h in part.column(2)), model))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
