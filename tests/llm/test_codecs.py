"""Formats and local helpers: exact round trips and brute force."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmatch.llm import boosting, ctxmix, dom, hashing, htmlmain, media, packing, tokenfiles, tokens


@given(st.lists(st.integers(0, 49407), max_size=3000), st.integers(1, 300))
@settings(max_examples=25, deadline=None)
def test_context_mixing_round_trip(ids, repeat):
    x = np.array((ids * repeat)[:6000], np.uint16)
    coded = ctxmix.encode(x, 49408)
    back, end = ctxmix.decode(coded)
    assert end == len(coded) and (back == x).all()


def test_context_mixing_learns_and_checks():
    x = np.tile(np.arange(50, dtype=np.uint16), 4000)
    coded = ctxmix.encode(x, 49408)
    assert len(coded) < len(x) / 4
    bad = bytearray(coded)
    bad[-5] ^= 1
    with pytest.raises(ValueError):
        ctxmix.decode(bytes(bad))


def test_token_blocks_stand_alone():
    ids = np.arange(300, dtype=np.uint16)
    data = tokenfiles.block([(7, 100, 0), (None, 200, 0)], ids) + tokenfiles.block([(8, 300, 1)], ids[::-1].copy())
    (i1, x1), (i2, x2) = tokenfiles.blocks(data)
    assert i1["n"].tolist() == [100, 200] and i1["null"].tolist() == [0, 1] and i2["more"].tolist() == [1]
    assert (x1 == ids).all() and (x2 == ids[::-1]).all()


def test_token_ids_equal_the_library():
    e = tokens.Encoder(tokens.default_path())
    texts = ["", "Hello, WORLD's it'll 42²", "ünïcode ß Straße\xa0x", "İstanbul ΣΑΣ", "a<|endoftext|>b", "tab\x1cfile\x85x", "日本語 text", "don't!'s 'tis _x_ %%%", "é combining", "x" * 500, None]
    for t in texts:
        want = np.array(e.tokenizer.encode(t, add_special_tokens=False).ids if t else [], "<u2").tobytes()
        assert e.ids(t) == want, t


def test_ids_of_all_characters_equal_the_library():
    e = tokens.Encoder(tokens.default_path())
    some = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10400, 0x10450), *range(0x1F600, 0x1F640)]]
    texts = [form.format(c) for c in some for form in ("a{0}b", "Go {0} it's{0}", "{0}{0}1 x")]
    ids, cut = e.encode(texts)
    for i, want in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[cut[i] : cut[i + 1]].tolist() == want.ids, texts[i]


def test_words_are_kept_and_dropped_alike(monkeypatch):
    monkeypatch.setattr(tokens, "MOST", 40)
    e = tokens.Encoder(tokens.default_path())
    e.words.tables = []
    draw = random.Random(3)
    for _ in range(30):
        texts = [" ".join("".join(draw.choices("abcé'1", k=draw.randrange(1, 4))) for _ in range(20)) for _ in range(5)]
        ids, cut = e.encode(texts)
        for i, want in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert ids[cut[i] : cut[i + 1]].tolist() == want.ids


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_lacing(kind):
    frames = [b"a" * 300, b"b" * 300, b"c" * 300] if kind == 2 else [b"a" * 255, b"", b"b" * 600, b"c" * 7]
    flags, body = media.lace(frames, kind)
    block = b"\x81" + (5).to_bytes(2, "big") + bytes([flags]) + body
    track, rel, _, ranges = media.frames_of(block, 0, len(block))
    assert (track, rel) == (1, 5) and [block[a:b] for a, b in ranges] == frames


@pytest.mark.parametrize("data", [b"", b"RIFF1234WAVE", b"<html>", media.element(media.EBML, b"") + media._id(media.SEGMENT) + b"\x84\xa3\x82\x81\x00"])
def test_foreign_and_cut_files_are_errors(data):
    if data.startswith(media._id(media.EBML)):
        data = media.element(media.EBML, b"") + media.element(media.SEGMENT, media.element(media.CLUSTER, media.element(media.SIMPLE_BLOCK, b"\x81\x00")))
    with pytest.raises(ValueError):
        media.parse(data)


def test_cues_must_lead_to_their_packets():
    b = media.write(random.Random(1).randbytes(576 * 600))
    good = media.parse(b)
    assert len(good["cues"]) == good["clusters"] == 3 and all(b[at : at + 4] == media._id(media.CLUSTER) for _, _, at in good["cues"])
    at = b.rindex(media._id(media.CUE_CLUSTER_POSITION))
    with pytest.raises(ValueError, match="cue"):
        media.parse(b[: at + 3] + bytes([b[at + 3] ^ 1]) + b[at + 4 :])


@pytest.mark.parametrize("n", [1, 8, 9, 257, 600])
def test_matroska_round_trip(n):
    payload = random.Random(n).randbytes(576 * n)
    b = media.write(payload)
    p = media.parse(b)
    assert b"".join(b[x[2] : x[3]] for x in p["packets"]) == payload
    assert [x[1] for x in p["packets"]] == [k * media.FRAME_NS for k in range(n)]
    assert len(p["cues"]) == p["clusters"] == -(-n // 256)
    for _, _, at in p["cues"]:
        assert b[at : at + 4] == media._id(media.CLUSTER)
    assert p["tracks"][1]["codec"] == "A_PCM/INT/LIT"


def test_matroska_groups_unknown_sizes_and_damage():
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, b"\x81\x00\x03\x00xyz") + media.uint(media.BLOCK_DURATION, 2))
    cluster = media._id(media.CLUSTER) + b"\xff" + media.uint(media.TIMESTAMP, 10) + group
    segment = media._id(media.SEGMENT) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster
    p = media.parse(media.element(media.EBML, b"") + segment)
    assert p["clusters"] == 2 and [x[1] for x in p["packets"]] == [13_000_000] * 2
    with pytest.raises(ValueError):
        media.parse(media.write(b"x" * 576)[:-3])


@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(30, 60))
@settings(max_examples=40, deadline=None)
def test_packing_plan(lengths, capacity):
    histogram = {k: lengths.count(k) for k in set(lengths)}
    bins = packing.plan(histogram, capacity)
    used: dict[int, int] = {}
    for times, chosen in bins:
        assert times > 0 and sum(k * n for k, n in chosen) <= capacity
        for k, n in chosen:
            used[k] = used.get(k, 0) + n * times
    assert used == histogram


@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 3)), max_size=5, unique_by=lambda x: x[0]), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_fullest_combination(left, room):
    left = sorted(left, reverse=True)
    got = packing.fullest(left, room)
    best = max(s for s in (sum(k * c for (k, _), c in zip(left, pick)) for pick in itertools.product(*(range(n + 1) for _, n in left))) if s <= room)
    assert sum(k * n for k, n in got) == best and all(n <= dict(left)[k] for k, n in got)


def test_winnowing_covers_every_window():
    h = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    at = hashing.anchors(hashing.mix(h), 7, np.array([0, 150]), np.array([150, 400]))
    for a, b in ((0, 150), (150, 400)):
        assert all(((at >= s) & (at < s + 7)).any() for s in range(a, b - 6))


def test_hashes_of_ranges_and_windows_agree():
    buf = np.frombuffer(b"the cat sat on the mat; the cat sat", np.uint8)
    c = hashing.prefix(buf)
    w = hashing.windows(c, 7)
    s = np.arange(len(w))
    assert (w == hashing.ranges(c, s, s + 7)).all() and w[0] == w[24] and w[0] != w[1]


def test_boosting_learns():
    x = np.random.default_rng(0).normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((boosting.predict(boosting.fit(x, y), x) > 0.5) == y).mean() > 0.97


def test_dom_blocks():
    t = dom.Tree("<html><body><p>a <b>b</b>&nbsp; c<br>d<p>x<div>y<script>no</script><!-- no --></div>&amp;<ul><li>1<li>2</ul></body>")
    assert [b for _, b, _ in t.blocks] == ["a b c d", "x", "y", "&", "1", "2"]
    assert dom.Tree("").blocks == [] and dom.Tree("<p").blocks == [(0, "<p", 0)]


def test_decoding_is_consistent():
    t = dom.Tree("<body><div><p>one one</p><p>two two</p></div><nav><p>menu</p></nav></body>")
    p = np.array([0.9 if t.tag[i] != "nav" and t.tag[t.parent[i]] != "nav" else 0.05 for i in range(len(t.tag))])
    assert dom.decode(t, p) == ["one one", "two two"]


def test_held_out_layouts():
    rng = random.Random(3)
    pages = [htmlmain.layout(rng, htmlmain._spoken(rng, 5), [htmlmain._spoken(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))], []) for _ in range(60)]
    x, y, w = htmlmain.training([])
    model = boosting.fit(x, y, weight=w)
    hit = n = extra = 0
    for page in pages:
        t = dom.Tree(page)
        mark = htmlmain._inherited(t, t.mark)
        want = {b for k, b, _ in t.blocks if mark[k] == 1}
        got = set(dom.decode(t, boosting.predict(model, dom.features(t))))
        hit, n, extra = hit + len(want & got), n + len(want), extra + len(got - want)
    assert hit / n > 0.95 and extra / n < 0.1


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\"", "<", "<!", "<!--", "<div>", "<p>", "<h1>", "<blockquote>", "<svg>", "<li><td>", "<header><li>", "</p>", "</div>", "<script", "<a href='x'>y</b>"])
def test_damaged_pages_are_read_in_linear_time(piece):
    for page in (piece * (2**20 // len(piece)), "<div>" * 100_000 + piece * (2**19 // len(piece)) + "</p>" * 100_000):
        at = time.process_time()
        dom.Tree(page)
        assert time.process_time() - at < 8


def test_damaged_markup():
    blocks = lambda page: [b for _, b, _ in dom.Tree(page).blocks]
    assert blocks('<p title="a>b</p><p>c</p>') == ["b", "c"]  # the quote never closes
    assert blocks("<p>a</i></div></p>b<p>c") == ["a", "b", "c"]
    assert blocks("<p>a<svg>x<p>b<svg>y</svg>c") == ["ac"]
    assert blocks("a<!-- b") == ["a"] and blocks("a < b <3 <") == ["a < b <3 <"] and blocks("a<script>b") == ["a"]
    t = dom.Tree("<blockquote><p>a<div><p>b<p>c</div><p>d</blockquote>")
    assert [t.tag[k] for k, _, _ in t.blocks] == ["p"] * 4 and t.ends()[1] == len(t.tag)


def test_features_come_in_blocks():
    t = dom.Tree(htmlmain.layout(random.Random(1), "a b", ["c d e"] * 5, []))
    assert (np.concatenate(list(dom.feature_rows(t, 3))) == dom.features(t)).all()


def test_pages_scored_together_or_alone():
    rng = random.Random(2)
    pages = [htmlmain.layout(rng, "a b", [htmlmain._spoken(rng, 20)] * 3, []) for _ in range(7)] + ["", "<p>x"]
    x, y, w = htmlmain.training(pages)
    model = boosting.fit(x, y, trees=5, weight=w)
    assert list(htmlmain._texts(pages, model)) == [next(htmlmain._texts([p], model)) for p in pages]


def test_unmarked_pages_to_the_letter():
    """The whole text of pages without article or main; some of their nameless headings could be of either part."""
    rng = random.Random(31)
    x, y, w = htmlmain.training([])
    model, right, n = boosting.fit(x, y, weight=w), 0, 0
    while n < 60:
        page = htmlmain.layout(rng, htmlmain._spoken(rng, 5), [htmlmain._spoken(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))], [])
        if "<article" in page or "<main" in page:
            continue
        t = dom.Tree(page)
        mark = htmlmain._inherited(t, t.mark)
        n += 1
        right += next(htmlmain._texts([page], model)) == "\n".join(b for k, b, _ in t.blocks if mark[k] == 1)
    assert right / n > 0.6
