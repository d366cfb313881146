"""Every operator on a small corpus with planted cases, against brute force; odd tables don't break any."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmatch.llm import components, decontaminate, htmlmain, media, neardup, packing, phrases, quality, suffixdedup, tokenfiles, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def corpus() -> list[tuple]:
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdeéßo", k=rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    out = [say(rng.randint(1, 120)) for _ in range(40)]
    base, passage = say(90), say(60)
    out += [base, base, base.replace(base.split()[5], "other", 1), base.upper(), base + " tail end", say(30) + " " + passage, say(10) + "\n" + passage + " " + say(20), passage + " " + passage]
    out += ["", "   ", "one", "one two", "ONE two", "word " * 80, "word " * 81, say(3000)]
    return [(i * 3, t) for i, t in enumerate(out)] + [(500, None), (501, "é" * 70), (502, "xé" * 40 + "é" * 50)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), 1, "k") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int, k string").repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "other text here"), (None, "null id"), (None, None), (2, None)], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_media(docs):
    got = by_id(media.text_media(docs))
    for i, t in corpus():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got.values()}) == len({r.payload_sha256 for r in got.values()})
    table = media.packets(media.encode_media(docs, "doc_id", "text"), "doc_id")
    assert table.where("error is not null").count() == 0 and table.count() == sum(r.payload_bytes // 576 for r in got.values())


def test_near_duplicates(docs, odd):
    sets = {}
    for i, t in corpus():
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = by_id(neardup.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == 6 and all(r.kept for r in rows)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    label = list(range(80))
    for _ in range(80):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: label[n] for p in pairs if p[0] != p[1] for n in p}


def removed_bytes() -> dict:
    out, rows = {}, sorted((i, (t or "").encode()) for i, t in corpus())
    first: dict = {}
    for i, b in rows:
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, odd, monkeypatch, hot):
    from shelfmatch.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)  # the way for grams with very many variants gives the same
    got = by_id(suffixdedup.suffix_dedup(docs))
    want = removed_bytes()
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (n, m, s, hashlib.sha256(k).hexdigest()) for i, (n, m, s, k) in want.items()}
    if hot > 1:
        cut = by_id(suffixdedup.cut_repeats(docs))
        assert {i: r.text for i, r in cut.items() if r.text is not None} == {i: k.decode("utf-8", "ignore") for i, (_, _, _, k) in want.items() if i != 500}
        assert set(cut[0].asDict()) == set(docs.columns) and all(r.text is None or r.n_chars == len(r.text) for r in cut.values())
        assert suffixdedup.suffix_dedup(odd).count() == 6


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    """Pieces of a long text, few variants at once and many deals give the same rows."""
    from shelfmatch.llm import repeats

    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(30))
    some = [line() for _ in range(12)]
    texts = [(i, "\n".join(rng.choice(some)[rng.randint(0, 9) :] if rng.random() < 0.4 else line() for _ in range(rng.randint(1, 25)))) for i in range(40)] + [(40, "x" * 3000), (41, "a " * 2000), (42, "x" * 700 + " " + "a " * 30)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(5).persist()
    runs = []
    for name, value in (("HOT", 20_000), ("LONG", 300), ("CHUNK", 150), ("DEAL", 2000), ("BLOCK", 1500), ("ORDERED", 40)):
        if runs:
            monkeypatch.setattr(repeats, name, value)
            monkeypatch.setattr(phrases, name, value, raising=False)
        if not runs or name == "ORDERED":
            runs.append((sorted(map(tuple, suffixdedup.suffix_dedup(table).collect())), sorted(map(tuple, phrases.phrase_dedup(table).collect()))))
    assert runs[0] == runs[1]
    first: dict = {}
    for i, t in texts:
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    for (i, t), row in zip(texts, runs[0][0]):
        gone = [False] * len(t)
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = [True] * 50
        assert row[2] == sum(gone)
    seen = set()
    for (i, t), row in zip(texts, runs[0][1]):
        w = t.split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            x = tuple(w[s : s + 20])
            if x in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(x)
        assert row[2] == sum(gone)


def test_a_missing_shard_loses_repeats(docs, monkeypatch):
    """What is removed comes from the automata: without the phrases of some blocks fewer words go, without any none but whole copies'."""
    from shelfmatch.llm import repeats

    monkeypatch.setattr(repeats, "BLOCK", 2000)
    confirmed, removed = phrases.confirmed, []
    for keep in ("true", "block % 2 = 0", "false"):
        monkeypatch.setattr(phrases, "confirmed", lambda *a, keep=keep: confirmed(*a).where(keep))
        removed.append(phrases.phrase_dedup(docs).agg(F.sum("n_removed")).first()[0])
    assert removed[0] > removed[1] > removed[2] or removed[0] > removed[1] == removed[2]


def test_repeated_ids_in_repeats(spark):
    """Rows with one doc_id: equal texts stay whole, other texts don't count against each other for bytes."""
    t, u = "the same long passage of text, fifty bytes and more of it", "quite another passage that is not like the first one, see"
    table = spark.createDataFrame([(1, t), (1, t), (1, u), (2, t + " and " + u)], "doc_id long, text string")
    rows = suffixdedup.suffix_dedup(table).orderBy("doc_id", "n_bytes").collect()
    assert [(r.doc_id, r.n_removed) for r in rows] == [(1, 0), (1, 0), (1, 0), (2, len(t) + len(u))]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_phrase_dedup(docs, odd, monkeypatch, hot):
    from shelfmatch.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    seen, want = set(), {}
    for i, t in sorted(corpus()):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            x = tuple(w[s : s + 20])
            if x in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(c for c, g in zip(w, gone) if not g).encode()).hexdigest())
    got = by_id(phrases.phrase_dedup(docs))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert phrases.phrase_dedup(odd).count() == 6


def test_decontamination(spark, docs, odd):
    texts = dict(corpus())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    long_ = " ".join((texts[120] or "").split()[10:30])
    items = [(1, long_), (10, "ONE two"), (2, None), (3, "..."), (9, "absent words never seen anywhere in here at all ok"), (4, "word " * 12), (5, long_)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for item, it in items:
            x = words(it)
            n = min(10, len(x))
            every = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            for s in range(len(w) - n + 1):
                if n and tuple(w[s : s + n]) in every:
                    hit |= set(range(s, s + n))
                    found.add(str(item))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = by_id(decontaminate.contamination(docs, bench))
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    assert decontaminate.contamination(odd, bench).count() == 6
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(not w[4] for w in want.values())


def test_packing(docs, odd):
    path = tokens.default_path()
    library = tokens.Encoder(path).tokenizer
    for table, rows in ((docs, corpus()), (odd, [tuple(r) for r in odd.collect()])):
        got = packing.pack_documents(table, path, capacity=256).collect()
        bins: dict = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 256
        want = sorted(((i is None, i or 0), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
        total: dict = {}
        for i, n in want:
            total[i] = total.get(i, 0) + n
        have: dict = {}
        for r in got:
            k = (r.doc_id is None, r.doc_id or 0)
            have[k] = have.get(k, 0) + r.length
        assert have == total and len(bins) <= -(-sum(total.values()) // 256) + 2


def test_token_files(docs, odd):
    path = tokens.default_path()
    library = tokens.Encoder(path).tokenizer
    got, at = by_id(tokenfiles.token_files(docs, path)), 0
    for i, t in sorted(corpus()):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u2").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids) // 2, tokens.crc(ids))
        at += len(ids) // 2
    assert tokenfiles.token_files(odd, path).count() == 6


def test_long_documents_span_blocks_and_files(spark, monkeypatch):
    from shelfmatch.llm import ctxmix

    monkeypatch.setattr(ctxmix, "BLOCK", 1000)
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 3000)
    w_folder = tokenfiles.shared_dir(spark)
    w = tokenfiles._Writer(w_folder, 3)
    import numpy as np

    for d in range(4):
        w.add(d, (np.arange(2500) % 100 + d).astype("<u2"))
    w.close()
    assert sum(x[3] for x in w.done) == 10_000 and len(w.done) == 2


def test_classifiers_hold_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeimnorstu", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        bad, rude = i % 4 == 0, i % 5 == 0
        w = [word() for _ in range(rng.randint(30, 120))]
        if rude:
            for _ in range(4):
                w[rng.randrange(len(w))] = "zugg" + rng.choice(["wort", "heit", "zzz", "ling"]) + rng.choice(["", ".", "s"])
        t = " ".join(f"{x}%%%" if bad else x for x in w)
        rows.append((i, t))
        labels.append((i, int(not bad), int(rude)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, col, mod, at in ((quality.quality, "quality", 5, 0), (toxicity.toxicity, "toxic", 3, 1)):
        got = f(docs, lab).join(lab, "doc_id").collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == at) and 0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out]
        assert sum((r.score >= 0.5) == bool(r[col]) for r in held) / len(held) > 0.9
    assert quality.keep_good(docs, lab).count() < 330


def test_classifiers_on_odd_tables(spark, odd):
    lab = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.quality, toxicity.toxicity):
        assert f(odd, lab).count() == 6 and f(odd, lab.limit(0)).count() == 6 and f(odd.limit(0), lab).count() == 0


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Big &amp; small</h1><p>First  long paragraph, of the article.</p><p>Second one, also\nlong enough.</p></article><footer>&copy; us</footer></body></html>"
    d = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "v", ""), (3, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = htmlmain.main_text(d).orderBy("page_id").collect()
    want = "Big & small\nFirst long paragraph, of the article.\nSecond one, also long enough."
    assert [(r.text, r.n_chars) for r in got] == [(want, len(want))] * 2 + [("", 0)] * 2


@pytest.mark.parametrize("f", [lambda d: neardup.near_duplicates(d), lambda d: suffixdedup.suffix_dedup(d), lambda d: phrases.phrase_dedup(d), lambda d: media.text_media(d), lambda d: packing.pack_documents(d, tokens.default_path()), lambda d: tokenfiles.token_files(d, tokens.default_path())])
def test_empty_tables(docs, f):
    assert f(docs.limit(0)).count() == 0
