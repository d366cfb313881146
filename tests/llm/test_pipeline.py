"""The whole pipeline on a small corpus: each stage against brute force on its own input, and run() against the stages in a row."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from shelfmatch.llm import quality, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(n))
    shared, leak = say(40), say(30)
    rows, labels = [], []
    for i in range(120):
        t = say(rng.randint(30, 120)) if i % 5 else " ".join(rng.choice(["$$$", "###", "%%%"]) for _ in range(60))
        t = t + " " + shared if i % 7 == 1 else t
        t = leak[: len(leak) // 2] + " " + t if i % 11 == 3 else t
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(i % 5 > 0), 0))
    for i in range(120, 140):  # copies and near copies
        t = rows[i - 119][1]
        t = t if i % 2 else t + " more"
        rows.append((i, t, None, None, len(t)))
    rows += [(200, None, "en", "s", None), (201, "", "en", "s", 0)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("b1", leak), ("b2", "short item"), ("b3", None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, leak


def near(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i for i in sets if label[i] == i}


def cut(docs):
    first, out = {}, {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        out[i] = None if t is None else bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def leaked(docs, items):
    windows = set()
    for t in items:
        w = WORD.findall((t or "").translate(FOLD))
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)} or ({tuple(w)} if w else set())
    found = set()
    for i, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        if any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            found.add(i)
    return found


def test_stages_against_brute_force(spark, corpus_dir, tmp_path):
    at, leak = corpus_dir
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, inputs = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([(r.doc_id, r.text) for r in docs.collect()])
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert sorted(docs.columns) == sorted(columns), name
    # 1: what the classifier's score says, and no clean document of the training kind goes
    all_docs = spark.read.parquet(f"{at}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score(all_docs, quality.fit(all_docs, spark.read.parquet(f"{at}/labels.parquet"))).collect()}
    assert {i for i, _ in inputs[1]} == {i for i, s in scores.items() if s >= 0.3}
    assert {i for i, _ in inputs[1] if i < 120} == {i for i in range(120) if i % 5}
    # 2 to 4 on their own inputs
    assert {i for i, _ in inputs[2]} == near(inputs[1])
    assert dict(inputs[3]) == cut(inputs[2])
    assert {i for i, _ in inputs[4]} == {i for i, _ in inputs[3]} - leaked(inputs[3], [leak, "short item"])
    # 5: every document's ids, in sequences without gaps of 2048 at most
    library = tokens.Encoder(tokens.default_path()).tokenizer
    got = docs.collect()
    for i, t in inputs[4]:
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        assert sum(r.length for r in got if r.doc_id == i) == n
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()] and sum(n for _, n in b) <= 2048
    again = corpus_pipeline.run(spark, at).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(again) == key(got)
