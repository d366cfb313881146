"""Cases in which an operator once did less than the whole job."""

import random
import zlib

import corpus_pipeline
from shelfmatch.llm import toxicity


def test_toxicity_learns_from_long_texts(spark):
    """All toxic texts are over 10 kB, so are some clean ones, and labels without a document take no place."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeimnorstu", k=rng.randint(2, 8)))
    rows, labels = [], [(i, 0, 1) for i in range(1000, 1400)]
    for i in range(120):
        rude = i % 3 == 0
        w = [word() for _ in range(2500 if rude or i % 3 == 1 else 40)]
        if rude:
            for at in rng.sample(range(len(w)), 5):
                w[at] = "zugg" + rng.choice(["wort", "heit", "ling"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(rude)))
    assert all(len(t) > 10_000 for i, t in rows if i % 3 < 2)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    teach = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    got = toxicity.lessons_of(docs, lab, sample=20).collect()
    assert {r.text for r in got} <= {t for i, t in rows if i in teach}
    assert [sum(r.y == y for r in got) for y in (0, 1)] == [20, 20]
    held = [r for r in toxicity.toxicity(docs, lab).collect() if r.held_out]
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held) / len(held) > 0.9


def test_near_dedup_stage_takes_five_words(spark):
    """The pipeline's stage against five-word brute force, with pairs that only four words hold to be near copies."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = []
    for changed in [5, 5, 5, 4, 4, 1, 9, 0]:  # scattered words that differ, of 200
        base = rng.choices(vocabulary, k=200)
        other = list(base)
        for k in range(changed):
            other[20 + 20 * k] = f"other{len(texts)}x{k}"
        texts += [" ".join(base), " ".join(other)]
    texts += ["one two", "ONE two", "", "   "]

    def left(size):
        sets = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()) for w in (t.lower().split() for t in texts)]
        label = list(range(len(sets)))
        for _ in sets:
            for a in range(len(sets)):
                for b in range(a):
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
        return {i for i, x in enumerate(label) if i == x}

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert got == left(5) != left(4)
