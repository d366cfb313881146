"""Conversation repair, the adaptive prefix join and ranked search against brute force; odd tables don't break any."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmatch.llm import dialogue, ngramjoin, ranked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}
GRAMMAR = re.compile("(s?(ua)+)?")


# conversation repair


def cheapest(rows):
    """(cost, audit, lines) by all edits in the order of (cost, audit); rows: (role, text, must go, cut off)."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, lines
        # what can still follow depends on the end alone
        place = (i, "".join(dict.fromkeys(initials[-1:])), initials == "s", audit)
        if place in seen or len(audit) > 2 * len(rows) + 4:
            continue
        seen.add(place)

        def go(more, letter, at, role, text, cost=cost, audit=audit, initials=initials, lines=lines):
            new = initials + role[:1]
            if any(GRAMMAR.fullmatch(new + rest) for rest in ("", "ua", "a", "uaua")):
                heapq.heappush(heap, (cost + more, audit + letter, at, new, (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(3, "I", i, role, "")
        if i < len(rows):
            role, text, must_go, cut_off = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, initials, lines))
            if not must_go:
                if role[:1] in ("s", "u", "a"):
                    go(3 * cut_off, "K", i + 1, role, text)
                for new in ("user", "assistant"):
                    go(3 + 3 * cut_off, "R", i + 1, new, text)
    raise AssertionError


def plain_repair(table):
    """conv_id to its row by the contract."""
    out, kept = {}, {}
    for conv, turn, role, text in table:
        kept.setdefault(conv, [])
        c, t, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        d = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        kept[conv] += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for conv, rows in kept.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, edits, n = set(), [], Counter()
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            edits.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [r[1][:1] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, lines = cheapest(edits)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(4)
    out = []
    for conv in [*range(60), None]:
        roles = rng.choices(["user", "assistant", "system", "tool", "", None], [8, 8, 3, 1, 1, 1], k=rng.randint(1, 7))
        for turn, role in enumerate(roles):
            text = rng.choice(["Yes.", "Yes.", "no", "So what? ", " \t", "", None, f"Say {turn}!", f"cut {turn}"])
            out.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return out + out[:5]


SCHEMA = "conv_id long, turn long, role string, text string, h string, fault int"


def test_audits_are_the_least():
    rng = random.Random(2)
    every = [(role, "x.", must, cut) for role in ("user", "assistant", "system", "tool") for must, cut in ((False, False), (True, False), (False, True))]
    for n in range(5):
        for _ in range(40 if n else 1):
            rows = rng.choices(every, k=n)
            cost, audit, lines = cheapest(rows)
            assert dialogue.repaired([(r[0][:1], r[2], r[3]) for r in rows]) == (cost, audit)
            speech = dialogue.Speech(audit)
            for r in rows:
                speech.row(r[0], r[1])
            assert speech.digest() == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_pieces_join_to_the_whole():
    rng = random.Random(8)
    m = dialogue.machine()
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(1, 40))]
        cut = sorted(rng.choices(range(len(rows) + 1), k=3))
        frontier, cost, back = ((m.root, 0),), 0, []
        for a, b in zip([0, *cut], [*cut, len(rows)]):
            ways = {}
            for start in m.tops.values():
                end, least, came = dialogue.parsed(rows[a:b], start)
                ways |= {(start[0], s[0]): (least + c, dialogue._audit(came, i)) for i, (s, c) in enumerate(end)}
            frontier, more, came = m.joined(frontier, ways)
            cost += more
            back.append(came)
        more, place, letters = m.finish(frontier)
        assert (cost + more, dialogue._audit(back, place, letters)) == dialogue.repaired(rows)


@pytest.mark.parametrize("most", [20_000, 2])
def test_conversation_repair(spark, most):
    table = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in table], SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in dialogue.repair(df, most).collect()}
    assert got == plain_repair(table)
    assert dialogue.repair(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"row {i}{'.' * (i % 3)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole, cut = (dialogue.repair(df, n).collect() for n in (10_000, 100))
    assert whole == cut and len(whole) == 1 and len(whole[0].audit) > 2500


# n-gram join


def texts():
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("abcdefgéß", k=rng.randint(2, 6))) for _ in range(400)]
    say = lambda n: rng.choices(vocabulary, k=n)
    line = say(12)
    out = [say(rng.randint(1, 60)) + line * rng.randint(0, 2) for _ in range(50)]
    for n in (20, 60, 150, 400):
        base = say(n)
        for edits in (0, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = "other"
            out.append(copy)
        chain = list(base)
        for _ in range(6):
            chain = [*chain, *say(max(1, n // 30))]
            out.append(chain)
    out += [["one"], ["one", "two"], ["ONE", "two"], ["w"] * 50, ["w"] * 51, list("abcdefghijk"), list("abcdefghijkl"), [*"abcdefghijklm", "abc"]]
    rows = [(3 * i, " ".join(t)) for i, t in enumerate(out)]
    return rows + [(9001, ""), (9002, " \n "), (9003, None), (9004, rows[3][1] + " "), (-5, rows[4][1].upper().replace("É", "é"))]


def plain_components(rows, size, similarity):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("similarity", "cost", "stars"), [(90, 64, True), (90, 0, False), (80, 2, True), (100, 64, True)])
def test_ngram_join(spark, similarity, cost, stars):
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, k string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.ngram_components(df, similarity=similarity, cost=cost, stars=stars).collect()}
    assert got == plain_components(rows, 3, similarity)


def test_prefixes_hold_what_levels_ask_for(spark):
    """The guarantee behind the lists, for sets of all sizes near each other."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    pairs = []
    for n in (9, 10, 11, 19, 20, 37, 100, 333):
        for _ in range(20):
            a = rng.sample(range(10**6), n)
            b = set(a) ^ set(rng.sample(a, rng.randint(0, n // 18))) | set(rng.sample(range(10**6), rng.randint(0, n // 18)))
            if 100 * len(set(a) & b) >= 90 * len(set(a) | b):
                pairs.append((sorted(a), sorted(b)))
    sizes = [(len(a), len(b)) for a, b in pairs]
    frame = spark.createDataFrame(sizes, "n long, m long")
    for level in range(len(ngramjoin.LEVELS)):
        cut = lambda s: set(s[: ngramjoin.cut_off(len(s), level, 90)])  # noqa: B023, E731
        rows = frame.select(ngramjoin.common(F.col("n"), F.col("m"), level, 90).alias("c"), ngramjoin.left_out(F.col("n"), level, 90).alias("x")).collect()
        for (a, b), r in zip(pairs, rows):
            assert len(cut(a) & cut(b)) >= r.c and len(cut(a)) == len(a) - r.x
            asked = max(ngramjoin.least_shared(len(s), 90) - (len(s) - len(cut(s))) for s in (a, b))
            assert r.c >= asked  # what the lists of either rely on


def test_ngram_join_odd(spark):
    schema = "doc_id long, text string"
    odd = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "b"), (None, "null id"), (None, None), (2, None), (3, "A b c d e")], schema)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.ngram_components(odd).collect()), key=str)
    assert got == sorted([(1, 3, 1)] * 3 + [(None, 1, None), (None, 0, None), (2, 0, 2), (3, 3, 1)], key=str)
    assert ngramjoin.ngram_components(odd.limit(0)).count() == 0


# ranked search


def plain_search(docs, items, k):
    n, tf = {}, {}
    for at, (_, t) in enumerate(docs):
        w = TERM.findall((t or "").translate(FOLD))
        n[at], tf[at] = len(w), Counter(w)
    total, length = sum(x > 0 for x in n.values()), sum(n.values())
    df = Counter(t for c in tf.values() for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for i, terms in asked.items():
        scores = []
        for at, (doc, _) in enumerate(docs):
            m = 100 - 50 + (50 * n[at] * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[at][t] // (1000 * tf[at][t] + 20 * m)) for t in terms if tf[at][t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(i, rank, None if gone else doc, -s) for rank, (s, gone, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def library():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcé0", k=rng.randint(1, 4))) for _ in range(120)]
    docs = [(rng.randrange(10**6) - 500, " ".join(rng.choices(vocabulary, range(1, 121), k=rng.randint(0, 50))) + rng.choice(["", "!", " A-b", "ß"])) for _ in range(300)]
    docs += [(7, docs[0][1]), (8, docs[0][1]), (9, None), (10, ""), (11, "-- !"), (None, docs[1][1]), (7, docs[2][1]), (12, "abc " * 5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(25)]
    return docs, items + [(25, None), (26, "?!"), (27, "zzzz"), (None, "a b"), (3, "ABC é0"), (4, items[4][1])]


@pytest.mark.parametrize(("k", "terms"), [(50, 400_000), (3, 60)])
def test_ranked_search(spark, k, terms, monkeypatch):
    docs, items = library()
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, item int").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, term int")
    got = [tuple(r) for r in ranked.search(d, q, k, terms).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == plain_search(docs, items, k)
    assert ranked.search(d.limit(0), q).count() == ranked.search(d, q.limit(0)).count() == 0


def test_best_positions_stop_early_and_right():
    rng = np.random.default_rng(3)
    n, terms = 4000, 6
    cut = np.arange(0, n * terms + 1, terms)
    impact = (rng.pareto(1.1, n * terms) * 1000).astype(np.int64)
    lists = ranked.Lists(cut, np.tile(np.arange(terms), n), impact, np.arange(n))
    whole = impact.reshape(n, terms).sum(1)
    first = np.lexsort((np.arange(n), -whole))[:10]
    read = []
    entries = lists.entries
    lists.entries = lambda rows: read.append(len(rows)) or entries(rows)
    score, docs = ranked.best_positions(lists, np.arange(terms), 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert (docs == first).all() and (score == whole[first]).all() and sum(read) < n / 4
    # ties: equal documents of smaller id come first, however late they are read
    flat = ranked.Lists(np.arange(0, 401, 1), np.zeros(400, np.int64), np.full(400, 5), np.arange(400)[::-1])
    score, docs = ranked.best_positions(flat, np.array([0]), 3, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert docs.tolist() == [0, 1, 2]
