import random
import re

import pytest

from recordloom.llm import decontamination as D

from .corpus import SCHEMA, documents, frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def fixture():
    r = random.Random(9)
    items = [(n, sentence(r, r.randrange(1, 40))) for n in range(25)]
    items += [(100, None), (101, "..."), (102, "one"), (103, "a b c"), (104, items[0][1]), (0, items[3][1]), (None, items[4][1]), (None, sentence(r, 12)), (105, "É t é, x " * 6), (106, "a a a a a a a a a a a")]
    docs = [*documents()]
    for n in range(300, 360):
        item = r.choice(items)[1] or ""
        w = item.split()
        a = r.randrange(len(w) + 1)
        docs.append((n, sentence(r, r.randrange(0, 20)) + " " + " ".join(w[a : a + r.randrange(1, 30)]).upper() + "; " + sentence(r, r.randrange(0, 20)), "en", "s", 0))
    return docs, items


def brute(docs, items, window=10):
    out = []
    for d in docs:
        w = words(d[1])
        hit, found = set(), set()
        for item, t in items:
            x = words(t)
            k = min(window, len(x))
            runs = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in runs:
                    hit |= set(range(i, i + k))
                    found.add(item)
        out.append((str(d[0]), len(w), len(hit), len(found), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


@pytest.mark.parametrize("limit", [D.AUTOMATON_WORDS, 60])
def test_against_brute_force(spark, limit):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in D.scan(frame(spark, docs), bench, limit=limit).collect())
    assert got == brute(docs, items)
    assert len(list(D.item_groups(bench, limit=60))) > 3


def test_cleaning(spark):
    r = random.Random(1)
    item, a, b = sentence(r, 15), sentence(r, 30), sentence(r, 30)
    rows = [(1, f"{a}.\n{item.upper()}! {b}", "en", "s", 5), (2, item, "en", "s", 5), (3, a, "en", "s", 5), (4, None, "en", "s", None), (5, "", "en", "s", 0)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in D.clean(frame(spark, rows), bench).collect()}
    assert got == {1: (f"{a}.\n! {b}", len(f"{a}.\n! {b}")), 3: (a, 5), 4: (None, None), 5: ("", 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in D.scan(frame(spark), none).collect()} == {0}
    assert D.scan(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_cleaning_by_several_automata(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, several = (sorted((str(r["doc_id"]), str(r["text"]), str(r["n_chars"])) for r in D.clean(frame(spark, docs), bench, limit=n).collect()) for n in (D.AUTOMATON_WORDS, 60))
    assert one == several and len(one) < len(docs)


def test_an_automaton_is_small():
    """What a worker holds of one: under 260 bytes for each word, even if all are different."""
    import pickle
    import subprocess
    import sys

    r = random.Random(2)
    n = 25_000
    for texts in ([[f"w{r.randrange(10**9)}".encode() for _ in range(100)] for _ in range(n // 100)], [[b"ab%d" % r.randrange(30) for _ in range(100)] for _ in range(n // 100)]):
        m = D.Automaton(list(enumerate(texts)))
        flat = [m.link, m.size, m.root, m.one_word, m.one_next, m.more, m.more_next, m.several, m.states, m.of]
        held = sum(sys.getsizeof(x) for x in flat) + sys.getsizeof(m.vocabulary) + sum(sys.getsizeof(w) + 32 for w in m.vocabulary)
        assert held < 260 * n, held / n
        code = "import sys, pickle, resource; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; import recordloom.llm.decontamination; b = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; m = pickle.load(sys.stdin.buffer); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - b)"
        grown = int(subprocess.run([sys.executable, "-c", code], input=pickle.dumps(m), capture_output=True, check=True).stdout.split()[-1])
        assert grown * 1024 < 800 * n + (8 << 20)  # with the pickle itself and what loading it needs


def test_a_text_of_a_megabyte():
    r = random.Random(3)
    item = [b"i%d" % r.randrange(1000) for _ in range(40)]
    m = D.Automaton([(1, item)])
    hit, found = m.match([b"x%d" % (n % 977) for n in range(150_000)] + item + [b"y"] * 50_000)
    assert found == {1} and hit.sum() == 40
