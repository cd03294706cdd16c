"""Each stage of the pipeline, on what its predecessor kept."""

import random

import corpus_pipeline
import numpy as np
import pytest
from recordloom.llm import decontamination, minhash, packing, toxicity
from recordloom.llm.common import cut, table

from .corpus import documents, frame, sentence
from .test_decontamination import words
from .test_lines import brute as lines_left
from .test_minhash import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, kept[-1], SF), name)
        assert out.schema == docs.schema
        kept.append(out)
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    assert ids[1] <= ids[0] and ids[2] == ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3]
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    assert len(ids[0] - ids[1] - toxic) < 0.06 * len(ids[0])

    rows = [tuple(r) for r in kept[2].collect()]
    stays = {int(x[0]) for x in brute(rows, 5) if x[3]}
    assert ids[3] == stays

    found = decontamination.scan(kept[4], table(spark, SF, "benchmark")).collect()
    assert sum(r["n_hit"] for r in found) <= 0.01 * sum(r["n_words"] for r in found)

    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    assert {r["doc_id"] for r in pieces} == ids[4]
    assert sum(r["length"] for r in pieces) == packing.token_pieces(kept[4]).agg({"length": "sum"}).first()[0]
    assert minhash.PERCENT == 80


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100 and len(corpus_pipeline.STAGES) == 5


def test_copies_of_several_lines_do_not_reach_packing(spark):
    docs = table(spark, SF, "documents")
    out = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = cut(stage(spark, out, SF), name)
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all((t or "").strip("\n") or not (given[d] or "").strip("\n") for d, t in left.items())
    first, copies = {}, set()
    for d in sorted(given):
        if given[d] and "\n" in given[d].strip("\n") and first.setdefault(given[d], d) != d:
            copies.add(d)
    assert copies and not copies & left.keys()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, blanks, repeated rows, very long texts and columns named as stages' own are; some toxic, some with test items."""
    r = random.Random(12)
    item = sentence(r, 30)
    rows = [*documents()]
    rows += [(2000 + n, sentence(r, 20) + (" Vile nasty wretched vile." if n % 4 == 0 else "") + f" {sentence(r, 9)}", "en", "s", None) for n in range(240)]
    rows += [(3000, sentence(r, 40) + " " + item + " " + sentence(r, 30), "en", "s", 1), (3001, item, "en", "s", 1), (3002, "one\ntwo\n" + sentence(r, 9), "en", "s", 0), (3003, "one\ntwo", "en", "s", 0)]
    docs = frame(spark, rows)
    for c in ("toxicity", "row", "word", "bits", "__gone", "__loom_row", "__id", "hits", "names", "_a", "_fp", "id"):
        docs = docs.withColumn(c, docs["lang"])
    sf = f"{tmp_path_factory.mktemp('odd')}"
    docs.write.parquet(f"{sf}/documents.parquet")
    labels = [(2000 + n, 1, int(n % 4 == 0)) for n in range(240)] + [(None, 1, 1), (3, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "short item"), (None, sentence(r, 12))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, item


def key(r):
    return str((r["doc_id"], r["text"]))


def cleaned(text, items, window=10, most=0.8):
    """A text without words of items' windows, in plain Python; None if it is mostly such."""
    raw = text.encode()
    own = words(text)
    hit = set()
    for t in items:
        w = words(t)
        k = min(window, len(w))
        runs = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        hit |= {j for i in range(len(own) - k + 1 if k else 0) if tuple(own[i : i + k]) in runs for j in range(i, i + k)}
    if not hit:
        return text
    if len(hit) > most * len(own):
        return None
    mapped = raw.translate(decontamination.WORD_TABLE)
    spans, at = [], 0
    for w in mapped.split():
        at = mapped.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for i, (a, b) in enumerate(spans):
        if i in hit:
            if i - 1 not in hit:
                out.append(raw[at:a])
            at = b
    return b"".join([*out, raw[at:]]).decode()


def test_stages_on_odd_tables(spark, odd):
    sf, item = odd
    steps = [table(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(cut(stage(spark, steps[-1], sf), name))
        assert steps[-1].schema == steps[0].schema
    given, safe, lined, one, clean = (s.collect() for s in steps)

    model = toxicity.learn(steps[0], table(spark, sf, "labels"))
    weights, bias = dict(zip(*(x.tolist() for x in model[:2]), strict=True)), model[2]

    def toxic(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        x, _ = toxicity.features(toxicity.Words(raw, np.array([0, len(raw)]), lower=True, separators=toxicity.SEPARATORS))
        return 1 / (1 + np.exp(-(bias + sum(weights.get(i, 0.0) for i in set(x.tolist()))))) >= toxicity.CUT

    assert sorted(map(key, safe)) == sorted(key(r) for r in given if not toxic(r["text"]))
    bad = {2000 + n for n in range(0, 240, 4)}
    assert len(bad & {r["doc_id"] for r in safe}) <= 5 and len(safe) >= len(given) - len(bad) - 10

    same = sorted(safe, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))  # repeated rows are alike, so their order does not matter
    left = lines_left([(n, r["doc_id"], r["text"]) for n, r in enumerate(same)])
    assert sorted(map(key, lined)) == sorted(str((r["doc_id"], left[n])) for n, r in enumerate(same))

    rows = [(r["doc_id"], r["text"]) for r in lined]
    with_words = [r for r in rows if (r[1] or "").split()]
    stays = {x[0] for x in brute(with_words, 5) if x[3]}
    assert sorted({str(r["doc_id"]) for r in one if (r["text"] or "").split()}) == sorted(stays | ({"None"} if any(r["doc_id"] is None and (r["text"] or "").split() for r in one) else set()))
    assert {str(r) for r in rows if not (r[1] or "").split()} == {key(r) for r in one if not (r["text"] or "").split()}

    items = [x["text"] or "" for x in table(spark, sf, "benchmark").collect()]
    bare = {r["doc_id"] for r in given if r["text"] is not None and not r["text"].strip("\n")}
    want = [(r["doc_id"], r["text"] and cleaned(r["text"], items)) for r in one if r["text"] is None or r["text"].strip("\n") or r["doc_id"] in bare]
    want = [w for w, r in zip(want, [r for r in one if r["text"] is None or r["text"].strip("\n") or r["doc_id"] in bare], strict=True) if r["text"] is None or w[1] is not None]
    assert sorted(map(key, clean)) == sorted(map(str, want))
    assert 3001 not in {r["doc_id"] for r in clean} and item.split()[5] not in next(r["text"] for r in clean if r["doc_id"] == 3000)
    assert all(r["n_chars"] == len(r["text"]) for r in clean if r["doc_id"] == 3000)

    pieces = corpus_pipeline.STAGES[-1][1](spark, steps[-1], sf).collect()
    assert sorted({str(r["doc_id"]) for r in pieces}) == sorted({str(r["doc_id"]) for r in clean}) and sum(r["piece"] == 0 for r in pieces) == len(clean)


def test_empty_documents(spark, odd):
    sf, _ = odd
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        assert docs.collect() == []
