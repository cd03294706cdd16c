"""Small tables with the cases that operators meet: copies, near copies, shared passages, nulls, blanks, long and repeated rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on are with as be this have from by at or an not but what all were when we there can said which do how if will each about many then them these so some her would make like him into time has look two more go see no way could people than first water been call who oil now find long down day did get come made may part".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    passage = sentence(r, 60)
    lines = [sentence(r, 8) for _ in range(8)]
    texts: list[str | None] = [sentence(r, r.randrange(1, 160)) for _ in range(30)]
    for t in texts[:8]:
        words = t.split()
        for k in (1, 2, 5):
            near = list(words)
            for _ in range(k):
                near[r.randrange(len(near))] = "changed" + str(r.randrange(9))
            texts.append(" ".join(near))
    texts += texts[3:6] + texts[3:5]
    texts += [sentence(r, 20) + " " + passage + " " + sentence(r, 30) for _ in range(4)] + [passage]
    texts += ["\n".join(lines[:5] + [sentence(r, 9)]), "\n".join([sentence(r, 9), *lines]), "\n".join(lines[2:]) + "\n\n"]
    texts += [None, None, "", "", "  \n\t ", "one", "ONE", "a b c", "a a " * 60, ("a b c d e " * 30).strip(), "Été\x1cà\x85la\xa0mer, l'eau d'ici… <|endoftext|> 12,5 %%", "日本 語 " * 12, "x" * 20000, sentence(r, 9000)]
    rows = [(n, t, "en", f"s{n % 3}", len(t) if t is not None else None) for n, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], None, None, None), (None, None, None, None, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple] | None = None, clash: bool = True):
    """documents; with clash, also columns named as operators' own are."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if clash:
        for c in ("node", "a", "b", "score", "piece", "component", "size", "key", "shard", "number", "copies", "length", "part"):
            df = df.withColumn(c, F.lit("clash"))
    return df
