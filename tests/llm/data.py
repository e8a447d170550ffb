"""Small documents with every odd case: nulls, empty and long texts, copies, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, of int, fp string, spans int, times int, kept string, label int, n int, size string"


def documents(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "ré", "mo", "li", "zu") for b in ("n", "sse", "k", "ô", "rin", "7")]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = line(60)
    rows = []
    for i in range(n):
        text = line(rng.randrange(1, 90))
        if i % 7 == 0:
            text = f"{text} {passage} {line(5)}"
        if i % 11 == 0 and i:
            text = rows[i - 1][1]
        if i % 13 == 0:
            text = f"{text}\tmail a.b{i}@x.example.org or 10.0.{i}.1, +1 (200) 555-{1000 + i}; 4242 4242 4242 4242"
        if i % 5 == 0:
            text = (text or "") + " &&&" * 6
        rows.append([i, text, "en", f"s{i % 4}" if i % 9 else None])
    rows += [[500, None, None, None], [501, "", "fr", "s1"], [502, " \n\t ", "fr", "s2"], [503, "one", "fr", "s2"], [504, "word " * 20000, "en", "s0"], [505, "9" * 2500, "en", "s0"]]
    rows += [[None, line(40), "en", "s1"], rows[3], rows[3], [3, line(50), "en", "s3"]]
    return [(*r, None if r[1] is None else len(r[1]), "k", 1, "f", 2, 3, "x", 0, 5, "z") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
