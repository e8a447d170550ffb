"""The text operators against brute-force versions, on odd documents and on none."""

import collections
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from crewlens.llm import bpe, mixing, pii, quality, simhash, substrings, tokencounts
from crewlens.llm.queries import tokenizer_path

from .data import documents, frame


def same(got, expected):
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))] if 16 <= len(digits) <= 19 else [1]
        return sum(t - 9 if t > 9 else t for t in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii(spark, docs, none):
    expected = []
    for row in documents():
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, row[1] or "") if valid(k, m[0])]
        text = ",".join(f"{k}:{a}:{e}" for k, a, e in spans)
        expected.append((row[0], *(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(text.encode()).hexdigest()))
    got = pii.span_digests(docs)
    same([tuple(r)[:6] for r in got.collect()], expected)
    assert pii.span_digests(none).count() == 0


def test_pii_contexts_and_redaction(spark):
    rows = [(i, f"hello {i} Mobile: +1 (200) 555-{1000 + i} bye") for i in range(8)] + [(90, "é Mobile: 555-0199-22 now"), (91, "no 555-0100-33 now"), (92, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.span_digests(df).collect()}
    assert spans[90] == "phone:10:21" and spans[91] == "" and spans[92] == ""
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[90] == "é Mobile: [PHONE] now" and out[0] == "hello 0 Mobile: [PHONE] bye" and out[92] is None


def test_pii_rounds(spark):
    """Instances found by one word make the word behind them a pattern, which finds more; two words may be a pattern as well."""
    rows = [(i, f"Mobile: +1 (200) 555-{1000 + i} ok {i}") for i in range(12)]
    rows += [(100 + i, f"Mobile: 555-02{10 + i}-77 Zed") for i in range(6)] + [(200, "then 444-0199-55 Zed"), (201, "none 444-0100-33 here")]
    rows += [(300 + i, f"call his office desk +1 (300) 555-{2000 + i} my desk") for i in range(6)] + [(310, "call his office desk 020 7946 0958 x"), (311, "in 2019 2020")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.span_digests(df).collect()}
    assert spans[200] == "phone:5:16" and spans[201] == "" and all(spans[100 + i] == "phone:8:19" for i in range(6))
    assert spans[310] == "phone:21:34" and spans[311] == ""


def test_redaction_keeps_columns(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where(F.col("text").contains("@x.example")).count() == 0


def test_helper_columns_clash(spark):
    """Names that the operators use for themselves are columns of the caller."""
    names = ["key", "key of spans", "spans", "key kept", "of", "shard", "place", "row of key", "key of row", "key of the row"]
    row = (1, "mail a.b@x.example.org " + "word " * 9, "en", "s", *names)
    df = spark.createDataFrame([row, (2, None, None, None, *names)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for out in (pii.redact(df), simhash.keep_one(df), mixing.mixed_documents(df), quality.good_documents(df, df.select("doc_id", F.lit(1).alias("quality")))):
        assert out.columns == df.columns and all(r[n] == n for r in out.collect() for n in names)


def test_quality(spark, docs, none):
    good = ["the quiet river runs past the old mill and the field", "we walked to the market and bought bread and fruit"]
    rows = [(i, f"{good[i % 2]} {i}" if i % 2 else f"BUY!! NOW!! {i} &&& $$$ ###") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels, "quality", ~quality.held_out())
    scored = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert sum((scored[i] >= 0.5) == (i % 2 == 1) for i in range(400)) >= 396
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(docs, model).count() == docs.count() and quality.score(none, model).count() == 0
    empty = quality.fit(df, labels.where("doc_id < 0"), "quality", F.lit(True))
    assert {r.score for r in quality.score(df, empty).collect()} == {0.5}
    assert quality.good_documents(docs, labels).columns == docs.columns
    # Rows are judged one by one, whatever their doc_id, repeated ones alike.
    odd = spark.createDataFrame([(1, rows[1][1], "a"), (1, rows[0][1], "b"), (None, rows[3][1], "c"), (None, rows[2][1], "d"), (None, rows[3][1], "e")], "doc_id long, text string, score string")
    assert sorted(r.score for r in quality.good_documents(df.withColumn("score", F.lit("z")).union(odd), labels).collect() if r.score != "z") == ["a", "c", "e"]


def test_bpe_equals_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    more = [(900, "a<|endoftext|>b  c\n\n d's 'lls I'll"), (901, "a" * 700), (902, "日本語 😀  x y ٣٤ Ⅷ"), (903, "aaaa bbbb " * 50)]
    rows = [(r[0], r[1]) for r in documents()] + more
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for lexicon in (None, bpe.build_lexicon(df, path)):
        same([tuple(r) for r in bpe.token_digests(df, path, lexicon).collect()], expected)
    back = bpe.decode(bpe.encode(df, path), path)
    same([tuple(r) for r in back.collect()], [(i, t or "") for i, t in rows])
    assert bpe.token_digests(none, path, bpe.build_lexicon(none, path)).count() == 0


def plain_targets(sizes):
    """share x all sizes by weight, stops and reshares, one source after the other."""
    target, free, rest = {}, list(range(len(sizes))), 1.5 * sum(sizes)
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    while True:
        total = sum(weight[i] for i in free)
        over = [i for i in free if rest * weight[i] / total > 2 * sizes[i]]
        if not over:
            return target | {i: rest * weight[i] / total for i in free}
        target |= {i: 2 * sizes[i] for i in over}
        rest -= sum(target[i] for i in over)
        free = [i for i in free if i not in over]


def test_mixing(docs, none):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    got = mixing.taken_words(docs).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r[0], size(r)) for r in documents())
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(docs).collect()))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    # Source by source: sizes, targets and what is taken.
    names = sorted({r[3] for r in documents()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r) for r in documents() if r[3] == s) for s in names]
    targets = plain_targets(sizes)
    expected = {n: (targets[i], int(targets[i])) for i, n in enumerate(sizes)}
    assert len(expected) == len(names)
    found = collections.defaultdict(lambda: [0.0, 0])
    for r in got:
        found[r.source_size][0] = r.target
        found[r.source_size][1] += r.taken
    for n, (target, words) in expected.items():
        assert abs(found[n][0] - target) < 1e-6 and abs(found[n][1] - words) <= 1
    assert mixing.taken_words(none).count() == 0
    # Every row taken stands in a shard; the shards' blocks differ by one at most; the tree's result is what op6 counts.
    whole, taken = mixing.mix(docs)
    assert taken.agg(F.sum("words")).first()[0] == sum(r.taken for r in got)
    assert {s for r in got for s in r.shards} == {r[0] for r in taken.select("shard").distinct().collect()} <= set(range(mixing.SHARDS))
    ordered = [(r.shard, r.place) for p in mixing.shard_order(taken).rdd.glom().collect() for r in p]
    assert len(ordered) == taken.count() and sorted(ordered) != ordered[::-1]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mixed_documents(none).count() == 0
    key = lambda r: (r.doc_id, r.source, r.text)
    copies, rows = collections.Counter(map(key, out.collect())), {key(r): r for r in docs.collect()}
    count = collections.Counter(map(key, docs.collect()))
    assert set(copies) <= set(rows) and all(n <= 2 * count[k] for k, n in copies.items())
    words = collections.Counter()
    for k, n in copies.items():
        words[k[1]] += n * size(rows[k])
    longest = {s: max(size(r) for r in documents() if r[3] == s) for s in names}
    assert all(targets[i] - longest[s] <= words[s] <= targets[i] for i, s in enumerate(names))


def test_mixing_tells_rows_apart(spark):
    """Null and repeated doc_ids: six texts without an id, and two texts of one id."""
    rows = [(None, "x " * (10 + i), "a") for i in range(6)] + [(1, "y " * 8, "b"), (1, "z " * 9, "b"), (2, "w " * 500, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, out = mixing.taken_words(df), mixing.mixed_documents(df)
    counted = {(r.doc_id, r["size"]): r.taken // r["size"] for r in taken.collect()}
    copies = collections.Counter((r.doc_id, len(r.text.split())) for r in out.collect())
    assert all(copies[k] in (n, n - 1) or copies[k] == n for k, n in counted.items()) and sum(copies.values()) >= sum(counted.values()) - 3


def test_targets_and_tree(spark, monkeypatch):
    import numpy as np

    sizes = [7, 100, 100, 3, 2000, 1, 50, 80, 9, 12]
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    expected = plain_targets(sizes)
    assert all(abs(expected[r.part] - r.target) < 1e-9 and r.source == f"s{r.part}" for r in mixing.source_targets(df).collect())
    parts = mixing.split_quotas(np.array([7, 40, 3]), mixing.even(50, 5), np.random.default_rng(1))
    assert parts.sum(axis=0).tolist() == [7, 40, 3] and parts.sum(axis=1).tolist() == [10] * 5
    # Groups of two sources: quotas and shards stay exact.
    monkeypatch.setattr(mixing, "GROUP", 2)
    drawn = spark.createDataFrame([(i % 5,) for i in range(83)], "part long")
    ends = {r.part: r.ends for r in mixing.shard_ends(drawn, 3, 4).collect()}
    dealt = np.diff(np.array([[0, *ends[p]] for p in range(5)]), axis=1)
    assert dealt.sum(axis=1).tolist() == [17, 17, 17, 16, 16] and sorted(dealt.sum(axis=0).tolist()) == [20, 21, 21, 21] and dealt.min() >= 0


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    rows = [(r[0], plain_fingerprint(r[1] or "")) for r in documents()]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    got = simhash.simhash_groups(docs)
    same([(r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()], [(d, f, least.get(find(f))) for d, f in rows])
    assert simhash.simhash_groups(none).count() == 0
    # Of each group the row of the least doc_id stays, once, a null one only where there is no other.
    kept = simhash.keep_one(docs)
    stays = {}
    for (d, f), text in zip(rows, (r[1] for r in documents()), strict=True):
        stays.setdefault(find(f), set()).add((d is None, d or 0, d, text))
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    firsts = {g: min(r[:2] for r in rs) for g, rs in stays.items()}
    assert sum(got.values()) == len(stays) and max(got.values()) == 1
    assert all(sum((d, t) in got for none, number, d, t in rs if (none, number) == firsts[g]) == 1 for g, rs in stays.items())
    assert None in {d for d, _ in got}
    assert kept.columns == docs.columns and simhash.keep_one(none).count() == 0


def test_near_fingerprints(spark, monkeypatch):
    """Groups that need steps and cells of several tiles."""
    import random

    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in centres for k in (0, 1, 2, 3, 4) for _ in range(4)}
    monkeypatch.setattr(simhash, "BLOCK", 8)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    from crewlens.llm.components import components

    got = {r.node: r.root for r in components(simhash.near_links(df)).collect()}
    label = {f: f for f in map(signed, fps)}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {f: got.get(f, f) for f in label} == label


def twisted(order, letters="ab"):
    """The word of Thue and Morse: 2**order letters, equal to its twin under polynomials modulo 2**64."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << order))


def test_words_are_compared(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = [twisted(k, p) for k in (10, 11) for p in ("ab", "ba")] * 2
    texts += [f"{texts[0]} {texts[1]} {texts[0]}"]
    encoder = bpe.Encoder(path)
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    from crewlens.llm.wordseq import distinct_words, find_words

    words = find_words([t.encode() for t in texts])
    words.name[:] = 0
    _, of = distinct_words(words.data, words.start, words.end)
    flat = words.data.tobytes()
    spelt = [flat[s:e] for s, e in zip(words.start, words.end, strict=True)]
    assert all((of[i] == of[j]) == (a == b) for i, a in enumerate(spelt) for j, b in enumerate(spelt))
    # 34 equal words and one that differs: no window repeats. With the same one, all do.
    line = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{line} {twisted(k, p)}") for i, (k, p) in enumerate([(10, "ab"), (10, "ba"), (11, "ab"), (11, "ba")])]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substrings.dedup_substrings(once).collect()] == [0] * 4
    again = spark.createDataFrame([*rows, (9, f"{line}\t {twisted(10)}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.dedup_substrings(again).collect()} == {0: 35, 1: 0, 2: 0, 3: 0, 9: 35}


def test_names_that_collide(docs, monkeypatch):
    """Equal names of different words and symbols cost candidates, no result."""
    import numpy as np

    from crewlens.llm import wordseq

    expected = sorted(map(str, substrings.dedup_substrings(docs).collect()))
    real = wordseq.word_names
    monkeypatch.setattr(wordseq, "word_names", lambda *a: real(*a) % np.uint64(3))
    texts = [(r[1] or "").encode() for r in documents()]
    words = wordseq.find_words(texts)
    start = np.flatnonzero(words.doc[:-34] == words.doc[34:])
    plain = [b" ".join(t.split()[i : i + 35]) for t in texts for i in range(max(0, len(t.split()) - 34))]
    digests = [bytes(d) for d in substrings.digests(words, start, start + 35)]
    assert [hashlib.blake2b(p, digest_size=16).digest() for p in plain] == digests and expected


def plain_kept(rows):
    rows = [(d, (t or "").encode().split()) for d, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    expected = []
    for d, w in rows:
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return expected


def test_substrings(docs, none):
    got = substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    same([tuple(r) for r in got.collect()], plain_kept([(r[0], r[1]) for r in documents()]))
    assert substrings.dedup_substrings(none).count() == 0


def test_substrings_of_edited_copies(spark):
    """Copies with words changed, cut and repeated, so that equal passages end anywhere."""
    import random

    rng = random.Random(8)
    line = lambda k, n: [f"w{rng.randrange(n)}" for _ in range(k)]
    bases, rows = [line(rng.randrange(60, 160), n) for n in (3, 40, 400) for _ in range(4)], []
    for i in range(160):
        words = list(rng.choice(bases))
        a = rng.randrange(len(words) // 2)
        words = line(rng.randrange(20), 400) + words[a : a + rng.randrange(30, 120)] + line(rng.randrange(20), 3)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words + words[:50] if i % 10 == 0 else words)))
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    same([tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], plain_kept(rows))


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_token_counts(spark, docs, block):
    path = tokenizer_path()
    separator = bpe.vocabulary(path).special["<|endoftext|>"]
    rows = docs.where("doc_id is not null")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    count = lambda text: len(library.encode(text or "", add_special_tokens=False).ids)
    expected = [(r.doc_id, count(r.text)) for r in rows.collect()]
    same([tuple(r) for r in tokencounts.document_tokens(rows, path, separator, block=block).collect()], expected)


def test_flat_files(spark, tmp_path, none):
    import numpy as np

    np.array([5, 5, 9, 9, 1, 2, 3, 9, 4], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    found = tokencounts.count_tokens(tokencounts.read_flat_files(spark, str(tmp_path), block=2), 9)
    assert [r.n_tokens for r in found.orderBy("ordinal").collect()] == [2, 0, 3, 1]
    # Ids of 32 bits, and a file of several tasks' ranges, against the places of the id.
    ids = np.random.default_rng(3).integers(0, 1 << 18, 5000)
    ids[np.random.default_rng(4).integers(0, 5000, 90)] = 70000
    ids[-1] = 9 + (1 << 16)
    (tmp_path / "wide").mkdir()
    ids.astype("<u4").tofile(tmp_path / "wide" / "c.bin")
    ends = np.flatnonzero(ids == 70000)
    expected = [*np.diff(np.concatenate(([-1], ends))) - 1, *([5000 - ends[-1] - 1] if ends[-1] < 4999 else [])]
    for block in (3, 64):
        found = tokencounts.count_tokens(tokencounts.read_flat_files(spark, str(tmp_path / "wide"), block, "<u4"), 70000, "<u4")
        assert [r.n_tokens for r in found.orderBy("ordinal").collect()] == expected
    assert tokencounts.token_type(1 << 16) == "<u2" and tokencounts.token_type(70000) == "<u4"
    assert tokencounts.document_tokens(none, tokenizer_path(), 50256).count() == 0
