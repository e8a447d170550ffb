"""Quality rules by fertility against a plain version that uses the tokenizers' own libraries."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from crewlens.llm import fertility
from tests.llm.data import SCHEMA, documents

PATHS = [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    rows = [list(r) for r in documents()]
    texts = ["a b c a b c a b c", "x\nx\n\n \n \nx y\nx y ", "one two\rone two\none two", "日本 語 ñ ö é́ 😀😀", "\u0000   �", "a" * 3000, "% # $$ <|endoftext|> </s> ▁▁x", "w " * 60 + "\n"]
    noise = [" ".join(f"{random.Random(i * 99 + k).getrandbits(90):x}" for k in range(80)) for i in range(2)]
    return rows + [[600 + i, t, lang, *rows[0][3:]] for i, (t, lang) in enumerate(zip([*texts, *noise], ["en", None, "", " ", "xx", "en", "en", "de", "en", "en"], strict=True))]


def base(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def shapes(text):
    words, found = WORD.findall(text), []
    piece = sentencepiece.SentencePieceProcessor(model_file=PATHS[0])
    byte = Tokenizer.from_file(PATHS[1])
    byte.encode_special_tokens = True
    letters = {b for b in range(256)}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(letters - set(plain)))}

    def is_part(i):
        try:
            bytes(spelled.get(c, 0x41) for c in byte.id_to_token(i)).decode()
        except UnicodeDecodeError:
            return True
        return False

    for spell, is_byte in ((piece.encode, piece.is_byte), (lambda w: byte.encode(" " + w, add_special_tokens=False).ids, is_part)):
        ids = [i for w in words for i in spell(w)]
        n, count = max(1, len(ids)), Counter(ids)
        found += [sum(map(len, words)) / n, sum(map(is_byte, ids)) / n, -sum(c / n * math.log2(c / n) for c in count.values())]
    return found


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_counts_and_measures(data, monkeypatch, block):
    monkeypatch.setattr(fertility, "_BLOCK", block)
    got = sorted(fertility.measured(data, PATHS).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words, r.word_chars))
    rows = sorted(odd_rows(), key=lambda r: (r[0] is None, r[0], *base(r[1] or "")[:2]))
    assert len(got) == len(rows)
    for r, row in zip(got, rows, strict=True):
        text = row[1] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text), text[:80]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert np.allclose(r.measures, shapes(text)), text[:80]
        assert r.band == ((row[2] or "").strip() or r.script) and (r.script is None) == bool((row[2] or "").strip())


def test_bands_and_verdicts(data):
    found = fertility.judged(data, PATHS).collect()
    limits = {}
    for band in {r.band for r in found}:
        for i in range(6):
            steps = [round(r.measures[i] / fertility.STEP[i % 3]) for r in found if r.band == band and not r.base_failed]
            if steps:
                low, high = (float(q) * fertility.STEP[i % 3] for q in np.percentile(steps, [25, 75]))
                off = fertility.REACH * (high - low)
                limits[band, i] = low - off, high + off
    for r in found:
        error = [s / max(1, r.n_words) ** 0.5 for s in fertility.SPREAD * 2]
        names = [f"{fertility.MEASURES[i % 3]}_{i // 3 + 1}" for i in range(6) if (r.band, i) in limits and not limits[r.band, i][0] - error[i] <= r.measures[i] <= limits[r.band, i][1] + error[i]]
        assert r.outside == names and r.kept == (not r.base_failed and not names)
    verdict = {r.doc_id: r for r in found}
    assert not verdict[608].base_failed and not verdict[608].kept and "chars_per_token_1" in verdict[608].outside
    assert not verdict[None].base_failed or verdict[None].n_words < 50


def test_scripts():
    assert [fertility.script(t) for t in ("abc é", "Привет a", "日本語", "12 %", "", "かな", "한국어", "שלום")] == ["latin", "cyrillic", "han", "none", "none", "kana", "hangul", "hebrew"]


def test_words_spelled_together_are_spelled_alone():
    """Words of one call don't meet, whatever they hold; a kept word gives the same ids."""
    byte = Tokenizer.from_file(PATHS[1])
    byte.encode_special_tokens = True
    words = ["it's", "'s", "\u00a0", "a\u00a0", "\u00a0b", "x\u2003y", "9" * 500, "é" * 300, "<|endoftext|>", "%%%", "\u3000\u3000", "don't'll", "日本"]
    for speller in (fertility.speller(PATHS[1]), fertility.Speller(fertility.speller(PATHS[1]).spell, np.zeros(0, bool))):
        for part in (words, words[::-1], words[3:] + ["new"]):
            ids, head, size = speller([w.encode() for w in part])
            assert [ids[h : h + n].tolist() for h, n in zip(head, size, strict=True)] == [byte.encode(" " + w, add_special_tokens=False).ids for w in part]


def test_no_rows(spark):
    assert fertility.judged(spark.createDataFrame([], SCHEMA), PATHS).count() == 0
