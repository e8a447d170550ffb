"""Fill-in-middle against a plain version, and back."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crewlens.llm import fim
from tests.llm.data import SCHEMA, documents, frame


def plain(doc_id, text, seed=7, rate=100, spm=50, sentinels=fim.SENTINELS):
    text = text or ""
    p, s, m = sentinels
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b, c = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(a), len(b), s + c + p + a + m + b
    return doc_id, n, "psm", len(a), len(b), p + a + s + c + m + b


def odd_rows():
    rows = [list(r) for r in documents()]
    texts = ["\n", "\n\n\n", "a\nb", "a\n\nb\n", "x <P> y\nz", "<S", "P><", "é\n日本\n<\nM>\r\n\x0b", "line\n" * 5000, "日" * 70000 + "\n" + "b" * 70001]
    return rows + [[600 + i, t, *rows[0][2:]] for i, t in enumerate(texts * 4)]


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm_rate": 100}, {"seed": 11, "spm_rate": 0, "sentinels": ("[p]", "[s]", "[m]")}])
def test_fill_in_middle(spark, options):
    made = fim.fill_in_middle(spark.createDataFrame(odd_rows(), SCHEMA).repartition(3), **options)
    marks = options.get("sentinels", fim.SENTINELS)
    names = {"seed": "seed", "rate": "rate", "spm_rate": "spm", "sentinels": "sentinels"}
    expected = [plain(r[0], r[1], **{names[k]: v for k, v in options.items()}) for r in odd_rows()]
    assert sorted(map(repr, (tuple(r) for r in made.collect()))) == sorted(map(repr, expected))
    back = fim.restore(made, marks).select("doc_id", "restored").collect()
    assert sorted(map(repr, (tuple(r) for r in back))) == sorted(repr((r[0], r[1] or "")) for r in odd_rows())
    assert {"psm", "spm", "plain"} >= {e[2] for e in expected}


def test_restore_keeps_columns_of_clashing_names(spark):
    made = fim.fill_in_middle(frame(spark)).withColumn("restored", F.lit(1)).withColumn("output_bytes", F.lit("x"))
    back = fim.restore(made)
    assert back.columns == [*made.columns, "restored_"]
    assert back.where("restored = 1 and output_bytes = 'x'").count() == len(documents())
    assert fim.restore(fim.fill_in_middle(frame(spark, []))).count() == 0


def test_sentinels_must_not_overlap(spark):
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "x"), ("", "a", "b"), ("aa", "b", "c"), ("<P>", "x<P>", "y")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(frame(spark, []), sentinels=bad)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.data())
def test_rotation(data, pick):
    start, cut, end = sorted(pick.draw(st.lists(st.integers(0, len(data)), min_size=3, max_size=3)))
    block, fim._BLOCK = fim._BLOCK, 3
    try:
        array = np.array(bytearray(data), np.uint8)
        fim.rotate(array, start, cut, end)
    finally:
        fim._BLOCK = block
    assert array.tobytes() == data[:start] + data[cut:end] + data[start:cut] + data[end:]
