"""Word arrays, windows, spans, positions and components against plain versions."""

import random

import numpy as np
import pyarrow as pa
from brute import letters, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.ranked import with_position
from ledgerline.llm.textwords import LETTERS, NOT_SPACE, merged, steps, window_keys, window_starts, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 \t\n\x0b\x85 éÉ文😀-|'", max_size=60)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_of_a_column(texts):
    for kind, lower, plain in ((NOT_SPACE, False, words), (LETTERS, True, letters)):
        w = words_of(pa.array(texts, pa.string()), kind, lower)
        want = [x.encode() for t in texts for x in plain(t)]
        assert [w.text(i) for i in range(len(w.start))] == want
        assert w.counts.tolist() == [len(plain(t)) for t in texts]
        keys = dict(zip(want, w.keys().tolist(), strict=True))
        assert len(set(keys.values())) == len(keys)


def test_long_words_have_different_keys():
    texts = ["x" * n for n in range(1, 60)] + ["x" * 40 + "y" + "x" * 10]
    assert len(set(words_of(pa.array(texts), NOT_SPACE).keys().tolist())) == len(texts)


def test_steps_cut_by_bytes_and_keep_every_row():
    texts = ["a" * 10, None, "b" * 1000, "", "c" * 5] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(steps(iter([batch.slice(0, 0), batch]), most=50))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 50 for p in parts)


def test_windows_stay_inside_a_text():
    w = words_of(pa.array(["a b c d", "a b c", "", "b c d a b c d"]), NOT_SPACE)
    assert np.flatnonzero(window_starts(w.first, 4)).tolist() == [0, 7, 8, 9, 10]
    keys = window_keys(w.keys(), 4)
    assert keys[0] == keys[10] and keys[0] != keys[7]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9))))
def test_merged_spans(pairs):
    start, end = np.array([a for a, _ in pairs], np.int64), np.array([a + n for a, n in pairs], np.int64)
    s, e = merged(start, end)
    marks = {i for a, n in pairs for i in range(a, a + n)}
    assert {i for a, b in zip(s, e, strict=True) for i in range(a, b)} == marks
    assert all(b < a for b, a in zip(e[:-1], s[1:], strict=True))


def test_positions_follow_the_binary_order(spark):
    values = [None, "é", "a", "Z", "文", "b", "", "😀"] + [f"k{i:03d}" for i in range(50)]
    got = with_position(spark.createDataFrame([(v,) for v in values], "s string"), "s").collect()
    want = sorted((v for v in values if v is not None), key=lambda v: v.encode()) + [None]
    assert [r["s"] for r in sorted(got, key=lambda r: r["position"])] == want
    assert with_position(spark.createDataFrame([], "s string"), "s").count() == 0


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges += [(-5, -9), (-9, 300), (7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200 + i: 200 for i in range(9)} | {-5: -9, -9: -9, 300: -9}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).filter(F.lit(True)).count() == 0
