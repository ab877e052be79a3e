"""Merkle manifest, filter audit and line dedup against plain versions, and on odd tables."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import filteraudit, linededup, merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
CLASH = {n: "kept" for n in "digest tree size run path part failed words low high key line position dropped text_hash n _id left right kind range id".split()}


def same(got, want):
    def key(r):
        return tuple((x is None, str(x)) for x in r)

    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def clashing(df):
    return df.withColumns({n: F.lit(v) for n, v in CLASH.items()})


def odd_rows(long_text, seed=0):
    """Nulls in every column, blanks, repeated rows, copies, shared lines, a very long text and a very long list of lines."""
    rng = random.Random(seed)
    shared = [f"This Line number {i} is in many documents" for i in range(6)]
    shared += ["\t" + shared[0].upper() + " \r", "short", "exactly twenty chars", "nineteen characters", "  ", "ÄÖÜ äöü ÉÈ line of other letters é", "文字" * 12]
    rows = []
    for i in range(90):
        text = "\n".join(rng.choice(shared) if rng.random() < 0.5 else f"own {i} {rng.random()} | A" for _ in range(rng.randrange(1, 9)))
        rows.append((i % 70, rng.choice(["a", "b", "B", "", "ä", None]), rng.choice(["en", "fr", None, ""]), rng.choice([len(text), None]), text))
    rows += [(None, "a", "en", 3, shared[0]), (None, None, None, None, None), (None, None, None, None, None), (500, "a", "en", 0, ""), (501, "a", "en", 0, None)]
    rows += [(600, "b", "en", 1, "COPY of a text $")] * 40 + [(601 + i, "b", "en", 1, "COPY of a text $") for i in range(30)]
    rows += [(700, "c", "fr", 9, long_text), (701, "c", "fr", 9, long_text), (702, "c", "fr", 9, "\n".join(shared * 700)), (703, "c", "fr", 9, "\n" * 500), (704, "c", "fr", 9, "\n".join(shared))]
    return rows


@pytest.fixture(scope="module")
def odd(spark, long_text):
    rows = odd_rows(long_text)
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sources_of_many_sizes(spark):
    """Sources of 1, 15 to 17, 255 to 257 and 300 rows, and 20 of one row."""
    sizes = {"s0": 1, "s1": 15, "s2": 16, "s3": 17, "s4": 255, "s5": 256, "s6": 257, None: 300} | {f"t{i}": 1 for i in range(20)}
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((doc * 7919 % 10_007, source, "en", 5, f"Text {doc}" if doc % 2 else f"text {doc}"))
            doc += 1
    return rows, spark.createDataFrame(rows, SCHEMA)


# 11: Merkle manifest


def manifest_rows(df, spark, tmp_path):
    path = str(tmp_path)
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return merkle.op11_merkle_manifest(spark, path).collect()


def test_manifest_equals_plain_trees(spark, sources_of_many_sizes, odd, tmp_path):
    for k, (rows, df) in enumerate((sources_of_many_sizes, (odd[0], clashing(odd[1])))):
        got = manifest_rows(df, spark, tmp_path / str(k))
        same(got, brute.merkle(rows))
    untouched = {r["doc_id"] for r in got if r["doc_id"] is None or brute.zlib.crc32(str(r["doc_id"]).encode()) % 5}
    assert all(r["verified"] for r in got if r["doc_id"] in untouched)
    assert any(not r["verified"] for r in got)


def test_many_equal_rows_are_listed_in_chunks(spark, monkeypatch):
    rows = [(1, "a", "en", 1, "same")] * 70 + [(2, "a", "en", 1, "X")] * 3 + [(0, "a", "en", 1, "y")]
    monkeypatch.setattr(merkle, "CHUNK", 16)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["position"] for r in got) == list(range(74))
    assert sorted(r["digest"] for r in got) == sorted(brute.merkle_leaf(r) for r in rows)
    assert {r["subroot"] for r in got} == {brute.merkle(rows)[0][2]}


def test_manifest_notices_any_change(spark, sources_of_many_sizes):
    rows, df = sources_of_many_sizes
    root = brute.merkle(rows)[0][3]
    for column, value in (("lang", None), ("source", "s9")):
        changed = df.withColumn(column, F.when(F.col("doc_id") == rows[40][0], F.lit(value)).otherwise(F.col(column)).cast(df.schema[column].dataType))
        assert merkle.manifest(changed).first()["root"] != root
    assert merkle.manifest(df.repartition(7)).first()["root"] == root


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(spark.createDataFrame([(4, None, None, None, None)], SCHEMA)).first()
    assert one["digest"] == one["subroot"] == one["root"] == brute.sha("1:4----") and one["path"] == []


# 12: filter audit


def test_galloping_merges():
    rng = np.random.default_rng(3)
    for _ in range(400):
        lists = [np.unique(rng.integers(0, rng.integers(1, 600), rng.integers(0, 90))) for _ in range(3)]
        a, b, c = lists
        assert filteraudit.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
        assert filteraudit.union(lists).tolist() == sorted({*a.tolist(), *b.tolist(), *c.tolist()})
        assert filteraudit.difference(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
        many = np.repeat(a, 3)
        assert filteraudit.holds(b, many).tolist() == np.isin(many, b).tolist()


def audit_rows(docs, labels):
    out = filteraudit.orders_report(filteraudit.interactions(docs, labels))
    assert out.columns == ["part", "filter_order", "step", *filteraudit.COUNTS, "shapley"]
    return out.collect()


def test_audit_equals_plain_filters(spark, odd, monkeypatch):
    rows, df = odd
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 705, 3)] + [(6, 1, 1), (6, 0, 0), (None, 1, 1), (9, None, None), (10**12, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    want = brute.filter_audit([(d, t, lang) for d, _, lang, _, t in rows], marks)
    same(audit_rows(df, labels), want)
    same(audit_rows(clashing(df), clashing(labels.withColumn("text", F.lit("x")))), want)
    monkeypatch.setattr(filteraudit, "HEAVY", 1)  # no text is hot
    same(audit_rows(df, labels), want)


def test_audit_in_small_steps():
    """Ranges, parts and chunks cut a partition's rows in any way; the sums stay."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = [(r, 0, "", r * 4096 + i, int(rng.integers(0, 4)), 1) for r in range(3) for i in range(0, 400, 7)]
    rows += [(r, 1, p, r * 4096 + i, int(rng.integers(0, 32)), int(rng.integers(1, 3))) for r in range(3) for p in ("", "de", "en") for i in range(400)]
    rows = [(None, 1, "en", None, 3, 2), *sorted(rows, key=lambda r: r[:4])]
    table = pa.table(dict(zip(("range", "kind", "part", "id", "bits", "n"), map(list, zip(*rows, strict=True)), strict=True)))

    def sums(size, chunk, parts):
        filteraudit.CHUNK, filteraudit.PARTS = chunk, parts
        total = {}
        for out in filteraudit.sums_of_ranges(iter(table.to_batches(max_chunksize=size))):
            for part, cell, *counts in zip(*out.values(), strict=True):
                total[part, cell] = total.get((part, cell), 0) + np.array(counts)
        return {k: v.tolist() for k, v in total.items()}

    before = filteraudit.CHUNK, filteraudit.PARTS
    try:
        one = sums(10_000, 1 << 16, 256)
        assert len(one) == 3 * len(filteraudit.CELLS) and sum(r[5] for r in rows if r[1] and r[2] == "en") == sum(one["en", 0][:2])
        assert sums(7, 1 << 16, 1) == sums(100, 50, 2) == one
    finally:
        filteraudit.CHUNK, filteraudit.PARTS = before


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit_rows(docs, labels) == []
    assert len(audit_rows(spark.createDataFrame([(1, "a", None, 1, None)], SCHEMA), labels)) == 600


# 13: line dedup


def line_rows(df, **options):
    rows = linededup.with_kept_text(linededup.with_bitmaps(df, **options))
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], brute.sha(r["kept_text"])) for r in rows.collect()]


def test_line_dedup_equals_plain(spark, odd, monkeypatch):
    rows, df = odd
    want = brute.kept_lines([(d, t) for d, _, _, _, t in rows])
    assert sum(w[2] for w in want) > 1000
    same(line_rows(df), want)
    same(line_rows(clashing(df)), want)
    for heavy in (1, 20):  # no or few hot lines
        monkeypatch.setattr(linededup, "HEAVY", heavy)
        same(line_rows(df), want)
    same(line_rows(df, min_chars=3, min_documents=2), brute.kept_lines([(d, t) for d, _, _, _, t in rows], 3, 2))


def test_bitmaps_hold_only_words_with_a_dropped_line(spark):
    line = "a line that three documents have"
    texts = [(i, "\n".join(line if k in (0, 63, 64, 700) else f"{i} {k}" for k in range(800))) for i in range(3)]
    found = {r["doc_id"]: r["dropped"] for r in linededup.bitmaps(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    bits = [(w["word"], w["bits"] % 2**64) for w in found[0]]
    assert sorted(found) == [0, 1] and bits == [(0, 1 | 1 << 63), (1, 1), (10, 1 << 60)]


def test_lowering_is_that_of_ascii(spark):
    texts = ["ABC xyz", "ÀÉ Z", "İ I", "", None, "文A"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(linededup.lowered(F.col("t"))).collect()]
    assert got == [None if t is None else t.translate(brute.ASCII_LOWER) for t in texts]


def test_line_dedup_runs_no_python(spark, odd):
    plan = linededup.with_kept_text(linededup.with_bitmaps(odd[1]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_of_an_empty_table(spark):
    assert line_rows(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_filter_audit", "op13_line_dedup"])
def test_queries_equal_their_sql(spark, data, duck, name):
    from ledgerline.llm.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, data)
    want = duck.sql(ORACLES[name])
    columns = [c for c in df.columns if c in want.columns]
    assert sorted(columns) == sorted(want.columns)
    got = df.select(*columns).collect()
    same(got, duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


def test_line_dedup_query_has_the_columns_of_its_sql(spark, data, duck):
    from ledgerline.llm.queries import ORACLES, QUERIES

    assert QUERIES["op13_line_dedup"](spark, data).columns == duck.sql(ORACLES["op13_line_dedup"]).columns
