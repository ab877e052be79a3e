"""Toxicity by nearest labelled examples: exact TF-IDF cosine on block-max inverted lists.

A term is a lower-cased word's stem, its first STEM bytes, so that unseen endings still
meet. A bounded, seeded sample of labelled rows, one of each group of copies (equal
smallest shingle hash), gives the examples; every term of an example is indexed, and
document frequencies of all of them are counted over all texts. Terms that no example has
can't meet one and are left out of a text's vector.

Examples lie in blocks of like ones; the sum of a text's weights times the largest weight of
each term in a block bounds the block's best cosine. Blocks are visited by falling bound, in
rounds, until no bound reaches the K-th best cosine. Terms of many examples are multiplied
as a dense matrix of 32-bit numbers, others by posting lists; whatever may be among the K
nearest within the rounding is then scored anew in 64 bits: the K nearest examples are
exact. Equal texts of a step are scored once.

Votes are weighted by squared cosine, with PRIOR_MASS added for the examples that share no
term; the vote is turned into a probability by a logistic curve fitted on the examples with
themselves left out, each counted for the labelled rows it stands for.

Cases: a null or empty text, or one without any term, gets the score of a vote of 0;
without labelled rows of both kinds every score is the (smoothed) share of label 1;
equal texts get equal scores, since nothing but the text is used; repeated label rows of
an id count once, by their largest label."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.rows import TEXT, annotate, gathered, table
from ledgerline.llm.textwords import LETTERS, LOW_BYTES, STEP_BYTES, Words, mix, steps, window_keys, window_starts, words_of
from ledgerline.sources.writers import written

EXAMPLES = 2_000  # of each label at most, those of smallest hash among different texts
CANDIDATES = 4  # times as many rows are looked at, so that copies can give way to other texts
STEM = 4  # bytes
K = 40
BLOCK = 128  # examples
DIRECTIONS = 512  # terms by which like examples are put together
DENSE = 30  # a term of one in so many examples is kept as a dense row
QUERIES = 256  # texts scored at once
WHOLE_CELLS = 1 << 22  # of texts times terms
PAIR_ENTRIES = 1 << 20  # entries of nearest examples looked at once
FIRST_BLOCKS = 4  # visited before the others; every round visits twice as many
PRIOR_MASS = 0.02
CUT = 0.7  # predicted 1 from this score on
FOLDS, HELD_OUT = 3, 1

OUTPUTS = "score double, predicted int, evidence array<bigint>"


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every word's stem."""
    view = np.ndarray(len(words.data) - 7, dtype="<u8", buffer=words.data, strides=(1,))
    length = np.minimum(words.end - words.start, STEM)
    keys = mix((view[words.start] & LOW_BYTES[length]) * np.uint64(0xD6E8FEB86659FD93) + length.astype(np.uint64))
    return keys, words.row()


class Vocabulary:
    """The examples' terms, looked up by key."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        # keys are well mixed, so their top bits spread them over buckets of about one key
        self.shift = np.uint64(64 - max(8, len(keys).bit_length()))
        edges = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.bucket = np.append(np.searchsorted(self.keys, edges), len(keys)).astype(np.int32)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the known ones in `key`, their terms)."""
        at = (key >> self.shift).astype(np.int64)
        term, end = self.bucket[at], self.bucket[at + 1]
        left, places, found = np.flatnonzero(term < end), [], []
        term, end, key = term[left], end[left], key[left]
        while len(left):
            good = self.keys[term] == key
            places.append(left[good])
            found.append(term[good])
            go = ~good & (term + 1 < end)
            left, term, end, key = left[go], term[go] + 1, end[go], key[go]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *found])

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the known terms in each text, by text and term."""
        key, row = terms(words_of(texts, LETTERS, lower=True))
        at, term = self.find(key)
        cell, count = np.unique(row[at] * max(1, len(self.keys)) + term, return_counts=True)
        return cell // max(1, len(self.keys)), cell % max(1, len(self.keys)), count


def unit_vectors(row: np.ndarray, term: np.ndarray, count: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Weight of each entry; the weights of a text have length 1."""
    weight = (1 + np.log(count)) * weights[term]
    length = np.sqrt(np.bincount(row, weight * weight, minlength=n))
    return weight / np.maximum(length[row], 1e-300)


def alike_together(example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """The examples in an order that puts like ones into the same block: split again and again
    at the middle of their main direction over the terms that most have (only speed depends on it)."""
    common = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:DIRECTIONS]
    place = np.full(n_terms, -1, np.int32)
    place[common] = np.arange(len(common))
    dense = np.zeros((n, len(common)), np.float32)
    some = place[term] >= 0
    dense[example[some], place[term[some]]] = weight[some]

    def split(members: np.ndarray) -> list[np.ndarray]:
        if len(members) <= BLOCK:
            return [members]
        own = dense[members] - dense[members].mean(axis=0)
        along = own[:, own.var(axis=0).argmax()] if len(common) else np.zeros(len(members))
        for _ in range(8):
            along = own @ (along @ own)
            along = along / max(np.linalg.norm(along), 1e-300)
        members = members[np.argsort(along, kind="stable")]
        half = max(1, round(len(members) / BLOCK / 2)) * BLOCK
        return split(members[:half]) + split(members[half:])

    return np.concatenate(split(np.arange(n)))


class BlockMaxIndex:
    """Lists and dense rows of the examples' unit vectors, with the largest weight of every block."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int) -> None:
        """Entries by example; no weight is negative. The lists are made when first used, by the executors."""
        self.n, self.n_terms, self.blocks = n, n_terms, -(-n // BLOCK)
        self.example, self.term, self.weight = example.astype(np.int32), term.astype(np.int32), weight
        self.ready = False
        self.scored = self.pairs = 0  # (text, block) pairs looked into, and all of them

    def make(self) -> None:
        if self.ready:
            return
        self.ready = True
        example, term, weight, n, n_terms = self.example, self.term, self.weight, self.n, self.n_terms
        self.first = np.searchsorted(example, np.arange(n + 1))
        self.largest = np.zeros((n_terms, self.blocks), np.float32)
        np.maximum.at(self.largest, (term, example // BLOCK), weight.astype(np.float32))
        common = np.flatnonzero(np.bincount(term, minlength=n_terms) * DENSE >= max(n, DENSE))
        self.place = np.full(n_terms, -1, np.int32)
        self.place[common] = np.arange(len(common))
        self.largest_common = self.largest[common]
        dense = self.place[term] >= 0
        self.dense = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        self.dense[example[dense] // BLOCK, self.place[term[dense]], example[dense] % BLOCK] = weight[dense]
        order = np.flatnonzero(~dense)
        order = order[np.lexsort((example[order], term[order]))]
        self.listed, self.share = self.example[order], weight[order]
        # postings of (term, block) are bounds[term * blocks + block] to the next
        size = np.bincount(term[order].astype(np.int64) * self.blocks + self.listed // BLOCK, minlength=n_terms * self.blocks)
        self.bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32 if len(order) < 2**31 else np.int64)
        # of 32-bit sums and products of positive numbers, one of each dense term at most
        self.slack = (len(common) + 16) * 2.0**-23

    def __reduce__(self) -> tuple:
        return BlockMaxIndex, (self.example, self.term, self.weight, self.n, self.n_terms)

    def add_scores(self, scores: np.ndarray, wanted: np.ndarray, dense: np.ndarray, rare: tuple) -> None:
        """Fill in the cosines of the (text, block) pairs that are wanted."""
        row, term, weight = rare
        for block in np.flatnonzero(wanted.any(axis=0)):
            texts = np.flatnonzero(wanted[:, block])
            part = dense[texts] @ self.dense[block]
            some = np.flatnonzero(wanted[row, block])
            at = term[some].astype(np.int64) * self.blocks + block
            begin, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
            full = np.flatnonzero(size)
            some, begin, size = some[full], begin[full].astype(np.int64), size[full].astype(np.int64)
            posting = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            local = np.zeros(len(wanted), np.int64)
            local[texts] = np.arange(len(texts))
            cell = np.repeat(local[row[some]] * BLOCK - block * BLOCK, size) + self.listed[posting]
            part += np.bincount(cell, np.repeat(weight[some], size) * self.share[posting], part.size).reshape(part.shape)
            scores[texts, block] = part

    def nearest_of(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray) -> list:
        """(examples, cosines) of nearest() for texts of at least one term, whose entries begin at `first`."""
        self.make()
        texts = len(first) - 1
        row = np.repeat(np.arange(texts), np.diff(first))
        dense = np.zeros((texts, self.dense.shape[1]), np.float32)
        place = self.place[term]
        dense[row[place >= 0], place[place >= 0]] = weight[place >= 0]
        rare = tuple(x[place < 0] for x in (row, term, weight))
        bound = dense @ self.largest_common
        starts = np.flatnonzero(np.r_[True, rare[0][1:] != rare[0][:-1]][: len(rare[0])])
        if len(starts):
            bound[rare[0][starts]] += np.add.reduceat(self.largest[rare[1]] * rare[2].astype(np.float32)[:, None], starts, axis=0)
        bound = bound.astype(float) * (1 + len(term) * 2.0**-23 + self.slack)
        scores = np.zeros((texts, self.blocks, BLOCK), np.float32)
        own = np.flatnonzero(skip >= 0)
        k = min(k, self.n)

        def reached(among: np.ndarray) -> np.ndarray:
            return np.partition(among, -k, axis=1)[:, -k] * (1 - 2 * self.slack)

        order = np.argsort(-bound, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(self.blocks), order.shape), axis=1)
        least, begin, size = np.zeros(texts), 0, FIRST_BLOCKS
        while begin < self.blocks:
            wanted = (place >= begin) & (place < begin + size) & (bound > 0) & (bound >= least[:, None])
            if not wanted.any():  # bounds fall: no later block reaches either
                break
            self.add_scores(scores, wanted, dense, rare)
            self.scored += int(wanted.sum())
            scores[own, skip[own] // BLOCK, skip[own] % BLOCK] = 0
            least = reached(scores.reshape(texts, -1))
            begin, size = begin + size, size * 2
        self.pairs += texts * self.blocks
        scores = scores.reshape(texts, -1)
        near_row, near = np.nonzero((scores > 0) & (scores >= least[:, None]))
        exact = self.exact(near_row, near, row, term, weight, texts)
        order = np.lexsort((near, -exact, near_row))
        near_row, near, exact = near_row[order], near[order], exact[order]
        cut = np.searchsorted(near_row, np.arange(texts + 1))
        return [(near[a : min(a + k, b)], exact[a : min(a + k, b)]) for a, b in zip(cut, cut[1:])]

    def exact(self, text: np.ndarray, example: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """64-bit cosines of (text, example) pairs in order of text, in steps of bounded size."""
        out = np.zeros(len(text))
        size = self.first[example + 1] - self.first[example]
        upto = np.concatenate([[0], np.cumsum(size)])
        most = max(1, WHOLE_CELLS // max(1, self.n_terms))
        for base in range(0, texts, most):
            low, high = np.searchsorted(row, [base, base + most])
            whole = np.zeros((min(most, texts - base), self.n_terms))
            whole[row[low:high] - base, term[low:high]] = weight[low:high]
            a, last = np.searchsorted(text, [base, base + most])
            while a < last:
                b = min(last, max(a + 1, int(np.searchsorted(upto, upto[a] + PAIR_ENTRIES, side="right")) - 1))
                own = size[a:b]
                entry = np.arange(own.sum()) + np.repeat(self.first[example[a:b]] - (upto[a:b] - upto[a]), own)
                parts = whole[np.repeat(text[a:b] - base, own), self.term[entry]] * self.weight[entry]
                out[a:b] = np.add.reduceat(parts, upto[a:b] - upto[a])
                a = b
        return out

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest examples with a positive cosine; ties by number."""
        return self.nearest_of(np.array([0, len(term)]), term, weight, k, np.array([skip]))[0]


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray  # of the terms
    index: BlockMaxIndex | None
    label: np.ndarray
    ids: np.ndarray
    curve: tuple[float, float]

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine * cosine
        return float((weight * self.label[who]).sum() / (weight.sum() + PRIOR_MASS))

    def score(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * vote + self.curve[1])))

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, skip: bool = False) -> Iterator[tuple]:
        """(text, its nearest examples, their cosines) of all texts with a term; with `skip` text i isn't near to example i."""
        texts, first = np.unique(row, return_index=True)
        first = np.append(first, len(row))
        for a in range(0, len(texts), QUERIES):
            own, at = texts[a : a + QUERIES], first[a : a + QUERIES + 1]
            part = slice(at[0], at[-1])
            found = self.index.nearest_of(at - at[0], term[part], weight[part], K, own if skip else np.full(len(own), -1))
            for text, (who, cosine) in zip(own.tolist(), found, strict=True):
                yield text, who, cosine

    def own_votes(self, numbers: np.ndarray) -> np.ndarray:
        """Votes of consecutive examples with themselves left out."""
        entries, votes = self.index, np.zeros(len(numbers))
        part = slice(*np.searchsorted(entries.example, [numbers[0], numbers[-1] + 1]))
        for i, who, cosine in self.nearest(entries.example[part], entries.term[part], entries.weight[part], skip=True):
            votes[i - numbers[0]] = self.vote(who, cosine)
        return votes

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Scores and evidence; equal texts are looked at once."""
        coded = texts.dictionary_encode(null_encoding="encode")
        score, evidence = self.scores_of_different(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        return score[at], [evidence[i] for i in at.tolist()]

    def scores_of_different(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        n = len(texts)
        vote, evidence = np.zeros(n), [[] for _ in range(n)]
        if self.index is not None:
            row, term, count = self.vocabulary.counts(texts)
            for r, who, cosine in self.nearest(row, term, unit_vectors(row, term, count, self.weights, n)):
                vote[r] = self.vote(who, cosine)
                evidence[r] = self.ids[who].tolist()
        return self.score(vote), evidence


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def logistic(vote: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a small pull of the slope to 0."""
    x = np.stack([vote, np.ones_like(vote)], axis=1)
    beta = np.array([0.0, np.log((weight @ label + 0.5) / (weight @ (1 - label) + 0.5))])
    pull = np.diag([0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (weight * (label - p)) - pull @ beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def smallest_shingles(texts: pa.Array, size: int = 3) -> np.ndarray:
    """Smallest hash of each text's word shingles; copies with few changes mostly share it."""
    words = words_of(texts, LETTERS, lower=True)
    keys, n = words.keys(), len(texts)
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(words.counts > 0)
    if len(some):
        padded = np.concatenate([keys, np.zeros(size - 1, np.uint64)])
        whole = window_starts(words.first, size)
        whole[words.first[some]] = True  # a shorter text counts by its first words and what follows them
        shingles = np.where(whole, window_keys(padded, size), np.uint64(2**64 - 1))
        short = words.counts[some] < size
        shingles[words.first[some[short]]] = keys[words.first[some[short]]]
        out[some] = np.minimum.reduceat(shingles, words.first[some])
    return out


def examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """(at most `most` (example_id, label) rows of each label that may be learned, of different
    texts; all such rows' number by label). Broadcasts at most 2 * CANDIDATES * `most` ids."""
    rows = labels.filter(~held_out() & F.col("doc_id").isNotNull())
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("example_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    rows = rows.filter("label in (0, 1)")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}

    def first(df: DataFrame, label: int, n: int) -> DataFrame:
        return df.filter(F.col("label") == label).orderBy(F.xxhash64("example_id"), "example_id").limit(n)

    candidates = first(rows, 0, CANDIDATES * most).unionByName(first(rows, 1, CANDIDATES * most))
    known = docs.join(F.broadcast(candidates), F.col("doc_id") == F.col("example_id")).select(TEXT, "example_id", "label")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for step in steps(batches, TEXT, STEP_BYTES):
            yield {"id": step.column(1), "label": step.column(2), "key": smallest_shingles(step.column(0)).view(np.int64)}

    keyed = gathered(known, "id bigint, label int, key bigint", shingles)
    one = keyed.groupBy("label", "key").agg(F.min_by("id", F.struct(F.xxhash64("id"), "id")).alias("example_id"))
    one = written(one.groupBy("example_id").agg(F.max("label").alias("label")), "examples")
    return first(one, 0, most).unionByName(first(one, 1, most)), counts


def train(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model:
    """Broadcasts at most 2 * `most` ids; the driver gets the counts of the terms of as many
    examples, and their vectors."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias(TEXT))
    picked, counts = examples(texts, labels, most)
    known = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("example_id")).select(TEXT, "example_id", "label")

    def support(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for step in steps(batches, TEXT, STEP_BYTES):
            key, _ = terms(words_of(step.column(0), LETTERS, lower=True))
            yield {"key": np.unique(key).view(np.int64)}

    found = gathered(known, "key bigint", support).distinct()
    sizes = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    base = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    empty = Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), None, *[np.zeros(0)] * 2, (0.0, float(np.log(base / (1 - base)))))
    if not sizes.get(0) or not sizes.get(1):
        return empty
    found = found.toArrow()
    if not found.num_rows:
        return empty
    chosen = np.sort(found["key"].to_numpy().view(np.uint64))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(chosen))
    size = len(chosen)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(size + 1, np.int64)
        for step in steps(batches, TEXT, STEP_BYTES):
            seen[:size] += np.bincount(vocabulary.value.counts(step.column(0))[1], minlength=size)
            seen[size] += step.num_rows
        some = np.flatnonzero(seen)
        yield {"term": some.astype(np.int32), "texts": seen[some]}

    seen = np.zeros(size + 1)
    sums = gathered(texts.select(TEXT), "term int, texts bigint", frequencies).groupBy("term").agg(F.sum("texts").alias("texts"))
    sums = sums.toArrow()
    seen[sums["term"].to_numpy()] = sums["texts"].to_numpy()
    weights = np.log((seen[size] + 1) / (seen[:size] + 1)) + 1e-9

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for step in steps(batches, TEXT, STEP_BYTES):
            row, term, count = vocabulary.value.counts(step.column(0))
            first = np.searchsorted(row, np.arange(step.num_rows + 1))
            lists = [
                pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))
                for values in (term, count)
            ]
            yield {"id": step.column(1), "label": step.column(2), "term": lists[0], "count": lists[1]}

    rows = gathered(known, "id bigint, label int, term array<int>, count array<int>", vectors).toArrow()
    rows = rows.combine_chunks().sort_by([("label", "ascending"), ("id", "ascending")])
    label, ids = rows["label"].to_numpy().astype(float), rows["id"].to_numpy()
    example = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(rows["term"]).to_numpy())
    term, count = (pc.list_flatten(rows[c]).to_numpy() for c in ("term", "count"))
    weight = unit_vectors(example, term, count, weights, len(ids))
    order = alike_together(example, term, weight, len(ids), size)
    place = np.argsort(order).astype(np.int32)[example]
    entries = np.argsort(place, kind="stable")
    label, ids, example, term, weight = label[order], ids[order], place[entries], term[entries], weight[entries]
    del rows, count, place, entries
    index = BlockMaxIndex(example, term, weight, len(ids), size)
    share = [counts[k] / max(1, (label == k).sum()) for k in (0, 1)]
    stands_for = np.where(label == 1, share[1], share[0])
    stands_for = stands_for / stands_for.min()
    model = Model(vocabulary.value, weights, index, label, ids, (0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                yield {"example": batch.column(0), "vote": shared.value.own_votes(batch.column(0).to_numpy())}

    numbers = docs.sparkSession.range(0, len(ids), 1, -(-len(ids) // BLOCK))
    found = gathered(numbers, "example bigint, vote double", own_votes).toArrow().sort_by("example")
    votes = found["vote"].to_numpy()
    shared.unpersist()
    model.curve = logistic(votes, label, stands_for)
    return model


def assess(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with its score, prediction and the ids of the nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fill(step: pa.RecordBatch) -> list:
        score, evidence = shared.value.scores(step.column(TEXT))
        return [score, (score >= CUT).astype(np.int32), pa.array(evidence, pa.list_(pa.int64()))]

    return annotate(docs, OUTPUTS, fill, keep)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = assess(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
