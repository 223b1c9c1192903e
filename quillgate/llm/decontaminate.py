"""Benchmark decontamination by latent semantic retrieval.

Words are compared with case folded and the marks at their edges dropped. Terms are hashed words weighted by inverse document
frequency over all documents. A randomised SVD of the TF-IDF rows of the benchmark's passages, run as distributed passes, gives a
latent space. Every window of every document is projected into it and compared with every item by cosine. Beside these, an exact index of every
item's rarest words finds each passage of up to twice an item's length that shares enough of its words with it, whatever the number of
items or their length, so what the latent space loses isn't missed. Candidates are checked by the longest common subsequence of
words between the item and the text around the window, and by how much of the item's answer (its last sentence, or what follows
an `Answer:` mark) is there; the latter is for paraphrases, so a passage with COPY of the item's words in order goes without.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, judged, released, small_batches, stored, text_buffers
from .words import U, mix, word_hashes

TERMS = 1 << 16
WINDOW, STRIDE = 48, 24
RANK = 192
COPY = 0.8  # share of an item's words in order within a short passage from which no answer is asked for
BLOCKS = 512  # blocks of STRIDE words projected together
HITS = 1 << 18  # pairs of a word and an item looked at together
ITEM_BLOCK, ITEM_WORDS = 4000, 500_000  # items, and their words, compared in one pass over the documents; more take more passes


def _term(words: np.ndarray) -> np.ndarray:
    return (mix(words, 0x632BE59BD9B4E019) >> U(48)).astype(np.int64)


_MARKS, _INNER, _GAP = r"[\p{P}\p{S}]+", r"[\p{L}\p{M}\p{N}]", r"[\x09-\x0D\x20]"


def normal_buffers(column_):
    """text_buffers of texts with case folded and marks at the edges of words dropped, as copies may differ in both. No word is joined,
    split or emptied (one of marks only stays), so the n-th word of a text stays its n-th."""
    for row, _, data, offsets in text_buffers(column_):
        raw = data.tobytes()
        folded = [raw[a:b].decode("utf-8", "replace").casefold() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        bare = pc.replace_substring_regex(pa.array(folded, pa.large_string()), f"(^|{_GAP}){_MARKS}({_INNER})", r"\1\2")
        bare = pc.replace_substring_regex(bare, f"({_INNER}){_MARKS}({_GAP}|$)", r"\1\2")
        for first, n, data_, offsets_ in text_buffers(bare):
            yield row + first, n, data_, offsets_


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents hold each of the TERMS hashed terms, over all documents; one dense vector a task is summed."""

    def run(batches):
        counts = np.zeros(TERMS, np.int64)
        for batch in batches:
            for _, _, data, offsets in normal_buffers(batch.column("text")):
                words, ends = word_hashes(data, offsets)
                if len(words):
                    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                    key = np.unique(owner * TERMS + _term(words))
                    counts += np.bincount(key % TERMS, minlength=TERMS)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_pydict({"term": used, "n": counts[used]})

    sums = docs.select(column(docs, "text", "string").alias("text")).mapInArrow(released(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS)
    out[sums["term"].to_numpy(np.int64)] = sums["n"]
    return out


def _weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return (np.log((documents + 1) / (frequencies + 1)) + 0.05).astype(np.float32)


def _rows(texts: list[str | None], idf: np.ndarray):
    """(words of each text, their terms, sqrt of the summed squared weights)."""
    column_ = pa.array([t or "" for t in texts], pa.string())
    for _, n, data, offsets in normal_buffers(column_):
        words, ends = word_hashes(data, offsets)
        for a, b in zip(ends[:-1], ends[1:]):
            term = _term(words[a:b])
            yield words[a:b], term, float(np.sqrt((idf[term] ** 2).sum()))


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """{key: summed vector} of (key, v), summed in the tasks; as many keys as the sketch has rows, whatever the input."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, v in zip(batch.column("key").to_pylist(), batch.column("v")):
                v = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                total[key] = total[key] + v if key in total else v
        if total:
            yield _vectors(total)

    out = parts.repartition("key").mapInArrow(released(run), "key long, v array<float>").toArrow()
    return {k: v.values.to_numpy(zero_copy_only=False) for k, v in zip(out.column("key").to_pylist(), out.column("v"))}


def _vectors(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.astype(np.float32) for v in total.values()], pa.list_(pa.float32()))], ["key", "v"])


def _projected(passages: DataFrame, idf, place, sketch, gram: bool) -> dict[int, np.ndarray]:
    """One distributed pass: the rows of X^T (X Q) by term, or of (X Q)^T (X Q) by column, for TF-IDF rows X and a sketch Q."""

    def run(batches):
        weights, at, q = idf.value, place.value, sketch.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, term, norm in _rows(batch.column("text").to_pylist(), weights):
                if norm:
                    w = weights[term] / norm
                    y = w @ q[at[term]]
                    for t, v in zip(range(len(y)), y.tolist()) if gram else zip(term.tolist(), w.tolist()):
                        total[t] = total[t] + v * y if t in total else v * y
        if total:
            yield _vectors(total)

    return _summed(passages.select("text").mapInArrow(released(run), "key long, v array<float>"))


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK, power: int = 2, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(terms, basis): the terms of the passages and the right singular basis (terms x rank) of their TF-IDF rows, by randomised SVD.

    Each pass sends a sketch of (terms x (rank + 8)) to the tasks and sums X^T (X Q) over all passages there; at most TERMS rows
    are gathered, whatever the number of passages or documents.
    """
    context = passages.sparkSession.sparkContext

    def terms_of(batches):
        used = np.zeros(TERMS, bool)
        for batch in batches:
            for words, _, _ in _rows(batch.column("text").to_pylist(), idf_shared.value):
                used[_term(words)] = True
        yield pa.RecordBatch.from_pydict({"key": np.flatnonzero(used)})

    idf_shared = context.broadcast(idf)
    terms = np.sort(passages.select("text").mapInArrow(released(terms_of), "key long").distinct().toArrow().column("key").to_numpy())
    place = np.zeros(TERMS, np.int32)
    place[terms] = np.arange(len(terms))
    place_shared = context.broadcast(place)
    sketch = np.random.default_rng(seed).standard_normal((len(terms), rank + 8)).astype(np.float32)
    for _ in range(power if len(terms) else 0):
        shared = context.broadcast(sketch)
        sums = _projected(passages, idf_shared, place_shared, shared, False)
        product = np.zeros_like(sketch)
        for t, v in sums.items():
            product[place[t]] = v
        sketch = np.linalg.qr(product)[0].astype(np.float32)
        shared.unpersist()
    if not len(terms):
        return terms, np.zeros((0, 1), np.float32)
    # the singular vectors within the span found, strongest first
    shared = context.broadcast(sketch)
    rows = _projected(passages, idf_shared, place_shared, shared, True)
    gram = np.zeros((sketch.shape[1],) * 2)
    for k, v in rows.items():
        gram[k] = v
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-6]
    return terms, (sketch @ vectors[:, keep]).astype(np.float32)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence by bit-parallel rows: one big-integer step a word of b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = where.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


_ANSWER = re.compile(r"(?is).*\banswer\s*:\s*(.+)\Z")


def answer_of(text: str) -> str:
    marked = _ANSWER.match(text)
    if marked:
        return marked[1]
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return parts[-1] if parts else ""


class Items:
    """A block of benchmark items with their latent vectors, words and answers, as the tasks need them."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray, terms: np.ndarray, basis: np.ndarray, overlap: float):
        self.ids, self.words, self.answers, vectors = [], [], [], []
        self.square = (idf**2).astype(np.float64)
        self.used = np.zeros(TERMS, bool)
        self.used[terms] = True
        self.compact = np.zeros(TERMS, np.int32)
        self.compact[terms] = np.arange(len(terms))
        self.rows = basis * idf[terms][:, None]
        self.tf, self.norms, need, keys = [], [], [], []
        for item, text in rows:
            for words, term, norm in _rows([text], idf):
                if norm:
                    self.ids.append(item)
                    self.words.append(words.tolist())
                    self.answers.append(next(_rows([answer_of(text)], idf))[0].tolist())
                    vectors.append(self.rows[self.compact[term]].sum(0) / norm)
                    own, times = np.unique(term, return_counts=True)
                    self.tf.append((own, times))
                    self.norms.append(float(np.sqrt((self.square[own] * times**2).sum())))
                    # a passage with `common` of the n words in order lacks at most n - common, so it has `hits` of any n - common + hits
                    n = len(words)
                    common = min(n, max(1, math.ceil(overlap * n - 1e-9)))
                    hits = min(common, max(1, n // 6))
                    need.append(hits)
                    keys.append(np.unique(words[np.argsort(-idf[term], kind="stable")[: n - common + hits]]))
        v = np.array(vectors, np.float32).reshape(len(vectors), self.rows.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.need = np.array(need, np.int64)
        self.span = 2 * np.array([len(w) for w in self.words], np.int64)
        word = np.concatenate(keys) if keys else np.zeros(0, U)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys]).astype(np.uint16)
        order = np.argsort(word, kind="stable")
        self.keys, at = np.unique(word[order], return_index=True)
        self.starts, self.owners = np.append(at, len(word)), owner[order]
        self.keyed = np.zeros(TERMS, bool)
        self.keyed[_term(self.keys)] = True

    def passages(self, words: np.ndarray, term: np.ndarray, ends: np.ndarray):
        """Yield (row, item, place): some `need` of the item's rarest words stand within `span` words of that row, from `place` (in
        units of the item's length from the row's first word) on."""
        held = np.flatnonzero(self.keyed[term])
        if not len(held):
            return
        at = np.minimum(np.searchsorted(self.keys, words[held]), len(self.keys) - 1)
        same = self.keys[at] == words[held]
        held, at = held[same], at[same]
        if not len(held):
            return
        times = self.starts[at + 1] - self.starts[at]
        upto = np.concatenate([[0], np.cumsum(times)])
        row = np.searchsorted(ends, held, "right") - 1
        lo, reach = 0, int(self.span.max())
        while lo < len(held):  # pieces of about HITS pairs, overlapping by the longest span
            end = max(lo + 1, int(np.searchsorted(upto, upto[lo] + HITS, "right")) - 1)
            hi = int(np.searchsorted(held, held[end - 1] + reach, "right"))
            n = times[lo:hi]
            pairs = int(n.sum())
            item = self.owners[np.repeat(self.starts[at[lo:hi]] - (upto[lo:hi] - upto[lo]), n) + np.arange(pairs)]
            order = np.argsort(item, kind="stable")
            item, which = item[order].astype(np.int64), (lo + np.repeat(np.arange(hi - lo), n))[order]
            last = np.arange(pairs) + self.need[item] - 1
            ok = last < pairs
            last = np.minimum(last, pairs - 1)
            ok &= (item[last] == item) & (row[which[last]] == row[which]) & (held[which[last]] - held[which] < self.span[item])
            item, which = item[ok], which[ok]
            place = (held[which] - ends[row[which]]) // (self.span[item] // 2)
            yield from sorted(set(zip(row[which].tolist(), item.tolist(), place.tolist())))
            lo = end

    def exact(self, words: np.ndarray, term: np.ndarray, item: int, place: int, cosine: float, overlap: float, answer: float):
        """(cosine, LCS share, answer share, first word, end word) of an item in one text's words around `place`, or None."""
        own, n, size = self.words[item], len(words), len(self.words[item])
        lo, hi = max(0, (place - 2) * size), min(n, (place + 3) * size)
        near = words[lo:hi].tolist()
        if lcs_length(own, near) < overlap * size - 1e-9:
            return None
        step = max(1, size // 2)  # every passage of 2 * size words lies in one of these
        width = 2 * size + step
        share = max(lcs_length(own, near[a : a + width]) for a in range(0, max(1, len(near) - width + step), step)) / size
        if share < overlap - 1e-9:
            return None
        square = self.square[term[lo:hi]]
        terms, times = self.tf[item]
        at = np.minimum(np.searchsorted(terms, term[lo:hi]), len(terms) - 1)
        dot = np.where(terms[at] == term[lo:hi], square * times[at], 0)
        wide = min(size, hi - lo)
        rolled = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[wide:] - c[: len(x) - wide + 1]
        scores = rolled(dot) / (self.norms[item] * np.sqrt(np.maximum(rolled(square), 1e-12)))
        best = int(np.argmax(scores))
        if scores[best] < cosine:
            return None
        first, end = lo + best, lo + best + wide
        around = words[max(0, first - size) : end + size].tolist()
        said = lcs_length(self.answers[item], around) / len(self.answers[item]) if self.answers[item] else 1.0
        return (float(min(scores[best], 1.0)), share, said, first, end) if said >= answer or share >= max(COPY, overlap) - 1e-9 else None

    def search(self, words: np.ndarray, ends: np.ndarray, cosine: float, overlap: float, answer: float) -> list[tuple]:
        """(row, item, cosine, LCS share, answer share, first word, end word) of the items found in rows of words, best per row and item."""
        if not len(words) or not len(self.vectors):
            return []
        term = _term(words)
        found: dict[tuple[int, int], tuple[float, float, float, int, int]] = {}

        def better(key, new):
            if new is not None and (key not in found or (new[1], new[0]) > (found[key][1], found[key][0])):
                found[key] = new

        for row, item, new in self.latent(words, term, ends, cosine, overlap, answer):
            better((row, item), new)
        for row, item, place in self.passages(words, term, ends):
            a, b = ends[row], ends[row + 1]
            better((row, item), self.exact(words[a:b], term[a:b], item, place, cosine, overlap, answer))
        return [(row, self.ids[item], *v) for (row, item), v in sorted(found.items())]

    def latent(self, words: np.ndarray, term: np.ndarray, ends: np.ndarray, cosine: float, overlap: float, answer: float):
        """Yield (row, item, (cosine, LCS share, answer share, first word, end word)) of the windows near an item in the latent space.

        Windows are two blocks of STRIDE words, or all of a text within one block; each block is projected once, and every window compared.
        """
        blocks = -(-np.diff(ends) // STRIDE)
        before = np.concatenate([[0], np.cumsum(blocks)])
        row = np.repeat(np.arange(len(blocks)), blocks)
        starts = ends[row] + (np.arange(before[-1]) - before[row]) * STRIDE
        square = np.add.reduceat(self.square[term], starts)
        starts = np.append(starts, len(words))
        paired = np.append(row[1:] == row[:-1], False)
        for lo in range(0, len(row), BLOCKS):
            hi = min(len(row), lo + BLOCKS)
            end = min(len(row), hi + 1)  # the last window's second block
            first = int(starts[lo])
            mine = np.flatnonzero(self.used[term[first : starts[end]]])
            bound = np.searchsorted(mine, starts[lo : end + 1] - first)
            some = np.flatnonzero(np.diff(bound))
            if not len(some):
                continue
            projected = np.zeros((end - lo, self.rows.shape[1]), np.float32)
            projected[some] = np.add.reduceat(self.rows[self.compact[term[first + mine]]], bound[:-1][some], axis=0)
            pair = paired[lo:hi]
            x, whole = projected[: hi - lo].copy(), square[lo:hi].copy()
            second = np.flatnonzero(pair)
            x[second] += projected[second + 1]
            whole[second] += square[lo + second + 1]
            size = np.linalg.norm(x, axis=1)
            alone = pair | (blocks[row[lo:hi]] == 1)  # the last block of several stands in the window before it
            live = np.flatnonzero((size > 0) & alone)
            scores = x[live] @ self.vectors.T / np.maximum(size[live], np.sqrt(whole[live]))[:, None]
            for k, i in np.argwhere(scores >= cosine).tolist():
                at = lo + int(live[k])
                a, b = int(ends[row[at]]), int(ends[row[at] + 1])
                first_word = int(starts[at]) - a
                new = self.checked(words[a:b], i, first_word, min(b - a, first_word + WINDOW), float(scores[k, i]), overlap, answer)
                if new:
                    yield int(row[at]), i, new

    def checked(self, words: np.ndarray, i: int, lo: int, hi: int, score: float, overlap: float, answer: float):
        """(cosine, LCS share, answer share, first word, end word) of item i around a window of one text's words, or None."""
        item = self.words[i]
        near = words[max(0, lo - len(item)) : hi + len(item)].tolist()
        share = lcs_length(item, near) / len(item)
        if share < overlap:
            return None
        said = lcs_length(self.answers[i], near) / len(self.answers[i]) if self.answers[i] else 1.0
        return (min(score, 1.0), share, said, lo, hi) if said >= answer else None


SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long, end_word long"


def _item_blocks(docs: DataFrame, benchmark: DataFrame, rank: int, overlap: float):
    documents = docs.count()
    idf = _weights(document_frequencies(docs), documents)
    items = benchmark.select(column(benchmark, "item_id", "bigint").alias("item_id"), column(benchmark, "text", "string").alias("text")).where("item_id is not null and text is not null")
    terms, basis = latent_space(items, idf, rank)
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        words = len(r["text"].split())
        if block and (len(block) == ITEM_BLOCK or size + words > ITEM_WORDS):
            yield Items(block, idf, terms, basis, overlap)
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += words
    if block:
        yield Items(block, idf, terms, basis, overlap)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, overlap: float = 0.6, answer: float = 0.5, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, first_word, end_word): benchmark items found in documents, the best
    window of each pair.

    Null or wordless texts and items, and rows with a null item_id, match nothing; a null doc_id stays null. Repeated rows
    repeat their results. Empty tables give an empty result. Items go through in blocks of ITEM_BLOCK items or ITEM_WORDS words, each a pass over
    all documents, so a larger benchmark takes more passes, not more memory. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    out = None
    for items in _item_blocks(docs, benchmark, rank, overlap):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = []
                for row, _, data, offsets in normal_buffers(batch.column("text")):
                    words, ends = word_hashes(data, offsets)
                    found += [(ids[row + i], *x) for i, *x in shared.value.search(words, ends, cosine, overlap, answer)]
                if found:
                    columns = list(zip(*found))
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        part = rows.mapInArrow(released(run), SCHEMA)
        out = part if out is None else stored(out, "leaks").unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, overlap: float = 0.6, answer: float = 0.5, rank: int = RANK) -> DataFrame:
    """The rows of docs, columns unchanged, in which no benchmark item is found; what matches nothing for `leaks` stays, each repeated row is
    judged for itself, and an empty table stays empty.

    Only texts go to the Python workers, and only a flag comes back. After each block of items but the last, what is left is stored.
    """
    small_batches(docs.sparkSession)
    out, last = docs, None
    for items in _item_blocks(docs, benchmark, rank, overlap):
        if last is not None:
            out = stored(out.where(last), "clean")
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(texts, shared=shared):
            for whole in texts:
                keep = np.ones(len(whole), bool)
                for row, _, data, offsets in normal_buffers(whole):
                    words, ends = word_hashes(data, offsets)
                    for i, *_ in shared.value.search(words, ends, cosine, overlap, answer):
                        keep[row + i] = False
                yield pa.array(keep)

        last = judged(run)(column(docs, "text", "string"))
    return out if last is None else out.where(last)
