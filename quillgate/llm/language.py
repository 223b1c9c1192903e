"""Language identification: script ranges, then Viterbi over per-word scores with a switching penalty.

A word (a run of letters, lower-cased) is scored for each language by naive Bayes over hashed character n-grams and the word itself;
languages never seen with the word's script are out. A Viterbi path over all words of a text, in which each change of language
costs `penalty` nats, labels spans of mixed-language text; a document's language is the one whose spans hold most letters.

Only the distinct words of a slice of texts are scored, as arrays of code points, and a text is from then on a row of 32-bit codes. Sequences
are decoded together, step by step; one longer than PIECE words is decoded by pieces that are joined exactly (`best_paths`).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, judged, released, small_batches
from .words import U, mix

BUCKETS = 1 << 14
PIECE = 512  # words decoded in one go; longer sequences are joined from pieces without loss
TOGETHER = 400_000  # words whose way back is kept at once
GRAMS = 1_000_000  # n-grams looked up at once
SLICE = 1200  # documents decoded together, and the bytes of their texts
SLICE_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15

# First code points of script ranges and the script that begins there.
SCRIPTS = [
    (0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"), (0x980, "Bengali"),
    (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"),
    (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
_KINDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of all words in order, offsets of each text's words, the distinct words); a null text has none."""
    bare = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), r"\PL+", " ")
    lists = pc.split_pattern(pc.utf8_trim(bare, " "), " ")
    flat = pc.list_flatten(lists)
    real = np.asarray(pc.binary_length(flat)) > 0  # a text without letters splits into one empty string
    counts = np.asarray(pc.list_value_length(lists), np.int64)
    before = np.concatenate([[0], np.cumsum(real)])
    encoded = flat.filter(pa.array(real)).dictionary_encode()
    codes = np.asarray(encoded.indices, np.int32) if len(encoded) else np.zeros(0, np.int32)
    return codes, before[np.concatenate([[0], np.cumsum(counts)])], encoded.dictionary


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the words between marks < and >, offsets of the words)."""
    mark = lambda c: pa.scalar(c, pa.large_string())
    marked = pc.binary_join_element_wise(mark("<"), words.cast(pa.large_string()), mark(">"), mark(""))
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(marked), np.int64))])
    return np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def features(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets of each word's buckets): first for the n-grams of each of the orders 2, 3 and 4 of the marked words, then for
    the words as wholes."""
    points, offsets = _points(words)
    lengths = np.diff(offsets)
    place = np.arange(len(points)) - np.repeat(offsets[:-1], lengths)
    left = np.repeat(lengths, lengths) - place
    wide = points.astype(U)
    for order in (2, 3, 4):
        n = max(0, len(wide) - order + 1)
        rolled = wide[:n].copy()
        for j in range(1, order):
            rolled = rolled * U(_BASE) + wide[j : n + j]
        inside = left[:n] >= order
        yield (mix(rolled[inside], order) >> U(50)).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(lengths - order + 1, 0))])
    power = np.full(int(lengths.max(initial=1)), _BASE, U)
    power[0] = 1
    power = np.cumprod(power, dtype=U)
    whole = np.add.reduceat(wide * power[place], offsets[:-1]) if len(lengths) else np.zeros(0, U)
    yield (mix(whole, 1) >> U(50)).astype(np.int64), np.arange(len(lengths) + 1)


def scripts_of(words: pa.Array) -> np.ndarray:
    """The script of each word's first letter, as a place in SCRIPT_NAMES."""
    first = "".join(pc.utf8_slice_codeunits(words, 0, 1).to_pylist())
    return _KINDS[np.searchsorted(_STARTS, np.frombuffer(first.encode("utf-32-le", "surrogatepass"), np.uint32), "right") - 1]


class Model:
    """Learned languages, log-probabilities (buckets x languages) and, by script, which languages use it."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.log_p = np.log((counts + 0.05) / (total + 0.05 * BUCKETS)).astype(np.float32).T.copy() if langs else np.zeros((BUCKETS, 0), np.float32)
        self.uses = scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= 0.001
        self.fallback = int(np.argmax(scripts.sum(1))) if langs else -1

    def scores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each word by language, whether some language uses its script)."""
        k = len(self.langs)
        out, known = np.zeros((len(words), k), np.float32), np.zeros(len(words), bool)
        step = max(1, GRAMS // (32 * max(k, 4)))
        for lo in range(0, len(words), step):
            part = words.slice(lo, step)
            total, grams = np.zeros((len(part), k)), np.zeros(len(part))
            for buckets, ends in features(part):
                summed = np.concatenate([np.zeros((1, k)), np.cumsum(self.log_p[buckets], 0, np.float64)])
                total += summed[ends[1:]] - summed[ends[:-1]]
                grams += np.diff(ends)
            uses = self.uses[:, scripts_of(part)].T
            known[lo : lo + step] = uses.any(1)
            # n-grams of a word overlap, so their evidence isn't added in full
            out[lo : lo + step] = np.where(uses | ~uses.any(1, keepdims=True), total / np.sqrt(grams)[:, None], -1e4)
        return out, known


def train(docs: DataFrame, max_documents: int = 6000) -> Model:
    """Fit on a seeded sample of at most `max_documents` distinct rows of docs(doc_id, text, lang, ...) with non-null lang and text whose
    crc32(doc_id) mod 5 is not 0, or has no doc_id. Rows of equal doc_id, text and lang count once. Feature counts are summed by Spark and
    at most (languages x (buckets + scripts)) sums reach the driver. Only text and lang are features or labels. An empty table, or
    one without labels, gives a model without languages. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"), column(docs, "lang", "string").alias("lang"))
    rows = rows.where("text is not null and lang is not null and coalesce(crc32(cast(doc_id as string)) % 5, 1) <> 0")
    rows = rows.withColumn("at", F.xxhash64("doc_id", "text", "lang", F.lit("languages")))
    share = min(1.0, 1.2 * max_documents / max(1, rows.count()))
    rows = rows.where(F.pmod("at", F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    last = rows.select("at").distinct().orderBy("at").limit(max_documents).agg(F.max("at").alias("at")).first()["at"]
    sample = rows.where(F.col("at") <= F.lit(last).cast("bigint")).dropDuplicates(["at"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in _slices(whole):
                for lang in batch.column("lang").unique().to_pylist():
                    codes, _, words = text_words(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))
                    if not len(words):
                        continue
                    times = np.bincount(codes, minlength=len(words))
                    total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                    total[BUCKETS:] += np.bincount(scripts_of(words), times, len(SCRIPT_NAMES))
                    for buckets, ends in features(words):
                        total[:BUCKETS] += np.bincount(buckets, np.repeat(times, np.diff(ends)), BUCKETS)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "f": used, "n": total[used].astype(np.int64)})

    sums = sample.select("text", "lang").mapInArrow(released(count), "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sums.column("lang").unique().to_pylist())
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    if langs:
        counts[np.asarray(pc.index_in(sums.column("lang"), pa.array(langs))), sums.column("f").to_numpy()] = sums.column("n").to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


def _forward(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bias: np.ndarray, penalty: float, keep: bool):
    """Values of all last labels of sequences (longest first) of rows of `table`, and, if asked for, the choices made at each step.

    Values stand relative to the best of a step, whose sum is kept apart in full precision, so no length wears them down.
    """
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # sequences longer than t
    final, gained, back = np.zeros(bias.shape), np.zeros(len(lengths)), []
    value = table[codes[starts]] + bias
    for t in range(1, len(live)):
        n = int(live[t])
        if n < len(value):
            final[n : len(value)] = value[n:] + gained[n : len(value), None]
            value = value[:n]
        top = value.argmax(1)
        best = value[np.arange(n), top]
        value = value - best[:, None]
        if keep:
            back.append((top.astype(np.int16), value >= -penalty))
        gained[:n] += best
        value = np.maximum(value, -penalty) + table[codes[starts[:n] + t]]
    final[: len(value)] = value + gained[: len(value), None]
    return final, back


def best_paths(table: np.ndarray, codes: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of concatenated sequences of the given lengths, whose scores are rows of `table`: the best path of each, whatever its length.

    A sequence of more than PIECE words is cut. For each piece but the first, the best values from each label before it to each of its
    last labels are found; walking along the pieces then says with which labels the whole's best path enters and leaves each, and only
    then are the ways within the pieces found, so pieces don't show in the result.
    """
    k = table.shape[1]
    labels = np.zeros(len(codes), np.int16)
    pieces = np.maximum(1, -(-lengths // PIECE)) * (lengths > 0)
    first = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(first[-1]) - first[owner]
    begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    starts = begin[owner] + nth * PIECE
    sizes = np.minimum(PIECE, begin[owner + 1] - starts)
    enter, leave = np.full(len(owner), -1), np.full(len(owner), -1)  # label before a piece, and its last (-1: free)
    switch = -penalty * (1 - np.eye(k))
    cut = np.flatnonzero(pieces[owner] > 1)
    if len(cut):
        cut = cut[np.argsort(-sizes[cut], kind="stable")]
        free = np.repeat((nth[cut] == 0)[:, None, None], k, 1)
        bias = np.where(free, 0.0, switch[None]).reshape(-1, k)
        across = np.empty((len(owner), k, k))
        across[cut] = _forward(table, codes, np.repeat(starts[cut], k), np.repeat(sizes[cut], k), bias, penalty, False)[0].reshape(len(cut), k, k)
    for i in np.flatnonzero(pieces > 1):
        mine = range(first[i], first[i + 1])
        value, choices = across[mine[0]][0], []
        for step in across[mine[1] : mine[-1] + 1]:
            through = value[:, None] + step
            choices.append(through.argmax(0))
            value = through.max(0) - through.max()
        leave[mine[-1]] = value.argmax()
        for at in range(len(mine) - 1, 0, -1):
            enter[mine[at]] = leave[mine[at - 1]] = choices[at - 1][leave[mine[at]]]
    order = np.argsort(-sizes, kind="stable")
    upto = np.concatenate([[0], np.cumsum(sizes[order])])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + TOGETHER, "right")) - 1)
        part = order[lo:hi]
        bias = np.where(enter[part, None] >= 0, switch[enter[part]], 0.0)
        final, back = _forward(table, codes, starts[part], sizes[part], bias, penalty, True)
        state = np.where(leave[part] >= 0, leave[part], final.argmax(1)).astype(np.int16)
        for t in range(int(sizes[part[0]]) - 1, 0, -1):
            top, stay = back[t - 1]
            n = len(top)
            labels[starts[part[:n]] + t] = state[:n]
            state[:n] = np.where(stay[np.arange(n), state[:n]], state[:n], top)
        labels[starts[part]] = state
        lo = hi
    return labels


def _slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to SLICE rows and SLICE_BYTES of text; a single longer text is a slice of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0), np.int64))
    lo = 0
    while lo < len(ends):
        room = SLICE_BYTES + (int(ends[lo - 1]) if lo else 0)
        hi = min(max(lo + 1, int(np.searchsorted(ends, room, "right"))), lo + SLICE)
        yield whole.slice(lo, hi - lo)
        lo = hi


def _decode(model: Model, texts: pa.Array, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each word, -1 in a script that no language uses; offsets of each text's words; letters of each word)."""
    codes, ends, words = text_words(texts)
    if not len(model.langs) or not len(codes):
        return np.full(len(codes), -1, np.int16), ends, np.ones(len(codes), np.int64)
    table, known = model.scores(words)
    labels = best_paths(table, codes, np.diff(ends), penalty)
    labels[~known[codes]] = -1
    return labels, ends, np.asarray(pc.utf8_length(words), np.int64)[codes]


def _letters(labels: np.ndarray, ends: np.ndarray, letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters by text and language, letters by text)."""
    n, owner = len(ends) - 1, np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    said = labels >= 0
    return np.bincount(owner[said] * max(k, 1) + labels[said], letters[said], n * max(k, 1)).reshape(n, max(k, 1)), np.bincount(owner, letters, n)


_SPAN = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())])


def _spans(labels: np.ndarray, ends: np.ndarray, names: pa.Array) -> pa.Array:
    """Runs of words of equal label by text, as (language, first word, end word); names has `und` at its end, for -1."""
    starts = np.zeros(len(labels) + 1, bool)
    starts[1:-1] = labels[1:] != labels[:-1]
    starts[ends[:-1]] = starts[ends[1:]] = True
    first = np.flatnonzero(starts[:-1])
    end = np.append(first[1:], len(labels))
    base = ends[np.searchsorted(ends, first, "right") - 1]
    own = pa.StructArray.from_arrays([names.take(pa.array(labels[first] % len(names))), pa.array(first - base, pa.int64()), pa.array(end - base, pa.int64())], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends), pa.int32()), own)


def identify(docs: DataFrame, model: Model, penalty: float = 6.0, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) per row of docs(doc_id, text, ...); lang_pred and score come from the text alone.

    score is the share of the text's letters within spans of lang_pred. Null text, or one without a letter: `und` and 0.
    Letters, but in scripts that no learned language uses: the most frequent language, and 0. With no learned language all
    is `und`. Equal shares go to the language first by code point. spans are (lang, first word, end word), in order; `und` where
    no learned language uses the script. Texts of any length are labelled by one unbroken path. Repeated rows give repeated results; an
    empty table an empty result; a null doc_id stays null; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers, whatever the input

    def run(batches):
        model = shared.value
        k = len(model.langs)
        names = pa.array([*model.langs, "und"], pa.string())
        for whole in batches:
            for batch in _slices(whole):
                labels, ends, letters = _decode(model, batch.column("text"), penalty)
                weight, total = _letters(labels, ends, letters, k)
                best, some = weight.argmax(1), weight.any(1)
                lang = np.where((total > 0) & (k > 0), np.where(some, best, model.fallback), k)
                score = np.where(some, weight[np.arange(len(best)), best] / np.maximum(total, 1), 0.0)
                out = [batch.column("doc_id"), names.take(pa.array(lang)), pa.array(score, pa.float64())]
                if spans:
                    out.append(_spans(labels, ends, names))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "spans"][: len(out)])

    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, lang_pred string, score double" + ", spans array<struct<lang: string, first: long, end: long>>" * spans)


def confident(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = 6.0) -> DataFrame:
    """The rows of docs, columns unchanged, that are in learned languages, one or several, by at least the share `least` of their letters.

    Null texts and those without a letter go; repeated rows and null doc_ids are judged like others; an empty table stays empty. Only
    texts go to the Python workers, and only a flag comes back.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        k = len(model.langs)
        for whole in texts:
            keep = []
            for batch in _slices(pa.RecordBatch.from_arrays([whole], ["text"])):
                weight, total = _letters(*_decode(model, batch.column("text"), penalty), k)
                keep.append((total > 0) & (k > 0) & (weight.sum(1) >= least * total))
            yield pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))

    return docs.where(judged(run)(column(docs, "text", "string")))
