"""Spelling variants: words one edit apart, found by automata over the halves of all words.

If one edit leads from a word to another, it touches one half of the word; the other half stands in the other word unchanged, the left one at its beginning,
the right one at its end. So shards of an Aho-Corasick automaton hold both halves of every word, and every word runs through the automata that
may hold a half of it. A hit counts if the half stands where it must and the lengths differ by at most one; then the distance is
verified. A half's shard is a hash of the half, so a word needs no more than the shards of its own possible halves (six at most); shards that come out large, as many
words share a half, are cut into parts by word, each of which sees all words sent to the shard.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, column, released, small_batches, stored

PIECE = 1 << 20
HELD = 200_000
SHARD = 5000
FEW = 24
_RUN = "[a-zÀ-ÿ]+"


def _runs(text: bytes, find) -> Counter:
    """The runs of a text with their counts, A-Z lowered (bytes.lower lowers these alone), a piece at a time: a piece ends between two runs."""
    out: Counter = Counter()
    whole = text.lower().decode("utf-8", "replace")
    if len(whole) <= PIECE:
        out.update(find(whole))
        return out
    gap, at = re.compile("[^a-zÀ-ÿ]"), 0
    while at < len(whole):
        end = gap.search(whole, min(at + PIECE, len(whole)))
        to = end.end() if end else len(whole)
        out.update(find(whole[at:to]))
        at = to
    return out


def spoiled(word: str, before: int, every: int) -> str:
    """The word, without one of its code points if `every` divides its crc32, taken on from `before`."""
    h = zlib.crc32(word.encode(), before)
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def counted(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of docs(doc_id, text): the runs of letters of all texts, each spoiled if `every`
    divides the crc32 of "doc_id:run" (0: none), of at least `least_length` code points and found at least `least_count` times. A null doc_id counts as an empty text.

    A task counts in a table that it sends on whenever it holds HELD words, so frequent words cross the shuffle a few times a task.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(column(docs, "doc_id", "string"), F.lit("")).alias("doc"), column(docs, "text", "string").alias("text")).where("text <> ''")

    def run(batches):
        find = re.compile(_RUN).findall
        total: Counter = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                before = zlib.crc32(f"{doc}:".encode())
                for word, n in _runs(text, find).items():
                    word = spoiled(word, before, every) if every else word
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) >= HELD:
                    yield sent()
        yield sent()

    return rows.mapInArrow(released(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def possible_halves(word: str) -> list[str]:
    """What may stand in this word as a half of a word one edit away: beginnings and ends, by the lengths that word can have."""
    n = len(word)
    out = [word[: k // 2] for k in (n - 1, n, n + 1)] + [word[n - (k - k // 2) :] for k in (n - 1, n, n + 1)]
    return list(dict.fromkeys(out))


class _Bucket:
    """Words of one length that share one half; those one edit away from a word that holds the half, too, differ from it in the rest alone.

    A few words are compared one by one. More are found by their rests with a place left out, so that words that share a half cost no
    comparison of all with all; what is found is verified all the same.
    """

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.rests: dict | None = None

    def near(self, word: str, rest: str, cut) -> list[tuple[str, int]]:
        if len(self.words) <= FEW:
            return [(w, n) for w, n in self.words if one_edit(w, word)]
        if self.rests is None:
            self.rests = {}
            for w in self.words:
                r = cut(w[0])
                self.rests.setdefault(r, []).append(w)
                for i in range(len(r)):
                    self.rests.setdefault((i, r[:i] + r[i + 1 :]), []).append(w)
        mine = len(self.words[0][0])
        if mine == len(word):
            found = [self.rests.get((i, rest[:i] + rest[i + 1 :]), ()) for i in range(len(rest))]
        elif mine < len(word):
            found = [self.rests.get(rest[:i] + rest[i + 1 :], ()) for i in range(len(rest))]
        else:
            found = [self.rests.get((i, rest), ()) for i in range(len(rest) + 1)]
        return [(w, n) for w, n in dict.fromkeys(p for some in found for p in some) if one_edit(w, word)]


class Shard:
    """An automaton over the halves of words, and per half the words it is a half of, by side and length."""

    def __init__(self):
        self.buckets: dict[str, dict[tuple[bool, int], _Bucket]] = {}
        self.automaton = None

    def add(self, word: str, n: int, left: bool) -> None:
        half = halves(word)[0 if left else 1]
        self.buckets.setdefault(half, {}).setdefault((left, len(word)), _Bucket()).words.append((word, n))

    def near(self, word: str) -> list[tuple[str, int]]:
        """Words one edit away that this shard holds a half of. A pair with both halves in place is left to the left half."""
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for half in self.buckets:
                self.automaton.add_word(half, half)
            if self.buckets:
                self.automaton.make_automaton()
        out: list[tuple[str, int]] = []
        size = len(word)
        for end, half in self.automaton.iter(word) if self.buckets else ():
            first, last = end + 1 == len(half), end + 1 == size
            if not (first or last):
                continue
            for (left, length), bucket in self.buckets[half].items():
                if abs(length - size) > 1 or not (first if left else last):
                    continue
                if left:
                    out += bucket.near(word, word[len(half) :], lambda w, k=len(half): w[k:])
                else:
                    some = bucket.near(word, word[: size - len(half)], lambda w, k=len(half): w[: len(w) - k])
                    out += [(w, n) for w, n in some if not word.startswith(halves(w)[0])]
        return out


def _best(found: list[tuple[str, int]]) -> tuple[int | None, str | None]:
    return min(((-n, w) for w, n in found), default=(None, None))


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, near_n, near) of words(word, n), each word once and of two code points or more: how many words are one edit away, and of these the one of largest n (among
    equals the first in code-point order), null where there is none."""
    words = stored(words.select("word", "n"), "words")
    shards = max(1, -(-2 * words.count() // shard))
    schema = "shard int, part int, held boolean, side boolean, word string, n bigint"

    def of(half: str) -> int:
        return zlib.crc32(half.encode(), 0x5EED) % shards

    def sent(batches):
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for left, half in zip((True, False), halves(word)):
                    out.append((of(half), zlib.crc32(word.encode(), 0x9A27) & 0x7FFFFFFF, True, left, word, n))
                for s in dict.fromkeys(map(of, possible_halves(word))):
                    out.append((s, -1, False, None, word, n))
            yield pa.RecordBatch.from_pylist([dict(zip(["shard", "part", "held", "side", "word", "n"], r)) for r in out], ARROW)

    def found(batches):
        now, held = None, None
        for batch in batches:
            out = []
            for at, part, is_held, left, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (at, part) != now:
                    now, held = (at, part), Shard()
                if is_held:
                    held.add(word, n, left)
                else:
                    some = held.near(word)
                    out.append((word, n, len(some), *_best(some)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "n_near", "low", "near"])

    rows = stored(words.mapInArrow(released(sent), schema), "halves")
    parts = rows.where("held").groupBy("shard").agg(F.ceil(F.count("*") / F.lit(2.0 * shard)).cast("int").alias("parts"))
    rows = rows.join(parts, "shard").select("shard", F.when(F.col("held"), F.array(F.pmod("part", "parts"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "held", "side", "word", "n")
    rows = rows.withColumn("part", F.explode("part")).repartition("shard", "part").sortWithinPartitions("shard", "part", F.desc("held"))
    near = rows.mapInArrow(released(found), "word string, n bigint, n_near bigint, low bigint, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct("low", "near"))).alias("best")
    near = near.unionByName(words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("string").alias("near")))
    return near.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", (-F.col("best.low")).alias("near_n"), F.col("best.near").alias("near"))


ARROW = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("held", pa.bool_()), ("side", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form) for words that have a form: the end of the chain of forms. Each round doubles the steps made, so a chain, along
    which counts double, takes a handful of rounds."""
    known = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(known.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        known = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return known


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, times: int = 2, every: int = 97, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of docs(doc_id, text, ...) that `counted` gives.

    form is the word's near word of largest n, if that is at least `times` (2 or more) the word's own; root is where forms lead to in the end, the
    word itself if it has none. Null and empty texts have no words; repeated rows count again; an empty table gives an empty result; other columns are ignored.
    """
    if least_length < 2:
        raise ValueError("words of one code point have no two halves")
    if times < 2:
        raise ValueError("times must be 2 or more, or forms could lead back to where they began")
    with Scratch(docs.sparkSession) as scratch:
        near = near_words(counted(docs, least_length, least_count, every), shard)
        ruled = F.col("near_n") >= F.lit(times) * F.col("n")
        near = stored(near.select("word", "n", "n_near", F.when(ruled, F.col("near")).alias("form"), F.when(ruled, F.col("near_n")).alias("form_n")), "near")
        out = near.join(roots(near), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scratch.keep(out, "variants")
