"""Corpus operators against brute force on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgate.llm import catalog, chat, decontaminate, exact_dedup, jaccard, language, licenses, line_dedup, mixing, sharding, token_files
from quillgate.llm.components import components
from quillgate.llm.shared import release
from quillgate.llm.words import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, key string, bucket string, size string"
SPACE = "[\x20\x09-\x0d]"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the last columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "x", "x", "x") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 6, 9, 12, 40, 90, 200]))) for _ in range(60)]
    out = []
    for i in range(260):
        words = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        text = (" " if r.random() < 0.8 else "\n").join(words)
        out.append((i, text.upper() if r.random() < 0.1 else text, r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", None])))
    out += [(300, None, "en", "a"), (301, "", None, None), (302, " \n\t ", "en", "c"), (303, "a b c d e", "en", "a"), (303, "a b c d e", "en", "a"), (None, "a b c d e", "en", "b"), (304, "é " * 3000, "fr", "b")]
    return out


def empty(spark):
    return docs(spark, [])


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_word_hashes_split_anywhere(monkeypatch):
    from quillgate.llm import words as W

    text = ("alpha  beta\tg " * 50 + "x" * 100).encode()
    data, offsets = np.frombuffer(text + b"alpha", np.uint8), np.array([0, 0, len(text), len(text) + 5, len(text) + 5])
    whole = word_hashes(data, offsets)
    monkeypatch.setattr(W, "_SEGMENT", 16)
    again = word_hashes(data, offsets)
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()
    assert whole[0][0] == whole[0][-1] and len(set(whole[0].tolist())) == 4


def test_token_files(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    hard = [(400, "Don't “stop” <|endoftext|> É… x's, 12.5!", None, None)]
    folder, manifest = token_files.write_token_files(docs(spark, rows + hard), path, 1)
    got = token_files.read_token_files(spark, folder, manifest).orderBy("start").collect()
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for i, t, *_ in rows + hard:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == start
        start += r.n_tokens
    folder, manifest = token_files.write_token_files(empty(spark), path, 1)
    assert manifest == [] and token_files.read_token_files(spark, folder, manifest).count() == 0


def test_token_files_of_a_tokenizer_that_keeps_spaces(spark):
    """Ids of words one by one would be wrong here; also rows without doc_id, of which many are alike, and clashing columns."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert not token_files.Encoder.of(path).splits and token_files.Encoder.of(public_tokenizers.path("word_bpe_49k.json")).splits
    texts = ["a  b\n c", " lead", "x" * 50_000 + " end", None] + ["same text"] * 300 + [f"other {i}" for i in range(50)]
    table = spark.createDataFrame([(None, t, b"x", 1) for t in texts], "doc_id long, text string, ids binary, tie long")
    folder, manifest = token_files.write_token_files(table, path, 1)
    got = token_files.read_token_files(spark, folder, manifest).collect()
    want = [zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) for t in texts for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [1]]]
    assert sorted(r.ids_crc32 for r in got) == sorted(want) and {r.doc_id for r in got} == {None}


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    packed = token_files.pack(ids, width)
    assert len(packed) == 16 * width and (token_files.unpack(packed, width, 1000) == ids).all()


@pytest.mark.parametrize("piece", [3, 64, language.PIECE])
def test_viterbi_is_optimal(monkeypatch, piece):
    """Unbroken best paths, however sequences are cut into pieces; against all paths, and one long walk for long sequences."""
    from itertools import product

    monkeypatch.setattr(language, "PIECE", piece)
    r = np.random.default_rng(3)
    lengths = np.array([5, 0, 1, 7, 3, 3000, 700])
    table = r.normal(size=(200, 3)).astype(np.float32) * 3
    codes = r.integers(0, 200, lengths.sum()).astype(np.int32)
    labels, at = language.best_paths(table, codes, lengths, 2.0), 0
    worth = lambda s, p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    for n in lengths:
        own = table[codes[at : at + n]].astype(float)
        if 0 < n < 8:
            best = max(worth(own, p) for p in product(range(3), repeat=int(n)))
        elif n:
            value = own[0]
            for x in own[1:]:
                value = np.maximum(value, value.max() - 2.0) + x
            best = value.max()
        if n:
            assert worth(own, labels[at : at + n].tolist()) == pytest.approx(best, abs=1e-3)
        at += n


def test_language_spans(spark):
    """Spans of a text in two languages and a script nobody learned; an unbroken text of 40,000 words; ties; repeated rows."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(table)
    one, two = "the with and that this from have they " * 6, "und der die nicht das ist mit sich auch " * 6
    n, m = len(one.split()), len(two.split())
    long = one * 400 + two * 400
    found = language.identify(docs(spark, [(1, f"{one} {two} Ωμέγα άλφα", None, None), (2, long, None, None), (2, long, None, None), (3, "", None, None), (4, None, None, None)]), model, spans=True).collect()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in found}
    assert got[1] == [("en", 0, n), ("de", n, n + m), ("und", n + m, n + m + 2)] and got[2] == [("en", 0, 400 * n), ("de", 400 * n, 400 * (n + m))]
    assert got[3] == got[4] == [] and sum(r.doc_id == 2 for r in found) == 2
    letters = lambda t: sum(c.isalpha() for c in t)
    want = max(letters(one), letters(two)) / letters(one + two)
    assert [r.score for r in found if r.doc_id == 2] == pytest.approx([want, want])
    # of languages with equal shares the first by code point is named
    even = language.Model(["b", "a"][::-1], np.ones((2, language.BUCKETS)), np.ones((2, len(language.SCRIPT_NAMES))))
    assert {(r.lang_pred, r.score) for r in language.identify(docs(spark, [(1, "x y", None, None)]), even).collect()} == {("a", 1.0)}


def test_language_features():
    """n-grams and whole words hash alike wherever a word stands, and differ between words."""
    import pyarrow as pa

    words = ["a", "ab", "übung", "ab" * 40, "漢字", "b"]
    together = [[b[lo:hi].tolist() for lo, hi in zip(e[:-1], e[1:])] for b, e in language.features(pa.array(words))]
    for i, w in enumerate(words):
        assert [x[i] for x in together] == [b.tolist() for b, _ in language.features(pa.array([w]))]
        assert [len(x[i]) for x in together] == [len(w) + 1, len(w), max(0, len(w) - 1), 1]
    assert len({x[0] for x in together[3]}) == len(words)
    codes, ends, distinct = language.text_words(pa.array(["It's  é1x", None, "12 !", "IT é", ""]))
    assert distinct.to_pylist() == ["it", "s", "é", "x"] and codes.tolist() == [0, 1, 2, 3, 0, 2] and ends.tolist() == [0, 4, 4, 4, 6, 6]


def test_language_sample_is_bounded(spark):
    """At most max_documents distinct rows are fitted, also where one row without doc_id is most of the table."""
    rows = [(None, "same words here", "en", "a")] * 400 + [(None, f"word{i}", "en", "a") for i in range(100)]
    whole, part = (language.train(docs(spark, rows), n) for n in (1000, 10))
    assert whole.langs == part.langs == ["en"] and not np.array_equal(whole.log_p, part.log_p)
    assert language.identify(docs(spark, rows), part).where("lang_pred = 'en'").count() == 500


def test_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(table)
    found = language.identify(table, model, spans=True).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in found)
    odd = docs(spark, [(1, None, None, None), (2, "12 !", None, None), (3, "Ωμέγα", None, None), (None, "the with and that", None, None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] in model.langs and got[3][1] == 0 and got[None][0] == "en"
    assert language.identify(empty(spark), model).count() == 0 and language.identify(odd, language.train(empty(spark))).where("lang_pred = 'und'").count() == 4
    assert [r.doc_id for r in language.confident(odd, model).collect()] == [None]


def test_near_duplicates(spark, rows):
    sets = []
    for i, t, *_ in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    lowest = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            lowest[root(i)] = min(lowest.get(root(i), doc), doc)
    want = sorted(((doc, len(sets[i]), lowest[root(i)] if doc is not None else None) for i, (doc, *_) in enumerate(rows)), key=repr)
    assert sorted(map(tuple, jaccard.near_duplicates(docs(spark, rows)).collect()), key=repr) == want
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_signatures_meet():
    r = np.random.default_rng(1)
    frequent = np.zeros(1 << jaccard.FREQUENT_BITS, bool)
    for trial in range(400):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        change = int(r.integers(0, len(a) // 9 + 1))
        b = np.unique(np.concatenate([a[change:], r.integers(0, 1 << 62, change).astype(np.uint64)]))
        if trial % 2:
            frequent[:] = False
            frequent[jaccard._bits(a[r.random(len(a)) < r.random()])] = True
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.signatures(a, frequent), jaccard.signatures(b, frequent)))


def test_near_duplicates_where_names_clash(spark, rows):
    """With two bits for a set's first name nearly all clash, and the second tells them apart."""
    table = docs(spark, rows)
    assert sorted(map(tuple, jaccard.near_duplicates(table, bits=2).collect()), key=repr) == sorted(map(tuple, jaccard.near_duplicates(table).collect()), key=repr)


def test_one_of_each_with_several_texts_of_a_doc_id(spark, monkeypatch):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    given = [(2, a), (9, a.replace("a39", "x")), (9, b), (9, b.replace("b39", "y")), (12, c), (12, c), (13, ""), (13, None), (None, a), (None, a)]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(given)], "doc_id long, text string, _doc long")
    for most in (300_000, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", most)
        got = [tuple(r) for r in jaccard.one_of_each(table).collect()]
        assert sorted(k for *_, k in got if k not in (2, 3)) == [0, 4, 6, 7, 8, 9] and len([k for *_, k in got if k in (2, 3)]) == 1
    assert jaccard.one_of_each(table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 700])
def test_packed_signatures(n):
    r = np.random.default_rng(n)
    sig = np.sort(r.integers(0, 1 << jaccard.SIGNATURE_BITS, n, dtype=np.uint64))
    sig[: n // 2] = sig[0]
    ids, leader = r.integers(-(2**63), 2**63 - 1, n), np.full(n, -(2**63))
    for got, want in zip(jaccard.unpack(jaccard.pack(sig, ids, leader), 2), (sig, ids, leader), strict=True):
        assert (got == want).all()


def test_stars_when_a_bucket_doubles(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 4)
    r = np.random.default_rng(3)
    parts = [(b, np.sort(r.integers(0, 6, 5).astype(np.uint64)) + np.uint64(10 * b), r.integers(-50, 50, 5)) for b in (0, 0, 0, 0, 1, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts]), pa.array([jaccard.pack(s, i) for _, s, i in parts], pa.binary())], ["bucket", "packed"])
    found, want = {}, {}
    for out in jaccard._linked_to_first([batch]):
        for sig, i, lead in zip(*(c.to_pylist() for c in out.columns)):
            assert lead < i
            found.setdefault(sig, {}).setdefault(i, lead)
    for _, sig, ids in parts:
        for s, i in zip(sig.tolist(), ids.tolist()):
            want.setdefault(s, set()).add(i)
    for s, members in want.items():
        up = found.get(s, {})
        assert set(up) == members - {min(members)}
        for i in members:
            while i in up:
                i = up[i]
            assert i == min(members)


def test_language_slices_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language, "SLICE", 3)
    monkeypatch.setattr(language, "SLICE_BYTES", 10)
    texts = ["x" * 25, None, "", "a", "b", "c" * 9, "d" * 10, "é" * 5, "e"]
    cut = [b.column("text").to_pylist() for b in language._slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))]
    assert sum(cut, []) == texts
    assert all(len(c) <= 3 and (len(c) == 1 or sum(len((t or "").encode()) for t in c) <= 10) for c in cut)
    assert not list(language._slices(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})))


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (7, 9), (3, 1), (20, 20), (None, 2)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 141)}


def test_leaks(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(30)) for k in range(8)]
    held = [(k, f"{say(100)} {items[k][1]} {say(60)}", "en", "a") for k in range(6)]
    near = items[6][1].split()
    near[3:6] = ["other", "words"]
    rows = held + [(6, f"{say(40)} {' '.join(near)} {say(9)}", "en", "a")] + [(k, say(150), "en", "a") for k in range(20, 40)] + [(50, None, None, None), (51, "", None, None)]
    bench = spark.createDataFrame([*items, (None, "x y"), (90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got == {(k, k) for k in range(7)}
    assert decontaminate.leaks(empty(spark), bench).count() == 0 and decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.clean(docs(spark, rows), bench).count() == len(rows) - 7


def test_lcs():
    assert decontaminate.lcs_length([1, 2, 3, 4], [2, 9, 4, 4]) == 2 and decontaminate.lcs_length([], [1]) == 0
    assert decontaminate.answer_of("One? Answer: forty two") == "forty two" and decontaminate.answer_of("A b. C d.") == "C d."


def test_sharding(spark, rows):
    got = sharding.shard_rows(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads = {i: 10 for i in range(4000)}
    eight, nine = sharding.walk(loads, 8, slack=0.05), sharding.walk(loads, 9, slack=0.05)
    assert max(list(eight.values()).count(s) for s in range(8)) <= 525
    assert sum(eight[i] != nine[i] for i in loads) < 0.5 * len(loads)
    assert sharding.shard_rows(empty(spark)).count() == 0


def test_mixing(spark, rows):
    got = mixing.mixed(docs(spark, rows)).collect()
    again = sorted(map(repr, mixing.mixed(docs(spark, rows).repartition(5)).collect()))
    assert sorted(map(repr, got)) == again and all(0 <= r.taken <= 3 * r.size for r in got) and len(got) == len(rows)
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    assert sum(sizes.values()) == sum(r.size for r in got)
    targets = mixing.source_targets(sizes)
    for s, n in sizes.items():
        assert targets[s] <= 3 * n
        taken = sum(r.taken for r in got if r.source_size == n and r.target == targets[s])
        assert abs(taken - targets[s]) <= 3
    assert mixing.source_targets({"a": 10, "b": 100}) == {"a": 30.0, "b": 80.0}
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    made = mixing.mixed_documents(docs(spark, rows), blocks=200).collect()
    assert sum(len(words_of(r.text)) for r in made) == sum(r.taken for r in mixing.mixed(docs(spark, rows), blocks=200).collect())


def test_apportionment_by_brute_force():
    """Seats one by one to the highest quotient, and quotas of (source, shard) that the blocks' takers keep exactly."""
    r = random.Random(6)
    for _ in range(40):
        names = ["a", "b", "c", None][: r.randint(1, 4)]
        targets, most = {s: r.random() * 100 for s in names}, {s: r.randint(0, 40) for s in names}
        seats, shards = r.randint(0, 80), r.randint(1, 5)
        want = {s: [0] * shards for s in names}
        for t in range(seats):
            open_ = [s for s in names if sum(want[s]) < most[s]]
            if open_:
                best = max(open_, key=lambda s: (targets[s] / (2 * sum(want[s]) + 1), -names.index(s)))
                want[best][t % shards] += 1
        got = mixing.apportion(targets, most, seats, shards)
        assert got == want
        for s in names:
            n = r.randint(1, 15)
            takers = mixing.block_takers(n, got[s], s, 17)
            assert [sum(x.count(k) for x in takers) for k in range(shards)] == got[s]
            assert max(map(len, takers)) - min(map(len, takers)) <= 1 and takers == mixing.block_takers(n, got[s], s, 17)


def test_mix_keeps_lines_copies_and_shards(spark):
    """Cut documents keep their white space; rows alike in all columns and rows without doc_id are spread; against the places of `mixed`."""
    text = lambda k: "\n".join(f"w{k}-{i} x\ty  z" for i in range(30))
    given = [(k, text(k), None, "a") for k in range(20)] + [(None, text(99), None, "b")] * 9 + [(50, text(50), None, "b")] * 2 + [(60, "", None, "b"), (61, None, None, None)]
    table = docs(spark, given)
    parts = mixing.mixed(table, blocks=100).collect()
    made = mixing.mixed_documents(table, blocks=100, shard_column="mix_shard").collect()
    want, shards = [], [0] * 8
    for p in parts:
        words = re.findall(r"\S+\s*", text(99 if p.doc_id is None else p.doc_id)) if p.size else []
        for x in p.pieces or []:
            for k in x.shards:
                shards[k] += x.end - x.first
        for copy in range(max((len(x.shards) for x in p.pieces or []), default=0)):
            own = [x for x in p.pieces if len(x.shards) > copy]
            want.append((p.doc_id, "".join("".join(words[x.first : x.end]) for x in own).rstrip(), own[0].shards[copy]))
    assert sorted(((r.doc_id, r.text, r.mix_shard) for r in made), key=repr) == sorted(want, key=repr)
    assert {r.sig for r in made} == {"x"} and all(r.n_chars == len(r.text) for r in made) and max(shards) - min(shards) <= 3 * max(1, sum(p.size for p in parts) // 100 + 1)
    few = mixing.COPIES
    try:
        mixing.COPIES = 2  # copies of a row made by several tasks
        assert sorted(map(repr, mixing.mixed(table, blocks=100).collect())) == sorted(map(repr, parts))
    finally:
        mixing.COPIES = few


def test_exact_dedup(spark, rows, monkeypatch):
    groups = {}
    for row, (i, t, *_) in enumerate(rows):
        groups.setdefault(re.sub(SPACE, "", t or ""), []).append((-len(t or ""), i is None, i or 0, row))
    want = []
    for text, members in groups.items():
        best = min(members)[3]
        want += [(rows[row][0], rows[best][0], len(members), row == best, hashlib.sha256(text.encode()).hexdigest()) for *_, row in members]
    for most in (exact_dedup.BROADCAST_KEYS, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", most)
        assert sorted(map(tuple, exact_dedup.deduplicate(docs(spark, rows)).collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def test_exact_dedup_without_ids(spark):
    """Where a row without doc_id is the longest of its group, it alone stays, also among equals."""
    given = [(1, "ab"), (None, "a  b"), (None, "a b"), (None, "x y"), (None, "x y"), (7, "pq"), (None, "pq"), (8, "lone"), (None, "alone")]
    got = exact_dedup.deduplicate(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=repr) == sorted(
        [(1, None, 3, False), (None, None, 3, True), (None, None, 3, False), (None, None, 2, True), (None, None, 2, False), (7, 7, 2, True), (None, 7, 2, False), (8, 8, 1, True), (None, None, 1, True)], key=repr
    )


def test_exact_dedup_keeps_one_row(spark):
    """Of rows of one doc_id, equal and unequal ones, a single row of a group stays, and it is the longest."""
    given = [(1, "a b"), (1, "ab"), (1, "a b"), (2, "ab"), (3, "q"), (3, "q"), (4, "z"), (4, "y")]
    got = exact_dedup.deduplicate(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted(
        [(1, 1, 4, True), (1, 1, 4, False), (1, 1, 4, False), (2, 1, 4, False), (3, 3, 2, True), (3, 3, 2, False), (4, 4, 1, True), (4, 4, 1, True)]
    )


@pytest.mark.parametrize("least", [0.8, 0.55, 1.0])
def test_licenses_against_all_units(spark, least):
    """Units of changed, cut and joined notices, with repeats, null ids and a clashing column, against brute force without any filter."""
    r = random.Random(9)
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(r.randint(1, 5)):
            words = r.choice(notices).split()
            for _ in range(r.choice([0, 1, 3, 8])):
                words[r.randrange(len(words))] = r.choice(["word", "the", "license", "MIT"])
            words = words[: r.randint(1, len(words))] if r.random() < 0.3 else words
            lines += [" ".join(words), ""] if r.random() < 0.5 else ["  " + " ".join(words[:6]).upper(), "\t".join(words[6:])]
        rows.append((i if i % 10 else None, "\n".join(lines), None, None))
    rows += rows[:5]
    want = []
    for doc, text, *_ in rows:
        lines = [licenses.normal_words(x) for x in text.split("\n")]
        units, lo = [("line", i, i + 1, x) for i, x in enumerate(lines) if x], 0
        for i in range(len(lines) + 1):
            if i == len(lines) or not lines[i]:
                if i - lo > 1:
                    units.append(("paragraph", lo, i, sum(lines[lo:i], [])))
                lo = i + 1
        if re.search("x +x", "".join("x" if x else " " for x in lines)):
            units.append(("document", 0, len(lines), sum(lines, [])))
        for unit, a, b, words in units:
            own, said = set(licenses.bigrams(words)), set(licenses.versions(words))
            known = [(n, t, licenses.versions(licenses.normal_words(licenses.TEMPLATES[n][i]))) for n, i, t in licenses.template_rows()]
            scores = [(-2.0 * len(own & set(t)) / (len(own) + len(t)), n) for n, t, v in known if not said or not v or said & set(v)]
            best = min((s for s in scores if s[0] <= -least), default=None)
            if best:
                want.append((doc, unit, a, b, best[1], -best[0]))
    got = licenses.scan(docs(spark, rows), least).collect()
    assert want and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_licenses(spark):
    text = "x\nReleased under the MIT licence.\n\n" + licenses.TEMPLATES["ISC"][0].replace("fee is", "fee\nis") + "\n\nend"
    got = licenses.scan(docs(spark, [(1, text, None, None), (2, None, None, None), (3, "", None, None), (4, "Released under the MIT License.", None, None), (5, "plain words of a text", None, None)])).collect()
    assert {(r.doc_id, r.unit, r.license) for r in got} == {(1, "paragraph", "ISC"), (4, "line", "MIT"), (1, "document", "ISC")}  # the whole first text is little but its notice
    a, b = (set(licenses.bigrams(licenses.normal_words(t))) for t in ("Released under the MIT License.", licenses.TEMPLATES["MIT"][0]))
    assert {r.dice for r in got if r.doc_id == 4} == {2 * len(a & b) / (len(a) + len(b))}
    assert licenses.scan(empty(spark)).count() == 0


GNU = "{what} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {name} as published by\nthe Free Software Foundation; either version {version} of the License, or\n(at your option) any later version."


def test_licenses_by_version_name_and_whole(spark):
    heads = {
        "GPL-2.0": GNU.format(what="This program", name="General Public License", version="2"), "GPL-3.0": GNU.format(what="This file", name="General Public License", version="3"),
        "LGPL-2.1": GNU.format(what="This library", name="Lesser General Public License", version="2.1"), "LGPL-3.0": GNU.format(what="Foo", name="Lesser General Public License", version="3"),
        "AGPL-3.0": GNU.format(what="This program", name="Affero General Public License", version="3").replace(";", ",").replace("software,", "software:"),
        "MIT": "// SPDX-License-Identifier: MIT", "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0", "EUPL-1.2": "Licensed under the EUPL, Version 1.2 or later", "Unlicense": "This is free and unencumbered software released into the public domain.",
    }
    rows = [(k, f"/* Some file.\n\n{t}\n\nmore words */", None, None) for k, t in enumerate(heads.values())]
    whole = [(50 + k, "Copyright (c) 2024 Some One\n\n" + t[: len(t) // 2].replace(". ", ".\n") + "\n\n" + t[len(t) // 2 :], None, None) for k, t in enumerate(licenses.WHOLE.values())]
    other = [(90, "This work is licensed under the GNU General Public License, version 1.", None, None), (91, "This work is licensed under a Creative Commons Attribution 3.0 International License.", None, None)]
    got = licenses.scan(docs(spark, rows + whole + other)).collect()
    assert {(r.doc_id, r.license) for r in got if r.doc_id < 50} == set(enumerate(heads))
    assert {(r.doc_id, r.license) for r in got if r.unit == "document" and r.doc_id >= 50} == {(50 + k, n) for k, n in enumerate(licenses.WHOLE)}
    assert not [r for r in got if r.doc_id >= 90]


@pytest.mark.parametrize("small", [True, False])
def test_line_dedup(spark, rows, small, monkeypatch):
    if not small:
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    table = [(i, f"{t}\n Common LINE\t\n\nend {(i or 0) % 7}" if t else t, a, b) for i, t, a, b in rows]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    counts = {}
    for _, t, *_ in table:
        for k in {key(x) for x in (t or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    want = []
    for i, t, *_ in table:
        lines = (t or "").split("\n")
        rest = [x for x in lines if not key(x) or counts[key(x)] < 10]
        want.append((i, "\n".join(rest), len(lines), len(lines) - len(rest)))
    assert sorted(map(tuple, line_dedup.deduplicate_lines(docs(spark, table)).collect()), key=repr) == sorted(want, key=repr)
    assert line_dedup.deduplicate_lines(empty(spark)).count() == 0


def test_line_runs_in_a_later_session(spark, tmp_path):
    """Batches into a store that is opened again by another session, against counting; joins neither move nor sort the runs."""
    from quillgate.llm.shared import Scratch

    r = random.Random(4)
    batches = [[(f"line {min(r.randrange(60), r.randrange(60))}\nalways" if r.random() < 0.9 else None,) for _ in range(40)] for _ in range(7)]
    counts: dict[str, int] = {}
    session, folder = spark, f"file:{tmp_path}/store"
    for at, batch in enumerate(batches):
        for (t,) in batch:
            for line in set((t or "").split("\n")) - {""}:
                counts[line] = counts.get(line, 0) + 1
        runs = line_dedup.LineRuns.open(session, folder) if at else line_dedup.LineRuns(session, 10, 3, folder, buckets=4)
        table = line_dedup.line_counts(session.createDataFrame(batch, "text string"))
        if at == 5:
            plan = runs.fresh(table)._jdf.queryExecution().executedPlan().toString()
            merges, scans = plan.count("SortMergeJoin"), plan.count("FileScan parquet spark_catalog")
            assert merges == scans == len(runs.runs()) and "LeftAnti" in plan and plan.count("Exchange hashpartitioning(key") <= 2
            assert plan.count("Sort [") <= 2  # the batch's own, before the joins and after its counts; none of a run
        runs.add(table)
        want = {hashlib.md5(x.encode()).digest() for x, n in counts.items() if n >= 10}
        assert {bytes(x.key) for x in runs.frequent().collect()} == want
        assert all(x["count"] == 1 for run in runs.runs() for x in runs._read(run).groupBy("key").count().collect())  # compaction sums
        runs.close()
        session = session.newSession()
    assert max(runs.levels) >= 1 and len(runs.runs()) <= 4
    with Scratch(spark) as scratch:
        line_dedup.deduplicate_lines(spark.createDataFrame([("a",)], "text string"))
    assert scratch.made


def test_events_by_brute_force(spark):
    """Random logs of messages, deltas, edits and regenerations with ties, nulls, repeated rows, long texts and clashing columns."""
    r = random.Random(12)
    log = []
    for conv in [1, 2, 3, None]:
        for _ in range(60):
            event = r.choice(["message", "delta", "delta", "edit", "regenerate", None])
            log.append((conv, r.choice([None, *range(25)]), event, r.choice([1, 2, 3, None]), r.choice(["user", "assistant", None]), r.choice([None, "", "<a&b>", "x" * r.randint(1, 9), "long " * 3000])))
    log += log[:20]
    want = {}
    for key in {(c, m) for c, _, _, m, _, _ in log}:
        own = sorted((s or 0, e or "message", t or "") for c, s, e, m, _, t in log if (c, m) == key)
        last = max((x for x in own if x[1] != "delta"), default=None)
        want[key] = "".join(t for s, e, t in own if last is None or (s, e, t) >= last)
    events = spark.createDataFrame([(*x, "k", "k") for x in log], "conv_id long, seq long, event string, message long, role string, text string, turns string, `from` string")
    got = chat.fold_events(events).collect()
    assert {(x.conv_id, x.message): x.text for x in got} == want and len(got) == len(want)
    for x in got:
        said = [(s or 0, q) for c, s, _, m, q, _ in log if (c, m) == (x.conv_id, x.message) and q is not None]
        assert x.role in ({q for s, q in said if s == max(said)[0]} or {""})


def test_chat_of_odd_conversations(spark):
    """Null turns first, repeated rows as turns of their own, null conv_id and role, a long text, extra columns with clashing names."""
    rows = [(1, None, "user", "first"), (1, 2, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "assistant", "y" * 200_000), (2, 0, "assistant", "")]
    table = spark.createDataFrame([(*x, "z", "z", 5) for x in rows], "conv_id long, turn long, role string, text string, formatted string, event string, seq int")
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(table)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "first"), ("assistant", "b"), ("assistant", "b"), ("", "")] and got[1].learned == ["b", "b"]
    assert got[None].learned == ["y" * 200_000] and got[2].learned == [""] and len(got) == 3


def test_chat(spark):
    hard = "\\### <turn> & &lt; </turn>\n ok"
    log = [(1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", "draft"), (1, 3, "delta", 2, None, " more"), (1, 4, "regenerate", 2, None, None), (1, 5, "delta", 2, None, hard), (1, 6, "delta", 2, None, "!"), (1, 7, "edit", 1, "user", "hello"), (None, None, None, None, None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, event string, message long, role string, text string")
    messages = chat.fold_events(events)
    assert {(r.conv_id, r.message, r.role, r.text) for r in messages.collect()} == {(1, 1, "user", "hello"), (1, 2, "assistant", hard + "!"), (None, None, "", "")}
    back = {r.conv_id: r for r in chat.read_back(chat.render(messages)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hello"), ("assistant", hard + "!")] and back[1].learned == [hard + "!"]
    assert chat.format_conversations(events.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    said = con.sql(catalog.oracle_sql()[name])
    ours = catalog.queries()[name](spark, d)
    columns = sorted(said.columns)
    assert columns == sorted(ours.columns)
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, said.project(", ".join(columns)).fetchall()))


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert len(stage) == 5
    near = stage["n-gram Jaccard join"](spark, table, d)
    groups = jaccard.near_duplicates(table).where("doc_id = component_id")
    assert near.columns == table.columns and near.count() == groups.count()
    clean = stage["benchmark decontamination"](spark, table, d)
    bench = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in table.collect() if not any(b in r.text for b in bench)}
    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_stage_keeps_documents_without_id(spark):
    """Against brute force over exact shingle sets: groups, repeated rows, null ids, and an extra column named like an inner one."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "x")
    given = [(4, base, "a"), (2, near, "b"), (9, "other words stand here in this text", "c"), (9, "other words stand here in this text", "d"), (None, base, "e"), (None, base, "f"), (7, None, "g"), (8, "", "h")]
    table = spark.createDataFrame(given, "doc_id long, text string, n string")

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    def linked(a, b):
        x, y = shingles(a), shingles(b)
        return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)

    kept = [r for r in given if r[0] is None or not any(o[0] is not None and o[0] < r[0] and linked(o[1], r[1]) for o in given)]
    want = sorted({(r[0], r[1]) for r in kept if r[0] is not None}, key=repr) + [(None, base)] * 2
    got = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, table, "")
    assert got.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_sharding_by_brute_force(spark):
    """Sizes, checksums and law of every row; shard sizes near equal at the shipped slack; and how much a ninth shard moves."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    eight, nine = ({r.doc_id: r for r in sharding.shard_rows(table, n).collect()} for n in (8, 9))
    assert set(eight) == set(texts)
    for i, t in texts.items():
        raw = t.encode()
        assert (eight[i].size, eight[i].text_crc32, eight[i].law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
    total, largest = sum(r.size for r in eight.values()), max(r.size for r in eight.values())
    for found, n in ((eight, 8), (nine, 9)):
        loads = [sum(r.size for r in found.values() if r.shard == s) for s in range(n)]
        assert sum(loads) == total and max(loads) <= total / n * 1.0005 + largest
    # the ring itself, with many small slots: a ninth shard takes its ninth and moves little else
    r = random.Random(3)
    loads = {i: r.randint(900, 1100) for i in range(sharding.SLOTS)}
    before, after = sharding.walk(loads, 8), sharding.walk(loads, 9)
    for walked, n in ((before, 8), (after, 9)):
        held = [0] * n
        for slot, shard in walked.items():
            held[shard] += loads[slot]
        assert max(held) <= sum(held) / n * 1.0005 + 1100 and min(held) >= sum(held) / n * 0.99
    assert sum(before[i] != after[i] for i in loads) < 0.25 * len(loads)


def test_sharding_of_odd_rows(spark):
    """Ties, repeated rows, nulls, a very long text, and columns that clash with inner names."""
    given = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (2, "é" * 300_000), (3, None)]
    table = spark.createDataFrame([(i, t, 7, "s") for i, t in given], "doc_id long, text string, size long, shard string")
    got = sharding.shard_rows(table).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(8) for k in range(sum(r.shard == s for r in got))]


def test_sharding_without_ids(spark):
    got = sharding.shard_rows(spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")).collect()
    assert len({r.shard for r in got}) == 8 and len({r.ring_slot for r in got}) > 300
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(8) for k in range(sum(r.shard == s for r in got))]


@pytest.mark.parametrize("doc", [None, 5])
@pytest.mark.parametrize("same", [True, False])
def test_sharding_balances_hot_ids(spark, monkeypatch, doc, same):
    """Hundreds of rows of one doc_id or none, with one text or many, beside others: all shards hold about as many bytes."""
    monkeypatch.setattr(sharding, "COPIES", 16)
    given = [(doc, "one text of all" if same else f"text number {i:04}") for i in range(800)] + [(1000 + i, "x" * 20) for i in range(100)]
    got = sharding.shard_rows(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    want = [(i, len(t) + 1, zlib.crc32(t.encode())) for i, t in given]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    loads = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(loads) <= sum(loads) / 8 * 1.0005 + 21 and min(loads) >= sum(loads) / 8 - 3 * 21
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(8) for k in range(sum(r.shard == s for r in got))]


@pytest.mark.parametrize("count", [2000, 4000])
def test_leaks_of_many_items(spark, count):
    """Far more items than the latent space has dimensions: every planted copy is found."""
    r = random.Random(count)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(6000)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.randint(15, 59))) for k in range(count)]
    planted = r.sample(items, 200)
    rows = [(k, f"{say(r.randint(20, 90))} {text} {say(40)}", "en", "a") for k, text in planted] + [(count + k, say(150), "en", "a") for k in range(100)]
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, _ in planted}


@pytest.mark.parametrize("length", [3, 800, 1200])
def test_leaks_of_any_length(spark, length):
    """Verbatim copies of items far shorter or longer than a window."""
    r = random.Random(length)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(6000)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(length if k < 80 else 40)) for k in range(180)]
    rows = [(k, f"{say(r.randint(20, 90))} {items[k][1]} {say(40)}", "en", "a") for k in range(80)]
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got >= {(k, k) for k in range(80)}


def test_leaks_ignore_case_and_marks(spark):
    """Upper-cased copies of accented items, and copies with marks at the edges of words."""
    item = "Été à Évian, où l'œuvre déjà née élève âmes et forêts çà et là. Réponse éclatée über straße."
    noisy = " ".join(f"«{w}»!!" for w in item.split())
    rows = [(1, f"x y z {item.upper()} a b", "fr", "a"), (2, f"x y z {noisy} a b", "fr", "a"), (3, "x y z - a b", "fr", "a"), (4, "« » !! —", "fr", "a")]
    found = decontaminate.leaks(docs(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.lcs_share) for r in found} == {(1, 7, 1.0), (2, 7, 1.0)}


def test_normal_words_keep_their_places():
    import pyarrow as pa

    texts = ["«Été» — a! b? (c)", None, "", "... !", "x\x0b«y»\tz_", "é! 5%", "don't stop-it"]
    said = [data[a:b].tobytes().decode() for _, _, data, offsets in decontaminate.normal_buffers(pa.array(texts)) for a, b in zip(offsets[:-1], offsets[1:])]
    assert said == ["été — a b c", "", "", "... !", "x\x0by\tz", "é 5", "don't stop-it"]


def test_leaks_of_copies_without_answer(spark):
    """A nearly whole copy counts though its answer is missing; a looser passage without the answer doesn't."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    question, last = say(29), say(4)
    loose = question.split()
    loose[::4] = ["other"] * len(loose[::4])
    rows = [(1, f"{say(60)} {question} {say(60)}", "en", "a"), (2, f"{say(60)} {' '.join(loose)} {say(60)}", "en", "a"), (3, f"{say(60)} {' '.join(loose)} {last} {say(60)}", "en", "a")]
    found = decontaminate.leaks(docs(spark, rows), spark.createDataFrame([(7, f"{question}. {last}")], "item_id long, text string")).collect()
    assert {r.doc_id: r.answer_share for r in found} == {1: 0.0, 3: 1.0}


def test_latent_windows_with_repeats():
    """Every window near an item is compared, also where a repeated word carries it; against one window at a time."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    vocabulary = [word() for _ in range(300)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(12))) for k in range(5)]
    items.append((5, "again again again again"))
    texts = [" ".join(r.choice([word(), word(), r.choice(vocabulary)]) for _ in range(n)) for n in (0, 1, 23, 24, 25, 48, 49, 72, 500, 0, 40000)]
    texts += [" ".join(["again"] * 3 + [word() for _ in range(45)]), f"{items[2][1]} {word()}"]
    data = "".join(texts).encode()
    words, ends = word_hashes(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    idf = np.full(decontaminate.TERMS, 2.0, np.float32)
    terms = np.unique(np.concatenate([t for _, t, _ in decontaminate._rows([t for _, t in items], idf)]))
    block = decontaminate.Items(items, idf, terms, np.eye(len(terms), dtype=np.float32), 0.6)
    seen = []
    block.checked = lambda w, i, lo, hi, score, *_: seen.append((len(w), i, lo, hi)) or (score, 1.0, 1.0, lo, hi)
    term = decontaminate._term(words)
    got = {(row, i, v[3], v[4]): v[0] for row, i, v in block.latent(words, term, ends, 0.3, 0.6, 0.5)}
    want = {}
    for row, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        for lo in range(0, max(1, int(b - a) - decontaminate.STRIDE), decontaminate.STRIDE) if b > a else []:
            t = term[a:b][lo : lo + decontaminate.WINDOW]
            x = block.rows[block.compact[t[block.used[t]]]].sum(0)
            for i, score in enumerate(block.vectors @ x / max(float(np.linalg.norm(x)), float(np.sqrt(block.square[t].sum())))):
                if score >= 0.3:
                    want[row, i, lo, min(int(b - a), lo + decontaminate.WINDOW)] = score
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    assert any(row == 11 and i == 5 for row, i, _, _ in got)


def test_confident_keeps_mixed_documents(spark):
    """Learned languages in equal parts, none with half of the letters, stay; a document mostly in none goes."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(table)
    assert len(model.langs) >= 3
    plain = {}
    for row in language.identify(table, model).where("score > 0.99").join(table.select("doc_id", "text"), "doc_id").orderBy("doc_id").collect():
        plain.setdefault(row.lang_pred, []).extend(re.findall(r"[^\W\d_]+", row.text))
    parts = [" ".join(words[:80]) for _, words in sorted(plain.items())[:3] if len(words) >= 80]
    assert len(parts) == 3
    other = " ".join(["Ωμέγα"] * 300)
    mixed = docs(spark, [(1, "\n".join(parts), None, None), (2, other, None, None), (3, parts[0], None, None), (4, f"{parts[0]} {other}", None, None)])
    found = {r.doc_id: r.score for r in language.identify(mixed, model).collect()}
    assert found[1] < 0.5 and {r.doc_id for r in language.confident(mixed, model).collect()} == {1, 3}


def test_licenses_of_very_long_lines(spark):
    """A line of more words than the SQL check looks at, against brute force over its distinct word pairs."""
    text = "Released under the MIT License. " * 25000
    pairs = [set(zip(w, w[1:])) for w in (re.findall("[a-z0-9]+", t.lower()) for t in (text, licenses.TEMPLATES["MIT"][0]))]
    got = licenses.scan(docs(spark, [(1, text, None, None)])).collect()
    assert len(text.split()) > 100_001 and [(r.doc_id, r.unit, r.license) for r in got] == [(1, "line", "MIT")]
    assert got[0].dice == pytest.approx(2 * len(pairs[0] & pairs[1]) / (len(pairs[0]) + len(pairs[1])))


def test_leaks_recall_and_precision(spark):
    """3000 items of 3 to 200 words: every verbatim copy, at least 0.9 of copies with a fifth of the words replaced, and little else."""
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(20_000)]
    say = lambda n: " ".join(vocabulary[min(int(r.paretovariate(0.6)) - 1, 19_999)] if r.random() < 0.1 else r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.choice([3, 5, 8, 15, 30, 60, 120, 200]))) for k in range(3000)]
    said = {k: t.split() for k, t in items}
    rows, verbatim, changed = [], set(), set()
    for k, text in r.sample(items, 600):
        words = list(said[k])
        if len(rows) % 2 and len(words) >= 15:
            for i in r.sample(range(len(words) - 5), len(words) // 5):
                words[i] = r.choice(vocabulary)
            changed.add((k, k))
        else:
            verbatim.add((k, k))
        rows.append((k, f"{say(r.randint(20, 90))} {' '.join(words)} {say(40)}", "en", "a"))
    rows += [(5000 + k, say(300), "en", "a") for k in range(100)]
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert verbatim <= got and len(changed & got) >= 0.9 * len(changed)
    # what else is found holds 0.6 of its item's words in order within a passage twice as long
    text = {k: t.split() for k, t, *_ in rows}
    for doc, item in got - verbatim - changed:
        own = said[item]
        assert decontaminate.lcs_length(own, text[doc]) >= 0.6 * len(own)
    assert not [d for d, i in got if d >= 5000 and len(said[i]) >= 15]


def test_leaks_of_odd_rows(spark, monkeypatch):
    """Repeated rows, null ids, equal items, a very long text and clashing columns; the same from several blocks of items."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(1, say(20)), (2, say(20)), (3, say(9))]
    items.append((4, items[0][1]))
    given = [(10, f"{say(30)} {items[0][1]}"), (10, f"{say(30)} {items[0][1]}"), (None, items[1][1]), (11, f"{say(60_000)} {items[2][1]} {say(10)}"), (12, say(50)), (12, say(50)), (None, None), (13, "")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in given], "doc_id long, text string, item_id int, cosine string")
    bench = spark.createDataFrame([(i, t, 0.0) for i, t in items], "item_id long, text string, doc_id double")
    want = sorted([(10, 1), (10, 4), (10, 1), (10, 4), (None, 2), (11, 3)], key=repr)
    for block, words in ((4000, 500_000), (2, 500_000), (4000, 1)):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
        monkeypatch.setattr(decontaminate, "ITEM_WORDS", words)
        found = decontaminate.leaks(table, bench).collect()
        assert sorted(((x.doc_id, x.item_id) for x in found), key=repr) == want and {x.lcs_share for x in found} == {1.0}
        left = decontaminate.clean(table, bench)
        assert left.columns == table.columns and sorted((x.doc_id for x in left.collect()), key=repr) == [12, 12, 13, None]


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    """Every stage on nulls, repeated rows, ties, a very long text and an extra column; then on an empty table."""
    d = "/root/testdata/sf0.001"
    kind = spark.read.parquet(f"{d}/documents.parquet").schema
    plain = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    odd = [(None, None, None, None, None), (None, plain[0][1], None, None, None), (plain[1][0], *plain[1][1:]), (900_001, "", "en", None, 0), (900_002, plain[2][1] * 40, None, "src1", 1), (900_003, "Ωμέγα " * 50, None, "src1", 1)]
    for name, rows in (("odd", plain + odd), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, kind).withColumn("root", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        table = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.columns == table.columns and (out.count() > 0) == bool(rows)
        out = corpus_pipeline.run(spark, folder)
        again = corpus_pipeline.run(spark, folder)
        assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect())) and (out.count() > 0) == bool(rows)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language ID"](spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), d).collect()}
    assert 900_001 not in kept and 900_003 not in kept and None in kept


def test_scratch_removes_what_is_not_kept(spark):
    import os

    from quillgate.llm.shared import Scratch, shared_folder, stored

    folder = os.path.dirname(shared_folder(spark, "x"))
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    left = lambda: sorted(x[:3] for x in set(os.listdir(folder)) - before)
    with Scratch(spark) as outer:
        stored(spark.range(3), "a-a")
        with Scratch(spark) as inner:
            stored(spark.range(4), "b-b")
            kept = inner.keep(spark.range(5), "c-c")
        assert left() == ["a-a", "c-c"] and kept.count() == 5
        last = outer.keep(kept, "d-d")
    assert left() == ["d-d"] and last.count() == 5


def test_release_gives_the_drivers_freed_memory_back(spark):
    """What the JVM has freed in the C library lies between blocks in use, where a collection doesn't reach it."""
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.management.ManagementFactory.getRuntimeMXBean()
    smaps = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"
    if not os.path.exists(smaps) or int(runtime.getSpecVersion()) < 17:
        pytest.skip("memory can't be read, or the JVM has no such operation")

    def anonymous():
        with open(smaps) as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024

    release(spark)
    made = [jvm.java.util.zip.Deflater() for _ in range(400)]
    for k, x in enumerate(made):
        if k % 20 != 19:
            x.end()
    for _ in range(2):
        jvm.System.gc()
    before = anonymous()
    release(spark)
    assert before - anonymous() > 20
    for x in made:
        x.end()


def test_mix_names_its_takers_once(spark):
    """The plan with the texts doesn't hold the list of what each block gives, which Spark would write out for every stage."""
    table = spark.createDataFrame([(i, " ".join(f"w{i * k % 97}" for k in range(40)), "ab"[i % 2]) for i in range(500)], "doc_id long, text string, source string")
    made = mixing.mixed_documents(table)
    assert made.count() > 400
    assert len(made._jdf.queryExecution().toString()) < 60_000
