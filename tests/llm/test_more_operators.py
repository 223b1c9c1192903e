"""Whitening, spelling variants and URL filters against brute force, on odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgate.llm import catalog, spelling, url_filter, whitening

VECTORS = "vec_id long, embedding array<float>, label int, key string, vector string, n string"


def exact_whitening(rows, components):
    """Covariance in fractions, LAPACK's eigenvectors."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(kept), len(kept[0][1])
    sums = [sum(x[d] for _, x in kept) for d in range(dims)]
    moved = [[Fraction(n * x[d] - sums[d], n) for d in range(dims)] for _, x in kept]
    cov = np.array([[float(sum(m[a] * m[b] for m in moved) / n) for b in range(dims)] for a in range(dims)])
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    white = (np.array([[float(v) for v in m] for m in moved]) @ vecs[:, order]) / np.sqrt(values[order])
    deviation = [sum((n * x[d] - sums[d]) ** 2 for d in range(dims)) for _, x in kept]
    return [i for i, _ in kept], deviation, white, values[order] / np.trace(cov)


def test_whitening(spark):
    r = np.random.default_rng(3)
    spread = r.normal(size=(12, 12)) * np.linspace(1, 3, 12)
    vectors = (r.normal(size=(400, 12)) @ spread).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7]), (None, vectors[9]), (900, None), (901, [None] + vectors[0][1:]), (902, [float("nan")] + vectors[0][1:]), (903, [float("-inf")] + vectors[0][1:])]
    df = spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], VECTORS).repartition(7)
    got = whitening.whiten(df).collect()
    ids, deviation, white, share = exact_whitening(rows, 8)
    assert len(got) == 8 * len(ids)
    by_id = {}
    for row in got:
        assert row.n == len(ids) and row.identity_error < 1e-9 and abs(row.explained - share[row.component - 1]) < 1e-12
        by_id.setdefault(row.vec_id, {}).setdefault(row.component, []).append((row.whitened, int(row.deviation)))
    first = [i for i in ids if i is not None and i != 7]
    for c in range(8):
        mine = np.array([by_id[i][c + 1][0][0] for i in first])
        theirs = white[[ids.index(i) for i in first], c]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-9
    assert all(by_id[i][1][0][1] == d for i, d in zip(ids, deviation))
    assert len(by_id[7][1]) == 2 and by_id[None][3][0] == by_id[9][3][0]


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], VECTORS)
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.whitened, r.explained, int(r.deviation), r.identity_error) for r in one] == [(1, None, 0.0, 0, None), (2, None, 0.0, 0, None)]
    flat = whitening.whiten(make([(i, [float(i), 5.0]) for i in range(4)])).collect()  # one dimension has no variance
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-12
    mixed = whitening.whiten(make([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0]), (4, [])])).collect()
    assert {r.vec_id for r in mixed} == {1, 2}
    huge = whitening.whiten(make([(1, [3.0e38, 1.0]), (2, [-3.0e38, 2.0]), (3, [1.0, 7.0])])).collect()  # beyond 64 bits
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(r.identity_error < 1e-6 for r in huge if r.component == 1)
    assert {r.vec_id: r.deviation is None for r in huge} == {1: True, 2: True, 3: False}  # more than 38 digits, or the middle one's few


def test_moments_in_any_split():
    r = np.random.default_rng(5)
    x = r.integers(99_000, 101_000, size=(500, 6))
    for whole, rows in ((True, x), (True, x.astype(object) * 10**20), (False, x / 7)):
        parts = []
        for part in np.split(rows, [0, 3, 4, 100, 420]):
            m = whitening.Moments(6, whole)
            for a in range(0, len(part), 37):
                m.add(part[a : a + 37])
            parts.append(m)
        total = whitening.Moments(6, whole)
        for m in parts:
            total.merge(m)
        want = np.cov(rows.astype(float).T, bias=True) * len(rows)
        assert total.n == 500 and np.abs(total.scatter / want - 1).max() < 1e-9


def test_symmetric_qr():
    r = np.random.default_rng(1)
    for a in (np.zeros((3, 3)), np.eye(4), np.diag([3.0, 3.0, -1.0]), np.array([[2.0]]), np.zeros((0, 0)), *[x @ x.T for x in r.normal(size=(4, 40, 25))], np.ones((30, 30))):
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(np.sort(values), np.linalg.eigvalsh(a) if len(a) else values, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-12)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-11)


def brute_variants(rows, least_length=5, least_count=3):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= least_count}

    def edits(w):
        letters = sorted({c for x in count for c in x})
        cuts = {w[:k] + w[k + 1 :] for k in range(len(w))}
        return (cuts | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}) - {w}

    near = {w: sorted((x for x in edits(w) if x in count), key=lambda x: (-count[x], x)) for w in count}
    form = {w: near[w][0] if near[w] and count[near[w][0]] >= 2 * n else None for w, n in count.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items()}


@pytest.fixture(scope="module")
def misspelt():
    r = random.Random(8)
    base = ["".join(r.choice("abcàÿ") for _ in range(r.randint(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "abababab"]
    rows = []
    for i in range(120):
        words = []
        for w in r.choices(base, weights=[1 / (k + 1) for k in range(len(base))], k=60):
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcàÿ") + w[k:], w[:k] + r.choice("abcàÿ") + w[k + 1 :]]) or "x"
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows + [(None, "abcab abcab"), (5, None), (6, ""), (7, "a" * 3000 + " " + "b" * 70), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("shard,few", [(5000, 24), (40, 0), (7, 2)])
def test_spelling_variants(spark, misspelt, monkeypatch, shard, few):
    monkeypatch.setattr(spelling, "FEW", few)
    df = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in misspelt], "doc_id long, text string, word string, shard string, n int").repartition(5)
    got = spelling.variants(df, shard=shard).collect()
    assert len(got) == len({r.word for r in got}) and {tuple(r) for r in got} == brute_variants(misspelt)


def test_spelling_of_pieces(spark, misspelt, monkeypatch):
    long = [(1, " ".join(t for _, t in misspelt if t))]
    monkeypatch.setattr(spelling, "PIECE", 50)
    assert spelling._runs(long[0][1].encode(), re.compile(spelling._RUN).findall) == Counter(re.findall(spelling._RUN, long[0][1].encode().lower().decode()))
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for bad in ({"times": 1}, {"least_length": 1}):
        with pytest.raises(ValueError):
            spelling.variants(spark.createDataFrame([], "doc_id long, text string"), **bad)


def test_long_chains_of_forms(spark):
    forms = [(f"w{k}", f"w{k + 1}" if k < 40 else None) for k in range(41)] + [("alone", None)]
    assert {tuple(r) for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {(f"w{k}", "w40") for k in range(40)}


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/2", "https://EXAMPLE.com/en/", "http://example.com/EN/", "http://x.net/es/5?x=1", "http://x.net/fr", "ftp://net/fr/#a/b", "http://net.com", "http://com/",
    "http://notexample.com/en/1", "no scheme/com/", "", None, "://", "a://b://c/d", "http://x.org?q=/en/", "http://x.org#frag", "http://u@h.com:80/p", "HTTP://\u00c9xample.COM/en/x", "http://a.com/" + "s/" * 5000, "x\ny://h\n/p\nq", "http://..com/",
]


def brute_url(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    h, p = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(-len(r), r, v) for v, r in catalog.URL_RULES if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/") :])]
    return h, p, *(min(fits)[1:] if fits else (None, "allow"))


def test_url_rules(spark):
    rows = [(i, u, "x", "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "x", "x"), (0, URLS[0], "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, row string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = url_filter.judge(pages, none, catalog.URL_RULES).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(((i, *brute_url(u)) for i, u, *_ in rows), key=repr)
    assert all(r.mined is None for r in got) and url_filter.judge(pages.limit(0), none).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, none).collect()} == {"allow"}


def test_mined_url_rules(spark):
    r = random.Random(2)
    rows = []
    for _ in range(900):
        bad, lang = r.random() < 0.2, r.choice(["en", "fr"])
        name = r.choice(["win", "luck"]) if bad else r.choice(["news", "blog", "win" if lang == "fr" else "luck"])
        rows.append((f"http://{r.choice(['', 'www.'])}{name}.{r.choice(['org', 'net'])}/{lang}/{r.randrange(10**6)}{r.choice(['', '.html', '?page=1'])}", bad if r.random() < 0.95 else not bad))
    rows += [(None, True), ("nothing", True), ("http://x.org/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    host, path = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    told = labelled.select(url_filter.tokens(F.col("url"), host, path).alias("tokens"), "blocked")
    items = [(tuple(t.tokens), t.blocked) for t in told.collect() if t.blocked is not None and t.tokens]
    held, blocked = Counter(), Counter()
    for t, b in items:
        for k in range(1, len(t) + 1):
            for some in itertools.combinations(t, k):
                held[some] += 1
                blocked[some] += b
    rules = {c: blocked[c] / n for c, n in held.items() if blocked[c] >= max(20, 0.001 * len(items)) and blocked[c] / n >= 0.6}
    rules = {c: s for c, s in rules.items() if not any(set(d) < set(c) and t >= s for d, t in rules.items())}
    got = url_filter.mined_rules(told, least_rows=20)
    assert rules and {tuple(x.tokens): round(x.confidence, 9) for x in got.collect()} == {c: round(s, 9) for c, s in rules.items()}
    assert all(x.n == blocked[tuple(x.tokens)] for x in got.collect())
    pages = labelled.select(F.monotonically_increasing_id().alias("page_id"), "url")
    judged = {x.page_id: x for x in url_filter.judge(pages, labelled).collect()}
    for page, t in zip(pages.collect(), told.collect()):
        hits = [(-s, -len(c), c) for c, s in rules.items() if set(c) <= set(t.tokens)]
        x = judged[page.page_id]
        assert (x.verdict, x.mined and tuple(x.mined)) == (("block", min(hits)[2]) if hits else ("allow", None))
    assert url_filter.mined_rules(told.limit(0)).count() == 0 and url_filter.mined_rules(told.limit(5)).count() == 0


def test_late_url_parts_count(spark):
    """Labels that only a late segment, key or host label tells; thirty segments that always go together cost no more than one."""
    long = "/".join(f"s{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(30))
    forms = ["http://a.b.c.d.e.{}.org/x", "http://h.org/a/b/c/d/e/{}/z", "http://h.org/a?k=1&l=2&m=3&n=4&{}=5", f"http://h.org/{long}/{{}}", "http://h.org/a.{}"]
    words = [("badword", True), ("fineword", False)]
    rows = [(f.format(w), blocked) for f in forms for w, blocked in words for _ in range(25)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    pages = spark.createDataFrame([(2 * i + k, f.format(w)) for i, f in enumerate(forms) for k, (w, _) in enumerate(words)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, labelled).collect()} == {k: ("block", "allow")[k % 2] for k in range(10)}
    host, path = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    told = labelled.select(url_filter.tokens(F.col("url"), host, path).alias("tokens"), "blocked")
    bad = {tuple(r.tokens) for r in url_filter.mined_rules(told).collect()}
    assert bad == {("host=badword",), ("path=badword",), ("key=badword",), ("file=badword",), ("path=a.badword",)}
    twins = spark.createDataFrame([(["p", "q", "r"], True)] * 30 + [(["r"], False)] * 30, "tokens array<string>, blocked boolean")
    assert sorted(tuple(r.tokens) for r in url_filter.mined_rules(twins).collect()) == [("p",), ("q",)]
