"""Url verdicts, spelling groups and whitening against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA

from quillon.llm import spelling, url_filter, whitening

# Url filter

RULES = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("com", "", "allow"), ("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("net", None, "allow"), ("de", "/", "perhaps")]
URLS = [
    None, "", "no scheme/en/", "http://NET/", "http://x.example.NET/en/a?b#c", "https://example.net/en", "x://example.net", "ftp://xexample.com/de/1", "http://www.example.com/de/1", "http://example.com:80/de/", "http://org/fr/", "http://.org/fr/",
    "http://org./fr/", "http:///fr/", "http://a.com/xyz", "http://b.a.com/x/y", "http://a.b.c.d.net?q=/", "http://a.b.c.d.net/#/", "http://é.NET/Ä", "http://x\n.net/a\nb?c", "a://b://net/", "http://org/f", "http://" + "a." * 5_000 + "net/" + "y" * 20_000,
]


def verdict_of(url, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        rest = rest[len(host) :]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h.lower() + p, v) for h, p, v in RULES if h and p is not None and v != "perhaps" and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


def test_url_verdicts(spark, monkeypatch):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    data = [(i if i % 5 else None, u, "x", 1) for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(data, "page_id long, url string, host string, rule int")
    want = sorted([repr((i, *verdict_of(u))) for i, u, *_ in data])
    for shapes, blocks in ((10_000, 1 << 20), (2, 1)):
        monkeypatch.setattr(url_filter, "MOST_SHAPES", shapes)
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)
        assert sorted(repr(tuple(r)) for r in url_filter.judge_urls(pages, rules).collect()) == want
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), otherwise="block").collect()} == {"block"}


def test_url_filter_lets_few_others_through(spark):
    listed = spark.range(2_000).selectExpr("concat('h', id, '.org') AS host", "'/' AS path", "'block' AS verdict")
    blocks = 2_000 // url_filter.BLOCK_RULES
    bloom = url_filter.bloom_filter(listed, blocks)
    assert url_filter.possible_hits(listed.select("host", "path"), bloom, blocks).count() == 2_000
    others = spark.range(20_000).selectExpr("concat('x', id, '.org') AS host", "'/' AS path")
    assert url_filter.possible_hits(others, bloom, blocks).count() < 60


def test_url_verdicts_of_many_rules(spark):
    chosen = random.Random(5)
    rules = [(f"h{chosen.randrange(400)}.org", "/" + "ab"[chosen.randrange(2)] * chosen.randrange(4), chosen.choice(["allow", "block"])) for _ in range(300)]
    urls = [(i, f"http://{chosen.choice(['', 'www.'])}h{chosen.randrange(500)}.org/{'ab'[chosen.randrange(2)] * chosen.randrange(5)}") for i in range(1_500)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in urls:
        host, path = u[7:].split("/", 1)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow"))


# Spelling


def counted(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def grouped(n):
    holes = defaultdict(set)  # words by what is left where one code point is deleted or replaced
    for w in n:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for key, ws in holes.items():
        for a in ws:
            near[a] |= {b for b in ws if b != a and ("*" in key or key in (a, b))}
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 2 * k else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


ORDER = ["word", "form", "root", "n", "n_near", "form_n"]


def spelled(docs):
    out = spelling.spelling_groups(docs)
    assert out.columns[:6] == ORDER
    got = [tuple(r) for r in out.select(*ORDER).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_groups_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = grouped(counted([tuple(r) for r in docs.collect()]))
    assert spelled(docs) == want and len({w[1] for w in want}) > 100


ODD = [
    (None, "Straße straße STRASSE straÿe ÀÉÿ×÷Àb Ünïcode ünïcode x\u0100yzzy caf\u00e9s cafés"), (1, None), (2, ""), (2, " \n"), (3, "\U0001F600abcdeé" * 40), (3, "abcdeé" * 40), (4, "aaaab aaaaab aaaab aaaaab aaaab aaaaab aaaaaab " * 5),
    (5, "z" * 2_000 + " " + "z" * 1_999 + " " + "z" * 1_999), (6, ("z" * 2_000 + " ") * 3), (7, ("z" * 1_999 + " ") * 3), (8, "Ab" * 60 + " "), (9, ("ab" * 60 + " ") * 2), (-10, "\u00c3\u0083 éééééé éééééé éééééé ééééé ééééé ééééé\u0301"),
]


def test_spelling_of_odd_texts(spark):
    data = ODD + [(100 + i, f"{w} {w}s {w[:-1]}x {w[1:]}") for i in range(40) for w in ("colour", "flavour", "naïveté")] * 2
    docs = spark.createDataFrame([(*r, 1, "n") for r in data], "doc_id long, text string, word int, n string")
    assert spelled(docs) == grouped(counted(data))
    assert spelled(docs.limit(0)) == spelled(docs.where("text IS NULL")) == set()


def test_spelling_of_a_crowded_half(spark, monkeypatch):
    """One beginning has most words, in many blocks, some of them empty."""
    chosen = random.Random(3)
    words = {"prefix" + "".join(chosen.choice("abc") for _ in range(chosen.choice((4, 5, 6)))) for _ in range(500)} | {"".join(chosen.choice("abc") for _ in range(5)) + "suffix" for _ in range(150)}
    data = [(i, w, chosen.randrange(1, 40)) for i, w in enumerate(sorted(words))]
    frame = spark.createDataFrame([(w, n) for _, w, n in data], "word string, n long")
    want = {(w, k) for w, _, _, _, k, _ in grouped({w: n for _, w, n in data}) if k}
    for block, chunk in ((1_024, 16_384), (7, 50), (300, 64)):
        monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
        monkeypatch.setattr(spelling, "CHUNK_WORDS", chunk)
        assert {(r.word, r.n_near) for r in spelling.near_words(frame).collect()} == want


def test_checksums_are_continued():
    ids = ["7", "-12", "", "123456789"]
    texts = [" ".join("abc" * k for k in range(1, 40)), "é" * 60 + " é" * 3, "x", "a\u00d7b " * 200]
    import pyarrow as pa

    words, counts = spelling.count_words(ids, pa.array(texts))
    got = Counter()
    for w, n in zip(words.to_pylist(), counts.tolist()):
        got[w] += n
    want = Counter()
    for i, t in zip(ids, texts):
        for w in re.findall("[a-z\u00C0-\u00FF]+", t):
            h = zlib.crc32(f"{i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            want[w] += len(w) >= 5
    assert got == +want


# Whitening


def plain_whitening(data):
    """(rows kept, n, deviations, whitened, explained) by the textbook in double precision."""
    sound = [(i, v) for i, v in data if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(256 * c) for c in v) for _, v in sound]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = [k for k in range(min(4, len(e))) if e[k] > 1e-9 * e[0]]
    w = (np.array(x, float) - np.array([s / n for s in sums])) @ u[:, keep] / np.sqrt(e[keep])
    return sound, n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], w, (e / np.trace(v))[keep]


def check_whitening(df, data):
    sound, n, deviations, want, explained = plain_whitening(data)
    rows = df.collect()
    assert df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(rows) == len(sound) * len(explained) and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    assert {r.n for r in rows} == {n}
    order = lambda i: (i is None, i or 0)
    assert sorted(((r.vec_id, r.deviation) for r in rows if r.component == 1), key=lambda r: (*order(r[0]), r[1])) == sorted(((i, d) for (i, _), d in zip(sound, deviations)), key=lambda r: (*order(r[0]), r[1]))
    for k, share in enumerate(explained):
        got = sorted((*order(r.vec_id), r.whitened) for r in rows if r.component == k + 1)
        assert all(abs(r.explained / share - 1) < 1e-9 for r in rows if r.component == k + 1)
        fits = [np.allclose(sorted(g[2] for g in got), sorted(s * want[:, k]), atol=1e-6) for s in (1, -1)]
        assert any(fits), k


def test_whitening_of_embeddings(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    check_whitening(whitening.whiten(vectors), [tuple(r) for r in vectors.collect()])


def test_whitening_of_odd_vectors(spark):
    chosen = random.Random(1)
    data = [(i % 30 if i % 7 else None, [chosen.gauss(0, s) for s in (3, 1, 0.5, 0.2, 0.01)]) for i in range(80)] * 2
    data += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [math.nan] * 5), (204, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in data + [(205, [1.0, 2.0])]], "vec_id long, embedding array<double>, n int")
    check_whitening(whitening.whiten(frame), data)
    for none in (frame.limit(0), frame.where("vec_id = 205"), frame.where("vec_id >= 200 AND vec_id < 205")):
        assert whitening.whiten(none).collect() == []


def test_whitening_with_equal_and_missing_eigenvalues(spark):
    """Four corners of a square and their centre: two equal eigenvalues, one zero; far numbers don't round."""
    square = [(i, [a, b, 0.5]) for i, (a, b) in enumerate([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0), (0.0, 0.0)])]
    rows = whitening.whiten(spark.createDataFrame(square, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in rows} == {1, 2} and all(abs(r.explained - 0.5) < 1e-15 and r.identity_error < 1e-12 for r in rows)
    far = [(i, [1e25 * (i % 3), 1e14 + i, 1e300 * (-1) ** i]) for i in range(6)]
    rows = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in rows} == {1, 2, 3} and rows[0].identity_error < 1e-4 and all(r.deviation is None for r in rows)


@pytest.mark.parametrize("kind", ["random", "diagonal", "zero columns", "rank one"])
def test_characteristic_polynomial(spark, kind):
    chosen = random.Random(kind)
    d = 7
    base = [[chosen.randrange(-50, 50) for _ in range(d)] for _ in range(d)]
    if kind == "diagonal":
        m = [[3 * (i == j) * (1 + i // 2) for j in range(d)] for i in range(d)]
    elif kind == "rank one":
        m = [[base[0][i] * base[0][j] for j in range(d)] for i in range(d)]
    else:
        m = [[sum(base[k][i] * base[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
        if kind == "zero columns":
            m = [[0 if 2 in (i, j) or 0 in (i, j) else v for j, v in enumerate(row)] for i, row in enumerate(m)]
    # traces of powers, by Newton's identities
    power, traces = [[int(i == j) for j in range(d)] for i in range(d)], []
    for _ in range(d):
        power = [[sum(a * b for a, b in zip(row, col)) for col in zip(*m)] for row in power]
        traces.append(sum(power[i][i] for i in range(d)))
    e = [1]
    for k in range(1, d + 1):
        e.append(sum((-1) ** (i - 1) * e[k - i] * traces[i - 1] for i in range(1, k + 1)) // k)
    want = [(-1) ** (d - k) * e[d - k] for k in range(d + 1)]
    assert whitening.characteristic_polynomial(spark, m) == want
    roots, shift = whitening.largest_roots(want, d)
    known = [v for v in sorted(np.linalg.eigvalsh(np.array(m, float)), reverse=True) if v > 1e-6]
    assert np.allclose([r / 2**shift for r in roots], known, rtol=1e-6)
