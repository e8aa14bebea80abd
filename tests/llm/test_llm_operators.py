"""The training-data operators against plain Python, exact round trips and SQL."""

import html
import json
import math
import random
import re
import tempfile
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA
from oracle import compare, duck
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from quillon.llm import chat, embedding_dedup, exact_dedup, line_dedup, main_text, mixing, near_copies, packing, quality, queries, shared, simhash, token_files, tokens
from quillon.llm.shared import small_batches
from quillon.llm.tokens import vocabulary


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").cache()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    compare(queries.QUERIES[name](spark, DATA), duck(DATA), queries.ORACLE_SQL[name])


# Main text


def test_main_text_keeps_the_article_of_every_page(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in main_text.extract_main_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_main_text_without_article_marks():
    page = (
        '<body><header><h1>Site</h1></header><div id="menu"><ul><li><a href=x>Home</a><li><a>News</a></ul></div><div class="content"><h1>Title &amp; more</h1>'
        "<p>First paragraph that is long enough to be seen as text by anyone who reads it, really.<p>Second&nbsp;one\n here.<div class=ad>Buy!</div>"
        "<p>Third with <a href=y>a link</a>. 1 < 2<p>End.</div><aside>Side text that goes on and on and on and on and on and on and on and on and on.</aside>"
        "<div id=comments><p>A reader's comment that goes on and on and on and on and on and on and on.</div><form>Sign <input> up</form><footer>(c)</footer></body>"
    )
    want = ["Title & more", "First paragraph that is long enough to be seen as text by anyone who reads it, really.", "Second one here.", "Third with a link. 1 < 2", "End."]
    assert main_text.main_text(page) == "\n\n".join(want)
    assert main_text.main_text("") == main_text.main_text(None) == main_text.main_text("<script>x</script>") == ""
    assert main_text.main_text("plain") == "plain"
    assert main_text.main_text("<p>" * 20_000 + "deep") == "deep"


ARTICLE = ["A title of the page"] + [f"Paragraph {i} says something of its own, and goes on long enough to be seen as text by a reader. " * 2 for i in range(4)] + ["The end."]
CHROME = '<div class="menu"><ul><li><a href=a>Home</a><li><a>News</a><li><a>More</a></ul></div>', '<div class="site-footer">Copyright and so on, with a long line of legal text that nobody reads and nobody wants to see.</div>'


def article_in(before, after):
    blocks = f"<h1>{ARTICLE[0]}</h1>" + "".join(f"<p>{x}</p>" for x in ARTICLE[1:])
    return f"<html><body>{CHROME[0]}{before}{blocks}{after}{CHROME[1]}</body></html>"


WHOLE = "\n\n".join(x.strip() for x in ARTICLE)


@pytest.mark.parametrize("name", ["post", "social-science", "search-engine-guide", "related-work", "alert-study", "comments-on-law", "share-market", "hidden-history", "notice-board-story", "has-sidebar", "banner"])
def test_a_name_never_removes_the_article(name):
    assert main_text.main_text(article_in(f'<div class="{name}">', "</div>")) == WHOLE
    assert main_text.main_text(article_in(f'<main><section id="{name}">', "</section></main>")) == WHOLE


#: Names of boilerplate that layouts also give to what is around the article.
WRAPPERS = (
    "content-sidebar-wrap right-sidebar left-sidebar sidebar-right page-sidebar login-content signup-page cookie-content newsletter menu-page post-comments comment-content copyright disclaimer reply ad"
    " sidebar sponsored-content nav-wrapper footer-content comments respond"
).split()


@pytest.mark.parametrize("name", WRAPPERS)
def test_a_name_of_boilerplate_around_the_article_keeps_it(name):
    extra = f'<div class="{name}"><p>' + "Words that aren't of the article, though there are many of them here. " * 40 + "</p></div>"
    remark = '<div class="comments"><article><p>' + "A reader says this and that. " * 20 + "</p></article></div>"
    for before, after in (("<main><article>", "</article></main>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<section>", "</section>"), ('<div class="right-sidebar"><main>', "</main></div>")):
        whole = f'<div class="{name}">{before}', f"{after}</div>"
        assert main_text.main_text(article_in(*whole)) == WHOLE
        assert main_text.main_text(article_in(whole[0], after + "<aside>Side</aside></div>")) == WHOLE
        assert main_text.main_text(article_in(f'<div id="{name}">' + before, after + remark + "</div>")) == WHOLE
        if "<main>" in before or "<article>" in before:
            assert main_text.main_text(article_in(whole[0] + extra, extra + whole[1] + extra)) == WHOLE, "beside and inside"
            assert main_text.main_text(article_in(before, after + extra)) == WHOLE


def test_formulas_of_an_article_stay():
    page = article_in("<article>", "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> holds.</p></article>")
    assert main_text.main_text(page) == WHOLE + "\n\nSo x=2 holds."


def test_main_text_of_other_layouts():
    form = article_in("<form action=x><div>", "</div><input><label>Search</label></form>")
    assert main_text.main_text(form) == WHOLE
    half = ARTICLE[:3], ARTICLE[3:]
    split = f"<body>{CHROME[0]}" + "".join(f"<div class=part><p>{'</p><p>'.join(x)}</p></div>" for x in half) + CHROME[1]
    assert main_text.main_text(split) == WHOLE
    outside = f"<body>{CHROME[0]}<h1>{ARTICLE[0]}</h1><div class=content>{''.join(f'<p>{x}</p>' for x in ARTICLE[1:])}</div>{CHROME[1]}"
    assert main_text.main_text(outside) == WHOLE
    for name in ("comments", "comment-list", "sidebar", "site-footer", "cookie-notice", "newsletter", "ad", "related-posts", "share-buttons", "socialLinks", "search-form", "login-box"):
        extra = f'<div class="{name}"><p>' + "Words that aren't of the article, though there are many of them here. " * 4 + "</p></div>"
        assert main_text.main_text(article_in("<article>", "</article>" + extra)) == WHOLE, name
        assert main_text.main_text(article_in("<div class=text>", "</div>" + extra)) == WHOLE, name
        assert main_text.main_text(article_in("<article>", extra + "</article>")) == WHOLE, name
    links = "<ul><li><a href=1>A first source with a long name</a></li><li><a href=2>A second one</a></li><li><a href=3>And a third</a></li></ul>"
    assert main_text.main_text(article_in("<article>", links + "</article>")) == WHOLE + "\n\nA first source with a long name\n\nA second one\n\nAnd a third"
    assert main_text.main_text(CHROME[0] + CHROME[1]) == ""


def test_main_text_of_deep_and_broken_pages_is_quick():
    began = time.process_time()
    deep = main_text.main_text("<div>some words " * 20_000)
    assert deep.startswith("some words") and deep.count("some words") == 20_000
    for piece in ("<a ", "<p it's>x", "<p a='x>", '<a b="', "<b></p><p>", "</i>", "<!-", "<ul><li><b>"):
        main_text.main_text("<div>" * 2_000 + piece * 20_000)
    assert time.process_time() - began < 8


def test_main_text_edges(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (2, "<p>Hi there</p>", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in main_text.extract_main_text(df).collect()) == ["", "", "Hi there"]
    assert main_text.extract_main_text(df.limit(0)).count() == 0


# Packing and token files


def encoded(name, texts, end):
    return [e.ids + [end] for e in Tokenizer.from_file(vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["a", "B", "the", " ", "\n", "\t", "  ", "\u2003", "\u00e9", "\u0301", "1", "23", "!", "...", "'s", "Σ", "\u00a0", "日本", "👍🏽", "<|endoftext|>", "<|startoftext|>", "\x00", "İ", "ß", ", ", ". ", "\x1c", "\x85"]


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", "space"), ("byte_bpe_50k.json", "before")])
def test_pieces_encode_like_whole_texts(name, cut, special_as_text, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(3000)]
    fresh = Tokenizer.from_file(vocabulary(name))
    fresh.encode_special_tokens = special_as_text
    want = [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
    e = tokens.PieceEncoder(vocabulary(name), cut, special_as_text)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    for at in (0, 500, 500):
        assert [x.tolist() for x in e.arrays(pa.array(texts[at:]))] == want[at:]
        assert [x.tolist() for x in e.arrays(pa.array(texts).slice(at, 300))] == want[at : at + 300]
    assert e.arrays(pa.array([None, ""], pa.string()))[0].tolist() == [] and e.arrays(pa.array([], pa.string())) == []


def test_special_tokens_are_the_librarys():
    fresh = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for text in ("a <|endoftext|> b", "<|startoftext|> x"):
        want = fresh.encode(text, add_special_tokens=False).ids
        assert tokens.encoder(vocabulary("word_bpe_49k.json"), "space").arrays(pa.array([text]))[0].tolist() == want


def test_packing_round_trip(spark, documents):
    out = rows(packing.pack_documents(documents, vocabulary("word_bpe_49k.json"), 1, capacity=512))
    data = rows(documents.select("doc_id", "text"))
    want = {}
    for (i, _), ids in zip(data, encoded("word_bpe_49k.json", [t for _, t in data], 1)):
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[i, k // 512] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(d, p): (s, n, c) for d, p, s, n, c, _, _ in out} == want and len(out) == len(want)
    places = {}
    for _, _, _, n, _, s, o in out:
        places.setdefault(s, []).append((o, n))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(places) <= 1.03 * sum(n for v in places.values() for _, n in v) / 512 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_finds_exact_fills(seed):
    rng = np.random.default_rng(seed)
    lengths = {int(k): int(v) for k, v in zip(rng.integers(1, 100, 30), rng.integers(1, 50, 30))}
    used = {}
    for pattern, times in packing.plan_packing(lengths, 100):
        assert sum(pattern) <= 100 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == lengths
    assert packing.plan_packing({60: 3, 40: 3}, 100) == [([60, 40], 3)]
    assert packing.plan_packing({50: 2, 30: 2, 20: 2}, 100)[0][1] == 1
    assert sum(t for _, t in packing.plan_packing({70: 1, 10: 3}, 100)) == 1


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_a_sum_if_there_is_one(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(61, np.int64)
    np.add.at(counts, rng.integers(1, 60, 14), 1)
    index = packing.SumIndex(counts)
    for _ in range(25):
        available = [x for x in range(61) for _ in range(counts[x])]
        for gap in range(1, 61):
            some = next((k for k in (1, 2, 3) if any(sum(c) == gap for c in combinations(available, k))), None)
            found = index.fill(gap)
            assert (len(found) if found else None) == some
            assert found is None or sum(found) == gap and not Counter(found) - Counter(available)
        if not available:
            break
        counts[rng.choice(available)] -= 1


def test_texts_come_in_small_batches():
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["a" * 10, None, "b" * 3, "c" * 30])], ["doc_id", "text"])
    assert [b.num_rows for b in small_batches([batch, batch.slice(0, 0)], limit=14)] == [3, 1]
    out = list(packing._pieces([batch.slice(i, 1) for i in range(4)], vocabulary("word_bpe_49k.json"), 1, 4))
    assert [r for b in out for r in b.column(0).to_pylist()][:3] == [1, 2, 3] and len(out) == 4


def test_packing_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (5, "", 2), (5, "hello there", 3), (5, "hello there", 3)], "doc_id long, text string, start int")
    out = rows(packing.pack_documents(df, vocabulary("word_bpe_49k.json"), 1))
    assert len(out) == 4 and {r[5] for r in out} == {0} and sorted(r[3] for r in out) == [1, 1, 3, 3]
    assert packing.pack_documents(df.limit(0), vocabulary("word_bpe_49k.json"), 1).count() == 0


def test_token_files_round_trip(spark, documents):
    path = tempfile.mkdtemp() + "/files"
    token_files.write_token_files(documents, path, vocabulary("byte_bpe_50k.json"), 2)
    data = sorted(rows(documents.select("doc_id", "text")))
    ids = encoded("byte_bpe_50k.json", [t for _, t in data], 2)
    starts = np.cumsum([0, *map(len, ids)])
    got = sorted(rows(token_files.read_token_files(spark, path, with_ids=True)))
    assert got == [(d, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x) for (d, _), s, x in zip(data, starts, ids)]
    assert token_files.read_document(spark, path, data[7][0]) == [ids[7]]
    assert token_files.read_document(spark, path, -1) == []


def test_token_files_edges(spark):
    df = spark.createDataFrame([(None, None), (5, ""), (5, "hello there"), (5, "hello there")], "doc_id long, text string")
    for table, n in ((df, 4), (df.limit(0), 0)):
        path = tempfile.mkdtemp() + "/files"
        token_files.write_token_files(table, path, vocabulary("byte_bpe_50k.json"), 2)
        out = rows(token_files.read_token_files(spark, path))
        assert len(out) == n and [r[1] for r in sorted(out, key=lambda r: r[1])] == [0, 1, 2, 5][:n]


# Chat


def test_chat_layouts_and_round_trip(spark):
    chats = [
        {"messages": [{"role": "user", "content": "hi: ### "}, {"role": "gpt", "content": None}]},
        {"conversations": [{"from": "human", "value": "a\nb"}, {"from": "gpt", "value": "</turn>\\e"}]},
        {"instruction": "do", "output": "ok", "input": None}, {"instruction": "do", "output": "ok", "input": "x"},
        {"prompt": "p", "response": "\\### r", "system": "s"}, {"prompt": "p", "completion": "r"}, {"question": "q", "answer": "<</turn>"}, {"other": {"deep": [1]}},
    ]
    df = spark.createDataFrame([(i, json.dumps(c), "old") for i, c in enumerate(chats)] + [(8, None, "old"), (9, "no json", "old")], "id int, json string, layout string")
    out = chat.format_chat(df).withColumn("back", chat.parsed_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).orderBy("id").collect()
    assert [r.layout for r in out] == ["messages", "conversations", "instruction", "instruction", "prompt", "completion", "question", None, None, None]
    assert all(r.back == r.turns for r in out)
    assert [r.loss for r in out] == ["", "</turn>\\e", "ok", "ok", "\\### r", "r", "<</turn>", None, None, None]
    assert [tuple(t) for t in out[3].turns] == [("user", "do"), ("user", "x"), ("assistant", "ok")]
    assert chat.format_chat(df.limit(0)).count() == 0


def test_layouts_by_whole_names(spark):
    odd = ['{"x prompt": "a", "y response": "b"}', '{"a:prompt": "q", "response": "b"}', '{"x messages": [{"role": "user", "content": "c"}]}', '{"messages[].role": 1, "messages": [], "messages[]": 1, "messages[].content": 2}', '{"a.prompt": "q", "response": "b"}']
    df = spark.createDataFrame([(i, j) for i, j in enumerate(odd)], "id int, json string")
    assert {r.layout for r in chat.format_chat(df).collect()} == {None}


def test_control_strings_come_back(spark):
    parts = ["\\", "### ", "</turn>", "\\s", "\\e", "\\b", "\n", "#", "<", "user: ", "é", ""]
    rng = random.Random(1)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(i, [("user: x", t), ("assistant", t)]) for i, t in enumerate(texts)], "id int, turns array<struct<role: string, text: string>>")
    for r in chat.formatted(df).withColumn("back", chat.parsed_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect():
        assert r.back == r.turns and r.loss == texts[r.id]


# SimHash


def test_golay_keys_meet_within_two_bits():
    leaders = [0] + [sum(1 << p for p in c) for w in (1, 2, 3) for c in combinations(range(23), w)]
    errors = np.array([sum(1 << p for p in c) for w in (1, 2) for c in combinations(range(23), w)])
    for leader in leaders:  # by linearity, cosets stand for all values
        own = set(simhash.golay_keys(np.array([leader]))[0]) - {-1}
        assert 1 <= len(own) <= 6
        near = simhash.golay_keys(leader ^ errors)
        assert np.isin(near, list(own)).any(1).all()


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def components(n, links):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def test_simhash_matches_brute_force(spark, documents):
    data = sorted(rows(documents.select("doc_id", "text")))
    prints = [slow_fingerprint(t) for _, t in data]
    links = [(i, j) for i, j in combinations(range(len(data)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = components(len(data), links)
    want = {(d, f"{p:016x}", data[r][0]) for (d, _), p, r in zip(data, prints, roots)}
    assert set(rows(simhash.simhash_components(documents))) == want


@pytest.mark.parametrize("limit", [2, 64])
def test_crowded_keys_lose_no_link(spark, limit):
    rng = np.random.default_rng(limit)
    base, prints = int(rng.integers(0, 2**62)), set()
    while len(prints) < 300:
        prints.add(base ^ sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 7))}))
    prints = sorted(prints)
    found = rows(simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), limit))
    at = {p: i for i, p in enumerate(prints)}
    near = [(i, j) for i, j in combinations(range(300), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert components(300, [(at[a], at[b]) for a, b in found]) == components(300, near)


def test_simhash_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c")], "doc_id long, text string")
    out = rows(simhash.simhash_components(df))
    assert sorted((d or 0, c or 0) for d, _, c in out) == [(0, 0), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert simhash.simhash_components(df.limit(0)).count() == 0


# Near copies


def shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def near_family(seed, n, families):
    rng = random.Random(seed)
    vocabulary_, texts = [f"w{i}" for i in range(3_000)], []
    for _ in range(families):
        base = rng.choices(vocabulary_, k=rng.randint(30, 220))
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary_)
            texts.append(" ".join(words))
    return texts + [None, "", "one", "one", "Two words", "two  words"]


@pytest.mark.parametrize(("limits", "n", "families"), [({}, 6, 60), ({"LIST_ROWS": 4, "FEW": 1, "BLOCK_ROWS": 50, "SAMPLE_ROWS": 100, "CROWDED": 3, "BUCKET_ROWS": 3_000}, 90, 4)])
def test_near_copies_match_brute_force(spark, monkeypatch, limits, n, families):
    for name, value in limits.items():
        monkeypatch.setattr(near_copies, name, value)
    texts = near_family(n, n, families)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    got = dict(rows(near_copies.near_copy_groups(spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(4))))
    sets = shingle_sets(texts)
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = sum(got[i] == got[j] for i, j in links)
    want = components(len(texts), links)
    assert found >= 0.97 * len(links) and len(links) > 300
    assert all(want[i] == want[got[i]] for i in got) and len(got) == len(texts)  # no group reaches beyond a true one
    if limits:
        assert [got[i] for i in range(len(texts))] == want


def test_near_copies_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (3, None), (2, "  "), (9, "x y"), (9, "p q"), (4, "P  q"), (7, "x y")], "doc_id long, text string")
    assert sorted(rows(near_copies.near_copy_groups(df))) == [(2, 2), (3, 2), (4, 4), (7, 4), (9, 4), (9, 4)]
    assert near_copies.near_copy_groups(df.limit(0)).count() == 0


# Mixing


def test_targets_share_the_excess(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 5, 100, 1000, 5000]) for _ in range(15)]
    out = mixing.source_targets(spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")).collect()
    weights, left, goal, open_ = [(5, 2, 1)[i % 3] for i in range(15)], 1.5 * sum(sizes), [0.0] * 15, set(range(15))
    while True:
        share = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > 2 * sizes[i]}
        if not over:
            break
        for i in over:
            goal[i] = 2.0 * sizes[i]
            left -= goal[i]
        open_ -= over
    for i in open_:
        goal[i] = share * weights[i]
    assert [r.target for r in sorted(out)] == pytest.approx(goal)


def test_mix_meets_targets_and_repeats(spark, documents):
    first = rows(mixing.mix_sources(documents, block_words=64).select("doc_id", "source", "size", "source_size", "target", "taken"))
    again = rows(mixing.mix_sources(documents.repartition(7), block_words=64).select("doc_id", "source", "size", "source_size", "target", "taken"))
    assert sorted(first) == sorted(again)
    for s in {r[1] for r in first}:
        own = [r for r in first if r[1] == s]
        assert sum(r[5] for r in own) == round(own[0][4]) and sum(r[2] for r in own) == own[0][3]
    assert all(0 <= r[5] <= 2 * r[2] for r in first)


def test_mixed_documents_hold_the_words_taken(spark, documents):
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(documents, block_words=50).collect()}
    got = {}
    for r in mixing.mixed_documents(documents, block_words=50).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in out) == list(range(n))


def test_mixing_edges(spark):
    df = spark.createDataFrame([(None, None, None, 3), (1, "a b c", "s", 3), (1, "a b c", "s", 3), (2, "", None, 1)], "doc_id long, text string, source string, size int")
    out = mixing.mix_sources(df).collect()
    assert len(out) == 4 and sum(r.taken for r in out) == 9 and mixing.mix_sources(df.limit(0)).count() == 0


# Lines


def line_oracle(data, t=0.8):
    seen, gone = [], set()
    for i, text in sorted((d for d in data if d[1] is not None), key=lambda d: d[0]):
        for k, row in enumerate(text.split("\n")):
            words = frozenset(row.encode().lower().split())
            if words:
                if any(len(words & s) >= t * len(words | s) - 1e-9 for s in seen):
                    gone.add((i, k))
                seen.append(words)
    return gone


def test_hot_lines_and_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the same line\nline {i % 9} {i}") for i in range(60)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    results = []
    for share in (10_000, 3):
        monkeypatch.setattr(shared, "HOT_SHARE", share)
        results.append((set(rows(line_dedup.removed_lines(df))), sorted(rows(embedding_dedup.embedding_dedup(vectors).select("vec_id", "n_links", "component_id")))))
    assert results[0] == results[1] and {(i, 0) for i in range(1, 60)} <= results[0][0]


@pytest.mark.parametrize(("threshold", "block"), [(0.8, 8_192), (0.8, 40), (0.6, 60), (0.95, 8_192)])
def test_lines_match_brute_force_in_crowded_lists(spark, monkeypatch, threshold, block):
    for name, value in (("LIST_ROWS", 3), ("FEW", 1), ("BLOCK_ROWS", block), ("BUCKET_ROWS", 500), ("PACKED_ROWS", 100), ("CROWDED", 2)):
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(14)]
    data = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert set(rows(line_dedup.removed_lines(df.repartition(5), threshold=threshold))) == line_oracle(data, threshold)
    if block < 100:  # places too many to be broadcast are joined
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 3)
        assert set(rows(line_dedup.removed_lines(df.repartition(5), threshold=threshold))) == line_oracle(data, threshold)
        kept = {r.doc_id: r.text for r in line_dedup.line_dedup(df, threshold=threshold).collect()}
        gone = line_oracle(data, threshold)
        assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in data}


@pytest.mark.parametrize("few", [None, 4])
def test_pairs_of_long_lists(few):
    rng = np.random.default_rng(5)
    sizes = [1, 3, 700, 40, 900]
    p = np.zeros(sum(sizes), line_dedup._POSTING)
    p["list"], p["n"] = np.repeat(np.arange(len(sizes)), sizes), rng.integers(8, 14, len(p))
    p["pos"], p["block"] = rng.integers(0, 3, len(p)), np.where(p["list"] == 4, rng.integers(0, 2, len(p)), -1)
    for half in ("p0", "p1"):
        p[half] = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 5, (len(p), 2)).astype(np.uint64), axis=1)
    p = p[np.lexsort((p["n"], p["list"]))]
    place, more = rng.permutation(len(p)), np.zeros(len(p), bool)
    y, x, apart = line_dedup._pairs(p, place, np.arange(len(p)), more, few, 0.8)
    n, want = p["n"].astype(int), {}
    for a in range(len(p)):
        for b in np.nonzero((p["list"] == p["list"][a]) & (place < place[a]))[0]:
            need = int(np.ceil(0.8 / 1.8 * (n[a] + n[b]) - 1e-9))
            differ = int(p["p0"][a] ^ p["p0"][b]).bit_count() + int(p["p1"][a] ^ p["p1"][b]).bit_count()
            if min(n[a], n[b]) >= 0.8 * max(n[a], n[b]) - 1e-9 and min(n[a] - p["pos"][a], n[b] - p["pos"][b]) >= need and n[a] + n[b] - differ >= 2 * need and (p["block"][a] != p["block"][b] or p["block"][a] < 0):
                want.setdefault(a, {})[int(b)] = differ
    got: dict = {}
    for a, b, d in zip(y.tolist(), x.tolist(), apart.tolist()):
        assert want[a][b] == d and b not in got.setdefault(a, set())
        got[a].add(b)
    for a in range(len(p)):
        own = len(got.get(a, ()))
        assert own == len(want.get(a, ())) if not more[a] else own < len(want[a]) and own >= few
    assert sum(map(len, want.values())) > 1_000 and bool(few) == bool(more.any())


def test_lines_of_slices(documents):
    batch = pa.RecordBatch.from_pandas(documents.select("doc_id", "text").toPandas(), preserve_index=False)
    for part in small_batches([batch], limit=20_000):
        x = line_dedup.Lines(part.column(0), part.column(1))
        lines = [(i, k, row.split()) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, row in enumerate((t or "").encode().lower().split(b"\n"))]
        assert list(zip(x.doc.tolist(), x.line.tolist())) == [(i, k) for i, k, w in lines if w]
        assert x.n.tolist() == [len(set(w)) for _, _, w in lines if w] and x.counts.sum() == sum(len(w) for *_, w in lines)


def test_small_sets_by_threshold(spark):
    data = [(1, "a b c"), (2, "a b"), (3, "p q r s"), (4, "p q r"), (5, "x"), (6, "x y")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert set(rows(line_dedup.removed_lines(df, threshold=0.6))) == {(2, 0), (4, 0)} == line_oracle(data, 0.6)


def test_lines_in_rows_out_of_order(spark):
    rng = random.Random(6)
    lines = [rng.sample(range(100), 12) for _ in range(8)]
    data = []
    for i in range(90):
        words = list(rng.choice(lines))
        if rng.random() < 0.5:
            words[rng.randrange(12)] = 1_000 + i
        data.append((i, " ".join(f"w{w}" for w in words)))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    assert set(rows(line_dedup.removed_lines(df))) == line_oracle(data)
    few = [(5, "a b c d e f g h i j"), (3, "a b c d e f g h i x"), (1, "a b c d e f g h i j")]
    assert set(rows(line_dedup.removed_lines(spark.createDataFrame(few, "doc_id long, text string").coalesce(1)))) == {(3, 0), (5, 0)}


def test_line_edges(spark):
    df = spark.createDataFrame([(None, "a b\na b", 1), (1, None, 2), (2, "", 3), (3, "a b\nA  B\n\nc", 4), (4, "x\na b", 5)], "doc_id long, text string, n_lines int")
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(df).collect()}
    assert out == {None: ("a b\na b", 2, 0), 1: (None, 0, 0), 2: ("", 1, 0), 3: ("a b\n\nc", 4, 1), 4: ("x", 2, 1)}
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


# Embeddings


def test_embeddings_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([c + rng.normal(scale=0.12, size=(25, 16)) for c in centres])
    out = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    got = np.array([out[i].n_links for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum() and want.sum() > 2000
    v = spark.createDataFrame(
        [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], None), (3, None, None), (4, [0.0, 0.0], None), (5, [float("nan"), 1.0], None), (6, [None, 1.0], None), (None, [1.0, 0.0], None), (7, [1.0], None), (8, [], None)],
        "vec_id long, embedding array<double>, kept string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.embedding_dedup(v).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in range(3, 9)]]
    assert embedding_dedup.embedding_dedup(v.limit(0)).count() == 0


def test_recall_holds_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    rng = np.random.default_rng(9)
    far = rng.normal(size=(2000, 24))
    x = np.concatenate([far, far[:700] + rng.normal(scale=0.25, size=(700, 24)), np.repeat(far[5:6], 300, 0) + rng.normal(scale=0.1, size=(300, 24))])
    order = rng.permutation(len(x))
    x = x[order]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    for queries in (2_000, 20):  # with few queries there is next to no link among them
        monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", queries)
        got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(df).collect()}
        got = np.array([got[i] for i in range(len(x))])
        assert (got <= near.sum(1)).all() and got.sum() >= 0.97 * near.sum() > 1_000


def test_depths_are_places_in_the_sequence():
    rng = np.random.default_rng(2)
    index = embedding_dedup.MultiIndex(rng.normal(size=(6, 3)), rng.normal(size=(7, 3)), 1)
    x, y = rng.normal(size=(40, 6)), rng.normal(size=(40, 6))
    own = index.sequence(y, 1)[:, 0]
    assert index.depth(x, y).tolist() == (index.sequence(x, 42) == own[:, None]).argmax(1).tolist()


def test_smaller_sums():
    rng = np.random.default_rng(4)
    a, b, least = rng.integers(0, 9, size=(30, 7)).astype(float), np.sort(rng.integers(0, 9, size=(30, 5)), 1).astype(float), rng.integers(0, 18, size=30).astype(float)
    assert embedding_dedup.smaller_sums(a, b, least).tolist() == [int((x[:, None] + y[None] < r).sum()) for x, y, r in zip(a, b, least)]


def test_a_dense_group_is_measured_in_bounded_time(spark):
    rng = np.random.default_rng(6)
    near = rng.normal(size=(1, 32)) + rng.normal(scale=0.05, size=(20_000, 32))
    index = embedding_dedup.fit_codebooks(embedding_dedup.unit(near[:2_000]), 7)
    batch = pa.record_batch([pa.array(np.arange(4_096)), pa.array(near[:4_096].tolist())], ["rep", "embedding"])
    began = time.process_time()
    out = list(embedding_dedup._measured(iter([batch]), index, np.arange(0, 20_000, 20), embedding_dedup.unit(near[::20]), 0.95))
    assert abs(sum(sum(b.column("n").to_pylist()) for b in out) - (4_096 * 1_000 - 205)) < 1
    assert time.process_time() - began < 20
    table = pa.table({"rep": np.arange(2_048), "copies": np.ones(2_048, np.int64), "embedding": near[:2_048].tolist(), "cells": [[0, 1]] * 2_048})
    linked = embedding_dedup._in_block(table, table, 0.95)
    assert set(linked["n"].to_pylist()) == {2_047} and set(linked["other"].to_pylist()) == {0}


def test_odd_ids_visit_as_few_cells_as_others(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 24))
    x[1_500:] = x[:1_500] + rng.normal(scale=0.15, size=(1_500, 24))
    index = embedding_dedup.fit_codebooks(embedding_dedup.unit(x), 4)
    visits = [
        embedding_dedup.measured_visits(spark.createDataFrame([(f(i), v.tolist()) for i, v in enumerate(x)], "rep long, embedding array<double>"), index, len(x), 0.95, 0.995)
        for f in (lambda i: i, lambda i: 2 * i + 1)
    ]
    assert abs(visits[0] - visits[1]) <= 2 and max(visits) < 16


def test_multi_sequence_visits_nearest_cells(monkeypatch):
    rng = np.random.default_rng(0)
    index = embedding_dedup.MultiIndex(rng.normal(size=(7, 4)), rng.normal(size=(5, 4)), 9)
    x = rng.normal(size=(50, 8))
    a, b = embedding_dedup.halves(x)
    d = embedding_dedup.distances(a, index.first)[:, :, None] + embedding_dedup.distances(b, index.second)[:, None, :]
    got = np.take_along_axis(d.reshape(50, -1), index.sequence(x, 9), 1)
    assert np.allclose(got, np.sort(d.reshape(50, -1), 1)[:, :9])
    monkeypatch.setattr(embedding_dedup, "SEQUENCE_CELLS", 40)
    assert np.array_equal(index.sequence(x, 9), np.concatenate([index.sequence(v[None], 9) for v in x]))


def test_lines_of_far_ids_and_of_none(spark):
    """Whole numbers beyond 2**53 beside a null id."""
    far = 2**53
    df = spark.createDataFrame([(far + 1, "a b c d e\nx y"), (far + 3, "a b c d e\nz"), (None, "a b c d e"), (far + 2, "x y")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.line_dedup(df).collect()}
    assert got == {far + 1: (0, "a b c d e\nx y"), far + 3: (1, "z"), None: (0, "a b c d e"), far + 2: (1, "")}


def test_roles_stay_as_given_and_other_fields_may_come(spark):
    docs = [
        (1, {"messages": [{"role": "human", "content": "a"}, {"role": "gpt", "content": "b c"}]}), (2, {"id": "x", "messages": [{"role": "user", "content": "a", "name": "me"}, {"role": "assistant", "content": "b"}]}),
        (3, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 7}), (4, {"prompt": "a", "response": "b", "id": 7}), (5, {"prompt": "a", "response": "b", "other": 7}),
    ]
    out = chat.format_chat(spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "doc_id long, json string"))
    got = {r.doc_id: (r.roles, r.loss) for r in out.select("doc_id", F.transform(chat.parsed_turns(F.col("formatted")), lambda t: t["role"]).alias("roles"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got == {1: (["human", "gpt"], "b c"), 2: (["user", "assistant"], "b"), 3: (["user", "assistant"], "b"), 4: (["user", "assistant"], "b"), 5: (None, None)}


def test_very_long_texts_of_chats_and_copies(spark):
    long = "word ### </turn>\\ " * 60_000
    chats = chat.format_chat(chat.conversations_as_json(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")))
    r = chats.select(chat.parsed_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t.text for t in r.t] == [long, long] and r.loss == long
    docs = spark.createDataFrame([(1, long), (2, long.replace(" ", "\n")), (3, long + "x")], "doc_id long, text string")
    assert {x.doc_id: (x.keep_id, x.group_size) for x in exact_dedup.exact_dedup(docs).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


# Names of other columns

CLASHING = "id _id _size _s _v _n _c _l _r _b _t _gone gone _parts _keep _source _key meets row lang2 cold_id shard embedding2 key fp doc line words keep_id n text2 rep node component column".split()


def with_clashes(df):
    return df.select("*", *[F.lit(7).alias(c) for c in [*CLASHING, "a.b", "column 0", "column 1"] if c not in df.columns])


@pytest.mark.parametrize(("operator", "schema", "data"), [
    (mixing.mix_sources, "doc_id long, text string, source string", [(1, "a b", "s"), (2, None, None)]),
    (mixing.mixed_documents, "doc_id long, text string, source string", [(1, "a b", "s"), (2, "c", None)]),
    (line_dedup.line_dedup, "doc_id long, text string", [(1, "a b"), (2, "a b")]),
    (embedding_dedup.embedding_dedup, "vec_id long, embedding array<double>", [(1, [1.0, 0.0]), (2, [2.0, 0.0])]),
    (exact_dedup.exact_dedup, "doc_id long, text string", [(1, "a"), (2, "a "), (3, "b")]),
    (chat.format_chat, "doc_id long, json string", [(1, '{"prompt": "a", "response": "b"}'), (2, None)]),
    (main_text.extract_main_text, "page_id long, html string", [(1, "<p>x</p>")]),
])
def test_other_columns_come_along(spark, operator, schema, data):
    df = spark.createDataFrame(data, schema)
    plain, more = operator(df), operator(with_clashes(df))
    added = [c for c in with_clashes(df).columns if c not in df.columns and c not in plain.columns]
    got = more.collect()
    assert got and all(r[c] == 7 for r in got for c in added)
    assert sorted(map(repr, more.select(*[f"`{c}`" for c in plain.columns]).collect())) == sorted(map(repr, plain.collect()))


# Exact copies


@pytest.mark.parametrize("budget", [2_000, 20_000, 10**9])
def test_trie_with_and_without_spill(budget):
    rng, want = random.Random(1), {}
    trie = exact_dedup.PatriciaTrie(budget, tempfile.mkdtemp())
    for i in range(4000):
        key = b"common" * rng.randint(0, 1) + bytes(rng.choices(b"ab", k=rng.randint(0, 9)))
        owner = (-rng.randint(0, 5), False, i, 1, "d")
        trie.add(key, owner)
        want[key] = exact_dedup.better(want[key], owner) if key in want else owner
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want


def test_hot_and_cold_copies(spark, monkeypatch):
    data = [(i, "hot" if i % 2 else f"t{i % 30}") for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(map(tuple, exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect()))
    monkeypatch.setattr(shared, "HOT_SHARE", 10)
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect())) == want
    first = {}
    for i, t in data:
        first.setdefault(t, i)
    assert want == sorted((i, first[t], sum(u == t for _, u in data), first[t] == i) for i, t in data)


def test_exact_edges(spark):
    df = spark.createDataFrame([(3, "a b", 1), (2, "ab ", 1), (9, "a  b", 1), (None, None, 1), (7, " \n", 1), (7, " \n", 1)], "doc_id long, text string, kept int")
    out = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert out == [(0, 7, 3, False), (2, 9, 3, False), (3, 9, 3, False), (7, 7, 3, True), (7, 7, 3, True), (9, 9, 3, True)]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


# Quality


class PlainKneserNey:
    """Interpolated modified Kneser-Ney bigrams with dictionaries, written from the formulas."""

    def __init__(self, texts, types):
        self.n, self.context = Counter(), Counter()
        for t in texts:
            words = [" ", *t.split(), " "]
            for pair in zip(words, words[1:]):
                self.n[pair] += 1
                self.context[pair[0]] += 1
        self.follow = Counter(w for _, w in self.n)
        self.d, self.lower_d = self.discounts(self.n.values()), self.discounts(self.follow.values())
        self.spare = Counter()
        for (c, _), n in self.n.items():
            self.spare[c] += self.d[min(n, 3)]
        self.types = types
        left = sum(self.lower_d[min(f, 3)] for f in self.follow.values())
        self.even = left / len(self.n) / (len(types) + 3)  # the types, the edge, and two shares for all other words

    @staticmethod
    def discounts(values):
        n = [max(sum(v == i for v in values), 1) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
        return {0: 0.0, **{i + 1: min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)}}

    def p(self, word, context):
        if word == " " or word in self.types:
            f = self.follow[word]
            lower = max(f - self.lower_d[min(f, 3)], 0) / len(self.n) + self.even
        else:
            lower = 2 * self.even
        total, n = self.context[context], self.n[context, word]
        if not total:
            return lower
        return max(n - self.d[min(n, 3)], 0) / total + self.spare[context] / total * lower

    def perplexity(self, text):
        words = [" ", *text.split(), " "]
        logs = [math.log(self.p(w, c)) for c, w in zip(words, words[1:])]
        return math.exp(-sum(logs) / len(logs))


def test_plain_model_sums_to_one():
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", weights=range(1, 9), k=30)) for _ in range(9)]
    model = PlainKneserNey(texts, set("abcdefghxyz"))
    for c in "ah q":
        assert sum(model.p(w, c) for w in [*model.types, " ", "other"]) == pytest.approx(1)


def plain_perplexities(texts, trusted):
    types = {w for i in trusted & set(texts) for w in texts[i].split()}
    models = [PlainKneserNey([texts[i] for i in trusted & set(texts) if quality.fold_of(i) == fold], types) for fold in (0, 1)]
    return {i: models[1 - quality.fold_of(i)].perplexity(t) for i, t in texts.items()}


def test_quality_perplexity_matches_plain_python(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_scores(documents, labels).collect()}
    want = plain_perplexities(dict(rows(documents.select("doc_id", "text"))), {r.doc_id for r in labels.where("quality = 1").collect()})
    assert {i: r.perplexity for i, r in got.items()} == pytest.approx(want)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept = [np.mean([got[d].kept for d in truth if d in got and truth[d] == q]) for q in (0, 1)]
    assert kept[1] > 0.97 and kept[0] < 0.5


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, None, None, 1.0), (1, "", "en", 2.0), (1, "a b", "en", 2.0)], "doc_id long, text string, lang string, threshold double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels).collect()
    own = quality.fold_of(1)
    assert len(out) == 3 and all(r.kept for r in out)  # one label says that document 1 isn't known to be good
    good = quality.quality_scores(docs, labels.where("quality = 1")).collect()
    assert len(good) == 3 and all(r.kept and (r.perplexity is None) == (quality.fold_of(r.doc_id) == own) for r in good)
    clash = docs.selectExpr("*", "1 AS id", "2 AS _id", "3 AS _lang", "4 AS most", "5 AS row", "6 AS lang2", "7 AS _key", "8 AS `a.b`")
    assert {(r.id, r._id, r._lang, r.most, r.row, r._key, r["a.b"]) for r in quality.quality_scores(clash, labels.where("quality = 1")).collect()} == {(1, 2, 3, 4, 5, 7, 8)}
    assert quality.quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_every_trusted_type_has_its_own_counts(spark):
    rng = random.Random(8)
    frequent, rare = [f"w{i}" for i in range(30)], iter(range(10**9))
    texts = {}
    for i in range(600):  # 54,000 types, each in two documents or more of one fold or both
        texts[i] = " ".join(x for _ in range(45) for k in (next(rare),) for x in (rng.choice(frequent), f"r{k}", f"s{k}"))
    copies = {1000 + i: t for i, t in texts.items()}
    texts |= copies
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in texts], "doc_id long, quality int")
    got = {r.doc_id: r.perplexity for r in quality.quality_scores(docs, labels).collect()}
    assert len({w for t in texts.values() for w in t.split()}) > 50_000
    assert got == pytest.approx(plain_perplexities(texts, set(texts)))


def test_quality_is_the_same_at_any_sharding(spark, documents, monkeypatch):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    want = {r.doc_id: r.perplexity for r in quality.quality_scores(documents, labels).collect()}
    for name, value in (("SHARDS", 1), ("SHARD_WORDS", 3_000), ("SLICE_WORDS", 1_000)):
        monkeypatch.setattr(quality, name, value)
    got = {r.doc_id: r.perplexity for r in quality.quality_scores(documents.repartition(5), labels).collect()}
    assert got == pytest.approx(want)
