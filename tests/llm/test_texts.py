"""Sharding, BPE, HTML, LM scores, decontamination and the pipeline on small tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_near_dup import shingle_set
from texts import corpus, prose

import corpus_pipeline
from cubespark.llm import bpe, decontaminate, fingerprints, html_text, lm_score, shards

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# sharding


@pytest.mark.parametrize("count", [1, 3, 24])
def test_shards(spark, documents, count):
    pairs = corpus() + [(100 + i, prose(50 + i % 40, 20 + i % 90)) for i in range(300)]
    got = shards.shard_by_size(documents(pairs), count).collect()
    size = lambda t: len((t or "").encode()) + 8
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in pairs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    by = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    mean = sum(size(t) for _, t in pairs) / count
    unit = max(max(size(t) for _, t in pairs), mean / 10)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - mean) <= unit


def test_hot_group_is_spread_over_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(shards, "CELL_ROWS", 20)
    pairs = [(i, "copy " * 20) for i in range(500)] + [(1000 + i, prose(i, 20)) for i in range(500)]
    got = shards.shard_by_size(documents(pairs), 8).collect()
    bytes_of = Counter()
    for r in got:
        bytes_of[r["shard"]] += r["size"]
    assert max(bytes_of.values()) - min(bytes_of.values()) < 1500
    for s in bytes_of:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_equal_rows_are_spread(spark, documents, monkeypatch):
    """Rows that are equal in every column, and without ids, still go to cells of bounded size."""
    monkeypatch.setattr(shards, "CELL_ROWS", 20)
    steps = shards.Steps(spark)
    rows = steps.kept(shards.sized(documents([(None, "copy " * 20)] * 500 + [(7, "x" * 30)] * 500), "doc_id", "text"), "rows")
    cells = shards._place(steps, rows.selectExpr("*", "0 as range"), []).groupBy("range", "cell").count().collect()
    assert max(r["count"] for r in cells) < 60
    got = shards.shard_by_size(documents([(None, "copy " * 20)] * 400), 4).collect()
    assert Counter(r["shard"] for r in got) == {0: 100, 1: 100, 2: 100, 3: 100}


def test_small_groups_stay_together(spark, documents):
    pairs = [(i, prose(i // 3, 40)) for i in range(600)]
    where = {}
    for r in shards.shard_by_size(documents(pairs), 5).collect():
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_no_rows_to_shard(spark, documents):
    assert shards.shard_by_size(documents([]), 24).collect() == []


# byte-level BPE


def ranks():
    with open(PATH, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


def odd_texts():
    draw = random.Random(8)
    kinds = ["a", " ", "ab ", "=", "!? ", "\n ", "0", "haou ", "é", "ouo n", "%$* '", " 's", "  ", " ", "\x1c ", "\x85 ", "日本 ", "😀", "  x"]
    return ["".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(0, 60))) for _ in range(3000)] + [
        "x" * 5000,
        " " * 3000,
        "<|endoftext|> and it's we'll I'D",
        "a  b   c ",
        " lead",
        "tail ",
        "퟿ \U0010ffff",
    ]


def test_ids_equal_the_other_library(other):
    codec = bpe.Codec(bpe.build(ranks(), public_tokenizers.PATTERN))
    for text in odd_texts() + [t or "" for _, t in corpus()]:
        ids = codec.encode(text)
        assert ids.tolist() == other.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_character(other):
    codec = bpe.Codec(bpe.build(ranks(), public_tokenizers.PATTERN))
    for code in [*range(0x3100), *range(0xA000, 0xD800, 61), *range(0xE000, 0x110000, 997)]:
        text = f"a{chr(code)} {chr(code)}b {chr(code)} 1"
        assert codec.encode(text).tolist() == other.encode_ordinary(text), hex(code)


def test_other_patterns_are_not_cut(spark, documents):
    """Ids under a pattern that joins words across spaces are those of the other library."""
    pattern = r"[a-z]+ [a-z]+|\s|\S"
    plain = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks(), special_tokens={})
    texts = ["the end of it", "one two three", " lead and  two"]
    got = bpe.encode(documents(list(enumerate(texts))), PATH, pattern).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {i: plain.encode_ordinary(t) for i, t in enumerate(texts)}


def test_full_caches_change_nothing(other, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    codec = bpe.Codec(bpe.build(ranks(), public_tokenizers.PATTERN))
    for text in [prose(i, 60) for i in range(30)]:
        assert codec.encode(text).tolist() == other.encode_ordinary(text)


def test_digests(spark, documents, other):
    got = bpe.digests(documents(corpus()), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in corpus():
        ids = other.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert bpe.digests(documents([]), PATH, public_tokenizers.PATTERN).collect() == []


def test_encode_and_decode_as_tables(spark, documents):
    pairs = [(i, t) for i, t in corpus() if i is not None and i != 15]
    encoded = bpe.encode(documents(pairs), PATH, public_tokenizers.PATTERN)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    for i, t in pairs:
        ends, chars = rows[i]["byte_ends"], rows[i]["char_ends"]
        raw = (t or "").encode()
        assert len(ends) == len(rows[i]["ids"]) and (ends[-1] if ends else 0) == len(raw)
        for byte, char in zip(ends, chars):
            assert len(raw[:byte].decode(errors="ignore")) == char
    decoded = {r["doc_id"]: r for r in bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()}
    assert {i: r["text"] for i, r in decoded.items()} == {i: t or "" for i, t in pairs}


# HTML


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="home-ad"><header><h1>Site</h1><p>Welcome to the site of sites</p></header>
<nav><ul><li><a href="/a">Menu one</a></li><li>two</li></ul></nav><div class="cookie-notice">We use cookies, a long line of text it is, longer than others.</div>
%s<aside>Side text</aside><form><input value="x">Search <button>Go</button></form>
<div id="comments"><h2>Comments</h2><article><p>First! This reader comment is a long one, longer than any line of text here.</p></article></div>
<footer>&copy; 2024 &middot; all</footer></body></html>"""
BODY = "<h1>The &amp; title</h1>\n<p>A first   paragraph with <b>bold</b> and <a href='#'>a link</a> of some length.<br>More of it.</p><p>Short.</p><ul><li>item one<li>item two</ul><table><tr><td>c1<td>c2</table><p>Last &lt;one&gt; &#233;&nbsp;end &am"
TEXT = "The & title A first paragraph with bold and a link of some length. More of it. Short. item one item two c1 c2 Last <one> é end &am"


@pytest.mark.parametrize(
    "wrap",
    [
        "<article>%s</article>",
        "<main><article><header>%s</header></article></main>",
        "<main>%s<div class='share social'>Share this</div></main>",
        "<div class='content'>%s<div class='advert'>Buy now, buy a lot of it, it is good for you.</div></div>",
    ],
)
def test_main_text(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)) == TEXT


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("  ", ""),
        ("just text", "just text"),
        ("<p>a<p>b<b>c", "a bc"),
        ("<article><p>cut in the mid", "cut in the mid"),
        ("<article>x<script>var a = 1;</article>", "x"),
        ("<article><p>one</p><!-- <p>no</p> --><p hidden>no</p><p>two</p></article>", "one two"),
        ("<div><p>" + "word " * 30_000 + "</p></div>", ("word " * 30_000).strip()),
        ("<" * 50, "<" * 50),
    ],
)
def test_main_text_of_odd_pages(html, text):
    assert html_text.main_text(html) == text


LONG = "A line of text that is long enough to be content, and then some more of it."


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<body><article><p>{LONG}</p></article><article><p>{LONG} Twice.</p><p>Short.</p></article></body>", f"{LONG} {LONG} Twice. Short."),
        (f"<main><h1>Title</h1><article><p>{LONG}</p></article></main>", f"Title {LONG}"),
        (f"<div><h1>Title</h1><article><p>{LONG}</p></article></div>", f"Title {LONG}"),
        (f"<body><div><h1>A title of some length</h1><div class=body><p>{LONG * 9}</p></div></div></body>", f"A title of some length {LONG * 9}"),
        (f"<div class='has-sidebar'><p>{LONG}</p><p>{LONG}</p><div class=sidebar>Side.</div></div>", f"{LONG} {LONG}"),
        (f"<div id='social-science'><article><p>{LONG}</p></article></div>", LONG),
        (f"<article><p>{LONG}</p></article><div class='comment-list'><article><p>{LONG * 5}</p></article></div>", LONG),
        (f"<div class='with-comments'><p>{LONG}</p><p>{LONG}</p><div class=comments>First!</div></div>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG} <span class='ad'>Buy!</span>End.</p></article>", f"{LONG} End."),
        (f"<body><form><div><article><p>{LONG}</p><button>Send</button></article></div></form></body>", LONG),
        (f"<body><form><p>{LONG}</p><p>{LONG}</p><nav><a href='#'>Home</a></nav></form></body>", f"{LONG} {LONG}"),
        (f"<nav><a href='#'>Home</a><article><p>{LONG}</p></article>", LONG),
        (f"<article><button>Like<p>{LONG}</p><p>{LONG}</p></article>", f"Like {LONG} {LONG}"),
        (f"<article><p class='social-science'>{LONG}</p><p>{LONG}</p><h2 id='share-price'>{LONG}</h2></article>", f"{LONG} {LONG} {LONG}"),
        (f"<article><p>{LONG * 9}</p><p>{LONG * 9}</p><p class=share><a href='#'>f</a> <a href='#'>t</a></p></article>", f"{LONG * 9} {LONG * 9}"),
        (f"<div><p>{LONG}</p></div><footer>{LONG} {LONG} long</footer>", LONG),
    ],
)
def test_main_text_is_whole(html, text):
    assert html_text.main_text(html) == text


def test_ratios_decide(monkeypatch):
    """Where the markup says nothing, lines of many tags and links are left out by their ratios."""
    links = "".join(f"<li><a href='#'>Link {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><p>{LONG * 3}</p><p>{LONG * 4}</p></div><div><ul>{links}</ul></div></body>"
    assert html_text.main_text(page) == f"{LONG * 3} {LONG * 4}"
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: np.ones(len(ratios)))
    assert html_text.main_text(page.replace("href", "x").replace("<a", "<b").replace("</a", "</b")) != f"{LONG * 3} {LONG * 4}"


def test_extract(spark):
    rows = [(1, "u", "<article>a</article>", "x"), (1, "u", "<article>a</article>", "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).collect() == []


# LM scores


def brute_scores(pairs, target):
    """Counting words and pairs of words one by one."""
    texts = [(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split(), i is not None and i in target) for i, t in pairs]
    m = lm_score.SMOOTHING

    def counts(keep):
        single, double = Counter(), Counter()
        for words, mine in texts:
            if words and (keep or mine):
                single.update([None, *words])
                double.update(zip([None, *words], words))
        return single, double, sum(len(w) for w, mine in texts if keep or mine)

    every, wanted = counts(True), counts(False)
    out = []
    for words, _ in texts:
        losses = []
        for single, double, total in (wanted, every):
            loss = 0.0
            for h, w in zip([None, *words], words):
                alone = (single[w] + m * every[0][w] / every[2]) / (total + m)
                loss -= math.log((double[h, w] + m * alone) / (single[h] + m))
            losses.append(loss / len(words) if words else None)
        out.append((len(words), *losses, losses[0] - losses[1] if words else None))
    return out


@pytest.mark.parametrize("block,names", [(lm_score.BLOCK_BYTES, lm_score.RANGE_NAMES), (3000, 300)])
def test_lm_scores_against_brute_force(spark, documents, monkeypatch, block, names):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_score, "RANGE_NAMES", names)
    pairs = corpus() + [(100 + i, prose(200 + i % 30, 15 + i % 40)) for i in range(90)]
    ids = spark.createDataFrame([(1,), (5,), (5,), (None,), (999,), (103,)], "doc_id long")
    got = lm_score.score(documents(pairs), ids).collect()
    want = [(i, *b) for (i, _), b in zip(pairs, brute_scores(pairs, {1, 5, 103}))]
    key = lambda r: (str(r[0]), r[1], str(r[2])[:4])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and (g[2:] == pytest.approx(w[2:], abs=1e-9) if w[2] is not None else g == w)


def test_lm_lists_of_names():
    draw = np.random.default_rng(6)
    for n in (1, 2, 5, 400, 100_000):
        for high in (1 << 40, 1 << 63):
            names = np.unique(draw.integers(0, high, n, np.uint64))
            assert (lm_score.unpacked(lm_score.packed(names), len(names)) == names).all()
    close = np.arange(1 << 60, (1 << 60) + 1000, dtype=np.uint64)
    assert len(lm_score.packed(close)) == 8 + 999 * 6


def test_lm_words_of_long_texts(monkeypatch):
    text = (prose(4, 2000) + " " * 500 + "x" * 700 + " end").encode()
    flat, offsets = np.frombuffer(b"first one" + text + b"last", np.uint8), np.array([0, 9, 9 + len(text), 13 + len(text)])
    whole = lm_score.words_of(flat, offsets)
    monkeypatch.setattr(lm_score, "SEGMENT", 200)
    monkeypatch.setattr(fingerprints, "SEGMENT", 200)
    cut = lm_score.words_of(flat, offsets)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_lm_scores_of_an_empty_table(spark, documents):
    ids = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(documents([]), ids).collect() == []
    assert len(lm_score.score(documents(corpus()[:9]), ids).collect()) == 9
    assert [tuple(r) for r in lm_score.score(documents([(1, ""), (2, None)]), ids).orderBy("doc_id").collect()] == [
        (1, 0, None, None, None), (2, 0, None, None, None)
    ]


# decontamination


ITEMS = "item_id long, text string, doc_id string, q int"


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ITEMS)


def held(pairs, items):
    out = set()
    for i, t in pairs:
        own = shingle_set(t)
        for j, s in items:
            q = shingle_set(s)
            if q and 5 * len(q & own) >= 4 * len(q):
                out.add((i, j, len(q), len(q & own)))
    return out


def leaky():
    long = prose(6, 20_000).split(" ")
    item = prose(70, 40)
    words = item.split(" ")
    one_off = words.copy()
    one_off[1] = "changed"
    half = words[:20] + ["x"] * 20
    docs = corpus() + [
        (30, " ".join(long[:9000] + words + long[9000:])),
        (31, "a b " + " ".join(one_off) + " c"),
        (32, " ".join(half)),
        (33, "".join(c.upper() if c.isascii() else c for c in item)),
        (34, prose(71, 5) + " " + prose(72, 6)),
        (None, "at the " + item),
    ]
    items = [(1, item), (1, item), (2, prose(73, 6)), (3, None), (4, ""), (5, "one two three"), (6, prose(72, 6)), (None, prose(71, 5)), (7, prose(14, 300))]
    return docs, items


def test_containment_against_brute_force(spark, documents):
    docs, items = leaky()
    got = {tuple(r) for r in decontaminate.contained(documents(docs), items_of(spark, items)).collect()}
    assert got == held(docs, items) and (30, 1) in {r[:2] for r in got}


def test_clean_and_empty_tables(spark, documents):
    docs, items = leaky()
    out = decontaminate.clean(documents(docs), items_of(spark, items))
    assert out.columns == documents([]).columns
    # each row by its own text
    clean = [i for i, t in docs if not held([(0, t)], items)]
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, clean))
    assert decontaminate.contained(documents([]), items_of(spark, items)).collect() == []
    assert decontaminate.clean(documents(docs), items_of(spark, [])).count() == len(docs)


def test_clean_judges_rows_and_not_ids(spark, documents):
    item = prose(70, 40)
    docs = [(None, "before " + item), (None, prose(1, 30)), (5, item + " after"), (5, prose(2, 30)), (6, None)]
    odd = documents(docs).withColumnsRenamed({"lang": "_held", "source": "name", "n": "row"})
    out = decontaminate.clean(odd, items_of(spark, [(1, item)]))
    assert out.columns == odd.columns
    assert sorted((str(r["doc_id"]), r["text"], r["name"]) for r in out.collect()) == sorted(
        [("None", prose(1, 30), "s"), ("5", prose(2, 30), "s"), ("6", None, "s")], key=str
    )


def test_short_items_match_whole_texts_only(spark, documents):
    docs = [(1, "one two three"), (2, "zero one two three four five six"), (3, "One  TWO three\n")]
    got = decontaminate.contained(documents(docs), items_of(spark, [(9, "one two three")])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]


def test_no_python_on_native_paths(spark, documents):
    docs, items = leaky()
    for df in (decontaminate.contained(documents(docs), items_of(spark, items)), shards.shard_by_size(documents(docs), 4)):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("MapInArrow", "MapInPandas", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"))


# pipeline


def test_stages_on_their_own_input(spark, documents, tmp_path):
    docs, items = leaky()
    docs = [(i, t) for i, t in docs if i is not None]
    items_of(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(i not in (12, 13))) for i, _ in docs]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table = documents(docs)
    at = dict(corpus_pipeline.STAGES)
    assert list(at) == [name for name, _ in corpus_pipeline.STAGES] and len(at) == 5
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        before, table = table, spark.read.parquet(f"{tmp_path}/stage{n}")
        if n < 4:
            assert table.columns == before.columns
    assert table.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = {r["doc_id"] for r in table.collect()}
    assert not kept & {2, 3, 30, 31, 33}  # copies and leaks are gone
    assert {1, 5, 6, 14} <= kept  # clean documents stay
