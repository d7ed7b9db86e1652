"""The training-data operators against brute force, exact round trips and held-out accuracy; edge rows of each."""

import binascii
import hashlib
import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querysieve.llm import components, ctw, decontaminate, jaccard, language, linelog, pieces, queries, shards, suffixes, template, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, blanks, repeated rows, a very long text, ties.
EDGES = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 3), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "one", "fr", None, 3),
    (6, "word " * 20_000, "en", "s", 100_000), (7, "123 !?", "en", "s", 6), (8, "éàü ñ 日本 😀", "fr", "s", 10), (9, "a b c d", "en", "s", 7), (None, "no id at all here", "en", "s", 17),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


# ---- 1


PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body><header class="site"><a href=/>Home</a> Slogan</header>
<nav><ul><li><a href=/a>Menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id="content"><article><header><h1>Title {i}</h1></header><p>First &amp; {a}
 line<p>Second <b>bold</b> {b} line<!-- no --><aside>Aside</aside><form><input><label>Mail</label></form><div class="ad">Buy</div><blockquote>Quoted {a}</blockquote>
<section class="comments"><p>Reader says</p></section></article></div><div class="sidebar"><p>Side {i}</p></div><footer>&copy; x</footer></body></html>"""


def test_template_extracts_the_article(spark):
    rng = random.Random(3)
    word = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
    rows, want = [], {}
    for i in range(30):
        a, b = word(), word()
        rows.append((i, f"http://h{i % 2}.example/{i}", PAGE.format(i=i, a=a, b=b)))
        want[i] = f"Title {i}\nFirst & {a} line\nSecond bold {b} line\nQuoted {a}"
    rows += [(100, "http://h0.example/", None), (101, None, ""), (102, "x", "plain text only"), (103, "http://h0.example/5", rows[5][2])]
    got = {r.page_id: r for r in template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i].text for i in want} == want
    assert got[100].text == got[101].text == "" and got[103].text == want[5] and len(got) == 34
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_template_without_article_element(spark):
    page = "<html><body><div class=top><a href=1>One</a><a href=2>Two</a></div><div class=text><p>{}</p><p>{}</p></div><div class=bottom>Imprint</div></body></html>"
    rows = [(i, "http://h/", page.format(f"long running text number {i} " * 20, f"more of it {i * 7} " * 20)) for i in range(10)]
    got = template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert all(len(r.text.split("\n")) == 2 and r.text.startswith("long running") for r in got)


def test_template_on_the_pages(spark):
    def truth(h):
        body = re.split("</article>|<footer>", h.split("<article>", 1)[-1] if "<article>" in h else "")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", body))
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in blocks]
        return "\n".join(x for x in blocks if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op1_template(spark, SF).collect()
    assert len(got) == len(pages) and all(r.text == truth(pages[r.page_id]) for r in got)


def test_equivalence_classes():
    pages = [template.parse(f"<body><ul>{'<li><a>x</a></li>' * n}</ul><p>{'w' * n}</p></body>") for n in (1, 2, 3)]
    template.name_tokens(pages)
    classes = template.equivalence_classes(pages)
    assert [len(c) for c in classes] == [6, 5] and classes[1][0].endswith("<li") and "/body/ul x" in classes[1]


def neutral_page(rng, i, comments, names):
    """Containers that no element and no name tells apart: a menu, an article with a notice and readers' comments in it, an advert."""
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    c = (lambda x: f' class="{x}"') if names else (lambda x: "")
    title, paragraphs = word(5), [word(rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f"<a href=/{j}>{x} {i if j == 3 else ''}</a>" for j, x in enumerate("One Two Three Four Five Six".split()))
    told = "".join(f"<div{c('q')}><div{c('r')}>{word(2)} on day {rng.randint(1, 30)}</div><p>{word(rng.randint(5, 25))}</p><div{c('s')}><b>{rng.randint(0, 9)}</b> agree</div></div>" for _ in range(comments))
    notice = "All that stands here stands here without any warranty, express or implied, and nobody answers for it. " * 4
    article = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs) + f"<div{c('n')}>{notice}</div><div{c('o')}>{told}</div>"
    html_ = f"<html><body><div{c('a')}>{menu}</div><div{c('b')}><div{c('m')}>{article}</div></div><div{c('z')}>Buy {word(3)} now, <b>cheap</b></div></body></html>"
    return html_, "\n".join([title, *paragraphs])


@pytest.mark.parametrize("names", [True, False])
@pytest.mark.parametrize("comments", [lambda rng: rng.randint(0, 6), lambda rng: 4])
def test_slots_decide_without_elements_and_names(monkeypatch, names, comments):
    rng = random.Random(21)
    pages = [neutral_page(rng, i, comments(rng), names) for i in range(30)]
    assert template.extract_all([h for h, _ in pages]) == [t for _, t in pages]
    monkeypatch.setattr(template, "equivalence_classes", lambda pages: [])
    without = template.extract_all([h for h, _ in pages])
    assert sum(a == t for a, (_, t) in zip(without, pages)) == 0


def test_template_of_edges(spark):
    schema = "page_id long, url string, html string"
    assert template.main_text(spark.createDataFrame([], schema)).count() == 0
    long = "<html><body><nav><a href=/>x</a></nav><article>" + "<p>some words of a very long page</p>" * 30_000 + "</article></body></html>"
    rows = [(None, None, None), (None, "http://a/", "<p>x"), (1, None, long), (1, None, long), (2, "http://b/", ""), (3, "http://b/", "<" * 1000), (4, "http://b/", "<div>" * 3000 + "deep")]
    got = template.main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text.count("\n") for r in got if r.page_id == 1] == [29_999] * 2 and {r.text for r in got if r.page_id == 2} == {""}


@pytest.mark.parametrize("n", [59, 61, 119, 121, 200])
def test_no_page_is_a_template_of_its_own(spark, n):
    rng = random.Random(n)
    pages = [neutral_page(rng, i, rng.randint(0, 5), True) for i in range(n)]
    rows = [(i, f"http://one.example/{i}", h) for i, (h, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(pages)}


# ---- 2


def test_codec_is_the_library(docs, edges):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    for df in (docs, edges):
        rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(df, queries.model_file()).collect()}
        for d in df.collect():
            ids = lib.encode(d.text or "")
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) in rows


def test_codec_on_hostile_texts():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=queries.model_file()), pieces.codec(queries.model_file())
    rng, vocabulary = random.Random(5), list(own.ids)
    for _ in range(3000):
        s = "".join(rng.choice([rng.choice(vocabulary), rng.choice(["ab", "tion", " the"]), rng.choice(" \n\té日▁😀\x00#<s>"), " " * rng.randint(1, 40)]) for _ in range(rng.randint(0, 10)))
        ids = own.encode(s).tolist()
        assert ids == lib.encode(s) and own.decode(ids) == lib.decode(ids)


def test_codec_keeps_rows_and_columns(edges, none):
    out = pieces.encode(edges.withColumn("ids", F.lit("clash")), queries.model_file())
    assert out.count() == len(EDGES) and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    assert pieces.digests(none, queries.model_file()).count() == 0


# ---- 3


def repeated_words(texts, n=50):
    first, cover = {}, defaultdict(set)
    for i, w in texts.items():
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            if k in first and first[k] != (i, p):
                j, q = first[k]
                cover[i] |= set(range(p, p + n))
                cover[j] |= set(range(q, q + n))
            else:
                first[k] = i, p
    return {i: c for i, c in cover.items() if c}


def test_repeated_passages(spark, docs):
    rng = random.Random(2)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [new(n) for n in (50, 51, 60, 200, 49)]
    rows = [(1000 + 10 * i + j, " ".join(new(rng.randint(0, 80)) + p + new(rng.randint(0, 80)))) for i, p in enumerate(shared) for j in range(3)]
    rows += [(2000 + i, " ".join(new(120))) for i in range(20)] + [(3000, None), (3001, ""), (3002, " ".join(shared[3])), (3003, " ".join(shared[3])), (3004, " ".join(new(30)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in df.collect()}
    want = repeated_words(texts)
    got = {r.doc_id: r for r in suffixes.repeats(df).collect()}
    assert set(got) == set(want)
    covered = {i: {x for s in r.spans for x in range(s.start, s.end)} for i, r in got.items()}
    assert covered == want and all(r.n_repeated == len(covered[i]) and r.others for i, r in got.items())
    again = {r.doc_id: r for r in suffixes.repeats(df.repartition(7)).collect()}
    assert again == got == {r.doc_id: r for r in suffixes.repeats(df.coalesce(1)).collect()}
    few = {r.doc_id: {x for s in r.spans for x in range(s.start, s.end)} for r in suffixes.repeats(df, passage=31).collect()}
    assert few == repeated_words(texts, 31)


def test_parts_of_keys():
    keys = np.array([1] * 3 + [2] + [3] * 9 + [4] * 2 + [5] * 2)
    assert suffixes.parts_of(keys, 4) == [(0, 4), (4, 13), (13, 17)] and suffixes.parts_of(keys[:0], 4) == []
    assert suffixes.parts_of(keys, 100) == [(0, 17)] and suffixes.parts_of(keys, 1) == [(0, 3), (3, 4), (4, 13), (13, 15), (15, 17)]


def words_of_others(texts, n=50):
    at, cover = defaultdict(set), defaultdict(set)
    for i, w in texts.items():
        for p in range(len(w) - n + 1):
            at[tuple(w[p : p + n])].add((i, p))
    for places in at.values():
        if len({i for i, _ in places}) > 1:
            for i, p in places:
                cover[i] |= set(range(p, p + n))
    return dict(cover)


def test_passages_across_documents_only(spark):
    rng = random.Random(14)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    own, both, notice = new(70), new(60), new(150)
    texts = {0: own + new(9) + own, 1: both + new(3) + both + new(5), 2: new(4) + both + own[:49], 3: own[:20] + new(60)} | {10 + i: notice + new(i % 2) + (notice if i % 3 else []) for i in range(40)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    for n in (1, 6):
        got = {r.doc_id: {x for s in r.spans for x in range(s.start, s.end)} for r in suffixes.repeats(df.repartition(n), within=False).collect()}
        assert got == words_of_others(texts) and 0 not in got and 1 in got


def test_a_passage_of_very_many_documents(spark):
    """Batches that hold many suffixes with all words alike, and some that differ beside the passage."""
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    notice, inner = new(140), new(55)
    texts = {i: new(rng.randint(0, 40)) + (notice if i % 3 else inner) + [f"x{rng.randrange(3)}"] + new(rng.randint(0, 40)) for i in range(300)}
    texts[300] = inner + new(5) + inner
    want = repeated_words({i: [w.encode() for w in t] for i, t in texts.items()})
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.repeats(df.repartition(3)).collect()}
    assert {i: {x for s in r.spans for x in range(s.start, s.end)} for i, r in got.items()} == want
    assert got == {r.doc_id: r for r in suffixes.repeats(df.coalesce(1)).collect()}


def test_repeats_of_edges(edges, none):
    got = {r.doc_id: r for r in suffixes.repeats(edges).collect()}
    assert set(got) == {6} and got[6].n_repeated == 20_000
    assert suffixes.repeats(none).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeats(none, passage=16)


# ---- 4


def test_language(docs, edges, none):
    got = language.held_out_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)
    rows = language.predict(edges, language.learn(docs)).collect()
    assert len(rows) == len(EDGES) and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert language.predict(none, language.learn(docs)).count() == 0
    assert {r.lang_pred for r in language.predict(docs.limit(3), language.learn(none)).collect()} == {"und"}


def test_rank_order_by_hand():
    codes, counts = language.gram_counts("Ab, ab!")
    names = {}
    for c, n in zip(codes.tolist(), counts.tolist()):
        letters = [(c >> (21 * i)) & 0x1FFFFF for i in (2, 1, 0)]
        names["".join(chr(x) if x else "_" for x in letters).lstrip("_") + ("" if letters[2] else "")] = n
    assert counts.sum() == 4 + 6 + 5  # letters; pairs and triples over "_ab_ab_"
    assert len(language.ranked(codes, counts, 3)) == 3


def test_profiles_are_of_all_rows(spark, monkeypatch):
    """More rows of a language than were once drawn, and sums that tasks pass on many times: every row counts."""
    import corpus_pipeline

    monkeypatch.setattr(language, "HELD", 50)
    rng = random.Random(17)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(12)) for _ in range(12_000)]
    df = spark.createDataFrame([(i, t, "x", "s", 12) for i, t in enumerate(texts)], DOCS)
    sums = Counter()
    for t in texts:
        codes, n = language.gram_counts(t)
        sums.update(dict(zip(codes.tolist(), n.tolist())))
    want = {"x": [c for c, _ in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]}
    assert language.learn(df) == want
    kept = {r.doc_id for r in language.predict(df, want).collect() if r.score >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, df, SF).collect()} == kept


# ---- 5


def closure(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {i: root(i) for i in sets}


def variants(rng, n, base_size, most):
    base = [f"v{rng.randrange(10**6)}" for _ in range(base_size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


def test_jaccard_groups(spark, docs):
    rng = random.Random(11)
    rows = [t for size in (3, 5, 6, 9, 12, 20, 60, 150) for t in variants(rng, 12, size, max(1, size // 25 + 1))]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(25)) + " " + passage for _ in range(60)]
    df = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(rows)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    got = {r.doc_id: r for r in jaccard.groups(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == closure(sets)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("left_out", ["none", "half", "all"])
def test_frequent_shingles_change_no_group(spark, docs, monkeypatch, left_out):
    """Whichever shingles are taken for frequent, and whatever they are said to count: the groups are those of brute force."""
    df = docs.select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    hashes = np.unique(np.concatenate([jaccard.shingle_set((r.text or "").encode()) for r in df.collect()]))
    rng = np.random.default_rng(18)
    some = hashes[rng.random(len(hashes)) < {"none": 0, "half": 0.5, "all": 1}[left_out]]
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda *a: (some, rng.integers(1, 99, len(some))))
    want = closure(sets)
    assert len(set(want.values())) < len(want)
    assert {r.doc_id: r.component_id for r in jaccard.groups(df).collect()} == want


def test_jaccard_of_a_large_group_in_blocks(spark, monkeypatch):
    """A group of near copies, many of them below the threshold to each other, compared block by block."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    want = closure({i: shingles(t) for i, t in enumerate(rows)})
    assert len(set(want.values())) > 3
    assert {r.doc_id: r.component_id for r in jaccard.groups(df).collect()} == want


def test_elements_in_common(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(30)]
    y = np.arange(30)
    for bits in (jaccard.BITS, 0):
        monkeypatch.setattr(jaccard, "BITS", bits)
        common = jaccard.in_common(sets)
        assert all(common(x, y).tolist() == [len(np.intersect1d(sets[x], s)) for s in sets] for x in range(30))


def test_run_rows_follow_the_input(spark):
    """Twice as many groups give twice as many rows, and packed bytes a signature stay the same however many buckets there are."""
    rng = np.random.default_rng(7)
    sets = [(i, np.sort(rng.integers(0, 2**64, 200, dtype=np.uint64))) for i in range(300)]
    size = lambda b: sum(len(x.as_py()) for c in ("sigs", "who", "nodes") for x in b.column(c))
    assert size(jaccard.packed_signatures(sets, 50_000)) <= 18 * 60_000
    one = lambda i: (np.repeat(np.arange(i, i + 50, dtype=np.uint64), 3), np.tile(np.arange(3 * i, 3 * i + 3), 50))
    a, b = jaccard.equal_runs(*one(0)), jaccard.equal_runs(*(np.concatenate(x) for x in zip(one(0), one(50))))
    assert (a.num_rows, b.num_rows) == (50, 100)


def test_jaccard_edges(edges, none):
    rows = jaccard.groups(edges).collect()
    assert len(rows) == len(EDGES) and jaccard.groups(none).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 8), 9: (1, 9), None: (1, None)}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    common = np.sort(draw(200))
    counts = rng.integers(8, 99, 200)
    for _ in range(1500):
        n = int(rng.integers(1, 120)) if rng.random() < 0.7 else int(rng.integers(120, 900))
        base = np.unique(np.concatenate([draw(n), rng.choice(common, int(rng.integers(0, min(n, 150) + 1)), replace=False)]))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.2], draw(int(rng.integers(0, n // 8 + 1)))]))
        both = len(np.intersect1d(base, other))
        if both and 100 * both >= 80 * (len(base) + len(other) - both):
            assert len(np.intersect1d(jaccard.signatures(base, common, counts), jaccard.signatures(other, common, counts)))
            assert jaccard.may_be_similar(len(base), jaccard.bitmap(base), len(other), jaccard.bitmap(other), 80, 100)


@pytest.mark.parametrize("small", [components.SMALL, -1])
def test_components_of_chains_stars_and_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 901), (903, 902), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500 + i: 500 for i in range(60)} | {900: 900, 901: 900, 902: 902, 903: 902}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.components(spark.createDataFrame([(1, None), (None, 2), (3, 1)], "a long, b long")).where("id = 3 and component = 1").count() == 1


def test_contracted_edges():
    rng = np.random.default_rng(9)
    for _ in range(50):
        u, v = rng.integers(0, 60, (2, 40))
        parent = {i: i for i in set(u.tolist()) | set(v.tolist())}

        def root(x, parent=parent):
            return x if parent[x] == x else root(parent[x])

        for x, y in zip(u.tolist(), v.tolist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        ids, least = components.contracted(u, v)
        assert dict(zip(ids.tolist(), least.tolist())) == {i: root(i) for i in parent if root(i) != i}


# ---- 6


def check_shards(df, out, shards_=16):
    rows = out.collect()
    texts = df.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (d.doc_id is not None, d.doc_id or 0, len((d.text or "").encode()) + 1, binascii.crc32((d.text or "").encode())) for d in texts
    )
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < shards_ and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return sizes, rows


def test_shards(spark, docs, edges, none):
    sizes, _ = check_shards(docs, shards.shard(docs))
    fair = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(s - fair) for s in sizes.values()) < 35_000
    check_shards(edges, shards.shard(edges))
    check_shards(none, shards.shard(none))


def test_shards_spread_a_frequent_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 50)).otherwise(F.concat(F.lit("x" * 100), F.col("id"))).alias("text"))
    sizes, rows = check_shards(df, shards.shard(df))
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 16
    by = defaultdict(set)
    for r in shards.shard(df.withColumn("text", F.concat(F.lit("pair " * 10), (F.col("doc_id") % 1500).cast("string")))).collect():
        by[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) < 100


# ---- 7


def test_topk_is_exact(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(0, 0.3, (400, 16)).astype(np.float32)
    v[50:60] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(400, None), (402, [float("nan")] * 16), (403, [None] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 20 == 0, topk.sixty_fourths(), k=20, block=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    w = np.floor(v.astype(np.float64) * 64)
    for q in range(0, 400, 20):
        s = sorted(((-int(w[q] @ w[i]), i) for i in range(400) if i != q))[:20]
        assert got[q] == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert len(got) == 20


def test_topk_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in topk.search(few, F.col("vec_id") == 0, topk.sixty_fourths()).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert topk.search(few.limit(0), F.col("vec_id") == 0, topk.sixty_fourths()).count() == 0


def test_topk_leaves_most_products_out(spark):
    """The pivot table, not brute force, decides what is evaluated."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n = spark.sparkContext.accumulator(0)
    found = topk.search(rows, F.col("vec_id") % 20 == 0, topk.sixty_fourths(), counted=n)
    assert found.count() == 20 * rows.where("vec_id % 20 = 0").count()
    assert 0 < n.value < 0.4 * rows.where("vec_id % 20 = 0").count() * rows.count()


def test_topk_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 20, (300, 12)))
    table = topk.PivotTable(x[:50], 7)
    at, products = table.places(x), x @ x.T
    assert len(table.points) == 7 and (at @ at.T >= products - 1e-6).all()
    # as tight as any triangle inequality over the same pivots
    far = np.sqrt(table.distances(x))
    low = np.abs(far[:, None] - far[None]).max(axis=2)
    norm = (x * x).sum(1)
    assert (at @ at.T <= (norm[:, None] + norm[None] - low**2) / 2 + 0.1).all()


def test_topk_of_ragged_and_repeated_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 1)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [5.0]), (20, [2.0]), (3, []), (None, [9.0, 9.0]), (40, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0, topk.sixty_fourths(), block=1).collect()}
    assert got == {(0, 1, 1, 5 * 4096), (0, 2, 1, 5 * 4096), (20, 1, 2, 10 * 4096)}


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf"), None])
def test_topk_leaves_out_a_vector_with_one_bad_component(spark, bad):
    rows = [(0, [1.0, -0.5, 0.25]), (1, [0.5, 0.0, 0.0]), (2, [0.25, 0.0, 0.0]), (3, [9.0, bad, 0.0]), (20, [9.0, 0.0, bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("vec_id") % 20 == 0, topk.sixty_fourths()).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 64 * 32), (0, 2, 2, 64 * 16)]


# ---- 8


def test_unigram_base_and_model(docs):
    got = {r.doc_id: r for r in ctw.held_out_scores(docs).collect()}
    words = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    held = {i for i in words if binascii.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, ws in words.items() if i not in held for w in ws)
    n, bottom = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / bottom) for w in ws), rel_tol=1e-9)
    # 450 kB teach little; more text teaches more (README)
    assert sum(got[i].bits_per_byte for i in held) / len(held) < 3.5 and all(math.isfinite(r.score) for r in got.values())


def test_ctw_rows(docs, edges, none):
    assert ctw.scores(none, F.lit(True)).count() == 0
    rows = ctw.scores(edges, F.coalesce(F.col("doc_id") != 5, F.lit(True)), depth=2).collect()
    assert len(rows) == len(EDGES) and sum(r.doc_id == 4 for r in rows) == 2
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == 1 and by[1].score == by[2].score < 0 and by[4].score == by[5].score


def test_runs_of_long_texts_come_in_pieces(monkeypatch):
    texts = [b"abc" * 200, None, b"", b"Some text", b"\xff\x00" * 90]
    whole = list(ctw.runs(texts, 3))
    monkeypatch.setattr(ctw, "PIECE", 100)
    parts = list(ctw.runs(texts, 3))
    assert len(whole) == 1 and len(parts) > 6
    for i in (0, 1):
        assert np.concatenate([p[i] for p in parts]).tolist() == whole[0][i].tolist()
    numbers = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (ctw.unsqueezed(ctw.squeezed(numbers, True), True) == numbers).all() and not len(ctw.unsqueezed(ctw.squeezed(numbers[:0])))


def brute_tree(train, depth):
    """log10 probability of a text by the definition, evaluated recursively over all contexts."""
    seen = Counter()
    for t in train:
        s = b"\xff" * depth + t.lower() + b"\xff"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for level in range(8):
                    seen[s[i - d : i], (1 << level) + (s[i] >> (8 - level)), s[i] >> (7 - level) & 1] += 1
    children = defaultdict(set)
    for c, node, _ in seen:
        if c:
            children[c[1:], node].add(c)
    counts = lambda c, node: (seen[c, node, 0], seen[c, node, 1])

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    known = {}

    def log_w(c, node):
        if (c, node) not in known:
            kt = log_kt(*counts(c, node))
            known[c, node] = kt if len(c) == depth else np.logaddexp(kt, sum(log_w(x, node) for x in children[c, node])) + math.log(0.5)
        return known[c, node]

    def p_one(c, d, node):
        own = c[len(c) - d :]
        a, b = counts(own, node)
        if not a + b:
            return None
        kt = (b + 0.5) / (a + b + 1)
        longer = p_one(c, d + 1, node) if d < depth else None
        if longer is None:
            return kt
        w = math.exp(log_kt(a, b) + math.log(0.5) - log_w(own, node))
        return w * kt + (1 - w) * longer

    def score(t):
        s, out = b"\xff" * depth + t.lower() + b"\xff", 0.0
        for i in range(depth, len(s)):
            for level in range(8):
                p = p_one(s[i - depth : i], 0, (1 << level) + (s[i] >> (8 - level)))
                p = 0.5 if p is None else p
                out += math.log10(p if s[i] >> (7 - level) & 1 else 1 - p)
        return out

    return score


@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_scores_are_the_whole_tree_by_definition(spark, docs, monkeypatch, depth):
    for name, value in (("CHUNK", 2000), ("PER_BUCKET", 1500)):  # many chunks and buckets
        monkeypatch.setattr(ctw, name, value)
    rows = [(r.doc_id, r.text[:400]) for r in docs.orderBy("doc_id").limit(25).collect()] + [(1000, None), (1001, ""), (1002, "abracadabra Abracadabra"), (1002, "abracadabra Abracadabra"), (1003, "\x00é日本"), (None, "no id")]
    got = ctw.scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 != 0, depth=depth).collect()
    score = brute_tree([(t or "").encode() for i, t in rows if i is not None and i % 3 != 0], depth)
    want = sorted((i if i is not None else -1, score((t or "").encode())) for i, t in rows)
    assert np.allclose([s for _, s in want], [s for _, s in sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in got)], rtol=1e-5, atol=1e-6)
    assert all(r.held_out == (r.doc_id is None or r.doc_id % 3 == 0) for r in got)


# ---- 9


def test_lines(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    notice = lambda i: f"Copyright notice number {i} of the {word()} company limited"
    rows = [(i, "\n".join([f"own line {word()} {word()} {word()} {word()}", notice(i), "short one", f"last {word()} {word()} {word()} {word()}"])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a b c d e f g"), (102, "a b c d e f g")]
    got = defaultdict(list)
    for r in linelog.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    kept = [i for i in range(40) if "Copyright" in got[i][0].text]
    assert kept == [0] and all(got[i][0].n_dropped == (i > 0) and got[i][0].n_lines == 4 for i in range(40))
    assert all(got[i][0].text.split("\n")[-1].startswith("last") and "short one" in got[i][0].text for i in range(40))
    assert got[100][0].text is None and got[100][0].n_lines == 0 and got[101][0].text == "" and [r.text for r in got[102]] == ["a b c d e f g"] * 2


def brute_lines(texts, least):
    leaves = defaultdict(list)
    for i, t in sorted(texts.items()):
        for p, tokens in linelog._lines(t):
            leaves[linelog.leaf_of(tokens)].append((tuple(tokens), i, p))
    drops = defaultdict(set)
    for rows in leaves.values():
        if len({i for _, i, _ in rows}) < least:
            continue
        often = Counter(x for tokens, _, _ in rows for x in enumerate(tokens))
        by = defaultdict(list)
        for tokens, i, p in rows:
            kept = tuple(t if often[q, t] >= least else None for q, t in enumerate(tokens))
            if sum(t is not None for t in kept) >= 0.6 * len(kept) and sum(t not in (None, linelog.ANY) for t in kept) >= 2:
                by[kept].append((i, p))
        for places in by.values():
            if len({i for i, _ in places}) >= least:
                for i, p in places:
                    if (i, p) != min(places):
                        drops[i].add(p)
    return drops


@pytest.mark.parametrize("most", [linelog.MOST, -1])
def test_lines_against_one_process(docs, edges, none, monkeypatch, most):
    monkeypatch.setattr(linelog, "MOST", most)
    texts = {r.doc_id: r.text for r in docs.collect()}
    drops = brute_lines(texts, 4)
    assert drops
    for r in linelog.clean(docs, least=4).collect():
        lines = texts[r.doc_id].split("\n")
        assert r.text == "\n".join(x for p, x in enumerate(lines) if p not in drops[r.doc_id]) and r.n_dropped == len(drops[r.doc_id])
    assert linelog.clean(edges).count() == len(EDGES) and linelog.clean(none).count() == 0


def test_op9_parses_every_line(spark, tmp_path):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(60))
    kanji = lambda: "".join(rng.choice("一二三四五六七八九十") for _ in range(4))
    rows = [(i, "\n".join(["All rights reserved.", f"Page {i}", " ", f"本作品版权归作者所有转载请注明出处{kanji()}", *([long] if i < 2 else []), f"own {word()}"])) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_lines(spark, str(tmp_path)).collect()}
    for i, x in rows:
        lines = x.split("\n")
        want = lines if not i else [y for y in lines if y.startswith(("Page", "own")) or y == " "]
        assert got[i].text == "\n".join(want) and got[i].n_dropped == len(lines) - len(want)


def test_pipeline_drops_short_lines(spark):
    import corpus_pipeline

    rows = [(i, f"All rights reserved.\n{'abcdefghijkl'[i] * 5} is a line of one document only", "en", "s", 0) for i in range(12)]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert [r.doc_id for r in got if "reserved" in r.text] == [0] and len(got) == 12


def test_a_large_leaf_gives_what_a_small_one_does(spark):
    names = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(1000)]
    for n in (100, 1000):
        rows = [(i, f"the user named {names[i]} has logged in today") for i in range(n)]
        out = linelog.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert sorted(r.doc_id for r in out if not r.n_dropped) == [0]


def test_lines_of_numbers_are_no_template(spark):
    rows = [(i, f"{i} {i + 1} {i * 3} {i + 7} {i * i} {i}") for i in range(30)]
    assert not any(r.n_dropped for r in linelog.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect())


# ---- 10


def brute_hits(text, items):
    words = lambda s: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").encode().lower())
    w, hit, found = words(text), set(), set()
    for name, t in items:
        x = words(t)
        n = min(8, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_decontamination(spark, docs, edges, block):
    bench = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(15).collect())]
    bench += [(50, "a b"), (51, "One"), (52, None), (53, " !"), (7, "a b c d e f g h i")]
    extra = [(900, "x A-b one " + (bench[0][1] or "")), (901, (bench[1][1] or "")[5:] + " a b c d e f g h i j"), (902, None)]
    df = docs.select("doc_id", "text").limit(60).unionByName(spark.createDataFrame(extra, "doc_id long, text string")).unionByName(edges.select("doc_id", "text"))
    found = decontaminate.search(df, spark.createDataFrame(bench, "item_id long, text string"), block=block).collect()
    assert len(found) == df.count()
    for r in found:
        assert (r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) == brute_hits(r.text, [b for b in bench if b[1]]), r.doc_id


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


# ---- all together


def test_extra_columns_may_clash(edges):
    odd = edges.withColumns({"id": F.lit(1), "key": F.lit("k"), "sig": F.lit(2), "hits": F.lit("h"), "n_lines": F.lit(3), "_slot": F.lit(4), "score": F.lit(5)})
    assert jaccard.groups(odd).count() == len(EDGES)
    assert suffixes.repeats(odd).count() == 1
    odd = odd.withColumns({c: F.lit(c) for c in ("_drops", "_k", "_t", "k", "t", "x", "r", "slot", "drops", "lines", "n_dropped")})
    cleaned = linelog.clean(odd)
    assert cleaned.count() == len(EDGES) and set(cleaned.columns) == set(odd.columns) and cleaned.where("_slot = 4 and _t = '_t' and lines = 'lines' and n_dropped = 0").count() == len(EDGES)
    assert {r.mine for r in linelog.clean(odd.withColumn("mine", F.col("n_lines")), counts=("lines_", "dropped_")).collect()} == {3}
    assert ctw.scores(odd, F.lit(True), depth=1).count() == len(EDGES)
    assert decontaminate.search(odd, edges.select(F.col("doc_id").alias("item_id"), "text")).count() == len(EDGES)
    assert language.predict(odd, {"en": [1]}).columns.count("score") == 1
    assert shards.shard(odd).count() == len(EDGES)


def test_results_do_not_depend_on_other_columns(spark, edges):
    """Columns that are named like an operator's own, or like what it works with, change no result."""
    names = ("id", "x", "train", "chunk", "key", "bucket", "kind", "a", "b", "n", "n_tokens", "score", "base_score", "row", "r", "items_", "print", "pos", "name", "s", "node", "sig", "component_id", "size", "_at", "_sub", "shard", "slot")
    odd = edges.withColumns({c: F.lit(c) for c in names})
    rows = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    scored = ("doc_id", "n_tokens", "score", "base_score")
    assert rows(ctw.scores(odd, F.col("doc_id") != 5, depth=2), *scored) == rows(ctw.scores(edges, F.col("doc_id") != 5, depth=2), *scored)
    bench = spark.createDataFrame([("i", "a b c d"), ("j", "word " * 9), (None, "one"), ("k", None)], "item_id string, text string")
    for block in (1 << 20, 1):
        found = decontaminate.search(odd, bench, block=block, added=("w", "h", "i"))
        assert rows(found, "doc_id", "w", "h", "i") == rows(decontaminate.search(edges, bench, added=("w", "h", "i")), "doc_id", "w", "h", "i")
        assert {tuple(r[c] for c in names) for r in found.collect()} == {names}
    grouped = ("doc_id", "n_shingles", "component_id")
    assert rows(jaccard.groups(odd), *grouped) == rows(jaccard.groups(edges), *grouped)
    repeated = ("doc_id", "n_words", "n_repeated", "spans")
    assert rows(suffixes.repeats(odd), *repeated) == rows(suffixes.repeats(edges), *repeated)
    assert rows(shards.shard(odd.where("doc_id is not null")), "doc_id", "size", "shard") == rows(shards.shard(edges.where("doc_id is not null")), "doc_id", "size", "shard")
    digests = ("doc_id", "n_tokens", "ids_sha256")
    assert rows(pieces.digests(odd, queries.model_file()), *digests) == rows(pieces.digests(edges, queries.model_file()), *digests)


def test_pipeline_drops_documents_with_one_planted_item(spark, docs):
    import corpus_pipeline

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    planted = [(9000 + i, f"before it {t} and after it", "en", "s", 0) for i, (_, t) in enumerate(items[:20])]
    part = " ".join(items[0][1].split()[:10])
    more = [(9100, f"x {part} y", "en", "s", 0), (9101, "nothing of it here", "en", "s", 0), (9102, None, "en", "s", 0)]
    both = docs.unionByName(spark.createDataFrame(planted + more, DOCS))
    kept = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, both, SF).collect()}
    hit = {r.doc_id for r in docs.collect() if brute_hits(r.text, items)[1]}
    assert hit and kept == {r.doc_id for r in both.collect()} - hit - {i for i, *_ in planted} - {9100}


def test_pipeline_lines_against_one_process(spark, docs):
    """Templates of ten documents, and short lines that ten documents share, but for the first of each."""
    import corpus_pipeline

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    made = [(5000 + i, "\n".join([f"Filed under number {i} by {word()} of this office", "Read more", "Back", f"own {word()} {word()}"] + ["Share"] * (i % 2)), "en", "s", 0) for i in range(25)]
    rows = docs.unionByName(spark.createDataFrame(made, DOCS))
    texts = {r.doc_id: r.text for r in rows.collect()}
    short = defaultdict(list)
    for i, t in sorted(texts.items()):
        for p, x in enumerate(t.split("\n")):
            if x.split() and len(linelog.tokens_of(x)) < linelog.TOKENS:
                short[" ".join(x.split())].append((i, p))
    drops = brute_lines(texts, 10)
    stay = set()
    for places in short.values():
        if len({i for i, _ in places}) >= 10:
            stay.add(min(places))
            for i, p in places:
                if (i, p) != min(places):
                    drops[i].add(p)
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drops[i] or (i, p) in stay) for i, t in texts.items()}
    assert sum(len(d) for d in drops.values()) > 80
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, rows, SF).collect()}
    assert got == {i: t for i, t in want.items() if t.strip() or t == texts[i]}


def test_pipeline_stages_on_odd_rows(spark, edges, none):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, stage by stage."""
    import corpus_pipeline

    clash = {c: F.lit(c) for c in ("lang_pred", "score", "_lang", "_score", "n_lines", "n_dropped", "hits", "items", "n_words", "row", "_slot", "r", "k", "component_id")}
    odd = edges.withColumns(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and all(r.asDict().items() >= {c: c for c in clash}.items() for r in out.collect())
        assert stage(spark, none, SF).count() == 0
    kept = {n: sorted((r.doc_id or 0, r.text or "") for r in s(spark, odd, SF).collect()) for n, s in corpus_pipeline.STAGES[:-1]}
    all_rows = sorted((i or 0, t or "") for i, t, *_ in EDGES)
    assert {i for i, _ in kept["language"]} == {0, 4, 5, 6, 8, 9} - {i for i, t in all_rows if t == "éàü ñ 日本 😀" and (8, t) not in kept["language"]}
    assert kept["lines"] == kept["decontamination"] == all_rows
    assert kept["near_duplicates"] == [x for x in sorted(set(all_rows)) if x != (5, "one")]
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.encode(spark, odd, SF).collect()) == [i for i, _ in all_rows]


def test_near_duplicates_with_equal_ids(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, c), (None, c), (None, b + " end")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (1, b), (3, c)]


def test_language_by_out_of_place_distance(docs):
    """Profiles and predictions against the definition, gram by gram."""
    train = [(r.lang, r.text) for r in docs.collect() if r.lang is not None and r.text is not None and binascii.crc32(str(r.doc_id).encode()) % 4 != 2]
    profiles = language.learn(docs.where(language.training_rows(docs)))
    sums = {k: Counter() for k in profiles}
    for k, t in train:
        codes, n = language.gram_counts(t)
        for c, m in zip(codes.tolist(), n.tolist()):
            sums[k][c] += m
    for k in profiles:
        assert profiles[k] == [c for c, _ in sorted(sums[k].items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]
    for r in language.predict(docs.select("doc_id", "text").limit(40), profiles).collect():
        codes, n = language.gram_counts(r.text)
        mine = [c for c, _ in sorted(zip(codes.tolist(), n.tolist()), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]
        far = {k: sum(min(language.PROFILE, abs(i - p.index(c))) if c in p else language.PROFILE for i, c in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and math.isclose(r.score, 1 - far[best] / (language.PROFILE * len(mine)), abs_tol=1e-12)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [len(texts)]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if name != "tokens":
            assert docs.columns == before.columns
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.7 * kept[0]
    sets = {r.doc_id: shingles(r.text) for r in spark.read.parquet(str(tmp_path / "lines")).collect()}
    want = closure(sets)
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "near_duplicates")).collect()} == {i for i in want if want[i] == i}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
