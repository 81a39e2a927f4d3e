"""Spelling variants, main text of pages and phrase collocations, against brute force."""

import collections
import html
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gradewell.llm import main_text, phrases, queries, variants
from gradewell.llm.common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_SCHEMA = "doc_id long, text string, lang string, word string, n string, phrase string, root string, at string"
ODD = [None, "", "   ", "...\n\n;;", "a  b\ta b, a b! A B", "İstanbul ΣΑΣ \x85 × ÷ x́", "Colour colours color",
       "colour colours kolour colouur", "x" * 30_000, " ".join(f"word{i % 7} colour" for i in range(4_000))]


def odd_rows(spark, repeat=6):
    rows = [(i, t, lang, "w", "n", "p", "r", "a") for i, (t, lang) in
            enumerate((t, lang) for t in ODD for lang in ("en", None, "und", "")) for _ in range(repeat)]
    return spark.createDataFrame(rows + [(None, "colour colours", None, None, None, None, None, None)] * 3, ODD_SCHEMA)


# ------------------------------------------------------------------ op 11

def brute_words(docs, least_length=6, least=5, every=199):
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words, times=5):
    letters = sorted({c for w in words for c in w})
    form, near = {}, {}
    for w in words:
        edits = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        edits |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in ["", *letters]}
        near[w] = (edits - {w}) & words.keys()
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}, near


def pairs_of(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_variants_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    want, near = brute_forms(brute_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    got = queries.QUERIES["op11_spelling_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    words = spark.createDataFrame([(w, n) for w, _, _, n, _, _ in want], "word string, n long")
    links = variants.neighbours(words).select("word", "near").collect()
    assert sorted(map(tuple, links)) == sorted((w, x) for w, xs in near.items() for x in xs)


def test_variants_of_short_alphabets(spark):
    # all words over two letters: runs of equal letters, long chains, ties, hubs
    words = {"".join("ab"[i >> k & 1] for k in range(size)): 5 ** ((i * 7 + size) % 6) + i % 3
             for size in range(1, 7) for i in range(1 << size)}
    words |= {"cccccc": 1, "cccccd": 6, "ccccdd": 40, "cccddd": 199, "cccdd": 40}      # a chain, and a tie
    want, near = brute_forms(words)
    assert all(one_edit(a, b) for a, bs in near.items() for b in bs)
    got = variants.word_forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == want
    assert any(f is not None and r != f for _, f, r, _, _, _ in want)


def test_variants_odd_rows(spark):
    docs = odd_rows(spark)
    want, _ = brute_forms(brute_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    got = [tuple(r) for r in variants.spelling_variants(docs).collect()]
    assert len(got) == len(want) and set(got) == want
    # every copy is altered; a run may shrink below the least length
    want, _ = brute_forms(brute_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], every=1))
    assert {tuple(r) for r in variants.spelling_variants(docs, every=1).collect()} == want
    assert variants.spelling_variants(docs.limit(0)).collect() == []


def test_variants_of_very_long_words(spark):
    """Lengths around the limit beyond which ranges are hashed, and a word alone of 50,000."""
    base = "".join("abcdefghij"[i * i % 10] for i in range(70))
    words = {base[:k]: 5 + k for k in range(61, 70)} | {"z" * 50_000: 9, "y" * 3_000: 90, "y" * 3_001: 9}
    for k in (63, 64, 65, 66):
        for at in (0, k // 2, k - 1):
            words[base[:at] + "q" + base[at + 1:k]] = 7 * k
            words[base[:at] + "qq" + base[at:k]] = 3
    want, near = brute_forms({w: n for w, n in words.items() if len(w) < 100})
    want |= {("z" * 50_000, None, "z" * 50_000, 9, 0, None), ("y" * 3_000, None, "y" * 3_000, 90, 1, None),
             ("y" * 3_001, "y" * 3_000, "y" * 3_000, 9, 1, 90)}
    table_ = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in variants.word_forms(table_).collect()} == want
    links = variants.neighbours(table_.where(F.length("word") < 100)).select("word", "near").collect()
    assert sorted(map(tuple, links)) == sorted((w, x) for w, xs in near.items() for x in xs)


# ------------------------------------------------------------------ op 12

def article(source):
    body = re.search(r"<article[^>]*>(.*?)(</article>|$)", source, re.S)
    blocks = re.split(r"</?(?:p|h1)[^>]*>", body.group(1).replace("<br>", " ")) if body else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_main_text_equals_the_marked_article(spark):
    pages = {r["page_id"]: r for r in table(spark, SF, "pages").collect()}
    got = queries.QUERIES["op12_main_text"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


def test_learned_weights_part_pages_without_names(spark):
    """Pages the fit has not seen, whose parts have no telling names: tags alone part them."""
    sources = [r["html"] for r in table(spark, SF, "pages").orderBy("page_id").collect()]
    fit = [main_text.read_page(s, parts) for s in sources[:25] for parts in (True, False)]
    weights = main_text.fit_weights([p for p in fit if len(p.articles) == 1])
    assert weights["word"] > 0 and all(w < 0 for f, w in weights.items() if not main_text.is_word(f))
    assert weights["word"] != main_text.START["word"]
    for s in sources[25:]:
        page = main_text.read_page(s, parts=False)
        a, b = main_text.best_region(weights.scores(page))
        (x, y), = page.articles
        inside = [t for t in page.tokens[x:y] if t[3].strip()]
        if sum(n for _, n, _, _ in inside) < 40:       # an advert may be the longer text
            continue
        assert [t for t in page.tokens[a:b] if t[3].strip()] == inside


BODY = "<p>" + " ".join(f"word{i}" for i in range(40)) + ".</p>"
TEXT = " ".join(f"word{i}" for i in range(40)) + "."
PAGES = {
    "<body><nav><a href=x>Home</a> <a>b</a></nav><article><h1>Title</h1>" + BODY + "<div class='ad'>buy this "
    + "x " * 30 + "</div><p>last bit.</p></article><div id=comments><p>nice " + "y " * 200 + "</p></div></body>":
        f"Title\n\n{TEXT}\n\nlast bit.",
    "<body><div class=cookie-notice>We use cookies</div><div class='header'>Site</div><div class=menu><ul><li><a>q</a>"
    "</ul></div><div id=main><h2>T</h2>" + BODY + "<p>Be.</p></div><div class='sidebar'>" + "z " * 100
    + "</div><div class=footer>c 2024</div>": f"T\n\n{TEXT}\n\nBe.",
    '<article><p title="a > b">one  two &lt;three&gt;\n&amp four</p><form><input value=">">name</form></article>':
        "one two <three> & four",
    "<article><h1>A b</h1><p>one two thr": "A b\n\none two thr",
    "<article><h1>A b</h1><p>one two<p cla": "A b\n\none two",
    "<article><h1>A b</h1><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table><p>x<br>y</p></article>":
        "A b\n\none\n\ntwo\n\na\n\nb\n\nx y",
    "<!-- <p>not this</p> --><p>a < b and 3<4 c</p><script>var t='</p><p>nor this</p>'</script>": "a < b and 3<4 c",
    "just <b>te</b>xt": "just text", "": "", None: "", "<p></p>": "", "<nav>Menu one two</nav>": "",
}


def test_main_text_of_other_layouts_and_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(i, f"u{i}", h, "t", "n") for i, h in enumerate(PAGES)] + [(None, None, "<p>x y</p>", None, None)] * 2
    pages = spark.createDataFrame(rows, schema)
    learned = main_text.learn(table(spark, SF, "pages"))
    for weights in (None, learned, main_text.Weights()):
        got = main_text.extract(pages, weights).collect()
        assert len(got) == len(rows)
        by_id = {r["page_id"]: r["text"] for r in got if r["page_id"] is not None}
        assert [by_id[i] for i in range(len(PAGES))] == list(PAGES.values())
        assert [r["text"] for r in got if r["page_id"] is None] == ["x y"] * 2
    assert main_text.extract(pages.limit(0)).collect() == []


def test_best_region_is_the_greatest_sum():
    scores = [1, -2, 3, -1, 2, -5, 4, -0.5, 1]
    sums = {(i, j): sum(scores[i:j]) for i in range(9) for j in range(i + 1, 10)}
    a, b = main_text.best_region(scores)
    assert sums[a, b] == max(sums.values())
    assert main_text.best_region([-1, 0, -2]) == (0, 0)


# ------------------------------------------------------------------ op 13

def brute_phrases(docs, least, top=2000):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    counts[lang][tuple(w[i:i + size])] += 1
    out = set()
    for lang, c in counts.items():
        frequent = {p: a for p, a in c.items() if a >= least and len(p) >= 2}
        held = {p[i:i + size] for p, a in frequent.items() for size in range(2, len(p))
                for i in range(len(p) - size + 1) if 100 * a >= 100 * c[p[i:i + size]]}
        rows = []
        for p, a in frequent.items():
            if p not in held:
                score, k = min((1000 * a * words[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0])
                for i, x in enumerate(sorted(rows)[:top])}
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("bits, chunk", [(64, 6 << 20), (64, 20_000), (9, 20_000)])
def test_phrases_equal_brute_force(spark, bits, chunk):
    """Also with fingerprints of 9 bits, of which nearly all collide."""
    docs = table(spark, SF, "documents")
    want = brute_phrases([tuple(r) for r in docs.select("lang", "text").collect()], 12)
    got = phrases.collocations(docs, least=12, chunk_bytes=chunk, print_bits=bits)
    assert pairs_of(got, *COLUMNS) == want and len(want) > 50


def test_phrases_top_and_pointers(spark):
    docs = table(spark, SF, "documents")
    got = phrases.collocations(docs, least=8, top=5)
    assert pairs_of(got, *COLUMNS) == brute_phrases([tuple(r) for r in docs.select("lang", "text").collect()], 8, 5)
    texts = {r["h"]: r["text"] for r in docs.select(F.xxhash64("text").alias("h"), "text").collect()}
    for r in got.collect():
        spot = texts[r["at"]["text_hash"]].encode()[r["at"]["start"]:r["at"]["end"]].decode()
        assert " ".join(spot.translate(LOWER).split()) == r["phrase"]


def test_phrases_odd_rows(spark):
    docs = odd_rows(spark)
    want = brute_phrases([tuple(r) for r in docs.select("lang", "text").collect()], 5)
    assert pairs_of(phrases.collocations(docs, least=5), *COLUMNS) == want and want
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_phrases_exact_beyond_64_bits(spark):
    found = [("en", "a b", 2, 3 * 10**12, None), ("en", "a", 1, 7 * 10**12, None), ("en", "b", 1, 5 * 10**12, None)]
    wide = spark.createDataFrame(found, "lang string, phrase string, n_words int, n long, at string")
    words = spark.createDataFrame([("en", 9 * 10**13)], "lang string, words long")
    row, = phrases.scored(wide, words).collect()
    assert row["score"] == 1000 * 3 * 10**12 * 9 * 10**13 // (7 * 10**12 * 5 * 10**12)


def test_byte_compare_finds_a_collision():
    chunk = phrases.Chunk([b"aa bb ab aa bb", b"AA  bb"])
    places = chunk.places(1)
    assert len(places) == 7
    import numpy as np
    a, b = np.array([0, 0, 1, 0]), np.array([3, 2, 4, 5])
    assert chunk.same(a, b).tolist() == [True, False, True, True]
    assert chunk.phrase(5, 2) == b"aa bb"
