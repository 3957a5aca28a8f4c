"""The operators against brute force, round trips and held-out accuracy, on small frames."""

import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash

from statloom.llm import ann, bpe, html_extract, lattice_lm, licenses, mixing, simhash, toxicity, urlfilter, vecdedup
from statloom.functions.components import connected_components

JSON = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VEC = "vec_id long, embedding array<float>, label int"


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def odd_docs(spark):
    """Nulls, blanks, repeated rows, a long text, and columns named like the operators' own."""
    rows = [(1, None, None), (2, "", "a"), (3, "   \n", "a"), (4, "One two three four", "b"),
            (4, "One two three four", "b"), (5, "ONE two  three four", "b"), (6, "word " * 30_000, None),
            (None, "no id here", "c"), (7, "tie", "c"), (8, "tie", "c"), (9, "😀 ünï 中文 <|endoftext|> end", "é")]
    full = [(i, t, s, *["x"] * 12) for i, t, s in rows]
    names = ["fp", "node", "ids", "score", "held_out", "n_tokens", "component_id", "h", "b", "size", "target", "words"]
    return spark.createDataFrame(full, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))


# --- components ---

def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({n for p in pairs for n in p}, pairs)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: BPE ---

def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    lib.no_truncation()
    lib.no_padding()
    with open(JSON, encoding="utf-8") as f:
        codec = bpe.Codec(json.load(f))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "a", "é", "1", "中", " ", "\r", "\x1c", "!", "the", "ß",
             "\x85", "😀", "<|endof", " ", "　", "\x0b", "x" * 500]
    for _ in range(3_000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert codec.encode(s).tolist() == ids, repr(s)
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert codec.decode([codec.byte_ids[0xFF]]) == "�"


def test_bpe_query_on_odd_rows(spark):
    docs = odd_docs(spark)
    got = bpe.encode_decode(docs, JSON).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert sorted(r.decoded for r in got) == sorted(texts)
    rows = bpe.digests(bpe.encode_decode(docs, JSON)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id == 1] == [(0, empty, empty)]
    ids = next(r.ids for r in got if r.doc_id == 4)
    assert next(r.ids_sha256 for r in rows if r.doc_id == 4) == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), JSON).count() == 0


# --- 2: nearest neighbours ---

def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3_000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), 10, trees=8, leaf=32, share=0.15, block=200).collect()
    hit = 0
    for q in range(0, 3_000, 100):
        dist = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(3_000), dist)) if i != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(abs(r.score - dist[r.vec_id]) < 1e-12 for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(best))
    assert hit / 300 >= 0.9


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [], 1),
            (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None),
            (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (100, [1.0, 0.1], 1), (100, [1.0, 0.1], 1)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "vec_id long, embedding array<float>, label int, node string, v string")


def test_nearest_on_odd_rows(spark):
    df = odd_vectors(spark)
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), 3)
    by = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    assert [by[0, k][0] for k in (1, 2, 3)] == [1, 10, 11]  # ties go to the smaller id
    assert [by[100, k][0] for k in (1, 2, 3)] == [0, 1, 10] and len(by) == 6
    assert ann.nearest(df.limit(0), df.limit(0), 3).count() == 0
    assert ann.nearest(df, df.where("vec_id = 4"), 3).count() == 0


# --- 3: URLs ---

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "http://net", "http://net/", "http://notnet/", "https://x.net/en/", None, "nourl",
            "http://example.com/de/1", "http://xexample.com/de/1", "http://a.org/fr/2#z", "http://a.org/FR/2", "://h?q/p", ""]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    model = ([0.0] * 16, -1.0)
    got = {r.page_id: r for r in urlfilter.judge(df, RULES, model).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert [got[i].rule for i in range(1, 13)] == [None, "net/", None, "net/", None, None, "example.com/de/", None, "org/fr/",
                                                   None, None, None]
    assert (got[5].host, got[5].path, got[6].host, got[11].host, got[11].path) == ("", "", "", "h", "")
    assert urlfilter.judge(df.limit(0), RULES, model).count() == 0


def test_url_model_equals_gradient_descent(spark):
    table = urlfilter.labelled(spark).limit(30)
    weights, bias = urlfilter.train(table, buckets=256, steps=40)
    host, path = urlfilter.host_and_path(table.url)
    rows = table.select("label", urlfilter.features(host, path, 256).alias("f")).collect()
    x = np.zeros((len(rows), 257))
    for i, r in enumerate(rows):
        x[i, r.f] = 1 / math.sqrt(len(r.f))
        x[i, 256] = 1
    y = np.array([r.label for r in rows], float)
    w = np.zeros(257)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w = w * (1 - urlfilter.PENALTY) + x.T @ (y - p) * 10 / len(y)
    assert np.allclose(w[:256], weights) and abs(w[256] - bias) < 1e-9


def test_url_model_separates_and_counts_grams(spark):
    model = urlfilter.train(urlfilter.labelled(spark))
    urls = [("http://m.casino-win.example.com/en/5", "block"), ("http://cheap-pills.example.org/de/9.html", "block"),
            ("http://blog.ththan.example.org/en/5", "allow"), ("http://www.gardening.example.com/es/1", "allow")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, {}, model).collect()}
    assert [got[i] for i in range(4)] == [v for _, v in urls]


# --- 4: HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>menu</a>
</ul></nav><div class="ad">buy</div><article><h1>{t}</h1><p><b>first &amp; {t}<br>line<p>second&nbsp;one</p>{more}<div class=
"comments"><p>reader</p></div></article><aside>side</aside><form><p>field</form><footer>&copy;</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(i, f"http://h{i % 2}.test/{i}", PAGE.format(t=f"title {i}", more="<ul><li>x<li>y</ul>" * (i % 3))) for i in range(12)]
    rows += [(50, "http://solo.test/", "<div id=nav class=menu>m</div><div id=c><p>alone here</p><p>and more text</div>"),
             (51, None, None), (52, "http://e.test", ""), (53, "x", "plain < text &lt;&zzz; <b>bold</b>"),
             (54, "http://deep.test", "<div>" * 5_000 + "deep" + "</div>" * 5_000 + "after"),
             (56, "http://state.test", "<body class='has-sidebar'><article class='post no-comments related'><p>kept</p></article></body>"),
             (55, "http://cut.test", "<body><article><p>cut <!-- never closed")]
    df = spark.createDataFrame([(*r, "q") for r in rows + rows[:1]], "page_id long, url string, html string, text string")
    got = html_extract.main_text(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) + 1
    for i in range(12):
        want = [f"title {i}", f"first & title {i} line", "second one"] + ["x", "y"] * (i % 3)
        assert by[i].text == "\n\n".join(want) and by[i].n_chars == len(by[i].text)
    assert by[50].text == "alone here\n\nand more text"
    assert (by[51].text, by[51].n_chars, by[51].url, by[52].text) == ("", 0, None, "")
    assert by[53].text == "plain < text <&zzz; bold" and by[54].text == "deep\n\nafter" and by[55].text == "cut"
    assert by[56].text == "kept"
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_html_wrapper_has_slots_options_and_groups():
    total = None
    for i in range(4):
        w = html_extract.wrapper_of(html_extract.parse(
            "<body><h1>Same</h1>" + "<p>a</p>" * (i + 1) + (f"<h2>{i}</h2><ul><li>x</ul>" * 2 if i % 2 else "") + "</body>"))
        total = w if total is None else html_extract.merge(total, w)
    text = html_extract.expression(total)
    assert '<h1> "Same" </>' in text and "(<p> \"a\" </>)+" in text and "(<h2> # </> <ul>" in text and text.count(")*") == 1


def main_texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_html_wrapper_decides(spark):
    story = "<p>story {i} one</p><p>story {i} two, rather long, so that it outweighs the rest of this page {i}</p>"
    box = "<div class=box><p>Our terms apply</p></div>"
    plain = "<body><div class=a><p>Our shop is closed</p></div><div class=b>" + story + "</div><div class=c><p>end {i}</p></div></body>"
    pages = [("named.test", f"<body><article>{story}{box}</article></body>".format(i=i)) for i in range(4)]
    pages += [("plain.test", plain.format(i=i)) for i in range(4)]
    # two templates: the second must not be read by the first one's region
    pages += [("both.test", f"<body><article>{story}</article><div>teaser {{i}}</div></body>".format(i=i)) for i in range(4)]
    pages += [("both.test", f"<body><div class=b>{story}{box}</div></body>".format(i=i)) for i in range(4)]
    # copies of one page say nothing about the template; nor do runs that differ in length
    pages += [("copies.test", plain.format(i=7))] * 9
    pages += [("runs.test", "<body><h1>" + f"title {i}" * 9 + "</h1>" + "<p>again</p>" * (i + 1) + "</body>") for i in range(4)]
    got = main_texts(spark, pages)
    for i in range(4):
        want = [f"story {i} one", f"story {i} two, rather long, so that it outweighs the rest of this page {i}"]
        assert got[i] == "\n\n".join(want) and got[4 + i] == "\n\n".join([*want, f"end {i}"])
        assert got[8 + i] == got[12 + i] == "\n\n".join(want)
        assert got[25 + i].endswith("\n\nagain" * (i + 1))
    assert got[16].startswith("Our shop is closed\n\nstory 7 one") and len(set(got[16:25])) == 1


def page_texts(pages):
    """The same without Spark, for pages of one host."""
    wrappers = {}
    for page, html in enumerate(pages):
        w = html_extract.wrapper_of(html_extract.parse(html), page)
        key = html_extract.template(w)
        wrappers[key] = html_extract.merge(wrappers[key], w) if key in wrappers else w
    rules = {k: html_extract.rule(w) for k, w in wrappers.items()}
    return [html_extract.text_of(html, rules).split("\n\n") for html in pages]


def test_html_named_region_must_hold_the_text():
    text = [f"real text of page {i}, much longer than whatever else there is on it" for i in range(4)]
    for box in ("<div class='main-title'>title {}</div>", "<div class=mainmenu>menu {}</div>", "<div class=main>box {}</div>",
                "<article>teaser {}</article><article>card {}</article>"):
        got = page_texts([f"<body>{box.replace('{}', str(i))}<div class=t><p>{t}</p></div></body>" for i, t in enumerate(text)])
        assert [t in g for t, g in zip(text, got)] == [True] * 4
    for name in ("article", "main", "div class='wide main'", "div role=main", "article class=c{}"):
        got = page_texts([f"<body><{name.replace('{}', 'xyzw'[i])}><p>{t}</p></{name.split()[0]}><div>other {i}</div></body>"
                          for i, t in enumerate(text)])
        assert got == [[t] for t in text]


def test_html_names_only_hint():
    body = ("<h2 id=search-engines>head {i}</h2><section id=related-work><p id=social-history>work {i} with a "
            "<span class=search-term>term</span></p></section><div class=section id=search><p data-role=search>div {i}</p></div>"
            "<p class=notice>remark {i}</p><div class=comment-on-law><p>law {i}</p></div>")
    boxes = ("<div class=comments>reader {i}</div><div class=share-links><a href=x>share {i}</a></div>"
             "<ul id=related><li><a href=y>next {i}</a></ul><div class=cookie-box>We use cookies</div>")
    want = [[f"head {i}", f"work {i} with a term", f"div {i}", f"remark {i}", f"law {i}"] for i in range(4)]
    form = "<form><label>name</label><input name=a>{}<fieldset><select><option>one</select></fieldset><button>go</button></form>"
    for page in ("<body><article>{}</article></body>", "<body>{}</body>", f"<body>{form}</body>"):
        got = page_texts([page.replace("{}", body + boxes).replace("{i}", str(i)) for i in range(4)])
        assert got == want


def test_html_embedded_elements_end_where_they_end():
    for html, want in (('<p>one <svg class="icon"/> two</p><p>three</p>', ["one two", "three"]),
                       ("<p>a <math/> b</p><p>c</p><svg><text>no</text></svg><p>d</p>", ["a b", "c", "d"]),
                       ("<p>a</p><object data=x><p>b</p><canvas><p>c</p>", ["a", "b", "c"]),
                       ("<p>a <svg> b</p><p>c <svg><g/><svg><text>no</text></svg>no</svg> d</p>", ["a b", "c d"]),
                       ("<p>a<template><p>no<iframe>no</template> b</p><script>'<svg>'</script><p>c</p><!--</svg>--><p>d", ["a b", "c", "d"]),
                       ("<p>a</p><svg><style>.x{}</svg><p>no", ["a"])):
        assert page_texts([f"<body><article>{html}</article></body>"]) == [want]


# --- 5: SimHash ---

def slow_fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_fingerprints_and_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        odd_docs(spark).selectExpr("doc_id + 100000 AS doc_id", "text"))
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{f:016x}") for i, f in fps)
    known = [(i, f) for i, f in fps if i is not None]
    pairs = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if (x ^ y).bit_count() <= 3]
    want = roots({i for i, _ in known}, pairs)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [50_000, 4])
def test_trie_join_is_exact_also_when_split(spark, unit):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    vals = sorted({b ^ sum(1 << k for k in set(rng.choices(range(64), k=rng.randint(0, 6)))) for b in base for _ in range(12)} | {0})
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(vals)]
    edges = simhash.linked_fingerprints(spark.createDataFrame(rows, "node long, fp long"), 3, unit)
    got = roots(range(len(vals)), [(e.a, e.b) for e in edges.collect()])
    assert got == roots(range(len(vals)), [(i, j) for i in range(len(vals)) for j in range(i) if (vals[i] ^ vals[j]).bit_count() <= 3])


def test_simhash_keeps_one_document(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 4, 6, 7, 9] and list(kept[0].asDict()) == docs.columns


def test_simhash_tells_rows_apart_without_ids(spark):
    a, b, c = "alpha beta gamma delta epsilon", "quite another text stands here now", "the same words without any id at all"
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (None, c, "x"), (None, c, "y"), (5, a, "x"), (2, c + " more and more", "x")],
                                 "doc_id long, text string, _row string")
    for n in (1, 3):
        kept = simhash.keep_one(docs.repartition(n)).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (1, b), (0, c), (2, c + " more and more")])
        assert list(kept[0].asDict()) == docs.columns


# --- 6: mixing ---

def test_targets_and_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 20), s) for s, n in (("a", 400), ("b", 30), ("c", 100), (None, 200)) for i in range(n)]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(mixing.sizes(docs)).toPandas()
    per = got.groupby("source", dropna=False).agg(own=("size", "sum"), size=("source_size", "first"), target=("target", "first"),
                                                  taken=("taken", "sum"))
    assert (per["own"] == per["size"]).all() and abs(per["target"].sum() - per["own"].sum()) < 1e-6
    weights = {"a": 1, "b": 2, "c": 3}
    total, left, target = per["own"].sum(), dict(enumerate(per["own"])), {}
    w = [weights.get(s, 1) for s in per.index]  # null comes last and weighs 1 again
    share, free = float(total), set(range(len(w)))
    while free:  # repeated rounds, as the water level replaces them
        over = {k for k in free if share * w[k] / sum(w[j] for j in free) > 3 * left[k]}
        if not over:
            target |= {k: share * w[k] / sum(w[j] for j in free) for k in free}
            break
        target |= {k: 3.0 * left[k] for k in over}
        share -= sum(3.0 * left[k] for k in over)
        free -= over
    assert np.allclose(per["target"], [target[k] for k in range(len(w))])
    assert (abs(per["taken"] - per["target"]) <= 40).all() and (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix(mixing.sizes(docs.repartition(7))).toPandas()
    assert (got.sort_values("doc_id")["taken"].to_numpy() == again.sort_values("doc_id")["taken"].to_numpy()).all()


def test_mix_on_odd_rows(spark):
    docs = odd_docs(spark)
    got = mixing.mix(mixing.sizes(docs)).collect()
    assert len(got) == docs.count() and all(r.taken % max(1, r.size) == 0 for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    assert mixing.mix(mixing.sizes(docs.limit(0))).count() == 0 and mixing.take(docs.limit(0)).count() == 0


# --- 7: toxicity ---

def labelled_docs(spark, n=900):
    rng = random.Random(4)
    words = ["tion", "ance", "the", "order", "house", "river", "stone", "green", "walks", "under"]
    rows = []
    for i in range(n):
        ws = [rng.choice(words) + rng.choice(words) for _ in range(rng.randint(5, 150))]
        bad = i % 4 == 0
        if bad:
            ws[rng.randrange(len(ws))] = "vile" + rng.choice(words)
        rows.append((i, " ".join(ws), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out_accuracy_and_folds(spark):
    both = labelled_docs(spark)
    docs, labels = both.select("doc_id", "text"), both.select("doc_id", "toxic")
    sample = toxicity.training_sample(docs, labels)
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(sample[1]) == len(ids)
    net = toxicity.train(*sample)
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    held = [i for i in range(900) if i not in set(ids)]
    assert all(got[i].held_out == (i in set(held)) for i in range(900))
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) >= 0.97
    odd = odd_docs(spark)
    scored = toxicity.score(odd, net).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.keep_clean(odd, net).columns == odd.columns
    kept = {r.doc_id for r in toxicity.keep_clean(docs, net).collect()}
    assert kept == {i for i in range(900) if got[i].predicted == 0}
    assert toxicity.score(odd.limit(0), net).count() == 0


def test_toxicity_gradients():
    net = toxicity.Net([b"aa", b"bb"], toxicity.grams_of(b"aaaaaa"), 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    parts = [net.parts(w) for w in (b"aa", b"aaaaaa", b"zz")]
    at = np.array([[0, 1, 2, -1], [1, 1, -1, -1]])

    def loss():
        return net.forward(net.project(net.inputs(parts)[0]), at).sum()

    x, _ = net.inputs(parts)
    proj = net.project(x)
    logit, kept = net.forward(proj, at, keep=True)
    grads, _ = net.backward(x.astype(float), proj, at, np.ones(2), kept)
    for name in ("wf", "ub", "pool", "out", "cb"):
        flat = net.p[name].reshape(-1)
        k = flat.size // 2
        old = flat[k]
        flat[k] = old + 1e-4
        up = loss()
        flat[k] = old - 1e-4
        down = loss()
        flat[k] = old
        assert abs((up - down) / 2e-4 - grads[name].reshape(-1)[k]) < 1e-3


def test_toxicity_without_labels(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    net = toxicity.train(*toxicity.training_sample(docs, labels))
    assert net is None and {r.score for r in toxicity.score(docs, net).collect()} == {0.0}
    assert toxicity.keep_clean(docs, None).count() == docs.count()


def test_toxicity_windows_hold_passages_and_training_sees_all(spark):
    for n in range(17, 200):
        starts = toxicity.window_starts(n)
        assert all(any(s <= a and a + 17 <= s + toxicity.WINDOW for s in starts) for a in range(n - 16))
    docs = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(5_000))), (1, "short text")], "doc_id long, text string")
    windows, labels = toxicity.training_sample(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert {w for text in windows for window in text for w in window.split()} >= {f"w{k}" for k in range(5_000)}


def test_training_windows_of_a_text_are_bounded(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    words = [" ".join(f"w{k}" for k in range(n)) for n in (30_000, 3, 0, 500, 9_000, 40)]
    docs = spark.createDataFrame(list(zip(ids, words)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    windows, y = toxicity.training_sample(docs, labels)
    assert sorted(map(len, windows)) == sorted(min(toxicity.MAX_WINDOWS, len(toxicity.window_starts(len(w.split())))) for w in words)
    longest = max(windows, key=lambda ws: (len(ws), ws[0]))
    assert len(longest) == toxicity.MAX_WINDOWS and longest[0].split()[0] == "w0"


# --- 8: licences ---

def test_license_templates(spark):
    opt = licenses.compiled("x", "alpha beta <<optional>> of the <<end>> gamma <<any 2>> delta")
    run = lambda s: opt.run(s.encode().split(), 0)
    assert run("alpha beta gamma delta")[0] == 4 and run("alpha beta of the gamma q q delta more")[0] == 8
    assert run("alpha beta of gamma delta") == (-1, 0.5) and run("alpha beta gamma q q q delta")[0] == -1
    texts = ["Under the MIT-License under the mit LICENSE. Apache License, Version 2", None, "", "cc by nc" * 1,
             "licensed under the gnu affero", "x\ny Released UNDER THE MIT License cc by nc", "y " * 20_000 + "CC BY-NC 4.0"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(df)).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (12, 3, 0, 8, "apache-2,mit")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert got[3].labels == "cc-by-nc" and got[4].n_base == 0 and 0 < got[4].score < 1
    assert got[5].labels == "mit,mit-notice" and got[6].first_word == 20_000
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_base_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(docs)).collect()}
    for r in docs.select("doc_id", "text").collect():
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate({c: c + 32 for c in range(65, 91)}))
        at = {(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()}
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (g.first_word, g.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))


# --- 9: lattice language model ---

def test_lattice_sums_all_segmentations():
    pieces, byte_weights = lattice_lm.vocabulary(PIECES)
    lattice = lattice_lm.Lattice(pieces, byte_weights)

    def total(s, i=0):
        if i == len(s):
            return 1.0
        out = sum(math.exp(pieces[s[i:j]]) * total(s, j) for j in range(i + 1, len(s) + 1) if s[i:j] in pieces)
        if s[i] not in lattice.chars:
            out += math.exp(sum(byte_weights[b] for b in s[i].encode())) * total(s, i + 1)
        return out

    for w in ("the", "thanedble", "ción", "😀x", "a"):
        assert abs(lattice.forward(w)[-1] - math.log(total("▁" + w))) < 1e-9
        used = {}
        lattice.expected(w, 1, used)
        length = sum(n * len(k) for k, n in used.items() if isinstance(k, str))
        raw = sum(n for k, n in used.items() if not isinstance(k, str)) / 4
        assert abs(length + raw - len(w) - 1) < 1e-9


@pytest.mark.parametrize("heads", [100_000, 3, 0])
def test_lattice_lm_base_equals_brute_force(spark, heads):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        odd_docs(spark).selectExpr("doc_id + 100000 AS doc_id", "text"))
    rows = docs.collect()
    got = lattice_lm.score(docs, PIECES, heads=heads).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [w for w in (t or "").encode().lower().split()] + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = {}
    for r in rows:
        if not held(r.doc_id):
            for w in tokens(r.text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id or -1, held(r.doc_id), len(tokens(r.text)), sum(w in counts for w in tokens(r.text)), n,
                   sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(r.text))) for r in rows)
    have = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in have], [x[5] for x in want])
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("heads", [100_000, 0])
def test_lattice_lm_score_is_the_sum_over_words(spark, heads):
    from pyspark.sql import functions as F
    docs = odd_docs(spark)
    texts = lattice_lm.doc_texts(docs).withColumn("held_out", lattice_lm.crc_mod(F.col("doc_id"), 7) == 2)
    n_train = texts.where("NOT held_out").count()
    pieces, byte_weights, end = lattice_lm.learn(lattice_lm.word_counts(texts), n_train, lattice_lm.vocabulary(PIECES))
    lattice = lattice_lm.Lattice(pieces, byte_weights)
    want = sorted((sum(lattice.forward(w)[-1] for w in lattice_lm.words_of(r.text or "")) + end) / math.log(10)
                  for r in docs.collect())
    got = sorted(r.score for r in lattice_lm.score(docs, PIECES, heads=heads).collect())
    assert np.allclose(got, want, rtol=1e-9)


def test_lattice_lm_on_an_empty_table(spark):
    assert lattice_lm.score(odd_docs(spark).limit(0), PIECES).count() == 0


# --- 10: embedding near-duplicates ---

def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    x = np.concatenate([x, x[:150] + rng.normal(size=(150, 8)) * 0.12, x[:40], 3 * x[:20]]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], VEC)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    want = roots(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a > b])
    for options in ({}, {"per_pivot": 20, "cell": 16}):
        got = {r.vec_id: r for r in vecdedup.near_duplicates(df, **options).collect()}
        assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
        assert {i: got[i].component_id for i in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vector_links_on_odd_rows(spark):
    df = odd_vectors(spark)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vecdedup.near_duplicates(df).collect())
    assert got == [(0, 4, 0), (1, 4, 0), (2, 4, 0), (3, 0, 3)] + [(i, 0, i) for i in range(4, 13)] + [(100, 4, 0)] * 2
    assert vecdedup.near_duplicates(df.limit(0)).count() == 0
