"""Media archives, pages, urls, the quality classifier and the pipeline."""

import hashlib
import io
import os
import random
import re
import tarfile
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideweave.llm import html, media, quality, registry, urls

SF = "/root/testdata/sf0.001"
tables_only = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# ------------------------------------------------------------------------ media
@pytest.mark.parametrize("raw", [b"", b"a", b"x" * 576, b"y" * 577, "é日".encode() * 500, os.urandom(3000)])
def test_images_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(raw)
    assert set(payload[len(raw) :]) <= {255}
    stored = media.to_png(payload)
    assert media.from_png(stored) == payload
    broken = bytearray(stored)
    broken[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(broken))


def test_archives_are_tar_files():
    members = [(str(k), os.urandom(n)) for k, n in enumerate((1, 511, 512, 513, 5000, 1024))]
    whole = b"".join(row + b"\0" for row in media.archive_rows(iter(members), "m" * 31))
    with tarfile.open(fileobj=io.BytesIO(whole)) as tar:
        assert [(m.name, tar.extractfile(m).read()) for m in tar] == members
    assert media.parse_header(whole[:512], "other") is None


MEDIA = [(1, "some text"), (2, None), (3, ""), (None, "no id"), (4, "é" * 4000), (4, "é" * 4000)]


@pytest.mark.parametrize("range_bytes", ["512", "3000", "100000000"])
def test_media_columns(spark, range_bytes):
    df = spark.createDataFrame(MEDIA, "doc_id long, text string").withColumn("name", F.lit("x")).repartition(2)
    got = media.media_columns(df, rangeBytes=range_bytes).collect()
    assert len(got) == len(MEDIA)
    want = []
    for i, t in MEDIA:
        raw = (t or "").encode()
        p = media.padded(raw)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert len({tuple(r)[1:] for r in got if r.doc_id == 4}) == 1
    assert media.media_columns(df.where("false")).count() == 0


def test_members_are_retried_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string").coalesce(1)
    path, mark = str(tmp_path / "archives"), "z" * 31
    media.write_archives(df, path, mark)
    reader = media.ArchiveReader({"path": path, "mark": mark, "retries": "2"})
    tries: dict[int, int] = {}

    def fault(file, offset, attempt):
        tries[offset] = attempt
        if offset == sorted(seen)[2] and attempt < 2:
            raise OSError("lost")

    parts = reader.partitions()
    store, _ = media.open_store(path)
    seen = [at for at, _, _ in reader.headers(store, parts[0])]
    reader.fault = fault
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 6 and all(r["error"] is None for r in rows)
    assert sorted(tries.values()) == [0, 0, 0, 0, 0, 2]
    # A damaged member yields an error row or fails, and leaves the others alone.
    name = [n for n in os.listdir(path) if n.startswith("part-")][0]
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(seen[3] + 512 + 60)
        f.write(b"\xaa\xaa\xaa")
    reader.permissive, reader.fault = True, None
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["error"] is None for r in rows] == [True, True, True, False, True, True]
    reader.permissive = False
    with pytest.raises(RuntimeError):
        list(reader.read(parts[0]))
    # So does a damaged header; reading goes on at the next one.
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(seen[1] + 257)
        f.write(b"xxxxx")
    with pytest.raises(RuntimeError):
        list(reader.read(parts[0]))
    reader.permissive = True
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["offset"], r["error"] is None) for r in rows] == [(at, k not in (1, 3)) for k, at in enumerate(seen)]


# ------------------------------------------------------------------------- html
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body><header><a href="/">Site</a></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; line</h1><p>First  para &lt;b&gt;
with <b>bold</b> text.<p>Second &eacute; para<br>goes on.</p><div class="ad">Buy this now!</div>
<ul><li>item one</li><li>item two</li></ul><p>End.</p>
<form><label>Mail</label><input><button>Send</button></form></article>
<section id="comments"><p>A reader writes a long comment about all of this.</p></section>
<aside><p>Related story with some words.</p></aside><footer>&copy; 2020 Site</footer></body></html>"""
TEXT = "Head & line\nFirst para <b> with bold text.\nSecond é para goes on.\nitem one\nitem two\nEnd."


def test_main_text():
    assert html.main_text(PAGE) == TEXT
    assert html.main_text("") == "" and html.main_text("<p") == "" and html.main_text("<nav>a</nav>") == ""
    assert html.main_text("<article><p>cut off &am") == "cut off &am"
    assert html.main_text("<p>" + "Plain page without landmarks, but with a long sentence. " * 3 + "</p>").startswith("Plain")
    assert html.main_text("<div>" * 3000 + "<article>deep text</article>") == "deep text"


def brute_cut(odds, edges):
    best = None
    for bits in range(1 << len(odds)):
        side = [bits >> i & 1 for i in range(len(odds))]
        cost = sum(max(0, x) if not s else max(0, -x) for x, s in zip(odds, side, strict=True))
        cost += sum(w for a, b, w in edges if side[a] != side[b])
        if best is None or cost < best - 1e-9:
            best = cost
    return best


@pytest.mark.parametrize("seed", range(25))
def test_minimum_cut(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 10)
    odds = [round(rnd.uniform(-2, 2), 3) for _ in range(n)]
    edges = [(a, b, round(rnd.uniform(0, 1.5), 3)) for a in range(n) for b in range(a) if rnd.random() < 0.5]
    side = html.minimum_cut(odds, edges)
    cost = sum(max(0, x) if not s else max(0, -x) for x, s in zip(odds, side, strict=True))
    cost += sum(w for a, b, w in edges if side[a] != side[b])
    assert cost == pytest.approx(brute_cut(odds, edges), abs=1e-6)


def hidden(page, kinds=False):
    """A page without landmark tags and names; ``kinds``: with plain elements only."""
    page = re.sub(r"<(/?)(article|nav|footer|aside|header|main|section|form)\b", r"<\1div", page)
    if kinds:
        page = page.replace("<br><p>", "</p><p>")  # a paragraph that only the next one ends
        page = re.sub(r"<(/?)(p|h1|li|ul)\b", r"<\1div", page)
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|[^\s>]+)", "", page)


@tables_only
def test_landmarks_may_be_hidden(spark):
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").orderBy("page_id").select("html").collect()
    pages = [r.html or "" for r in rows]
    model = html.fit_classifier(pages[::2])
    assert max(map(abs, model.weights[html.TAG_FEATURES[0] :])) <= html.MOST_LANDMARK
    alike = {0: 0, 1: 0}
    flips = 0  # of one-word lines that the cut alone keeps
    for page in pages[1::2]:
        found = html.page_blocks(page)
        want = "\n".join(t for b, t in found if b.towards and not (b.away_tag or b.away_name))
        assert html.main_text(page, model) == want
        for kinds in alike:
            bare = hidden(page, bool(kinds))
            alike[kinds] += html.main_text(bare, model) == want
        blocks = html.page_blocks(hidden(page.replace("</article>", "<div>So</div></article>"), True))
        odds = model.odds(blocks)
        kept = html.minimum_cut(odds, html.smoothness_edges([b for b, _ in blocks]))
        flips += sum(t == "So" and o < 0 and k for (_, t), k, o in zip(blocks, kept, odds, strict=True))
    n = len(pages[1::2])
    assert alike[0] >= 0.95 * n and alike[1] >= 0.75 * n and flips > 0


def test_the_cut_flips_blocks():
    """A short line amid paragraphs stays, a longer one amid links goes."""
    model = html.BlockClassifier()

    def labelled(page):
        blocks = html.page_blocks(page)
        odds = model.odds(blocks)
        kept = html.minimum_cut(odds, html.smoothness_edges([b for b, _ in blocks]))
        return {text: (o > 0, k) for (_, text), o, k in zip(blocks, odds, kept, strict=True)}

    long = "A sentence that goes on for a while, as those of articles do, and says something. " * 3
    got = labelled(f"<div><p>{long}</p><p>{long}</p><div><p>So.</p></div><p>{long}</p></div>")
    assert got["So."] == (False, True) and got[long.strip()] == (True, True)
    links = "".join(f"<li><a href=x>Item {k}</a></li>" for k in range(6))
    got = labelled(f"<ul>{links}<li><p>A teaser of some words.</p></li>{links}</ul>")
    assert [v for k, v in got.items() if k.startswith("A teaser")] == [(True, False)]
    assert not any(k for _, k in got.values())


def plain_blocks(page):
    """Texts of a small page of block elements, by the standard library's parser."""
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.now = [], ""

        def cut(self):
            if self.now.split():
                self.out.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in html.BLOCKS:
                self.cut()

        handle_endtag = lambda self, tag: self.handle_starttag(tag, ())

        def handle_data(self, data):
            self.now += data

    parser = Texts()
    parser.feed(page)
    parser.close()
    parser.cut()
    return parser.out


@pytest.mark.parametrize("seed", range(30))
def test_extraction_equals_brute_force(seed):
    """Blocks by another parser, the labelling by all labellings."""
    rnd = random.Random(seed)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.4:
            text = " ".join(rnd.choice(["word", "a &amp; b", "longer sentence, here.", "<b>bold</b>", "&copy;"]) for _ in range(rnd.randrange(1, 12)))
            tag = rnd.choice(["p", "div", "h2", "li", "div class=sidebar"])
            return f"<{tag}>{text}</{tag.split()[0]}>"
        tag = rnd.choice(["div", "section", "article", "nav", "ul", "div id=main"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randrange(1, 4))) + f"</{tag.split()[0]}>"

    page = tree(3)
    blocks, model = html.page_blocks(page), html.BlockClassifier()
    assert [t for _, t in blocks] == plain_blocks(page)
    blocks = blocks[:11]
    odds, edges = model.odds(blocks), html.smoothness_edges([b for b, _ in blocks])
    kept = html.minimum_cut(odds, edges)
    cost = sum(max(0, x) if not s else max(0, -x) for x, s in zip(odds, kept, strict=True))
    cost += sum(w for a, b, w in edges if kept[a] != kept[b])
    assert cost == pytest.approx(brute_cut(odds, edges), abs=0.02)
    if len(html.page_blocks(page)) <= 11:
        assert html.main_text(page) == "\n".join(t for (_, t), k in zip(blocks, kept, strict=True) if k)


def test_deep_and_broken_pages():
    began = time.perf_counter()
    deep = html.page_blocks("<div>a" * 20_000)
    assert len(deep) == 20_000
    html.main_text("<div>a" * 20_000)
    html.page_blocks("<dt>x<ul>" + "<b>" * 5000 + "<dd>y" * 5000)
    assert html.main_text("<a " + "\"'" * 50_000) == ""
    assert time.perf_counter() - began < 20
    assert [t for _, t in html.page_blocks('one <a href="x>link')] == ["one"]
    assert [t for _, t in html.page_blocks("one <a title='>' b=\"<p>\">two</a> <i x\"y>three</i>")] == ["one two three"]


def test_extract_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = sorted(map(tuple, html.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (3, "", "", 0), (1, "u", TEXT, len(TEXT))], key=repr)
    assert html.extract_pages(df.where("false")).count() == 0


# ------------------------------------------------------------------------- urls
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.NET/x?y#z", "https://www.example.net/en/1",
    "https://example.net/en", "https://notexample.net/en/1", "http://example.com/de/", "http://x.example.com/de/a",
    "http://example.com/en/de/", "ftp://org/fr/1", "http://a.org/fr/", "http://a.org/FR/", "http://a.org?x=/fr/",
    "http://a.org/fr/://b.net/", "http://u@a.net:80/", "http://a..net/", "http://.net/", "http://net./", "http://é.net/en/",
    "http://a.net/\nb", "x://a.net\n/c",
]


def plain_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [
        (len(h) + len(p), len(h), a == "block", h + p, a)
        for a, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *((max(fit)[3], max(fit)[4]) if fit else (None, default)))


def test_filter_urls(spark):
    rules = [*urls.RULES, ("allow", "a.net", "/x"), ("block", "org", "/f"), ("allow", "net", "/")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    df = df.withColumns({"rule": F.lit(1), "digest": F.lit(2), "host": F.lit(3)})
    table = spark.createDataFrame([*rules, ("block", None, "/"), rules[0]], "action string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, table).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(URLS * 2)}
    bare = urls.filter_urls(df, table.where("false"), default="block").collect()
    assert len(bare) == len(URLS) * 2 and {r.verdict for r in bare} == {"block"}
    assert urls.filter_urls(df.where("false"), table).count() == 0


def test_long_hosts_end(spark):
    deep = "a." * 20_000
    rows = [(0, f"http://{deep}example.net/en/x"), (1, f"http://{deep}com/"), (2, "http://" + "." * 50_000), (3, "http://net" + "/x" * 50_000)]
    table = spark.createDataFrame([*urls.RULES, ("block", "a.a.a.com", "")], "action string, host string, path string")
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), table).collect()}
    assert got == {0: ("example.net/en/", "allow"), 1: ("a.a.a.com", "block"), 2: (None, "allow"), 3: ("net/", "block")}
    assert time.perf_counter() - began < 30


# ---------------------------------------------------------------------- quality
def test_co_training_learns_from_the_other_view():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.7).astype(float)
    pool = (rng.random(600) < 0.7).astype(float)

    def rows(t):
        content = np.c_[3 * t + rng.normal(0, 0.7, len(t)), rng.normal(0, 1, (len(t), quality.N_CONTENT - 1)) * 0.01]
        sources = np.where(rng.random(len(t)) < 0.95, t, 1 - t) * 5 + rng.integers(0, 5, len(t))
        return np.c_[content, np.zeros(len(t)), sources, 8 + 4 * t + rng.normal(0, 1, len(t))]

    x, more = rows(y), rows(pool)
    choose = lambda models, quota, taken: quality.surest(models, np.arange(600), more, quota, taken)
    model = quality.co_train(x, y, choose)
    test = (rng.random(500) < 0.7).astype(float)
    t = rows(test)
    a, b, both = model.score(t[:, : quality.N_CONTENT], quality.metadata_features(t[:, quality.N_CONTENT :]))
    right = lambda p: ((p > 0.5) == (test == 1)).mean()
    assert model.exchanged > 50 and right(both) > 0.97 and right(both) >= max(right(a), right(b)) - 0.01
    assert abs(both.mean() - test.mean()) < 0.05
    alone = quality.co_train(x, np.ones(400), choose)
    assert alone.content is None and alone.score(t[:, : quality.N_CONTENT], t)[2].min() == 1.0


@tables_only
def test_quality_equals_brute_force(spark):
    """The pool searched in one array, features taken one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    y_of = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    x = np.array(
        [[*quality.content_features((r.text or "").encode()), *quality.metadata_codes(r.lang, r.source, r.n_chars)] for r in rows]
    )
    half = x.astype(np.float16)
    keys = np.array([quality.xxhash.xxh64_intdigest(r.tobytes(), 3) >> 1 for r in half])
    known = sorted((r.doc_id, i) for i, r in enumerate(rows) if r.doc_id in y_of)
    at = [i for _, i in known]
    free = [i for i, r in enumerate(rows) if r.doc_id not in y_of]
    half = half.astype(np.float64)
    model = quality.co_train(
        half[at],
        np.array([float(y_of[rows[i].doc_id]) for i in at]),
        lambda models, quota, taken: quality.surest(models, keys[free], half[free], quota, taken),
    )
    want = model.score(x[:, : quality.N_CONTENT], quality.metadata_features(x[:, quality.N_CONTENT :]))[2]
    got = {r.doc_id: r for r in quality.op10_quality_cotraining(spark, SF).collect()}
    assert model.exchanged > 0 and len(got) == len(rows)
    for r, p in zip(rows, want, strict=True):
        assert got[r.doc_id].score == pytest.approx(p, abs=1e-6) and got[r.doc_id].accepted == (got[r.doc_id].score >= 0.5)


@tables_only
def test_quality_holds_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    model = quality.fit_quality(docs, labels.where("doc_id % 3 > 0"))
    got = quality.score_quality(docs, model, ["doc_id"]).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    right = got.accepted == (got.quality == 1)
    assert right.mean() >= 0.95 and got[got.quality == 1].accepted.mean() >= 0.97


def test_quality_odd_inputs(spark):
    rows = [(1, None, None, None, None), (None, "a", "en", "s", 1), (1, "b", "en", "s", 1), (2, "", "de", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (2, 7)], "doc_id long, quality int")
    got = quality.quality_scores(df.withColumn("score", F.lit(1)), labels).collect()
    assert len(got) == 4 and all(r.accepted and r.score == 1.0 for r in got)
    assert quality.quality_scores(df.where("false"), labels.where("false")).count() == 0
    bare = quality.quality_scores(df.select("doc_id", "text"), labels)
    assert bare.count() == 4


# --------------------------------------------------------- queries and pipeline
@tables_only
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_keeps_all_rows(spark, name):
    got = registry.queries()[name](spark, SF)
    table, key = ("pages", "page_id") if "page_id" in got.columns else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in got.select(key).collect()} == ids


@tables_only
def test_pipeline(spark):
    import corpus_pipeline
    from tideweave.llm import exact, privacy, similar

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left[-1], SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        left.append(out.cache())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in left]
    assert len(ids[0]) > len(ids[1]) >= len(ids[2]) >= len(ids[3]) == len(ids[4])
    gone = exact.exact_dedup(left[1]).where("not kept").collect()
    assert ids[1] - ids[2] == {r.doc_id for r in gone}
    rows = sorted((r.doc_id, frozenset(similar.shingle_hashes((r.text or "").encode(), 5))) for r in left[2].collect())
    least = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):  # classes by all pairs
        for j, b in rows[:k]:
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((least[i], least[j]))
                least = {d: x if c == y else c for d, c in least.items()}
    assert ids[3] == set(least.values()) and len(ids[3]) < len(ids[2])
    texts = {r.doc_id: r.text for r in left[3].collect()}
    assert {r.doc_id: r.text for r in left[4].collect()} == {i: privacy.pseudonymise(t)[0] for i, t in texts.items()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[4]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


CLASHES = [
    "accepted", "score", "n_pii", "pii_kinds", "id", "keep", "kept", "mark", "node", "part", "fp", "key", "size", "shard",
    "slot", "level", "body", "__id", "text_sha256", "sequence_id", "links",
]


@pytest.mark.parametrize("chars", [True, False])
def test_stages_on_odd_inputs(spark, chars):
    """Nulls, ties, repeated rows, long texts, clashing columns, no rows, with and without n_chars."""
    import corpus_pipeline

    words = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, words, "en", "s", 7), (2, words.upper(), "en", "s", 7), (2, words.upper(), "en", "s", 7), (3, None, None, None, None),
        (4, "", "en", "s", 0), (None, words, None, "s", 7), (5, words + " more", "de", "s", 7), (6, " \n ", "de", "t", 3),
        (7, "x" * 100_000, "de", "t", 9), (8, "mail a.b@x.org " * 3000, "de", "t", 9), (1, "one id on another text", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    df = (df if chars else df.drop("n_chars")).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    want = {
        "quality": sorted((r[0] for r in rows), key=repr),
        "exact_duplicates": sorted([2, 2, 4, None, 5, 6, 7, 8, 1], key=repr),
        "near_duplicates": sorted([1, 1, None, 3, 7, 8], key=repr),
        "personal_data": sorted((r[0] for r in rows), key=repr),
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, SF)
        assert stage(spark, df.where("false"), SF).count() == 0
        if name == "packing":
            assert {r.doc_id for r in got.collect()} == {r[0] for r in rows}
            continue
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in df.schema], name
        left = got.collect()
        if name != "quality":
            assert sorted((r.doc_id for r in left), key=repr) == want[name], name
        assert all(r[c] == f"own {c}" for r in left for c in CLASHES)


def test_imports_of_the_rest():
    """Nothing outside the subpackage needs it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{root}/tideweave"):
        if "/llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{folder}/{n}") as f:
                    assert "tideweave.llm" not in f.read(), n
