"""The operators' methods against plain versions: windows, block rules, orders, splits, sums and walks."""

import hashlib
import html.parser
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import components, htmltext, langid, linededup, mixing, neardup, quality, queries, tokens, toxicity, trees, warc
from corpusloom.llm._rows import with_group
from corpusloom.llm._store import shared_dir, written
from tests.llm.test_operators import ODD, SPACE, components as linked, table

SOME = "doc_id long, text string, source string, `_copy` string, `_id` string, `_times` string, `_salt` string, `row` string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, s, "a", "b", "c", "d", "e") for i, t, s in rows], SOME)


# Line dedup


def deduped(rows, words):
    """Plain line dedup of distinct (id, text) rows: every run of lines is held against all earlier places."""
    docs = []
    for i, t in rows:
        md5 = hashlib.md5((t if t is not None else "").encode()).hexdigest() if t is not None else "null"
        rid = hashlib.md5(f"{'null' if i is None else i}\n{md5}".encode()).digest()
        lines = t.split("\n") if t is not None else []
        docs.append((i is not None, i or 0, rid, lines, [p for p, x in enumerate(lines) if SPACE.search(x)]))
    places = {}
    runs = []
    for d in sorted(docs):
        for s in range(len(d[4])):
            n = 0
            for e in range(s, len(d[4])):
                n += len(SPACE.findall(d[3][d[4][e]]))
                if n >= words:
                    content = tuple(d[3][p] for p in d[4][s : e + 1])
                    runs.append((content, d, d[4][s], d[4][e]))
                    places.setdefault(content, (d[:3], d[4][s]))
    gone = {}
    for content, d, lo, hi in runs:
        if places[content] != (d[:3], lo):
            gone.setdefault(d[2], set()).update(range(lo, hi + 1))
    return {(d[1] if d[0] else None, "\n".join(d[3])): ("\n".join(x for p, x in enumerate(d[3]) if p not in gone.get(d[2], ())), len(gone.get(d[2], ()))) for d in docs}


def test_line_dedup_runs(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    pool = [line(rng.randint(1, 9)) for _ in range(12)]
    rows = {(rng.choice([None, 1, 2, 3, 4, 5]), "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randint(1, 40)))) for _ in range(60)}
    long = [line(9), line(2), line(2)]
    rows |= {(7, "\n".join(long)), (8, "\n".join(["x", *long])), (9, "\n".join([pool[0]] * 30)), (10, "")}
    rows = sorted(rows, key=repr)
    want = deduped(rows, 10)
    found = linededup.dedup_lines(clashing(spark, [(i, t, "s") for i, t in rows]), words=10).collect()
    assert Counter((r.doc_id, r.text, r.n_removed) for r in found) == Counter((i, *want[i, t]) for i, t in rows)
    assert {r.doc_id: r.n_removed for r in found}[8] == 3  # the tail of a run goes too


def test_with_group(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, i) for k, n in (("a", 3000), ("b", 1), ("c", 2)) for i in range(n)], "k string, v long")
    got = with_group(rows, ["k"], F.col("v"), {"n": (F.count("*"), F.sum), "low": (F.min("v"), F.min)}).collect()
    assert len(got) == 3003 and {(r.k, r.n, r.low) for r in got} == {("a", 3000, 0), ("b", 1, 0), ("c", 2, 0)}


# HTML


class Plain(html.parser.HTMLParser):
    """Blocks of well-formed pages: (text, link characters, home, whether in the article, whether out, whether heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.blocks, self.n = [("", 0)], [], [], 0

    def flush(self):
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            tags = [t for t, _ in self.stack]
            linked = sum(len("".join(p.split())) for p, a in self.parts if a)
            out = any(t in ("nav", "footer", "aside", "form", ".ad") for t in tags)
            self.blocks.append((text, linked, self.stack[-1][1], "article" in tags, out, any(re.fullmatch("h[1-6]", t) for t in tags)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "a"):
            self.stack.append((tag, self.stack[-1][1]))
            return
        self.flush()
        if tag in ("br", "meta"):
            return
        if tag == "p" and any(t == "p" for t, _ in self.stack):
            self.close("p")
        home = self.stack[-1][1]
        if tag not in ("p", "h1", "h2", "li", "title", "style", "script"):
            self.n += 1
            home = self.n
        self.stack.append((".ad" if dict(attrs).get("class") in ("ad", "cookie-notice") else tag, home))

    def close(self, tag):
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag or tag == "div" and self.stack[at][0] == ".ad":
                del self.stack[at:]
                return

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.flush()
        elif any(t == tag for t, _ in self.stack):
            if tag == "b":
                self.flush()
        self.close(tag)

    def handle_data(self, data):
        if self.stack[-1][0] not in ("title", "style", "script"):
            self.parts.append((data, any(t == "a" for t, _ in self.stack)))


def relabelled(page):
    """First and final labels by the rules as written, block by block."""
    parser = Plain()
    parser.feed(page)
    parser.flush()
    found = [b for b in parser.blocks]
    marked = any(b[3] and not b[4] for b in found)
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    stops = lambda t: sum(w in htmltext.STOP_WORDS for w in words(t))
    longer = [b for b in found if not b[4] and b[1] <= 0.2 * len(b[0]) and len(b[0]) >= 70]
    listed = sum(stops(b[0]) for b in longer) >= 0.12 * sum(len(words(b[0])) for b in longer)
    first, apart = [], []
    for text, linked_chars, _, inside, out, _ in found:
        density, links = stops(text) / max(len(words(text)), 1), linked_chars / len(text)
        apart.append(bool(out or marked and not inside))
        article = marked and not apart[-1]
        if links > (0.8 if article else 0.2):
            first.append("bad")
        elif len(text) < 70:
            first.append("short" if article or not linked_chars else "bad")
        elif apart[-1] or links > 0.2:
            first.append("near")
        elif not listed or density >= 0.2:
            first.append("good" if len(text) > 200 else "near")
        else:
            first.append("near" if density >= 0.08 or marked else "bad")
    final = list(first)
    for i, label in enumerate(first):
        if label not in ("short", "near"):
            continue

        def sides(places, edge):
            before = next(((first[j], i2) for i2, j in enumerate([j for j in reversed(places) if j < i], 1) if first[j] in ("good", "bad")), (edge, 1 + sum(j < i for j in places)))
            after = next(((first[j], i2) for i2, j in enumerate([j for j in places if j > i], 1) if first[j] in ("good", "bad")), (edge, 1 + sum(j > i for j in places)))
            return [s for s in (before, after) if s[0]]

        inside = [j for j in range(len(first)) if apart[j] == apart[i]]
        home = sides([j for j in inside if found[j][2] == found[i][2]], None)
        on_page = sides(inside, "good" if marked and not apart[i] else "bad")
        seen = home or on_page
        kinds = {s[0] for s in seen}
        few = stops(found[i][0]) < 0.08 * len(words(found[i][0])) or not words(found[i][0])
        if label == "near" and few and min((d for x, d in seen + on_page if x == "good"), default=0) > 40:
            final[i] = "bad"
        elif len(kinds) == 1:
            final[i] = kinds.pop()
        elif label == "near":
            final[i] = "good"
        elif not home:
            final[i] = "bad"
        else:
            (a, x), (b, y) = seen
            final[i] = a if x < y or x == y and not found[i][5] else b
    return [b[0] for b in found], first, final


def test_html_labels(spark, sf_dir):
    changed, decided, removed = Counter(), Counter(), Counter()
    pages = [r.html for r in queries.table(spark, sf_dir, "pages").collect()]
    bare = [re.sub(r"<(/?)article", r"<\1div", p) for p in pages]
    for page in [*pages, *bare]:
        found = htmltext.blocks(page)
        htmltext.first_pass(found)
        labels = [b.label for b in found]
        htmltext.second_pass(found)
        texts, first, final = relabelled(page)
        assert [b.text for b in found] == texts and labels == first and [b.label for b in found] == final
        decided += Counter(x for x in labels if x in ("good", "bad"))
        if "<article" in page:  # both passes take blocks away on pages that mark their article
            removed += Counter("first" if x == "bad" else "second" for x, b in zip(labels, found, strict=True) if b.label == "bad")
        changed += Counter(f"{x} {b.label}" for x, b in zip(labels, found, strict=True) if x in ("short", "near"))
    assert removed["first"] > len(pages) and removed["second"] > len(pages) / 2
    assert decided["good"] > len(pages) and changed["short good"] > len(pages) and changed["near good"] > len(pages) / 2
    same = sum(htmltext.main_text(a) == htmltext.main_text(b) for a, b in zip(pages, bare, strict=True))
    assert same >= 0.7 * len(pages)  # most pages come out the same if they don't mark their article
    got = {r.page_id: r for r in queries.op9_html(spark, sf_dir).collect()}
    for r in queries.table(spark, sf_dir, "pages").collect():
        texts, _, final = relabelled(r.html)
        want = " ".join(t for t, x in zip(texts, final, strict=True) if x == "good")
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def plain_subwords(text):
    """Marked words of two edges, their n-grams and the words themselves, as strings."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    out = []
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
        marked = f" {m[0]} "
        out += [marked[i : i + k] for k in toxicity.GRAMS for i in range(len(marked) - k + 1)]
        out.append((m[0],))
    return out


def test_toxicity_bags():
    """Two texts share a bucket as often as they share a subword, and have as many as they have subwords."""
    import numpy as np
    import pyarrow as pa

    texts = ["You are an IDIOT, idi0t!", "idiot", "", None, "naïve naïves 漢字 x", "a b", "you", "  --  "]
    buckets, owner = toxicity.subwords(pa.array(texts))
    of = {}
    for i, t in enumerate(texts):
        mine, want = buckets[owner == i], plain_subwords(t or "")
        assert len(mine) == len(want), t
        of[i] = (Counter(mine.tolist()), Counter(want))
    for i in of:
        assert sorted(of[i][0].values()) == sorted(of[i][1].values())
        for j in of:
            assert sum((of[i][0] & of[j][0]).values()) == sum((of[i][1] & of[j][1]).values())
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.3)
    score = model.score(pa.array(texts))
    for i in of:
        mine = buckets[owner == i]
        z = 0.3 + (model.gain[mine].mean() if len(mine) else 0)
        assert math.isclose(score[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_toxicity_steps():
    """The fit against the same steps on whole matrices, with the gradients written out."""
    import numpy as np

    rng = np.random.default_rng(4)
    bags = [np.unique(rng.integers(0, 40, rng.integers(0, 12))) for _ in range(30)]
    labels = rng.random(30) < 0.4
    values = [rng.dirichlet(np.ones(len(b))).astype(np.float32) if len(b) else np.zeros(0, np.float32) for b in bags]
    got = toxicity.fit(np.concatenate(bags).astype(np.int32), np.concatenate(values), np.array([len(b) for b in bags]), labels, epochs=25)
    y = labels.astype(float)
    weight = np.where(labels, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    start = np.random.default_rng(3)
    vectors = start.uniform(-1, 1, (toxicity.BUCKETS, toxicity.DIMENSIONS)).astype(np.float32)[:40] / toxicity.DIMENSIONS
    head, bias = start.normal(0, 1, toxicity.DIMENSIONS).astype(np.float32).astype(float), 0.0
    vectors = vectors.astype(float)
    x = np.zeros((30, 40))
    for i, (b, v) in enumerate(zip(bags, values, strict=True)):
        x[i, b] = v
    step_head, step_line, used = 0.0, 0.0, x.any(0)
    for epoch in range(25):
        pull = 20.0 * (1 - epoch / 25)
        g = weight * (1 / (1 + np.exp(-(x @ vectors @ head + bias))) - y)
        along = x.T @ g
        step_line, step_head = 0.9 * step_line + along, 0.9 * step_head + vectors.T @ along
        vectors[used] = (vectors * (1 - 1e-5 * pull) - 50 * pull * np.outer(step_line, head))[used]
        head, bias = head - 0.05 * pull * step_head, bias - 0.1 * g.sum() * pull
    assert np.allclose(got.gain[:40][used], (vectors @ head)[used], rtol=2e-2, atol=2e-2) and math.isclose(got.bias, bias, abs_tol=1e-2)


def test_html_doubtful_blocks_far_from_good_ones():
    good = ("The house is on the hill and it was built by the people of the town for all of us to see. " * 4).strip()
    odd, short = ("blah " * 40).strip(), "Short one."
    page = lambda n: f"<article><p>{good}</p>" + f"<p>{short}</p>" * n + f"<p>{odd}</p>" + f"<p>{short}</p>" * n + f"<p>{good}</p></article>"
    assert odd in htmltext.main_text(page(htmltext.FAR - 1)) and odd not in htmltext.main_text(page(htmltext.FAR))
    assert htmltext.main_text(f"<article><p>{good}</p></article><p>{good} x</p><p>{good} y</p>") == good


def test_html_tables(spark):
    kinds = "page_id long, url string, html string, `row` string, `result` string"
    rows = [(1, "u", None, "x", "y"), (2, None, "", "x", "y"), (3, "v", "<p>One", "x", "y"), (3, "v", "<p>One", "x", "y"), (None, "w", "<article>" + "<p>the cat is on the mat and " * 20_000, "x", "y")]
    got = [(r.row.page_id, r.result.n_chars) for r in htmltext.extract(spark.createDataFrame(rows, kinds)).collect()]
    assert Counter(got) == Counter([(1, 0), (2, 0), (3, 0), (3, 0), (None, 20_000 * 26 - 1)])
    assert htmltext.extract(spark.createDataFrame([], kinds)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div><h2>Short title</h2><p>{0}</p><p>Short.</p><p>{0}</p><p>The end.</p></div><div><a href=x>One link</a> <a href=y>and one more</a></div>",
        "<table><tr><td><a href=x>Home</a></td></tr></table><div><h1>Short title</h1><div>{0}</div><div>Short.</div><div>{0}</div><div>The end.</div></div><div><a href=x>All rights</a></div>",
    ],
)
def test_html_unmarked(page):
    long = ("The house is on the hill and it was built by the people of the town for all of us to see. " * 4).strip()
    got = htmltext.main_text(page.format(long))
    assert long in got and "Short." in got and "link" not in got and "rights" not in got and "Home" not in got
    if "<h2>" in page:
        assert got == f"Short title {long} Short. {long} The end."


# Mixing and order


def test_exponents(spark):
    sizes = {"a": 1000, "b": 100, "c": 10, None: 1}
    sources = spark.createDataFrame(list(sizes.items()), "source string, tokens long")
    total = sum(sizes.values())

    def entropy(alpha):
        w = [(n / total) ** alpha for n in sizes.values()]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(len(w))

    for target in (0.3, 0.6, 0.9):
        alpha = mixing.exponent(sources, entropy=target)
        assert entropy(alpha) >= target - 1e-9 and (entropy(alpha + 1e-6) < target or alpha == 1.0)
    alpha = mixing.exponent(sources, repeats=4.0)
    passes = [n ** (alpha - 1) for n in sizes.values()]
    assert math.isclose(max(passes) / min(passes), 4.0, rel_tol=1e-9)
    assert mixing.exponent(sources, entropy=0.99, repeats=4.0) >= alpha - 1e-12
    got = {r.source: r for r in mixing.weights(sources, 0.5, budget=10_000).collect()}
    roots = {s: math.sqrt(n) for s, n in sizes.items()}
    assert all(got[s].target == round(10_000 * roots[s] / sum(roots.values())) for s in sizes)


@pytest.mark.parametrize("goal", [{"repeats": 3.0}, {"entropy": 0.9, "repeats": None}, {"repeats": 2.0, "budget": 900}])
def test_budgets(spark, monkeypatch, goal):
    rows = [(i, f"w{i} " * (1 + i % 5), "big") for i in range(400)] + [(i, f"w{i} " * 3, "small") for i in range(30)] + [(None, "x y", None), (None, "z " * 9, None), (4, "", "big"), (4, None, "small")]
    docs = clashing(spark, rows)
    from pyspark.sql import functions as F

    keys = written(mixing._measured(docs), "measured")
    alpha = mixing.exponent(mixing.shares(keys), goal.get("entropy"), goal.get("repeats"))
    target = {r.source: r.target for r in mixing.weights(mixing.shares(keys), alpha, goal.get("budget")).collect()}
    for block_tokens in (64, 1 << 18):
        found = mixing.plan(keys, ["doc_id", "digest"], **{"repeats": None, **goal}, block_tokens=block_tokens).collect()
        took = Counter()
        for r in found:
            took[r.source] += r.n_tokens
        assert all(n <= took[s] < n + 10 for s, n in target.items())
        by_doc = {}
        for r in found:
            by_doc.setdefault((r.doc_id, r.digest, r.source), []).append(r["pass"])
        assert all(sorted(p) == list(range(len(p))) for p in by_doc.values())
        assert {(r.doc_id, r.source) for r in found if not r.n_tokens} == {(4, "big"), (4, "small")}
    copies = Counter({k: len(p) for k, p in by_doc.items()})
    mixed = mixing.mixed(docs, **{"repeats": None, **goal})
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, r.digest, r.source) for r in mixed.select("doc_id", F.xxhash64("text").alias("digest"), "source").collect())
    assert got == copies
    placed = mixing.ordered(mixed).collect()
    assert {r.position for r in placed} == {r.position for r in found}


def test_token_order(spark):
    rows = [(i, f"number {i} of many", "big") for i in range(300)] + [(None, f"no id {i}", "small") for i in range(20)] + [(5, None, "big"), (5, "", None)]
    docs = mixing.mixed(clashing(spark, rows), repeats=2.0)
    want = [(r.position, r.doc_id) for r in mixing.ordered(docs).collect()]
    got = corpus_pipeline.token_output(spark, docs, "").orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for _, i in sorted(want)]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    path = f"{shared_dir(spark)}/ordered-tokens"
    tokens.write(mixing.ordered(docs), path, corpus_pipeline.TOKENIZER, order="position")
    ids = [tuple(r.ids) for r in tokens.read(spark, path).orderBy("start").collect()]
    twice = {x for x, n in Counter(ids).items() if n > 1 and len(x) > 1}
    assert twice and sum(a == b and a in twice for a, b in zip(ids, ids[1:])) <= len(twice) / 10  # copies stand apart


def test_token_checksum(spark):
    from pyspark.sql import functions as F

    path = f"{shared_dir(spark)}/broken-tokens"
    tokens.write(table(spark, ["one two three", "four"]), path, corpus_pipeline.TOKENIZER)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc_ids", F.col("crc_ids") + 1).collect()
    spark.createDataFrame(blocks, tokens._BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="checksum"):
        tokens.read(spark, path).collect()


# WARC


def test_warc_splits(spark):
    body = lambda i: f"<p>{i} WARC/1.0\r\nContent-Length: 5\r\n\r\nWARC/1.1</p>" * (30 + i)
    pages = spark.createDataFrame([(i, f"http://a/{i}", body(i)) for i in range(60)], "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/plain-warc"
    warc.records(warc.captures(pages)).coalesce(1).write.option("lineSep", "\r\n\r\n").text(folder)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "20000")
        records = warc.read(spark, folder)
        assert records.count() == 180 and records.filter("not complete").count() == 0
        got = {r.page_id: r.payload_digest for r in warc.resolved(warc.transactions(records)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: hashlib.sha1(body(i).encode()).hexdigest() for i in range(60)}


def test_warc_bodies_of_many_marks():
    """What stands in a body is no record, however many version marks it has, and takes time in proportion."""
    import time

    mark = "WARC/1.0\r\n"
    body = ("x" * 200 + mark).encode() * 20_000
    record = lambda b: f"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    whole = record(body) + record(b"") + record(mark.encode()) + record(body)[:-300]
    chunks = whole.split(warc._MARK)
    began = time.time()
    got = list(warc._records((7, c) for c in chunks))
    assert time.time() - began < 10
    assert [(r["payload"], r["complete"]) for r in got[:3]] == [(body, True), (b"", True), (mark.encode(), True)]
    assert len(got) == 4 and not got[3]["complete"] and body.startswith(got[3]["payload"])


def test_warc_incomplete(spark):
    import os

    folder = f"{shared_dir(spark)}/cut-warc"
    os.makedirs(folder)
    record = lambda kind, name, more, block, n=None: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{more}Content-Length: {len(block) if n is None else n}\r\n\r\n{block}\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\n\r\nhello"
    kind = "Content-Type: application/http\r\n"
    with open(f"{folder}/a.warc", "w", newline="") as f:
        f.write(record("response", "<a>", kind, http) + record("request", "<b>", "WARC-Concurrent-To: <a>\r\n" + kind, "GET /\r\n\r\n") + record("metadata", "<c>", "WARC-Concurrent-To: <gone>\r\n", "page_id: 1") + record("response", "<d>", kind, http, 999))
    open(f"{folder}/b.warc", "w").close()
    records = warc.read(spark, folder)
    assert {(r.record_id, r.complete) for r in records.collect()} == {("<a>", True), ("<b>", True), ("<c>", True), ("<d>", False)}
    (one,) = warc.transactions(records).collect()
    assert one.capture_id == "<a>" and bytes(one.response.payload) == b"hello" and one.request.record_id == "<b>" and one.metadata is None


# Near-duplicates


@pytest.mark.parametrize("limits", [neardup.Limits(4, 2, 1 << 20, 1), neardup.Limits(8, 1024, 300, 2), neardup.Limits(1 << 20)])
def test_neardup_limits(spark, limits):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    texts = list(ODD)
    for size in (40, 12, 5, 3, 2):
        base = [word() for _ in range(120)]
        for _ in range(size):
            other = list(base)
            for at in rng.sample(range(120), rng.randint(0, 4)):
                other[at] = word()
            texts.append(" ".join(other))
    shared = [word() for _ in range(90)]
    texts += [" ".join(shared + [word() for _ in range(40)]) for _ in range(40)]  # alike, but less than asked
    texts += [" ".join(word() for _ in range(60)) for _ in range(40)]
    found = {r.doc_id: r for r in neardup.near_duplicates(table(spark, texts), shingle=4, percent=80, limits=limits).collect()}
    assert [(found[i].n_shingles, found[i].component_id) for i in range(len(texts))] == linked(texts, 4, 80)


def test_dedup_names(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, None, None), (None, "g h i j k l", None), (2, "a b c d e f", "t")]
    docs = clashing(spark, rows)
    got = neardup.dedup(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, "a b c d e f"), (None, None), (None, "g h i j k l")])


def test_components(spark):
    rng = random.Random(9)
    pairs = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5100)] + [(rng.randrange(6000, 6300), rng.randrange(6000, 6300)) for _ in range(200)] + [(7, 7), (9999, 9999)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# Language


def test_long_words():
    import numpy as np

    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)} - {"c"} | {"a", "b", "▁", "▁a", "▁ab"})
    words = langid.Vocabulary(names)
    theta = np.array([[rng.random() / 20, rng.random() / 20] for _ in names])
    for n in (1, 3, 31, 33, 40, 100):
        run = "▁" + "".join(rng.choice("aabbc") for _ in range(n))
        for k in (0, 1):
            sums = [1.0] + [0.0] * len(run)
            for j in range(1, len(run) + 1):
                parts = [sums[j - s] * theta[names.index(run[j - s : j]), k] for s in range(1, min(j, words.longest) + 1) if run[j - s : j] in names]
                sums[j] = sum(parts) if parts else sums[j - 1] * langid.UNKNOWN
            points = np.array([ord(c) for c in run], np.uint32)
            got = langid.log_sum(points, words, theta)[k]
            assert math.isclose(got, math.log(sums[-1]), rel_tol=1e-9)
            if n < langid.STRETCH:
                alpha, _ = langid.forward(points[None, :], words, theta)
                assert math.isclose(got, math.log(alpha[-1, 0, k]) - len(run) * math.log(langid.SCALE), rel_tol=1e-9)


def segmentations(run, names):
    if not run:
        yield []
    for s in range(1, len(run) + 1):
        if run[:s] in names:
            for rest in segmentations(run[s:], names):
                yield [run[:s], *rest]


def test_expectations(monkeypatch):
    import numpy as np
    import pyarrow as pa

    names = ["a", "b", "ab", "ba", "▁", "▁a", "aba"]
    monkeypatch.setattr(langid, "vocabulary", lambda path: langid.Vocabulary(names))
    rng = random.Random(2)
    theta = np.array([[rng.random(), rng.random()] for _ in names])
    model = langid.Model(["x", "y"], np.log(theta), "")
    texts, langs = ["aba ab abab", "ba ba", "bab"], np.array([0, 1, 0])
    want = np.zeros_like(theta)
    for t, k in zip(texts, langs, strict=True):
        for w in t.split():
            ways = list(segmentations("▁" + w, names))
            p = [math.prod(theta[names.index(x), k] for x in way) for way in ways]
            for way, q in zip(ways, p, strict=True):
                for x in way:
                    want[names.index(x), k] += q / sum(p)
    assert np.allclose(langid.expectations(pa.array(texts), langs, model), want)


def test_expectations_of_long_runs():
    """A run of any length: what is expected is theta times the slope of the log of the sum, which is summed elsewhere."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(40)} - {"c"} | {"a", "b", "▁", "▁a"})
    words = langid.Vocabulary(names)
    theta = np.array([rng.random() / 10 + 0.01 for _ in names])
    for n in (1, 5, 33, 100, 400):
        run = "▁" + "".join(rng.choice("aabbc") for _ in range(n))
        points = np.array([ord(c) for c in run], np.uint32)
        number, share = langid.run_expectations(points, words, theta)
        got = np.bincount(number, share, len(names))
        for i in range(len(names)):
            step = theta.copy()
            low, high = theta[i] * (1 - 1e-5), theta[i] * (1 + 1e-5)
            step[i] = high
            up = langid.log_sum(points, words, step[:, None])[0]
            step[i] = low
            down = langid.log_sum(points, words, step[:, None])[0]
            assert math.isclose(got[i], theta[i] * (up - down) / (high - low), rel_tol=1e-4, abs_tol=1e-5 * n)
    short = [w for w in ("ab" * 3, "abcba", "c" * 7)]
    model = langid.Model(["x"], np.log(theta)[:, None], "")
    original = langid.vocabulary
    try:
        langid.vocabulary = lambda path: words
        whole = langid.expectations(pa.array([" ".join(short)]), np.array([0]), model)[:, 0]
    finally:
        langid.vocabulary = original
    each = np.zeros(len(names))
    for w in short:
        number, share = langid.run_expectations(np.array([ord(c) for c in "▁" + w], np.uint32), words, theta)
        np.add.at(each, number, share)
    assert np.allclose(whole, each)  # both ways give the same for words that either can take


def test_language_scores(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the hill", "en"), ("das haus und der berg", "de")] * 20)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(known, f"{queries.TOKENIZERS}/piece_bpe_32k.model", F.lit(True))
    scorer = langid.Scorer(model)
    import pyarrow as pa

    from corpusloom.llm._bytes import Texts, Words

    texts = Texts(pa.array(["the unheard of berg " + "abc" * 40]))
    words = Words(texts, langid.LETTERS)
    first, _ = scorer.of_words(texts, words.start, words.end)
    again, _ = scorer.of_words(texts, words.start, words.end)
    assert (first == again).all()  # a remembered word scores what it did when it was new
    same = langid.predict(known.limit(0).unionByName(spark.createDataFrame([(None, "der berg", None), (1, "der berg", "x"), (1, "der berg", "x")], "doc_id long, text string, lang string")), model).collect()
    assert len({(r.result.lang_pred, r.result.score) for r in same}) == 1 and same[0].result.lang_pred == "de"
    assert langid.predict(known.limit(0), model).count() == 0
    none = langid.train(known.limit(0), f"{queries.TOKENIZERS}/piece_bpe_32k.model", F.lit(True))
    assert {r.result.lang_pred for r in langid.predict(known, none).collect()} == {"und"}


# Classifiers


def test_held_out_toxicity(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").collect()}
    found = [r for r in queries.op7_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in found) >= 0.85 * len(found) > 0
    by = {v: [r.score for r in found if labels[r.doc_id] == v] for v in (0, 1)}
    above = sum((a > b) + (a == b) / 2 for a in by[1] for b in by[0])
    assert above >= 0.85 * len(by[0]) * len(by[1]) > 0  # area under the curve


def test_toxicity_tables(spark):
    kinds, marks = "doc_id long, text string, `row` string, `result` string", "doc_id long, toxic int"
    docs = spark.createDataFrame([(1, "good day", "x", "y"), (2, "bad day", "x", "y"), (2, "bad day", "x", "y"), (None, None, "x", "y")], kinds)
    for rows in ([], [(1, 0), (2, 0)], [(7, 1), (None, 1), (1, None)]):
        scores = [r.result.score for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(rows, marks))).collect()]
        assert len(scores) == 4 and len(set(scores)) == 1 and scores[0] < 0.5
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 1)], marks), longest=7)  # what is longer isn't learned from
    assert {r.result.score < 0.5 for r in toxicity.score(docs, model).collect()} == {False}
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.score(docs, toxicity.train(docs.limit(0), spark.createDataFrame([(1, 1)], marks))).count() == 4


def test_walk():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    forest = trees.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), np.zeros(3, int), trees=10)

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return total

    assert np.allclose(forest.raw(x), [walk(r) for r in x])
    assert ((forest.probability(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.8


def test_held_out_quality(spark, sf_dir):
    from pyspark.sql import functions as F

    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    forest = quality.train(docs, labels.filter(~held_out))
    kept = {r.row.doc_id: r.result for r in quality.judge(docs, forest, carry=["doc_id"]).collect()}
    known = [(kept[r.doc_id], r.quality) for r in labels.filter(held_out).collect()]
    judged = [(k.kept, q) for k, q in known if not k.base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.9 * len(judged) > 0
    whole = {r.doc_id: r for r in queries.op10_quality(spark, folder).collect()}
    assert set(whole) == set(kept) and all(whole[i].base_failed == kept[i].base_failed and not (whole[i].base_failed and whole[i].kept) for i in kept)


# The pipeline's stages on odd rows


def test_stages_on_odd_rows(spark, sf_dir):
    prose = " ".join(f"word{i} and" for i in range(60))
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, prose, None), (None, prose + " more", "s"), (3, prose.upper(), "s"), (3, "the " + " ".join(f"other{i} of" for i in range(60)), "t")] * 2
    for docs in (clashing(spark, rows), clashing(spark, [])):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert name == "mix_sources" or out.count() <= n
        assert corpus_pipeline.token_output(spark, docs, sf_dir).count() == n
    kept = corpus_pipeline.decontamination(spark, clashing(spark, rows), sf_dir).count()
    assert kept == len(rows)


# Odd tables


def test_odd_tables(spark, sf_dir):
    from corpusloom.llm import decontaminate

    item = " ".join(f"k{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, item), (None, "k3 k4")], "item_id long, text string")
    rows = [(None, item, "s"), (1, None, None), (2, "x " + item, "s"), (2, "x " + item, "s"), (2, "", "s")]
    for docs in (clashing(spark, rows), clashing(spark, [])):
        n = docs.count()
        found = decontaminate.contamination(docs, bench).collect()
        assert len(found) == n
        for r in found:
            assert (r.verdict.n_items, r.verdict.contaminated) == ((3, True) if r.row.text else (0, False)) and r.row._copy == "a"
        assert decontaminate.remove(docs, bench).columns == docs.columns and decontaminate.remove(docs, bench).count() == min(n, 2)
        forest = quality.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
        judged = quality.judge(docs, forest).collect()
        assert len(judged) == n and len({tuple(r.result) for r in judged if r.row.doc_id == 2 and r.row.text}) == min(n, 1)
        path = f"{shared_dir(spark)}/odd-ids-{n}"
        tokens.write(docs, path, corpus_pipeline.TOKENIZER)
        read = tokens.read(spark, path).orderBy("start").collect()
        assert [r.doc_id for r in read] == sorted((r[0] for r in rows[:n]), key=lambda i: (i is not None, i))
        mixed = Counter(r.doc_id for r in mixing.mixed(docs).collect())
        assert set(mixed) == {r[0] for r in rows[:n]} and all(mixed[i] >= sum(r[0] == i for r in rows) for i in mixed)


def test_ties(spark):
    model = langid.uniform(["b", "a"][::-1], f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    (r,) = langid.predict(table(spark, ["some words"]), model).collect()
    assert (r.result.lang_pred, r.result.score) == ("a", 0.5)


def test_empty_archives(spark):
    folder = f"{shared_dir(spark)}/no-warc"
    pages = spark.createDataFrame([], "page_id long, url string, html string, `payload` string, `key` string")
    warc.write(pages, folder)
    records = warc.read(spark, folder)
    assert records.count() == 0 and warc.resolved(warc.transactions(records)).count() == 0
    some = spark.createDataFrame([(1, "u", "<p>x", "a", "b"), (1, "u", "<p>x", "a", "b"), (1, "v", "<p>" + "y" * 2000, "a", "b")], pages.schema)
    warc.write(some, f"{folder}-some")
    got = Counter(tuple(r) for r in warc.resolved(warc.transactions(warc.read(spark, f"{folder}-some"))).collect())
    assert sum(got.values()) == 3 and {(r[0], r[1], r[3], r[4]) for r in got} == {(1, 4, "response", None), (1, 2003, "response", None)}
