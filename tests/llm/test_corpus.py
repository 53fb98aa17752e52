"""Operators that compare texts with the corpus, labels or benchmarks."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm.conftest import ODD

from shelfscope.llm import catalog, decontaminate, html_text, line_dedup, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_line_dedup_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(catalog.ORACLES["op3_line_dedup"]).fetchall()
    got = catalog.op3_line_dedup(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.removed_lines > 0 for r in got) > 20


def passages(rng, n, words=12):
    return [" ".join(f"{rng.choice('abcdefg')}{rng.randrange(10_000)}" for _ in range(words)) for _ in range(n)]


def test_line_dedup_shifted_passages(docs_of):
    rng = random.Random(2)
    shared = passages(rng, 40)
    pairs = []
    for i in range(6):
        own = passages(rng, i + 1), passages(rng, 3)
        pairs.append((10 + i, "\n".join([*own[0], *shared, *own[1]])))
    alone = [(50 + i, "\n".join(passages(rng, 6))) for i in range(5)]
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs_of(pairs + alone)).collect()}
    assert rows[10].text == pairs[0][1]
    for i, text in pairs[1:]:
        left = rows[i].text.split("\n")
        assert sum(line in left for line in shared) <= 12, "only the edges of the passage may stay"
        assert [line for line in text.split("\n") if line not in shared] == [line for line in left if line not in shared]
        assert rows[i]["__removed"] == len(text.split("\n")) - len(left)
    assert all(rows[i].text == text for i, text in alone)


def test_line_dedup_whole_passages(docs_of):
    """Of passages of 2 to 8 lines and over 50 words between different neighbours no line stays a second time."""
    rng = random.Random(12)
    pairs, own = [], {}
    for k, n in enumerate([2, 3, 4, 5, 6, 7, 8] * 3):
        shared = [passages(rng, 1, rng.randint(1, 49))[0] for _ in range(n)]
        shared[rng.randrange(n)] = passages(rng, 1, 49)[0]
        shared[0] += " and more"
        if k % 2:
            shared.insert(1, "")
        for copy in range(3):
            i = 100 * copy + k
            before, after = passages(rng, rng.randint(1, 4)), passages(rng, rng.randint(1, 4))
            own[i] = before + shared * (copy == 0) + after
            pairs.append((i, "\n".join(before + shared + after)))
    rows = line_dedup.line_dedup(docs_of([*pairs, (900, None), (901, ""), (902, "\n\n")]), passages=True).collect()
    left = {r.doc_id: r.text for r in rows}
    assert {i: left[i].split("\n") for i in own} == own
    assert left[900] is None and left[901] == "" and left[902] == "\n\n" and len(rows) == len(pairs) + 3
    assert all(r["__removed"] == len(t.split("\n")) - len(own[i]) for r in rows for i, t in pairs if r.doc_id == i)


def test_line_dedup_odd_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    pairs = [*ODD, (None, f"x\n{long}\ny"), (20, f"a\n{long}"), (21, long), (21, long), (22, "\n\n\n\n"), (23, "a\n\n\n\nb")]
    docs = docs_of(pairs)
    rows = line_dedup.line_dedup(docs).collect()
    assert len(rows) == len(pairs)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.text)
    assert got[1] == [None] and got[2] == [""] and got[22] == ["\n\n\n\n"] and got[23] == ["a\n\n\n\nb"]
    assert f"x\n{long}\ny" in got[None]  # the row without an id comes first
    assert got[20] == ["a"] and got[21] == ["", ""]
    assert got[4] == ["repeated row"] * 2
    assert rows[0].asDict().keys() - {"__removed"} == set(docs.columns)
    assert line_dedup.line_dedup(docs_of([])).collect() == []


def edit_distance_anywhere(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(before + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(6)
    for _ in range(400):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randint(1, 120)))
        scores = list(decontaminate.columns(decontaminate.masks_of(pattern), len(pattern), text, anchored=False))
        assert min(*scores, len(pattern)) == edit_distance_anywhere(pattern, text)


def test_benchmark_matches_with_edits(docs_of, spark):
    rng = random.Random(8)
    items = [(i, " ".join(passages(rng, 1, rng.randint(8, 40)))) for i in range(12)] + [(90, None), (91, ""), (None, "no id of its own here")]
    pairs, want = [*ODD], {}
    for d in range(100, 160):
        i, item = items[rng.randrange(12)]
        chars = list(item)
        budget = int(decontaminate.ERROR_RATE * len(item))
        edits = rng.choice([0, budget // 2, budget, budget + 12])
        for _ in range(edits):
            at = rng.randrange(len(chars))
            what = rng.randrange(3)
            if what == 0:
                chars[at] = "#"
            elif what == 1:
                chars.insert(at, "#")
            elif len(chars) > 1:
                del chars[at]
        text = " ".join(passages(rng, 3)) + "\n" + "".join(chars).upper().replace(" ", "\n", 2) + " " + " ".join(passages(rng, 2))
        pairs.append((d, text))
        folded = item.translate(decontaminate.FOLDED)
        best = edit_distance_anywhere(folded, text.translate(decontaminate.FOLDED))
        if best <= budget:
            want[d] = (i, best)
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.benchmark_matches(docs_of(pairs), table).collect()
    assert {r.doc_id: (r.item_id, r.distance) for r in rows} == want and len(rows) == len(want)
    in_blocks = decontaminate.benchmark_matches(docs_of(pairs), table, block_chars=300).collect()
    assert sorted(map(tuple, in_blocks)) == sorted(map(tuple, rows))
    kept = {r.doc_id for r in decontaminate.without_benchmarks(docs_of(pairs), table).collect()}
    assert kept == {i for i, _ in pairs} - set(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_matches(docs_of(pairs), none).count() == 0
    assert decontaminate.without_benchmarks(docs_of(pairs), none).count() == len(pairs)
    assert decontaminate.benchmark_matches(docs_of([]), table).count() == 0


def test_short_benchmark_items_are_words(spark, docs_of):
    """An item without an edit to spare is not sought inside words, at either end; where no spaces are set it is."""
    pairs = [(1, "eyesight"), (2, "He said: YES."), (3, "yes"), (4, "yesterday"), (5, "eyes yes"), (6, "\u6211\u662f\u4eba"), (7, "a-yes\u6211"), (8, "2yes")]
    table = spark.createDataFrame([(1, "yes"), (2, "\u662f")], "item_id long, text string")
    rows = decontaminate.benchmark_matches(docs_of(pairs), table).collect()
    assert {(r.doc_id, r.item_id, r.start) for r in rows} == {(2, 1, 9), (3, 1, 0), (5, 1, 5), (6, 2, 1), (7, 1, 2)}
    assert {r.doc_id for r in decontaminate.without_benchmarks(docs_of(pairs), table).collect()} == {1, 4, 8}


def test_benchmark_small_table(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    items = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()
    exact = {
        (d, i)
        for d, t in zip(docs["doc_id"], docs["text"], strict=True)
        for i, x in zip(items["item_id"], items["text"], strict=True)
        if x in (t or "")
    }
    got = catalog.op5_decontaminate(spark, FOLDER).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 0} == exact
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    of_item = dict(zip(items["item_id"], items["text"], strict=True))
    for r in got:
        found = texts[r.doc_id][r.start : r.end].translate(decontaminate.FOLDED)
        assert edit_distance_anywhere(of_item[r.item_id].translate(decontaminate.FOLDED), found) == r.distance


def test_toxicity_held_out(spark):
    larger = "/root/testdata/sf0.1"
    table = pq.read_table(f"{larger}/labels.parquet").to_pydict()
    labels = dict(zip(table["doc_id"], table["toxic"], strict=True))
    rows = catalog.op1_toxicity(spark, larger).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    scored = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, plain = [s for s, y in scored if y], [s for s, y in scored if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in plain])
    assert auc > 0.94


def test_toxicity_counts_and_held_out_labels(spark, docs_of):
    rng = random.Random(4)
    bad = ["vile", "nasty"]
    common = [f"w{i}" for i in range(60)]
    pairs, labels = [], []
    for i in range(1200):
        words = rng.choices(common, k=30)
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad)
        pairs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = docs_of([*pairs, *((i + 5000 if i else None, t) for i, t in ODD)])
    table = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    scores = {r.doc_id: r.toxic_score for r in toxicity.toxicity(docs, table).collect()}
    right = sum((scores[i] >= toxicity.THRESHOLD) == bool(y) for i, y in labels)
    assert right > 0.97 * len(labels)
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.toxic_score for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == scores

    train = [(y, t) for (i, y), (_, t) in zip(labels, pairs, strict=True)]
    frame = spark.createDataFrame(train, "toxic int, text string")
    got = toxicity.continuation_counts(frame, "text").collect()
    before = [defaultdict(set), defaultdict(set)]
    for y, t in train:
        words = t.split()
        for a, b in zip(["", *words], words, strict=False):
            before[y][b].add(a)
    numbers = dict(zip(common + bad, toxicity.word_numbers(pa.array([" ".join(common + bad)]))[1], strict=True))
    assert {r.word: (r.ordinary, r.toxic, r.shared) for r in got} == {
        numbers[w]: (len(before[0][w]), len(before[1][w]), len(before[0][w] | before[1][w])) for w in numbers
    }


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxic_score for r in toxicity.toxicity(docs_of(ODD), none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    assert {r.toxic_score for r in toxicity.toxicity(docs_of(ODD), one).collect()} == {0.0}
    assert toxicity.toxicity(docs_of([]), none).collect() == []


def test_toxicity_counts_rows_the_curve_does_not_use(spark, docs_of):
    """A toxic word found only in rows that could be for calibration is learnt from those the curve leaves."""
    crc = [zlib.crc32(str(i).encode()) for i in range(6000)]
    training = [i for i in range(6000) if crc[i] % 4 != 2]
    reserved = {i for i in training if crc[i] // 4 % 5 == 0}
    rng = random.Random(3)
    common = [f"w{i}" for i in range(40)]
    pairs, labels = [], []
    for k, i in enumerate(training):
        words = rng.choices(common, k=20)
        toxic = k % 3 == 0
        if toxic:
            words[rng.randrange(20)] = "foul" if i in reserved else "vile"
        pairs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    probe = [(10_001, " ".join(["foul", *common[:19]])), (10_002, " ".join(["fresh", *common[:19]]))]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r.doc_id: r.toxic_score for r in toxicity.toxicity(docs_of(pairs + probe), table, calibration_rows=60).collect()}
    assert scores[10_001] > scores[10_002], "a word of counted toxic rows weighs more than one never seen"


def test_toxicity_words_of_one_short_hash(spark, docs_of):
    """Words that share the first 22 bits of their hash are counted and scored apart, by the table and by the join."""
    names = [f"n{i}" for i in range(20_000)]
    hashes = toxicity.word_numbers(pa.array([" ".join(names)]))[0].hashes >> np.uint64(42)
    slot, twins = {}, None
    for name, h in zip(names, hashes.tolist(), strict=True):
        if h in slot:
            twins = slot[h], name
            break
        slot[h] = name
    vile, mild = twins
    rng = random.Random(9)
    common = [f"w{i}" for i in range(40)]
    pairs, labels = [], []
    for i in range(2400):
        words = rng.choices(common, k=12)
        words[rng.randrange(12)] = vile if i % 3 == 0 else mild
        pairs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs = docs_of([*pairs, *((None, t) for _, t in ODD), (9001, f"w1 {vile} w2"), (9002, f"w1 {mild} w2"), (9002, f"w1 {mild} w2")])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    frame = spark.createDataFrame([(y, t) for (_, y), (_, t) in zip(labels, pairs, strict=True)], "toxic int, text string")
    assert toxicity.continuation_counts(frame, "text").count() == len(common) + 2
    sent = toxicity.toxicity(docs, table, keep=["doc_id", "text"]).collect()
    joined = toxicity.toxicity(docs, table, keep=["doc_id", "text"], table_words=0).collect()
    assert Counter((r.doc_id, r.text, round(r.toxic_score, 9)) for r in sent) == Counter((r.doc_id, r.text, round(r.toxic_score, 9)) for r in joined)
    scores = {r.doc_id: r.toxic_score for r in joined}
    assert scores[9001] > toxicity.THRESHOLD > scores[9002]


class Walk(HTMLParser):
    """Words outside script, style and title, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_html_keeps_every_word_of_the_pages(spark):
    table = pq.read_table(f"{FOLDER}/pages.parquet").to_pydict()
    rows = {r.page_id: r.text for r in catalog.op6_html_text(spark, FOLDER).collect()}
    for i, source in zip(table["page_id"], table["html"], strict=True):
        walk = Walk()
        walk.feed(source or "")
        walk.close()
        assert Counter(w for w in rows[i].split() if w != "-") == Counter(w for w in walk.words if w != "-"), i


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>One <b>two<p>three", "One two\n\nthree"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>all of it, in total</table>", "Name       Qty\napple pie  3\nall of it, in total"),
        ("<td>a<td>b", "ab"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<table><tr><td><p>a<p>b</td><td>c<br>d</table>", "a  c\n   d\nb"),
        ("x<pre> a\n  b\n</pre>y", "x\n\n a\n  b\n\ny"),
        ("<div hidden>no</div><p style='display: none'>no</p><span style='visibility:hidden'>no<i style='visibility:visible'>yes</i></span>", "yes"),
        ("<head><title>t</title><style>s</style></head><script>if (a<b) c()</script>seen &amp; <!-- no --> read&nbsp;it", "seen & read\xa0it"),
        ("<details><summary>open me</summary>hidden</details><details open><summary>s</summary>seen</details>", "open me\ns\nseen"),
        ("1 < 2 > 0 <3 & <a href='>'>link</a>", "1 < 2 > 0 <3 & link"),
        ("<blockquote>a<p>b</blockquote>c", "> a\n\n> b\n\nc"),
        ("<dl><dt>T<dd>D</dl>", "T\n    D"),
        ("  <b>a</b> <i> b</i>c ", "a bc"),
        ("<textarea>a\n b</textarea>", "a\n b"),
        ("</p></div></b>", ""),
        ("<!--", ""),
        ("<", "<"),
        ("", ""),
    ],
)
def test_html_layout(source, text):
    assert html_text.visible_text(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("so <math><mi>a</mi><mo>+</mo><mi>b</mi></math> holds", "so a+b holds"),
        ("<math><semantics><msup><mi>x</mi><mn>2</mn></msup><annotation encoding='tex'>x^2</annotation><annotation-xml>no</annotation-xml></semantics></math>", "x 2"),
        ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/><mtext>of <b>all</b></mtext></math>", "1 2 of all"),
        ("a <svg><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs>no<g><path d='M0'/><text x=1>one</text><text>two</text></g></svg> b", "a one two b"),
        ("<svg><style/><text>in<tspan>side</tspan> <textPath href='#p'>along</textPath></text></svg>after", "inside along after"),
        ("<svg><text><tspan x=0 dy=1>first</tspan><tspan x=0 dy=1>second</tspan></text></svg>", "first second"),
        ("<svg><foreignObject><div>boxed</div></foreignObject><text display=none>no</text></svg>", "boxed"),
        ("<svg/>x<svg><rect><p>y", "x\n\ny"),
    ],
)
def test_html_formulas_and_drawings(source, text):
    assert html_text.visible_text(source) == text


def test_html_odd_pages(docs_of):
    pages = [*ODD, (30, "<b>" * 30_000 + "deep"), (31, "<div>" * 5000 + "<p>x" * 5000), (32, '<a href="' * 20_000), (33, "<table>" * 3000 + "y")]
    rows = html_text.html_text(docs_of(pages), "doc_id", "text").collect()
    assert [r.doc_id for r in rows] == [i for i, _ in pages]
    assert rows[0].text == rows[1].text == rows[2].text == "" and rows[12].text == "deep"
    assert html_text.html_text(docs_of([]), "doc_id", "text").collect() == []
    rng = random.Random(1)
    pieces = ["<p>", "</p>", "<td>", "<tr>", "<table>", "</table>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<div>", "</div>", "<pre>", "<br>", "<dd>", "w ", "</td>", "<hr>"]
    for _ in range(500):
        source = "".join(rng.choices(pieces, k=rng.randint(1, 40)))
        assert len(re.findall("w", html_text.visible_text(source))) == source.count("w ")
