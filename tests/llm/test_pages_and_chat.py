import base64
import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred import storage
from kindred.llm import chat, html, queries, warc

from .conftest import SF

PAGES = "page_id long, url string, html string, payload string, digest int, text string"


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark):
    rows = [(i, f"http://h.example/{i}", f"<p>{i % 7}</p>" * 50, None, 1, "x") for i in range(200)]
    rows += [(500, None, None, None, None, None), (501, "a b\r\nc", "", None, None, None), (502, "u", "ü" * 90000, None, None, None), (7, "again", "<p>0</p>" * 50, None, None, None), (7, "again", "<p>0</p>" * 50, None, None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    found = warc.archive_round_trip(pages, archive_bytes=3000).collect()
    last = {}
    for i, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", -1), i)
    want = Counter()
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        first = last[h or ""] == i
        want[(i, len(b), sha(b), "response" if first else "revisit", None if first else last[h or ""])] += 1
    assert Counter(map(tuple, found)) == want
    assert warc.archive_round_trip(pages.where("false")).collect() == []
    alone = warc.archive_round_trip(pages.where("page_id < 20"), least_bytes=10**6).collect()
    assert len(alone) == 22 and {r.record_type for r in alone} == {"response"}


def test_ids_keep_their_type(spark):
    some = ["a b", "null", "x>\r\ny", "100%25+1", "", "é/1", None, "7"]
    pages = spark.createDataFrame([(i, "u", f"<p>{k // 2}</p>") for k, i in enumerate(some)], "page_id string, url string, html string")
    found = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert found.keys() == set(some)
    for k, i in enumerate(some):
        pair = [x for x in some[k // 2 * 2 : k // 2 * 2 + 2] if x is not None]
        assert found[i].refers_to == (None if i == max(pair) else max(pair)) and found[i].record_type == ("response" if i == max(pair) else "revisit")
    numbers = warc.archive_round_trip(pages.selectExpr("cast(length(page_id) as int) as page_id", "url", "html"))
    assert dict(numbers.dtypes)["page_id"] == "int" and {r.page_id for r in numbers.collect()} == {None if i is None else len(i) for i in some}


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_in_pieces(packed, tmp_path):
    """A file that is read in small pieces gives what its bytes in memory give."""
    from pyarrow import fs

    rnd = random.Random(4)
    data = b"".join(archive(30, packed))
    for turn in range(12):
        bad = bytearray(data)
        for _ in range(turn):
            bad[rnd.randrange(len(bad))] ^= 1 + rnd.randrange(255)
        (tmp_path / "x").write_bytes(bad)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f:
            assert list(warc.salvage(warc.Stream(f, 500))) == list(warc.salvage(bytes(bad)))
    source = warc.Held(b"x" * 5000 + b"WARC/1.1\r\n")
    assert all(warc.next_sign(source, 0, piece) == 5000 for piece in (20, 33, 4999, 10**6)) and warc.next_sign(source, 5001) == source.size


class Counting(warc.Held):
    """Notes the longest read and the sum of all."""

    longest, total = 0, 0

    def read(self, at, size):
        out = super().read(at, size)
        self.longest, self.total = max(self.longest, len(out)), self.total + len(out)
        return out


def test_damage_is_read_in_pieces():
    """Wrong lengths, headers without end and cut members do not load the rest of an archive."""
    plain = [warc.record(i, "u", b"payload %d " % i * 2000) for i in range(400)]
    for k in range(20, 40):  # twenty wrong lengths
        plain[k] = re.sub(rb"Content-Length: \d+\r\nWARC|Content-Length: (\d+)\r\n\r\nHTTP", lambda m: b"Content-Length: 9%s\r\n\r\nHTTP" % m[1], plain[k])
    source = Counting(b"".join(plain))
    found = [f[3]["warc-record-id"] for f in warc.salvage(source) if f[0] == "record"]
    assert found == [f"<urn:page:{i}>" for i in range(400) if not 20 <= i < 40]
    assert source.longest <= 1 << 20 and source.total < 4 * source.size
    import os

    data = b"".join([warc.record(0, "u", b"p"), b"WARC/1.1\r\n", os.urandom(6_000_000).replace(b"\r\n", b"  ")])
    source = Counting(data)
    assert [f[0] for f in warc.salvage(source)] == ["record", "gap"] and source.longest <= 1 << 20
    big = warc.member(warc.record(1, "u", os.urandom(6_000_000)))
    source = Counting(warc.member(warc.record(0, "u", b"p")) + big[:-3])
    out = list(warc.salvage(source))
    assert out[0][0] == "record" and out[1][0] == "gap" and out[1][3] == "cut member" and source.longest <= 1 << 20
    out = list(warc.salvage(big + warc.member(warc.record(0, "u", b"p"))))
    assert [f[0] for f in out] == ["record"] * 2 and len(out[0][4]) > 6_000_000


def test_version_lines_alone_take_linear_time():
    began = time.process_time()
    assert [f[0] for f in warc.salvage(b"WARC/1.1\r\n" * 30_000)] == ["gap"]
    assert time.process_time() - began < 5


def test_long_urls(spark):
    rows = [(1, "http://h.example/?" + "a b" * 40000, "<p>x</p>", None, None, None), (2, "u" * 100_000, "<p>x</p>", None, None, None), (3, "v" * 2_000_000, "<p>y</p>", None, None, None), (4, "w", "<p>y</p>", None, None, None)]
    found = {tuple(r)[:2] + (r.record_type, r.refers_to) for r in warc.archive_round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {(1, 8, "revisit", 2), (2, 8, "response", None), (3, 8, "revisit", 4), (4, 8, "response", None)}


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_long_and_cut_headers(packed):
    records = [warc.record(i, "u" * (300_000 if i == 1 else 9), b"p") for i in range(3)]
    parts = [warc.member(r) if packed else r for r in records]
    assert ids(b"".join(parts)) == ([f"<urn:page:{i}>" for i in range(3)], [])
    cut = records[0][:60] + b"\r\n"  # its header does not end before the next record begins
    assert ids(cut + b"".join(parts[1:])) == (["<urn:page:1>", "<urn:page:2>"], [(0, len(cut))])


def test_query_reads_back_each_page(spark):
    want = Counter((r.page_id, len((r.html or "").encode()), sha((r.html or "").encode())) for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in queries.op2_warc_salvage(spark, SF).collect()) == want


def archive(n, packed=True):
    records = [warc.record(i, f"http://x.example/{i}", b"payload %d " % i * (i * 40 + 1)) for i in range(n)]
    return [warc.member(r) if packed else r for r in records]


def ids(data):
    return [f[3]["warc-record-id"] for f in warc.salvage(data) if f[0] == "record"], [(f[1], f[2]) for f in warc.salvage(data) if f[0] == "gap"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = archive(6, packed)
    whole = [f"<urn:page:{i}>" for i in range(6)]
    assert ids(b"".join(parts)) == (whole, [])
    place = [sum(map(len, parts[:i])) for i in range(7)]
    bad = bytearray(b"".join(parts))
    at = place[2] + len(parts[2]) - 12  # in the payload
    bad[at] ^= 0x55
    got, gaps = ids(bytes(bad))
    assert got == whole[:2] + whole[3:] and gaps == [(place[2], place[3])]
    cut = b"".join(parts)[: place[5] + len(parts[5]) // 2]
    assert ids(cut) == (whole[:5], [(place[5], len(cut))])
    junk = parts[0] + b"junk \x1f\x8b\x08 WARC/1.1\r\n nothing" + b"".join(parts[1:])
    assert ids(junk)[0] == whole and len(ids(junk)[1]) == 1
    assert ids(b"\x00" * 100) == ([], [(0, 100)]) and ids(b"") == ([], [])


def test_salvage_of_random_damage():
    rnd = random.Random(3)
    parts = archive(20)
    data = b"".join(parts)
    edges = [sum(map(len, parts[:i])) for i in range(21)]
    for _ in range(30):
        bad, hurt = bytearray(data), set()
        for _ in range(3):
            at = rnd.randrange(len(data))
            bad[at] ^= 1 + rnd.randrange(255)
            hurt.add(max(i for i in range(20) if edges[i] <= at))
        got, gaps = ids(bytes(bad))
        assert {f"<urn:page:{i}>" for i in range(20) if i not in hurt} <= set(got)
        assert all(a < b for a, b in gaps)


def test_gaps_are_logged(spark):
    folder = storage.new_path(spark, "broken")
    local = folder.removeprefix("file://")
    import os

    os.makedirs(local)
    parts = archive(5)
    with open(f"{local}/a.warc.gz", "wb") as f:
        f.write(parts[0] + b"broken" + parts[1][:40] + b"".join(parts[2:]))
    rows = warc.read_warc(spark, folder).orderBy("start").collect()
    assert [r.kind for r in rows] == ["record", "gap", "record", "record", "record"]
    assert rows[1].start == len(parts[0]) and rows[1].stop == rows[2].start and rows[1].reason
    assert rows[2].payload == b"payload 2 " * 81
    assert rows == warc.read_warc(spark, folder, whole_bytes=0).orderBy("start").collect()  # in pieces
    pages, gaps = warc.salvaged(spark, folder)
    assert sorted(r.page_id for r in pages.collect()) == [0, 2, 3, 4] and [(r.start, r.stop) for r in gaps.collect()] == [(rows[1].start, rows[1].stop)]


CONVERSATIONS = "conv_id long, turn long, role string, text string, formatted string, state int"


def test_chat_by_brute_force(spark):
    marks = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|x", "<", "|", "\\", "a\nb", "", "%3C", "é😀"]
    rnd = random.Random(1)
    rows = []
    for c in range(60):
        for k in range(rnd.randrange(1, 9)):
            text = None if rnd.random() < 0.05 else "".join(rnd.choices(marks, k=rnd.randrange(0, 6)))
            rows.append((c, k, rnd.choice(["user", "assistant", "system", None, "to%0Aol<|\n"]) if c % 3 else ["user", "assistant"][k % 2], text, "f", 1))
    rows += [(None, 0, "user", "a", None, None), (70, None, "assistant", "b", None, None), (70, None, "assistant", "b", None, None), (71, 0, "user", "x " * 50000, None, None)]
    turns = spark.createDataFrame(rows, CONVERSATIONS)
    by = {}
    for c, k, r, t, *_ in rows:
        by.setdefault(c, []).append((-1 if k is None else k, r or "", t or ""))
    got = {r.conv_id: r for r in chat.digest_conversations(turns).collect()}
    formatted = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert got.keys() == by.keys()
    for c, some in by.items():
        some.sort()
        r = got[c]
        learned = "".join(t for _, x, t in some if x == "assistant")
        assert r.n_turns == len(some)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for _, x, t in some).encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == len(formatted[c].formatted)
        assert formatted[c].formatted.count("<|im_start|>") == formatted[c].formatted.count("<|im_end|>") == len(some)
        roles = [x for _, x, _ in some]
        follows = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
        bad = next((i for i, (a, b) in enumerate(zip(["", *roles], roles, strict=False)) if b not in follows.get(a, ())), -1)
        assert (r.first_bad_turn, r.valid) == (bad, bad < 0)
    assert chat.digest_conversations(turns.where("false")).collect() == []


@pytest.mark.parametrize("template", [
    chat.Template(open_turn="[INST]", after_role=": ", close_turn="[/INST]"), chat.Template(open_turn="$1{", after_role="|", close_turn="}\n"), chat.Template(open_turn="éa.*", after_role="\t", close_turn="."),
    chat.Template(train_close=True, loss_roles=("user", "assistant")),
])
def test_other_templates(spark, template):
    rnd = random.Random(7)
    marks = [template.open_turn, template.after_role, template.close_turn, template.open_turn[0], template.open_turn[1], "\\", "x", "%", "<|im_start|>"]
    rows = [(i, k, rnd.choice(["user", "assistant", "a" + "".join(rnd.choices(marks, k=2))]), "".join(rnd.choices(marks, k=rnd.randrange(7)))) for i in range(40) for k in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r.turns for r in chat.format_conversations(turns, template).select("conv_id", chat.read_turns(F.col("formatted"), template).alias("turns")).collect()}
    for i in range(40):
        assert [tuple(x) for x in found[i]] == [(r, t) for c, _, r, t in rows if c == i]


def test_templates_that_do_not_hold():
    for bad in (dict(open_turn="<"), dict(open_turn="<<x"), dict(open_turn="\\|"), dict(close_turn="|end"), dict(after_role=""), dict(close_turn="x<|im_start|>")):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chat_query_has_no_python(spark):
    found = queries.op3_chat_format(spark, SF)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    r = found.where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.valid


def expected(page):
    import html as h

    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    clean = [re.sub(r"[ \t\n\r\f\v]+", " ", h.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b))).strip() for b in blocks]
    return "\n\n".join(b for b in clean if b)


def test_main_text_of_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op7_html_extract(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == expected(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain words only", "plain words only"), ("<p>a<p>b", "a\n\nb"),
    ("<nav>menu here</nav><article><h1>T</h1><p>one  &amp;\n two</p><aside>side</aside><p>three</p><form>f</form><div class='comments'><article class=comment>no</article></div></article><footer>f</footer>", "T\n\none & two\n\nthree"),
    ("<article><p>x</article><div class=ad>many words in this advert that is much longer than the text</div>", "x"),
    ("<article></article><p>words outside of it</p>", "words outside of it"), ("<article></article><div class=ad>words outside of it</div>", ""),
    ("<body><script>if (a<b) x='</p>'</script><style>p{}</style><p>text &lt;b&gt;</p><!-- note <p>no</p> --></body>", "text <b>"),
    ("<main><div>a <b>b</b>c</div><ul class='menu'><li>m</ul><p class='notice'>n<p>d</main>", "a bc\n\nd"),
    ("<article><p>unclosed <i>tag<p>next", "unclosed tag\n\nnext"),
])
def test_html_cases(page, text):
    assert html.main_text(page, {}) == text


WEIGHTS = {"nav nav": 8.0, "hr": 3.0, "div.zone7 div": 6.0, "div.zone7 /div": 6.0, "div.zone7 #": 0.01, " #": 0.9}


@pytest.mark.parametrize("page, text", [
    ("<article class='card'>teaser</article><nav><a>x</a></nav><div class='content'><p>the long text of the page is here</p><p>and here</p></div>", "the long text of the page is here\n\nand here"),
    ("<main><p>short start</p><hr><hr><p>a longer part that has the run</p></main><nav><a>x</a></nav><p>out</p>", "a longer part that has the run"),
    ("<article><p>first of two</p></article><article><p>second of two</p></article>", "first of two\n\nsecond of two"),
    ("<div><p>a lead that stands before it</p></div><article><p>the text itself</p></article>", "a lead that stands before it\n\nthe text itself"),
    ("<div class=zone7>many words of a teaser that no list knows as one</div><p>the text itself</p><p>goes on</p>", "the text itself\n\ngoes on"),
    ("<hr><p>one <i>two</i><hr>three four five six seven</p>", "three four five six seven"),
])
def test_run_fixes_the_region(page, text):
    assert html.main_text(page, WEIGHTS) == text


def test_weights_decide():
    page = "<div class=zone7>many words of a teaser that no list knows as one</div><p>the text itself</p>"
    assert html.main_text(page, {}) == "many words of a teaser that no list knows as one\n\nthe text itself"
    assert html.main_text(page, WEIGHTS) == "the text itself"
    counts = html.label_counts([f"<div class=zone7>w{i} x y</div><article><p>a b c</p></article>" for i in range(50)])
    assert html.main_text(page.replace("<p>", "<div><p>"), html.weights(counts)) == "the text itself"


def test_pages_without_marks(spark):
    """Labels teach the weights; pages that lack the marks give the same text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weight = html.fitted_weights(pages)
    bare = pages.withColumn("html", F.regexp_replace("html", "</?(article|main)[^>]*>", ""))
    want = {r.page_id: expected(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html.extract_main_text(bare, weight=weight).collect()} == want
    other = {k: v if k.endswith("#") else 8.0 - v for k, v in weight.items()}
    assert sum(r.text != want[r.page_id] for r in html.extract_main_text(pages, weight=other).collect()) > len(want) // 2


@pytest.mark.parametrize("part", ['<a ', '<a "', "<div>", "<!", '<a b=">"', "<a x='\"<a y=\"'", "<p>", "<li>", "<", "<table><td>", "<b><div></b>"])
def test_html_takes_linear_time(part):
    began = time.process_time()
    html.main_text(part * 100_000, {})
    html.main_text(part * 50_000 + "</i>" * 50_000, {})
    assert time.process_time() - began < 10


@pytest.mark.parametrize("page, text", [
    ("<body class='single-post has-sidebar'><article class='post no-comments'><p>text</p></article></body>", "text"),
    ("<html class='menu'><body class='sticky-header'><main id='sidebar'><p>text</p></main></body></html>", "text"),
    ("<article class='comments'><h2 id='social-history'>Social history</h2><section id='discussion'><p id='notice'>text</p></section><h3 class='header'>End</h3></article>", "Social history\n\ntext\n\nEnd"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <object data=f>shown instead</object></p></article>", "so x=2 holds shown instead"),
    ("<article><p>text</p><div class='wide ad'>a</div><div class='cookie-banner'>b</div><div id='sidebar'>c</div></article>", "text"),
])
def test_what_is_boilerplate(page, text):
    assert html.main_text(page, {}) == text


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, None, None, "t"), (None, None, "<article>a</article>", None, None, "t"), (2, "v", "<article>" + "<p>w</p>" * 20000 + "</article>", None, None, None), (2, "v", "", None, None, None)], PAGES)
    found = sorted(((r.page_id or 0, r.text) for r in html.extract_main_text(pages).collect()), key=str)
    assert found == [(0, "a"), (1, ""), (2, ""), (2, "\n\n".join(["w"] * 20000))]
    assert html.extract_main_text(pages.where("false")).collect() == []


def test_best_run():
    rnd = random.Random(2)
    for _ in range(200):
        x = [rnd.choice([-2, -1, 0, 1, 3]) for _ in range(rnd.randrange(0, 12))]
        a, b = html.best_run(x)
        assert sum(x[a:b]) == max((sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1)), default=0)


def test_weights_come_from_labelled_pages(spark):
    w = html.fitted_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    assert w["nav nav"] > w["p"] and w["nav li"] > w["p"] and w["nav #"] < w[" #"] and F is not None


def test_templates_that_misread_are_refused(spark):
    for marks in (("<|T|>", ":<", "#"), ("<|T|>", ":<|", "#"), ("<|<|", ":", "#<|"), ("<|T|>", "2", "#"), ("A|T", ":", "#"), ("<|", ":", "#<|")):
        with pytest.raises(ValueError):
            chat.Template(*marks)
    # random marks of few signs: a template is refused, or all turns come back, whatever texts and roles hold
    rng, accepted, refused = random.Random(5), [], 0
    while len(accepted) < 24:
        marks = ["".join(rng.choice("<|:") for _ in range(rng.randint(least, 4))) for least in (2, 1, 1)]
        try:
            accepted.append(chat.Template(*marks))
        except ValueError:
            refused += 1
    assert refused
    word = lambda: "".join(rng.choice("<|:\\%x") for _ in range(rng.randint(0, 6)))
    given = {i: [(word(), word()) for _ in range(rng.randint(1, 4))] for i in range(200)}
    given[200] = [(t.after_role, t.open_turn[1:]) for t in accepted] + [(t.open_turn, t.close_turn + t.open_turn) for t in accepted]
    rows = spark.createDataFrame([(i, k, *x) for i, xs in given.items() for k, x in enumerate(xs)], "conv_id long, turn long, role string, text string")
    for t in accepted:
        back = chat.format_conversations(rows, t).select("conv_id", chat.read_turns(F.col("formatted"), t).alias("turns")).collect()
        assert {r.conv_id: [(x.role, x.text) for x in r.turns] for r in back} == given, t
