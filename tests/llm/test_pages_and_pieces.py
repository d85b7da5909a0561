"""Main text of pages, and segmentation against enumeration."""

import random
import zlib

import numpy as np
import pytest

from barsight.llm import html_main, pieces

from .edge import ROWS, table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header>Site name</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First&nbsp;&eacute; <i>part</i><br>goes on<p>Second  one
<form>Mail <input></form><div class=ad>Buy!</div><ul><li>item 1<li>item 2</ul><!-- not > this -->
<section id="comments"><p>Great post</p></section></article><aside>Side</aside><footer>Foot</footer>"""


def test_article_without_its_surroundings():
    assert html_main.main_text(PAGE) == "Head & line\n\nFirst é part goes on\n\nSecond one\n\nitem 1\n\nitem 2"


def test_page_without_article_takes_the_container():
    page = "<body><div class=top>Hi <a href=1>login</a></div><div class=story><p>Long text here</p><p>More</p></div><div><a href=2>link list</a></div>"
    assert html_main.main_text(page, "/body/div.story") == "Long text here\n\nMore"
    assert html_main.main_text(page, None) == "Long text here\n\nMore"


STORY = "<p>The story's first lines are here</p><p>and it goes on for a while</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='has-sidebar'>{STORY}<div class=sidebar>Side</div></body>",
        f"<body><div class='content-with-sidebar'>{STORY}</div><div class=sidebar>Side</div></body>",
        f"<body><div class='page widgets'><article class='post comments-open'>{STORY}<div class=ad>Buy</div></article></div></body>",
        f"<body><main id='search-result-page'>{STORY}</main><div class=login>{STORY * 3}</div></body>",
        f"<body><article class=post>{STORY}</article><div class=comments><article class=comment>{STORY}</article></div></body>",
        f"<body><div id=share-wrap><main>{STORY}</main></div><footer class=footer>{STORY * 9}</footer></body>",
    ],
)
def test_class_words_do_not_rule_out_the_text(page):
    assert html_main.main_text(page) == "The story's first lines are here\n\nand it goes on for a while"


@pytest.mark.parametrize("page", ["", "text only", "<", "<p", "</p></div>", "<b><b><p>a", "<script>x", "<!-- x", "&am &lt;b&gt;", "<p>" * 5000])
def test_broken_pages_do_not_fail(page):
    html_main.main_text(page)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, site string, total int")


def test_template_text_goes_and_copies_make_no_template(spark):
    fixed = "<p>Share this story with your friends</p>"
    rows = [(i, f"https://a.example/{i}", f"<article><h1>T{i}</h1><p>Body {i} text</p>{fixed}</article>") for i in range(8)]
    copy = "<article><h1>Same</h1><p>The one article</p></article>"
    rows += [(100 + i, f"https://b.example/{i}", copy) for i in range(30)] + [(200, "https://b.example/x", "<article><p>Other</p></article>")]
    rows += [(300, None, None), (301, "", ""), (302, "no url", "<p>Loose text"), (302, "no url", "<p>Loose text"), (None, "https://c.example", "<main>Main")]
    got = html_main.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"T{i}\n\nBody {i} text" for i in range(8))
    assert all(text[100 + i] == "Same\n\nThe one article" for i in range(30))
    assert (text[300], text[301], text[302], text[None]) == ("", "", "Loose text", "Main")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_main.extract(pages(spark, [])).collect() == []


def test_classes_share_their_vector(spark):
    rows = [(i, "https://a.example/", f"<article><p>P{i}</p><p>fix one</p>{'<p>fix two</p><p>fix three</p>' if i % 2 else ''}</article>") for i in range(10)]
    found = html_main.classes(pages(spark, rows)).where("text <> 0").collect()
    assert sorted((r["pages"], r["members"]) for r in found if r["pages"] > 1) == [(5, 2), (5, 2), (10, 1)]


def story(i, body):
    return i, "https://a.example/", f"<body><div class=story>{body}</div><div class=end><a href=1>More of it</a></div></body>"


def test_events_are_balanced():
    found = html_main.events(PAGE + "<ul><li>a<li><div>b</ul><p>c")
    open_ = []
    for kind, role, text, *_ in found:
        if kind == html_main.OPEN:
            open_.append(role)
        elif kind == html_main.CLOSE:
            assert open_.pop() == role
        else:
            assert text and role == (open_ or [""])[-1]
    assert not open_ and len(html_main.blocks(PAGE)) > 10


def test_slots_of_the_template_decide(spark):
    label = ["Filed under the long history of towns", "Filed under the long history of gardens"]
    rows = [story(i, f"<p>{label[i % 2]}</p><h2>T{i}</h2><p>Body {i}</p>{'<p>And more</p>' * (i % 3)}") for i in range(30)]
    text = {r["page_id"]: r["text"] for r in html_main.extract(pages(spark, rows)).collect()}
    # both are paragraphs of one element: only the gap of the class they stand in tells them apart
    assert all(text[i] == "\n\n".join([f"T{i}", f"Body {i}", *["And more"] * (i % 3)]) for i in range(30))


def plain_classes(rows):
    """{(role, text): class} of valid classes by definition, all pairs of tokens compared."""
    found = [html_main.events(h) for _, _, h in rows]
    places = []
    for page in found:
        here = {}
        for at, (kind, role, text, *_) in enumerate(page):
            here.setdefault((role, text, kind == html_main.CLOSE), []).append(at)
        places.append(here)
    vector = {}
    for token in {t for here in places for t in here}:
        vector[token] = tuple(len(here.get(token, ())) for here in places)
    often = {t: v for t, v in vector.items() if sum(map(bool, v)) >= 0.1 * len(rows)}

    def ordered(a, b):
        def before(x, y):
            return all(p < q for here in places for p, q in zip(here.get(x, ()), here.get(y, ()))) and all(
                q < p for here in places for p, q in zip(here.get(x, ())[1:], here.get(y, ()))
            )

        return before(a, b) or before(b, a)

    wrong = {t[:2] for t in often if any(u != t and often[u] == often[t] and not ordered(t, u) for u in often)}
    return {t[:2]: t[:2] if t[:2] in wrong else often[t] for t in often}


def test_valid_classes_equal_their_definition(spark):
    two = ["<p>Share this</p>", "<div class=x><p>Print that</p></div>"]
    rows = [
        story(i, f"{''.join(two[:: 1 if i % 4 else -1])}<ul>{''.join(f'<li><b>{i}</b><p>{i}-{j}</p></li>' for j in range(i % 3 + 1))}</ul>{'<h3>Odd</h3><h4>One</h4>' * (i % 2)}")
        for i in range(12)
    ]
    got = {(r["role"], r["text"]): r["class"] for r in html_main.templates(pages(spark, rows)).collect()}
    want = {(html_main._hash(role), html_main._hash(text) if text else 0): c for (role, text), c in plain_classes(rows).items()}
    assert got.keys() == want.keys()
    assert len(set(want.values())) > 5 and all((got[a] == got[b]) == (want[a] == want[b]) for a in got for b in got)


def test_crossing_spans_are_found():
    def token(role, c, place, close, pages):
        return {"role": html_main._hash(role), "text": 0, "class": c, "place": place, "close": close, "pages": pages, "total": 10, "members": 2}

    def page(*borders):
        return [(html_main.CLOSE if b[0] == "/" else html_main.OPEN, b.strip("/"), "", 0, True, False) for b in borders]

    # a and b are siblings of one class; c holds b only
    template = html_main.Template([token("a", 1, 0, 1, 10), token("b", 1, 3, 4, 10), token("c", 2, 2, 6, 8), token("d", 2, 7, 8, 8)])
    assert template.faults(page("a", "/a", "c", "b", "/b", "/c", "d", "/d")) == (set(), {2})
    assert template.faults(page("a", "/a", "b", "c", "/c", "d", "/d", "/b")) == (set(), set())
    fixed = {**token("e", 1, 1.5, 1.5, 10), "text": html_main._hash("Home")}
    template = html_main.Template([token("a", 1, 0, 9, 10), token("e", 2, 1, 2, 10), fixed])
    home = [*page("a", "e"), (html_main.TEXT, "e", "Home", 0, False, False), *page("/e", "e", "/e", "/a")]
    assert template.faults(home) == ({(html_main._hash("e"), html_main._hash("Home"))}, set())
    template = html_main.Template([token("a", 1, 0, 1, 10), token("b", 1, 3, 4, 10)])
    assert template.faults(page("b", "/b", "a", "/a")) == ({(html_main._hash("a"), 0), (html_main._hash("b"), 0)}, set())


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.model_path())


def every(p, chars, at=0):
    if at == len(chars):
        yield 0.0, []
        return
    for end in range(at + 1, len(chars) + 1):
        for start, score, ids in pieces.edges(p, chars, end):
            if start == at:
                for rest, more in every(p, chars, end):
                    yield score + rest, ids + more


def test_best_lists_equal_enumeration(model):
    rng = random.Random(6)
    for _ in range(150):
        word = " " * rng.randint(0, 3) + "".join(rng.choice("theandingé\n▁☃") for _ in range(rng.randint(1, 8)))
        full = sorted(every(model, pieces.inner(word)), key=lambda x: -x[0])
        got = pieces.n_best(model, word, 5)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in full[:5]])
        score, gap, ids = pieces.segmented(model, [word])
        assert score[0] == pytest.approx(full[0][0]) and (full[0][0], ids[0]) in [(pytest.approx(s), x) for s, x in full]
        assert gap[0] == (pytest.approx(full[0][0] - full[1][0]) if len(full) > 1 else np.inf)


def test_best_of_whole_texts(spark, model):
    rows = [(0, "the and"), (1, "an  in"), (2, ""), (3, None), (4, "a\nb")]
    got = {r["doc_id"]: r for r in pieces.encode(table(spark, rows), best=4).collect()}
    for i, text in rows:
        chars = [c for w in pieces.marked(text or "") for c in pieces.inner(w)]
        full = sorted(every(model, chars), key=lambda x: -x[0])
        assert got[i]["scores"] == pytest.approx([s for s, _ in full[:4]])
        assert set(got[i]["ids_crc32"]) <= {zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in full}
        assert len(set(got[i]["ids_crc32"])) == len(got[i]["scores"])
        assert got[i]["round_trip"]


def test_piece_edge_cases(spark):
    got = pieces.encode(table(spark)).collect()
    assert len(got) == len(ROWS) and all(r["round_trip"] for r in got)
    assert all(r["scores"] == sorted(r["scores"], reverse=True) for r in got)
    assert pieces.encode(table(spark, [])).collect() == []


def test_ids_decode_to_the_texts(spark):
    rows = [(0, "the and"), (1, "an  in é\n\tx"), (2, ""), (3, None), (4, "漢 🙂 end ")]
    got = pieces.encode(table(spark, rows), best=3)
    for r in got.collect():
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in r["ids"]] == r["ids_crc32"] and len(r["ids"][0]) == r["n_pieces"]
    back = pieces.decode_table(got.selectExpr("doc_id", "ids[size(ids) - 1] AS ids"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in rows}


def test_pieces_are_encoded_in_parts(monkeypatch):
    """A batch is cut between texts, and the parts give what the whole batch gives."""
    import pyarrow as pa

    from barsight.llm import pieces

    texts = ["one two three", None, "", "a longer text than the part holds " * 5, "four", "five six"]
    batch = pa.record_batch({"id": pa.array(range(6), pa.int64()), "text": pa.array(texts, pa.string())})
    whole = pa.Table.from_batches(pieces._encoded([batch], pieces.model_path(), 3))
    monkeypatch.setattr(pieces, "PART", 20)
    monkeypatch.setattr(pieces, "KEPT", 2)
    parts = list(pieces._encoded([batch], pieces.model_path(), 3))
    assert [x.num_rows for x in parts] == [3, 1, 2]
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    assert [x.num_rows for x in pieces._parts([batch.slice(0, 0)])] == [0]


def test_words_without_pieces_keep_their_order_in_a_batch():
    """Words of one length, some with characters that are spelled in bytes, segmented together and alone."""
    model = pieces.load(pieces.model_path())
    words = [" 漢\U0001f9ffa", " abc", " ▁bc", "\U0001f9ff\U0001f9ffbc", " the", "a", "\U0001f9ff", " zq\U0001f9ffzq\U0001f9ff"]
    score, gap, ids = pieces.segmented(model, words)
    for i, word in enumerate(words):
        best = pieces.n_best(model, word, 2)
        assert ids[i] == best[0][1] and score[i] == pytest.approx(best[0][0])
        assert gap[i] == (pytest.approx(best[0][0] - best[1][0]) if len(best) > 1 else np.inf)
    # what each piece says is made once for a model
    assert [pieces.decode(model, [x]) for x in ids[4]] == [model.spoken[x].decode()[1:] for x in ids[4]]
    assert pieces.decode(model, pieces.n_best(model, " ", 1)[0][1] + ids[0] + ids[7])[1:] == words[0][1:] + words[7]
