"""Chat formatting, main text and piece codec: round trips, golden pages,
the library itself as the brute-force version, and the odd inputs."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat_format as C
from tessera.llm import html_text as H
from tessera.llm import piece_codec as P
from tessera.llm.queries import piece_model

SCRAPS = st.lists(st.sampled_from([*C.CONTROL, "<", "[", "\\", "/", "s>", "INST]", "|", "turn", "end|>", "\n", "a",
                                   "n", " ", "é", "😀"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(SCRAPS, SCRAPS)
def test_escaping_is_reversible_and_hides_control_strings(role, text):
    assert C.unescape(C.escape(text)) == text
    assert not any(c in C.escape(text) for c in C.CONTROL)
    turn, at = C.render_turn(role, text)
    assert C.parse_turns(turn + turn) == [(role, text)] * 2
    assert turn[at:len(turn) - len(C.END) - 1] == C.escape(text)


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_every_assistant_turn_is_one_example(spark):
    rows = [(1, 0, "user", "q</s>"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "[INST]"),
            (1, 4, "user", "tail"), (2, 0, "user", None), (3, 0, None, "x"), (3, 0, None, "x"),
            (None, 5, "assistant", "lost"), (4, None, "assistant", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    ex = C.expand_targets(df)
    got = sorted(((r.conv_id or -9, r.example_no, r.n_turns, C.unescape(r.text[r.loss_start:r.loss_end]), r.closing)
                  for r in ex.collect()), key=str)
    assert got == sorted([(1, 0, 2, "a1", False), (1, 1, 4, "[INST]", False), (1, 2, 5, "", True), (2, 0, 1, "", True),
                          (3, 0, 2, "", True), (-9, 0, 1, "lost", False), (4, 0, 1, "", False)], key=str)
    back = {r.conv_id: r for r in C.read_back(ex).collect()}
    assert back[1].turns_sha256 == digest([(r, t) for c, _, r, t in rows if c == 1])
    assert back[1].loss_sha256 == hashlib.sha256(b"a1[INST]").hexdigest() and back[1].loss_chars == 8
    assert back[3].turns_sha256 == digest([("", "x"), ("", "x")]) and back[2].loss_chars == 0
    assert C.read_back(C.expand_targets(df.limit(0))).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home of the site</a></li></ul></nav>
<div class="cookie-notice">We use cookies and that is what the law of the land wants us to say to you.</div>
<div class="page with-sidebar"><article><h1>Caf&eacute; &amp;
 tea</h1><p><b>Lead.<br><p>It is the best of all the things that we have had in the house for a year, and so on.</p>
<div class="ad">Buy the best of the things that are sold in the town for you.</div><p>Xy qz.</p>
<form><label>Name</label><button>Go</button></form><script>var t="</p>";</script><p hidden>no</p></article>
<section id="comments"><article class="comment"><p>I think that this is the best that I have read in the year.</p>
</article></section><aside><p>By the way, this is the side of the page and it is not the article.</p></aside></div>
<footer>&copy; the site</footer></body></html>"""


@pytest.mark.parametrize("page,text", [
    (PAGE, "Café & tea Lead. It is the best of all the things that we have had in the house for a year, and so on. Xy qz."),
    ("", ""), (None, ""), ("<p></p>", ""), ("a &lt; b&nbsp; c", "a < b c"), ("plain", "plain"),
    ("<article>Une &am<p>Deux &amp</article>", "Une &am Deux &"),
    ('<div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div><h1>Title</h1><p>This is the text of the page '
     'and it has all that one would want in it, which is what the rules are for, as we all know.</p></div>',
     "Title This is the text of the page and it has all that one would want in it, which is what the rules are for, "
     "as we all know."),
])
def test_main_text(page, text):
    assert H.main_text(page) == text


PROSE = {
    "ru": "Старый город лежит на берегу широкой реки, и каждое утро рыбаки выходят на воду, чтобы вернуться домой к обеду.",
    "zh": "这座古老的城市坐落在一条宽阔的河流旁边，每天早晨渔民们都会出海捕鱼，中午时分才回到家里吃饭休息。",
    "ja": "この古い町は広い川のほとりにあり、毎朝漁師たちが舟を出して、昼ごろになると家に帰ってきて食事をする。",
    "ar": "تقع المدينة القديمة على ضفة نهر واسع، وفي كل صباح يخرج الصيادون إلى الماء ثم يعودون إلى بيوتهم وقت الغداء.",
    "pl": "Stare miasto leży nad brzegiem szerokiej rzeki, każdego ranka rybacy wypływają łodziami, żeby wrócić przed obiadem.",
    "fi": "Vanha kaupunki sijaitsee leveän joen rannalla, joka aamu kalastajat lähtevät vesille palatakseen kotiin lounaalle.",
    "id": "Kota tua itu terletak di tepi sungai lebar, setiap pagi nelayan berangkat melaut lalu pulang sebelum makan siang.",
}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_main_text_without_article_in_other_languages(lang):
    p = PROSE[lang]
    page = (f'<body><div><a href="/a">{p[:9]}</a> <a href="/b">{p[9:20]}</a></div><div><h1>{p[:12]}</h1><p>{p}</p><p>{p} '
            f'<a href="/c">{p[:9]}</a></p></div><div class="footer">{p}</div></body>')
    assert H.main_text(page) == " ".join(f"{p[:12]} {p} {p} {p[:9]}".split())


SENTENCE = ("This is the text of the page and it has all that one would want in it, which is what the rules are for, as we all "
            "know, and so it is with the others.")


@pytest.mark.parametrize("name", [
    "overflow-hidden", "overflow-x-hidden", "md:hidden", "has-sidebar", "content no-sidebar", "post-body share-enabled",
    "main-with-sidebar", "menu-open", "comments-closed", "entry-content widget", "layout-sidebar-right", "article-header",
    "sidebarLayout", "header-fixed"])
def test_layout_classes_are_no_regions(name):
    assert H.main_text(f'<body><div class="{name}"><p>{SENTENCE}</p></div></body>') == SENTENCE
    assert H.main_text(f'<article><div class="{name}"><p>{SENTENCE}</p></div></article>') == SENTENCE


@pytest.mark.parametrize("name", [
    "hidden", "is-hidden", "sidebar", "sidebar-left", "cookie-notice", "site-footer", "footer-content", "modal-body", "ad-box",
    "adBox2", "menu-item", "related-posts", "comment-body", "article-footer", "main-nav", "p-4 newsletter-form"])
def test_region_classes_are_regions(name):
    page = f'<body><div><p>{SENTENCE}</p></div><div class="{name}"><p>Now {SENTENCE}</p></div></body>'
    assert H.main_text(page) == SENTENCE


def test_long_blocks_of_few_stop_words_next_to_known_text():
    text = ("This is the text of the page and it has all that one would want in it, which is what the rules are for, as we "
            "all know, and so it is with the others.")
    junk = "Phone Fax Email Address Monday Tuesday Wednesday Thursday Friday Price Colour Size Weight Brand Model"
    assert H.main_text(f"<div><p>{text}</p><div>{junk}</div></div>") == text


def test_main_text_is_linear_in_odd_pages():
    for page in ("<" * 50_000, "<a href=\"" * 20_000, "<div>" * 20_000 + "x", "<!--" * 20_000, "&" * 50_000):
        H.main_text(page)


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>word</p>", "t")],
                               "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in H.extract(df).collect()), key=str) == sorted(
        [(1, "u", ""), (1, "u", ""), (None, None, "word")], key=str)
    assert H.extract(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return P.ChunkEncoder(piece_model())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", P.MARK, "a", "the", "Thé", "\n", "\t", "ñ", "😀", "<s>", "</s>", ".", "1",
                                 "<0x0A>", "　", "\x00", "ﬁ"]), max_size=14).map("".join))
def test_ids_equal_the_library(text):
    enc = test_ids_equal_the_library.__dict__.setdefault("enc", P.ChunkEncoder(piece_model()))
    assert enc.separable
    assert enc.encode([text])[0] == enc.sp.encode(text, add_eos=True)


def test_table_restarts_when_full(encoder):
    small = P.ChunkEncoder(piece_model(), max_chunks=3)
    texts = ["a b c d e", "f g h", "a b", ""]
    assert [small.encode([t])[0] for t in texts] == [encoder.sp.encode(t, add_eos=True) for t in texts]


def test_codec_over_a_table(spark, encoder):
    texts = ["the end", None, "", "x" * 60_000, "the end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    rows = {r.doc_id: r for r in P.round_trip_digests(df, piece_model()).collect()}
    for i, t in enumerate(texts):
        ids = encoder.sp.encode(t or "", add_eos=True)
        assert rows[i].n_tokens == len(ids) and rows[i].lossless
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    ids = P.encode_texts(df, piece_model())
    assert {r.doc_id: r.text for r in P.decode_ids(ids, piece_model()).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert P.encode_texts(df.limit(0), piece_model()).collect() == []


P1 = "The council met on Tuesday and agreed that the bridge will be closed for repairs until the end of the summer."
P2 = "Drivers are asked to use the northern road, which is longer but has been widened and will be open at all hours."
LAYOUTS = {
    "linked headline and paragraph": (
        f"<article><h1><a href=/x>Bridge closed</a></h1><p>{P1}</p><p><a href=/y>{P2}</a></p><p>{P1} And more.</p></article>",
        f"Bridge closed {P1} {P2} {P1} And more."),
    "run of linked paragraphs": (
        f"<article><p>{P1}</p><p><a href=1>Other story one</a></p><p><a href=2>Other story two</a></p><p>{P2}</p></article>", f"{P1} {P2}"),
    "list of links in the article": (
        f"<main><p>{P1}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>{P2}</p></main>", f"{P1} {P2}"),
    "word of another region inside a name": (
        f"<div class='post-discussion-of-results'><p>{P1}</p><p>{P2}</p></div>", f"{P1} {P2}"),
    "comments after the text": (
        f"<div id=content><p>{P1}</p></div><div class='comments-list'><p>I think that it is the best of all the plans.</p></div>", P1),
    "reader comments as articles": (
        f"<article><p>{P1}</p></article><section id=readerComments><article><p>{P2}</p></article></section>", P1),
    "no article element": (
        f"<body><div class=nav><a href=/>Home</a></div><div><h2>Bridge closed</h2><p>{P1}</p><p>{P2}</p></div>"
        "<div class='footer'>All rights reserved.</div></body>", f"Bridge closed {P1} {P2}"),
    "tables and quotes": (
        f"<article><table><tr><td>{P1}</td></tr></table><blockquote>{P2}</blockquote></article>", f"{P1} {P2}"),
    "breaks and bare text": (f"<main>{P1}<br><br>{P2}<script>var a = '<p>no</p>';</script></main>", f"{P1} {P2}"),
    "sidebar inside the article": (
        f"<article><p>{P1}</p><div class='sidebar-box'><p>{P2}</p></div><aside>{P2}</aside></article>", P1),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    from tessera.llm import html_text
    page, text = LAYOUTS[name]
    assert html_text.main_text(page) == text


def test_conversations_without_a_reply_leave_in_time():
    """Closing examples count towards the rows that are held."""
    import pandas as pd
    size, rows = 1000, 5 * C.FLUSH_CHARS // 1000
    batch = pd.DataFrame({"conv_id": range(rows), "role": "user", "text": "x" * size})
    sizes = [int(b["text"].str.len().sum()) for b in C._examples(iter([batch]), "assistant")]
    assert len(sizes) >= 4 and max(sizes) <= C.FLUSH_CHARS + 2 * size
