"""Page text and chat formatting."""

import hashlib
import random

from pyspark.sql import functions as F

from readlens.llm import chat, html


# ---- pages ---------------------------------------------------------------------------
def text_of(markup):
    return " ".join(t for t, _ in html.Page(markup).kept())


def test_page_text():
    assert text_of("<html><body><nav><ul><li>menu</ul></nav><article><h1>T &amp; t</h1><p><b>one\n two<br>three<p>fo<i>ur</i></article>"
                   "<footer>&copy; x</footer></body>") == "T & t one two three four"
    assert text_of("<div class='ad'>buy</div><main><p>a&nbsp;b</p><form>q</form><section id=comments><p>no</p></section></main><p>x") == "a b"
    assert text_of("<p>only<p>body<script>var a='</p>';</script><style>p{}</style><!-- c --> text") == "only body text"
    assert text_of("<article>a <span class='share-buttons'>tweet</span> b<aside>s</aside><button>k</button></article>") == "a b"
    assert text_of("a < b &lt; c") == "a < b < c"
    for broken in ("", "<", "<p", "<!--", "<article><p>x", "</p></div>", "<a href='x>y", "<script>never", "<article></nav>t</article>"):
        text_of(broken)
    assert text_of("<article><p>x") == "x"
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def page(host, i, body):
    return (i, f"https://{host}/p/{i}?q=1", body)


def test_templates_recur_on_their_host(spark):
    box = "<div><p>Sign our petition today</p></div>"
    rows = [page("a.example", i, f"<body><p>own {i}</p>{box}<div><p>part {i}</p></div></body>") for i in range(12)]
    rows += [page("b.example", 100 + i, f"<body><p>own {i}</p>{box if i == 0 else ''}</body>") for i in range(12)]
    rows += [page("c.example", 200 + i, "<article><p>a copy of one article</p><p>on many pages</p></article>") for i in range(12)]
    rows += [(None, None, None), (300, "not a url", ""), (100, "https://b.example/p/100?q=1", f"<body><p>own 0</p>{box}</body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("box"))
    got = html.extract(pages)
    text = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows)
    assert text[3] == "own 3 part 3" and text[100] == "own 0 Sign our petition today"
    assert text[205] == "a copy of one article on many pages" and text[None] == "" and text[300] == ""
    assert {r.n_chars for r in got.where("page_id = 3").collect()} == {len("own 3 part 3")}
    assert html.extract(pages.where("false")).count() == 0


def test_copies_in_a_box_stay_whole(spark):
    copy = "<article><div class=body><p>one article</p><p>copied often</p></div></article>"
    box = "<div><p>Sign our petition today</p></div>"
    rows = [page("d.example", i, copy) for i in range(12)]
    rows += [page("e.example", 100 + i, f"<body><p>own {i // 2}</p>{box}</body>") for i in range(12)]
    text = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {text[i] for i in range(12)} == {"one article copied often"}
    assert {text[100 + i] for i in range(12)} == {f"own {i}" for i in range(6)}


def test_most_text_in_recurring_elements(spark):
    """Articles in nested boxes, on a large and a small host: what recurs goes at any share of the pages, the rest stays."""
    def body(i, more=""):
        return (f"<body><div id=w><article><section><div class=lead><p>lead {i}</p></div><div class=box><p>Read our rules</p></div>"
                f"<table><tr><td>cell {i}</table><p>All rights are with the writers</p></section>{more}</article></div></body>")

    rows = [page("large.example", i, body(i, "<section><p>written in the spring</p></section>" if i % 40 == 0 else "")) for i in range(240)]
    rows += [page("small.example", 1000 + i, body(i)) for i in range(4)]
    rows += [page("plain.example", 2000 + i, f"<body><p>Thank you for reading</p><h2>Title {i}</h2><blockquote>said {i % 3}</blockquote></body>") for i in range(9)]
    text = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()}
    # six of 240 pages have the spring section: a template by its count, though few pages have it; prose in the article stays
    assert all(text[i] == f"lead {i} cell {i} All rights are with the writers" for i in range(240))
    assert all(text[1000 + i] == f"lead {i} Read our rules cell {i} All rights are with the writers" for i in range(4))
    # no article: recurring blocks of any kind go; each quotation stands on three pages only
    assert all(text[2000 + i] == f"Title {i} said {i % 3}" for i in range(9))


def test_a_very_long_page(spark):
    words = " ".join(f"<b>w{i}</b> &amp;" for i in range(60_000))
    rows = [page("long.example", 1, f"<article><p>{words}</p></article>"), page("long.example", 2, "<div>" * 500 + words + "</div>" * 500)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = " ".join(f"w{i} &" for i in range(60_000))
    assert got[1].text == got[2].text == want and got[1].n_chars == len(want)


def test_given_pages(spark):
    import html as H
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(H.unescape(re.sub("<(/?(p|h1|br))\\b[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


# ---- chats ---------------------------------------------------------------------------
def test_escaping_is_reversible():
    r = random.Random(5)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "[", "<|", "s>", "/s>", "a", "\n", "|>", "[INST", "é"]
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(8)))
        escaped = chat.re.sub(chat._ESCAPE, r"\1\\\2", text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        out[c] = (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_conversations_brute_force(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "b</s>\\"), (2, 5, "user", ""), (2, 1, "assistant", "<|end|>\n<|turn|>x"),
            (2, 1, "assistant", "again"), (2, 1, "assistant", "again"), (3, None, None, "x" * 200_000), (None, 1, "user", "😀"), (4, 1, "assistant", "日本")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(0).alias("seq"), F.lit("edit").alias("op"))
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.format_conversations(chats).collect()}
    assert got == brute_chat(rows + probe)
    assert [r.conv_id for r in chat.format_conversations(chats.where("false")).collect()] == [-1]


def test_given_conversations(spark):
    chats = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.format_conversations(chats).collect()}
    rows = [tuple(r) for r in chats.select("conv_id", "turn", "role", "text").collect()]
    assert got == brute_chat([*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)])


def test_event_log_is_folded(spark):
    log = [(1, 1, "message", 0, "user", "hel"), (1, 2, "delta", 0, None, "lo"), (1, 3, "message", 1, "assistant", ""), (1, 4, "delta", 1, None, "wrong"),
           (1, 5, "message", 2, "user", "really?"), (1, 6, "regenerate", 1, "assistant", "rig"), (1, 7, "delta", 1, None, "ht"),
           (1, 8, "message", 2, "user", "thanks"), (1, 9, "edit", 0, "user", "hello!"), (2, 1, "message", 0, "user", "other")]
    events = spark.createDataFrame(log, "conv_id long, seq long, op string, turn long, role string, text string")
    got = [tuple(r) for r in chat.fold(events).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "hello!"), (1, 1, "assistant", "right"), (1, 2, "user", "thanks"), (2, 0, "user", "other")]
    rendered = chat.render(chat.fold(events)).orderBy("conv_id", "turn").collect()
    assert chat.read_turns("".join(r.formatted for r in rendered if r.conv_id == 1)) == [("user", "hello!"), ("assistant", "right"), ("user", "thanks")]
