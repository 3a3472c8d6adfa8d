"""Main text of hand-written pages in unlike layouts, none made by the rule that the field is trained on, and of very large pages."""

import re
import time
from collections import Counter

import pytest

from cloudstrata.llm import html_text

#: What is within [[ and ]] is main text.
PAGES = {
    "old page without containers": """<html><head><title>Notes on bread</title></head><body bgcolor=white><center><a href=index.html>Home</a> | <a href=list.html>List</a> | <a href=mail.html>Mail</a></center>
<hr><h1>[[Notes on bread]]</h1>[[Flour, water and salt are all that a loaf needs, and time does the rest of the work.]]<p>[[The dough should rest for a night in a cool place. In the morning it is folded twice and shaped.]]
<p>[[Bake it hot, and let it cool before the first cut, however hard that is.]]<hr><font size=1>Copyright 1997 the author. All rights reserved.</font></body></html>""",
    "table layout": """<html><body><table width=100%><tr><td colspan=2><img src=logo.gif><a href=/>The Harbour Times</a></td></tr><tr><td class=menu width=150><a href=/n>News</a><br><a href=/s>Sport</a><br><a href=/w>Weather</a></td>
<td class=content><h2>[[Ferry to run all winter]]</h2><p>[[The council decided on Monday that the ferry to the island will run through the winter for the first time in ten years.]]</p>
<p>[[Two boats will share the work, and a third one is kept ready for days of storm, said the harbour master.]]</p></td></tr><tr><td colspan=2 class=footer>&copy; The Harbour Times &middot; <a href=/i>Imprint</a></td></tr></table></body></html>""",
    "divs of a blog": """<body><div id="wrap"><div id="header"><h1><a href="/">My garden</a></h1><p>words from a small green place</p></div><div id="nav"><ul><li><a href="/a">About</a><li><a href="/c">Contact</a></ul></div>
<div class="post"><h2>[[Beans in May]]</h2><div class="meta">Posted by Ann on 3 May</div><div class="entry"><p>[[This year I put the beans out in the second week of May, when the soil was warm at last.]]</p>
<p>[[They stand along the south wall, where they get <a href="/sun">sun until the evening</a>, and I water them every other day.]]</p><blockquote>[[A bean that is sown too early only feeds the snails, as my grandmother used to say.]]</blockquote></div>
<div class="share"><a href="#">Share</a> <a href="#">Print</a></div></div><div id="comments"><h3>2 comments</h3><div class="comment"><b>Joe</b><p>My beans were eaten by the birds, what do you do against them?</p></div>
<div class="comment"><b>Ann</b><p>I have a net over them until they are a foot high.</p></div></div><div id="sidebar"><h3>Recent posts</h3><ul><li><a href="/p1">Peas</a></li><li><a href="/p2">Kale</a></li></ul></div><div id="footer">Powered by words</div></div></body>""",
    "news with main and aside": """<body><header><a href="/">Daily</a><nav><a href="/1">World</a><a href="/2">Money</a><a href="/3">Culture</a></nav></header><div class="cookie-banner"><p>We use cookies to make this page better for you.</p><button>Accept</button></div>
<main><h1>[[Old bridge opens again after two years of work]]</h1><p class="byline">By Maria Stone, 4 June</p><p>[[The stone bridge over the river was opened on Friday with music and a market on both banks.]]</p><aside class="related"><h4>Read more</h4><ul><li><a href="/x">The river in numbers</a></li></ul></aside>
<p>[[Its arches had been closed since a flood broke two of the pillars in the spring of the year before last.]]</p><p>[[“We used the old stones wherever we could,” said the engineer who led the work.]]</p></main>
<aside><div class="ad">Advertisement: new shoes at half the price</div></aside><footer><p>Daily is a paper of the valley. <a href="/terms">Terms</a> <a href="/privacy">Privacy</a></p></footer></body>""",
    "manual with code": """<body><nav class="toc"><ol><li><a href="#a">Start</a></li><li><a href="#b">Options</a></li></ol></nav><section role="main" class="doc"><h1>[[The count command]]</h1><p>[[The command reads files and prints how many lines each of them has.]]</p>
<pre>[[count notes.txt letters.txt]]</pre><h2>[[Options]]</h2><ul><li>[[-w counts words instead of lines]]</li><li>[[-s prints the sum alone]]</li></ul><p>[[Without a file it reads what is typed until the end mark.]]</p></section><div class="pager"><a href="/p">Previous</a> <a href="/n">Next</a></div></body>""",
    "recipe": """<body><div class="topbar"><a href="/">Kitchen</a> <a href="/login">Sign in</a></div><div class="recipe content"><h1>[[Pea soup]]</h1><p>[[A thick soup for cold evenings that gets better on the second day.]]</p><h3>[[You need]]</h3><ul><li>[[500 g dried peas]]</li><li>[[two onions and a carrot]]</li><li>[[a bay leaf]]</li></ul>
<h3>[[How it is made]]</h3><ol><li>[[Let the peas lie in water over night.]]</li><li>[[Cook all of it slowly for two hours and stir now and then.]]</li></ol></div><form class="newsletter"><label>Get our recipes by mail</label><input name="m"><button>Subscribe</button></form><footer>&copy; Kitchen</footer></body>""",
    "German page, menu last": """<body><article><h1>[[Der Turm über der Stadt]]</h1><p>[[Seit achthundert Jahren steht der Turm auf dem Hügel, und noch heute läuten seine Glocken jeden Abend um sechs.]]</p><p>[[Wer die zweihundert Stufen steigt, sieht bei gutem Wetter bis zu den Bergen.]]</p></article>
<section class="widget"><h4>Beliebt</h4><a href="/1">Das Schloss</a> <a href="/2">Der Markt</a></section><nav><a href="/s">Start</a><a href="/k">Kontakt</a><a href="/i">Impressum</a></nav><footer>Alle Rechte vorbehalten</footer></body>""",
    "wiki": """<body><div id="siteNotice">Please give to keep this page free.</div><div id="content"><h1>[[Heron]]</h1><p>[[The <b>heron</b> is a long-legged bird that lives near fresh water in most parts of the world.]]</p><div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#1">Food</a></li><li><a href="#2">Nest</a></li></ul></div>
<h2>[[Food]]</h2><p>[[It stands still in shallow water and waits for fish, frogs and insects, which it takes with a quick thrust of the bill.]]</p><h2>[[Nest]]</h2><p>[[Nests are built of sticks in high trees, often many in one place, and used again for years.]]</p></div>
<div id="mw-navigation"><ul><li><a href="/main">Main page</a></li><li><a href="/random">Random page</a></li></ul></div><div id="footer"><ul><li>This page was last changed in May.</li><li><a href="/privacy">Privacy</a></li></ul></div></body>""",
    "letter in spans": """<body><div class="nav-wrapper"><span><a href="/">Start</a></span><span><a href="/l">Letters</a></span></div><div class="page"><div class="text"><span>[[Dear friends of the museum, we are glad to tell you that the new hall will open on the first of September.]]</span><br><br>
<span>[[It will show the boats that were found in the bay, and the tools with which they were made.]]</span></div></div><div class="legal-footer"><span>Museum of the bay, harbour street 5</span></div></body>""",
    "story with notices inside": """<body><div role="banner"><a href="/">Stories</a></div><div class="story-body"><p>[[When the lamp went out, nobody in the room said a word for a long time.]]</p><div class="alert">Subscribe now and read all stories for one month at no cost.</div>
<p>[[Then the old man laughed, and somebody lit a match, and we saw that the box on the table was empty.]]</p><div class="advertisement"><p>Buy a lamp that never goes out. Sponsored.</p></div><p>[[It was the last evening of that kind, though none of us knew it then.]]</p></div>
<div class="disqus_thread"><p>Great story, thank you!</p><p>I liked the end best.</p></div></body>""",
}


def words(text):
    return Counter(text.split())


@pytest.fixture(scope="module")
def field():
    return html_text.field()


def test_unlike_layouts(field):
    """Words of main text found, and of those found that are main, over ten pages."""
    found = right = wanted = 0
    for name, page in PAGES.items():
        want = words(" ".join(re.sub(r"<[^>]*>", "", t) for t in re.findall(r"\[\[(.*?)\]\]", page, re.S)))
        got = words(" ".join(html_text.label_pages([page.replace("[[", "").replace("]]", "")], field, html_text.Paths())[0]))
        both = sum((want & got).values())
        print(name, "precision", round(both / max(sum(got.values()), 1), 2), "recall", round(both / sum(want.values()), 2))
        found, right, wanted = found + sum(got.values()), right + both, wanted + sum(want.values())
    print("all: precision", round(right / found, 3), "recall", round(right / wanted, 3))
    assert right >= 0.9 * found and right >= 0.9 * wanted


def test_attribute_names_are_whole():
    cases = {
        "<p data-hidden>a</p>": ["a"], "<p hidden-until=x>a</p>": ["a"], "<p class='x' hidden>a</p>b": ["b"], "<p HIDDEN=''>a</p>b": ["b"], "<p title='hidden'>a": ["a"], "<p style='display: none'>a</p>b": ["b"],
        "<p aria-hidden=false>a": ["a"], "<math><mi>x</mi>+1</math>": ["x+1"], "<object>a</object>b": ["b"], "<noscript>a</noscript>b": ["b"],
    }
    for page, want in cases.items():
        assert [b[0] for b in html_text.blocks_of(page)] == want, page


def test_end_tags():
    cases = {
        "<div><b>x<div>y</b>z</div>": ["x", "yz"], "<table><tr><td>1<td>2<tr><td>3</table>4": ["1", "2", "3", "4"], "<ul><li>a<ul><li>b</ul>c<li>d</ul>": ["a", "b", "c", "d"], "</section>a</b></td>": ["a"],
        "<dl><dt>a<dd>b<dt>c</dl>": ["a", "b", "c"], "<p>a<b>b<p>c": ["ab", "c"], "<select><option>a<option>b</select>c<p>d<option>e": ["c", "de"],
    }
    for page, want in cases.items():
        assert [b[0] for b in html_text.blocks_of(page)] == want, page
    depths = [b[2].depth for b in html_text.blocks_of("<table><tr><td>1<td>2<tr><td>3<tr><td>4</table>")]
    assert len(set(depths)) == 1


@pytest.mark.parametrize("part", ["<div>", "<div>a ", "<b>", "<div></section>", "<ul><div>", "<li></li><div>", "<i></b>", "<option>a", "<iframe>", "<a b='", '<p x="1>', "<!", "&#1", "<td>", "<dd>a<dl>"])
def test_time_grows_with_the_page(part):
    began = time.perf_counter()
    assert isinstance(html_text.blocks_of("<div><ul><b>" + part * 60_000 + "end"), list)
    assert time.perf_counter() - began < 20


def test_very_large_page(spark, field):
    page = "<div>" * 100_000 + "<p>" + "words of a text that is very long. " * 280_000 + "</p>"
    rows = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page[:1000], "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract_main_text(rows, model=field).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got) and len(page) > 10_000_000
    assert html_text.extract_main_text(rows.limit(0), model=field).count() == 0
