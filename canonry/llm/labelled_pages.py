"""Labelled pages for the extraction of main text: hand-written layouts, filled with invented words.

In a layout, {{...}} is a block of main text, $T a title, $P a paragraph, $S a short sentence, $W one to three words,
$L a list of links. The words are drawn from a seed, so that no word can be learned; only what stands around it can.
"""

from __future__ import annotations

import random
import re

LAYOUTS = [
    # a news site with an article element
    """<header class="site-header"><a href="/">$W</a><p>$S</p></header><nav class="main-nav"><ul>$L</ul></nav><div class="breadcrumb"><a href="/">$W</a> / <a href="/x">$W</a></div>
    <article><h1>{{$T}}</h1><p>{{$P}}</p><div class="ad"><p>$S</p></div><p>{{$P}}</p><h2>{{$T}}</h2><p>{{$P <a href="/l">$W</a> $S}}</p><div class="share-bar"><ul>$L</ul></div></article>
    <aside class="sidebar"><h3>$W</h3><ul>$L</ul><p>$S</p></aside><section class="comments"><h3>$W</h3><div class="comment"><p>$P</p></div><div class="comment"><p>$S</p></div></section><footer class="site-footer"><p>$S</p><ul>$L</ul></footer>""",
    # a blog without article or main
    """<div id="header"><h1>$W</h1><p class="tagline">$S</p></div><div id="menu"><ul>$L</ul></div><div id="content"><div class="post"><h2>{{$T}}</h2><p>{{$P}}</p><p>{{$P}}</p><ul><li>{{$S}}</li><li>{{$S}}</li></ul><p>{{$P}}</p></div>
    <div id="comments"><ol class="commentlist"><li>$P</li><li>$S</li></ol><form id="respond"><label>$W</label><textarea>$S</textarea></form></div></div><div id="sidebar"><h4>$W</h4><ul>$L</ul><div class="widget"><p>$P</p></div></div><div id="footer"><p>$S</p></div>""",
    # an old page of tables and plain blocks, with a bare menu
    """<ul>$L</ul><table><tr><td><a href="/a">$W</a></td><td><a href="/b">$W</a></td></tr></table><h1>{{$T}}</h1><p>{{$P}}</p><p>{{$P}}</p><blockquote>{{$P}}</blockquote><p>{{$P}}</p><hr><ul>$L</ul><p><a href="/t">$W</a> | <a href="/u">$W</a> | <a href="/v">$W</a></p>""",
    # a header before a plain content part, a cookie banner after it
    """<header>$S</header><div class="container"><div class="entry-content"><h1>{{$T}}</h1><p>{{$P}}</p><p>{{$P}}</p><div class="newsletter-signup"><p>$S</p><form><input><button>$W</button></form></div><p>{{$P}}</p></div></div><div class="cookie-banner"><p>$P</p><a href="/c">$W</a></div><footer>$S</footer>""",
    # documentation: main with a menu inside
    """<div class="topbar"><a href="/">$W</a></div><main><nav class="toc"><ul>$L</ul></nav><h1>{{$T}}</h1><p>{{$P}}</p><pre>{{$S}}</pre><p>{{$S}}</p><dl><dt>{{$W}}</dt><dd>{{$S}}</dd></dl><table><tr><th>{{$W}}</th><td>{{$S}}</td></tr></table><div class="pagination"><a href="/p">$W</a><a href="/n">$W</a></div></main><footer>$S</footer>""",
    # a shop's magazine: banners, promotions, related
    """<div class="promo-banner"><p>$S</p></div><div class="nav"><ul>$L</ul></div><div class="main-content"><div class="article-body"><h1>{{$T}}</h1><p>{{$P}}</p><div class="advertisement"><p>$S</p></div><p>{{$P}}</p><p>{{$P}}</p></div><div class="related"><h3>$W</h3><ul>$L</ul></div><div class="sponsored"><p>$S</p></div></div><div class="footer"><p>$S</p><p>$S</p></div>""",
    # an article with its own header, footer and an aside
    """<nav><ul>$L</ul></nav><div class="notice"><p>$S</p></div><main><article><header><h1>{{$T}}</h1></header><p>{{$P}}</p><aside><p>$S</p></aside><figure><img><figcaption>{{$S}}</figcaption></figure><p>{{$P}}</p><ol><li>{{$S}}</li><li>{{$S}}</li></ol><footer><p>$S</p></footer></article></main><div class="popup"><p>$S</p></div>""",
    # a forum entry with many replies
    """<div class="navbar"><ul>$L</ul></div><div class="login"><form><label>$W</label><input></form></div><div class="story"><h1>{{$T}}</h1><p>{{$P}}</p><p>{{$P}}</p></div><div class="replies"><div class="reply"><p>$P</p></div><div class="reply"><p>$P</p></div><div class="reply"><p>$P</p></div></div><div class="copyright">$S</div>""",
    # text without paragraphs, between breaks
    """<table><tr><td><a href="/1">$W</a></td><td><a href="/2">$W</a></td><td><a href="/3">$W</a></td></tr></table><div><b>{{$T}}</b></div><div>{{$P}}</div><div>{{$P}}</div><div>{{$P}}</div><div><a href="/x">$W</a> <a href="/y">$W</a></div><ul>$L</ul>""",
    # a portal with roles
    """<div role="banner"><p>$S</p></div><div role="navigation"><ul>$L</ul></div><div role="main"><h1>{{$T}}</h1><p>{{$P}}</p><p>{{$P}}</p><div role="alert"><p>$S</p></div><p>{{$P}}</p></div><div role="complementary"><h3>$W</h3><p>$S</p></div><div role="contentinfo"><p>$S</p></div><dialog><p>$S</p></dialog>""",
    # an article, subscriptions and trending lists within
    """<div class="masthead">$W</div><article><h1>{{$T}}</h1><p>{{$P}}</p><section class="subscribe"><h3>$W</h3><p>$S</p></section><p>{{$P}}</p><div class="trending"><ul>$L</ul></div><h2>{{$T}}</h2><p>{{$P}}</p><p>{{$S}}</p><div class="consent"><p>$S</p></div><menu>$L</menu></article><div class="legal">$P</div>""",
    # a plain page: main text alone
    """<h1>{{$T}}</h1><p>{{$P}}</p><p>{{$S}}</p><h2>{{$T}}</h2><p>{{$P}}</p><ul><li>{{$S}}</li><li>{{$S}}</li></ul><p>{{$P}}</p>""",
    # a site that names its parts, without an article
    """<div class="topbar">$W</div><div class="masthead"><h1>$W</h1></div><div class="breadcrumb"><a href="/">$W</a></div><div class="notice"><p>$S</p></div><div class="post-body"><h1>{{$T}}</h1><p>{{$P}}</p><div class="login"><p>$S</p></div><p>{{$P}}</p><div class="ad">$S</div><p>{{$P}}</p></div><div class="comment"><p>$P</p></div><div class="widget"><p>$S</p></div><div class="legal"><p>$P</p></div><div class="cookie-consent"><p>$S</p></div><div class="popup"><p>$S</p></div>""",
    # a press page: notices at the top, comments beside the text
    """<div class="cookie-notice"><p>$S</p></div><div class="skip"><a href="/m">$W</a></div><div class="text"><h2>{{$T}}</h2><p>{{$P}}</p><div class="promo"><p>$S</p></div><p>{{$P}}</p></div><div id="disqus"><p>$P</p><p>$P</p></div><div class="modal overlay"><p>$S</p></div><div class="copyright legal"><p>$S</p></div><div class="pager"><a href="/2">$W</a></div>""",
    # a site of a common publishing system
    """<div class="site page"><header class="site-header"><p class="site-title">$W</p><nav class="site-navigation"><ul>$L</ul></nav></header><div class="site-content"><div class="content-area"><main class="site-main"><article class="post entry"><header class="entry-header"><h1>{{$T}}</h1></header><div class="entry-content top"><p>{{$P}}</p><p>{{$P}}</p><ul><li>{{$S}}</li></ul></div><footer class="entry-footer"><p>$S</p></footer></article><div class="comments-area"><p>$P</p></div></main></div><aside class="widget-area"><p>$S</p></aside></div><footer class="site-footer"><p>$S</p></footer></div>""",
    # a magazine: branding, links, a discussion, a second column
    """<header id="branding"><p>$W</p></header><div class="nav-links"><ul>$L</ul></div><div id="primary"><div class="blog-entry"><h1>{{$T}}</h1><p>{{$P}}</p><div class="ads-slot"><p>$S</p></div><p>{{$P}}</p></div><div class="discussion"><h3>$W</h3><p>$P</p><p>$P</p></div></div><div id="secondary"><ul>$L</ul><p>$S</p></div><div class="site-info"><p>$S</p></div>""",
    # sections, consent before and recommendations after them
    """<div class="gdpr"><p>$S</p></div><section><h1>{{$T}}</h1><p>{{$P}}</p><aside><p>$P</p></aside><p>{{$P}}</p></section><section class="recommended recommendations"><h2>$W</h2><p>$S</p><ul>$L</ul></section><div class="disclaimer"><p>$S</p></div><footer><p>$S</p></footer>""",
    # a wrapped article, tags and feeds around it
    """<div id="wrapper"><div id="masthead"><p>$S</p></div><div id="navigation"><ul>$L</ul></div><article><p>{{$P}}</p><h3>{{$T}}</h3><ol><li>{{$S}}</li></ol><p>{{$P}}</p><div class="tags"><a href="/a">$W</a><a href="/b">$W</a></div><div class="outbrain feed"><p>$S</p></div></article></div>""",
    # parts named in many ways around one text
    """<div class="announcement"><p>$S</p></div><div class="toolbar"><ul>$L</ul></div><div class="breadcrumbs"><a href="/">$W</a></div><div class="document"><h1>{{$T}}</h1><p>{{$P}}</p><div class="adsense adv"><p>$S</p></div><p>{{$P}}</p><div class="sharing"><p>$S</p></div><p>{{$P}}</p></div><div class="respond reply-form"><p>$S</p></div><div class="popular"><p>$S</p></div><div class="subscription"><p>$S</p></div><div class="credits"><p>$S</p></div>""",
    """<div class="hero"><h1>{{$T}}</h1></div><div class="sponsor"><p>$S</p></div><div class="prose"><p>{{$P}}</p><p>{{$P}}</p><div class="advert"><p>$S</p></div><p>{{$P}}</p></div><div class="responses"><p>$P</p><p>$P</p></div><div class="comment-list"><p>$P</p></div><div class="register"><p>$S</p></div><div class="cookies"><p>$S</p></div><div class="foot"><p>$S</p></div>""",
    """<div class="announce warning"><p>$S</p></div><div id="top-menu"><ul>$L</ul></div><div id="article-text"><h1>{{$T}}</h1><p>{{$P}}</p><p>{{$P}}</p><p>{{$P}}</p></div><div class="follow"><p>$S</p></div><div class="promotion"><p>$S</p></div><div class="guestbook"><p>$P</p></div><div class="terms privacy"><p>$P</p></div><div class="search"><p>$S</p></div><div class="taboola"><p>$S</p></div>""",
    # held out: a blog with an article and much beside it
    """<header class="top-header"><h2>$W</h2></header><nav><ul>$L</ul></nav><article class="post"><h1>{{$T}}</h1><p>{{$P}}</p><div class="social-share"><ul>$L</ul></div><p>{{$P}}</p><ul><li>{{$S}}</li></ul></article><aside class="widget-area"><p>$P</p></aside><div class="comments-area"><p>$P</p><p>$P</p></div><footer><ul>$L</ul></footer>""",
    # held out: neutral parts, a bare menu and a long bar of links inside
    """<div><ul>$L$L</ul></div><div class="page"><h1>{{$T}}</h1><p>{{$P}}</p><div class="share"><ul>$L$L$L</ul></div><p>{{$P}}</p><p>{{$P}}</p></div><footer><p>$S</p></footer>""",
    # held out: an advert and a notice around main
    """<div class="alert-notice"><p>$S</p></div><div class="ad"><p>$S</p></div><main><h1>{{$T}}</h1><p>{{$P}}</p><blockquote>{{$S}}</blockquote><p>{{$P}}</p><form><label>$W</label></form></main><div id="sidebar"><ul>$L</ul></div>""",
    # held out: tables and cells
    """<ul>$L</ul><table><tr><td><h1>{{$T}}</h1><p>{{$P}}</p><p>{{$P}}</p><p>{{$P}}</p></td></tr></table><p><a href="/a">$W</a> <a href="/b">$W</a></p><div id="footer">$S</div>""",
]
#: The last layouts are held out when quality is measured (`tests/llm/test_op9_whole.py`).
HELD_OUT = 4


def _fill(layout: str, draw: random.Random) -> tuple[str, list[str]]:
    word = lambda: "".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))
    short = lambda: words(5, 14).capitalize() + draw.choice(".....!?")
    slots = {
        "$T": lambda: words(3, 8).capitalize(),
        "$P": lambda: " ".join(words(6, 16).capitalize() + "." for _ in range(draw.randint(2, 6))),
        "$S": short,
        "$W": lambda: words(1, 3).capitalize(),
        "$L": lambda: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(draw.randint(4, 8))),
    }
    page = re.sub(r"\$[TPSWL]", lambda m: slots[m[0]](), layout)
    main = [" ".join(re.sub(r"<[^>]*>", "", m).split()) for m in re.findall(r"\{\{(.*?)\}\}", page, re.S)]
    return "<html><head><title>x</title></head><body>" + page.replace("{{", "").replace("}}", "") + "</body></html>", main


def labelled_pages(layouts: list[str] | None = None, each: int = 6, seed: int = 9) -> list[tuple[str, list[str]]]:
    """`each` pages of every layout, with the blocks that are their main text."""
    draw = random.Random(seed)
    return [_fill(x, draw) for x in (LAYOUTS if layouts is None else layouts) for _ in range(each)]
