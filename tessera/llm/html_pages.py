"""Invented labelled pages that the block labeller learns from, and others that it is measured on.

A page is a random layout of the parts that real pages have. Text of the article starts with
MARK in the page, which the training takes off again; everything else is not the article. Parts
stand before, after and inside the article. Some layouts, class words and telltale phrases only
occur in pages with ``unseen``, which are never learned from.
"""

from __future__ import annotations

import random

MARK = "\ue000"
#: Syllables of the invented words; the article and everything around it draw from the same.
SYLLABLES = "an ba ce do en fi go hu in ja ke lo mu ne or pa qui re sa ti un va wi xo ye zu ß é ñ tion ment keit ción".split()
#: Words that pages have around an article, in any part of it but also, now and then, in the article.
CHROME = "Home About Contact Menu Login Search Subscribe Share Tweet Privacy Terms Cookies Accept Copyright Related Newsletter Sponsored Advertisement Reply Comments Next Previous Archive Tags".split()
#: Elements that hold an article, those of pages to learn from and unseen ones.
ARTICLE = (
    ["<article>", "<main>", '<div class="content">', '<div id="post">', '<div class="entry-content">', '<section class="story">', '<div class="article-body">', "<main><article>", '<div role="main">', '<div class="post-text">', '<article class="entry">', '<div class="main-content"><article>', '<div id="main"><div class="text">'],
    ['<div class="article__content">', '<article id="story-body">', '<section role="main"><article>', '<div class="post-content entry">', "<main><section>"],
)
#: Openings of what is no article, by the part: to learn from, and unseen.
PARTS = {
    "nav": (
        ["<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navbar">', '<div class="breadcrumbs">', '<nav class="pagination">', '<ol class="breadcrumb">', '<div role="navigation">', '<ul class="menu main-menu">', '<div class="toc">'],
        ['<div class="nav-menu">', '<nav id="site-navigation">', '<ul class="pager nav">', '<div class="navigation">'],
    ),
    "header": (
        ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header banner">', '<div role="banner">', '<header class="top-bar">', '<div class="topbar">'],
        ['<div id="site-masthead">', '<header id="page-header">', '<div class="header-banner">'],
    ),
    "aside": (
        ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">', '<div class="related-posts">', '<section class="recommended">', '<div class="read-more">', '<aside class="teaser">', '<div role="complementary">', '<div class="trending">'],
        ['<div class="widget-area">', '<aside id="right-sidebar">', '<div class="related-articles">', '<div class="sidebar-widget">'],
    ),
    "ad": (
        ['<div class="ad">', '<div class="ads banner">', '<div class="advert">', '<div id="sponsor">', '<aside class="promo">', '<div class="ad-slot">', '<div class="advertisement">', '<section class="sponsored">', '<div class="promo-box">', '<div class="adsbox">', '<ins class="ad">'],
        ['<div class="ad-container">', '<div id="top-ad">', '<div class="sponsored-promo">', '<div class="advert-wrap">'],
    ),
    "notice": (
        ['<div class="cookie-notice">', '<div id="consent">', '<div class="notice">', '<div class="popup">', '<div role="alert">', '<div class="gdpr">', '<section class="cookie">', '<div class="banner alert">', '<div role="dialog">', '<div class="overlay modal">', '<div class="privacy-notice">', '<div class="paywall">', '<div id="cookies">'],
        ['<div class="gdpr-bar">', '<div id="cookie-banner">', '<div class="consent-overlay">', '<dialog class="notice">', '<div class="alert-bar">'],
    ),
    "form": (
        ["<form>", '<form class="newsletter">', '<form id="search">', '<div class="signup"><form>', '<section class="subscribe">', '<form role="search">', '<fieldset class="poll">'],
        ['<form class="subscribe-form">', '<div class="newsletter-signup">', '<form id="contact">'],
    ),
    "comments": (
        ['<div class="comments">', '<section id="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<div class="reader-comments">', '<section class="comments">', '<div id="respond">', '<div class="replies">', '<ul class="comment-thread">', '<section class="discussion">', '<div class="responses">', '<div class="feedback">', '<div id="disqus">'],
        ['<div class="comments-area">', '<section id="user-comments">', '<div class="comment-section">', '<ol class="replies comments">', '<div class="discussion-thread">'],
    ),
    "footer": (
        ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="site-footer">', '<div class="copyright">', '<div role="contentinfo">', '<footer class="bottom">', '<div class="imprint">'],
        ['<div id="site-footer">', '<footer class="page-footer">', '<div class="footer-copyright">'],
    ),
    "share": (
        ['<div class="share">', '<div class="social">', '<ul class="tags">', '<div class="share-buttons">', '<p class="tags">', '<div class="byline">', '<div class="meta">', '<div class="author-box">'],
        ['<div class="social-share">', '<ul class="post-tags">', '<div class="sharing social">'],
    ),
}
#: Phrases that give a part away, whatever its element: to learn from, and unseen.
CUES = {
    "ad": (["Advertisement", "Sponsored", "Buy now", "Sponsored by"], ["Advertisement", "Sponsored content"]),
    "notice": (["We use cookies", "Accept all cookies", "This site uses cookies", "Your privacy", "Subscribe to continue"], ["We use cookies to", "Cookies and privacy"]),
    "comments": (["Reply", "says:", "Reply Report", "2 hours ago", "Comments (3)", "Posted by", "Leave a reply", "Log in to comment"], ["Reply Like", "says: Reply", "Comments (12)"]),
    "form": (["Subscribe", "Your email", "Search", "Sign up for our newsletter"], ["Subscribe", "Email newsletter"]),
    "footer": (["&copy; 2020", "All rights reserved", "Privacy Terms Contact", "Imprint"], ["&copy; 2024 All rights reserved", "Terms Privacy"]),
}
#: Openings that say nothing.
NEUTRAL = ["<div>", "<section>", '<div class="{}">', '<div id="{}">', '<section class="{}">']


def closing(tags: str) -> str:
    return "".join(f"</{t.split()[0].strip('<>')}>" for t in reversed(tags.replace("><", ">\n<").split("\n")))


def name(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES[:26]) for _ in range(rng.randint(1, 3)))


def words(rng: random.Random, n: int, chrome: float = 0.0) -> str:
    made = [rng.choice(CHROME) if rng.random() < chrome else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    text = " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in made)
    return text.capitalize() + rng.choice([".", ".", ".", "", " &amp; co."])


def part(rng: random.Random, kind: str, unseen: bool = False) -> str:
    begin = rng.choice(PARTS[kind][unseen])
    cue = rng.choice(CUES[kind][unseen]) if kind in CUES and rng.random() < 0.5 else ""
    if cue and not unseen and rng.random() < 0.25:
        begin = rng.choice(NEUTRAL).format(name(rng))
    n, chrome = rng.randint(1, 6), rng.choice([0.0, 0.0, 0.3, 0.7])
    if kind in ("nav", "share") or (kind in ("aside", "footer") and rng.random() < 0.4):
        items = "".join(f'<li><a href="/{i}">{words(rng, rng.randint(1, 3), chrome)}</a></li>' for i in range(n))
        inner = items if begin.startswith(("<ul", "<ol")) else f"<ul>{items}</ul>"
        if rng.random() < 0.2:
            inner = " ".join(f'<a href="/{i}">{words(rng, rng.randint(1, 2), chrome)}</a>' + rng.choice(["", " |", " &middot;"]) for i in range(n))
    elif kind == "form":
        inner = f"<label>{cue or words(rng, 2, chrome)}</label><input name=q><button>{words(rng, 1, 0.8)}</button><p>{words(rng, 6, chrome)}</p>"
        if rng.random() < 0.4:
            inner = f"<h3>{cue or words(rng, 3, 0.5)}</h3>" + inner
    elif kind == "comments":
        inner = f"<h3>{cue or words(rng, 2, 0.5)}</h3>" if cue or rng.random() < 0.5 else ""
        frame = rng.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', "<p><b>{}</b> {}</p>", "<div><span>{}</span><p>{}</p></div>", '<li><div class="{0}">{0}</div><p>{1}</p></li>', "<p>{}: {}</p>", "<article><h4>{}</h4><p>{}</p></article>", "<p>{1}</p>", "<blockquote>{1}</blockquote>"])
        for _ in range(n):
            text = words(rng, rng.randint(3, 40))
            inner += frame.format(name(rng).capitalize() + rng.choice(["", "", " " + (cue or "says:")]), text)
            inner += f'<a href="#">{rng.choice(["Reply", "Like", "Report"])}</a>' if rng.random() < 0.2 else ""
    elif kind == "footer" and rng.random() < 0.5:
        inner = f"{cue or '&copy;'} {words(rng, 1)} &middot; {words(rng, rng.randint(2, 15), chrome)}"
    else:
        inner = "".join(rng.choice(["<p>{}</p>", "{}", "<h3>{}</h3>", "<div>{}</div>", "<span>{}</span>"]).format((cue + " " if cue and not i else "") + words(rng, rng.randint(1, 25), chrome)) for i in range(rng.randint(1, 3)))
        inner += f"<button>{words(rng, 1, 0.8)}</button>" if kind == "notice" and rng.random() < 0.4 else ""
    return begin + inner + closing(begin)


#: What the paragraphs of an article stand in; None: bare text that line breaks part.
PARAGRAPHS = ["<p>{}</p>"] * 10 + ["<div>{}</div>"] * 3 + [None] * 3 + ["<div><span>{}</span></div>", "<div><span>{}</span></div>", "<div><div>{}</div></div>", "<section>{}</section>", "<dd>{}</dd>", "<li>{}</li>", "<blockquote>{}</blockquote>", "<center>{}</center><br>"]


def article(rng: random.Random, unseen: bool = False) -> str:
    paragraph = rng.choice(PARAGRAPHS)
    text = lambda n: MARK + words(rng, n, rng.choice([0.0, 0.0, 0.0, 0.1]))
    out = [f"<h1>{text(rng.randint(2, 10))}</h1>"] if rng.random() < 0.8 else []
    # Unseen pages have the blocks of an article one level deeper.
    wrap = "<section>{}</section>" if unseen else rng.choice(["{}", "{}", "{}", "<div>{}</div>", '<div class="' + name(rng) + '">{}</div>'])
    inside = rng.random() < 0.5
    for _ in range(rng.choice([1, 2, 4, 8, 14])):
        n = rng.choice([1, 2, 5, 12, 30, 80])
        shape = rng.random()
        if shape < 0.55 and paragraph is None:
            out.append(f"{text(n)}<br>" + rng.choice(["", "<br>", "<br/>\n"]))
            continue
        if shape < 0.55:
            block = paragraph.format(text(n))
        elif shape < 0.68:
            block = f"<p><b>{text(n)}<br>"
        elif shape < 0.75:
            block = f"<h2>{text(min(n, 8))}</h2>"
        elif shape < 0.78:
            block = "<ul>" + "".join(f"<li>{text(min(n, 12))}</li>" for _ in range(3)) + "</ul>"
        elif shape < 0.82:
            block = rng.choice(["<ul>{}</ul>", "<ol>{}</ol>", "<div>{}</div>"]).format("".join(f'<li><a href="/{i}">{text(rng.randint(1, 15))}</a></li>' for i in range(rng.randint(2, 8))))
        elif shape < 0.84:
            block = "<dl>" + "".join(f"<dt>{text(rng.randint(1, 3))}</dt><dd>{text(rng.randint(2, 15))}</dd>" for _ in range(rng.randint(2, 7))) + "</dl>"
        elif shape < 0.86:
            block = f"<blockquote><p>{text(n)}</p></blockquote>"
        elif shape < 0.9:
            block = f'<p>{text(n)} <a href="/x">{words(rng, 2)}</a> {words(rng, 3)}</p>'
        elif shape < 0.93:
            block = "<table>" + "".join(f"<tr><td>{text(rng.randint(1, 9))}</td><td>{text(rng.randint(1, 9))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        elif shape < 0.95:
            block = f"<figure><figcaption>{text(min(n, 12))}</figcaption></figure>"
        else:
            block = f"<pre>{text(n)}</pre>"
        # Of a paragraph that is left open the wrapper's end would be part.
        out.append(block if block.endswith("<br>") else wrap.format(block))
        if inside and rng.random() < 0.2:
            out.append(part(rng, rng.choice(["ad", "share", "aside", "form", "notice"]), unseen))
    if inside and rng.random() < 0.6:
        out += [part(rng, kind, unseen) for kind in rng.sample(["comments", "comments", "comments", "share", "aside", "notice", "footer"], rng.randint(1, 2))]
    begin = rng.choice(ARTICLE[unseen])
    if not unseen and rng.random() < 0.06:
        begin = rng.choice(["<div>", f'<div class="{name(rng)}">', "<table><tr><td>"])  # nothing says that it is one
    return begin + "".join(out) + closing(begin)


def page(rng: random.Random, unseen: bool = False) -> str:
    """An HTML page; text of the article is marked."""
    if not unseen and rng.random() < 0.03:  # text with hardly a tag
        body = rng.choice(["<br>", "<br><br>", "<p>"]).join(MARK + words(rng, rng.choice([1, 5, 20, 80])) for _ in range(rng.choice([1, 1, 2, 5])))
        return rng.choice(["{}", "<body>{}</body>", "<html><body>{}"]).format(body)
    some = lambda *kinds: "".join(part(rng, k, unseen) for k in kinds if rng.random() < 0.45)
    before = some("notice", "header", "nav", "nav", "ad", "form", "aside")
    after = some("share", "comments", "aside", "ad", "form", "notice", "nav", "footer")
    if rng.random() < 0.3:
        before, after = part(rng, "nav", unseen) + part(rng, "ad", unseen), part(rng, "footer", unseen)
    body = before + article(rng, unseen) + after
    if unseen:
        # A column of its own, between others.
        body = f'<div class="grid"><div class="column">{some("nav", "aside", "ad")}</div><div class="column">{body}</div><div class="column">{some("aside", "notice", "share")}</div></div>'
    elif rng.random() < 0.3:
        begin = rng.choice(["<div>", '<div class="wrap">', '<div id="page">', "<div class='container'>"])
        body = begin + body + "</div>"
    return f"<!DOCTYPE html><html><head><title>{words(rng, 4)}</title></head><body>{body}" + rng.choice(["</body></html>", ""])
