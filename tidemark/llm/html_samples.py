"""The small labelled table of operator 8: made-up pages as (1 content or 0 other, fragment)."""

from __future__ import annotations

LONG = "Early that morning the ferry left the harbour with twelve passengers, two crates of apples and a dog that nobody claimed, and by noon the wind had turned so far to the north that the captain, who had seen worse, quietly changed course."
MID = "The council met for three hours before anybody mentioned the bridge."
SHORT = "Nobody answered."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'

SAMPLES = [
    [
        (0, f"<html><body><nav>{MENU}</nav>"), (0, f'<div class="ad">{MID}</div>'), (1, "<article><h1>A ferry in the wind</h1>"), (1, f"<p>{LONG}</p>"), (1, f"<p>{SHORT}</p>"),
        (1, f"<p>{MID}</p>"), (1, "<p>No.</p></article>"), (0, f"<footer>&copy; site {MID}</footer></body></html>"),
    ],
    [
        (0, f'<html><body><header><p>{MID}</p></header>'), (0, f'<div class="cookie-notice">{LONG}</div>'), (1, "<main><h1>The bridge</h1>"), (1, f"<p>{MID}</p>"),
        (0, f'<aside><p>{LONG}</p></aside>'), (1, f'<p>See <a href="/x">{MID}</a></p>'), (1, "<ul><li>one item</li><li>two</li></ul>"), (0, f'<div class="comments"><p>{LONG}</p><p>{SHORT}</p></div></main>'),
        (0, f'<form><p>{MID}</p></form>'), (0, '<p><a href="/1">More</a> <a href="/2">Next story</a></p></body></html>'),
    ],
    [
        (0, '<html><body><div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/s">Sport</a></div>'), (1, f"<h1>{SHORT}</h1>"), (1, f"<p>{LONG}</p>"), (1, f"<p>{LONG} {MID}</p>"), (1, f"<p>{MID}</p>"), (1, f"<p>{LONG}</p>"),
        (0, '<div><a href="/t">Terms</a> <a href="/p">Privacy</a></div>'), (0, "<div>Printed in Oslo</div></body></html>"),
    ],
    [
        (0, f"<html><body><div id='menu'>{MENU}</div>"), (1, f"<div><h2>{MID}</h2>"), (1, f"<p>{LONG}</p>"), (1, f'<p>{LONG} <a href="/y">a note</a></p>'), (1, f"<p>{LONG}</p></div>"),
        (0, f'<div id="sidebar"><p>{LONG}</p></div>'), (0, f'<div class="footer">{MID}</div></body></html>'),
    ],
    [
        (0, "<html><body><div>Login</div>"), (0, '<div><a href="/a">Top stories</a></div>'), (1, "<article><p>Yes.</p>"), (1, f"<p>{SHORT}</p>"), (1, f'<p><a href="/z">{MID}</a></p>'), (1, f"<p>{LONG}</p></article>"),
        (0, f"<div>{LONG}</div>"), (0, f"<p>{MID}</p>"), (0, "<div>All rights reserved</div></body></html>"),
    ],
    [
        (0, f'<html><body><nav>{MENU}</nav>'), (1, f"<article><h1>{MID}</h1>"), (0, f'<div class="share"><a href="/f">Share</a></div>'), (1, f"<p>{MID}</p>"), (0, f'<div class="advertisement">{SHORT}</div>'), (1, f"<blockquote>{MID}</blockquote>"),
        (1, "<h2>Then</h2>"), (1, "<table><tr><td>1</td><td>2</td></tr></table></article>"), (0, f"<section class='comments'><p>{MID}</p></section>"), (0, f"<aside>{MID}</aside></body></html>"),
    ],
    [
        (0, "<html><body><div>Today in pictures</div>"), (0, f"<div>{MID}</div>"), (1, f"<article><p>{LONG}</p>"), (1, f"<p>{SHORT}</p>"), (1, f"<p>{LONG}</p></article>"), (0, f"<div>{LONG}</div>"), (0, f"<div>{LONG}</div></body></html>"),
    ],
    [
        (0, "<html><body><div>Login</div>"), (0, '<div><a href="/">Home</a></div>'), (0, '<div><a href="/n">All the news of the week in one place</a></div>'), (1, f"<h1>{MID}</h1>"), (1, f"<p>{LONG}</p>"), (1, f"<p>{SHORT}</p>"), (1, f"<p>{LONG}</p>"),
        (1, f"<p>{MID}</p>"), (1, f"<p>{LONG}</p>"), (0, f'<div><a href="/m">{MID}</a></div>'), (0, f'<div><a href="/o">{LONG}</a></div></body></html>'),
    ],
    # lists of links inside an article, and lone links between its paragraphs
    [
        (1, f"<html><body><article><h1>{SHORT}</h1>"), (1, f"<p>{LONG}</p>"), (0, '<ul><li><a href="/1">Ferry timetable</a></li><li><a href="/2">Bridge opens again</a></li><li><a href="/3">Harbour rules</a></li></ul>'), (1, f"<p>{LONG}</p>"), (1, f'<p><a href="/x">{MID}</a></p>'),
        (1, f"<p>{MID}</p>"), (1, "<ul><li>bread</li><li>two apples</li><li>salt</li></ul>"), (0, '<div><a href="/s">Share</a> <a href="/m">Mail</a> <a href="/p">Print</a></div>'), (0, f'<div><a href="/n">{MID}</a></div>'), (0, f'<div><a href="/o">{SHORT}</a></div></article></body></html>'),
    ],
    [
        (1, f'<html><body><main><div class="post-body"><p>{MID}</p>'), (1, f'<p>{LONG} <a href="/r">reference</a></p>'), (0, f'<div class="top-ad">{MID}</div>'), (1, f"<p>{SHORT}</p></div>"), (0, '<div><a href="/t1">Older story of the week</a></div>'), (0, '<div><a href="/t2">Newer story</a></div></main>'),
        (0, f'<div class="page-footer"><p>{LONG}</p></div></body></html>'),
    ],
    # plain divisions: only words and links tell
    [
        (0, '<html><body><div><a href="/">Start</a></div>'), (0, '<div><a href="/b">Boats</a> <a href="/c">Cars</a></div>'), (1, f'<div class="content"><p>{LONG}</p>'), (1, "<p>It snowed.</p></div>"), (0, '<div><a href="/i">Imprint</a></div></body></html>'),
    ],
    [
        (1, f"<html><body><div><p>{MID}</p>"), (1, f"<p>{LONG}</p>"), (1, f"<p>{SHORT}</p></div></body></html>"),
    ],
    [
        (0, '<html><body><ul><li><a href="/">Start</a></li><li><a href="/2">Two</a></li></ul>'), (1, f"<div>{LONG}</div>"), (1, f"<div>{LONG} {MID}</div>"), (0, '<div><a href="/1">Previous</a></div>'), (0, '<div><a href="/3">Next</a></div>'), (0, "<div>Page 2</div></body></html>"),
    ],
    [
        (0, f'<html><body><div class="site-header">{MID}</div>'), (1, f"<div><p>{LONG}</p>"), (1, f"<p>{SHORT}</p>"), (1, f"<h3>{SHORT}</h3>"), (1, f"<p>{LONG}</p></div>"), (0, f'<div id="comments"><p>{LONG}</p><p>{MID}</p></div>'), (0, f'<div class="cookie-banner"><p>{MID}</p></div></body></html>'),
    ],
    # short articles, and short pages without one
    [(1, "<html><body><article><p>Yes.</p></article></body></html>")],
    [(1, f"<html><body><main><h2>{SHORT}</h2>"), (1, "<p>No.</p>"), (1, "<pre>x = 1</pre></main></body></html>")],
    [(1, f"<html><body><article><p>{SHORT}</p>"), (0, f"<form><p>{SHORT}</p></form>"), (1, f"<div>{SHORT}</div>"), (0, f'<div class="advert">{SHORT}</div></article>'), (0, f"<div>{MID}</div></body></html>")],
    [(0, '<html><body><div><a href="/">Start</a></div>'), (1, f"<p>{MID}</p>"), (1, f"<p>{SHORT}</p>"), (1, f"<p>{MID}</p></body></html>")],
    [(1, f"<html><body><h1>{MID}</h1>"), (1, f"<p>{MID}</p>"), (1, f"<p>{MID}</p>"), (0, "<div>Contact us</div></body></html>")],
    [(1, f"<html><body><p>{LONG}</p>"), (1, f"<p>{SHORT}</p>"), (0, "<div>Printed by hand</div></body></html>")],
    # a line between links belongs to them, one between texts does not
    [(0, '<html><body><div><a href="/1">One</a></div>'), (0, "<p>or</p>"), (0, '<div><a href="/2">Two</a></div>'), (0, f"<p>{SHORT}</p>"), (0, '<div><a href="/3">Three</a></div>'), (1, f"<p>{LONG}</p>"), (1, f"<p>{SHORT}</p>"), (1, f"<p>{LONG}</p></body></html>")],
    [(1, f"<html><body><article><p>{LONG}</p>"), (0, '<div><a href="/1">One</a></div>'), (0, "<div>or</div>"), (0, '<div><a href="/2">Two</a></div>'), (1, f"<p>{MID}</p></article></body></html>")],
]
