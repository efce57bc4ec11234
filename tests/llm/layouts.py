"""Page layouts written by hand, apart from the generator that the extractor is fitted on: (html, main text)."""

import random
from collections import Counter

_PROSE = """Morning came late over the harbour and nobody had lit the lamps. She counted the boats twice before walking back up
the hill. According to the council, repairs will take until spring at least. Nothing in the report explains why the bridge
closed. We tested four kettles for a month; two of them leaked. El mercado abre a las ocho y cierra al mediodía. Die Brücke
wurde im Herbst gesperrt. The committee voted nine to three against the plan. A good loaf needs time, salt and patience. Rain
fell on the second day, so the match was moved indoors. Le musée rouvre ses portes en mars. Readers wrote in to say the map was
wrong. Turn the screw a quarter turn and check the gauge again. Her third novel is set in a town much like this one. Prices
rose by two per cent in June, the office said on Tuesday. Most of the seeds will sprout within ten days.""".replace("\n", " ").split(". ")


def _p(rng, n=None):
    return ". ".join(rng.choices(_PROSE, k=n or rng.randint(1, 6))) + "."


def _short(rng):
    return " ".join(rng.choice(_PROSE).split()[:4])


def blog(rng):
    title, ps = _short(rng), [_p(rng) for _ in range(rng.randint(2, 7))]
    body = "".join(f"<p>{p}</p>\n" for p in ps)
    return f"""<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{title} - My Blog</title><script>var a = "<p>no</p>";</script></head>
<body class="post-template single"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My Blog</a></p><p class="site-description">{_short(rng)}</p>
<nav id="site-navigation" class="main-navigation"><ul class="menu"><li><a href="/about">About</a></li><li><a href="/c">Contact us</a></li></ul></nav></header>
<div id="content"><main id="main"><article id="post-12" class="post type-post"><h1 class="entry-title">{title}</h1><div class="entry-content">{body}</div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">Three thoughts</h2><ol class="comment-list"><li class="comment"><p>{_p(rng, 1)}</p></li><li class="comment"><p>{_p(rng, 2)}</p></li></ol></div></main>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2>Recent Posts</h2><ul><li><a href="/1">{_short(rng)}</a></li><li><a href="/2">{_short(rng)}</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by something &copy; 2023</div></footer></div></body></html>""", [title, *ps]


def wiki(rng):
    title, parts = _short(rng), [_p(rng, rng.randint(2, 6)) for _ in range(rng.randint(3, 6))]
    heads = [_short(rng) for _ in parts[1:]]
    body = f"<p><b>{parts[0][:12]}</b>{parts[0][12:]}</p>" + "".join(f"<h2>{h}</h2><p>{p}</p>" for h, p in zip(heads, parts[1:]))
    main = [title, parts[0], *(x for pair in zip(heads, parts[1:]) for x in pair)]
    return f"""<html><head><title>{title}</title><link rel=stylesheet href=x.css><body><div id="mw-navigation" class="sidebar-nav"><ul><li><a href=/m>Main page</a><li><a href=/r>Random page</a><li><a href=/h>Help</a></ul></div>
<div id="content" class="body-content"><h1 id="firstHeading">{title}</h1><div class="article-text">{body}</div></div>
<div id="footer" class="footer-links"><ul><li>This page was last edited in May.<li><a href=/p>Privacy policy</a><li><a href=/d>Disclaimers</a></ul></div></body></html>""", main


def news(rng):
    title, ps = _short(rng), [_p(rng, rng.randint(1, 3)) for _ in range(rng.randint(4, 10))]
    cut = len(ps) // 2
    ad = '<div class="ad-slot ad-slot--inline" data-id="7"><p>Advertisement</p><a href="//x">Find the best offers here</a></div>'
    return f"""<!DOCTYPE html><html><head><title>{title}</title></head><body><div class="cookie-banner" role="dialog"><p>We value your privacy. Accept all cookies?</p><button>Accept</button></div>
<header class="top-bar"><a class="logo" href="/">The Daily</a><nav class="primary-nav"><a href="/w">World</a> <a href="/b">Business</a> <a href="/s">Sport</a></nav><form action="/search" class="search-form"><input name="q"><button>Search</button></form></header>
<main><article class="story"><header class="story-header"><h1>{title}</h1></header><div class="story-body">{''.join(f'<p>{p}</p>' for p in ps[:cut])}{ad}{''.join(f'<p>{p}</p>' for p in ps[cut:])}</div></article></main>
<section class="related-stories"><h3>More on this</h3><ul><li><a href="/a">{_short(rng)}</a></li><li><a href="/b">{_short(rng)}</a></li><li><a href="/c">{_short(rng)}</a></li></ul></section>
<section class="newsletter-signup"><h3>Get our newsletter</h3><form><label>Your email</label><input type=email><button>Sign up</button></form></section>
<footer class="page-footer"><p>&copy; The Daily. All rights reserved.</p><ul><li><a href="/t">Terms</a></li><li><a href="/x">Cookies</a></li></ul></footer></body></html>""", [title, *ps]


def tables(rng):
    title, ps = _short(rng), [_p(rng) for _ in range(rng.randint(2, 5))]
    return f"""<HTML><HEAD><TITLE>{title}</TITLE></HEAD><BODY BGCOLOR=white><TABLE WIDTH=760><TR><TD COLSPAN=2 CLASS=banner><A HREF=/><IMG SRC=l.gif ALT=logo></A><TR>
<TD WIDTH=140 CLASS=leftmenu><A HREF=1>Home</A><BR><A HREF=2>Links</A><BR><A HREF=3>Guestbook</A><TD CLASS=content><H1>{title}</H1>{''.join(f'<P>{p}' for p in ps)}
<TR><TD COLSPAN=2 CLASS=copyright ALIGN=center>Copyright 1999 <A HREF=m>Webmaster</A></TABLE></BODY></HTML>""", [title, *ps]


def manual(rng):
    title, ps = _short(rng), [_p(rng, 2) for _ in range(rng.randint(2, 6))]
    items = [_short(rng) for _ in range(3)]
    return f"""<!DOCTYPE html><html><head><title>{title}</title></head><body><div class="wy-nav"><div class="wy-side-nav toc"><ul><li><a href="i">Install</a></li><li><a href="u">Usage</a><ul><li><a href="o">Options</a></li></ul></li></ul></div>
<div class="wy-nav-content"><div role="navigation" class="breadcrumbs"><ul><li><a href="/">Docs</a> &raquo;</li><li>{title}</li></ul></div><div role="main" class="document"><section id="s"><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in ps)}<ul>{''.join(f'<li><p>{i}</p></li>' for i in items)}</ul></section></div>
<footer><div role="navigation" class="rst-footer-buttons"><a href="n">Next</a> <a href="p">Previous</a></div><p>Built with a theme.</p></footer></div></div></body></html>""", [title, *ps, *items]


def plain(rng):
    title, ps = _short(rng), [_p(rng) for _ in range(rng.randint(1, 5))]
    return f"<html><head><title>{title}</title><meta name=generator content=vi><body><h1>{title}</h1>" + "".join(f"<p>{p}\n" for p in ps), [title, *ps]


def magazine(rng):
    title, ps, quote = _short(rng), [_p(rng, 3) for _ in range(rng.randint(3, 6))], _p(rng, 1)
    return f"""<!DOCTYPE html><html><body><div class="Modal-overlay Paywall"><div class="Modal-inner"><h4>Subscribe to read on</h4><p>Only one euro a week.</p></div></div><div class="l-container"><div class="l-header MastHead"><div class="MastHead-menu"><span><a href=/s>Sections</a></span><span><a href=/a>Archive</a></span></div></div>
<div class="l-main"><div class="ArticlePage"><h1 class="ArticlePage-title">{title}</h1><div class="ArticlePage-body"><div><p>{ps[0]}</p></div><blockquote>{quote}</blockquote>{''.join(f'<div><p>{p}</p></div>' for p in ps[1:])}</div><div class="ShareBar social-share"><a href="#">Share</a><a href="#">Post</a><a href="#">Mail</a></div></div></div>
<div class="l-sidebar"><div class="MostRead trending"><h3>Most read</h3><ol><li><a href="/1">{_short(rng)}</a></li><li><a href="/2">{_short(rng)}</a></li></ol></div><div class="SponsorBox"><p>Sponsored: {_short(rng)}</p></div></div>
<div class="l-footer"><p>Imprint. Contact. Jobs.</p></div></div></body></html>""", [title, ps[0], quote, *ps[1:]]


def recipe(rng):
    title, lead = _short(rng), _p(rng, 2)
    needs, steps = [_short(rng) for _ in range(5)], [_p(rng, 1) for _ in range(4)]
    return f"""<!DOCTYPE html><html><body><div id=root><div class="skip-links"><a href="#c">Skip to content</a></div><div class="site-nav-wrapper"><ul class=nav><li><a href=/r>Recipes</a><li><a href=/v>Videos</a></ul></div>
<section id=c class="recipe-card"><h1>{title}</h1><p>{lead}</p><h3>You need</h3><ul>{''.join(f'<li>{n}' for n in needs)}</ul><h3>Do this</h3><ol>{''.join(f'<li>{s}' for s in steps)}</ol></section>
<div class="promo promo--bottom"><p>Try our new app today!</p><a href=/app>Get the app</a></div><div class="responses" id="reviews-comments"><h4>Comments (2)</h4><div><b>ann</b><p>{_p(rng, 1)}</p></div><div><b>bo</b><p>{_p(rng, 1)}</p></div></div><div class="bottom-bar footer">Terms | Privacy</div></div></body></html>""", [title, lead, "You need", *needs, "Do this", *steps]


def notice_board(rng):
    title, ps = _short(rng), [_p(rng) for _ in range(rng.randint(2, 4))]
    return f"""<html><body><nav aria-label=main><a href=/>Start</a><a href=/k>Calendar</a></nav><div role=alert class="notification notification-warning">The office is closed on Monday.</div><main class=page-main><section><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in ps)}</section></main>
<aside class=sidebar-right><h4>Contact</h4><p>Town hall, Main street 1</p></aside><footer>Town of Somewhere, {_short(rng)}</footer></body></html>""", [title, *ps]


LAYOUTS = [blog, wiki, news, tables, manual, plain, magazine, recipe, notice_board]


def pages(n, seed):
    """n pages of every layout: name, html, main text."""
    rng = random.Random(seed)
    for make in LAYOUTS:
        for _ in range(n):
            source, main = make(rng)
            yield make.__name__, source, "\n".join(" ".join(b.split()) for b in main)


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(sum(a.values()) + sum(b.values()), 1)
