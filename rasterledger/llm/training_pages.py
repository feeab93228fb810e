"""Labelled pages for the block labeller: ``data-main`` marks elements whose blocks are main text.

All of them were written for this purpose.
"""

_PROSE = (
    "The harbour was rebuilt twice before the railway reached the coast, and both times the stones came from the same hill.",
    "Every winter the keepers count the birds on the northern meadow; this year they found more than ever.",
    "A letter from the archive shows that the plan was older than the town had believed.",
    "Der alte Weg führt am Fluss entlang, und wer früh aufsteht, sieht die Boote im Nebel.",
    "La maison avait été construite par un meunier qui ne savait pas lire.",
    "El puente fue cerrado durante tres meses, pero nadie en el pueblo se quejó.",
    "Nobody answered",
    "Short notes",
    "Ships | Trains | Roads",
    "*** ### ###",
    "Pricing of the tickets, 4 to 9 in each class, is set by the council (see the list of May).",
)

_NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">the news</a></li><li><a href="/c">About us</a></li></ul></nav>'
_HEAD = "<head><meta charset=utf-8><title>{t} and more</title><style>p{{margin:0}}</style><script>var x='</p>';</script></head>"
_FOOT = "<footer>&copy; example.org &middot; {t} All pages.<p>Imprint</p><a href=/x>Contact</a></footer>"


def _p(*which: int) -> str:
    return "".join(f"<p>{_PROSE[i]}</p>" for i in which)


def _page(body: str, title: str) -> str:
    return "<!DOCTYPE html><html>" + _HEAD.format(t=title) + f"<body>{body}</body></html>"


# Layouts met on the web, one to a row: names of the element that holds the text, of reader comments, notices,
# adverts, menus, sidebars and the foot. Every name is in two rows or more. Fixed values.
_LAYOUTS = (
    ("article class='post'", "section class='replies'", "div class='gdpr consent'", "div class='sponsored'", "div class='navbar'", "div class='widget'", "div class='colophon'"),
    ("div class='entry-content'", "div class='reply'", "div class='cookie-banner'", "div class='ad-slot'", "ul class='topnav'", "aside class='rail'", "div class='site-footer'"),
    ("div class='story'", "div id='discussion'", "div class='alert'", "aside class='promotion'", "div class='breadcrumb'", "div class='related-posts'", "section class='legal'"),
    ("main class='page'", "ol class='comment-list'", "div role='dialog' class='consent'", "div id='advertisement'", "div role='menubar'", "div class='recommended'", "div class='copyright'"),
    ("section class='prose'", "div class='responses'", "div class='privacy-notice'", "div class='ads'", "div id='header-menu'", "div class='widget rail'", "div id='footer-links'"),
    ("div id='story-text'", "section class='user-comments'", "p class='paywall'", "div class='ad-slot sponsored'", "nav class='breadcrumb'", "div class='trending'", "div class='colophon legal'"),
    ("article class='entry'", "div class='discussion thread'", "div class='gdpr'", "div class='promotion'", "div class='topnav'", "section class='related'", "footer class='copyright'"),
    ("div class='prose markdown'", "ul class='replies'", "section class='announcement'", "div class='advertisement'", "div class='navbar'", "div class='recommended trending'", "div class='site-footer'"),
    ("section class='story'", "div class='reply'", "div class='cookie'", "div class='ads'", "div class='site-header menu'", "aside class='widget'", "div class='footer legal'"),
    ("div class='markdown'", "div class='feedback'", "div role='alert'", "section class='sponsored'", "ol class='breadcrumbs'", "div class='rail trending'", "div class='bottom'"),
    ("div class='post-body'", "div class='responses'", "div class='announcement'", "div class='adverts'", "div class='menubar'", "div class='sidebar'", "div class='bottom copyright'"),
    ("div role='main'", "div class='thread'", "div class='paywall'", "div class='adverts'", "header class='site-header'", "div class='more recommended'", "div role='contentinfo'"),
    ("article class='page-content'", "section class='feedback comments'", "div class='privacy consent'", "div class='advertisement promotion'", "ul class='breadcrumbs'", "div class='more'", "div role='contentinfo'"),
)


def _element(opening: str, inner: str, main: bool = False) -> str:
    return f"<{opening}{' data-main' if main else ''}>{inner}</{opening.split()[0]}>"


def _laid_out(layout: tuple[str, ...], turn: int) -> str:
    """A page of this layout; on two of three what is no text stands inside the article."""
    content, comments, notice, advert, menu, side, foot = layout
    inside = turn % 3 != 1

    def prose(*which: int) -> str:
        return _p(*((i + turn) % len(_PROSE) for i in which))

    others = _element(comments, f"<h3>{_PROSE[(7 + turn) % 11]}</h3>{prose(0, 6, 3)}"), _element(notice, prose(5)), _element(advert, prose(9, 2))
    item = _PROSE[(8 + turn) % 11]
    first = f"<h1 data-main>{_PROSE[turn % 11][:40]}</h1><div data-main>{prose(1, 4)}</div>"
    last = f"<div data-main><h2>{_PROSE[(6 + turn) % 11]}</h2>{prose(2, 10)}<ul><li>{item}</li></ul></div>"
    links = "".join(f"<li><a href=/{i}>{_PROSE[(i + turn) % 11][:18]}</a></li>" for i in range(3))
    if turn % 3 == 2:
        # Single paragraphs straight inside the article, each between two blocks of something else.
        one, two, three = (f"<p data-main>{_PROSE[(i + turn) % 11]}</p>" for i in (1, 4, 2))
        body = f"<h1 data-main>{_PROSE[turn % 11][:40]}</h1>{one}{others[1]}{two}{others[2]}{three}{others[0]}"
    else:
        body = first + others[1] + others[2] + last + others[0] if inside else first + last
    page = _element(menu, f"<ul>{links}</ul>") + ("" if inside else others[1] + others[2]) + _element(content, body)
    page += ("" if inside else others[0]) + _element(side, f"<h3>{item}</h3>{prose(3, 7)}<ul>{links}</ul>")
    return _page(page + _element(foot, f"{_PROSE[(4 + turn) % 11]}<p>{_PROSE[(7 + turn) % 11]}</p>"), _PROSE[turn % 11][:30])


def layout_pages() -> list[list[str]]:
    """Three pages for each layout: comments, notices and adverts between runs of text, outside, between single paragraphs."""
    return [[_laid_out(layout, 3 * i + kind) for kind in range(3)] for i, layout in enumerate(_LAYOUTS)]


def labelled_pages() -> list[str]:
    """All labelled pages: some written one by one, and those of the layouts."""
    return _single_pages() + [page for pages in layout_pages() for page in pages]


def _single_pages() -> list[str]:
    p, prose = _p, _PROSE
    ad = f'<div class="ad">{prose[2]}</div>'
    return [
        _page(f"{_NAV}{ad}<article data-main><h1>{prose[0][:40]}</h1>{p(0, 1, 2)}</article>" + _FOOT.format(t=prose[3]), prose[0][:40]),
        _page(f"{_NAV}<!-- ad --><div class='ad'>{prose[6]}</div><article data-main><h1>{prose[7]}</h1><p><b>{prose[8]}<br>{p(9, 6, 7)}</article>" + _FOOT.format(t=prose[6]), prose[7]),
        _page(f"{ad}<article data-main><h1>{prose[9]}</h1><p>{prose[9]}</article><footer>&copy; x.example.net &middot; {prose[0]}\n{prose[1]}</footer>", prose[9]),
        _page(
            f"<header><h1>The Daily Example</h1><p>{prose[1]}</p>{_NAV}</header><main data-main><h2>{prose[6]}</h2>{p(3, 4, 5)}<ul><li>{prose[8]}</li><li>{prose[2]}</li></ul></main>"
            f"<aside class='sidebar'><h3>Read more</h3>{p(2, 0)}<ul><li><a href=/1>{prose[1]}</a></li></ul></aside><footer><p>{prose[4]}</p></footer>",
            prose[3][:30],
        ),
        _page(
            f"<div id='cookie-notice' class='notice'><p>We use cookies. {prose[2]}</p><button>Accept</button></div><div class='menu'><a href=/>Start</a> <a href=/s>Search</a></div>"
            f"<div id='content' data-main><h1>{prose[4][:30]}</h1>{p(4, 1, 6, 0)}<blockquote>{prose[5]}</blockquote></div>"
            f"<div class='comments'><h3>Comments</h3><div class='comment'><p>{prose[1]}</p></div><div class='comment'><p>{prose[7]}</p></div></div>"
            f"<form><label>Name</label><input name=n><p>{prose[6]}</p><button>Send</button></form><div class='footer'>{prose[3]}</div>",
            prose[4][:30],
        ),
        _page(
            f"<div class='banner'><p>{prose[0]}</p></div><article><header><h1 data-main>{prose[5][:25]}</h1></header><div data-main>{p(5, 3)}</div>{ad}<div class='advert'><p>{prose[1]}</p></div>"
            f"<p data-main>{prose[10]}</p><section id='comments' class='comments'><p>{prose[0]}</p><p>{prose[2]}</p></section></article><aside><p>{prose[4]}</p></aside>",
            prose[5][:25],
        ),
        _page(
            f"<div role='navigation'><ul><li>Start</li><li>Links</li></ul></div><section class='related'><p>{prose[2]}</p></section><div class='article-body' data-main>{p(10, 7, 0)}"
            f"<table><tr><td>{prose[6]}</td><td>{prose[8]}</td></tr></table><pre>{prose[9]}</pre></div><div class='newsletter'><p>{prose[1]}</p><form><p>Your address</p></form></div>"
            f"<div class='social share'><a href=/f>Share this</a></div><footer>{p(0, 2)}</footer>",
            prose[10][:20],
        ),
        _page(
            f"{_NAV}<main><article data-main><h1>{prose[2]}</h1>{p(2)}<h2>{prose[7]}</h2>{p(6, 9)}<p><a href=/q>{prose[8]}</a></p></article><div class='comments'><p>{prose[5]}</p><p>{prose[3]}</p></div></main>"
            f"<div class='promo'><p>{prose[4]}</p></div>" + _FOOT.format(t=prose[1]),
            prose[2],
        ),
        _page(f"{_NAV}{ad}" + _FOOT.format(t=prose[0]), "Nothing here"),
        _page(f"<div class='popup notice'>{prose[5]}</div>{_NAV}<article data-main><p>{prose[7]}</p></article><div class='sidebar'>{p(1, 3)}</div>", prose[7]),
    ]
