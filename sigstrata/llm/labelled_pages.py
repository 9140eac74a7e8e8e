"""Labelled pages of many layouts, for training the extraction of main text (operator 11).

Every page is put together from parts that pages have: menus, headers, notices, adverts, the article, sidebars,
reader comments, forms and footers. Each part comes in several spellings (semantic tags, or ``div`` and tables with
class names, or neither), in random order and number, with words made up on the spot. Nothing is read from a table.
"""

from __future__ import annotations

import html
from random import Random

SYLLABLES = "an be ch da el er fi gro ha in ka lo mi ne or pa qui ra se ti um ver wa xo yl zé ñu ö å".split()
SCRIPTS = ("", "", "", "бгдежзиклмнопрст", "的一是在不了有和人這", "αβγδεηικλμνοπρστ")
# Fixed: names that pages give to their parts.
NAMES = {
    "menu": "nav navbar menu main-menu navigation topnav site-nav nav-links breadcrumb breadcrumbs mainNav menu-primary".split(),
    "header": "header site-header masthead top topbar banner page-header siteHeader head logo branding".split(),
    "footer": "footer site-footer colophon bottom foot page-footer siteFooter footer-widgets copyright credits".split(),
    "sidebar": "sidebar side widget widget-area rightcol right-column secondary rail sideBar related related-posts recommended more trending popular".split(),
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert popup modal overlay privacy-notice subscribe-box newsletter message paywall".split(),
    "advert": "ad ads advert advertisement ad-slot sponsored promo promotion adsbygoogle banner-ad ad-container sponsor ad-box".split(),
    "comments": "comments comment-list responses discussion commentlist comment-section user-comments replies disqus_thread feedback".split(),
    "comment": "comment reply comment-body response depth-1 user-comment".split(),
    "share": "share social share-buttons sharing social-links tags post-meta-share follow".split(),
    "form": "form search search-form login subscribe newsletter-signup contact-form signup comment-form respond".split(),
    "article": "article post entry entry-content post-content article-body story content main-content blog-post text body-text hentry prose page-content".split(),
    "frame": "container wrapper page layout row col main inner site wrap grid content-area primary column".split(),
}
LINKS = """Home|About us|Contact|News|Sport|Login|Sign up|Next|Previous|Read more|Startseite|Impressum|Kontakt|Anmelden|Accueil|Mentions
légales|Inicio|Contacto|Archive|Privacy policy|Terms of use|Share|Tweet|RSS|Help|Top|Reply|Blog|Shop|Search|FAQ|Jobs|Menu""".replace("\n", " ").split("|")
NOTICES = ("We use cookies to improve your experience.", "By continuing you accept our privacy policy.", "Wir verwenden Cookies auf dieser Seite.",
           "Ce site utilise des cookies.", "Este sitio utiliza cookies.", "Subscribe to our newsletter.", "Please enable notifications to stay informed.",
           "You have read all your free articles this month.", "Advertisement", "Sponsored", "Anzeige", "Publicité", "All rights reserved.",
           "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.")


class Writer:
    """Writes one page; ``main`` gathers the texts of its main blocks in order."""

    def __init__(self, random: Random):
        self.random, self.main, self.used = random, [], set()
        self.letters = random.choice(SCRIPTS)
        self.semantic = random.random() < 0.5
        self.junk = random.random() < 0.1
        self.unclosed = random.random() < 0.2

    def word(self) -> str:
        r = self.random
        if self.letters:
            return "".join(r.choice(self.letters) for _ in range(r.randint(1, 6)))
        word = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        return word + r.choice(("%%%", "***", "###", "$$$", "&&&")) if self.junk and r.random() < 0.8 else word

    def words(self, n: int) -> list[str]:
        while True:             # no text twice on a page: its label goes by its text
            out = [self.word() for _ in range(n)]
            if " ".join(out) not in self.used:
                self.used.add(" ".join(out))
                return out
            n += 1

    def sentence(self, n: int) -> str:
        r, out = self.random, self.words(max(1, n))
        for k in range(len(out) - 1):
            out[k] += r.choice(("", "", "", "", "", "", "", ",", ",", " &", " –") if n > 6 else ("",))
        out[0] = out[0][:1].upper() + out[0][1:]
        if r.random() < 0.1:
            out.insert(r.randrange(len(out)) + 1, str(r.randint(1, 2030)) if r.random() < 0.7 else r.choice("|·»→@#"))
        return " ".join(out) + (r.choice(".....!?") if r.random() < 0.93 else "")

    def prose(self, most: int = 120) -> str:
        r = self.random
        left, out = (r.randint(1, 8) if r.random() < 0.2 else r.randint(8, most)), []
        while left > 0:
            out.append(self.sentence(min(left, r.randint(2, 22))))
            left -= out[-1].count(" ") + 1
        return " ".join(out)

    def marked(self, text: str) -> str:
        """``text`` in html, with inline elements around some words."""
        r, out = self.random, []
        for word in text.split(" "):
            shown = html.escape(word) if r.random() < 0.9 else word.replace("&", "&#38;").replace("<", "&lt;")
            if r.random() < 0.03:
                tag = r.choice(("b", "em", "i", "strong", "a href='/x'", "span class=\"x\"", "code", "mark"))
                shown = f"<{tag}>{shown}</{tag.split(' ')[0]}>"
            out.append(shown)
        return r.choice((" ", " ", " ", "\n", "  ")).join(out) if r.random() < 0.2 else " ".join(out)

    def keep(self, text: str) -> str:
        self.main.append(" ".join(text.split()))
        return self.marked(text)

    def named(self, part: str, tags: str, chance: float = 0.85) -> tuple[str, str]:
        """(start tag, end tag) of a part; with ``semantic`` its own element, else a plain one with a name."""
        r = self.random
        tag = r.choice(tags.split()) if self.semantic or r.random() < 0.3 else r.choice(("div", "div", "section", "td"))
        plain = tag in ("div", "section", "td", "ul", "table", "p", "span")
        if not plain and r.random() < 0.5 or plain and r.random() > chance and part not in ("sidebar", "comments", "notice", "advert", "form"):
            if not plain:
                return self._cell(tag, "")
        key = r.choice(("class", "class", "class", "id"))
        name = r.choice(NAMES[part])
        if r.random() < 0.2:
            name += " " + r.choice(NAMES["frame"])
        mark = f" {key}={name}" if " " not in name and r.random() < 0.1 else f' {key}="{name}"'
        return self._cell(tag, mark)

    def _cell(self, tag: str, mark: str) -> tuple[str, str]:
        if tag == "td":
            return f"<table{self.random.choice(('', mark))}><tr><td{mark}>", "</td></tr></table>"
        return f"<{tag}{mark}>", f"</{tag}>"

    def wrap(self, ends: tuple[str, str], *inside: str) -> str:
        gap = self.random.choice(("", "", "\n"))
        return ends[0] + gap + gap.join(inside) + gap + ends[1]

    def link(self) -> str:
        text = self.random.choice(LINKS) if self.random.random() < 0.6 else self.sentence(self.random.randint(1, 8))
        return f'<a href="/{self.random.randint(1, 999)}">{html.escape(text)}</a>'

    def links(self, least: int, most: int) -> str:
        links = [self.link() for _ in range(self.random.randint(least, most))]
        kind = self.random.randrange(4)
        if kind < 2:
            end = "" if self.unclosed else "</li>"
            return "<ul>" + "".join(f"<li>{x}{end}" for x in links) + "</ul>"
        return self.random.choice((" | ", " ", " » ")).join(links) if kind == 2 else "".join(f"<p>{x}</p>" for x in links)

    # ---- parts ----
    def menu(self) -> str:
        return self.wrap(self.named("menu", "nav nav ul menu"), self.links(2, 9))

    def header(self) -> str:
        r, inside = self.random, []
        if r.random() < 0.7:
            inside.append(f"<{(t := r.choice(('div', 'p', 'h2', 'span', 'h1')))}>{html.escape(self.sentence(r.randint(1, 4)))}</{t}>")
        if r.random() < 0.4:
            inside.append(f"<p>{html.escape(self.sentence(r.randint(3, 9)))}</p>")
        if r.random() < 0.5:
            inside.append(self.menu())
        if r.random() < 0.3:
            inside.append(self.form())
        return self.wrap(self.named("header", "header"), *inside) if inside else ""

    def footer(self) -> str:
        r, inside = self.random, []
        if r.random() < 0.5:
            inside.append(self.links(1, 8))
        mark = r.choice(("&copy;", "©", "&#169;", "Copyright"))
        inside.append(r.choice(("{}", "<p>{}</p>", "<div>{}</div>")).format(f"{mark} {r.choice((2019, 2024, 'www.example.org'))} "
                      f"{r.choice(('&middot;', '|', '-', ''))} {html.escape(self.prose(14))}"))
        if r.random() < 0.4:
            inside.append(f"<p>{html.escape(self.prose(25))}</p>")
        return self.wrap(self.named("footer", "footer"), *inside)

    def sidebar(self) -> str:
        r, inside = self.random, []
        for _ in range(r.randint(1, 3)):
            inside.append(f"<{(t := r.choice(('h2', 'h3', 'h4', 'p', 'div')))}>{html.escape(self.sentence(r.randint(1, 4)))}</{t}>")
            inside.append(self.links(2, 6) if r.random() < 0.6 else f"<p>{self.marked(self.prose(40))}</p>")
        return self.wrap(self.named("sidebar", "aside"), *inside)

    def notice(self) -> str:
        r = self.random
        text = r.choice(NOTICES) + (" " + self.prose(20) if r.random() < 0.6 else "")
        inside = [r.choice(("{}", "<p>{}</p>", "<span>{}</span>")).format(html.escape(text))]
        if r.random() < 0.5:
            inside.append(f"<button>{r.choice(('OK', 'Accept', 'Accept all', 'Close', 'Akzeptieren', 'Accepter', 'Aceptar'))}</button>")
        start, end = self.named("notice", "div dialog aside")
        return self.wrap((start[:-1] + r.choice((' role="alert">', ' role="dialog">', " hidden>", ">", ">", ">", ">")), end), *inside)

    def advert(self) -> str:
        r = self.random
        text = r.choice(NOTICES[8:12]) if r.random() < 0.2 else self.prose(25)
        inside = f"<a href='//ad.example'>{html.escape(text)}</a>" if r.random() < 0.3 else html.escape(text)
        return self.wrap(self.named("advert", "ins aside div"), r.choice(("{}", "<p>{}</p>", "{}")).format(inside))

    def comment(self) -> str:
        r = self.random
        inside = [f"<{(t := r.choice(('h4', 'div', 'span', 'p', 'cite')))}>{html.escape(self.sentence(2))}</{t}>"]
        inside += [f"<p>{self.marked(self.prose(60))}</p>" for _ in range(r.randint(1, 2))]
        if r.random() < 0.4:
            inside.append('<a href="#">Reply</a>')
        return self.wrap(self.named("comment", "article li div"), *inside)

    def comments(self) -> str:
        r, inside = self.random, []
        if r.random() < 0.7:
            inside.append(f"<h{(n := r.randint(2, 4))}>{r.choice(('Comments', 'Kommentare', 'Commentaires', 'Comentarios', '3 comments', 'Leave a reply'))}</h{n}>")
        inside += [self.comment() for _ in range(r.randint(1, 5))]
        if r.random() < 0.4:
            inside.append(self.form())
        return self.wrap(self.named("comments", "section div ol"), *inside)

    def form(self) -> str:
        r = self.random
        inside = [f"<label>{html.escape(self.sentence(r.randint(1, 3)))}</label><input name=q>" for _ in range(r.randint(0, 3))]
        if r.random() < 0.4:
            inside.append(f"<p>{html.escape(self.prose(15))}</p>")
        if r.random() < 0.3:
            inside.append("<select>" + "".join(f"<option>{html.escape(self.sentence(1))}" for _ in range(3)) + "</select>")
        inside.append(f"<button>{r.choice(('Search', 'Send', 'Subscribe', 'Log in', 'Suchen', 'Envoyer', 'Enviar'))}</button>")
        return self.wrap(self.named("form", "form form form"), *inside) if r.random() < 0.2 else self.wrap(("<form>", "</form>"), *inside)

    def share(self) -> str:
        return self.wrap(self.named("share", "div ul"), self.links(2, 5))

    def piece(self) -> str:
        """One or a few blocks of the article."""
        r = self.random
        kind = r.random()
        end = "" if self.unclosed and r.random() < 0.5 else "</p>"
        if kind < 0.68:
            if self.unclosed and r.random() < 0.3:
                return f"<p><b>{self.keep(self.prose())}<br>"
            return f"<p>{self.keep(self.prose())}{end}"
        if kind < 0.76:
            return f"<h{(n := r.randint(2, 4))}>{self.keep(self.sentence(r.randint(1, 9)))}</h{n}>"
        if kind < 0.83:
            item = "" if self.unclosed else "</li>"
            return f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.keep(self.prose(25))}{item}" for _ in range(r.randint(1, 5))) + f"</{t}>"
        if kind < 0.88:
            return f"<blockquote>{r.choice(('<p>{}</p>', '{}')).format(self.keep(self.prose(50)))}</blockquote>"
        if kind < 0.92:
            return f"<figure><img src=a.png><figcaption>{self.keep(self.prose(14))}</figcaption></figure>"
        if kind < 0.95:
            return f"<pre>{self.keep(self.prose(30))}</pre>"
        if kind < 0.96:
            return f"<p>{self.keep(' | '.join(self.sentence(r.randint(1, 3)) for _ in range(r.randint(2, 6))))}{end}"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.sentence(r.randint(1, 4)))}</td>" for _ in range(2)) + "</tr>"
                                       for _ in range(r.randint(1, 3))) + "</table>"
        return f"<div>{self.keep(self.prose())}</div>"

    def article(self) -> str:
        r, inside = self.random, []
        if r.random() < 0.85:
            head = f"<h1>{self.keep(self.sentence(r.randint(1, 12)))}</h1>"
            if r.random() < 0.15:
                head = f'<header class="entry-header">{head}</header>'
            elif r.random() < 0.15:
                head = f"<header>{head}</header>"
            inside.append(head)
            if r.random() < 0.15:
                inside.append(f'<p class="{r.choice(("byline", "author", "meta", "date", "lead", "summary"))}">{self.keep(self.sentence(r.randint(2, 6)))}</p>')
        pieces = [self.piece() for _ in range(r.randint(1, 4) if r.random() < 0.3 else r.randint(3, 16))]
        for k, chance in enumerate((0.2, 0.15, 0.12, 0.1, 0.08)):
            if r.random() < chance:
                part = (self.advert, self.share, self.sidebar, self.form, self.notice)[k]()
                pieces.insert(r.randint(1, len(pieces)), ("</b>" if self.unclosed else "") + part)
        inside += pieces
        if r.random() < 0.12:
            inside.append(self.comments())
        if r.random() < 0.08:
            inside.append(f"<footer>{self.links(1, 4)}</footer>")
        if self.unclosed and r.random() < 0.5:
            inside.append("</p>")
        body = self.named("article", "article article article main", 0.75)
        if not self.semantic and r.random() < 0.12:
            body = ("", "")
        return self.wrap(body, *inside)

    def page(self) -> str:
        r = self.random
        kind = r.random()
        if kind < 0.02:
            return self.keep(self.prose())
        above, beside, below = [], [], []
        for part, chance, where in ((self.notice, 0.3, above), (self.header, 0.55, above), (self.menu, 0.75, above), (self.advert, 0.4, above),
                                    (self.form, 0.12, above), (self.sidebar, 0.45, beside), (self.advert, 0.2, beside),
                                    (self.share, 0.15, beside), (self.comments, 0.35, below), (self.notice, 0.1, below),
                                    (self.advert, 0.15, below), (self.menu, 0.12, below), (self.footer, 0.85, below)):
            if r.random() < chance:
                where.append(part())
        if r.random() < 0.5:
            r.shuffle(above)
        early = [x for x in beside if r.random() < 0.25]
        late = [x for x in beside if x not in early]
        article = "" if kind < 0.04 else self.article()
        middle = [*early, article, *late]
        if r.random() < 0.3:
            middle = ["<main>", *middle, "</main>"]
        if r.random() < 0.4:
            middle = [f'<div class="{r.choice(NAMES["frame"])}">', *middle, "</div>"]
        body = [*above, *middle, *below]
        if r.random() < 0.2:
            body = [f'<div id="{r.choice(NAMES["frame"])}">', *body, "</div>"]
        head = f"<head><meta charset=utf-8><title>{html.escape(self.sentence(5))}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        end = "" if r.random() < 0.1 else "</body></html>"
        comment = "<!-- menu <p> -->" if r.random() < 0.5 else ""
        return f"<!DOCTYPE html><html>{head}<body>{comment}{r.choice(('', chr(10))).join(body)}{end}"


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, str]]:
    """``n`` pairs of html and main text."""
    out = []
    for k in range(n):
        writer = Writer(Random(seed * 1_000_003 + k))
        source = writer.page()
        out.append((source, "\n".join(writer.main)))
    return out
