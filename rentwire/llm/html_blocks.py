"""Main text of web pages by a recurrent block labeller (operator 10).

A page is cut into leaf blocks: stretches of text between block-level tags. Each block is a vector of its hashed tag path
(tags, classes and ids of its block-level ancestors), its hashed words and a few measures of the block and of the elements
around it. A bidirectional LSTM in numpy reads the vectors of a page in order and labels every block as main text or not
with the whole page as context. It is trained here, on pages that ``training_page`` draws from a fixed seed, whose blocks are
labelled by how they were drawn: with telling, meaningless and no names, in sections, bare elements and table cells, with
words that tell something and words that don't. Training takes about half a minute of the driver, once a session; the
weights (0.2 MB) are broadcast.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import U, Words, separators, slices, text_bytes, with_fields

PATH, WORD = 160, 48
MEASURES = 15
WIDTH = PATH + WORD + MEASURES
HIDDEN = 16
#: Drawn pages, passes over them and pages of a step.
PAGES, EPOCHS, STEP = 1200, 9, 40
#: Names of a path that count: those of the innermost elements. It bounds the work on pages of endless nesting.
DEPTH = 48

#: Tags that begin or end a block, tags whose own kind closes them, tags without content.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead title tr ul button label iframe svg textarea".split())
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = BLOCK - {"html", "body", "head", "option", "optgroup", "button", "label", "select", "svg", "iframe", "textarea", "title", "template", "noscript"}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*+>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.IGNORECASE)
PIECES = re.compile(r"[a-z]+|[^\W\d_]+")


class Block:
    __slots__ = ("depth", "element", "linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int, element: int, depth: int):
        self.text, self.path, self.linked, self.element, self.depth = text, path, linked, element, depth


class Page(list):
    """Leaf blocks of a page, in order; above[i] is the element around element i, and element 0 is the page."""

    def __init__(self):
        self.above = [0]

    def around(self) -> np.ndarray:
        """(blocks, 8): of the element that a block's own stands in, and of the one around that: characters, blocks, linked share, share of the page's characters."""
        own = np.array([b.element for b in self], np.int64)
        above = np.array(self.above, np.int64)
        chars, linked, n = (np.bincount(own, w, len(above)) for w in ([len(b.text) for b in self], [b.linked for b in self], [1] * len(self)))
        for i in range(len(above) - 1, 0, -1):  # an element's number is above those around it
            chars[above[i]] += chars[i]
            linked[above[i]] += linked[i]
            n[above[i]] += n[i]
        columns = []
        for at in (above[own], above[above[own]]):
            columns += [np.log1p(chars[at]) / 8, np.log1p(n[at]) / 4, linked[at] / np.maximum(chars[at], 1), chars[at] / max(chars[0], 1)]
        return np.column_stack(columns)


def blocks(page: str) -> Page:
    """Leaf blocks in page order: character references decoded, white space in a block one space, trimmed, none empty."""
    out = Page()
    stack: list[tuple[str, tuple[str, ...], int]] = []  # open block-level elements with their path and number
    parts: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    link = at = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                linked = sum(len(x) for x, own in parts if own)
                _, path, element = stack[-1] if stack else ("", (), 0)
                out.append(Block(text, path, min(linked, len(text)), element, len(stack)))
            parts.clear()

    def add(text: str) -> None:
        if text:
            parts.append((html.unescape(text), link > 0))

    def close(k: int) -> None:
        for tag, _, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    for m in MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "a":
            link = max(0, link - 1) if m["end"] else 1
        elif tag == "br":
            parts.append((" ", False))
        if tag not in BLOCK:
            continue
        flush()
        if m["end"]:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
                link = 0
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        closes = CLOSES.get(tag, "").split()
        while stack and stack[-1][0] in closes:
            close(len(stack) - 1)
        if tag not in VOID and not m["attrs"].endswith("/"):
            names = [tag]
            for found in NAMES.findall(m["attrs"]):
                names += [f".{x}" for x in PIECES.findall("".join(found).lower())]
            stack.append((tag, (*(stack[-1][1] if stack else ()), *names)[-DEPTH:], len(out.above)))
            opened[tag] += 1
            out.above.append(stack[-2][2] if len(stack) > 1 else 0)
    add(page[at:])
    flush()
    return out


@functools.lru_cache(100_000)
def place(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h & 0x40000000 else -1.0


SEPARATOR = separators(x for x in range(0x80) if not chr(x).isalpha())


def word_vectors(texts: list[str]) -> np.ndarray:
    """Mean of the signed hashed words of each text."""
    words = Words(*text_bytes(pa.array(texts, pa.string())), SEPARATOR)
    counts = words.counts
    text = np.repeat(np.arange(len(texts)), counts)
    sign = np.where(words.hash >> U(63) == 1, 1.0, -1.0)
    sums = np.bincount(text * WORD + (words.hash % U(WORD)).astype(np.int64), sign, len(texts) * WORD)
    return sums.reshape(-1, WORD) / np.maximum(counts, 1)[:, None]


def features(pages: list[Page]) -> list[np.ndarray]:
    """(blocks, WIDTH) for each page."""
    ends = np.cumsum([0, *map(len, pages)])
    x = np.zeros((int(ends[-1]), WIDTH), np.float32)
    x[:, PATH : PATH + WORD] = word_vectors([b.text for page in pages for b in page])
    for page, first in zip(pages, ends.tolist()):
        if page:
            x[first : first + len(page), -8:] = page.around()
        before = -1
        for k, b in enumerate(page):
            row, n, above = x[first + k], len(b.text), page.above[b.element]
            for token in (*b.path, *(f"own {p}" for p in b.path[-1:])):
                at, sign = place(token, PATH)
                row[at] += sign
            row[PATH + WORD : -8] = math.log1p(n) / 5, b.linked / n, b.text.endswith((".", "!", "?", ":", ";")), sum(map(b.text.count, ".,;")) / n, k / len(page), 1 / (1 + k), above == before
            before = above
    np.clip(x[:, :PATH], -2, 2, out=x[:, :PATH])
    return [x[i:j] for i, j in zip(ends, ends[1:])]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic layer over both."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN)), f"u{d}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p |= {"v": r.normal(0, 0.2, 2 * HIDDEN), "o": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, d: str, x: np.ndarray, mask: np.ndarray):
        """States of one direction: x (time, pages, WIDTH), mask (time, pages, 1). Padding leaves the state as it is."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        pre, states, kept = x @ self.p[f"w{d}"] + self.p[f"c{d}"], [], []
        for t in range(len(x)):
            z = pre[t] + h @ self.p[f"u{d}"]
            i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            s = np.tanh(c2)
            kept.append((h, c, i, f, o, g, s))
            h, c = np.where(mask[t], o * s, h), np.where(mask[t], c2, c)
            states.append(h)
        return np.stack(states), kept

    def logits(self, x: np.ndarray, mask: np.ndarray):
        f, kept_f = self.run("f", x, mask)
        b, kept_b = self.run("b", x[::-1], mask[::-1])
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.p["v"] + self.p["o"], both, kept_f, kept_b

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, both, kept_f, kept_b = self.logits(x, mask)
        dz = (sigmoid(z) - y) * mask[..., 0] / mask.sum()
        g = {"v": np.einsum("tp,tph->h", dz, both), "o": dz.sum(keepdims=True).reshape(1)}
        dboth = dz[..., None] * self.p["v"]
        for d, kept, dh_all, xs, ms in (("f", kept_f, dboth[..., :HIDDEN], x, mask), ("b", kept_b, dboth[::-1, :, HIDDEN:], x[::-1], mask[::-1])):
            dh = dc = np.zeros_like(kept[0][0])
            dpre = np.zeros((*xs.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(self.p[f"u{d}"])
            for t in range(len(xs) - 1, -1, -1):
                h, c, i, f, o, gate, s = kept[t]
                dh = dh + dh_all[t]
                on = ms[t]
                dc2 = np.where(on, dc + dh * o * (1 - s * s), 0)
                raw = np.where(on, np.concatenate([dc2 * gate * i * (1 - i), dc2 * c * f * (1 - f), dh * s * o * (1 - o), dc2 * i * (1 - gate * gate)], axis=1), 0)
                dpre[t] = raw
                du += h.T @ raw
                dh, dc = np.where(on, raw @ self.p[f"u{d}"].T, dh), np.where(on, dc2 * f, dc)
            g |= {f"w{d}": np.einsum("tpi,tpj->ij", xs, dpre, optimize=True), f"u{d}": du, f"c{d}": dpre.sum(axis=(0, 1))}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.01, seed: int = 6) -> None:
        r = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        n = 0
        for _ in range(epochs):
            order = sorted(range(len(pages)), key=lambda k: (len(pages[k][1]) // 6, r.random()))
            steps = [order[k : k + STEP] for k in range(0, len(order), STEP)]
            r.shuffle(steps)
            for some in steps:
                x, mask = padded([pages[k][0] for k in some])
                y = np.zeros(mask.shape[:2], np.float32)
                for j, k in enumerate(some):
                    y[: len(pages[k][1]), j] = pages[k][1]
                n += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)

    def label(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page, which blocks are main text. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and stop - at < 256 and (stop - at + 1) * len(pages[order[stop]]) < 20_000:
                stop += 1
            some = order[at:stop]
            x, mask = padded(features([pages[k] for k in some]))
            z = self.logits(x, mask)[0]
            for j, k in enumerate(some):
                out[k] = z[: len(pages[k]), j] > 0
            at = stop
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), WIDTH), np.float32)
    mask = np.zeros((longest, len(pages), 1), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
    return x, mask


#: Names that pages give to their parts, and words that those parts hold.
NAMES_OF = {
    "main": "content main article post entry story body text page article-body post-content entry-content story-body main-content content-area news-text article__body richtext single-post hentry prose maincol reader longform",
    "menu": "nav menu navigation navbar topnav breadcrumbs main-menu site-nav tabs toc pagination mega-menu subnav quicklinks",
    "other": "ad ads advert advertisement banner-ad sponsored promo promotion sidebar aside widget related related-posts most-read trending popular recommended teaser cookie cookie-consent consent notice alert notification newsletter subscribe signup paywall share social follow popup modal overlay login search search-form tags rail outbrain gdpr app-download donate poll survey",
    "comments": "comments comment comment-list disqus-thread discussion responses reader-comments respond replies feedback",
    "head": "header site-header masthead banner topbar branding logo-bar page-header",
    "foot": "footer site-footer page-footer copyright legal colophon bottom imprint impressum contentinfo",
}
TAGS_OF = {"main": ("article", "main", "section"), "menu": ("nav", "ul"), "other": ("aside", "section", "form", "noscript"), "comments": ("section", "ol", "aside"), "head": ("header",), "foot": ("footer",)}
SAYS = {
    "menu": "Home|News|Sport|World|Business|Opinion|Contact|About us|Sign in|Log in|Search|Products|Support|Blog|Forum|Shop|Help|FAQ|Startseite|Nachrichten|Kontakt|Accueil|Actualités|Inicio|Noticias|Contacto|Weather|Culture|Politics|Travel|More|Next|Previous|Archive",
    "other": "Advertisement|Sponsored content|Subscribe to our newsletter|Sign up for free|We use cookies to improve your experience|Accept all cookies|Manage your privacy settings|Share this article|Follow us on social media|Most read|Related stories|You may also like|Read more|Recommended for you|Trending now|Buy now and save|Limited offer, order today|Download our app|Enter your email address|Search this site|Log in to continue|Diese Seite verwendet Cookies|Jetzt abonnieren|Anzeige|Publicité|Nous utilisons des cookies|Suscríbete a nuestro boletín|Publicidad|This story is for subscribers only|Get the latest delivered to your inbox|Print this page|Tags",
    "comments": "Comments|Leave a comment|Reply|Report abuse|Great article, thanks|I disagree with this|Show all comments|Log in to comment|Posted by|says|wrote on|Kommentare|Antworten|Commentaires|Comentarios|likes|I think the author is wrong here|Join the discussion",
    "head": "The Daily|Welcome to|Your source for|Menu|Skip to content|Edition|Today",
    "foot": "&copy; 2024|All rights reserved|Privacy policy|Terms of use|Contact us|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by|Back to top|Sitemap|Accessibility|Cookie settings",
}
COMMON = "the of and to in a is that was for on with as by at from it be this are der die und das ist mit von zu den nicht le la les des et en un une est pour el los que de y se con por".split()


def training_page(r: random.Random, names_of: dict[str, str] = NAMES_OF, named: float = 0.7) -> tuple[str, list[bool]]:
    """A drawn page and, for each of its blocks, whether it is main text. named: how often a part that can be told otherwise has a telling name or tag."""
    labels: list[bool] = []
    letters = "aeiouaeioubcdlmnrstpghwyéöñç"
    stock = [*COMMON, *("".join(r.choice(letters) for _ in range(r.randint(2, 11))) for _ in range(150))]
    spoken = r.random() < 0.7  # else no part of the page says what it is
    loud = r.random() < 0.1  # tags in capitals, attributes without quotes

    def words(low: int, high: int, ends: str = ".") -> str:
        n = r.randint(low, high)
        some = [r.choice(stock) + (r.choice(",.,;") if r.random() < 0.08 else "") for _ in range(n)]
        return (" ".join(some)).capitalize() + (r.choice((ends, "", "&amp;", "!", "?")) if r.random() < 0.25 else ends)

    def noise() -> str:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(3, 8)))

    def name_of(kind: str) -> str:
        return r.choice(names_of[kind].split())

    def wrap(tag: str, name: str | None, inner: str) -> str:
        if loud:
            return f"<{tag.upper()}{f' CLASS={name}' if name else ''}>{inner}</{tag.upper()}>"
        how = r.choice(("class", "class", "class", "id", "role")) if name else ""
        extra = f" {noise()}" if name and how == "class" and r.random() < 0.3 else ""
        return f'<{tag}{f" {how}={chr(34)}{name}{extra}{chr(34)}" if name else ""}>{inner}</{tag}>'

    def part(kind: str, inner: str, told: bool) -> str:
        """told: its words or links tell what it is, so it may have no telling name."""
        if told and r.random() > named:
            return wrap(r.choice(("div", "div", "section", "td")), r.choice((None, noise(), f"css-{noise()}")), inner)
        if r.random() < 0.4:
            tag = r.choice(TAGS_OF[kind])
            return wrap(tag, r.choice((None, name_of(kind))) if tag not in ("section", "ul", "ol") else name_of(kind), inner)
        return wrap("div", name_of(kind), inner)

    def put(tag: str, text: str, main: bool) -> str:
        labels.append(main)
        shut = tag not in ("p", "li") or r.random() < 0.9
        return f"<{tag}>{text}</{tag}>" if shut else f"<{tag}>{text}"

    def links(low: int, high: int, says: str | None) -> str:
        tag = r.choice(("li", "li", "li", "div", "p"))
        rows = "".join(put(tag, f'<a href="/{noise()}">{r.choice(SAYS[says].split("|")) if says and spoken and r.random() < 0.7 else words(1, 8, "")}</a>', False) for _ in range(r.randint(low, high)))
        return f"<ul>{rows}</ul>" if tag == "li" else rows

    def body(depth: int = 0) -> str:
        out = []
        if not depth:
            if r.random() < 0.85:
                head = put("h1", words(2, 12, ""), True)
                out.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
            if r.random() < 0.1:
                out.append(f'<figure><img src="x.jpg">{put("figcaption", words(3, 15), True)}</figure>')
        for _ in range(r.choice((1, 2, 3, 6, 10, 25))):
            kind = r.random()
            if kind < 0.6:
                out.append(put("p", words(1, 60), True))
            elif kind < 0.68:
                labels.append(True)
                out.append(f"<p><b>{words(2, 12)}<br>")
            elif kind < 0.76:
                out.append(put(r.choice(("h2", "h3", "h4")), words(1, 8, ""), True))
            elif kind < 0.82:
                out.append("<ul>" + "".join(put("li", words(1, 25, r.choice((".", ""))), True) for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.85:
                out.append("<blockquote>" + put("p", words(5, 40), True) + "</blockquote>")
            elif kind < 0.88:
                out.append("<table>" + "".join("<tr>" + put("td", words(1, 4, ""), True) + put("td", words(1, 4, ""), True) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.9:
                out.append(put("pre", words(3, 20), True))
            elif kind < 0.93 and not depth:
                out.append(wrap("div", r.choice((None, noise())), body(1)))
            elif kind < 0.95:
                out.append(put("p", f'{words(3, 20, "")} <a href="/{noise()}">{words(1, 4, "")}</a> {words(2, 20)}', True))
            else:
                out.append(other())
        return "".join(out)

    def other() -> str:
        how = r.random()
        if how < 0.35 and spoken:
            n = r.randint(1, 3)
            return part("other", "".join(put(r.choice(("p", "h3", "span", "div")) if n > 1 else "p", f'{r.choice(SAYS["other"].split("|"))}{r.choice(("", ". " + words(1, 9)))}', False) for _ in range(n)).replace("<span>", "<div>").replace("</span>", "</div>"), True)
        if how < 0.7:
            title = put("h3", r.choice(SAYS["other"].split("|")) if spoken else words(1, 4, ""), False) if r.random() < 0.6 else ""
            return part("other", title + links(1, 7, None), True)
        if how < 0.8:
            labels.append(False)
            return f"<form>{words(1, 6, '')}<input name=q></form>"
        labels.append(False)
        return part("other", words(1, 25), False)

    def comments() -> str:
        title = put("h3", r.choice(SAYS["comments"].split("|")) if spoken else words(1, 3, ""), False) if r.random() < 0.7 else ""
        rows = []
        for _ in range(r.randint(1, 6)):
            who = put("div", f'{words(1, 2, "")} {r.choice(("says", "wrote", ""))}', False) if r.random() < 0.5 else ""
            rows.append(r.choice(("<div>{}</div>", "<li>{}</li>", "{}")).format(who + put("p", (r.choice(SAYS["comments"].split("|")) + ". " if spoken and r.random() < 0.3 else "") + words(1, 50), False)))
        return part("comments", title + "".join(rows), bool(title) and spoken)

    def foot() -> str:
        if r.random() < 0.6:
            labels.append(False)
            return part("foot", f'{r.choice(SAYS["foot"].split("|")) if spoken else "&copy;"} {words(1, 20)}', spoken)
        return part("foot", links(1, 6, "foot"), True)

    def head() -> str:
        if r.random() < 0.5:
            labels.append(False)
            return part("head", f'{r.choice(SAYS["head"].split("|")) if spoken else ""} {words(1, 8, "")}', False)
        return part("head", links(1, 6, "menu"), True)

    def whole() -> str:
        """The article in its element: a telling one, a bare one, a meaningless name, or none."""
        how, inner = r.random(), body()
        if how < 0.3:
            return wrap(r.choice(("article", "article", "main")), r.choice((None, None, name_of("main"))), inner)
        if how < 0.6:
            return wrap(r.choice(("div", "section")), name_of("main"), inner)
        if how < 0.9:
            return wrap("div", r.choice((None, noise(), f"css-{noise()}")), wrap("div", noise(), inner) if r.random() < 0.4 else inner)
        return inner

    out = ["<!DOCTYPE html><html><head>"]
    if r.random() < 0.9:
        out.append(put("title", words(1, 10, ""), False))
    out.append("<style>p{margin:0}</style></head><body>")
    if r.random() < 0.18:  # a page laid out as a table
        if r.random() < 0.7:
            out.append(f"<table><tr><td>{head()}</td></tr></table>")
        cells = [f"<td>{links(2, 9, 'menu')}</td>", f"<td>{body()}</td>"]
        if r.random() < 0.5:
            cells.append(f"<td>{other()}</td>")
        out.append(f"<table><tr>{''.join(cells)}</tr></table>")
    else:
        if r.random() < 0.4:
            out.append(head())
        if r.random() < 0.8:
            out.append(part("menu", links(1, 9, "menu"), True))
        out += [other() for _ in range(r.choice((0, 1, 1, 2)))]
        out.append(whole())
    if r.random() < 0.35:
        out.append(comments())
    out += [other() for _ in range(r.choice((0, 0, 1, 2)))]
    if r.random() < 0.85:
        out.append(foot())
    return "".join(out) + "</body></html>", labels


@functools.lru_cache(1)
def trained(n: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """The model; the same weights each time."""
    r = random.Random(4)
    drawn = []
    while len(drawn) < n:
        page, labels = training_page(r)
        if cut_up := blocks(page):
            if len(cut_up) == len(labels):  # not where drawn parts ran together
                drawn.append((features([cut_up])[0], np.array(labels, np.float32)))
    model = Labeller()
    model.fit(drawn, epochs)
    return model


def extract(pages: DataFrame, model: Labeller | None = None, between: str = "\n") -> DataFrame:
    """``pages`` (which needs html) with text: the main text's blocks in page order, joined by ``between``.

    A null or empty html, or one without main text, gives an empty text. Pages are independent, so repeated rows give
    repeated results; other columns stay, but a column text is replaced.
    """
    source = pages.select(*(c for c in pages.columns if c != "text"))
    sent = pages.sparkSession.sparkContext.broadcast((model or trained()).p)

    def run(batches):
        model = Labeller()
        model.p = sent.value
        for part in slices(batches, "html", most_rows=1024):
            cut_up = [blocks(x or "") for x in part.column("html").to_pylist()]
            texts = [between.join(b.text for b, main in zip(page, labels) if main) for page, labels in zip(cut_up, model.label(cut_up))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return source.mapInArrow(run, with_fields(source.schema, {"text": "string"}))
