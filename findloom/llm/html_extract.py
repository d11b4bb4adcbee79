"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags. Each block is read as its tag path (hashed tags,
parent-child pairs, class and id words), its hashed words, and a few figures (length, link share, place). A numpy
bidirectional LSTM reads the whole sequence and labels every block main text or not, so that a block is judged in the
context of the document. Main blocks are joined in page order.

The labeller is trained here, on pages that `synthetic_page` makes: many layouts, names and languages' worth of words,
with menus, headers, footers, sidebars, notices, adverts, forms and comments around and inside articles. Training is
seeded and takes a minute; the weights (under 1 MB whatever the corpus) are kept in the shared folder under a name made of the
code that trains them, read by every later session, and shipped with the tasks.

A page is scanned in one pass whose time is linear in its length, however its tags and quotes are broken. Of very deep
nesting a block's path keeps the OUTER outermost and INNER innermost elements.

Defined cases: a null or empty html, and one without main text, gives an empty text; scripts, styles, templates and
comments never are blocks; what stands outside of all elements is main text where a page has nothing else; unclosed and stray tags are tolerated (a tag whose quotes do not close ends at its first ">"); equal pages get equal texts; nothing is cut off,
however long; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import io
import random
import re
import uuid
import zlib
from collections import Counter
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from findloom.llm import words as W
from findloom.llm.common import shared_dir

#: HTML elements by how they cut text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg canvas math textarea select".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

PATH_SLOTS, WORD_SLOTS, PATH_DIM, WORD_DIM, HIDDEN, FIGURES = 4096, 2048, 16, 6, 16, 8


OUTER, INNER = 8, 24


class Tags:
    """Finds the tags of a page one after another; everything that is looked for from a place on is looked for once."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.final = {q: page.rfind(q) for q in "\"'"}
        self.hopeless: set[int] = set()  # places outside quotes from which no tag ends outside quotes

    def end(self, at: int) -> int:
        """The ">" that ends the tag whose attributes begin at `at`, or -1."""
        page, passed, p = self.page, [], at
        while p <= self.last and p not in self.hopeless:
            passed.append(p)
            found = _SPECIAL.search(page, p)
            if found is None:
                break
            p = found.start()
            if page[p] == ">":
                return p
            if p == self.final[page[p]]:
                break
            p = page.find(page[p], p + 1) + 1
        self.hopeless.update(passed)
        return page.find(">", at) if at <= self.last else -1

    def following(self, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, name with a leading slash of end tags, attributes) of the next tag; the name of comments is "!--", of other markup "!"."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0 or start > self.last:
                return None
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                return start, len(page) if close < 0 else close + 3, "!--", ""
            if page[start + 1 : start + 2] in ("!", "?"):
                return start, page.find(">", start) + 1, "!", ""
            m = _NAME.match(page, start + 1)
            if m:
                close = self.end(m.end())
                if close >= 0:
                    return start, close + 1, m[0].lower(), page[m.end() : close]
            at = start + 1


class Block:
    __slots__ = ("path", "parts", "linked")

    def __init__(self, path: tuple):
        self.path, self.parts, self.linked = path, [], 0


def _tokens(name: str, attrs: str) -> tuple[str, ...]:
    found = [f"t:{name}"]
    for m in _NAMES.finditer(attrs) if attrs else ():
        found += [f"c:{p.lower()}" for p in _PIECES.findall(m[1] or m[2] or m[3] or "")]
    if attrs and _HIDDEN.search(attrs):
        found.append("hidden")
    return tuple(found)


def blocks_of(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of it in links) of each leaf block; path is a tuple of each open element's tokens."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    opened: Counter[str] = Counter()
    current: Block | None = None
    links = 0
    at, n = 0, len(page)

    def raw_end(name: str, at: int) -> int:
        """Where the raw element ends: found ends lie behind, a name without one has swallowed the page."""
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at) if at <= tags.last else None
        return m.end() if m else n

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if piece.isspace():
                return
            shown = stack if len(stack) <= OUTER + INNER else [*stack[:OUTER], *stack[-INNER:]]
            current = Block(tuple(t for _, t in shown))
            out.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(piece)

    def pop_to(k: int) -> None:
        nonlocal links
        for name, _ in stack[k:]:
            links -= name == "a"
            opened[name] -= 1
        del stack[k:]

    def is_open(names) -> bool:
        return any(opened[n] for n in names)

    tags = Tags(page)
    while at < n:
        m = tags.following(at)
        if not m:
            # What begins like a comment and never ends is none of the text.
            rest = page.find("<!--", at)
            text(page[at : rest if rest >= 0 else n])
            break
        start, end, name, attrs = m
        text(page[at:start])
        at = end
        if name[0] == "!":
            continue
        closing, name = name[0] == "/", name.lstrip("/")
        block = name not in INLINE and name not in RAW
        if block:
            current = None
        elif name == "br":
            text(" ")
        if closing:
            if not is_open(HEADINGS if name in HEADINGS else (name,)):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name or (name in HEADINGS and stack[k][0] in HEADINGS):
                    pop_to(k)
                    break
                if not block and stack[k][0] not in INLINE:
                    break
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                at = raw_end(name, at)
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif name in SIBLINGS and is_open(SIBLINGS[name]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SIBLINGS[name]:
                    pop_to(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table"):
                    break
        if name not in VOID and not attrs.endswith("/"):
            stack.append((name, _tokens(name, attrs)))
            opened[name] += 1
            links += name == "a"
    found = []
    for b in out:
        joined = "".join(b.parts)
        clean = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
        if clean:
            found.append((b.path, clean, b.linked / max(1, len(joined))))
    return found


@lru_cache(maxsize=1 << 16)
def path_slots(path: tuple) -> tuple[int, ...]:
    """Hashed features of a tag path."""
    names = [tokens[0] for tokens in path]
    features = {t for tokens in path for t in tokens} | {f"{a}>{b}" for a, b in zip(names, names[1:])}
    features |= {f"leaf:{t}" for tokens in path[-1:] for t in tokens} | {f"under:{t}" for tokens in path[-2:-1] for t in tokens}
    features |= {f"{tokens[0]}.{c}" for tokens in path for c in tokens[1:]}
    return tuple(sorted({zlib.crc32(f.encode()) % PATH_SLOTS for f in features})) or (0,)


class Batch:
    """The blocks of several pages as padded sequences (time, page)."""

    def __init__(self, pages: list[list[tuple[tuple, str, float]]]):
        self.lengths = np.array([len(p) for p in pages])
        flat = [b for p in pages for b in p]
        T, B = int(self.lengths.max(initial=0)), len(pages)
        self.mask = (np.arange(T)[:, None] < self.lengths[None, :]).astype(np.float32)
        page = np.repeat(np.arange(B), self.lengths)
        time = np.concatenate([np.arange(k) for k in self.lengths]) if len(flat) else np.zeros(0, np.int64)
        self.at = (time.astype(np.int64), page)
        slots = [path_slots(p) for p, _, _ in flat]
        self.path_ids = np.fromiter((s for own in slots for s in own), np.int64)
        self.path_n = np.array([len(own) for own in slots], np.int64)
        hashes, bounds = [], [0]
        for _, data, offsets in W.chunks(pa.array([t for _, t, _ in flat], pa.string())):
            h, b = W.word_hashes(data, offsets)
            hashes.append((h >> np.uint64(53)).astype(np.int64))
            bounds += (b[1:] + bounds[-1]).tolist()
        self.word_ids = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        self.word_n = np.maximum(np.diff(bounds), 1)
        chars = np.array([len(t) for _, t, _ in flat], np.float32)
        linked = np.array([k for *_, k in flat], np.float32)
        ends = np.array([t[-1] in ".!?:;" for _, t, _ in flat], np.float32)
        stops = np.array([sum(map(t.count, ".,")) / len(t) for _, t, _ in flat], np.float32)
        long = np.minimum(self.word_n, 60) / 60
        place = time / np.maximum(1, self.lengths[page] - 1)
        self.figures = np.stack([np.log1p(chars) / 6, linked, ends, 10 * stops, long, place, time == 0, np.ones(len(flat))], axis=1).astype(np.float32)


def _bag(table: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    start = np.concatenate(([0], np.cumsum(n)))[:-1]
    return np.add.reduceat(table[ids], start, axis=0) / n[:, None] if len(n) else np.zeros((0, table.shape[1]), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embedding bags, a bidirectional LSTM and a logistic output, in numpy, with its own gradients."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        D = PATH_DIM + WORD_DIM + FIGURES
        scale = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"path": (0.3 * r.standard_normal((PATH_SLOTS, PATH_DIM))).astype(np.float32), "word": (0.05 * r.standard_normal((WORD_SLOTS, WORD_DIM))).astype(np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": scale(D, 4 * HIDDEN), f"h{way}": scale(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
        self.p |= {"out": scale(2 * HIDDEN + D, 1), "bias": np.zeros(1, np.float32)}

    def _inputs(self, b: Batch) -> np.ndarray:
        x = np.zeros((*b.mask.shape, PATH_DIM + WORD_DIM + FIGURES), np.float32)
        x[b.at] = np.concatenate([_bag(self.p["path"], b.path_ids, b.path_n) * 2, _bag(self.p["word"], b.word_ids, b.word_n), b.figures], axis=1)
        return x

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = False):
        T, B, _ = x.shape
        gates = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        h, c = np.zeros((B, HIDDEN), np.float32), np.zeros((B, HIDDEN), np.float32)
        hs, steps = np.zeros((T, B, HIDDEN), np.float32), []
        for t in range(T) if way == "f" else range(T - 1, -1, -1):
            a = gates[t] + h @ self.p[f"h{way}"]
            i, f, o = _sigmoid(a[:, :HIDDEN]), _sigmoid(a[:, HIDDEN : 2 * HIDDEN] + 1), _sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            before, c = c, m * (f * c + i * g) + (1 - m) * c
            held, h = h, m * o * np.tanh(c) + (1 - m) * h
            hs[t] = h
            if keep:
                steps.append((t, i, f, o, g, before, c, held))
        return hs, steps

    def scores(self, b: Batch) -> np.ndarray:
        """Probability of main text for each block, pages one after another."""
        if not len(b.figures):
            return np.zeros(0)
        x = self._inputs(b)
        both = np.concatenate([self._run(x, b.mask, "f")[0], self._run(x, b.mask, "b")[0], x], axis=2)
        return _sigmoid((both @ self.p["out"])[..., 0] + self.p["bias"])[b.at]

    def gradients(self, b: Batch, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, self._inputs(b)
        runs = {way: self._run(x, b.mask, way, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0], x], axis=2)
        y = _sigmoid((both @ p["out"])[..., 0] + p["bias"])
        target = np.zeros_like(y)
        target[b.at] = labels
        err = ((y - target) * b.mask / len(labels))[..., None]
        grads = {"out": np.einsum("tbd,tbo->do", both, err), "bias": err.sum(axis=(0, 1))}
        back = err @ p["out"].T
        dx = back[..., 2 * HIDDEN :].copy()
        for way, dh_all in (("f", back[..., :HIDDEN]), ("b", back[..., HIDDEN : 2 * HIDDEN])):
            wh, wx = p[f"h{way}"], p[f"x{way}"]
            gh, ga = np.zeros_like(wh), np.zeros((*b.mask.shape, 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((b.mask.shape[1], HIDDEN), np.float32)
            for t, i, f, o, g, before, c, held in reversed(runs[way][1]):
                m = b.mask[t][:, None]
                dh = dh + dh_all[t]
                tc = np.tanh(c)
                dcm = m * (dc + dh * o * (1 - tc * tc))
                da = m * np.concatenate([dcm * g * i * (1 - i), dcm * before * f * (1 - f), dh * tc * o * (1 - o), dcm * i * (1 - g * g)], axis=1)
                ga[t] = da
                gh += held.T @ da
                dh = da @ wh.T + (1 - m) * dh
                dc = dcm * f + (1 - m) * dc
            grads |= {f"h{way}": gh, f"b{way}": ga.sum(axis=(0, 1)), f"x{way}": np.einsum("tbd,tbg->dg", x, ga)}
            dx += ga @ wx.T
        own = dx[b.at]
        for name, ids, n, part in (("path", b.path_ids, b.path_n, 2 * own[:, :PATH_DIM]), ("word", b.word_ids, b.word_n, own[:, PATH_DIM : PATH_DIM + WORD_DIM])):
            table = np.zeros_like(p[name])
            # A block without words has one place counted for it and no id.
            counts = n if len(ids) == n.sum() else np.bincount(np.repeat(np.arange(len(n)), n)[: len(ids)], minlength=len(n))
            np.add.at(table, ids, np.repeat(part / n[:, None], counts, axis=0))
            grads[name] = table
        return grads

    def train(self, pages: list[tuple[list, list[int]]], epochs: int = 6, size: int = 32, rate: float = 0.01, seed: int = 2) -> None:
        r = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(pages) // size)
        for _ in range(epochs):
            r.shuffle(pages)
            for at in range(0, len(pages), size):
                part = pages[at : at + size]
                grads = self.gradients(Batch([b for b, _ in part]), np.array([y for _, ys in part for y in ys], np.float32))
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


#: Names that layouts use, for made pages.
MAIN_NAMES = "article content post entry story main body text page article-body post-content entry-content story-body main-content articleBody page-content blog-post node prose".split()
SIDE_NAMES = {
    "nav": "nav menu navbar main-menu site-nav navigation breadcrumb breadcrumbs pagination pager toc skip-links top-links tabs".split(),
    "header": "header site-header masthead topbar top-bar logo branding page-header".split(),
    "footer": "footer site-footer colophon copyright bottom legal footer-links".split(),
    "aside": "sidebar side widget aside rail right-col related related-posts recommended trending most-read more-stories teaser tags tag-cloud author-box".split(),
    "notice": "cookie cookie-banner consent notice alert banner gdpr privacy-notice popup modal overlay message announcement warning".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot adsbygoogle banner-ad commercial".split(),
    "form": "form search login signup newsletter subscribe contact-form search-box register".split(),
    "comments": "comments comment reader-comments comment-list respond reply disqus discussion responses feedback user-comments".split(),
    "share": "share social social-links share-buttons follow-us".split(),
}
#: What menus, footers and headings of side blocks say, for blocks that no name tells.
SIDE_WORDS = {
    "menu": "Home News Sport About Contact Login Register Search Blog Shop Help FAQ Services Products Team Jobs Press Archive Start Impressum Kontakt Datenschutz Accueil Actualités Contactez-nous Inicio Noticias Deportes Contacto Politics Business Culture Weather Video Menu".split(),
    "footer": ["Copyright 2021", "Copyright 2019 {}", "\u00a9 2023 {}", "&copy; 2020 {}", "(c) 2018 {}", "All rights reserved", "All rights reserved.", "Terms of use", "Privacy policy", "Powered by {}", "Imprint", "Alle Rechte vorbehalten", "Tous droits r\u00e9serv\u00e9s", "Todos los derechos reservados", "Contact us | Terms | Privacy", "Last updated 2022"],
    "notice": ["We use cookies to improve {}.", "This site uses cookies. {}", "By continuing you accept our cookie policy.", "Accept all cookies", "Wir verwenden Cookies. {}", "Ce site utilise des cookies.", "Please enable JavaScript.", "Subscribe to our newsletter", "Sign up for our newsletter {}"],
    "advert": ["Advertisement", "Sponsored", "Sponsored content: {}", "Buy now! {}", "Anzeige", "Publicit\u00e9", "Special offer: {} only today!", "Save 50% on {}!"],
    "aside": ["Related articles", "Most read", "You may also like", "Popular posts", "See also: {}", "Share this", "Tags: {}", "Recent posts", "Read more: {}", "Follow us on Twitter"],
    "comments": ["Comments", "3 Comments", "Leave a reply", "Leave a comment", "Kommentare", "Commentaires", "Comentarios", "Reply"],
}
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve al ch ung ich sch eau ment que tion los ado ción ente ü é ö ñ".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, low: int, high: int) -> str:
    text = " ".join(_word(r) for _ in range(r.randint(low, high)))
    style = r.random()
    if style < 0.06:
        text = " ".join(w + r.choice(["***", "%%%", "$$$", "&amp;&amp;&amp;", "###"]) for w in text.split())
    elif style < 0.1:
        text = " ".join(w.upper() + "!!" for w in text.split())
    elif style < 0.13:
        text = text.replace(" ", " | ")
    elif style < 0.14:
        text += f" {_word(r)}" * r.randint(5, 60)
    return text


def _sentence(r: random.Random, low: int = 3, high: int = 60) -> str:
    return _words(r, low, high).capitalize() + r.choice([".", ".", ".", "?", "!", ""])


def _attrs(r: random.Random, names: list[str], chance: float) -> str:
    if r.random() > chance:
        return ""
    name = r.choice(names)
    return f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", "", f" {_word(r)}", f"-{r.randint(1, 9)}"])}"'


def synthetic_page(r: random.Random) -> str:
    """A made page; main text blocks carry the mark \\x02 before their text."""

    def side(kind: str, named: bool = False) -> str:
        tags = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "p", "section", "aside"], "advert": ["div", "aside", "p", "ins", "section"], "form": ["form"], "comments": ["section", "div", "ol", "ul", "aside"], "share": ["div", "ul", "p"]}[kind]
        tag = r.choice(tags)
        telling = tag in ("nav", "footer", "aside", "form", "header")
        if not telling and not named and r.random() < 0.25:
            return unnamed(kind)
        head = f"<{tag}{_attrs(r, SIDE_NAMES[kind], 0.6 if telling else 1.0)}>"
        links = lambda n: "".join(f'<li><a href="/{_word(r)}">{_words(r, 1, 4)}</a></li>' for _ in range(n))
        title = f"<h{r.randint(2, 4)}>{_words(r, 1, 4)}</h{0}>".replace("h0", "h3") if r.random() < 0.5 else ""
        if kind == "nav":
            inner = links(r.randint(2, 9)) if tag == "ul" else f"<ul>{links(r.randint(2, 9))}</ul>" if r.random() < 0.7 else " ".join(f'<a href="#">{_words(r, 1, 3)}</a>' for _ in range(r.randint(2, 8)))
        elif kind == "header":
            inner = f'{r.choice(["<h1>{}</h1>", "<a href=/>{}</a>", "<div>{}</div>", "<p>{}</p>"]).format(_words(r, 1, 6))}' + (side("nav") if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice([f"&copy; {_word(r)} &middot; {_sentence(r, 2, 12)}", f"<p>{_sentence(r, 3, 25)}</p>", f"<ul>{links(r.randint(2, 6))}</ul><p>&copy; 2024 {_words(r, 1, 4)}</p>", f"<p>&copy; {_words(r, 1, 3)}</p><p>{_sentence(r, 3, 20)}</p>"])
        elif kind == "aside":
            inner = title + r.choice([f"<ul>{links(r.randint(2, 8))}</ul>", f"<p>{_sentence(r, 3, 40)}</p>", "".join(f'<p><a href="#">{_words(r, 3, 10)}</a></p>' for _ in range(r.randint(1, 5))), f"<p>{_sentence(r)}</p><p>{_sentence(r)}</p>"])
        elif kind == "notice":
            inner = r.choice([_sentence(r, 4, 40), _sentence(r, 4, 30) + f' <a href="#">{_words(r, 1, 3)}</a>'] + ([] if tag == "p" else [f"<p>{_sentence(r, 4, 40)}</p><button>{_words(r, 1, 2)}</button>"]))
        elif kind == "advert":
            inner = r.choice([_sentence(r, 3, 20), _sentence(r, 3, 20) + f' <a href="#">{_words(r, 1, 4)}</a>'] + ([] if tag == "p" else [f"<p>{_sentence(r, 3, 30)}</p>", f'<a href="#"><img src="x.png">{_words(r, 1, 6)}</a>', f"<h3>{_words(r, 1, 5)}</h3><p>{_sentence(r, 3, 25)}</p>"]))
        elif kind == "form":
            inner = f'<label>{_words(r, 1, 3)}</label><input name="q">' + r.choice(["", f"<p>{_sentence(r, 3, 20)}</p>"]) + f"<button>{_words(r, 1, 2)}</button>"
        elif kind == "comments":
            one = lambda: r.choice(["<p>{}</p>", '<div class="comment"><p>{}</p></div>', '<div class="comment"><b>{}</b><p>{}</p></div>', '<article class="comment"><p>{}</p></article>', '<div class="comment-body">{}</div>']).replace("{}", "%s")
            made = []
            for _ in range(r.randint(1, 6)):
                form = one()
                made.append(form % tuple(_sentence(r, 2, 40) for _ in range(form.count("%s"))))
            inner = "".join(f"<li>{m}</li>" for m in made) if tag in ("ol", "ul") else title + "".join(made)
        else:
            inner = " ".join(f'<a href="#">{_words(r, 1, 2)}</a>' for _ in range(r.randint(2, 5)))
            inner = f"<li>{inner}</li>" if tag == "ul" else inner
        return f"{head}{inner}</{tag}>"

    def unnamed(kind: str) -> str:
        """A side block that no tag or name tells: tables and plain divs, known by links, words and place."""
        said = lambda k: r.choice(SIDE_WORDS[k]).format(_words(r, 1, 4).capitalize())
        attrs = _attrs(r, ["top", "bot", "bottom", "left", "col1", "c2", "box", "row", "m1", "x", _word(r), _word(r)], 0.6)
        if kind in ("nav", "header", "share"):
            names = [r.choice(SIDE_WORDS["menu"]) if r.random() < 0.8 else _words(r, 1, 2).capitalize() for _ in range(r.randint(2, 8))]
            form, linked = r.random(), r.random() < 0.7
            items = [f'<a href="/{_word(r)}">{x}</a>' if linked else x for x in names]
            if form < 0.4:
                rows = "".join(f"<td>{x}</td>" for x in items)
                return f"<table{attrs}><tr>{rows}</tr></table>" if r.random() < 0.6 else f"<table{attrs}>{''.join(f'<tr><td>{x}</td></tr>' for x in items)}</table>"
            if form < 0.7 and linked:
                return f"<div{attrs}>{r.choice([' | ', ' ', ' &middot; ', ' - ']).join(items)}</div>"
            return f"<div{attrs}>" + "".join(f"<div>{x}</div>" for x in items) + "</div>"
        if kind == "comments":
            made = "".join(f"<div><b>{_word(r).capitalize()}</b> <p>{_sentence(r, 3, 30)}</p></div>" for _ in range(r.randint(1, 4)))
            return f"<div{attrs}><h{(h := r.randint(2, 4))}>{said('comments')}</h{h}>{made}</div>"
        if kind == "aside":
            inner = "".join(f'<div><a href="/{_word(r)}">{_words(r, 2, 8)}</a></div>' for _ in range(r.randint(2, 6)))
            return f"<div{attrs}><div>{said('aside')}</div>{inner}</div>"
        says = said({"form": "notice"}.get(kind, kind))
        inner = says if r.random() < 0.6 else f"<{(t := r.choice(['p', 'div', 'span', 'small', 'center']))}>{says}</{t}>"
        return f"<table{attrs}><tr><td>{inner}</td></tr></table>" if r.random() < 0.2 else f"<div{attrs}>{inner}</div>"

    def paragraph() -> str:
        text = _sentence(r, 1 if r.random() < 0.1 else 4, r.choice([12, 40, 120]))
        if r.random() < 0.15:
            parts = text.split(" ")
            k = r.randrange(len(parts))
            parts[k] = r.choice(["<a href='#'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<strong>{}</strong>", "<span>{}</span>"]).format(parts[k])
            text = " ".join(parts)
        if r.random() < 0.1:
            return f"<p><b>\x02{text}<br>"
        return f"<p>\x02{text}</p>"

    def article() -> str:
        body = [f"<h1>\x02{_words(r, 2, 12)}</h1>"] if r.random() < 0.9 else []
        if body and r.random() < 0.15:
            body = [f"<header>{body[0]}</header>"]
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.7:
                body.append(paragraph())
            elif k < 0.73:
                body.append(f"<div{_attrs(r, [_word(r) for _ in range(4)], 0.5)}>{paragraph()}{paragraph()}</div>")
            elif k < 0.75:
                body.append(f"<section{_attrs(r, MAIN_NAMES, 0.2)}><h2>\x02{_words(r, 1, 8)}</h2>{paragraph()}</section>")
            elif k < 0.77:
                body.append(f'<figure><img src="x.png"><figcaption>\x02{_sentence(r, 2, 20)}</figcaption></figure>')
            elif k < 0.78:
                body.append(f"<div>\x02{_sentence(r, 4, 60)}</div>")
            elif k < 0.86:
                body.append(f"<h{r.randint(2, 4)}>\x02{_words(r, 1, 8)}</h3>")
            elif k < 0.9:
                body.append("<ul>" + "".join(f"<li>\x02{_sentence(r, 1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.93:
                body.append(f"<blockquote>\x02{_sentence(r)}</blockquote>")
            elif k < 0.94:
                body.append(f"<pre>\x02{_sentence(r)}</pre>")
            elif k < 0.95:
                body.append("<table>" + "".join(f"<tr><td>\x02{_words(r, 1, 4)}</td><td>\x02{_words(r, 1, 4)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            else:
                body.append(side(r.choice(["advert", "notice", "share", "aside", "form"]), True))
        if r.random() < 0.25:
            body.append(side(r.choice(["comments", "share", "aside", "footer", "advert"]), True))
        return "".join(body)

    kind = r.random()
    inner = article()
    if kind < 0.45:
        inner = f"<article{_attrs(r, MAIN_NAMES, 0.3)}>{inner}</article>"
    elif kind < 0.6:
        inner = f"<main{_attrs(r, MAIN_NAMES, 0.3)}>{inner}</main>"
    elif kind < 0.9:
        inner = f"<div{_attrs(r, MAIN_NAMES, 0.9)}>{inner}</div>"
    elif kind < 0.95:
        inner = f"<section{_attrs(r, MAIN_NAMES, 0.8)}>{inner}</section>"
    if r.random() < 0.3:
        inner = f"<{(t := r.choice(['main', 'div', 'section']))}{_attrs(r, MAIN_NAMES + ['wrapper', 'container', 'row', 'col'], 0.7)}>{inner}{side('comments') if r.random() < 0.2 else ''}</{t}>"
    before = "".join(side(k) for k in ("notice", "header", "nav", "advert", "form", "share") if r.random() < (0.6 if k in ("header", "nav") else 0.25))
    after = "".join(side(k) for k in ("share", "comments", "aside", "advert", "form", "notice", "footer") if r.random() < (0.75 if k == "footer" else 0.3))
    if r.random() < 0.2:
        before += side("aside")
    if r.random() < 0.12:
        # A layout of tables: the menu on the left, the text on the right.
        return f"<html><body>{before if r.random() < 0.5 else unnamed('nav')}<table><tr><td>{unnamed('nav')}</td><td>{inner}</td></tr></table>{unnamed('footer')}</body></html>"
    page = f"{before}{inner}{after}"
    if r.random() < 0.3:
        page = f'<div class="{r.choice(["wrapper", "container", "page", "site", "layout"])}">{page}</div>'
    return f"<html><head><title>{_words(r, 2, 12)}</title></head><body>{page}</body></html>"


def labelled(page: str) -> tuple[list, list[int]]:
    found = blocks_of(page)
    return [(p, t.replace("\x02", ""), k) for p, t, k in found], [int("\x02" in t) for _, t, _ in found]


@cache
def labeller(pages: int = 3000, seed: int = 5) -> Labeller:
    """The trained labeller; the same at every call."""
    r = random.Random(seed)
    model = Labeller()
    model.train([x for x in (labelled(synthetic_page(r)) for _ in range(pages)) if x[1]])
    return model


def kept_labeller(spark: SparkSession) -> Labeller:
    """labeller() from the shared folder, trained and put there if this code's is not there yet."""
    code = b"".join(Path(f).read_bytes() for f in (__file__, W.__file__))
    store, root = pafs.FileSystem.from_uri(f"{shared_dir(spark)}/findloom-models")
    path = f"{root}/labeller-{hashlib.sha256(code).hexdigest()[:24]}.npz"
    if store.get_file_info(path).type == pafs.FileType.File:
        model = Labeller()
        with store.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as held:
            model.p = dict(held)
        return model
    model, packed = labeller(), io.BytesIO()
    np.savez_compressed(packed, **model.p)
    store.create_dir(root, recursive=True)
    # Moved into place whole: two sessions that train at once leave the same weights.
    aside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside, compression=None) as out:
        out.write(packed.getvalue())
    store.move(aside, path)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page. Sequences of like length are run together."""
    cut = [blocks_of(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
    at = 0
    while at < len(order):
        # A run is bounded by its padded cells, so one huge page is a run of its own.
        end = at + 1
        while end < len(order) and end - at < 256 and len(cut[order[end]]) * (end - at + 1) <= 20_000:
            end += 1
        part = order[at:end]
        scores = model.scores(Batch([cut[k] for k in part]))
        first = 0
        for k in part:
            own = scores[first : first + len(cut[k])]
            first += len(cut[k])
            bare = not any(path for path, _, _ in cut[k])
            out[k] = "\n\n".join(t for (_, t, _), s in zip(cut[k], own) if bare or s > 0.5)
        at = end
    return out


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()
    model = kept_labeller(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
