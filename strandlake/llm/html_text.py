"""HTML extraction: a recurrent block labeller.

A page becomes a sequence of leaf blocks (text between block-level tags). A
bidirectional LSTM in numpy reads, for each block, a vector of its tag path, a vector of
hashed words and a few counts, and so labels every block as main text or not with the
whole document as context. It is fitted on synthetic pages whose layouts are known.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.textnum import Texts, slices
from strandlake.plans.session import ship_package

#: Elements that part blocks, that have no end, and whose content is not text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg select option".split())
OPAQUE = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Fixed value: a start tag on the left ends an open element on the right.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())

#: Fixed value: elements nested deeper share the place of the last one, as in browsers.
DEEPEST = 512

_VALUE = r"\"[^\">]*+\"|'[^'>]*+'|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s>]+"
#: One tag, comment or declaration. A quote opens a value only after an equals sign. Where a
#: quoted value holds the end of a tag and text follows its second quote at once, or where
#: there is no second quote, the first one is a plain character.
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)>|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*>|</>", re.S)
#: The same without regard to quotes.
_PLAIN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*>|</>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CLOSERS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in OPAQUE}
_BARE_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Any white space of Unicode other than single spaces, which may stay as they are.
_WHITE = re.compile(r"[^\S ]\s*| \s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags from the root, each with the words of its class, id and role
    linked: int  # characters inside links


class Open:
    """The stack of open elements. Every operation is constant in its depth, apart from what it pops."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[tuple[str, ...]] = [()]  # of each element, after the root's
        self.at: dict[str, list[int]] = {}  # places of each name
        self.blocks: list[int] = []  # places of block elements
        self.raw = self.anchors = 0

    def push(self, name: str, step: str) -> None:
        n = len(self.names)
        self.at.setdefault(name, []).append(n)
        if name in BLOCK:
            self.blocks.append(n)
        self.raw += name in RAW
        self.anchors += name == "a"
        self.names.append(name)
        self.paths.append((*self.paths[-1], step) if n < DEEPEST else self.paths[-1])

    def pop(self, n: int) -> None:
        for name in self.names[n:]:
            self.at[name].pop()
            self.raw -= name in RAW
            self.anchors -= name == "a"
        while self.blocks and self.blocks[-1] >= n:
            self.blocks.pop()
        del self.names[n:], self.paths[n + 1 :]

    def last(self, of: frozenset | set | tuple) -> int:
        """Place of the innermost element with one of these names, or -1."""
        return max((self.at[x][-1] for x in of if self.at.get(x)), default=-1)


def _step(name: str, attrs: str) -> str:
    """A tag with the words of its class, id and role."""
    step = name
    for a in _ATTR.finditer(attrs):
        key, value = a.group(1).lower(), (a.group(2) or "").strip("\"'").lower()
        if key in ("class", "id", "role", "itemprop"):
            step += " " + " ".join(w for w in _SPLIT.split(value) if w)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            step += " hidden"
    return step


def _tags(src: str) -> Iterator[tuple[int, int, str | None, str | None, str | None]]:
    """(start, end, slash, name, attributes) of each piece of markup; the receiver may send where to go on.

    Time is linear in the page, however it is malformed: a ``<`` after the last ``>`` is
    text, and once a quote has run to the end of the page quotes are no longer heeded.
    """
    at, last, markup = 0, src.rfind(">"), _MARKUP
    while True:
        p = src.find("<", at)
        if p < 0:
            return
        m = markup.match(src, p)
        if m is None and p < last and markup is _MARKUP and re.match("</?[a-zA-Z]", src[p : p + 3]):
            markup = _PLAIN
            m = markup.match(src, p)
        if m is None:
            at = p + 1
            if p > last and not src.startswith(("<!", "<?"), p):
                p = min((q for q in (src.find("<!", at), src.find("<?", at)) if q >= 0), default=-1)
                if p < 0:
                    return
                at = p
            continue
        go = yield p, m.end(), *m.groups()
        at = m.end() if go is None else go


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, forms' controls, comments and markup give none.

    A block's text has its character references decoded and each run of white space as
    one space; a line break inside a block is white space.
    """
    src = page or ""
    out: list[Block] = []
    stack = Open()
    parts: list[str] = []
    linked = 0
    home: tuple | None = None
    endless: set[str] = set()  # names that no end tag follows any more

    def flush() -> None:
        nonlocal linked, home
        if home is not None:
            text = parts[0] if len(parts) == 1 else "".join(parts)
            text = _WHITE.sub(" ", text).strip(" ")
            if text:
                out.append(Block(text, home, linked))
        parts.clear()
        linked, home = 0, None

    at, end = 0, len(src)
    tags = _tags(src)
    tag = next(tags, None)
    while at < end:
        stop = tag[0] if tag is not None else end
        if stop > at and not stack.raw:
            text = src[at:stop]
            if "&" in text:
                text = html.unescape(text)
            if home is None and not text.isspace():
                home = stack.paths[-1]
            parts.append(text)
            if stack.anchors:
                linked += len(text)
        if tag is None:
            break
        _, at, ended, name, attrs = tag
        go = None
        if name is not None:
            name = name.lower()
            if ended:
                found = stack.last((name,))
                # An end tag without its start is passed over, and an inline one does not close blocks around it.
                if found >= 0 and (name in BLOCK or not (stack.blocks and stack.blocks[-1] > found)):
                    if name in BLOCK:
                        flush()
                    stack.pop(found)
            else:
                if name in BLOCK:
                    if parts:
                        flush()
                    if name in CLOSES_P:
                        p = stack.last(("p", "table", "td", "th", "button"))
                        if p >= 0 and stack.names[p] == "p":
                            stack.pop(p)
                    if name in IMPLIED:
                        p = stack.last(IMPLIED[name] | {"ul", "ol", "menu", "dl", "table", "select"})
                        if p >= 0 and stack.names[p] in IMPLIED[name]:
                            stack.pop(p)
                elif name == "br":
                    parts.append(" ")
                closed = attrs.endswith("/") and name not in BLOCK and not _BARE_SLASH.search(attrs)
                if name not in VOID and not closed:
                    close = _CLOSERS[name].search(src, at) if name in OPAQUE and name not in endless else None
                    if close is None and name in OPAQUE:
                        endless.add(name)
                    if close is not None or name not in OPAQUE or name in ("script", "style"):
                        stack.push(name, _step(name, attrs) if attrs else name)
                    if close is not None:  # what it holds is not markup
                        go = close.start()
                    elif name in ("script", "style"):
                        go = end
        if go is not None:
            at = go
            tag = None
            try:
                tag = tags.send(go)
            except StopIteration:
                pass
        else:
            tag = next(tags, None)
    flush()
    return out


# --- vectors ----------------------------------------------------------------------

PATH_DIM, WORD_DIM = 96, 24
#: Tags and parts of class names with a place of their own in the path vector; others are hashed.
NAMED = "article main section header footer nav aside form div p li ul ol td table h1 h2 h3 h4 blockquote pre figure figcaption a b dl dt dd".split()
HINTS = "nav menu sidebar side footer header banner ad ads advert sponsor promo cookie consent notice popup modal comment comments reply respond disqus share social related recommended newsletter subscribe signup form widget breadcrumb pagination tags meta byline author copyright legal content body text entry post story main article hidden".split()
_PLACE = {n: i for i, n in enumerate([*NAMED, *(f".{h}" for h in HINTS)])}
N_NAMED = len(_PLACE)
N_COUNTS = 10
DIM = N_NAMED + PATH_DIM + WORD_DIM + N_COUNTS


@lru_cache(maxsize=20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Tags and class words along a path, named ones at their place, all of them hashed with a sign."""
    v = np.zeros(N_NAMED + PATH_DIM)
    for depth, step in enumerate(path):
        tag, *words = step.split(" ")
        for w in [tag, *(f".{x}" for x in words)]:
            if w in _PLACE:
                v[_PLACE[w]] = 1 if w[0] != "." else 1.5
            for hint in HINTS if w[0] == "." and w not in _PLACE else ():
                if len(hint) > 4 and hint in w:
                    v[_PLACE[f".{hint}"]] = 1.5
            h = zlib.crc32(w.encode())
            near = 1.0 if depth >= len(path) - 2 else 0.5
            v[N_NAMED + h % PATH_DIM] += (1 if h >> 16 & 1 else -1) * near * 0.5
    return v


def vectors(found: list[Block]) -> np.ndarray:
    """One row per block of all pages of a batch; words of whole blocks are hashed."""
    n = len(found)
    x = np.zeros((n, DIM), np.float32)
    if not n:
        return x
    t = Texts([b.text for b in found])
    t.words()
    h = t.word_hashes(fold=True)
    count = np.maximum(np.diff(t.words_from), 1)
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(float) * 2 - 1
    bag = np.bincount(t.word_doc * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64), weights=sign, minlength=n * WORD_DIM).reshape(n, WORD_DIM)
    size = np.array([len(b.text) for b in found], float)
    x[:, : N_NAMED + PATH_DIM] = [path_vector(b.path) for b in found]
    at = N_NAMED + PATH_DIM
    x[:, at : at + WORD_DIM] = np.clip(bag / np.sqrt(count)[:, None] * 0.5, -1, 1)  # a word that repeats must not swamp the rest
    stops = np.array([b.text.count(".") + b.text.count("?") + b.text.count("!") for b in found])
    commas = np.array([b.text.count(",") for b in found])
    last = np.array([b.text[-1] in ".!?:;\"')" for b in found])
    x[:, -N_COUNTS:] = np.column_stack([np.log1p(size) / 6, np.log1p(count) / 5, np.array([b.linked for b in found]) / size, np.minimum(stops / count, 1), np.minimum(commas / count, 1), last, np.array([len(b.path) for b in found]) / 12, size < 40, count >= 25, np.array([b.text[0] in "©®" for b in found])])
    return x


# --- the network ------------------------------------------------------------------


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Weights of both directions: inputs (DIM, 4H), recurrent (H, 4H), bias; and the output layer."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    b: list[np.ndarray]
    wo: np.ndarray
    bo: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, *self.b, self.wo, self.bo]

    def _run(self, x: np.ndarray, mask: np.ndarray, d: int, keep: bool):
        """States (T, B, H) of one direction; ``x``: (T, B, DIM), padded at the end; padding leaves the state at 0."""
        steps, size, _ = x.shape
        hid = self.wh[d].shape[0]
        pre = x @ self.wx[d] + self.b[d]
        h, c = np.zeros((size, hid), np.float32), np.zeros((size, hid), np.float32)
        out = np.zeros((steps, size, hid), np.float32)
        tape = []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.wh[d]
            g = _sig(z[:, : 3 * hid])
            i, f, o = g[:, :hid], g[:, hid : 2 * hid], g[:, 2 * hid :]
            u = np.tanh(z[:, 3 * hid :])
            m = mask[t][:, None]
            before_h, before_c = h, c
            c = (f * c + i * u) * m
            tc = np.tanh(c)
            h = o * tc * m
            out[t] = h
            if keep:
                tape.append((t, i, f, o, u, tc, before_h, before_c, m))
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        a, _ = self._run(x, mask, 0, False)
        b, _ = self._run(x, mask, 1, False)
        return np.concatenate([a, b], -1) @ self.wo + self.bo

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        runs = [self._run(x, mask, d, True) for d in (0, 1)]
        hid = self.wh[0].shape[0]
        both = np.concatenate([runs[0][0], runs[1][0]], -1)
        z = both @ self.wo + self.bo
        n = mask.sum()
        dz = (_sig(z) - y) * mask / n
        loss = float(((np.logaddexp(0, z) - y * z) * mask).sum() / n)
        dz = dz.astype(np.float32)
        dwo, dbo = both.reshape(-1, 2 * hid).T @ dz.reshape(-1), np.array(dz.sum())
        dboth = dz[..., None] * self.wo
        gx, gh, gb = [], [], []
        flat = x.reshape(-1, x.shape[2])
        for d in (0, 1):
            dout = dboth[..., d * hid : (d + 1) * hid]
            das, befores = np.zeros((*mask.shape, 4 * hid), np.float32), np.zeros((*mask.shape, hid), np.float32)
            dh, dc = np.zeros((x.shape[1], hid), np.float32), np.zeros((x.shape[1], hid), np.float32)
            for t, i, f, o, u, tc, h0, c0, m in reversed(runs[d][1]):
                dh = (dh + dout[t]) * m
                dct = (dc + dh * o * (1 - tc**2)) * m
                da = np.concatenate([dct * u * i * (1 - i), dct * c0 * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - u**2)], 1)
                das[t], befores[t] = da, h0
                dh, dc = da @ self.wh[d].T, dct * f
            das = das.reshape(-1, 4 * hid)
            gx.append(flat.T @ das)
            gh.append(befores.reshape(-1, hid).T @ das)
            gb.append(das.sum(0))
        return loss, [*gx, *gh, *gb, dwo, dbo]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(r) for r in rows)
    x, mask = np.zeros((longest, len(rows), DIM), np.float32), np.zeros((longest, len(rows)), np.float32)
    for i, r in enumerate(rows):
        x[: len(r), i], mask[: len(r), i] = r, 1
    return x, mask


@lru_cache(maxsize=1)
def _words() -> list[str]:
    """A made-up vocabulary for synthetic pages."""
    rng = random.Random(0)
    return ["".join(rng.choices("aeioubcdfghlmnprstvéüñ", k=rng.randint(1, 9))) for _ in range(4000)]


def _page(rng: random.Random) -> list[tuple[Block, int]]:
    """Blocks of a synthetic page with their labels."""
    return [(b, int(b.text.startswith("yes"))) for b in blocks(synthetic_page(rng))]


def synthetic_page(rng: random.Random) -> str:
    """A page in one of many layouts; blocks of main text begin with the word ``yes``, which no vector sees alone."""
    num = lambda a, b: int(rng.random() * (b - a)) + a
    pick = lambda *a: a[num(0, len(a))]
    word = lambda: _words()[num(0, 4000)]

    def words(a: int, b: int) -> str:
        w = rng.choices(_words(), k=num(a, b))
        for i in range(num(1, 12), len(w), 12):
            w[i] += ","
        for i in range(num(6, 14), len(w), num(6, 14)):
            w[i] = w[i].rstrip(",") + "."
        s = " ".join(w)
        odd = num(0, 14)
        if odd == 3:
            return " ".join([pick(*w)] * num(a, b))
        s = s.upper() if odd == 0 else s.replace(" ", pick("%%% ", "*** ", "$$$ ", "!! ")) if odd == 1 else s.replace(" ", " | ") if odd == 2 else s
        return s + pick(".", ".", ".", "", "!")

    def cls(*names: str) -> str:
        return pick("", *(f' {pick("class", "class", "id")}="{pick("", "", "x-", "site-")}{n}"' for n in names))

    def links(n: int) -> str:
        return "".join(f"<li><a href='/{word()}'>{words(1, 4)}</a></li>" for _ in range(n))

    def box(tag: str, *names: str) -> str:
        named = f' {pick("class", "class", "id")}="{pick("", "", "x-", "site-", "js ")}{pick(*names)}"'
        return f"<{tag}{named}>{pick(words(2, 40), f'<p>{words(3, 50)}</p>', f'<h3>{words(1, 4)}</h3><p>{words(3, 40)}</p>', f'<ul>{links(num(2, 6))}</ul>')}</{tag}>"

    def para() -> str:
        inner = "yes " + pick(words(1, 6), words(5, 60), words(20, 160))
        kind = num(0, 18)
        if kind == 0:
            return f"<h{num(2, 5)}>{'yes ' + words(1, 9)}</h{num(2, 5)}>"
        if kind == 1:
            return f"<blockquote><p>{inner}</p></blockquote>"
        if kind == 2:
            return "<ul>" + "".join(f"<li>yes {words(2, 20)}</li>" for _ in range(num(2, 6))) + "</ul>"
        if kind == 3:
            return f"<p><b>{inner}<br><p>yes {words(5, 50)}</p>"
        if kind == 4:
            return f"<pre>{inner}</pre>"
        if kind == 5:
            return "<table>" + "".join(f"<tr><td>yes {words(1, 5)}</td><td>yes {words(1, 5)}</td></tr>" for _ in range(num(2, 5))) + "</table>"
        if kind == 6:
            return f"<p>{inner} <a href='/x'>{words(1, 4)}</a> {words(1, 10)}</p>"
        return pick(f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<div>{inner}</div>") if num(0, 3) else f"<p>{inner}</p>"

    def noise() -> str:
        return pick(
            lambda: box(pick("div", "aside", "section"), "ad", "ads", "advert", "ad-box", "sponsor", "promo"),
            lambda: box(pick("div", "aside", "section"), "sidebar", "side", "widget", "related", "recommended"),
            lambda: box(pick("div", "section"), "cookie", "cookie-notice", "consent", "notice", "banner", "popup", "modal"),
            lambda: box(pick("div", "section"), "newsletter", "subscribe", "signup", "share", "social"),
            lambda: f"<aside>{pick(words(2, 40), f'<p>{words(3, 50)}</p>', f'<ul>{links(num(2, 6))}</ul>')}</aside>",
            lambda: f"<form{cls('search', 'signup', 'login')}><label>{words(1, 4)}</label><input name='q'><button>{words(1, 3)}</button>{pick('', f'<p>{words(3, 20)}</p>')}</form>",
            lambda: f"<button{cls('share', 'subscribe', 'btn')}>{words(1, 3)}</button>",
            lambda: f"<nav{cls('menu', 'nav', 'breadcrumb', 'pagination')}>{pick(f'<ul>{links(num(2, 8))}</ul>', ' '.join(f'<a href=/{word()}>{words(1, 3)}</a>' for _ in range(num(2, 6))))}</nav>",
            lambda: f"<div class='{pick('menu', 'breadcrumb', 'tags', 'share', 'social')}'>{''.join(f'<a href=/{word()}>{words(1, 3)}</a> ' for _ in range(num(2, 6)))}</div>",
        )()

    def comments() -> str:
        tag = pick("div", "section", "ol", "aside")
        item = pick("div", "li", "article", "p")
        body = "".join(f"<{item} class='{pick('comment', 'reply', 'comment-body', 'c')}'>{pick('', f'<b>{word()}</b> ')}{pick(words(3, 50), f'<p>{words(3, 60)}</p>')}</{item}>" for _ in range(num(1, 6)))
        return f"<{tag} {pick('class', 'id')}='{pick('comments', 'comment-list', 'responses comments', 'disqus', 'reader-comments')}'>{pick('', f'<h2>{words(1, 3)}</h2>', f'<h3>{words(1, 3)}</h3>')}{body}</{tag}>"

    title = f"<h1>yes {words(1, 12)}</h1>"
    main = [pick(title, title, title, title, f"<header>{title}</header>")] if num(0, 6) else []
    for _ in range(pick(num(1, 4), num(3, 12), num(8, 30))):
        main.append(para())
        if num(0, 5) == 0:
            main.append(noise())
    body = "".join(main)
    wrap = num(0, 6)
    if wrap < 3:
        body = f"<article{cls('post', 'entry', 'story', 'content')}>{body}{comments() if num(0, 6) == 0 else ''}</article>"
    elif wrap == 3:
        body = f"<main{cls('content', 'main')}>{body}</main>"
    elif wrap == 4:
        body = f"<main><article>{body}</article></main>"
    else:
        body = f"<div {pick('class', 'id')}='{pick('content', 'post-content', 'entry', 'article-body', 'story', 'main-text', 'post')}'>{body}</div>"
    if num(0, 3) == 0:
        body = f"<div class='{pick('page', 'wrapper', 'container', 'layout', 'site')}'>{body}{noise()}</div>"
    head = pick(
        "",
        lambda: f"<header{cls('site', 'top', 'masthead')}>{pick(f'<h1>{words(1, 4)}</h1>', f'<p>{words(2, 8)}</p>', f'<a href=/>{words(1, 3)}</a>')}{pick('', f'<nav>{links(num(2, 6))}</nav>')}</header>",
        lambda: f"<nav{cls('menu', 'nav')}><ul>{links(num(3, 9))}</ul></nav>",
        lambda: f"<div class='header'>{words(1, 6)}</div>",
    )
    foot = pick(
        "",
        lambda: f"<footer{cls('site', 'footer')}>{pick('&copy; ', '', '')}{words(2, 30)}</footer>",
        lambda: f"<footer><p>{words(2, 20)}</p><ul>{links(num(2, 6))}</ul></footer>",
        lambda: f"<div {pick('class', 'id')}='footer'>{pick('&copy; ', '')}{words(2, 20)}</div>",
    )
    made = lambda p: p() if callable(p) else p
    return "<html><head><title>t</title></head><body>" + made(head) + "".join(noise() for _ in range(num(0, 3))) + body + (comments() if num(0, 3) == 0 else "") + "".join(noise() for _ in range(num(0, 3))) + made(foot) + "</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = 800, hidden: int = 12, rounds: int = 8, seed: int = 4) -> Network:
    """The network fitted on ``pages`` synthetic pages with Adam."""
    pick, rng = random.Random(seed), np.random.default_rng(seed)
    made = [_page(pick) for _ in range(pages)]
    made = [p for p in made if p]
    for p in made:  # the mark that carries the label is not for the network
        for b, y in p:
            if y:
                b.text = b.text[4:] or "x"
    flat = vectors([b for p in made for b, _ in p])
    at = np.cumsum([0, *(len(p) for p in made)])
    rows = [flat[i:j] for i, j in zip(at, at[1:], strict=False)]
    labels = [np.array([y for _, y in p], np.float32) for p in made]
    order = np.argsort([len(r) for r in rows], kind="stable")
    groups = [order[i : i + 24] for i in range(0, len(order), 24)]
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    bias = lambda: np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
    net = Network([init(DIM, 4 * hidden) for _ in "fb"], [init(hidden, 4 * hidden) for _ in "fb"], [bias(), bias()], init(2 * hidden), np.zeros((), np.float32))
    theta = net.params()
    m, v, step = [np.zeros(t.shape) for t in theta], [np.zeros(t.shape) for t in theta], 0
    total = rounds * len(groups)
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            x, mask = padded([rows[i] for i in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(groups[g]):
                y[: len(labels[i]), k] = labels[i]
            _, grads = net.gradients(x, mask, y)
            norm = np.sqrt(sum(float((q**2).sum()) for q in grads))
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            for k, q in enumerate(grads):
                q = q * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q**2
                theta[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            net.wx, net.wh, net.b, net.wo, net.bo = theta[0:2], theta[2:4], theta[4:6], theta[6], theta[7]
    return net


def label(pages: list[list[Block]], net: Network, padded_blocks: int = 8192) -> list[np.ndarray]:
    """Probability of main text for each block of each page; pages of like length run together."""
    out = [np.zeros(0)] * len(pages)
    order = [i for i in np.argsort([len(p) for p in pages], kind="stable").tolist() if pages[i]]
    while order:
        group = [order.pop()]
        longest = len(pages[group[0]])
        while order and (len(group) + 1) * longest <= padded_blocks:
            group.append(order.pop())
        flat = vectors([b for i in group for b in pages[i]])
        at = np.cumsum([0, *(len(pages[i]) for i in group)])
        x, mask = padded([flat[a:b] for a, b in zip(at, at[1:], strict=False)])
        p = _sig(net.logits(x, mask))
        for k, i in enumerate(group):
            out[i] = p[: len(pages[i]), k]
    return out


def main_text(pages: list[str | None], net: Network, cut: float = 0.5) -> list[tuple[str, int, int]]:
    """(text, blocks kept, blocks) of each page; kept blocks in page order, joined by an empty line."""
    found = [blocks(p) for p in pages]
    out = []
    for bs, p in zip(found, label(found, net), strict=True):
        kept = [b.text for b, q in zip(bs, p, strict=True) if q >= cut]
        out.append(("\n\n".join(kept), len(kept), len(bs)))
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, net: Network | None = None, cut: float = 0.5) -> DataFrame:
    """The columns ``keep`` (all but the html by default) with text, n_chars, n_kept, n_blocks.

    A null or empty page, or one without main text, gives an empty text. Whole pages are
    read, in time linear in their length, however long or malformed; blocks that repeat
    are all there. Kept columns
    with the name of an added one come back with ``src_`` before it. Rows that repeat
    are labelled each; an empty table gives an empty result.
    """
    ship_package(pages.sparkSession)
    net = net or trained()
    added = ["text", "n_chars", "n_kept", "n_blocks"]
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    safe = [f"src_{c}" if c in added else c for c in keep]
    d = pages.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(keep, safe, strict=True)], F.col(f"`{html_col}`").cast("string").alias("__html"))
    n = len(safe)
    schema = T.StructType([*d.schema.fields[:-1], T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in added[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, n, 1 << 20):
            got = main_text(b.column(n).to_pylist(), net, cut)
            text, kept, total = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(kept, pa.int64()), pa.array(total, pa.int64())], names=[*safe, *added])

    return d.mapInArrow(run, schema)
