"""Main-text extraction with a tree-structured graphical model over the DOM.

Each element and each run of text is a binary variable (content or not).  Unary potentials come from tag, class and id
names, text length, punctuation and link density; parent-child potentials, one 2x2 table for each kind of edge, tie a
node to its parent.  The tree is small and has no loops, so one upward and one downward sum-product pass gives exact
marginals.  The weights are trained by conditional maximum likelihood (gradient: observed minus expected counts, from
the same passes) on labelled pages that `labelled_pages` writes from a fixed seed.

Null or empty html, and pages without content, give an empty text.  Broken markup (missing end tags, unclosed quotes,
stray `<`) never fails.  Pages are independent rows: no shuffle, memory bounded by a slice of pages or one page.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.llm.common import map_slices

TOKEN = re.compile(r"""<(?:!--(?P<c>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z][^>]*>)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLING_ENDS = {
    tag: (ends.split(), stop.split())
    for tag, ends, stop in (("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table tbody thead tfoot"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))
}
CHROME = frozenset("nav header footer aside form button select menu dialog fieldset noscript template svg canvas head object audio video label input textarea".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre li td th dd dt figcaption caption".split())
GOOD = re.compile(r"(?<![a-z])(?:article|content|post|entry|story|main|body|text|prose|page)(?![a-z])")
BAD = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|header|masthead|footer|foot|sidebar|side|aside|comment\w*|reply|replies|discussion|disqus|respond|cookie\w*|consent|gdpr|notice|alert|warning|popup|modal|overlay|share|sharing|social|related|recommend\w*|breadcrumbs?|subscribe|subscription|newsletter|signup|login|search|widget|toolbar|pagination|pager|tags?|copyright|legal|meta|byline|form|skip|hidden|tracking|paywall)(?![a-z])"
)

FEATURES = {
    f: i
    for i, f in enumerate(
        "bias text element chrome article head prose container inline good bad hidden linky linked_prose link_in_text longtext midtext shorttext sentence symbol under_a under_linked_prose under_link_in_text under_head under_prose dense sparse".split()
    )
}
EDGES = {"plain": 0, "chrome": 1, "article": 2, "text": 3, "badname": 4, "in_article": 5}


def tree(page: str) -> tuple[list, list, list, list]:
    """(parents, tags, names, texts) in page order; texts[i] is None for an element.  Node 0 is the page."""
    parents, tags, names, texts = [-1], ["#page"], [""], [None]
    stack = [0]
    # depths on the stack by tag, of what isn't inline, and of what a paragraph can't reach across
    open_at: dict[str, list[int]] = {}
    solid, walls = [0], [0]
    at, n = 0, len(page)

    def add(tag, name, text):
        parents.append(stack[-1])
        tags.append(tag)
        names.append(name)
        texts.append(text)
        return len(tags) - 1

    def opened(node, tag):
        depth = len(stack)
        stack.append(node)
        open_at.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            solid.append(depth)
            if tag not in HEADS and tag != "p":
                walls.append(depth)

    def close_to(depth):
        while len(stack) > depth:
            open_at[tags[stack.pop()]].pop()
        for marks in (solid, walls):
            while marks[-1] >= depth:
                marks.pop()

    def nearest(some):
        return max((open_at[t][-1] for t in some if open_at.get(t)), default=0)

    while at < n:
        m = TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            piece = page[at:upto]
            add("#text", "", html_lib.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            d = nearest((tag,))
            if d and not (tag in INLINE and solid[-1] > d):
                close_to(d)
            continue
        if tag in SIBLING_ENDS:
            ends, stop = SIBLING_ENDS[tag]
            wall = nearest(stop)
            if tag in ("tr", "dd", "dt"):  # whatever stands open since the table or list
                d = min((x[bisect_right(x, wall)] for t in ends if (x := open_at.get(t)) and x[-1] > wall), default=0)
            else:
                d = nearest(ends)
            if d > wall:
                close_to(d)
        elif tag in CLOSES_P and nearest(("p",)) > walls[-1]:
            close_to(nearest(("p",)))
        attrs = m["attrs"] or ""
        name = ""
        if attrs:
            for k, v in NAMED.findall(attrs):
                k = k.lower()
                v = v.strip("\"'").lower()
                if k in ("hidden", "aria-hidden") and v != "false" or k == "style" and "display:none" in v.replace(" ", ""):
                    name += " #hidden"
                elif k not in ("style", "hidden", "aria-hidden"):
                    name += f" {v}"
            if name:
                name = re.sub(r"[\d_-]+", " ", name)
        node = add(tag, name, None)
        if tag in VOID or attrs.endswith("/") and tag in ("path", "circle", "rect", "use", "g", "line"):
            continue
        if tag in RAW:
            m2 = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = m2.end() if m2 else n
            continue
        opened(node, tag)
    return parents, tags, names, texts


def features(parents, tags, names, texts) -> tuple[list[list[int]], list[int]]:
    """For each node the indices of its unary features, and the kind of the edge to its parent."""
    n = len(tags)
    size, linked = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if texts[i] is not None:
            size[i] = len(texts[i].strip())
            linked[i] = 0
        elif tags[i] == "a":
            linked[i] = size[i]
        size[p] += size[i]
        linked[p] += linked[i]
    f = FEATURES
    out, edges = [], []
    inside = [""] * n
    # the block that holds each node, and the kinds of links: alone in a block of prose, beside other text in any block
    block = [0] * n
    for i in range(1, n):
        block[i] = block[parents[i]] if texts[i] is not None or tags[i] in INLINE else i

    def link(i):
        b = block[i]
        return "link_in_text" if linked[b] < size[b] else "linked_prose" if tags[b] in PROSE - {"li", "td", "th"} or tags[b] in HEADS else ""

    for i in range(n):
        own = [f["bias"]]
        tag, p = tags[i], parents[i]
        if texts[i] is not None:
            t = texts[i].strip()
            own += [f["text"], f["longtext"] if len(t) > 120 else f["midtext"] if len(t) > 25 else f["shorttext"]]
            if re.search(r"[.!?,;:][\"')\]]*(?:\s|$)", t):
                own.append(f["sentence"])
            if t[:1] in "©|›»·•":
                own.append(f["symbol"])
            up = tags[p]
            q = p
            while tags[q] in INLINE and tags[q] != "a" and parents[q] >= 0:
                q = parents[q]
            up = tags[q]
            if up == "a":
                own.append(f["under_" + (link(i) or "a")])
            elif up in HEADS:
                own.append(f["under_head"])
            elif up in PROSE:
                own.append(f["under_prose"])
            edges.append(EDGES["text"])
        else:
            own.append(f["element"])
            edge = "plain"
            if tag in CHROME:
                own.append(f["chrome"])
                edge = "plain" if tag == "header" and inside[p] else "chrome"
                if edge == "plain":
                    own.pop()
            elif tag in ("article", "main"):
                own.append(f["article"])
                edge = "article"
            elif tag in HEADS:
                own.append(f["head"])
            elif tag in PROSE:
                own.append(f["prose"])
            elif tag in INLINE:
                own.append(f["inline"])
            else:
                own.append(f["container"])
            if not BAD.search(names[i]) and (tag in ("article", "main") or names[i] and tag == "div" and GOOD.search(names[i])):
                inside[i] = "y"
            elif p >= 0:
                inside[i] = inside[p] if tag not in CHROME or edge == "plain" else ""
            name = names[i]
            if name and tag not in ("html", "body"):
                if "#hidden" in name:
                    own.append(f["hidden"])
                if BAD.search(name):
                    own.append(f["bad"])
                    edge = "badname"
                elif GOOD.search(name):
                    own.append(f["good"])
            if size[i]:
                linky = "linky" if tag not in INLINE and tag not in HEADS and tag not in PROSE else link(i) or "linky"
                own.append(f[linky] if linked[i] * 2 > size[i] else f["dense"] if size[i] > 200 else f["sparse"])
            if edge == "plain" and p >= 0 and tags[p] in ("article", "main") and not BAD.search(names[p]):
                edge = "in_article"
            edges.append(EDGES[edge])
        out.append(own)
    return out, edges


def sum_product(unary: list[float], edges: list[int], parents: list[int], psi) -> tuple[list[float], list[float], list[float]]:
    """Exact log-odds of content for each node; also the cavities of parent and child for the pairwise marginals.

    psi[kind] is (log psi00, psi01, psi10, psi11), first index the parent.  Parents stand before children, so one loop
    backwards is the upward pass and one forwards the downward pass.
    """
    n = len(unary)
    up, msg = list(unary), [0.0] * n

    def lse(a, b):
        return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))

    for i in range(n - 1, 0, -1):
        p00, p01, p10, p11 = psi[edges[i]]
        a = up[i]
        msg[i] = lse(p10, p11 + a) - lse(p00, p01 + a)
        up[parents[i]] += msg[i]
    total, cavity = list(up), [0.0] * n
    for i in range(1, n):
        p00, p01, p10, p11 = psi[edges[i]]
        c = total[parents[i]] - msg[i]
        cavity[i] = c
        total[i] = up[i] + lse(p01, p11 + c) - lse(p00, p10 + c)
    return total, up, cavity


def labelled_pages(n: int = 240, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(html, the texts that are content): varied page layouts, written from a fixed seed."""
    rng = random.Random(seed)
    syll = "ba co di fu ga he li mo na po ri sa te vu wo xi".split()
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    phrase = lambda k: " ".join(word() for _ in range(k)).capitalize()

    def sentence():
        return phrase(rng.randint(5, 16)) + rng.choice([".", ".", ".", "!", "?"])

    pages = []
    for _ in range(n):
        good: set[str] = set()

        def text(t):
            good.add(t)
            return t

        short = rng.random() < 0.3

        def linked(t, share):
            """t with some of its words in links; each piece between tags is content."""
            words, out, plain, at = t.split(), [], [], 0
            while at < len(words):
                k = rng.randint(1, 6)
                if rng.random() < share:
                    out += [text(" ".join(plain))] * bool(plain) + [f'<a href="/{word()}">{text(" ".join(words[at : at + k]))}</a>']
                    plain = []
                else:
                    plain += words[at : at + k]
                at += k
            return " ".join(out + [text(" ".join(plain))] * bool(plain))

        def para():
            if rng.random() < 0.25:
                t = " ".join(sentence() for _ in range(rng.randint(1, 4)))
                end = "</p>" if rng.random() < 0.7 else ""
                return rng.choice([f"<p>{linked(t, 0.2)}{end}", f"<p>{linked(t, 0.6)}{end}", f'<p><a href="/{word()}">{text(sentence())}</a>{end}', f"<ul><li>{linked(t, 0.3)}</li><li>{linked(sentence(), 0.3)}</li></ul>", f'<h2><a href="#{word()}">{text(phrase(4))}</a></h2>', f"<h3>{linked(phrase(6), 0.5)}</h3>"])
            if short:
                return f"<p>{text(rng.choice([phrase(rng.randint(1, 4)), phrase(2) + '.', phrase(rng.randint(20, 60)), ' '.join([word()] * rng.randint(3, 40))]))}{'</p>' if rng.random() < 0.7 else ''}"
            return f"<p>{'<b>' if rng.random() < 0.2 else ''}{text(' '.join(sentence() for _ in range(rng.randint(1, 6))))}{'</p>' if rng.random() < 0.7 else ''}"

        links = lambda k: "".join(f'<li><a href="/{word()}">{phrase(rng.randint(1, 3))}</a></li>' for _ in range(k))
        menu = rng.choice([f"<nav><ul>{links(5)}</ul></nav>", f'<div class="menu"><ul>{links(6)}</ul></div>', f'<header class="site-header"><a href="/">{phrase(2)}</a><p>{phrase(4)}</p></header><nav>{links(3)}</nav>', ""])
        noise = lambda: rng.choice(
            [
                f'<div class="ad">{sentence()}</div>',
                f'<aside class="sidebar"><h3>{phrase(2)}</h3><ul>{links(4)}</ul><p>{sentence()}</p></aside>',
                f'<div class="cookie-notice"><p>{sentence()} {sentence()}</p><button>{phrase(1)}</button></div>',
                f'<form action="/s"><label>{phrase(2)}</label><input name="q"><button>{phrase(1)}</button><p>{sentence()}</p></form>',
                f'<div id="newsletter"><h4>{phrase(3)}</h4><p>{sentence()}</p></div>',
                f'<div class="advert"><p>{sentence()} {sentence()}</p></div>',
                f'<div role="alert" class="notice">{sentence()}</div>',
                f'<aside><p>{sentence()} {sentence()} {sentence()}</p></aside>',
                f'<div class="share"><a href="#">{phrase(1)}</a> <a href="#">{phrase(1)}</a></div>',
                f'<div class="related"><h3>{phrase(2)}</h3>{links(3)}</div>',
                "",
                "",
            ]
        )
        body = "".join(rng.choice([para, para, para, lambda: f"<h2>{text(phrase(4))}</h2>", lambda: f"<ul><li>{text(sentence())}</li><li>{text(sentence())}</li></ul>", lambda: f"<blockquote><p>{text(sentence())}</p></blockquote>", noise])() for _ in range(rng.choice([0, 1, 2, 30]) if short else rng.randint(2, 9)))
        title = text(phrase(rng.randint(1, 8)))
        head = rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>"])
        body += para()
        shell = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="post-content">{}</div>', '<div id="content"><div class="entry">{}</div></div>', "<section>{}</section>", "<div>{}</div>"])
        replies = "".join(f'<div class="comment"><b>{phrase(1)}</b><p>{sentence()} {sentence()}</p></div>' for _ in range(rng.randint(1, 4)))
        after = rng.choice([f'<section class="comments"><h3>{phrase(2)}</h3>{replies}</section>', f'<div id="comments">{replies}</div>', f'<ol class="comment-list"><li><article class="comment"><p>{sentence()} {sentence()}</p></article></li></ol>', "", ""])
        foot = rng.choice([f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>", f'<div class="footer"><p>{sentence()}</p><a href="/">{phrase(2)}</a></div>', f"<footer><p>{sentence()} {sentence()}</p></footer>"])
        inside = rng.random() < 0.3
        core = shell.format(head + body + (after if inside else ""))
        pages.append((f"<html><head><title>{phrase(4)}</title><style>p{{}}</style></head><body>{menu}{noise()}{core}{noise()}{'' if inside else after}{foot}</body></html>", good))
    return pages


@lru_cache(1)
def trained(pages: int = 360, rounds: int = 200, rate: float = 4.0, seed: int = 11) -> tuple[tuple[float, ...], tuple[tuple[float, ...], ...]]:
    """(unary weights, edge tables) by gradient ascent on the conditional log-likelihood of labelled_pages."""
    data = []
    for page, good in labelled_pages(pages, seed):
        parents, tags, names, texts = tree(page)
        feats, edges = features(parents, tags, names, texts)
        label = [0] * len(tags)
        for i in range(len(tags) - 1, -1, -1):
            if texts[i] is not None:
                label[i] = int(texts[i].strip() in good)
            if label[i] and i and tags[i] not in ("body", "html"):
                label[parents[i]] = 1
        for i, t in enumerate(tags):
            if t in ("#page", "html", "body"):
                label[i] = 1
        data.append((feats, edges, parents, label))
    # all pages as one forest: a page's nodes stand together, parents before children
    starts = np.cumsum([0, *(len(d[3]) for d in data)])
    n, width = int(starts[-1]), len(FEATURES)
    x = np.zeros((n, width))
    for (feats, _, _, _), at in zip(data, starts, strict=False):
        for i, f in enumerate(feats):
            x[at + i, f] = 1
    kind = np.concatenate([d[1] for d in data])
    label = np.concatenate([d[3] for d in data])
    parent = np.concatenate([np.array(d[2]) + at for d, at in zip(data, starts, strict=False)])
    root = np.zeros(n, bool)
    root[starts[:-1]] = True
    parent[root] = np.flatnonzero(root)
    depth = np.zeros(n, int)
    for i in np.flatnonzero(~root):
        depth[i] = depth[parent[i]] + 1
    levels = [np.flatnonzero(depth == k) for k in range(1, int(depth.max()) + 1)]
    child = np.flatnonzero(~root)
    observed = np.bincount(kind[child] * 4 + 2 * label[parent[child]] + label[child], minlength=4 * len(EDGES)).reshape(-1, 4)
    w, psi = np.zeros(width), np.zeros((len(EDGES), 4))
    gw2, gp2 = np.full(width, 1e-3), np.full((len(EDGES), 4), 1e-3)
    for _ in range(rounds):
        up, msg, cavity = x @ w, np.zeros(n), np.zeros(n)
        for at in reversed(levels):
            p00, p01, p10, p11 = psi[kind[at]].T
            msg[at] = np.logaddexp(p10, p11 + up[at]) - np.logaddexp(p00, p01 + up[at])
            np.add.at(up, parent[at], msg[at])
        total = up.copy()
        for at in levels:
            p00, p01, p10, p11 = psi[kind[at]].T
            cavity[at] = total[parent[at]] - msg[at]
            total[at] = up[at] + np.logaddexp(p01, p11 + cavity[at]) - np.logaddexp(p00, p10 + cavity[at])
        # observed minus expected counts, of features and of pairs
        gw = x.T @ (label - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) / n - 1e-4 * w
        u, c = up[child], cavity[child]
        joint = psi[kind[child]] + np.stack([0 * u, u, c, c + u], 1)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        joint /= joint.sum(axis=1, keepdims=True)
        expected = np.stack([np.bincount(kind[child], weights=joint[:, k], minlength=len(EDGES)) for k in range(4)], 1)
        gp = (observed - expected) / n - 1e-4 * psi
        gw2 += gw**2  # steps scaled by the gradients so far
        gp2 += gp**2
        w += rate * 0.1 * gw / np.sqrt(gw2)
        psi += rate * 0.1 * gp / np.sqrt(gp2)
    return tuple(w.tolist()), tuple(map(tuple, psi.tolist()))


def main_text(page: str | None, model) -> tuple[str, list[float]]:
    """(the content blocks joined by newlines, the marginal probability of each text node with letters or digits)."""
    if not page:
        return "", []
    w, psi = model
    parents, tags, names, texts = tree(page)
    feats, edges = features(parents, tags, names, texts)
    odds, _, _ = sum_product([sum(w[k] for k in f) for f in feats], edges, parents, psi)
    n = len(tags)
    home, dead = [0] * n, [False] * n
    blocks: list[str] = []
    now: list[str] = []
    last, seen = -1, []
    depth_open: list[int] = []

    def flush():
        if now:
            t = " ".join("".join(now).split())
            if t:
                blocks.append(t)
            now.clear()

    for i in range(1, n):
        p = parents[i]
        while depth_open and depth_open[-1] > p:  # left a block element: what follows is another block
            depth_open.pop()
            flush()
        if texts[i] is None:
            if tags[i] == "br":
                now.append(" ")
            elif tags[i] not in INLINE:
                flush()
                depth_open.append(i)
            dead[i] = dead[p] or tags[i] in ("head", "noscript", "template", "svg", "object", "canvas", "select", "button")
            continue
        if dead[p]:
            continue
        if texts[i].strip():
            seen.append(1 / (1 + math.exp(-max(-30, min(30, odds[i])))))
            if odds[i] > 0:
                now.append(texts[i])
        elif now:
            now.append(" ")
    flush()
    return "\n".join(blocks), seen


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text (string), n_chars (long, code points), n_nodes (int) and confidence (double: the least certain marginal)."""
    model = trained()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long, n_nodes int, confidence double"

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [main_text(x, model) for x in part.column(html).to_pylist()]
        out = [part.column(c) for c in keep] + [
            pa.array([t for t, _ in rows], pa.string()),
            pa.array([len(t) for t, _ in rows], pa.int64()),
            pa.array([len(s) for _, s in rows], pa.int32()),
            pa.array([min((max(x, 1 - x) for x in s), default=1.0) for _, s in rows], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(out, names=[*keep, "text", "n_chars", "n_nodes", "confidence"])

    return map_slices(pages.select(*keep, html), run, schema, html)
