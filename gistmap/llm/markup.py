"""Markup residue to clean, structured text with a tree-structured graphical model.

A text becomes a tree: elements of the document nest as in a DOM (with fenced code, LaTeX commands and
environments, links, templates and emphasis as elements of their own) and every sign that could be markup is a
node below the element it stands in. Each node takes one of three labels: markup, plain (the sign in its plain
sense) or code (a sign inside code). The root takes the notation the text is written in (``NOTATIONS``).
Node potentials come from the node's shape, edge potentials tie a child to its parent's label, and at the top to
the notation of the text; all are log counts of labelled pages, which are made here from seeded,
labelled fragments (``TRAIN_PAGES`` pages, a fixed bound). Sum-product messages run upward and downward once
and give exact marginals: a sign that can be read in two ways is read as its surroundings are. The most
probable label is taken, and the text is rendered from the labels: tags, emphasis and templates go, headings,
lists, tables, code and formulas stay in one uniform notation.

Elements are matched with stacks and sorted positions, without a bound on their length or depth. Near-linear in
the text, no shuffle. Defined results: a null text has no kinds and stays null; an empty one stays empty; unclosed
code, environments and tags end with the text.
"""

from __future__ import annotations

import bisect
import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmap.runtime import spread

MARKUP, PLAIN, CODE = 0, 1, 2
#: Nodes of a tree whose labels are remembered, and how many such trees a process keeps.
KNOWN_NODES, KNOWN_TREES = 200, 20_000
#: What the root of a text can be.
NOTATIONS = ("plain", "html", "markdown", "wiki", "latex")
TRAIN_PAGES = 1_500

# Element names of HTML that occur in exported chats.
TAGS = set("a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var video".split())
VOID = set("br hr img input link meta col".split())
BLOCKS = set("p div h1 h2 h3 h4 h5 h6 ul ol li table tr pre blockquote section article header footer dl dt dd hr figure".split())

# LaTeX names that stand without an argument, list and code environments, and environments that hold a formula.
BARE = set("alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega times cdot leq geq neq approx infty sum prod int partial nabla to rightarrow leftarrow Rightarrow forall exists in pm ldots cdots dots quad qquad LaTeX TeX newline newpage maketitle centering noindent bigskip medskip smallskip hline item".split())
LIST_ENVS, CODE_ENVS = {"itemize", "enumerate", "description"}, {"verbatim", "lstlisting", "minted"}
MATH_ENVS = {"equation", "align", "gather", "multline", "eqnarray", "math", "displaymath"}

_SIGNS = re.compile(r"[<&`#*_\[\]{}|\\$=>'+~]|^[ \t]*(?:-|\d{1,9}[.)])[ \t]", re.M)
#: Where an element can start: a sign, or the beginning of a line that may be a heading, list, rule or quote.
_START = re.compile(r"[<&\\$\[{'`*_~]|^[ \t]*(?:[=#>+\-|:]|\d{1,9}[.)])", re.M)
_TOKEN = re.compile(
    r"""
    (?P<comment><!--)
  | (?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*|/)?>)
  | (?P<escaped>&lt;/?(?P<ename>[A-Za-z][A-Za-z0-9]*)(?:\s(?:(?!&[lg]t;)[^<>\n])*|/)?&gt;)
  | (?P<ref>&(?:\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)
  | (?P<fence>(?<![^\n])[ \t]*(?:```|~~~)[^\n`]*$)
  | (?P<env>\\(?:begin|end)\{(?P<envname>[A-Za-z]+)\*?\})
  | (?P<item>\\item\b[ ]?)
  | (?P<display>\$\$|\\\[)
  | (?P<inline>\\\(|\$(?=\S)[^$\n]+?(?<=\S)\$)
  | (?P<command>\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?)
  | (?P<wlink>\[\[[^\[\]\n]+\]\])
  | (?P<template>\{\{)
  | (?P<whead>(?<![^\n])[ \t]*(?P<eq>={2,6})[ ]?[^=\n][^\n]*?[ ]?(?P=eq)[ \t]*$)
  | (?P<wemph>'{2,5}(?=[^'\s]))
  | (?P<mhead>(?<![^\n])[ ]{0,3}\#{1,6}[ ]+(?=\S))
  | (?P<mtable>(?<![^\n])[ ]*\|?[ ]*:?-{2,}:?[ ]*(?:\|[ ]*:?-{2,}:?[ ]*)+\|?[ ]*$)
  | (?P<mlist>(?<![^\n])[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S))
  | (?P<mquote>(?<![^\n])[ ]{0,3}>[ ]?(?=\S))
  | (?P<mlink>!?\[[^\[\]\n]+\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:[ ]"[^"\n]*")?\))
  | (?P<mcode>`{1,2}(?=[^`])[^`\n]+`{1,2})
  | (?P<memph>(?<![\w*_\\])(?P<em>\*{1,3}|_{1,3}|~~)(?=[^\s*_~]))
    """,
    re.X | re.M,
)
_EMPH_END = re.compile(r"(?<=[^\s*_~\\])(\*{1,3}|_{1,3}|~~)(?![\w*_])")
_WEMPH_END = re.compile(r"(?<=[^'\s])'{2,5}")
KIND = {
    "comment": "html", "tag": "html", "escaped": "html", "ref": "html",
    "fence": "markdown", "mhead": "markdown", "mtable": "markdown", "mlist": "markdown", "mquote": "markdown", "mlink": "markdown", "mcode": "markdown", "memph": "markdown",
    "wlink": "wiki", "template": "wiki", "whead": "wiki", "wemph": "wiki",
    "env": "latex", "item": "latex", "display": "latex", "inline": "latex", "command": "latex",
}


class Node:
    """One sign or element. ``inner`` is the range of its content where it is looked into, else None."""

    __slots__ = ("children", "end", "inner", "label", "name", "parent", "shape", "start", "type")

    def __init__(self, type_: str, start: int, end: int, shape: str, parent: Node | None, name: str = ""):
        self.type, self.start, self.end, self.shape, self.parent, self.name = type_, start, end, shape, parent, name
        self.children: list[Node] = []
        self.label = PLAIN
        self.inner: tuple[int, int] | None = None
        if parent is not None:
            parent.children.append(self)


def _shape(kind: str, m: re.Match, text: str, end: int) -> str:
    """What the potentials see of a node: its type and a few properties of its signs."""
    if kind == "tag":
        name = m["name"].lower()
        known = name in TAGS
        case = m["name"].islower() or m["name"].isupper()
        glued = text[m.start() - 1 : m.start()].isalnum() and not known
        return f"tag:{known}:{case or known}:{glued}:{len(name) == 1 and name not in 'abipqsu'}:{m['name'].isupper() and len(name) == 1}"
    if kind == "escaped":
        return f"escaped:{m['ename'].lower() in TAGS}:{m['ename'].isupper() and len(m['ename']) == 1}"
    if kind == "ref":
        s = m.group()
        return f"ref:{s[1] == '#' or s[1:] in html5}"
    if kind == "inline" and text[m.start()] == "$":
        body = text[m.start() + 1 : end - 1]
        money = body[0].isdigit() and re.search(r"[A-Za-z]{2,} ", body) is not None
        return f"inline$:{money}:{bool(re.search(r'[\\^_=+<>]|^[A-Za-z]$', body))}:{text[end : end + 1].isdigit()}"
    if kind == "memph":
        body = text[m.end() : end - len(m["em"])]
        return f"memph:{m['em'][0]}:{len(m['em'])}:{bool(re.fullmatch(r'[\d\s.,*+x=-]*', body))}"
    if kind == "mcode":
        return f"mcode:{end - m.start() > 80}"
    if kind == "mlist":
        return f"mlist:{m.group().strip()[0].isdigit()}:{text[end : end + 1].isdigit()}"
    if kind == "wemph":
        body = text[m.end() : end].rstrip("'")
        return f"wemph:{len(m.group()) == end - m.end() - len(body)}:{body.replace(' ', '').isdigit()}"
    if kind == "whead":
        return f"whead:{bool(re.search(r'[();]', m.group()))}"
    if kind == "mhead":
        return f"mhead:{text[end : end + 1].isdigit()}"
    if kind == "command":
        return f"command:{end > m.end()}:{m.group()[1:].rstrip('*') in BARE}:{text[m.start() - 1 : m.start()] in ('/', ':') or (text[m.start() - 1 : m.start()].isalnum() and end == m.end())}"
    if kind == "template":
        return f"template:{chr(10) in text[m.start() : end]}"
    return kind


class _Ends:
    """Where elements of one text end; each list is made once, when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.closing: dict[str, list[int]] = {}
        self.none_after: dict[str, int] = {}
        self.pairs: dict[str, dict[int, int]] = {}

    def mark(self, mark: str, pattern: re.Pattern, after: int) -> int:
        """Start of the next ``mark`` on the same line that can close an emphasis, or -1."""
        at = self.closing.get(mark)
        if at is None:
            at = []
            for m in pattern.finditer(self.text):
                if pattern is _WEMPH_END or m.group() == mark:
                    at.append(m.start())
            self.closing[mark] = at
        i = bisect.bisect_left(at, after)
        if i == len(at):
            return -1
        return -1 if self.text.find("\n", after, at[i]) >= 0 else at[i]

    def find(self, sign: str, after: int) -> int:
        """Next ``sign``, or -1; a miss is remembered."""
        if after >= self.none_after.get(sign, len(self.text) + 1):
            return -1
        at = self.text.find(sign, after)
        if at < 0:
            self.none_after[sign] = min(after, self.none_after.get(sign, after))
        return at

    def match(self, opened: str, closed: str, at: int) -> int:
        """Start of the bracket that closes the one at ``at``, or -1; brackets nest."""
        pairs = self.pairs.get(opened)
        if pairs is None:
            pairs, stack = {}, []
            for m in re.finditer(f"{re.escape(opened)}|{re.escape(closed)}", self.text):
                if m.group() == opened:
                    stack.append(m.start())
                elif stack:
                    pairs[stack.pop()] = m.start()
            self.pairs[opened] = pairs
        return pairs.get(at, -1)


def _element(kind: str, m: re.Match, text: str, ends: _Ends) -> tuple[int, tuple[int, int] | None]:
    """(end, content range or None) of the element that starts with ``m``; end -1: there is none."""
    start, end = m.span()
    if kind == "comment":
        at = ends.find("-->", end)
        return (at + 3 if at >= 0 else len(text)), None
    if kind == "display":
        closed = "$$" if text[start] == "$" else "\\]"
        at = ends.find(closed, end)
        return (at + 2 if at > end else -1), None
    if kind == "inline" and text[start] == "\\":
        at = ends.find("\\)", end)
        return (at + 2 if at > end else -1), None
    if kind == "command":
        groups, at = [], end
        while text[at : at + 1] == "{" and (close := ends.match("{", "}", at)) >= 0:
            groups.append((at + 1, close))
            at = close + 1
        if not groups:
            return m.start() + len(re.match(r"\\[A-Za-z]+", m.group()).group()), None
        if len(groups) == 1 or m.group().startswith("\\href"):
            return at, groups[-1]
        return at, None
    if kind == "template":
        at = ends.match("{{", "}}", start)
        return (at + 2 if at > end else -1), None
    if kind == "wemph":
        at = ends.mark("''", _WEMPH_END, end + 1)
        if at < 0:
            return -1, None
        return at + len(re.match("'{2,5}", text[at : at + 5]).group()), (end, at)
    if kind == "memph":
        at = ends.mark(m["em"], _EMPH_END, end + 1)
        return (at + len(m["em"]), (end, at)) if at >= 0 else (-1, None)
    if kind == "wlink":
        return end, (max(start + 2, text.rfind("|", start, end) + 1), end - 2)
    if kind == "mlink":
        at = text.index("[", start) + 1
        return end, (at, text.index("]", at))
    return end, None


def parse(text: str) -> Node:
    """The tree of a text; leaves and elements in order of appearance."""
    root = Node("root", 0, len(text), "root", None)
    here, at = root, 0
    ends = _Ends(text)
    # elements looked into, innermost last: (end of the content, end of the element, element)
    open_: list[tuple[int, int, Node]] = []
    while (s := _START.search(text, at)) is not None:
        pos = s.start()
        while open_ and pos >= open_[-1][0]:
            stop, end, node = open_.pop()
            here, pos = node.parent, max(pos, end)
        if pos != s.start():
            at = pos
            continue
        m = _TOKEN.match(text, pos)
        if m is None and text[pos] in " \t":
            at = pos + 1
            continue
        end, inner = -1, None
        if m is not None:
            kind = m.lastgroup if m.lastgroup in KIND else _INNER.get(m.lastgroup)
            end, inner = _element(kind, m, text, ends)
        if end < 0 or (open_ and end > open_[-1][0]):
            at = pos + 1
            # a run of the same sign is one sign
            while at < len(text) and text[at] == text[pos] and text[pos] in "*_~'`":
                at += 1
            continue
        at = end
        node = Node(kind, pos, end, _shape(kind, m, text, end), here)
        if inner is not None and inner[0] < inner[1]:
            node.inner = inner
            open_.append((inner[1], end, node))
            here, at = node, inner[0]
        if kind == "tag":
            name = node.name = m["name"].lower()
            if m.group().startswith("</"):
                up = here
                while up is not None and not (up.type == "tag" and up.name == name):
                    up = up.parent
                if up is not None:
                    here.children.remove(node)
                    node.parent = up.parent
                    up.parent.children.append(node)
                    here = up.parent
            elif name in TAGS and name not in VOID and not m.group().endswith("/>"):
                if name in ("li", "p", "tr", "td", "th") and here.type == "tag" and here.name == name:
                    # an unclosed sibling of the same name ends here
                    here.children.remove(node)
                    node.parent = here.parent
                    here.parent.children.append(node)
                here = node
        elif kind == "env":
            node.name = m["envname"]
            if node.name in CODE_ENVS and m.group().startswith("\\begin"):
                stop = ends.find(f"\\end{{{node.name}", end)
                at = stop if stop >= 0 else len(text)
                _inside(text, end, at, node)
        elif kind == "command":
            node.name = re.match(r"\\([A-Za-z]+)", m.group()).group(1)
        elif kind == "fence":
            node.name = "fence"
            mark = m.group().strip()[:3]
            close = re.compile(rf"^[ \t]*{mark}[ \t]*(?=$|\s)", re.M).search(text, end)
            stop = close.start() if close else len(text)
            _inside(text, end, stop, node)
            if close:
                Node("fence", close.start(), close.end(), "fence", here, "close")
                at = close.end()
            else:
                node.name = "open"
                at = len(text)
        elif kind == "mcode":
            node.name = "code"
    return root


_INNER = {"name": "tag", "ename": "escaped", "envname": "env", "eq": "whead", "em": "memph"}


def _inside(text: str, start: int, stop: int, parent: Node) -> None:
    """Signs inside code, as leaves below it."""
    ends, at = _Ends(text), start
    while (s := _START.search(text, at, stop)) is not None:
        m = _TOKEN.match(text, s.start(), stop)
        at = s.start() + 1
        if m is not None:
            kind = m.lastgroup if m.lastgroup in KIND else _INNER.get(m.lastgroup)
            Node(kind, m.start(), m.end(), _shape(kind, m, text, m.end()), parent)
            at = max(m.end(), at)


def _edge(parent: Node, child: Node) -> str:
    """The type of the edge to a child; below the root it is the notation the child would be of."""
    if parent.type == "root":
        return KIND[child.type]
    if parent.type == "tag" and parent.name == "pre" and child.type == "tag" and child.name == "code":
        return "wrap"
    if parent.type == "fence" or (parent.type == "env" and parent.name in CODE_ENVS) or (parent.type == "tag" and parent.name in ("pre", "code", "script", "style", "kbd", "samp", "tt")):
        return "code"
    return "flow"


def nodes_of(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += reversed(n.children)
    return out


class TreeModel:
    """Node and edge potentials, and exact inference on a tree."""

    def fit(self, pages: list[tuple[str, list[tuple[int, int, int]], int]]) -> TreeModel:
        """Count labels of nodes by shape and of edges by type on labelled pages (text, spans, notation)."""
        shapes: dict[str, np.ndarray] = {}
        edges: dict[str, np.ndarray] = {}
        types: dict[str, np.ndarray] = {}
        prior = np.full(len(NOTATIONS), 1.0)
        for text, spans, notation in pages:
            root = parse(text)
            prior[notation] += 1
            for n in nodes_of(root)[1:]:
                n.label = next((label for a, b, label in spans if a <= n.start < b), PLAIN)
                top = n.parent.type == "root"
                kind = _edge(n.parent, n)
                if kind == "code" and n.parent.label in (MARKUP, CODE) and not (n.type == "tag" and n.name in ("code", "pre")):
                    n.label = CODE
                shapes.setdefault(n.shape, np.full(3, 0.2))[n.label] += 1
                types.setdefault(n.type, np.full(3, 0.2))[n.label] += 1
                edges.setdefault(kind, np.full((len(NOTATIONS) if top else 3, 3), 0.2))[notation if top else n.parent.label, n.label] += 1
        # an edge tells how far the child's label leaves what its shapes alone would give; at the top also how far
        # a notation favours children of a kind, so that the signs of a text tell its notation
        total = sum(types.values())
        per_notation = sum(v.sum(axis=1, keepdims=True) for k, v in edges.items() if k in NOTATIONS)
        self.edges = {}
        for k, v in edges.items():
            if k in NOTATIONS:
                ratio = (v / per_notation) / (v.sum(axis=0) / per_notation.sum())
                ratio[:, CODE] = 1e-6  # nothing stands in code at the top
            else:
                ratio = (v / v.sum(axis=1, keepdims=True)) / (total / total.sum())
            self.edges[k] = [tuple(float(x) for x in row) for row in ratio]
        self.shapes = {k: tuple(float(x) for x in v / v.sum()) for k, v in shapes.items()}
        self.types = {k: tuple(float(x) for x in v / v.sum()) for k, v in types.items()}
        self.prior = [math.log(x) for x in prior / prior.sum()]
        self.known: dict[tuple, list[int]] = {}
        return self

    def own(self, n: Node) -> tuple[float, float, float]:
        """The node potential."""
        return self.shapes.get(n.shape) or self.types.get(n.type) or (1 / 3, 1 / 3, 1 / 3)

    def edge(self, kind: str) -> list[tuple[float, float, float]]:
        """The edge potential: a row per label (or notation) of the parent."""
        return self.edges.get(kind) or [(1.0, 1.0, 1.0)] * (len(NOTATIONS) if kind in NOTATIONS else 3)

    def label(self, root: Node) -> list[Node]:
        """Sum-product up and down; sets and returns the nodes with their most probable labels."""
        order = nodes_of(root)
        if len(order) > KNOWN_NODES:
            self._infer(order)
            return order
        # trees of the same shape have the same labels; those of small trees are remembered
        at = {id(n): i for i, n in enumerate(order)}
        key = tuple([(n.shape, at[id(n.parent)], n.name) for n in order[1:]])
        labels = self.known.get(key)
        if labels is None:
            self._infer(order)
            if len(self.known) >= KNOWN_TREES:
                self.known.clear()
            self.known[key] = [n.label for n in order[1:]]
        else:
            for n, label in zip(order[1:], labels):
                n.label = label
        return order

    def _infer(self, order: list[Node]) -> None:
        """Upward and downward messages over the nodes of a tree, parents first; sets the labels."""
        below = {id(n): self.own(n) for n in order[1:]}
        up: dict[int, tuple] = {}
        top = list(self.prior)
        for n in reversed(order[1:]):
            a, b, c = below[id(n)]
            m = [x * a + y * b + z * c for x, y, z in self.edge(_edge(n.parent, n))]
            if n.parent.type == "root":
                up[id(n)] = m = [math.log(v) for v in m]
                for d, v in enumerate(m):
                    top[d] += v
                continue
            s = sum(m)
            up[id(n)] = m = (m[0] / s, m[1] / s, m[2] / s)
            x, y, z = below[id(n.parent)]
            x, y, z = x * m[0], y * m[1], z * m[2]
            s = x + y + z
            below[id(n.parent)] = (x / s, y / s, z / s)
        full: dict[int, tuple] = {}
        for n in order[1:]:
            a, b, c = below[id(n)]
            if n.parent.type == "root":
                rest = [t - v for t, v in zip(top, up[id(n)])]
                most = max(rest)
                q = [math.exp(r - most) for r in rest]
            else:
                q = [f / u for f, u in zip(full[id(n.parent)], up[id(n)])]
            x = y = z = 0.0
            for w, (i, j, k) in zip(q, self.edge(_edge(n.parent, n))):
                x += w * i
                y += w * j
                z += w * k
            x, y, z = x * a, y * b, z * c
            s = x + y + z
            full[id(n)] = (x / s, y / s, z / s)
            n.label = MARKUP if x >= y and x >= z else PLAIN if y >= z else CODE


# --- labelled pages -----------------------------------------------------------------------------

_WORDS = "river stone garden paper window simple morning engine letter market copper silver forest bridge violet winter summer little common number answer river table chair light sound water cloud plate"


def _fragments(r: random.Random, notation: int) -> tuple[str, int]:
    """One fragment, mostly of the notation, and the label of the signs in it (code inside code is labelled by its place)."""
    w = lambda: r.choice(_WORDS.split())
    n = lambda: r.randint(2, 99)
    code = r.choice([f"for x in range({n()}):\n    print(x * {n()})  # {w()}", f"SELECT {w()}, count(*)\nFROM {w()}", f"if (a &lt; {n()} &amp;&amp; b) {{ run(); }}", f"# {w()}\n* {w()}\nx == y", f"let {w()} = [{n()}];", f"<b>{w()}</b> **{w()}**"])
    of_html = [
        f"<p>{w()} {w()}.</p>", f"<ul><li>{w()}</li><li>{w()}</li></ul>", f"<h3>{w()}</h3>", f"<b>{w()}</b>", f"<br>", f"<br/>", f"<div class=\"x\">{w()}</div>", f"<!-- {w()} -->",
        f"<table><tr><th>{w()}</th></tr><tr><td>{n()}</td></tr></table>", f"<a href=\"https://x.example/{n()}\">{w()}</a>", f"<pre><code>{code}</code></pre>", f"<span>{w()}</span>", f"<LI>{w()}<LI>{w()}", f"<i>{w()}</i>",
        f"{w()}&nbsp;{w()}", f"{w()} &amp; {w()}", f"&quot;{w()}&quot;", f"{w()} &ndash; {w()}", f"&#160;{w()}", f"a &lt; b", f"&lt;b&gt;{w()}&lt;/b&gt;", f"&lt;i&gt;{w()}&lt;/i&gt;",
    ]
    of_markdown = [
        f"\n# {w()}\n", f"\n### {w()} {w()}\n", f"\n- {w()} {w()}\n- {w()}\n", f"\n* {w()}\n* {w()} {w()}.\n", f"\n1. {w()} {w()}.\n2. {w()}.\n", f"\n+ {w()}\n", f"\n1) {w()}\n2) {w()}\n", f"\n> {w()} {w()}?\n", f"\n| {w()} | {w()} |\n|---|:--:|\n| {n()} | {n()} |\n",
        f"[{w()}](https://x.example/{n()})", f"**{w()}**", f"*{w()}*", f"__{w()}__", f"_{w()}_", f"**{w()} {w()}**", f"`{w()}_{w()}`", f"\n```\n{code}\n```\n", f"\n```python\n{code}\n```\n", f"**{n()}**",
    ]
    of_wiki = [
        f"[[{w()}|{w()}]]", f"[[{w()}]]", f"[[Category:{w()}]]", f"{{{{note|{w()}|{n()}}}}}", f"\n== {w()} ==\n", f"\n=== {w()} {w()} ===\n", f"'''{w()}'''", f"''{w()}''", f"{{{{note|{{{{{w()}}}}}|{n()}}}}}",
    ]
    of_latex = [
        f"\\textbf{{{w()}}}", f"\\emph{{{w()}}}", f"\n\\section{{{w()}}}\n", f"\n\\begin{{itemize}}\n\\item {w()} {w()}.\n\\end{{itemize}}\n", f"$x_{n()} = \\alpha^{n()}$", f"$a + b$", f"$$\\frac{{a}}{{b}} = {n()}$$", f"\n\\[ \\sum_i x_i \\leq {n()} \\]\n", f"\\(\\lambda_{n()} > 0\\)", f"\\textbf{{{w()} \\emph{{{w()}}} {w()}}}", f"where \\alpha and \\beta hold",
    ]
    plain = [
        f"It costs ${n()} or at most ${n()} per month.", f"From ${n()} to ${n()} in all.", f"That makes 2 * {n()} * {n()} pieces.", f"The name max_{n()}_items is long.", f"Check whether x == y before row[{n()}].", f"As long as a < b and c > {n()}.",
        f"Use 10^{n()} as limit ~ roughly.", "In C# or F# without changes.", f"Replace {{name}} by {w()}.", f"The R&D notes rank it #{n()}.", "The type Vec<T> is right.", "Use Map<K, V> or List<Item> here.", f"{w()} {w()} {w()}.", f"it's 5' 10'' tall", f"snake_case_{w()} and other_{w()}", f"a - b + c = {n()}",
        f"see [{n()}] and (x)", f"path C:\\Temp\\{w()}", f"D:\\alpha\\{w()}", f"mail & phone; {w()}|{w()}", f"~{n()} minutes", f"The type Vec&lt;T&gt; is right.",
    ]
    # escaped type names are character references, which are markup, though the tag they spell is none
    if r.random() < (0.15 if notation == 0 else 0.72):
        lists = (of_html, of_markdown, of_wiki, of_latex)
        return r.choice(lists[notation - 1] if notation and r.random() < 0.65 else r.choice(lists)), MARKUP
    s = r.choice(plain)
    return s, MARKUP if "&lt;T" in s else PLAIN


def _doubtful(r: random.Random, notation: str) -> tuple[str, int]:
    """A fragment whose signs can be read in two ways; in a text of their notation they are markup."""
    w = lambda: r.choice(_WORDS.split())
    n = lambda: r.randint(2, 99)
    every = [
        ("markdown", f"*{n()}*"), ("markdown", f"_{n()}_"), ("markdown", f"\n# {n()} {w()}s\n"), ("markdown", f"\n- {n()} {w()}\n"),
        ("wiki", f"''{n()}''"), ("wiki", f"\n== {w()} ({n()}); ==\n"), ("wiki", f"{{{{{w()}\n|{w()}}}}}"),
        ("latex", f"${n()} {w()}s$"), ("latex", f"${n()}$"), ("latex", f"\\{w()}"), ("html", f"<{w()}>"), ("html", f"<{w()}>{w()}</{w()}>"),
    ]
    mine = [x for x in every if x[0] == notation]
    of, s = r.choice(mine if mine and r.random() < 0.5 else every)
    return s, MARKUP if of == notation else PLAIN


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]], int]]:
    """Seeded pages: (text, [(start, end, label)], notation)."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        text, spans = "", []
        notation = r.randrange(len(NOTATIONS))
        wrap = r.random() < (0.6 if NOTATIONS[notation] == "html" else 0.05)
        if wrap:
            text = "<div>"
            spans.append((0, 5, MARKUP))
        for _ in range(r.randint(1, 7)):
            if r.random() < 0.12:
                frag, label = _doubtful(r, NOTATIONS[notation])
            else:
                frag, label = _fragments(r, notation)
            spans.append((len(text), len(text) + len(frag), label))
            text += frag + r.choice([" ", " ", "\n", "\n\n"])
        if wrap:
            spans.append((len(text), len(text) + 6, MARKUP))
            text += "</div>"
        pages.append((text, spans, notation))
    return pages


@lru_cache(maxsize=1)
def model() -> TreeModel:
    """The model trained on the seeded pages; every process makes the same one."""
    return TreeModel().fit(labelled_pages(TRAIN_PAGES))


def kinds_of(text: str | None) -> list[str]:
    """The kinds of markup in a text, sorted."""
    return analyse(text)[1]


# --- rendering ----------------------------------------------------------------------------------

_SPACES = re.compile(r"(?<=[^\n \t\u00a0\u202f])[ \t\u00a0\u202f]+")
_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "title": 1}
_SILENT = {"label", "ref", "cite", "usepackage", "documentclass", "vspace", "hspace", "pagestyle", "bibliography", "includegraphics"}


class _Writer:
    """Turns labelled nodes into text; knows the lists and tables it is in."""

    def __init__(self) -> None:
        self.lists: list[list] = []  # [ordered, number]
        self.tables: list[list] = []  # [rows, cells of the row, row open]

    def _item(self) -> str:
        if not self.lists:
            return "- "
        ordered, k = self.lists[-1]
        self.lists[-1][1] = k + 1
        return "  " * (len(self.lists) - 1) + (f"{k}. " if ordered else "- ")

    def _end_row(self) -> str:
        if not self.tables or not self.tables[-1][2]:
            return ""
        table = self.tables[-1]
        table[0] += 1
        table[2] = False
        return " |" + ("\n|" + " --- |" * table[1] if table[0] == 1 else "")

    def tag(self, n: Node, s: str) -> str:
        name, close = n.name, s.startswith("</")
        if name in ("script", "style"):
            return ""
        if name == "br":
            return " " if self.tables and self.tables[-1][2] else "\n"
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            return "\n\n" if close else "\n\n" + "#" * int(name[1]) + " "
        if name in ("ul", "ol"):
            if close:
                if self.lists:
                    self.lists.pop()
            else:
                start = re.search(r"""(?i)\bstart\s*=\s*["']?(\d{1,9})""", s)
                self.lists.append([name == "ol", int(start[1]) if start else 1])
            return "\n" if len(self.lists) == (not close) else ""
        if name == "li":
            return "" if close else "\n" + self._item()
        if name == "table":
            if close:
                end = self._end_row()
                if self.tables:
                    self.tables.pop()
                return end + "\n\n"
            self.tables.append([0, 0, False])
            return "\n\n"
        if name == "tr":
            end = self._end_row()
            if not close:
                if not self.tables:
                    self.tables.append([0, 0, False])
                self.tables[-1][1:] = [0, True]
                return end + "\n|"
            return end
        if name in ("td", "th"):
            if close or not self.tables:
                return ""
            self.tables[-1][1] += 1
            return " " if self.tables[-1][1] == 1 else " | "
        if name == "blockquote":
            return "\n" if close else "\n> "
        if name == "pre":
            return "\n```\n"
        if name == "code":
            return "" if n.parent is not None and n.parent.name == "pre" else "`"
        if self.tables and self.tables[-1][2] and name in BLOCKS:
            return " "
        if name == "p" and not close and n.parent is not None and n.parent.name == "li":
            return ""
        return "\n\n" if name in BLOCKS else ""

    def open(self, n: Node, s: str) -> str:
        """What a markup element that is looked into leaves before its content."""
        if n.type == "command" and n.name in _LEVELS:
            return "\n\n" + "#" * _LEVELS[n.name] + " "
        return ""

    def close(self, n: Node) -> str:
        return "\n\n" if n.type == "command" and n.name in _LEVELS else ""

    def leaf(self, n: Node, s: str) -> str:
        """What a markup node without content of its own leaves in the text."""
        t = n.type
        if t == "tag":
            return self.tag(n, s)
        if t in ("comment", "escaped", "template"):
            return ""
        if t == "ref":
            return html.unescape(s)
        if t == "env":
            begin = s.startswith("\\begin")
            if n.name in LIST_ENVS:
                if begin:
                    self.lists.append([n.name == "enumerate", 1])
                elif self.lists:
                    self.lists.pop()
                return ""
            return "\n```\n" if n.name in CODE_ENVS else "\n$$\n" if n.name in MATH_ENVS else ""
        if t == "item":
            return self._item()
        if t == "command":
            return s
        if t == "wlink":
            return ""
        if t == "whead":
            return "#" * max(1, len(re.match(r"\s*(=+)", s).group(1)) - 1) + " " + s.strip().strip("=").strip()
        if t == "mlist":
            return s if s.strip()[0].isdigit() else s[: len(s) - len(s.lstrip())] + "- "
        return s  # fences, inline code, headings, quotes, table rules and formulas are kept


def clean_text(text: str | None) -> str | None:
    """The readable text with headings, lists, tables, code and formulas in one notation."""
    return analyse(text)[0]


_HIDDEN_LINK = re.compile(r"(?i)\[\[(?:category|kategorie|categoría|catégorie|file|image|datei)\s*:")


def analyse(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, kinds of markup)."""
    if not text:
        return text, []
    if not _SIGNS.search(text):
        return _tidy(text), []
    order = model().label(parse(text))
    kinds = sorted({KIND[n.type] for n in order[1:] if n.label == MARKUP})
    # (start, end, node, whether it opens): elements that are looked into give two parts
    parts: list[tuple[int, int, int, Node]] = []
    for n in order[1:]:
        if n.inner is None:
            parts.append((n.start, n.end, 0, n))
        elif n.type == "wlink" and n.label == MARKUP and _HIDDEN_LINK.match(text, n.start):
            parts.append((n.start, n.end, 0, n))
        elif n.type == "command" and n.label == MARKUP and n.name in _SILENT:
            parts.append((n.start, n.end, 3, n))
        else:
            parts += [(n.start, n.inner[0], 1, n), (n.inner[1], n.end, 2, n)]
    parts.sort(key=lambda p: (p[0], p[1]))
    write = _Writer()
    out, at, hidden = [], 0, False
    for start, end, part, n in parts:
        if start < at:
            continue
        if not hidden:
            out.append(text[at:start])
        s = text[start:end]
        if n.type == "tag" and n.name in ("script", "style") and n.label == MARKUP:
            hidden = not s.startswith("</")
        if hidden or part == 3:
            pass
        elif n.label == MARKUP:
            out.append(write.leaf(n, s) if part == 0 else write.open(n, s) if part == 1 else write.close(n))
        elif n.label == CODE and n.type == "ref":
            out.append(html.unescape(s))
        else:
            out.append(s)
        at = end
    if not hidden:
        out.append(text[at:])
    return _tidy("".join(out)), kinds


_FENCED = re.compile(r"(^```[^\n]*\n.*?(?:^```[ \t]*$|\Z))", re.M | re.S)
_UNSEEN = re.compile(r"[\u200b\u200c\u200d\u2060\ufeff]")
_LEAD = re.compile(r"^[ \t\u00a0\u202f]++(?!(?:[-*+]|\d{1,9}[.)])[ \t])", re.M)
_TRAIL = re.compile(r"(?<=[^\n \t\u00a0\u202f])[ \t\u00a0\u202f]+$|^[ \t\u00a0\u202f]+$", re.M)
_UNTIDY = re.compile(r"[ \t\u00a0\u202f][ \t\u00a0\u202f\n]|\n[ \n\t\u00a0\u202f]|[\t\u00a0\u202f\u200b\u200c\u200d\u2060\ufeff]")
_GAPS = re.compile(r"\n{3,}")


def _tidy(text: str) -> str:
    """Invisible characters and superfluous white space go, outside code; the indent of list items stays."""
    if not _UNTIDY.search(text):
        return text.strip()
    parts = _FENCED.split(text) if "```" in text else [text]
    for i in range(0, len(parts), 2):
        p = _UNSEEN.sub("", parts[i])
        p = _SPACES.sub(" ", p)
        p = _LEAD.sub("", _TRAIL.sub("", p))
        parts[i] = _GAPS.sub("\n\n", p)
    return "".join(parts).strip()


# --- DataFrames ---------------------------------------------------------------------------------


def source_texts(entries: DataFrame, conversations: DataFrame) -> DataFrame:
    """(origin, record_key, item, text) of all html items and turns that are not null."""
    a = entries.select(F.lit("raw_entries").alias("origin"), F.col("entry_id").cast("string").alias("record_key"), F.posexplode("safeHtmlItem").alias("item", "t"))
    b = conversations.select(F.lit("conversations").alias("origin"), F.col("chat_id").alias("record_key"), F.explode("turns").alias("t"))
    a = a.select("origin", "record_key", F.col("item").cast("bigint").alias("item"), F.col("t.html").alias("text"))
    b = b.select("origin", "record_key", F.col("t.turn_index").cast("bigint").alias("item"), F.col("t.text").alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull())


def cleaned(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``clean`` and ``kinds`` (array<string>, empty where there is no markup) to ``df``."""
    names = df.columns
    at = names.index(text)
    df = spread(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            done = [analyse(t) for t in texts]
            arrays = [pa.array([c for c, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*names, "clean", "kinds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, clean string, kinds array<string>")


def found_kinds(entries: DataFrame, conversations: DataFrame) -> DataFrame:
    """(origin, record_key, item, kind): one row per text and kind of markup in it."""
    rows = cleaned(source_texts(entries, conversations))
    return rows.select("origin", "record_key", "item", F.explode("kinds").alias("kind")).distinct()
