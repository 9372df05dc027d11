"""Markup: exact marginals, held-out pages, surroundings, length, structure, hostile input."""

import time
from itertools import product

import numpy as np
import pytest

from gistmap.llm import markup


def test_marginals_equal_enumeration():
    m = markup.model()
    root = markup.parse("a **b** <code>x &lt; y</code> ''12''")
    order = m.label(root)
    got = [n.label for n in order[1:]]
    total = np.zeros((len(order), 3))
    at = {id(n): i for i, n in enumerate(order)}
    for top in range(len(markup.NOTATIONS)):
        for labels in product(range(3), repeat=len(order) - 1):
            p = np.exp(m.prior[top])
            for i, n in enumerate(order[1:]):
                up = top if n.parent is root else labels[at[id(n.parent)] - 1]
                p *= m.own(n)[labels[i]] * m.edge(markup._edge(n.parent, n))[up][labels[i]]
            for i, v in enumerate(labels, 1):
                total[i, v] += p
    assert got == total.argmax(axis=1)[1:].tolist()


def test_messages_lower_the_error_on_held_out_pages():
    n = wrong = alone = 0
    for text, spans, _ in markup.labelled_pages(300, seed=99):
        for x in markup.model().label(markup.parse(text))[1:]:
            want = next((label for a, b, label in spans if a <= x.start < b), markup.PLAIN) == markup.PLAIN
            n += 1
            wrong += (x.label == markup.PLAIN) != want
            alone += (max(range(3), key=lambda i: markup.model().own(x)[i]) == markup.PLAIN) != want
    print(n, wrong, alone)
    assert wrong / n < 0.03 and wrong < 0.9 * alone


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("''12''", []), ("''12'' [[a|b]] {{x}}", ["wiki"]), ("== Use (v2); ==\n\n[[link]] and '''b'''", ["wiki"]), ("the \\alpha value", ["latex"]), ("C:/\\alpha", []),
    ],
)
def test_surroundings_decide(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_same_signs_read_by_their_surroundings():
    assert markup.clean_text("''12'' here") == "''12'' here"
    assert markup.clean_text("[[a|b]] {{x}} ''12'' here") == "b 12 here"


@pytest.mark.parametrize(
    "text, kind",
    [
        ("$" + "x^2 + " * 200 + "y$", "latex"), ("[[" + "x" * 900 + "]]", "wiki"), ("**" + "word " * 300 + "end**", "markdown"), ("`" + "a" * 900 + "`", "markdown"), ("{{" + "w " * 900 + "}}", "wiki"),
        ("'''" + "word " * 300 + "end'''", "wiki"), ("[" + "word " * 300 + "](https://x.example/a)", "markdown"), ("[a](https://x.example/" + "b" * 2_000 + ")", "markdown"), ("x\n" + " " * 40 + "- item", "markdown"),
    ],
)
def test_elements_of_any_length(text, kind):
    assert kind in markup.kinds_of(text)


@pytest.mark.parametrize(
    "text, clean",
    [
        ("- a\n  - b\n    - c", "- a\n  - b\n    - c"), ("<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>", "1. a\n  - b\n2. c"), ('<ol start="4"><li>a<li>b</ol>', "4. a\n5. b"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("\\textbf{a \\emph{b} c}", "a b c"), ("{{a|{{b}}|c}}x", "x"), ("a **b *c* d** e", "a b c d e"), ("[**x**](http://u.v/(a)b)", "x"), ("\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}", "1. a\n2. b"),
        ("\\section{A}b", "# A\n\nb"), ("== A ==\n[[b|c]]", "# A\nc"), ("<h2>T</h2><pre><code>a &lt; b\n  c</code></pre>", "## T\n\n```\na < b\n  c\n```"), ("$$\\frac{a}{b}$$ and \\(x\\)", "$$\\frac{a}{b}$$ and \\(x\\)"),
    ],
)
def test_structure_is_kept(text, clean):
    assert markup.clean_text(text) == clean


@pytest.mark.parametrize("s", ["*a " * 60_000, "{{" * 60_000, "[[a" * 60_000, "\\(" * 60_000, "<a " * 60_000, "''a " * 60_000, "$a " * 60_001, "<b>" * 20_000, "\\x{" * 30_000, "```\n" * 20_001, "![a](" * 30_000])
def test_hostile_markup_is_near_linear(s):
    t = time.time()
    markup.analyse(s)
    assert time.time() - t < 8
