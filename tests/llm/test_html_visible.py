"""Visible text of pages against trees whose visible words are known."""

import random
import re

import pytest

html_render = pytest.importorskip("helixloom.llm.html_render")
render = html_render.render


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>area <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation encoding='t'>x+1 tex</annotation></math> end</p>", "area x+1 end"),
        ("a<svg width=9><title>no</title><defs><text>no</text></defs><rect x=1 /><text x=1>label <tspan>one</tspan></text>stray<desc>no</desc><text>two</text></svg>b", "a\nlabel one\ntwo\nb"),
        ("<svg><foreignObject><p>inside</p><svg><g>no</g><text>t</text></svg></foreignObject>no</svg>", "inside\n\nt"),
        ("<svg><text/>no</svg>yes", "yes"),
        ("pick <select><option>one<option selected>two</select> now", "pick two now"),
        ("<select><optgroup label=g><option value=1>first<option>second</optgroup></select>", "first"),
        ("<select><option label='short'>long text</select>", "short"),
        ("<select></select>x", "x"),
        ("<select multiple><optgroup label=Group><option>one<option>two</select>", "Group\none\ntwo"),
        ("<select size=3><option>one<option>two</select>", "one\ntwo"),
        ("<select style='display:none'><option>one</select>x<select hidden><option>y</select>", "x"),
        ("<input type=submit value='Send it'> <input type=hidden value=no> <input value=typed> <input type=password value=no> <input type=image alt=Go>", "Send it typed Go"),
        ("<button>Press</button> <textarea>typed &amp; kept</textarea>", "Press typed & kept"),
        ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> <select><option>no</select></p>", "yes"),
        ("<dialog>no</dialog><dialog open>yes</dialog><details><summary>head</summary>no</details><details open><summary>h2</summary>body</details>", "yes\nhead\nh2\nbody"),
        ("<table><tr><td colspan=2>wide</td></tr><tr><td>a</td><td>日本</td><td>x</td></tr></table>", None),
    ],
)
def test_visible(html, want):
    got = render(html)
    if want is not None:
        assert re.sub(r"[ \t]+\n", "\n", got).strip() == want
    else:
        assert [line.split() for line in got.split("\n")] == [["wide"], ["a", "日本", "x"]]


UNSEEN = ["script", "style", "template", "noscript", "object", "video", "datalist"]
BLOCKS = ["div", "p", "section", "blockquote", "h2", "figure", "ul", "pre"]
INLINE = ["b", "i", "span", "a", "em", "code", "label", "button"]


class Page:
    """A random page and its visible words in order."""

    def __init__(self, seed):
        self.r, self.n, self.words, self.out = random.Random(seed), 0, [], []

    def word(self, seen):
        self.n += 1
        self.out.append(f" w{self.n} ")
        if seen:
            self.words.append(f"w{self.n}")

    def inline(self, seen, depth):
        for _ in range(self.r.randint(1, 3)):
            x = self.r.random()
            if x < 0.5 or depth > 6:
                self.word(seen)
            elif x < 0.62:
                tag = self.r.choice(INLINE)
                style, now = self.r.choice([("", seen), ("", seen), (" hidden", False), (" style='color: red; display:none'", False), (" style='visibility: hidden'", None)])
                self.out.append(f"<{tag}{style}>")
                if now is None:
                    self.word(False)
                else:
                    self.inline(now, depth + 1)
                self.out.append(f"</{tag}>")
            elif x < 0.7:
                self.out.append(f"<{(tag := self.r.choice(UNSEEN))}>")
                self.word(False)
                self.out.append(f"</{tag}>")
            elif x < 0.78:
                self.out.append("<math><mrow><mi>")
                self.word(seen)
                self.out.append("</mi></mrow><annotation>")
                self.word(False)
                self.out.append("</annotation></math>")
            elif x < 0.86:
                self.out.append("<svg><path d='M0' /><g>")
                self.word(False)
                self.out.append("<text><tspan>")
                self.word(seen)
                self.out.append("</tspan></text></g><symbol><text>")
                self.word(False)
                self.out.append("</text></symbol></svg>")
            elif x < 0.94:
                count, pick = self.r.randint(1, 4), self.r.randint(0, 3)
                self.out.append("<select>")
                for k in range(count):
                    self.out.append(f"<option{' selected' if k == pick else ''}>")
                    self.word(seen and k == (pick if pick < count else 0))
                self.out.append("</select>")
            else:
                kind = self.r.choice(["submit", "text", "hidden", "password"])
                self.n += 1
                self.out.append(f"<input type={kind} value='w{self.n}'>")
                if seen and kind in ("submit", "text"):
                    self.words.append(f"w{self.n}")

    def block(self, seen, depth):
        for _ in range(self.r.randint(1, 3)):
            x = self.r.random()
            if depth > 4 or x < 0.3:
                self.out.append("<p>")
                self.inline(seen, depth)
            elif x < 0.5:
                self.out.append("<ul>")
                for _ in range(self.r.randint(1, 3)):
                    self.out.append("<li>")
                    self.inline(seen, depth + 1)
                self.out.append("</ul>")
            elif x < 0.65:
                self.out.append("<table>")
                for _ in range(self.r.randint(1, 3)):
                    self.out.append("<tr>")
                    for _ in range(self.r.randint(1, 3)):
                        self.out.append("<td>")
                        self.word(seen)
                self.out.append("</table>")
            else:
                tag = self.r.choice([b for b in BLOCKS if b not in ("p", "ul", "h2", "pre")])
                gone = self.r.random() < 0.15
                self.out.append(f"<{tag}{' hidden' if gone else ''}>")
                self.block(seen and not gone, depth + 1)
                self.out.append(f"</{tag}>")


@pytest.mark.parametrize("seed", range(150))
def test_words_of_random_pages(seed):
    page = Page(seed)
    page.block(True, 0)
    assert re.findall(r"w\d+", render("".join(page.out))) == page.words


def test_table_of_pages(spark):
    big = (1 << 53) + 1
    rows = [(big, "<p>x <math><mi>y</mi></math>", "a"), (None, None, "b"), (big, "", "c"), (big, "<p>x <math><mi>y</mi></math>", "a"), (2, "<select><option>" + "o" * 300_000, "d")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").withColumnRenamed("text", "k0")
    got = html_render.extract_text(df).collect()
    assert sorted(((r.page_id, r.k0, r.text) for r in got), key=str) == sorted([(big, "a", "x y"), (None, "b", None), (big, "c", ""), (big, "a", "x y"), (2, "d", "o" * 300_000)], key=str)
    assert html_render.extract_text(df.limit(0)).count() == 0
