"""Visible text where tags are implied or content stands in unusual places."""

import random

from logloom.llm.html_text import page_text


def test_an_open_head_ends_where_the_content_begins():
    assert page_text("<head><title>T</title><h1>one</h1><p>two").split() == ["one", "two"]
    assert page_text("<head><meta charset=utf-8><title>T</title>\n<style>p{}</style> bare text<p>two").split() == ["bare", "text", "two"]
    assert page_text("<html><head><title>T</title></head><body>x").split() == ["x"]


def test_content_of_table_sections_outside_rows_stays():
    html = "<table><thead>h<tbody>loose<div>block</div><tr><td>a<td>b</tr></tbody><tbody hidden>no</tbody></table>"
    assert page_text(html).split() == ["h", "loose", "block", "a", "b"]


def test_formulas_are_text():
    assert page_text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == "so x=2 holds"


SHOWS = ["", "", "", "", " hidden", ' style="display:none"', ' style="visibility:hidden"', ' style="color:red; visibility: visible"']


def made_page(rng, deep):
    """A page of nested elements with the words that are visible, by rules of its own."""
    parts, shown, word = [], [], 0
    stack = []  # (tag, out of the layout, invisible)
    for _ in range(deep * 3):
        gone, unseen = stack[-1][1:] if stack else (False, False)
        step = rng.random()
        if step < 0.45 and len(stack) < deep:
            tag, show = rng.choice(["div", "section", "blockquote", "span", "article"]), rng.choice(SHOWS)
            parts.append(f"<{tag}{show}>")
            gone = gone or show == " hidden" or "none" in show
            unseen = True if "visibility:hidden" in show else False if "visible" in show else unseen
            stack.append((tag, gone, unseen))
        elif step < 0.6 and stack:
            parts.append(f"</{stack.pop()[0]}>")
        else:
            word += 1
            parts.append(f" w{word} ")
            if not gone and not unseen:
                shown.append(f"w{word}")
    return "".join(parts), shown


def test_visible_words_match_a_plain_walk_at_any_depth():
    rng = random.Random(4)
    for deep in [3, 10, 60, 300, 4000] * 6:
        html, shown = made_page(rng, deep)
        assert page_text(html).split() == shown


def test_hidden_text_stays_hidden_in_very_deep_pages():
    for deep in (117, 118, 50_000):
        assert page_text("<div>" * deep + "<p hidden><b>secret</b></p>shown") == "shown"
        assert page_text("<blockquote>" * deep + "<i style='visibility:hidden'>secret</i>shown").strip() == "shown"


def plain_table(rows):
    """Lines of rows of (word, columns, rows), placed cell by cell in a set of taken places."""
    taken, placed = set(), []
    for r, row in enumerate(rows):
        column = 0
        for word, columns, deep in row:
            while (r, column) in taken:
                column += 1
            taken |= {(y, x) for y in range(r, min(r + deep, len(rows))) for x in range(column, column + columns)}
            placed.append((r, column, columns, word))
            column += columns
    wide = {c: max([len(w) for _, x, n, w in placed if x == c and n == 1], default=0) for _, c, _, _ in placed}
    left = {c: sum(wide[x] + 2 for x in wide if x < c and wide[x]) for c in wide}
    lines = []
    for r in range(len(rows)):
        line = ""
        for _, column, _, word in sorted(p for p in placed if p[0] == r):
            line += " " * max(left[column] - len(line), 1 if line else 0) + word
        lines.append(line)
    return [line for line in lines if line]


def test_cells_that_span_rows_and_columns():
    assert page_text("<table><tr><td rowspan=2>A<td>B<tr><td>C<td>D</table>").split("\n") == ["A  B", "   C  D"]
    assert page_text("<table><tr><td colspan=99999>x<td>y<tr><td>a<td>b</table>").split("\n") == ["x     y", "a  b"]
    rng = random.Random(6)
    for _ in range(300):
        rows = [[(f"{r}x{c}" + "z" * rng.randrange(6), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3, 9])) for c in range(rng.randrange(1, 5))] for r in range(rng.randrange(1, 7))]
        rows[0].append(("end", 1, 1))
        html = "".join("<tr>" + "".join(f"<td colspan={c} rowspan={r}>{w}" for w, c, r in row) for row in rows)
        assert page_text(f"<table>{html}</table>").split("\n") == plain_table(rows)


def test_long_cells_do_not_multiply_blanks():
    page = "<table><tr><td>" + "long " * 5000 + "<td>x" + "<tr><td>a<td>b" * 5000
    found = page_text(page)
    assert len(found) < 3 * len(page) and found.split() == ["long"] * 5000 + ["x"] + ["a", "b"] * 5000


def test_of_several_declarations_the_last_holds():
    shown = ["display:none;display:block", "visibility:hidden; visibility: visible", "visibility:hidden;visibility:bogus;visibility:visible", "color:red", "display:none /* no */; display:inline", "x-display:none", "display:none;display:block !important", "visibility:visible!important;visibility:hidden"]
    for style in shown:
        assert page_text(f'<p style="{style}">word</p>') == "word", style
    for style in ["display:block;display:none", "visibility:visible;visibility:hidden", "DISPLAY : NONE", "display:none!important;display:block", "visibility:collapse", "/* x */display:none", "visibility:hidden;visibility:bogus"]:
        assert page_text(f'<p style="{style}">word</p>') == "", style
    assert page_text("<div style='visibility:hidden;display:none'>a<b style='visibility:visible'>b</b></div>c") == "c"


STYLES = ["display:none", "display:block", "visibility:hidden", "visibility:visible", "visibility:inherit", "color:red", "display:none !important"]


def test_visible_words_under_any_declarations():
    """A plain walk with its own reading of declarations: the last of the most important ones holds."""
    rng = random.Random(12)
    for _ in range(150):
        parts, shown, stack = [], [], [(False, False)]
        for word in range(60):
            if rng.random() < 0.5 and len(stack) < 12:
                declarations = [rng.choice(STYLES) for _ in range(rng.randrange(4))]
                gone, unseen = stack[-1]
                for name in ("display", "visibility"):
                    own = [d for d in declarations if d.startswith(name)]
                    own = [d for d in own if "important" in d] or own
                    if own and name == "display":
                        gone = gone or "none" in own[-1]
                    elif own and "inherit" not in own[-1]:
                        unseen = "hidden" in own[-1]
                parts.append(f'<div style="{"; ".join(declarations)}">')
                stack.append((gone, unseen))
            elif rng.random() < 0.3 and len(stack) > 1:
                stack.pop()
                parts.append("</div>")
            parts.append(f" w{word} ")
            if stack[-1] == (False, False):
                shown.append(f"w{word}")
        assert page_text("".join(parts)).split() == shown


def test_labels_of_drawings_are_text():
    drawing = "<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><g><text x=1>North<tspan> gate</tspan></text><text>South</text></g></svg>"
    assert page_text(f"<p>before {drawing} after</p>").split() == ["before", "North", "gate", "South", "after"]
