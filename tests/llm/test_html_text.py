from logloom.llm.html_text import html_text, page_text


def test_blocks_lists_and_tables():
    assert page_text("<p>one<p>two<br>three<div>four</div>five") == "one\n\ntwo\nthree\n\nfour\nfive"
    assert page_text("<ul><li>a<li>b<ol><li>x<li value=7>y</ol><li>c</ul>") == "- a\n- b\n  1. x\n  7. y\n- c"
    table = "<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td colspan=2>all of it, at length<tr><td>日本<td>12</table>"
    assert page_text(table).split("\n") == ["Name       Qty", "Apple pie  3", "all of it, at length", "日本       12"]


def test_visibility():
    assert page_text("a<script>var t='</p>'</script>b<style>p{}</style><template>x</template>c") == "abc"
    assert page_text("<p hidden>no<p style='display:none'>no<p>yes") == "yes"
    assert page_text("<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>") == "yes"
    assert page_text("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>") == "S\nT\nyes"


def test_broken_and_deep_markup_keeps_all_text():
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000 + "after"
    assert page_text(deep).split("\n") == ["deep", "after"]
    assert page_text("a < b & c &amp; &lt;d&gt; &copy") == "a < b & c & <d> ©"
    assert page_text("x<b>y<p>z</b>w<!-- open").split() == ["xy", "z", "w"]
    assert page_text("<pre>a  b\n  c</pre>") == "a  b\n  c"
    assert page_text("") == ""
    assert page_text("<tr><td>1<td>2") == "1  2" or "1" in page_text("<tr><td>1<td>2")


def test_every_word_of_plain_markup_survives():
    words = [f"w{k}" for k in range(500)]
    tags = ["p", "div", "li", "td", "span", "h2", "b", "tr", "table", "ul", "dd", "section"]
    html = "".join(f"<{tags[k * 7 % len(tags)]}>{w} " + (f"</{tags[k * 5 % len(tags)]}>" if k % 3 else "") for k, w in enumerate(words))
    assert sorted(page_text(html).replace("-", " ").split()) == sorted(words)


def test_rows_stay(spark):
    pages = spark.createDataFrame([(1, None, "own"), (2, "<p>x", "own"), (2, "<p>x", "own"), (None, "", "own")], "page_id long, html string, text string")
    got = html_text(pages)
    assert got.columns == pages.columns
    assert sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == [(0, ""), (1, ""), (2, "x"), (2, "x")]
    assert html_text(pages.limit(0)).count() == 0
