import pytest

from loam.llm import markup as M


@pytest.mark.parametrize(
    "text, want",
    [
        ("<p>Hi <b>there</b></p>", ["html"]), ("a&nbsp;b", ["html"]), ("x<BR />\ny", ["html"]),
        ("# Head\n\ntext", ["markdown"]), ("see [x](y.md)", ["markdown"]), ("Title\n=====\n\ntext", ["markdown"]), ("- [ ] todo", ["markdown"]), ("| a | b |\n|---|:-:|\n| 1 | 2 |", ["markdown"]), ("a **bold** word", ["markdown"]),
        ("```\n<p>x</p>\n[[no]]\n```", ["markdown"]), ("== Head ==\n\n'''b''' [[Link|text]]\n* one\n# two", ["wiki"]), ("{{Infobox x\n| a = 1\n}}", ["wiki"]), ("{| class=\"wikitable\"\n|-\n| 1\n|}", ["wiki"]),
        ("\\section{A} text", ["latex"]), ("so $x_{7} \\leq 3$ holds", ["latex"]), ("\\(a+b\\)", ["latex"]), ("# H\n\n$x^2$ and <i>y</i>", ["html", "latex", "markdown"]),
        ("It cost $77 in spring and $654 in autumn, about 5*8*4 cm, tag #sky #26.", []), ("to: <ann at home>", []), ("call x with Vec<u8> & Map<String, i64> [7]", []), ("if a < b and c > d", []),
        ("fn f(v: &[u64]) -> Vec<u64> {\n    v.iter().filter(|v| **v < cap).copied()\n}", []), ("# note\ndef f(x):\n    return x[3:]  # more\n\n# alone", []), ('{"a": [[1, 2]], "b": "x"}', []), ("id,name\n1,\"a, b\"", []), ("C:\\work\\notes\\x.md", []), ("2025-01-01 12:00:01 INFO merge: hits=3", []), ("", []),
    ],
)
def test_languages(text, want):
    assert M.languages(text) == want


def test_html_text():
    got = M.to_plain("<html><head><title>T</title><style>p{}</style></head><body><h2>Head</h2><p>One &amp; two<br>three</p><ul><li>a</li><li>b</li></ul><table>\n<tr><th>x</th><th>y</th></tr>\n<tr><td>1</td><td>2</td></tr>\n</table><pre><code>if (a &lt; b) {}</code></pre><ol><li>q</li></ol></body></html>", ["html"])
    assert got == "T\n\n## Head\n\nOne & two\nthree\n\n- a\n- b\n\nx | y\n1 | 2\n\n```\nif (a < b) {}\n```\n\n1. q"
    assert M.html_text("a < b <i>c</i> Vec<u8>") == "a < b c Vec<u8>"


def test_markdown_text():
    got = M.to_plain("Title\n===\n\n**Bold** and _thin_ [link](u) ![pic](p.png) `code`\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> quote\n\n* x\n+ y\n\n```\n**kept** [k](k)\n```\n$x_1$", ["markdown"])
    assert got == "# Title\n\nBold and thin link pic code\n\na | b\n1 | 2\n\nquote\n\n- x\n- y\n\n```\n**kept** [k](k)\n```\n$x_1$"


def test_wiki_text():
    got = M.to_plain("== Head ==\n'''B''' ''i'' [[A|b]] [[c]] [[Category:x]]\n\n{| class=\"w\"\n! h1 !! h2\n|-\n| 1 || 2\n|}\n* a\n** b\n{{Infobox t\n| size = 5\n}}", ["wiki"])
    assert got == "## Head\nB i b c\n\nh1 | h2\n1 | 2\n- a\n  - b\nInfobox t\nsize = 5"


def test_latex_text():
    got = M.to_plain("\\documentclass{article}\n\\begin{document}\n\\section{Head} Text \\emph{x \\textbf{y}} 5\\%.\n\\begin{itemize}\n\\item one\n\\end{itemize}\n$$ x_{7} \\leq \\sqrt{9} $$\n\\begin{tabular}{ll}\na & b \\\\\n1 & 2 \\\\\n\\end{tabular}\n\\begin{verbatim}\n\\emph{raw}\n\\end{verbatim}\n\\end{document}", ["latex"])
    assert "# Head" in got and "Text x y 5%." in got and "- one" in got and "$$ x_{7} \\leq \\sqrt{9} $$" in got and "a | b\n1 | 2" in got and "```\n\\emph{raw}\n```" in got


def test_table(spark):
    rows = spark.createDataFrame([(1, "<p>x</p>", "m"), (2, None, "m"), (3, "", "m"), (4, "plain", "m"), (5, "word " * 100_000 + "<b>z</b>", "m")], "file_id long, content string, markup string")
    got = {r.file_id: (r.markup, r.content) for r in M.converted(rows).collect()}
    assert got[1] == (["html"], "x") and got[2] == ([], None) and got[3] == ([], "") and got[4] == ([], "plain") and got[5][1].endswith(" z")
    assert M.converted(rows.limit(0)).count() == 0
