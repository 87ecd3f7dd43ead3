import pytest
from pyspark.sql import functions as F

from lakequill.llm.html_text import extracted, main_text

PROSE = "This paragraph has a good length, some commas, and says what an article says in its own words."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a b"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{PROSE}</p><p>short</p></article><footer>&copy; x</footer>", f"T {PROSE} short"),
    (f"<article><p><b>{PROSE}<br><p>two</p></article><div class='ad'>buy</div>", f"{PROSE} two"),
    (f"<div id=sidebar><p>{PROSE}</p></div><div class=content><p>{PROSE} x</p><p>{PROSE} y</p></div>", f"{PROSE} x {PROSE} y"),
    (f"<main><p>{PROSE}</p><ul><li>one</li><li>two</li></ul><ul><li><a href=1>link</a></li><li><a href=2>other</a></li></ul></main>", f"{PROSE} one two link other"),
    (f"<article><p>{PROSE}</p><section class='comments'><p>{PROSE} I disagree, really, with all, of this, and more.</p></section></article>", PROSE),
    (f"<script>var a='<p>x</p>';</script><style>p{{}}</style><article><p>{PROSE}<script>if(a<b)c()</script> end</p><form><p>name</p></form></article>", f"{PROSE} end"),
    (f"<div class=cookie-notice><p>We use cookies, many, of them, for all, sorts of things, and you agree to it.</p></div><article><p>{PROSE}</p></article>", PROSE),
    (f"<article><p>{PROSE}</p><p>cut off in a tag <a hre", f"{PROSE} cut off in a tag"), (f"<article><p>{PROSE} &quo", f"{PROSE} &quo"),
    (f"<article><p>a\n  b&nbsp;c\t d</p><p>{PROSE}</p><!-- <p>no</p> --><p>&#233;&lt;&amp;lt;</p></article>", f"a b c d {PROSE} é<&lt;"),
    (f"<ARTICLE><P>{PROSE}</P><ASIDE>no</ASIDE></ARTICLE><HEADER>no</HEADER>", PROSE),
    (f"<article><header><h1>Title</h1></header><p>{PROSE}</p></article>", f"Title {PROSE}"),
    (f"<div><div><p>{PROSE}</p></div><div><p>{PROSE} 2</p></div></div>", f"{PROSE} {PROSE} 2"),
    (f"<table><tr><td>{PROSE}<td>{PROSE} b</table>", f"{PROSE} {PROSE} b"),
    (f"<article><p>1 < 2 and {PROSE}</p></article>", f"1 < 2 and {PROSE}"), (f'<article title="a>b"><p>{PROSE}</p></article>', PROSE),
    (f"<article><p style='display: none'>hidden words</p><p hidden>too</p><p>{PROSE}</p></article>", PROSE),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + PROSE + "</div>" * 5000) == PROSE
    long = " ".join(f"<p>{PROSE} {i}</p>" for i in range(3000))
    assert main_text(f"<article>{long}</article>") == " ".join(f"{PROSE} {i}" for i in range(3000))


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>"), (1, "u", f"<article><p>{PROSE}</p></article>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = sorted(map(tuple, extracted(df).collect()), key=str)
    assert got == sorted([(1, "u", PROSE, len(PROSE))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extracted(df.limit(0)).count() == 0
