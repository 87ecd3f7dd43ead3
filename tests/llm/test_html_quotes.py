import pytest

from lakequill.llm.html_text import main_text

PROSE = "This paragraph has a good length, some commas, and says what an article says in its own words."


@pytest.mark.parametrize(("page", "text"), [
    (f'<article><p class="a"">{PROSE}</p><p class="b">kept</p></article>', f"{PROSE} kept"),
    (f"<article><p title=it's>{PROSE}</p><p>and the rest</p></article>", f"{PROSE} and the rest"),
    (f'<article><p " class=b>{PROSE}</p><p \'>kept</p></article>', f"{PROSE} kept"),
    (f'<article><p><a href=/x?q="y>{PROSE}</a></p><p>some more words</p></article>', f"{PROSE} some more words"),
    (f'<article><p title=x"hidden>{PROSE}</p></article>', PROSE), (f'<article><p ="a>{PROSE}</p></article>', PROSE),
    (f'<article><p title==">{PROSE}</p></article>', PROSE), (f"<article><p title=>{PROSE}</p></article>", PROSE),
    (f'<article><p title = "a>b" lang=\'c>d\'>{PROSE}</p></article>', PROSE), (f"<article><p class='x'id='y'>{PROSE}</p></article>", PROSE),
    (f'<article><p>{PROSE}</p><p title="never closed>lost</p></article>', PROSE), (f"<article><p>{PROSE}</p><p/title/>kept</p></article>", f"{PROSE} kept"),
])
def test_quotes_in_tags(page, text):
    assert main_text(page) == text


def test_tags_are_read_in_one_pass():
    assert main_text("<p " + "a= \"' " * 50_000) == ""
