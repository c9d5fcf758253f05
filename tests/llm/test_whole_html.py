"""HTML: slots are the output, and no article text is lost."""

from lodestone.llm import html_extract

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def body(i, n=30):
    return " ".join(f"{WORDS[(i * k) % 8]}{i}{k}" for k in range(1, n))


def test_repeated_block_in_article():
    note = '<div class="teaser"><p>Read our other stories and win our prize</p></div>'
    pages = [f"<html><body><article><h1>Title {i}</h1><p>{body(i)}</p>{note if i % 4 else ''}<p>{body(i + 50)}</p></article></body></html>" for i in range(12)]
    assert html_extract.extract_chunk(pages) == [f"Title {i} {body(i)} {body(i + 50)}" for i in range(12)]


def test_near_copies_keep_their_article():
    pages = [f"<html><body><article><h1>Same title</h1><p>{body(1)}</p><p>changed {i}</p></article></body></html>" for i in range(6)]
    assert html_extract.extract_chunk(pages) == [f"Same title {body(1)} changed {i}" for i in range(6)]


def test_marked_wrapper_keeps_its_article():
    page = '<html><body><div class="page has-sidebar"><article><h1>Title {0}</h1><p>{1}</p><div class="related"><article><p>Other {0}</p></article></div></article><div class="sidebar">Side {0}</div></div></body></html>'
    pages = [page.format(i, body(i)) for i in range(8)]
    for chunk in (pages, pages[:1]):
        assert html_extract.extract_chunk(chunk) == [f"Title {i} {body(i)}" for i in range(len(chunk))]


def test_marked_element_with_most_text():
    pages = [f'<html><body><div class="search">Find {i}</div><div class="widget post"><p>{body(i)}</p></div></body></html>' for i in range(8)]
    assert html_extract.extract_chunk(pages) == [body(i) for i in range(8)]


def test_title_and_lede_beside_a_long_body():
    page = '<html><body><div class="top">Menu</div><div class="post"><h1>Title {0}</h1><div class="lede">Lede {0}</div><div class="body"><p>{1}</p><p>{2}</p></div></div></body></html>'
    pages = [page.format(i, body(i, 60), body(i + 9, 60)) for i in range(8)]
    assert html_extract.extract_chunk(pages) == [f"Title {i} Lede {i} {body(i, 60)} {body(i + 9, 60)}" for i in range(8)]
