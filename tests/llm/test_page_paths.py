"""Host paths: no text left beside them, any number of them, deep pages, names of furniture, and a slow twin of the vote."""

import tracemalloc
from collections import Counter, defaultdict

import pytest

from duelframe.llm import html_text

LEAD, BODY = "The lead says it in short words. " * 3, "The body tells the whole story at length. " * 14


def rows_of(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def texts(spark, pages):
    return {r.page_id: r.text for r in html_text.extract_main_text(rows_of(spark, pages)).collect()}


@pytest.mark.parametrize("name", [
    "user-comments", "reader-comments", "article-comments", "fb-comments", "comment-thread", "disqus_thread", "cookie-law-info", "adsense",
    "google-ads", "story-ads", "related-articles", "legal-notice", "userComments", "comments",
])
def test_furniture_beside_an_article(name):
    for attribute in ("class", "id"):
        page = f"<body><div class=post><p>{LEAD}</p><p>{BODY}</p></div><div {attribute}='{name}'><p>Nobody wants this here.</p></div></body>"
        assert html_text.main_text(page, None) == (LEAD + BODY).strip()
        page = f"<body><article><p>{LEAD}</p><div {attribute}='{name}'><p>Nobody wants this here.</p></div><p>{BODY}</p></article></body>"
        assert html_text.main_text(page, None) == (LEAD + BODY).strip()


@pytest.mark.parametrize("attribute", ["hidden", "hidden=''", "style='display:none'", "style=\"color:red; visibility: hidden\""])
def test_what_no_reader_sees(attribute):
    page = f"<body><div class=post><p>{LEAD}</p><div {attribute}><p>Nobody wants this here.</p></div><p>{BODY}</p></div></body>"
    assert html_text.main_text(page, None) == (LEAD + BODY).strip()
    page = f"<body><div {attribute}><article><p>{LEAD}</p></article></div></body>"
    assert html_text.main_text(page, None) == LEAD.strip()


@pytest.mark.parametrize("attributes", ["data-id='comments'", "data-class=sidebar", "title='a hidden thing'", "class='search-history'", "class='with-sidebar'"])
def test_what_is_no_furniture(attributes):
    page = f"<body><div class=post><p>{BODY}</p><div {attributes}><p>{LEAD}</p></div></div></body>"
    assert html_text.main_text(page, None) == (BODY + LEAD).strip()


def test_text_beside_the_path_of_the_host(spark):
    """A caption under the host's path, the story under another one: both are main text, as the other path wins wherever it stands."""
    plain = [(k, f"http://a.org/{k}", f"<body><div class=post><p>{BODY} {k}</p></div></body>") for k in range(5)]
    story = "<body><div class=post><p>A caption</p></div><div class=story><p>" + BODY + "</p></div></body>"
    assert texts(spark, [*plain, (9, "http://a.org/9", story)])[9] == "A caption " + BODY.strip()
    lead = f"<body><div class=wrap><p>{LEAD}</p><div class=post><p>{BODY}</p></div></div></body>"
    wrapped = [(k, f"http://b.org/{k}", f"<body><div class=wrap><div class=post><p>{BODY} {k}</p></div><div><a href=x>{LEAD}</a></div></div></body>") for k in range(5)]
    assert texts(spark, [*wrapped, (9, "http://b.org/9", lead)])[9] == (LEAD + BODY).strip()


def test_the_vote_overrules_a_long_aside(spark):
    """What usually loses does not win on the one page where it is longer than the article."""
    pages = [(k, f"http://a.org/{k}", f"<body><div class=post><p>{BODY} {k}</p></div><div class=talk><p>{LEAD}</p></div></body>") for k in range(5)]
    odd = f"<body><div class=post><p>{LEAD}</p></div><div class=talk><p>{BODY}</p></div></body>"
    assert texts(spark, [*pages, (9, "http://a.org/9", odd)])[9] == LEAD.strip()


def test_more_paths_than_one_host_can_rank(spark):
    """Twenty layouts of one host, each with an aside that is longer on one page: every layout's own vote decides."""
    pages, names = [], [chr(97 + k) * 3 for k in range(20)]
    for n, name in enumerate(names):
        for k in range(3 + n):
            main, aside = (LEAD, BODY) if k == 0 else (BODY, LEAD)
            pages.append((100 * n + k, f"http://a.org/{n}/{k}", f"<body><div class={name}><p>{main}</p></div><div class='x{name}'><p>{aside}</p></div></body>"))
    got = texts(spark, pages)
    assert all(got[i] == (LEAD if i % 100 == 0 else BODY).strip() for i, _, _ in pages)


def slow_choice(pages):
    """Votes by plain counting, page by page."""
    votes, seen, deep, surveys = Counter(), Counter(), {}, {}
    for i, url, page in pages:
        host = url.split("/")[2]
        surveys[i] = host, *html_text.survey(page)
        _, best, depth, paths = surveys[i]
        if best:
            votes[host, best] += 1
            deep[host, best] = depth
        for path in paths:
            seen[host, path] += 1
    found = defaultdict(str)
    for i, _, page in pages:
        host, best, _, paths = surveys[i]
        if best:
            path = max((p for p in paths if votes[host, p]), key=lambda p: (votes[host, p], deep[host, p], p))
            found[i] = html_text.main_text(page, [path], 2 * votes[host, best] > seen[host, best])
    return found


def test_votes_as_counted_one_by_one(spark):
    words = [f"word{k}" for k in range(40)]
    pages = []
    for i in range(120):
        blocks = [
            f"<div class='c{'xyz'[(i * 7 + j * 5) % 3]}{'pq'[(i + j) % 2]}'><p>{' '.join(words[(i * j) % 17 : (i * j) % 17 + 1 + (i * 3 + j * 11) % 23])}</p></div>"
            for j in range(i % 4)
        ]
        pages.append((i, f"http://h{i % 3}.org/{i}", "<body>" + "".join(blocks) + "</body>"))
    want = slow_choice(pages)
    assert texts(spark, pages) == {i: want[i] for i, _, _ in pages}


def test_deep_pages_take_little_memory():
    page = "<body>" + "<div class=layer>" * 20_000 + f"<p>{BODY}</p><a href=x>{LEAD}</a>" + "</div>" * 20_000 + "</body>"
    tracemalloc.start()
    key, depth, paths = html_text.survey(page)
    assert BODY.strip() in html_text.main_text(page, [key])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert depth and len(paths) == 20_002 and peak < 50_000_000
