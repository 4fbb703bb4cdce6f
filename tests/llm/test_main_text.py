"""Main text that stands beside the largest container, or under a name that only mentions furniture."""

import pytest

from duelframe.llm import html_text

LEAD, BODY = "The lead says it in short words. " * 3, "The body tells the whole story at length. " * 14


def found(page: str) -> str:
    return html_text.main_text(page, [html_text.best_path(page)])


@pytest.mark.parametrize("page", [
    f"<body><div class=post><div class=lead>{LEAD}</div><div class=body>{BODY}</div></div></body>",
    f"<body><div class=post><div class=lead>{LEAD}</div><div class=body>{BODY}</div><ul><li><a href=x>{LEAD}</a></ul></div></body>",
    f"<body><main><div>{LEAD}</div><article>{BODY}</article></main></body>",
    f"<body><article><p>{LEAD}</p><blockquote>{BODY}</blockquote></article></body>",
    f"<body><div class=post><p>{LEAD}</p><ul><li><a href=x>{LEAD}</a></ul><blockquote>{BODY}</blockquote></div></body>",
])
def test_no_plain_text_left_out(page):
    text = found(page)
    assert LEAD.strip() in text and BODY.strip() in text


@pytest.mark.parametrize("name", ["content has-sidebar", "post comments-open", "page no-header", "modal-open", "layout sidebar", "share-price"])
def test_names_that_mention_furniture(name):
    page = f"<body><div class='{name}'><article><p>{LEAD}</p><p>{BODY}</p></article></div><div class='site-footer'>Foot</div></body>"
    assert found(page) == (LEAD + BODY).strip()
    page = f"<body><div class='{name}' id='x1'><p>{LEAD}</p><p>{BODY}</p></div><div class='widget-area'>Side</div></body>"
    assert found(page) == (LEAD + BODY).strip()


def test_furniture_stays_hidden():
    page = (
        f"<body><article><p>{LEAD}</p></article><div class=comments><p>{BODY}</p><p>{BODY}</p></div><div id='sidebar-1'>{LEAD}</div></body>"
    )
    assert found(page) == LEAD.strip()
    page = f"<body><div class=post><p>{LEAD}</p></div><ol class=commentlist><li>{BODY}</ol></body>"
    assert found(page) == LEAD.strip()
