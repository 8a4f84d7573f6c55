"""Pages: content regions, labels, dialogue and embedded objects."""

import json

import pytest

from loomcorpus.sources import html as H

LONG = "words that are long enough to count"


@pytest.mark.parametrize("page,want", [
    (f'<body>out<div role="main note">{LONG} a</div></body>', f"{LONG} a"),
    (f'<div class="x detail-content">{LONG} b</div>rest', f"{LONG} b"),
    (f'<div id="content">{LONG} c<nav>no</nav></div>rest', f"{LONG} c"),
    (f'<div class="content">{LONG} d</div><article>{LONG} e</article>', f"{LONG} e"),
    (f'<div class="wiki-content">short</div><main>{LONG} f</main>', f"{LONG} f"),
    (f'<p class="contents">{LONG} g</p>', f"{LONG} g"),
    ("", ""), (None, ""),
])
def test_content_is_looked_for_in_order(page, want):
    assert H.parse(page)["text"].endswith(want) and ("rest" not in H.parse(page)["text"])


def test_labels_of_links_without_text():
    page = '<a href="1"><img alt="pic" title="t"></a><a href="2"><img title="t"></a><a href="3" title="own"></a><a href="4"> said <img alt="p"></a><a href="5"></a>'
    assert [x["label"] for x in H.parse(page)["links"]] == ["pic", "t", "own", "said", "5"]


def test_turns_of_a_stage():
    page = """<section class="stage"><div class="dialog-line"><span class="dialog-actor"> Ann： </span><div class="dialog-content">Hello <b>there</b>
      you</div></div><div class="dialog-line"><div class="dialog-content">It rains.</div></div><div class="dialog-line"><span class="dialog-actor">Scene</span><p class="dialog-content">A room</p></div>
      <div class="dialog-line"><span class="dialog-actor">Bob</span><p class="dialog-content"> </p></div></section><div class="dialog-line"><p class="dialog-content">outside</p></div><p>Eve: no</p>"""
    assert H.dialogue_of(page, ("Scene",)) == [("Ann", "Hello there you"), (None, "It rains."), (None, "A room")]
    assert H.dialogue_of(f"<main><p>Ann: one</p><p>no label {LONG}</p><p>Scene：two</p></main>", ("Scene",)) == [("Ann", "one"), (None, "two")]
    assert H.dialogue_of(None, ()) == [] and H.dialogue_of("", ()) == []


@pytest.mark.parametrize("value", [{}, {"a": "}"}, {"a": '"}{'}, {"a": "\\"}, {"a": {"b": ["{", "\\\"}"]}}, {"a": "x" * 200_000 + "}"}])
def test_balanced_objects(value):
    text = json.dumps(value)
    assert H.balanced(f"<script>x {{}} state = {text}; f({{}})", "state") == text
    assert H.balanced(f"state = {text[:-1]}", "state") is None
    assert H.balanced(text, "state") is None and H.balanced(None, "state") is None and H.balanced("state", "state") is None


def test_video_metadata(spark):
    video = {"title": "T}", "pages": [{"page": 1, "part": "a{", "duration": 3}, {"page": 2, "part": 'b"', "duration": None}], "subtitle": {"list": [{"lan": "en", "subtitle_url": "u}"}]}}
    rows = [(1, f"s = {json.dumps({'videoData': video})};"), (2, "s = {not json}"), (3, None), (4, "s = {}"), (5, 's = {"videoData": {"title": "x"}}')]
    parts, tracks = H.video_metadata(spark.createDataFrame(rows, "page_id int, html string"), marker="s =")
    assert [tuple(r) for r in parts.orderBy("part").collect()] == [(1, "T}", 1, "a{", 3), (1, "T}", 2, 'b"', None)]
    assert [tuple(r) for r in tracks.collect()] == [(1, 1, "en", "u}")]
