import random

import pytest

from corvella.operators.chunk import chunk_documents, document_chunks, markdown_chunks


def test_headings_make_paths():
    made = markdown_chunks("# A\n\nintro text\n\n## B\n\nmore\n\n# C\n\nend", least=1)
    assert [c.heading_path for c in made] == [["A"], ["A", "B"], ["C"]]
    assert made[1].section_title == "B"


def test_blank_texts_have_no_chunks():
    assert markdown_chunks("") == markdown_chunks("  \n ") == []


def test_code_and_tables_stand_alone_and_overlap_returns():
    p, code = "word " * 30, "```\nx = 1\n```"
    made = markdown_chunks("\n\n".join([p, code, code.replace("1", "2")]), most=60, least=1)
    assert [c.content_type for c in made] == [None, "code", None, "code", None]
    assert made[2].text == p.strip() and made[4].text == code
    table = "\n".join("|a|b|" for _ in range(20))
    assert "table" in [c.content_type for c in markdown_chunks(p + "\n\n" + table, most=50, least=1)]


def test_paragraphs_overlap():
    paragraphs = [f"paragraph {i} " + "x" * 60 for i in range(20)]
    made = markdown_chunks("\n\n".join(paragraphs), most=200, least=1, overlap=1)
    assert len(made) > 2
    for a, b in zip(made, made[1:], strict=False):
        assert a.text.split("\n\n")[-1] == b.text.split("\n\n")[0]


def test_small_chunks_join_and_take_the_later_path():
    made = markdown_chunks("# One\n\n" + "a" * 150 + "\n\n# Two\n\nb", least=100)
    assert len(made) == 1 and made[0].heading_path == ["Two"]


@pytest.mark.parametrize("kind", ["text", "xlsx", "image"])
def test_hard_bounds_lose_nothing(kind):
    rng = random.Random(3)
    body = "".join(rng.choice("漢字é😀ab c") for _ in range(20_000)).replace("  ", " ")
    text = f"```\n{body.strip()}\n```"
    made = document_chunks(text, kind)
    assert "".join(c.text for c in made) == text
    assert all(len(c.text) <= 1200 and len(c.text.encode()) <= 1800 for c in made)
    assert len({c.chunk_id for c in made}) == len(made)


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        document_chunks("a", most=0)
    with pytest.raises(ValueError):
        document_chunks("a", most_bytes=3)


def test_as_a_table_function(spark):
    rows = [("a.md", "text", "# T\n\n" + "word " * 500), ("b.md", "text", None), ("c.md", "text", "")]
    out = chunk_documents(spark.createDataFrame(rows, "path string, doc_type string, content string")).collect()
    assert {r.path for r in out} == {"a.md"} and all(r.heading_path == ["T"] for r in out)
