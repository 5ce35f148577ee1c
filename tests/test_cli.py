import json

from corvella import cli


def test_chunk_rewrite_rerank(tmp_path, capsys):
    (tmp_path / "a.md").write_text("# T\n\nbody")
    assert cli.main(["chunk", str(tmp_path / "a.md"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["heading_path"] == ["T"]
    assert cli.main(["--json", "rewrite", "two words"]) == 0
    assert json.loads(capsys.readouterr().out)["keywords"] == ["two", "words"]
    assert cli.main(["rerank", "red box", "--docs", "blue", "red box"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["index"] == 1


def test_errors_have_codes(capsys):
    assert cli.main(["retrieve", "x"]) == 2
    assert json.loads(capsys.readouterr().err)["error"]["code"] == "E_INVALID_ARGS"
    assert cli.main(["nonsense"]) == 2
    assert cli.main(["--registry", "/none.yaml", "--kb", "a", "stats"]) == 1
    assert "E_CONFIG_INVALID" in capsys.readouterr().err


def test_sources(tmp_path):
    from corvella.sources.parse import kind_of, parse_one

    names = {"a.md": "text", "a.PDF": "pdf", "a.doc": "docx", "a.xlsm": "xlsx", "a.ppt": "pptx", "a.TIF": "image", "a.unknown": "unknown", "a": "unknown", ".env": "unknown"}
    assert {n: kind_of(n) for n in names} == names
    assert parse_one("x/my_note-1.md", "no heading".encode())["title"] == "my note 1"
    assert parse_one("x.md", b"# Head\n\nx")["title"] == "Head"


def test_office_files():
    from corvella.plans.extended import sheet_file, slide_file, word_file
    from corvella.sources.parse import parse_one

    lines = ["first <line>", "second & last"]
    word = parse_one("a/my_file.docx", word_file(lines))
    assert (word["doc_type"], word["title"], word["content"]) == ("docx", "of 2", "first <line>\n\nsecond & last")
    sheet = parse_one("a.xlsx", sheet_file(lines))
    assert sheet["content"].splitlines()[2:5] == ["| 1 |  | first <line> |", "| --- | --- | --- |", "| 2 |  | second & last |"]
    assert json.loads(sheet["metadata"])["sheets"] == [{"name": "turns", "max_row": 2, "max_column": 3}]
    slides = parse_one("a.pptx", slide_file(lines))
    assert [p["content"] for p in slides["pages"]] == lines and json.loads(slides["metadata"])["slide_count"] == 2
    assert parse_one("a.unknown", word_file(lines))["content"] == word["content"]
    assert parse_one("a.docx", b"nothing")["doc_type"] == "error"


def test_pages_of_html():
    from corvella.sources.parse import parse_one

    made = parse_one("x/page", b"<!DOCTYPE html><html><head><title>The &amp; title</title><style>p{}</style></head><body><h1>Head</h1><p>one <b>two</b><br>three<script>no()</script></p><ul><li>four</li></ul></body></html>")
    assert (made["doc_type"], made["parse_engine"], made["title"]) == ("unknown", "html", "The & title")
    assert made["content"] == "# Head\n\none two\nthree\n\nfour"


def test_prompts(tmp_path):
    from corvella import providers

    (tmp_path / "query-rewrite-prompt.md").write_text("# Title\n## system\nBe short.\n# note\n\n## user\nAsk {query} in {context}\n")
    assert providers.prompt("query-rewrite", str(tmp_path)) == ("Be short.", "Ask {query} in {context}")
    assert providers.asked("query-rewrite", str(tmp_path), query="q", context="c") == "Be short.\n\nAsk q in c"
    assert providers.prompt("query-rewrite")[1].startswith("Rewrite") and providers.prompt("none", str(tmp_path)) == ("", "")


def test_services(tmp_path, monkeypatch, capsys):
    """What the registry names is asked; answers are those of a stand-in for the network."""
    from corvella import providers

    asked = []

    def answer(url, body, **how):
        asked.append(url)
        if url.endswith("embed"):
            return {"data": [{"index": i, "embedding": [1.0, 2.0, 3.0]} for i in range(len(body["input"]))]}
        if url.endswith("rerank"):
            return {"results": [{"index": i, "relevance_score": i / 10} for i in range(len(body["documents"]))]}
        text = json.dumps({"rewritten": "better", "summary": "short"})
        return {"choices": [{"message": {"content": text if isinstance(body["messages"][0]["content"], str) else " a picture "}}]}

    monkeypatch.setattr(providers, "post_json", answer)
    at = tmp_path / "registry.yaml"
    at.write_text("services: {embed: {url: 'http://m/embed', model: e, dimensions: 3}, rerank: {url: 'http://m/rerank'}, chat: {url: 'http://m/chat', model: c}}\nknowledge_bases: {}\n")
    out = lambda *a: (cli.main(["--registry", str(at), *a]), json.loads(capsys.readouterr().out))
    assert out("embed", "text") == (0, [1.0, 2.0, 3.0])
    assert out("rewrite", "query")[1]["rewritten"] == "better"
    assert [r["index"] for r in out("rerank", "q", "--docs", "a", "b")[1]] == [1, 0]
    (tmp_path / "a.md").write_text("x")
    assert out("summary", str(tmp_path / "a.md"))[1]["summary"] == "short"
    assert out("status") == (0, {"services": {"embed": True, "rerank": True, "chat": True}})
    status, report = out("doctor")
    assert report["services"]["chat"] and report["embedding_dimensions"] == 3 and report["tables"] == {}
    see = providers.HttpVision("http://m/see", "v")
    assert see(b"\x89PNG1") == see(b"\x89PNG1") == "a picture" and asked.count("http://m/see") == 1
    assert providers.HttpImageEmbedder("http://m/embed", "i", 3).embed([b"\xff\xd8x", "not base64!", None]) == [[1.0, 2.0, 3.0], [0.0] * 3, [0.0] * 3]
    monkeypatch.setattr(providers, "post_json", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("down")))
    assert see(b"GIF89") == "" and out("status")[0] == 2


def test_image_forms(tmp_path):
    from corvella.providers import data_url

    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8raw")
    assert data_url(str(tmp_path / "a.jpg")) == "data:image/jpeg;base64,/9hyYXc="
    assert data_url("/9hyYXc=") == data_url(b"\xff\xd8raw") == data_url("data:image/jpeg;base64,/9hyYXc=")
