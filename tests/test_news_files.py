"""Concatenated JSON: a file is read line by line, and values may span lines or share one."""

from intelspark.sources import feeds

FILES = {
    "a.txt": '{"title": "one",\n "url": "u]1"} {"results": [\n{"title": "two", "url": "u\\"{2"},\n 5]}\n[{"title": "three"}]\n\n7 "x"\n{"title": "four"}',
    "b.txt": '{"title": "five"}\r\n{"title": "six"} {"title": \n{"title": "seven"}\n',
    "c.txt": '{"title": "eight"}]\n{"title": "nine"}',
    "d.txt": '{"title": "ten\n{"title": "eleven"}',
    "e.txt": "",
}


def test_values_that_span_lines_and_broken_ones(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, newline="")
    out = feeds.concatenated_news(spark, str(tmp_path))
    want = {(name, i, item.get("title", ""), item.get("url", "")) for name, text in FILES.items() for i, item in enumerate(feeds._news_items(text)[0])}
    assert {(r.file.rsplit("/", 1)[1], r.pos, r.title, r.url) for r in out.collect()} == want
    assert {t for _, _, t, _ in want} == {"one", "two", "three", "four", "five", "six", "eight"}


def test_whole_files_are_not_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"title": "one"}\n')
    assert "wholetext" not in feeds.concatenated_news(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().lower()
    import inspect
    assert "wholetext" not in inspect.getsource(feeds.concatenated_news)
