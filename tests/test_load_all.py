"""Loading a folder with a broken file and a JSON file that starts with a blank line."""

import json

from webrisk.sources import readers


def test_broken_records_are_counted(spark, tmp_path):
    page = {"id": "1", "label": "malicious", "url": "https://a.example.com/x"}
    (tmp_path / "good.json").write_text("\n\n" + json.dumps([page, page | {"url": "https://b.example.com/"}]))
    (tmp_path / "lines.json").write_text(json.dumps(page | {"url": "https://c.example.com/"}) + "\n{broken\n")
    (tmp_path / "broken.json").write_text('[{"id": "2", "url": "https://d.exa')
    (tmp_path / "openphish.txt").write_text("https://e.example.com/\n")
    merged, summary = readers.load_all(spark, str(tmp_path))
    assert sorted(r.url for r in merged.collect()) == [f"https://{c}.example.com/{'x' if c == 'a' else ''}" for c in "abce"]
    counts = {r.source_file.rsplit("/", 1)[-1]: (r.rows, r.invalid_rows) for r in summary.collect()}
    assert counts == {"good.json": (2, 0), "lines.json": (1, 1), "broken.json": (0, 1), "openphish.txt": (1, 0)}


def test_many_files_with_three_headers(spark, tmp_path):
    """A hundred CSV files of three headers, a JSON array, a broken one and a compressed list that isn't one."""
    for i in range(100):
        if i % 3 == 0:
            text = f"id,URL,note\n{i},https://a{i}.example.com/,\"x, y\"\n{i},\"https://b{i}.example.com/?q=1,2\",z\n"
        elif i % 3 == 1:
            text = f"rank;site\n1;c{i}.example.com\n\n2;d{i}.example.com\n"
        else:
            text = f"first,second\n{i}.5,e{i}.example.com\n,\n"
        (tmp_path / f"f{i}.csv").write_text(text)
    (tmp_path / "plain.csv").write_text("zz\nf.example.com\n1\n")
    (tmp_path / "only_header.csv").write_text("url,x\n")
    (tmp_path / "pages.json").write_text(json.dumps([{"id": "1", "label": "benign", "url": "https://g.example.com/"}]))
    (tmp_path / "cut.json").write_text('[{"id": "2", "url": "https://h.exa')
    (tmp_path / "packed.txt.gz").write_bytes(b"not packed")
    merged, summary = readers.load_all(spark, str(tmp_path))
    want = set()
    for i in range(100):
        want |= [{f"https://a{i}.example.com/", f"https://b{i}.example.com/?q=1,2"}, {f"https://c{i}.example.com", f"https://d{i}.example.com"},
                 {f"https://e{i}.example.com", "https://nan"}][i % 3]
    assert {r.url for r in merged.collect()} == want | {"https://f.example.com", "https://1", "https://g.example.com/"}
    assert [r.source_file.rsplit("/", 1)[-1] for r in readers.unread_files(spark, str(tmp_path), summary).collect()] == ["only_header.csv"]
    scans = merged._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans <= 8


def test_one_file_reads_the_same_either_way(spark, tmp_path):
    for name, text in {"a": "x;domain\n1;p.example.com\n2;\n", "b": "7,q.example.com\n8,r.example.com\n", "c": "link\turl\nu\thttps://s.example.com/\n"}.items():
        path = str(tmp_path / f"{name}.csv")
        (tmp_path / f"{name}.csv").write_text(text)
        one = [(r.url, r.raw_value) for r in readers.read_url_csv(spark, path).collect()]
        assert sorted(one, key=str) == sorted([(r.url, r.raw_value) for r in readers.read_url_csvs(spark, [path]).collect()], key=str) and one
