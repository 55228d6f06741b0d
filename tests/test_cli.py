import json

from lexmill.__main__ import main


def test_run_and_query(spark, tmp_path, capsys):
    assert main(["run", "--keywords", "Tea, cup,tea", "--out", "a.json", "--format", "json", "--root", str(tmp_path), "--resume", str(tmp_path / "steps")]) == 0
    assert sorted(x["Keyword"] for x in json.loads((tmp_path / "a.json").read_text())) == ["Tea", "cup"]
    spark.createDataFrame([(1, "http://a.example.com/en/1", "<title>t</title>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    assert main(["query", "url_parts", str(tmp_path / "sf"), "--out", "b.csv", "--root", str(tmp_path)]) == 0
    assert "example.com" in (tmp_path / "b.csv").read_text()
