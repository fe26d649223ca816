import io
import zipfile

from fieldloom import sql
from fieldloom.operators import shelf
from fieldloom.sources import archives


def test_functions_in_sql(spark):
    sql.register(spark)
    row = spark.sql("SELECT rule_list('<a href=/x>y</a>', '@css:a@href') AS a, rule_text('<p>1<p>2', '//p') AS b, text_rule('a1', '##[0-9]##') AS c, html_text('<p>x</p>y') AS d, absolute_url('http://h/a/b', 'c') AS e, chinese_number('十二') AS f").first()
    assert tuple(row) == (["/x"], "12\n2", "a", "x\ny", "http://h/a/c", 12)
    assert [r.element for r in spark.sql("SELECT * FROM rule_elements('{\"a\":[1,2]}', '$.a[*]')").collect()] == ["1", "2"]
    assert spark.sql("SELECT tag FROM html_nodes('<p><b>x</b></p>')").count() == 2


def test_archives(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.txt", "中".encode("gbk"))
        z.writestr("c.bin", b"1")
    (tmp_path / "x.zip").write_bytes(out.getvalue())
    rows = archives.decoded_members(archives.archive_members(spark, str(tmp_path / "x.zip"), r"\.txt$"), "gbk").collect()
    assert [(r.name, r.text) for r in rows] == [("a/b.txt", "中")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_bytes(b"a\r\nb")
    assert archives.text_folder(spark, str(tmp_path / "t")).first().text == "a\nb"


def test_change_of_source(spark):
    s = spark.createDataFrame([(1, "old", 5), (2, "keep", 6)], "book long, bookUrl string, durChapterIndex long")
    h = spark.createDataFrame([(1, "new")], "book long, bookUrl string")
    assert {tuple(r) for r in shelf.replace_source(s, h).collect()} == {(1, "new", None), (2, "keep", 6)}
    p = spark.createDataFrame([(1, "Two!", 9), (2, "x", 1)], "book long, title string, index long")
    c = spark.createDataFrame([(1, 1, "one"), (1, 2, " two")], "book long, index long, name string")
    assert {tuple(r) for r in shelf.place_after_change(s, p, c).collect()} == {(1, 2, True), (2, None, False)}
