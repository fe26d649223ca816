import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import backup, books

SOURCE = {"bookSourceName": "s", "bookSourceUrl": "u", "bookSourceType": 0, "exploreUrl": "e", "enabledCookieJar": True, "ruleToc": {"chapterList": "@css:li", "nextTocUrl": "x"}, "ruleContent": {"content": "{{a}}", "replaceRegex": "##x##"}}
MEMBERS = {
    "bookSource.json": [SOURCE, "odd"],
    "bookshelf.json": [{"name": "n", "author": "a", "bookUrl": "b", "origin": "u", "durChapterIndex": 1, "group": 3, "readConfig": {"x": 1}}],
    "readRecord.json": {"bookName": "n", "readTime": 5},
    "readRecordDetail.json": [],
    "readRecordSession.json": [{"bookName": "n", "words": 2}],
}


def archive(members, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, value in members.items():
            z.writestr(name, json.dumps(value))
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture()
def members(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive(MEMBERS, [("config.xml", "<broken"), ("servers.json", "{")]))
    return backup.read_backup(spark, str(tmp_path / "a.zip"))


def test_load_and_summary(members):
    found = backup.summarize(members)
    assert found["counts"] == {"book_sources": 2, "bookshelf_books": 1, "read_records": 1, "read_record_details": 0, "read_record_sessions": 1, "ignored_members": 2}
    assert found["ignored_files"] == ["config.xml", "servers.json"]
    assert found["feature_usage"]["sources_with_explore_url"] == 1 and found["feature_usage"]["sources_with_cookie_jar"] == 1 and found["feature_usage"]["sources_with_toc_next_url"] == 1
    assert found["rule_keys"]["ruleToc"] == ["chapterList", "nextTocUrl"] and found["rule_keys"]["ruleSearch"] == []
    assert found["top_level_keys"]["bookshelf.json"] == ["author", "bookUrl", "durChapterIndex", "name", "origin"]
    assert "##x##" not in json.dumps(found)


def test_tables(members):
    shelf = backup.shelf_table(members).first()
    assert (shelf.name, shelf.durChapterIndex, shelf.pos) == ("n", 1, 0) and "group" not in shelf.raw
    report = backup.compatibility_report(backup.source_table(members)).where("bookSourceName = 's'").first()
    assert (report.css, report.replacements, report.templates, report.fully_supported) == (1, 1, 1, True)


@pytest.mark.parametrize("name", ["../escape.json", "nested/member.json", "a\\b.json"])
def test_unsafe_names(name):
    with pytest.raises(backup.BackupError):
        backup.unpack(archive(MEMBERS, [(name, "{}")]))


def test_missing_and_malformed():
    with pytest.raises(backup.BackupError):
        backup.unpack(archive({k: v for k, v in MEMBERS.items() if k != "readRecord.json"}))
    with pytest.raises(backup.BackupError):
        backup.unpack(b"no zip")
    with pytest.raises(backup.BackupError):
        backup.parse_member("bookshelf.json", b"{}")
    with pytest.raises(backup.BackupError):
        backup.parse_member("readRecord.json", b"\xff")


def test_state_round_trip(spark, members, tmp_path):
    path = str(tmp_path / "state")
    backup.write_state(members, path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.zip", "state"] and len(list((tmp_path / "state").glob("*.json"))) == len(backup.MEMBERS) + 1
    with pytest.raises(backup.BackupError, match="already"):
        backup.write_state(members, path)
    again = backup.read_state(spark, path)
    assert {r.name: r.data for r in again.collect()} == {r.name: r.data for r in members.collect()}
    backup.update_member(spark, path, "bookshelf.json", [{"name": "m", "group": 1}])
    assert backup.shelf_table(backup.read_state(spark, path)).first().name == "m" and sorted(p.name for p in tmp_path.iterdir()) == ["a.zip", "state"]
    with pytest.raises(backup.BackupError, match="format"):
        backup.read_state(spark, path, "another-format")


@pytest.mark.parametrize("fault", ["hash", "size", "missing", "unlisted", "twice", "kind", "version"])
def test_damaged_states(spark, members, tmp_path, fault):
    path = tmp_path / "state"
    backup.write_state(members, str(path))
    head, one = json.loads((path / "manifest.json").read_text()), path / "readRecord.json"
    if fault == "hash":
        one.write_bytes(one.read_bytes().replace(b"[", b" ", 1)[::-1])
    elif fault == "size":
        one.write_text("[1, 2, 3]")
    elif fault == "missing":
        one.unlink()
    elif fault == "unlisted":
        (path / "other.json").write_text("[]")
    elif fault == "twice":
        head["members"].append(head["members"][0])
    elif fault == "kind":
        head["members"][0]["kind"] = "text"
    else:
        head["state_schema_version"] = 9
    (path / "manifest.json").write_text(json.dumps(head))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(backup.BackupError):
        backup.read_state(spark, str(path))


def test_older_state(spark, members, tmp_path):
    """Files in a folder of their own and a group member: read, and written as the present version."""
    old, new = tmp_path / "old", tmp_path / "new"
    backup.write_state(members, str(old))
    head = json.loads((old / "manifest.json").read_text())
    for crc in old.glob(".*.crc"):
        crc.unlink()
    (old / "android").mkdir()
    (old / "android" / "bookGroup.json").write_text("[]")
    for m in backup.MEMBERS:
        (old / m).rename(old / "android" / m)
    head["state_schema_version"] = backup.OLDER_STATE_VERSION
    head["members"].append({"name": "bookGroup.json", "size": 2, "kind": "json"})
    (old / "manifest.json").write_text(json.dumps(head))
    found = backup.read_state(spark, str(old))
    assert {r.name: r.data for r in found.collect()} == {r.name: r.data for r in members.collect()}
    backup.write_state(found, str(new))
    assert json.loads((new / "manifest.json").read_text())["state_schema_version"] == backup.STATE_VERSION


def test_integrity(spark, members, tmp_path):
    for r in members.collect():
        (tmp_path / "m").mkdir(exist_ok=True)
        (tmp_path / "m" / r.name).write_bytes(json.dumps(MEMBERS[r.name]).encode())
    (tmp_path / "m" / "readRecord.json").write_bytes(b"[1]")
    (tmp_path / "m" / "extra.json").write_bytes(b"1")
    status = {r.name: r.status for r in backup.integrity(spark, str(tmp_path / "m"), members).collect()}
    assert status["bookSource.json"] == "ok" and status["readRecord.json"] == "size" and status["extra.json"] == "unlisted"


def test_pasted_sources(spark):
    df = spark.createDataFrame([(json.dumps(SOURCE),), (json.dumps([SOURCE, {"bookSourceName": "x"}]),)], "t string")
    assert [len(r.v) for r in df.select(backup.parse_sources(df.t).alias("v")).collect()] == [1, 1]


def test_epub(spark, tmp_path):
    """Books as EPUB files: the media type first and stored, lists in order, names that files can have; books over the cap aren't made."""
    rows = [("b/1", "a", i, f"t{i} <&>", f"line {i}\n<b>") for i in range(12, 0, -1)] + [("c", None, 5, None, None), ("big", "x", 1, "t", "x" * 5000)]
    df = spark.createDataFrame(rows, "book string, author string, index int, title string, content string").repartition(3)
    books.write_epubs(df, str(tmp_path / "out"), most_bytes=4000)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["b_1.epub", "c.epub"] and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    z = zipfile.ZipFile(tmp_path / "out" / "b_1.epub")
    assert z.testzip() is None and z.namelist()[:2] == ["mimetype", "META-INF/container.xml"] and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.read("mimetype") == b"application/epub+zip"
    root = ElementTree.fromstring(z.read("META-INF/container.xml"))
    package = ElementTree.fromstring(z.read(next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))))
    of = lambda tag: [e for e in package.iter() if e.tag.endswith("}" + tag)]
    items = {e.get("id"): e.get("href") for e in of("item")}
    pages = [items[e.get("idref")] for e in of("itemref")]
    assert len(pages) == 12 and set(items.values()) <= set(z.namelist())
    titles = ["".join(ElementTree.fromstring(z.read(p)).find(".//{*}h1").itertext()) for p in pages]
    assert titles == [f"t{i} <&>" for i in range(1, 13)]
    contents = ElementTree.fromstring(z.read("contents.xhtml"))
    assert [(a.get("href"), a.text) for a in contents.iter() if a.tag.endswith("}a")] == list(zip(pages, titles))
    older = ElementTree.fromstring(z.read("contents.ncx"))
    assert [e.get("src") for e in older.iter() if e.tag.endswith("}content")] == pages
    assert books.book_text(df, most_bytes=1).where("book <> 'c'").count() == 0


def test_archives_by_their_directories(spark, tmp_path):
    """Members of many archives, and what is wrong with archives, without reading the rest."""
    (tmp_path / "good.zip").write_bytes(archive(MEMBERS, [("other.bin", "x" * 1000)]))
    (tmp_path / "bad.zip").write_bytes(archive({k: v for k, v in MEMBERS.items() if k != "readRecord.json"}, [("a/b.json", "{}")]))
    faults = sorted((r.archive[-8:], r.name, r.fault) for r in backup.archive_faults(spark, str(tmp_path)).collect())
    assert faults == [("/bad.zip", "a/b.json", "unsafe"), ("/bad.zip", "readRecord.json", "missing")]
    rows = backup.archive_members(spark, str(tmp_path), ["bookshelf.json"]).collect()
    assert len(rows) == 2 and all(json.loads(r.data) == MEMBERS["bookshelf.json"] for r in rows)


def test_records_as_a_member(spark, tmp_path):
    """A member of any length is written a record at a time."""
    records = spark.range(500).select(F.col("id").alias("pos"), F.to_json(F.struct("id")).alias("record")).repartition(4)
    pieces = backup.record_pieces(records, "bookshelf.json")
    for name in backup.MEMBERS:
        if name != "bookshelf.json":
            pieces = pieces.unionByName(backup.record_pieces(records.limit(0), name))
    backup.write_state_pieces(pieces, str(tmp_path / "s"))
    assert json.loads((tmp_path / "s" / "bookshelf.json").read_text()) == [{"id": i} for i in range(500)]
    found = backup.read_state(spark, str(tmp_path / "s"))
    assert backup.records(found, "bookshelf.json").count() == 500 and backup.records(found, "readRecord.json").count() == 0


def test_books_are_dealt_once_for_all_documents(spark, capsys):
    """Each of an EPUB's documents used to deal and number all chapters for itself."""
    sections = spark.createDataFrame([("b", "me", 1, "t", "x")], "book string, author string, index int, title string, content string")
    books.epub_pieces(sections).explain()
    assert capsys.readouterr().out.count("row_number()") <= 4


def test_epubs_of_long_books_have_all_chapters(spark, tmp_path):
    """Books of over 5000 chapters or 25 MiB used to be left out, and numbers from a million on were cut to six digits."""
    long = spark.range(1_000_002).selectExpr("'long' AS book", "'me' AS author", "id AS index", "'t' AS title", "'x' AS content")
    names = books.epub_pieces(long).where("name LIKE 'text/%'").select("name")
    assert names.distinct().count() == 1_000_002 and names.where("name IN ('text/000001.xhtml', 'text/1000002.xhtml')").count() == 2
    large = spark.range(3).selectExpr("'large' AS book", "'me' AS author", "id AS index", "'t' AS title", "repeat('x', 9 * 1024 * 1024) AS content")
    books.write_epubs(large.unionByName(long.where("index < 5001")), str(tmp_path / "out"))
    count = lambda book: sum(n.startswith("text/") for n in zipfile.ZipFile(tmp_path / "out" / f"{book}.epub").namelist())
    assert count("long") == 5001 and count("large") == 3


def test_chapters_of_one_index_are_numbered_alike(spark):
    """In the order of what they hold, however rows arrive."""
    rows = [("b", "me", 1, t, c) for t in "ba" for c in "dc"]
    found = set()
    for some in (rows, rows[::-1]):
        pieces = books.epub_pieces(spark.createDataFrame(some, "book string, author string, index int, title string, content string").coalesce(1))
        found.add(tuple(sorted((r.name, r.content) for r in pieces.where("name LIKE 'text/%'").collect())))
    assert len(found) == 1
