"""Backup archives and state folders: five JSON members in a flat zip, checked, parsed and profiled.

Archives are read with Spark's binaryFile source, so any store that Spark reads will do. A member is a row; records of a
member are rows of a further table.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import kept
from .containers import opened, write_folder, zip_members

#: Members that are read; others are ignored, even broken ones (fixed values).
MEMBERS = ("bookSource.json", "bookshelf.json", "readRecord.json", "readRecordDetail.json", "readRecordSession.json")
CORE = MEMBERS[:2]
#: Fields of a shelf entry that belong to another reader's own settings (fixed values).
UNSHELVED = ("readConfig", "group", "groupId", "bookGroupId", "bookGroup")
#: Usage that the summary counts: name -> field of a source, or a rule group and its field (fixed values).
FEATURES = {
    "sources_with_explore_url": ("exploreUrl",), "sources_with_main_js": ("mainJs",), "sources_with_js_lib": ("jsLib",), "sources_with_login_url": ("loginUrl",), "sources_with_login_ui": ("loginUi",),
    "sources_with_header": ("header",), "sources_with_content_next_url": ("ruleContent", "nextContentUrl"), "sources_with_toc_next_url": ("ruleToc", "nextTocUrl"),
}
RULE_GROUPS = ("ruleBookInfo", "ruleContent", "ruleExplore", "ruleSearch", "ruleToc")
STATE_VERSION, OLDER_STATE_VERSION = 3, 2


class BackupError(ValueError):
    """An archive or state folder that can't be read safely."""


def check_name(name: str) -> None:
    if name in ("", ".", "..") or "/" in name or "\\" in name:
        raise BackupError(f"unsafe member name: {name!r}")


def parse_member(name: str, data: bytes) -> Any:
    try:
        value = json.loads(data.decode("utf-8"))
    except ValueError as e:
        raise BackupError(f"{name} is not UTF-8 JSON: {e}") from e
    if not isinstance(value, list) and (name in CORE or not isinstance(value, dict)):
        raise BackupError(f"{name} must be a JSON array" + " or object" * (name not in CORE))
    return value


def sanitized(books: list[Any]) -> list[Any]:
    """Shelf entries without the fields of UNSHELVED."""
    return [{k: v for k, v in b.items() if k not in UNSHELVED} if isinstance(b, dict) else b for b in books]


def unpack(data: bytes) -> tuple[dict[str, bytes], list[str]]:
    """The members of an archive, each of MEMBERS exactly once, and the names of the files that were ignored."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            files = Counter(name for name in archive.namelist() if not name.endswith("/"))
            for name in files:
                check_name(name)
            for fault, names in (("duplicate", [m for m in MEMBERS if files[m] > 1]), ("missing", [m for m in MEMBERS if not files[m]])):
                if names:
                    raise BackupError(f"{fault} members: {names}")
            return {m: archive.read(m) for m in MEMBERS}, sorted((files - Counter(MEMBERS)).elements())
    except zipfile.BadZipFile as e:
        raise BackupError(f"not a zip archive, or a damaged one: {e}") from e


_MEMBER_ROW = "archive string, name string, size long, sha256 string, data string, ignored array<string>"


def _member_rows(path: str, members: Mapping[str, bytes], ignored: list[str]) -> Iterator[tuple]:
    for name in MEMBERS:
        value = parse_member(name, members[name])
        text = json.dumps(sanitized(value), ensure_ascii=False, separators=(",", ":")) if name == "bookshelf.json" else members[name].decode()
        yield path, name, len(members[name]), hashlib.sha256(members[name]).hexdigest(), text, ignored


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    """A row for each member of each archive under path: archive, name, size, sha256, data (JSON text) and ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _member_rows(p, *unpack(c))]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
            names = [f.split()[0] for f in _MEMBER_ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _MEMBER_ROW)


def members_from_bytes(spark: SparkSession, members: Mapping[str, bytes]) -> DataFrame:
    """The same from members at hand."""
    if missing := [m for m in MEMBERS if m not in members]:
        raise BackupError(f"missing members: {missing}")
    return spark.createDataFrame(list(_member_rows("", members, [])), _MEMBER_ROW)


def records(members: DataFrame, name: str) -> DataFrame:
    """(archive, pos, record): a row for each record of a member, as JSON text. A single object counts as one record."""
    rows = members.where(F.col("name") == name)
    data = F.when(F.ltrim("data").startswith("{"), F.concat(F.lit("["), "data", F.lit("]"))).otherwise(F.col("data"))
    return rows.select("archive", F.posexplode(F.transform(F.from_json(data, "array<variant>"), lambda v: F.to_json(v))).alias("pos", "record"))


def record_field(field: str, record: Column | str = "record") -> Column:
    return F.get_json_object(record, f"$.{field}")


def source_table(members: DataFrame) -> DataFrame:
    """Sources with the fields that queries need; the rule groups are maps, and raw keeps all."""
    f = record_field
    rules = [F.from_json(f(g), "map<string,string>").alias(g) for g in RULE_GROUPS]
    return records(members, "bookSource.json").select(
        "archive", "pos", f("bookSourceUrl").alias("bookSourceUrl"), f("bookSourceName").alias("bookSourceName"), f("bookSourceGroup").alias("bookSourceGroup"),
        F.coalesce(f("bookSourceType").try_cast("int"), F.lit(0)).alias("bookSourceType"), F.coalesce(f("enabled").try_cast("boolean"), F.lit(True)).alias("enabled"),
        f("customOrder").try_cast("int").alias("customOrder"), f("searchUrl").alias("searchUrl"), f("exploreUrl").alias("exploreUrl"), *rules, F.col("record").alias("raw"),
    )


def sanitized_record(record: Column | str = "record") -> Column:
    """A shelf entry without the fields of UNSHELVED."""
    fields = F.from_json(record, "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, v: ~k.isin(*UNSHELVED)))


def shelf_table(members: DataFrame) -> DataFrame:
    """Shelf entries; raw keeps all their fields but those of UNSHELVED."""
    text = "name author bookUrl origin originName tocUrl durChapterTitle".split()
    number = "durChapterIndex durChapterPos durChapterTime totalChapterNum".split()
    return records(members, "bookshelf.json").select("archive", "pos", *[record_field(c).alias(c) for c in text], *[record_field(c).try_cast("long").alias(c) for c in number], sanitized_record().alias("raw"))


# ---- profiles


def _strings(value: Any) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings(v)


def _leaf_strings(raw: Column) -> Column:
    """All string values anywhere in a JSON record: string tokens, without those that a colon makes keys."""
    tokens = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    return F.transform(F.filter(tokens, lambda t: t.endswith('"')), lambda t: F.get_json_object(F.concat(F.lit('{"s":'), t, F.lit("}")), "$.s"))


def compatibility_report(sources: DataFrame, raw: str = "raw") -> DataFrame:
    """Per source: what kinds of rules its strings use, whether it is a text source, and what stays unsupported."""
    strings = _leaf_strings(F.col(raw))
    count = lambda test: F.size(F.filter(strings, test))
    has = lambda s, x: F.lower(s).contains(x)
    out = sources.withColumns({
        "text_source": F.coalesce(record_field("bookSourceType", raw).try_cast("int"), F.lit(0)) == 0,
        "css": count(lambda s: has(s, "@css:") | s.startswith("@@")), "json": count(lambda s: has(s, "@json:") | s.startswith("$.")),
        "regex": count(lambda s: has(s, "@regex:") | s.startswith(":")), "xpath": count(lambda s: has(s, "@xpath:")),
        "replacements": F.when(F.coalesce(record_field("ruleContent.replaceRegex", raw), F.lit("")) != "", 1).otherwise(0),
        "javascript": count(lambda s: F.lower(s).startswith("@js:") | F.lower(s).startswith("@webjs:") | F.lower(s).startswith("<js>") | s.contains("java.")),
        "templates": count(lambda s: s.contains("{{") & s.contains("}}")),
    })
    unsupported = F.array_compact(F.array(F.when(F.col("xpath") > 0, F.lit("xpath")), F.when(F.col("javascript") > 0, F.lit("javascript"))))
    return out.withColumn("unsupported", unsupported).withColumn("fully_supported", F.size("unsupported") == 0)


def report_totals(report: DataFrame) -> DataFrame:
    kinds = ["css", "json", "regex", "replacements", "xpath", "javascript", "templates"]
    return report.agg(F.count("*").alias("sources"), F.count_if("text_source").alias("text_sources"), F.count_if("fully_supported").alias("fully_supported"), *[F.sum(k).alias(k) for k in kinds])


def feature_usage(sources: DataFrame, raw: str = "raw") -> DataFrame:
    """(feature, n): how many sources use each feature; empty values count as unused."""
    used = lambda path: ~F.coalesce(record_field(".".join(path), raw), F.lit("")).isin("", "[]", "{}")
    counts = [F.count_if(used(path)).alias(name) for name, path in FEATURES.items()]
    counts.append(F.count_if(record_field("enabledCookieJar", raw) == "true").alias("sources_with_cookie_jar"))
    return sources.agg(*counts).unpivot([], [*FEATURES, "sources_with_cookie_jar"], "feature", "n")


def rule_keys(sources: DataFrame, raw: str = "raw") -> DataFrame:
    """(field, keys): the union of the keys of each rule group, sorted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("field"), F.json_object_keys(record_field(g, raw)).alias("keys")) for g in RULE_GROUPS]))
    return sources.select(pairs.alias("p")).select("p.field", F.explode("p.keys").alias("key")).groupBy("field").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def top_level_keys(members: DataFrame) -> DataFrame:
    """(name, keys): the union of the keys of each member's records, sorted."""
    parts = [records(members, m).select(F.lit(m).alias("name"), F.explode(F.json_object_keys("record")).alias("key")) for m in MEMBERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def summarize(members: DataFrame) -> dict[str, Any]:
    """The structural profile of one archive: sizes, hashes, counts, feature usage and keys; no values of fields."""
    infos = [r.asDict() for r in members.select("name", "size", "sha256").orderBy("name").collect()]
    counts = {m: records(members, m).count() for m in MEMBERS}
    sources = source_table(members)
    ignored = members.select("ignored").first().ignored
    return {
        "member_count": len(infos), "members": infos, "ignored_files": list(ignored),
        "counts": {"book_sources": counts[MEMBERS[0]], "bookshelf_books": counts[MEMBERS[1]], "read_records": counts[MEMBERS[2]], "read_record_details": counts[MEMBERS[3]], "read_record_sessions": counts[MEMBERS[4]], "ignored_members": len(ignored)},
        "feature_usage": {r.feature: r.n for r in feature_usage(sources).collect()},
        "rule_keys": {g: [] for g in RULE_GROUPS} | {r.field: list(r["keys"]) for r in rule_keys(sources).collect()},
        "top_level_keys": {m: [] for m in MEMBERS} | {r.name: list(r["keys"]) for r in top_level_keys(members).collect()},
    }


# ---- state


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def write_state(members: DataFrame, path: str, state_format: str = "imported-data", overwrite: bool = False) -> None:
    """The members (name, data) as files in a folder, with manifest.json: written beside it and moved when all tasks have ended,
    so it is there whole or not at all. An existing folder is an error unless overwrite; then it stays until the new one is
    complete. A line end closes each file."""
    write_state_pieces(members.select(F.col("name").alias("file"), F.lit(0).alias("pos"), F.concat("data", F.lit("\n")).alias("content")), path, state_format, overwrite)


def write_state_pieces(pieces: DataFrame, path: str, state_format: str = "imported-data", overwrite: bool = False) -> None:
    """The same from rows (file, pos, content), of which a file is made in the order of pos, as from record_pieces()."""
    system, at = opened(path.rstrip("/"))
    if system.get_file_info(at).type != FileType.NotFound and not overwrite:
        raise BackupError(f"there is something at {path} already")
    write_folder(pieces, path, "overwrite" if overwrite else "error", {"state_schema_version": STATE_VERSION, "format": state_format})


#: Records in a piece of a member.
PIECE_RECORDS = 1000


def record_pieces(records: DataFrame, file: str, by: str | None = None) -> DataFrame:
    """(file, pos, content): records (pos, record as JSON) as the text of one JSON array, in pieces of PIECE_RECORDS places, in the
    order of pos; without any an empty array. With `by` there is an array, and a column of that name, for each of its values."""
    keys = [by] if by else []
    part = F.floor(F.col("pos") / PIECE_RECORDS).alias("part")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "record"))), lambda r: r["record"])
    parts = records.groupBy(*keys, part).agg(F.array_join(texts, ",").alias("text"))
    if by:
        parts = parts.join(records.groupBy(by).agg(F.floor(F.min("pos") / PIECE_RECORDS).alias("_first")), by)
    else:
        first = records.agg(F.min("pos")).first()[0]
        parts = parts.withColumn("_first", F.lit(None if first is None else first // PIECE_RECORDS).cast("long"))
    comma = F.when(F.col("part") == F.col("_first"), "").otherwise(",")
    inner = parts.select(*keys, F.lit(file).alias("file"), F.col("part").cast("long").alias("pos"), F.concat(comma, "text").alias("content"))
    ends = (records.select(by).distinct() if by else records.sparkSession.range(1)).withColumn("_e", F.explode(F.array(F.struct(F.lit(-(1 << 62)).alias("pos"), F.lit("[").alias("content")), F.struct(F.lit((1 << 62)).alias("pos"), F.lit("]\n").alias("content")))))
    return inner.unionByName(ends.select(*keys, F.lit(file).alias("file"), F.col("_e.pos").cast("long").alias("pos"), F.col("_e.content").alias("content")))


def archive_members(spark: SparkSession, path: str, names: Iterable[str] = MEMBERS) -> DataFrame:
    """(archive, name, size, data): some members of all archives at path, as text; only their bytes are read. Long ones come in
    pieces, which are put together by order."""
    parts = zip_members(spark, path, members="|".join(names))
    whole = parts.groupBy("archive", "name", "size").agg(F.array_sort(F.collect_list(F.struct("part", F.col("content").cast("string").alias("text")))).alias("p"))
    return whole.select("archive", "name", "size", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("data"))


def archive_faults(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, fault): what keeps archives from being read, from their directories alone: "missing" and "duplicate"
    members, "unsafe" names."""
    listed = kept(zip_members(spark, path, content="false").select("archive", "name"), "zip-names")
    unsafe = listed.where(F.col("name").rlike(r"[/\\\\]") | F.col("name").isin("", ".", "..")).select("archive", "name", F.lit("unsafe").alias("fault"))
    counts = listed.groupBy("archive").pivot("name", list(MEMBERS)).count().na.fill(0)
    faults = [F.when(F.col(f"`{m}`") != 1, F.struct(F.lit(m).alias("name"), F.when(F.col(f"`{m}`") == 0, "missing").otherwise("duplicate").alias("fault"))) for m in MEMBERS]
    return unsafe.unionByName(counts.select("archive", F.explode(F.array_compact(F.array(*faults))).alias("f")).select("archive", "f.*"))


def update_member(spark: SparkSession, path: str, name: str, value: Any, state_format: str = "imported-data") -> None:
    """A state with one of its members rewritten, files and manifest, as one change."""
    write_state(replace_member(read_state(spark, path, state_format), name, value), path, state_format, overwrite=True)


def read_state(spark: SparkSession, path: str, state_format: str = "imported-data") -> DataFrame:
    """The members of a state folder, as from read_backup(), after checking the manifest and, of each file, size and hash.

    Version 2 may have its files in a folder `android`, and a group member, which is left out; write_state() writes
    what was read as the present version."""
    fs, at = _file_system(spark, path)
    head = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first().value)
    older = head.get("state_schema_version") == OLDER_STATE_VERSION
    if not older and head.get("state_schema_version") != STATE_VERSION or head.get("format") != state_format:
        raise BackupError("unsupported state version or format")
    listed = head.get("members") if isinstance(head.get("members"), list) else []
    names = Counter(m.get("name") for m in listed)
    wanted = set(MEMBERS) | ({"bookGroup.json"} & set(names) if older else set())
    if set(names) != wanted or max(names.values()) > 1 or any(m.get("kind") != "json" or not isinstance(m.get("size"), int) for m in listed):
        raise BackupError(f"the manifest doesn't list what a state has: {sorted(map(str, names))}")
    folder = f"{path}/android" if older and fs.exists(at(f"{path}/android")) else path
    told = spark.createDataFrame([(m["name"], m["size"], m.get("sha256")) for m in listed], "name string, size long, sha256 string")
    wrong = [(r.name, r.status) for r in integrity(spark, folder, told).where("status <> 'ok'").collect()]
    if wrong:
        raise BackupError(f"damaged state: {sorted(wrong)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, data = p.rpartition("/")[2], bytes(c)
                value = parse_member(name, data)
                text = json.dumps(sanitized(value), ensure_ascii=False, separators=(",", ":")) if name == "bookshelf.json" else data.decode().rstrip("\n")
                yield pa.RecordBatch.from_pydict({"archive": [p.rpartition("/")[0]], "name": [name], "size": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()], "data": [text], "ignored": pa.array([[]], pa.list_(pa.string()))})

    files = spark.read.format("binaryFile").load([f"{folder}/{m}" for m in MEMBERS])
    return files.select("path", "content").mapInArrow(run, _MEMBER_ROW)


def integrity(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """(name, status) for a folder of member files against listed (name, size, sha256): ok, missing, unlisted, size or hash."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("found_hash"))
    files = files.where(F.col("name") != "manifest.json")
    joined = listed.select("name", "size", "sha256").join(files, "name", "full_outer")
    status = F.when(F.col("found_size").isNull(), "missing").when(F.col("size").isNull(), "unlisted").when(F.col("size") != F.col("found_size"), "size")
    return joined.select("name", status.when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("found_hash")), "hash").otherwise("ok").alias("status"))


def replace_member(members: DataFrame, name: str, value: Any) -> DataFrame:
    """The members with one of them rewritten, checked as when it is read."""
    if name not in MEMBERS:
        raise BackupError(f"not a member: {name}")
    data = json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()
    parse_member(name, data)
    text = json.dumps(sanitized(value), ensure_ascii=False, separators=(",", ":")) if name == "bookshelf.json" else data.decode()
    mine = F.col("name") == name
    new = F.lit(text)
    return members.withColumns({"data": F.when(mine, new).otherwise(F.col("data")), "size": F.when(mine, F.octet_length(new).cast("long")).otherwise(F.col("size")), "sha256": F.when(mine, F.sha2(new.cast("binary"), 256)).otherwise(F.col("sha256"))})


def parse_sources(text: Column) -> Column:
    """Sources from pasted JSON, an object or an array, as JSON texts: those with a name and a URL."""
    whole = F.when(F.ltrim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    items = F.transform(F.from_json(whole, "array<variant>"), lambda v: F.to_json(v))
    named = lambda s: (F.coalesce(record_field("bookSourceName", s), F.lit("")) != "") & (F.coalesce(record_field("bookSourceUrl", s), F.lit("")) != "")
    return F.filter(items, named)
