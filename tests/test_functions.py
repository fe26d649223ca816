from pyspark.sql import functions as F

from fieldloom.functions import content, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers_and_times(spark):
    assert text.chinese_number("一千二百三十四") == 1234
    assert text.chinese_number("十二") == 12
    assert text.chinese_number("三万零五") == 30005
    assert text.chinese_number("x") is None
    assert one(spark, text.number_chapter(F.lit("第二十一章 a"))) == "第21章 a"
    assert one(spark, text.epoch_seconds(F.lit(1700000000123))) == 1700000000
    assert one(spark, text.epoch_seconds(F.lit("x"))) == 0
    assert one(spark, text.time_format_utc(F.lit(0) + 60, "HH:mm")) == "00:01"
    assert one(spark, text.bool_value(F.lit(" 付费 "))) is True


def test_encodings(spark):
    assert one(spark, text.base64_decode(F.lit("_-8"))) == b"\xff\xef"
    assert one(spark, text.hmac(F.lit("a"), "k")) == __import__("hmac").new(b"k", b"a", "sha256").hexdigest()
    for algorithm, key in (("md5", "k"), ("sha1", "k" * 100), ("sha512", "é"), ("HmacSHA256", "")):
        name = algorithm.lower().removeprefix("hmac")
        assert one(spark, text.hmac(F.lit("ü"), key, algorithm)) == __import__("hmac").new(key.encode(), "ü".encode(), name).hexdigest()
    enc = text.aes(F.lit("secret"), "0123456789abcdef")
    assert one(spark, text.aes(enc, "0123456789abcdef", encrypt=False).cast("string")) == "secret"
    assert one(spark, text.decode_charset(F.lit("中".encode("gbk")), "gbk")) == "中"
    assert one(spark, text.md5_middle(F.lit("a"))) == "c0f1b6a831c399e2"
    assert one(spark, text.cover_kind(F.lit(b"\x89PNG\r\n\x1a\n123"))) == "png"
    assert one(spark, text.safe_name(F.lit('a/b:"c"'))) == "a_b__c_"
    assert one(spark, text.safe_name(F.lit(None))) == "untitled" == one(spark, text.safe_name(F.lit(" \n")))


def test_byte_cuts(spark):
    """At every limit the longest whole characters that fit."""
    for sample in ("aé中😀b", "中中中", "😀😀", "", "abc"):
        for limit in range(len(sample.encode()) + 2):
            wanted = sample.encode()[:limit].decode(errors="ignore")
            assert one(spark, text.truncate_bytes_column(F.lit(sample), limit)) == wanted == text.truncate_bytes(sample, limit)


def test_factor_powers(spark):
    numbers = [0, 1, 2, 3, 31, 32, 33, 10**6, 2**40 + 12345]
    for n in numbers:
        assert one(spark, text.factor_power(F.lit(n).cast("long"))) == pow(33, n, 2**31 - 1)


def test_folded_texts(spark):
    h = 0
    for sample in ("a", "", "/é中"):
        for value in (len(sample.encode()), *sample.encode(), 0):
            h = (h * 33 + value) % (2**31 - 1)
    c, n = text.folded([F.lit("a"), F.lit(None).cast("string"), F.lit("/é中")])
    assert one(spark, c) == h and one(spark, n) == 13


def test_keys(spark):
    assert one(spark, text.canonical_title(F.lit(" 第1章：Hello, World！ "))) == "第1章helloworld"
    assert one(spark, text.match_name(F.lit("《A·B》 c"))) == "abc"
    assert one(spark, text.search_key(F.lit(" A b"), F.lit("C"), F.lit("u"))) == "ab\tc"
    assert one(spark, text.search_key(F.lit(None), F.lit("C"), F.lit(None))) == ""
    assert one(spark, text.group_tokens(F.lit("a, b，c|"))) == ["a", "b", "c"]


def test_urls(spark):
    cases = {"x": "http://h/d/x", "/x": "http://h/x", "//k/x": "http://k/x", "../x": "http://h/x", "data:,a": "data:,a", "https://o/": "https://o/", "": "", 'y,{"method":"POST"}': 'http://h/d/y,{"method":"POST"}', "?q": "http://h/d/p?q"}
    for link, expected in cases.items():
        assert one(spark, urls.absolute_url(F.lit("http://h/d/p"), F.lit(link))) == expected, link
    assert one(spark, urls.choose_page(F.lit("/l<,_2,_3>.html"), 5)) == "/l_3.html"
    assert one(spark, urls.data_uri(F.lit("data:text/plain;base64,YQ=="))) == b"a"
    assert one(spark, urls.data_uri(F.lit("data:,a%20b"))) == b"a b"
    o = one(spark, urls.split_options(F.lit("u, {“a”:1}")))
    assert (o.url, o.options) == ("u", '{"a":1}')
    assert one(spark, urls.encode_uri(F.lit("a b/ü"))) == "a%20b%2F%C3%BC"


def test_content():
    html = "<head>no</head><!-- c --><p>A &amp; B<br/>C<script>x</p></script><img src=a>d</p><![CDATA[raw]]> 3 < 4"
    assert content.clean_lines(content.html_to_text(html)) == "A & B\nCd\nraw 3 < 4"
    assert content.html_to_text("a <3 b>c") == "a <3 b>c"
    assert content.html_to_text("<style>never closed") == ""
    assert content.clean_lines("﻿ a  b \r\n\r\n　c　") == "a b\nc"
    assert content.decode_entities("&#65;&#x42;&hellip;&unknown;&#xD800;") == "AB…&unknown;&#xD800;"
    assert content.without_title("《One》\ntext", "One") == ("text", True)
    assert content.without_title("Book\nOne\ntext", "One", "Book") == ("text", True)
    assert content.without_title("BookOne\ntext", "One", "Book") == ("text", True)
    assert content.without_title("Another\ntext", "One") == ("Another\ntext", False)
    assert content.to_xhtml("a<b\n\nc") == "<p>a&lt;b</p>\n<p>c</p>"


def test_content_columns(spark):
    row = one(spark, content.process_content(F.lit("<h1>T</h1><p>x</p>"), F.lit("T")))
    assert (row.text, row.same_title_removed) == ("x", True)
    assert one(spark, content.clean_lines_column(F.lit(" a \r\n\r\n　b"))) == "a\nb"
    assert one(spark, content.paragraphs(F.lit("a&b\nc"))) == "<p>a&amp;b</p>\n<p>c</p>"
    assert one(spark, content.content_text(F.lit(None).cast("string"))) == ""


def test_lists_of_urls(spark):
    of = lambda *links: one(spark, urls.absolute_urls(F.lit("http://h/a/b?c"), F.array(*map(F.lit, links))))
    assert of("/x", "//k/y", "http://z/", "", "/x", " /w ") == ["http://h/x", "http://k/y", "http://z/", "http://h/w"]
    assert of("n", "/x", "../m,{\"a\":1}") == ["http://h/a/n", "http://h/x", 'http://h/m,{"a":1}'] and of() == []
    assert one(spark, urls.absolute_urls(F.lit("http://h/"), F.lit(None).cast("array<string>"))) == []
