"""Books out of sections: XHTML chapters, one text file, EPUB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import paragraphs, xml_escape
from ..functions.text import safe_name
from .containers import write_archives

#: A whole book has at most so many chapters and bytes (fixed values).
MOST_CHAPTERS, MOST_BYTES = 5000, 25 * 1024 * 1024


def chapter_html(title: Column, text: Column) -> Column:
    """A chapter as an XHTML document."""
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), xml_escape(title), F.lit("</title></head><body>\n<h1>"))
    return F.concat(head, xml_escape(title), F.lit("</h1>\n"), paragraphs(text), F.lit("\n</body></html>"))


def over_cap(sections: DataFrame, book: str = "book", most_chapters: int | None = MOST_CHAPTERS, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(book, chapters, bytes, over): whether a book passes the limits on chapters and bytes; None is no limit."""
    out = sections.groupBy(book).agg(F.count("*").alias("chapters"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    beyond = lambda c, most: F.lit(False) if most is None else F.col(c) > most
    return out.withColumn("over", beyond("chapters", most_chapters) | beyond("bytes", most_bytes))


def within_cap(sections: DataFrame, book: str = "book", **limits: int | None) -> DataFrame:
    """Sections of books within the limits; over_cap() lists the others. What makes one text out of a book's sections takes
    these alone, so a book fits a task."""
    small = over_cap(sections, book, **limits).where("NOT over").select(book)
    return sections.join(small, book, "left_semi")


def book_text(sections: DataFrame, book: str = "book", head: bool = False, **limits: int) -> DataFrame:
    """(book, text): sections (book, index, title, content) in order, each under its title, of books within the cap.

    With head, the book's name and author (columns name and author, the latter blank or not) come first."""
    text = lambda c: F.coalesce(c, F.lit(""))
    part = F.concat(text("title"), F.lit("\n\n"), text("content"))
    ordered = F.array_sort(F.collect_list(F.struct("index", part.alias("part"))))
    body = F.array_join(F.transform(ordered, lambda s: s["part"]), "\n\n")
    if head:
        first = lambda c: F.min_by(c, "index")
        body = F.concat(F.concat_ws("\n", text(first("name")), F.nullif(F.trim(text(first("author"))), F.lit("")), F.lit("")), F.lit("\n"), body, F.lit("\n"))
    return within_cap(sections, book, **limits).groupBy(book).agg(body.alias("text"))


def pending_sections(chapters: DataFrame, done: DataFrame, book: str = "book") -> DataFrame:
    """Chapters (book, index, name, url) of which done (book, index) has no content yet: what a download that was broken off
    goes on with. Books over the number of chapters are left out as a whole."""
    counted = chapters.groupBy(book).agg(F.count("*").alias("_n")).where(F.col("_n") <= MOST_CHAPTERS).select(book)
    return chapters.join(counted, book, "left_semi").join(done.select(book, "index"), [book, "index"], "left_anti")


#: Entries of an EPUB that don't depend on the book. The names, media types and namespaces are those of the standard.
MEDIA_TYPE = "application/epub+zip"
CONTAINER = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0">'
    '<rootfiles><rootfile media-type="application/oebps-package+xml" full-path="book.opf"/></rootfiles></container>'
)
#: Where the second half of a document's pieces begins, beyond any chapter's number.
BEYOND = 1 << 40


def epub_pieces(sections: DataFrame, **limits: int) -> DataFrame:
    """Rows for containers.write_archives(): the EPUBs of all books, from sections (book, author, index, title, content).
    Files are named after the books. Only a caller who gives limits (see over_cap()) leaves out the books beyond them.

    Documents that list all chapters (the package, the contents for readers of either version) are made of a piece for each
    chapter and a few around them, so no row ever has a book or a list of its chapters. A task that numbers a book's chapters
    sorts them, on disk where they are many."""
    rows = within_cap(sections, **({"most_chapters": None, "most_bytes": None} | limits)) if limits else sections
    # chapters with one index in the order of what they hold
    number = F.row_number().over(Window.partitionBy("book").orderBy("index", "title", "content")).cast("long")
    file = F.concat(safe_name(F.col("book").cast("string")), F.lit(".epub"))
    chapters = rows.select(file.alias("file"), F.col("book").cast("string").alias("book"), number.alias("n"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("text"))
    heads = rows.groupBy("book").agg(F.min_by("author", "index").alias("author")).select(file.alias("file"), xml_escape(F.coalesce(F.col("book").cast("string"), F.lit(""))).alias("book"), xml_escape(F.coalesce("author", F.lit(""))).alias("author"))
    digits = F.col("n").cast("string")
    page = F.concat(F.lit("text/"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")), F.lit(".xhtml"))
    xml = '<?xml version="1.0" encoding="UTF-8"?>\n'

    def piece(rank: int, name: str | Column, pos: int | Column, *texts: str | Column, stored: bool = False) -> Column:
        column = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
        return F.struct(F.lit(rank).cast("long").alias("rank"), column(name).alias("name"), column(pos).cast("long").alias("pos"), F.concat(*map(column, texts)).alias("content"), F.lit(stored).alias("stored"))

    label = xml_escape(F.col("title"))
    # all pieces of a row at once: books are dealt and numbered once, whatever their documents are
    of_book = [
        piece(0, "mimetype", 0, MEDIA_TYPE, stored=True),
        piece(1, "META-INF/container.xml", 0, CONTAINER),
        piece(2, "book.opf", 0, xml, '<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="book-id" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>', F.col("book"), "</dc:title><dc:creator>", F.col("author"), '</dc:creator><dc:identifier id="book-id">', F.sha2(F.concat_ws("\n", "book", "author"), 256), '</dc:identifier><dc:language>und</dc:language></metadata><manifest>'),
        piece(2, "book.opf", BEYOND, '<item media-type="application/xhtml+xml" href="contents.xhtml" id="contents" properties="nav"/><item media-type="application/x-dtbncx+xml" href="contents.ncx" id="older-contents"/></manifest><spine toc="older-contents">'),
        piece(2, "book.opf", 2 * BEYOND, "</spine></package>"),
        piece(3, "contents.xhtml", 0, xml, '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>', F.col("book"), '</title></head><body><nav epub:type="toc"><ol>'),
        piece(3, "contents.xhtml", BEYOND, "</ol></nav></body></html>"),
        piece(4, "contents.ncx", 0, xml, '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>', F.col("book"), "</text></docTitle><navMap>"),
        piece(4, "contents.ncx", BEYOND, "</navMap></ncx>"),
    ]
    of_chapter = [
        piece(2, "book.opf", F.col("n"), '<item media-type="application/xhtml+xml" href="', page, '" id="page-', F.col("n").cast("string"), '"/>'),
        piece(2, "book.opf", F.col("n") + BEYOND, '<itemref idref="page-', F.col("n").cast("string"), '"/>'),
        piece(3, "contents.xhtml", F.col("n"), '<li><a href="', page, '">', label, "</a></li>"),
        piece(4, "contents.ncx", F.col("n"), '<navPoint playOrder="', F.col("n").cast("string"), '" id="at-', F.col("n").cast("string"), '"><navLabel><text>', label, '</text></navLabel><content src="', page, '"/></navPoint>'),
        piece(5, page, 0, chapter_html(F.col("title"), F.col("text"))),
    ]
    return heads.select("file", F.inline(F.array(*of_book))).unionByName(chapters.select("file", F.inline(F.array(*of_chapter))))


def write_epubs(sections: DataFrame, path: str, mode: str = "error", **limits: int) -> None:
    """An EPUB file for each book of sections (book, author, index, title, content), in a folder at path; with limits, for
    each book within them."""
    write_archives(epub_pieces(sections, **limits), path, mode)
