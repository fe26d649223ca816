"""Text: normalisation, keys for matching, numbers and times, encodings and digests, as columns."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK punctuation that chapter titles differ in (fixed values).
TITLE_MARKS = "，。！？：；、“”‘’（）【】《》〈〉「」『』〔〕—–…·"
#: The same for source matching (fixed values).
MATCH_MARKS = "，。！？：；、“”‘’（）【】《》〈〉—…·"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Digits and units of Chinese numerals (fixed values).
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SMALL_UNITS = {"十": 10, "百": 100, "千": 1000}
LARGE_UNITS = {"万": 10_000, "亿": 100_000_000}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def without_space(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"\s+", "")


def history_key(name: Column | str, author: Column | str) -> Column:
    """name and author, trimmed and in lower case, with a tab between."""
    part = lambda c: F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))
    return F.concat(part(name), F.lit("\t"), part(author))


def search_key(name: Column | str, author: Column | str, url: Column | str) -> Column:
    """What merges hits of several sources: name (or url) and author without space; empty if there is neither name nor url."""
    head = F.when(without_space(name) != "", without_space(name)).otherwise(without_space(url))
    return F.when(head == "", "").otherwise(F.concat(head, F.lit("\t"), without_space(author)))


def canonical_title(c: Column | str) -> Column:
    """A chapter title as sources agree on it: no space, control, ASCII or CJK punctuation, lower case."""
    return F.translate(F.regexp_replace(without_space(c), rf"{ASCII_PUNCTUATION}|[\x00-\x1f\x7f]", ""), TITLE_MARKS, "")


def match_name(c: Column | str) -> Column:
    """A title or author for matching across sources, by code points."""
    return F.regexp_replace(F.translate(without_space(c), MATCH_MARKS, ""), ASCII_PUNCTUATION, "")


def epoch_seconds(c: Column | str) -> Column:
    """Seconds from a number of seconds or milliseconds; 0 for what is no positive number."""
    n = _c(c).try_cast("double")
    return F.when(n > 0, F.floor(F.when(n > 1e11, n / 1000).otherwise(n))).otherwise(0).cast("long")


def bool_value(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(_c(c).cast("string"), F.lit("")))).isin("true", "1", "yes", "vip", "付费")


def time_format(seconds: Column | str, pattern: str = "yyyy/MM/dd HH:mm") -> Column:
    """Epoch seconds or milliseconds as text, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(epoch_seconds(seconds)), pattern)


def time_format_utc(seconds: Column | str, pattern: str = "yyyy/MM/dd HH:mm", shift_hours: int = 0) -> Column:
    zone = F.current_timezone()
    utc = F.to_utc_timestamp(F.timestamp_seconds(epoch_seconds(seconds)), zone)
    return F.date_format(utc + F.expr(f"INTERVAL {shift_hours} HOURS"), pattern)


def group_tokens(c: Column | str) -> Column:
    """The names in a group field, which commas of either kind or bars separate."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"[,，|]"), lambda t: F.trim(t)), lambda t: t != "")


def base64_encode(c: Column | str, url_safe: bool = False, padding: bool = True) -> Column:
    out = F.replace(F.replace(F.base64(_c(c).cast("binary")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    out = F.translate(out, "+/", "-_") if url_safe else out
    return out if padding else F.rtrim(out, F.lit("="))


def base64_decode(c: Column | str) -> Column:
    """Bytes of either alphabet, with or without padding; null if it is neither."""
    text = F.rtrim(F.translate(F.regexp_replace(_c(c), r"\s", ""), "-_", "+/"), F.lit("="))
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64"))


def hex_encode(c: Column | str) -> Column:
    return F.lower(F.hex(_c(c).cast("binary")))


def hex_decode(c: Column | str) -> Column:
    return F.unhex(_c(c))


def md5_middle(c: Column | str) -> Column:
    """The 16 digits in the middle of the MD5."""
    return F.substring(F.md5(_c(c).cast("binary")), 9, 16)


def digest(c: Column | str, algorithm: str, form: str = "hex") -> Column:
    """MD5, SHA-1 or SHA-2 in hex or base64."""
    data, name = _c(c).cast("binary"), algorithm.upper().replace("-", "")
    hexed = F.md5(data) if name == "MD5" else F.sha1(data) if name == "SHA1" else F.sha2(data, int(name.removeprefix("SHA")))
    return hexed if form == "hex" else base64_encode(F.unhex(hexed))


#: Bytes in a block of the hash functions (fixed values of their standards).
_BLOCKS = {"md5": 64, "sha1": 64, "sha224": 64, "sha256": 64, "sha384": 128, "sha512": 128}


def hmac(c: Column | str, key: str, algorithm: str = "sha256", form: str = "hex") -> Column:
    """A keyed digest: the hash of the outer pad and the hash of the inner pad and the value."""
    name = algorithm.lower().replace("-", "").removeprefix("hmac")
    block, secret = _BLOCKS[name], key.encode()
    secret = (hashlib.new(name, secret).digest() if len(secret) > block else secret).ljust(block, b"\0")
    padded = lambda pad, data: F.concat(F.lit(bytes(b ^ pad for b in secret)), data)
    inner = F.unhex(digest(padded(0x36, _c(c).cast("binary")), name))
    return digest(padded(0x5C, inner), name, form)


def aes(c: Column | str, key: str, encrypt: bool = True, mode: str = "CBC", iv: str | None = None) -> Column:
    """AES with a key of 16, 24 or 32 bytes; encrypt gives bytes, which may be hexed or put in base64."""
    options = [F.lit(key.encode()), F.lit(mode), F.lit("DEFAULT")]
    if encrypt:
        return F.aes_encrypt(_c(c).cast("binary"), *options, *([F.lit(iv.encode())] if iv else []))
    return F.aes_decrypt(_c(c), *options)


def bytes_slice(c: Column | str, start: int, length: int) -> Column:
    return F.substring(_c(c).cast("binary"), start + 1, length)


def bytes_at(c: Column | str, place: int) -> Column:
    """The byte at a place from 0, as a number from 0 to 255; null beyond the end."""
    one = bytes_slice(c, place, 1)
    return F.when(F.octet_length(one) > 0, F.conv(F.hex(one), 16, 10).cast("int"))


def bytes_array(c: Column | str) -> Column:
    """All bytes as numbers from 0 to 255."""
    return F.transform(F.regexp_extract_all(F.hex(_c(c).cast("binary")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def bytes_length(c: Column | str) -> Column:
    return F.octet_length(_c(c).cast("binary"))


def word_count(c: Column | str) -> Column:
    """Bytes of the text, which is how chapters are measured."""
    return F.octet_length(F.coalesce(_c(c), F.lit("")))


def decode_charset(c: Column | str, charset: str) -> Column:
    """Text of bytes; charsets that the JVM side doesn't offer are decoded in an Arrow UDF. Broken bytes become U+FFFD."""
    if charset.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16"):
        return F.decode(_c(c), charset)

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bytes(v).decode(charset, "replace"))

    return read(_c(c))


def translate_script(c: Column | str, pairs: dict[str, str]) -> Column:
    """Characters replaced one for one, such as traditional by simplified ones; the pairs are the caller's."""
    return F.translate(_c(c), "".join(pairs), "".join(pairs.values()))


#: Common characters in their traditional and simplified forms (fixed values).
TRADITIONAL_TO_SIMPLIFIED = {
    "國": "国", "學": "学", "說": "说", "書": "书", "體": "体", "門": "门", "開": "开", "關": "关", "時": "时", "間": "间", "長": "长", "點": "点",
    "現": "现", "發": "发", "後": "后", "裡": "里", "這": "这", "個": "个", "們": "们", "為": "为", "與": "与", "從": "从", "無": "无", "過": "过",
    "來": "来", "見": "见", "萬": "万", "應": "应", "實": "实", "當": "当", "動": "动", "華": "华", "語": "语", "讀": "读", "寫": "写",
}


def to_simplified(c: Column | str) -> Column:
    return translate_script(c, TRADITIONAL_TO_SIMPLIFIED)


def to_traditional(c: Column | str) -> Column:
    return translate_script(c, {simple: form for form, simple in TRADITIONAL_TO_SIMPLIFIED.items()})


def html_format(c: Column | str) -> Column:
    """Line ends unified, <br> in one form, a line end after each closing p; other markup stays."""
    text = F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"<\s*br\s*/?\s*>", "<br/>")
    return F.regexp_replace(text, r"<\s*/\s*p\s*>", "</p>\n")


def chinese_number(text: str) -> int | None:
    """The value of a Chinese or decimal numeral; None if it is neither."""
    text = text.strip()
    if text.isdigit() and text.isascii():
        return int(text)
    if not text:
        return None
    total = part = 0
    digit: int | None = None
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in SMALL_UNITS:
            part += (1 if digit is None else digit) * SMALL_UNITS[c]
            digit = None
        elif c in LARGE_UNITS:
            total += ((part + (digit or 0)) or 1) * LARGE_UNITS[c]
            part, digit = 0, None
        else:
            return None
    return total + part + (digit or 0)


def number_chapter(c: Column | str) -> Column:
    """第...章 with the numeral in between as decimal digits; other texts as they are."""

    def one(text: str | None) -> str | None:
        m = re.search(r"第(.+?)章", text or "", re.DOTALL)
        n = chinese_number(m[1]) if m else None
        return text if n is None else f"{text[: m.start(1)]}{n}{text[m.end(1) :]}"

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(one)

    return convert(_c(c))


def truncate_bytes(text: str | None, limit: int) -> str:
    """The longest start of a text within so many UTF-8 bytes."""
    return (text or "").encode()[:limit].decode(errors="ignore")


def truncate_bytes_column(c: Column | str, limit: int) -> Column:
    """truncate_bytes() as a column: the cut goes back over the bytes of a character that it would divide."""
    data = F.coalesce(_c(c), F.lit("")).cast("binary")
    cut = F.substring(data, 1, limit)
    # the hex digits of a lead byte without all that belongs to it, at the end
    broken = r"(?:[CD].|E.(?:[89AB].){0,1}|F.(?:[89AB].){0,2})$"
    whole = F.unhex(F.regexp_replace(F.hex(cut), "^((?:..)*?)" + broken, "$1"))
    return F.when(F.octet_length(data) <= limit, data).otherwise(whole).cast("string")


def safe_name(c: Column | str, limit: int = 80, otherwise: str = "untitled") -> Column:
    """A name that fits a file system: separators and controls become underscores, at most limit bytes."""
    ends = r"^\s+|\s+$"
    named = F.regexp_replace(F.regexp_replace(F.coalesce(_c(c), F.lit("")), ends, ""), r'[\\/:*?"<>|\x00-\x1f]', "_")
    return F.coalesce(F.nullif(F.regexp_replace(truncate_bytes_column(named, limit), ends, ""), F.lit("")), F.lit(otherwise))


#: The hash of a reading session: h * FACTOR + value modulo MODULUS over all values, from SEED (fixed values).
FACTOR, MODULUS, SEED = 33, (1 << 31) - 1, 5381


def folded(texts: list[Column]) -> tuple[Column, Column]:
    """What some texts do to the hash, as a map h -> h * FACTOR^n + c: the columns c and n. A text is its length in bytes, its
    bytes, and a zero. Such maps can be put together in any grouping, so ranges of a list are hashed apart."""
    values = F.concat(*[x for t in texts for x in (F.array(F.octet_length(F.coalesce(t, F.lit("")))), bytes_array(F.coalesce(t, F.lit(""))), F.array(F.lit(0)))])
    return F.aggregate(values, F.lit(0).cast("long"), lambda h, v: (h * FACTOR + v) % MODULUS), F.size(values).cast("long")


def factor_power(n: Column) -> Column:
    """FACTOR^n modulo MODULUS, by the bits of n."""
    powers = [pow(FACTOR, 1 << k, MODULUS) for k in range(48)]
    bits = F.array(*[F.struct(F.lit(k).alias("bit"), F.lit(p).cast("long").alias("power")) for k, p in enumerate(powers)])
    is_set = lambda k: F.call_function("shiftright", n, k).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.aggregate(bits, F.lit(1).cast("long"), lambda h, x: F.when(is_set(x["bit"]), (h * x["power"]) % MODULUS).otherwise(h))


def cover_kind(c: Column | str) -> Column:
    """The image format of some bytes by how they begin; null if unknown."""
    head = F.hex(F.substring(_c(c), 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("474946383"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("424D"), "bmp")
    )
