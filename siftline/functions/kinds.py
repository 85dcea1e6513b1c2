"""Kinds of input files and of mail providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import ascii_lower

# Each kind's endings, the ending of its output, its family and what converts it.
KINDS = [
    ("png", "png", "jpg", "image", "ffmpeg"),
    ("jpeg", "jpg jpeg", "jpg", "image", ""),
    ("heic", "heic", "jpg", "image", "ffmpeg"),
    ("mov", "mov", "mp4", "video", "ffmpeg"),
    ("m4v", "m4v", "mp4", "video", "ffmpeg"),
    ("mp4", "mp4", "mp4", "video", "ffmpeg"),
    ("mp4-audio", "mp4", "opus", "audio", "ffmpeg"),
    ("numbers", "numbers", "csv", "spreadsheet", "soffice"),
    ("xlsx", "xlsx", "csv", "spreadsheet", ""),
    ("xls", "xls", "csv", "spreadsheet", ""),
    ("csv", "csv", "csv", "spreadsheet", ""),
    ("m4a", "m4a", "opus", "audio", "ffmpeg"),
    ("mp3", "mp3", "opus", "audio", "ffmpeg"),
    ("aac", "aac", "opus", "audio", "ffmpeg"),
    ("wav", "wav", "opus", "audio", "ffmpeg"),
    ("opus", "opus", "opus", "audio", "ffmpeg"),
    ("doc", "doc", "pdf", "document", "soffice"),
    ("docx", "docx", "pdf", "document", "soffice"),
    ("pages", "pages", "pdf", "document", "soffice"),
    ("rtf", "rtf", "pdf", "document", "soffice"),
    ("pdf", "pdf", "pdf", "document", ""),
    ("epub", "epub", "pdf", "document", "ebook-convert"),
    ("pptx", "pptx", "pdf", "document", "soffice"),
    ("key", "key", "pdf", "document", "soffice"),
    ("txt", "txt", "txt", "text", ""),
    ("md", "md markdown mkd", "txt", "text", "pandoc"),
    ("rst", "rst", "txt", "text", "pandoc"),
    ("textclipping", "textclipping", "txt", "text", ""),
    ("tsv", "tsv", "csv", "table", ""),
    ("avif", "avif", "jpg", "image", "ffmpeg"),
    ("tif", "tif", "jpg", "image", "ffmpeg"),
    ("tiff", "tiff", "jpg", "image", "ffmpeg"),
    ("webp", "webp", "jpg", "image", "ffmpeg"),
    ("ico", "ico", "png", "icon", "ffmpeg"),
    ("icns", "icns", "png", "icon", "ffmpeg"),
    ("procreate", "procreate", "png", "icon", ""),
    ("procreate-2", "procreate 2", "png", "icon", ""),
    ("ai", "ai", "svg", "vector", "soffice"),
    ("emz", "emz", "svg", "vector", "soffice"),
    ("svg", "svg", "svg", "vector", ""),
    ("bmp", "bmp", "jpg", "image", "ffmpeg"),
    ("eps", "eps", "svg", "vector", "gs"),
    ("ics", "ics", "txt", "text", ""),
    ("vcf", "vcf", "txt", "text", ""),
]
# Other names that kinds go by; bit rates and rate factors of qualities; domains and hosts of providers.
ALIASES = {"jpg": "jpeg", "markdown": "md", "mkd": "md", "procreate 2": "procreate-2"}
AUDIO_QUALITY = {"low": "32k", "medium": "48k", "high": "96k", "transparent": "128k"}
VIDEO_QUALITY = {"low": 30, "medium": 24, "high": 20, "lossless": None}
DOMAINS = {
    "gmail.com": "gmail",
    "googlemail.com": "gmail",
    "fastmail.com": "fastmail",
    "fastmail.fm": "fastmail",
    "icloud.com": "icloud",
    "me.com": "icloud",
    "mac.com": "icloud",
}
HOSTS = {
    "gmail": "imap.gmail.com",
    "fastmail": "imap.fastmail.com",
    "icloud": "imap.mail.me.com",
    "proton": "127.0.0.1",
}
PORTS = {"gmail": 993, "fastmail": 993, "icloud": 993, "proton": 1143}


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def dimension(spark: SparkSession) -> DataFrame:
    """One row a kind and ending; 47 rows, so joins with it broadcast it."""
    rows = [(k, e, out, family, tool or None, not tool and out in ends.split(" ")) for k, ends, out, family, tool in KINDS for e in ([ends] if k == "procreate-2" else ends.split(" "))]
    return F.broadcast(spark.createDataFrame(rows, "kind string, ending string, output string, family string, tool string, copied boolean"))


def parse_kind(text: Column) -> Column:
    """The kind that a name stands for; any other name is an error."""
    low = ascii_lower(text)
    name = F.coalesce(lookup(ALIASES, low), low)
    return F.when(name.isin([k[0] for k in KINDS]), name).otherwise(F.raise_error(F.concat(F.lit("unknown kind of input file: "), text)))


def provider(email: Column) -> Column:
    """The provider of an address by its domain, null for unknown ones."""
    return lookup(DOMAINS, ascii_lower(F.substring_index(email, "@", -1)))


def provider_host(name: Column) -> Column:
    return lookup(HOSTS, name)


def security(name: Column, port: Column) -> Column:
    """How a connection is secured when nothing else is said."""
    return F.when((name == "proton") | (name.isNull() & (port == 143)), "starttls").otherwise("tls")
