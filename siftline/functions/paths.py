"""Column functions on object keys, file names and aliases."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Longest file name in bytes, longest sheet slug, hex digits of a group's digest.
NAME_BYTES, SHEET_SLUG, DIGEST_DIGITS = 100, 40, 16


def ascii_lower(c: Column) -> Column:
    """c with A-Z lowered and every other character left as it is."""
    return F.translate(c, UPPER, LOWER)


def after_zip_separator(key: Column) -> Column:
    """What follows the last "!" of a key, the whole key without one."""
    return F.substring_index(key, "!", -1)


def basename(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def extension_of(key: Column) -> Column:
    """Lower-cased extension of a key's or archive member's last segment; "(none)" for none and for dotfiles."""
    base = basename(after_zip_separator(key))
    return F.when(base.rlike(r"(?s)^.+\.[^.]*$"), ascii_lower(F.substring_index(base, ".", -1))).otherwise("(none)")


def is_apple_double(key: Column) -> Column:
    return F.startswith(basename(key), F.lit("._"))


def is_lock_stub(key: Column) -> Column:
    return F.startswith(basename(key), F.lit("~$"))


def is_undated(key: Column) -> Column:
    """Does the name, behind any archive separator, begin with the all-zero date?"""
    return F.startswith(basename(after_zip_separator(key)), F.lit("0000-00-00-"))


def is_zip(key: Column) -> Column:
    return extension_of(key) == "zip"


def is_skippable_member(name: Column) -> Column:
    """Archive members that systems leave behind: resource forks, folder settings, version control, packages."""
    base = basename(name)
    return (
        F.startswith(name, F.lit("__MACOSX/"))
        | F.startswith(base, F.lit("._"))
        | (base == ".DS_Store")
        | F.arrays_overlap(F.split(name, "/"), F.array(F.lit(".git"), F.lit("node_modules")))
    )


def has_extension(key: Column, *extensions: str) -> Column:
    return ascii_lower(extension_of(key)).isin(*extensions)


def _continues(data: Column, at: Column) -> Column:
    """Is the byte at this place (from 1) inside a character?"""
    return F.hex(F.substr(data, at, F.lit(1))).between("80", "BF")


def cut_bytes(text: Column, most: Column) -> Column:
    """The longest beginning of text of at most so many bytes that ends between characters."""
    data = F.encode(text, "UTF-8")
    most = most.cast("int")
    back = F.when(~_continues(data, most + 1), 0).when(~_continues(data, most), 1).when(~_continues(data, most - 1), 2).otherwise(3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substr(data, F.lit(1), most - back), "UTF-8"))


def last_component(name: Column) -> Column:
    """Last path component as file systems see it: trailing slashes and dot segments count for nothing, ".." is none."""
    trimmed = F.regexp_replace(name, r"(?s)(/+\.?)+$", "")
    base = F.substring_index(F.when(name.rlike(r"(?s)^\.(/+\.?)*$"), F.lit("")).otherwise(trimmed), "/", -1)
    return F.when((base == "") | (base == "..") | (base == "."), F.lit(None)).otherwise(base)


def sanitize_filename(name: Column, most: int = NAME_BYTES) -> Column:
    """Last component, cut to so many bytes with its extension kept where that is short; "file" if nothing is left."""
    base = last_component(name)
    ext = F.substring_index(base, ".", -1)
    stem = F.substr(base, F.lit(1), F.length(base) - F.length(ext) - 1)
    keeps = F.contains(base, F.lit(".")) & (ext != "") & (F.octet_length(ext) + 1 < most)
    long = F.when(keeps, F.concat(cut_bytes(stem, F.lit(most - 1) - F.octet_length(ext)), F.lit("."), ext)).otherwise(cut_bytes(base, F.lit(most)))
    return F.coalesce(F.when(F.octet_length(base) <= most, base).otherwise(long), F.lit("file"))


def slugify(name: Column, most: int, fallback: str) -> Column:
    """Letters, digits, dot, underscore and hyphen stay, runs of anything else become one hyphen."""
    kept = F.regexp_replace(F.regexp_replace(name, r"^[^A-Za-z0-9._-]+", ""), r"[^A-Za-z0-9._-]+", "-")
    cut = F.regexp_replace(F.substring(kept, 1, most), r"^-+|-+$", "")
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def sheet_slug(name: Column) -> Column:
    return slugify(name, SHEET_SLUG, "sheet")


def strict_stem(name: Column) -> Column:
    return F.coalesce(slugify(last_component(name), NAME_BYTES, "file"), F.lit("file"))


def sanitize_segment(text: Column) -> Column:
    """ASCII letters (lowered) and digits, runs of anything else as one hyphen between them."""
    joined = F.regexp_replace(F.regexp_replace(text, "^[^A-Za-z0-9]+", ""), "[^A-Za-z0-9]+", "-")
    return F.regexp_replace(F.lower(F.substring(joined, 1, NAME_BYTES)), "-$", "")


def sanitize_alias(email: Column) -> Column:
    return sanitize_segment(F.substring_index(email, "@", 1))


def sanitize_mailbox(mailbox: Column, delimiter: str | None) -> Column:
    """A mailbox name as a path: each level a segment, empty ones dropped."""
    levels = F.split(mailbox, "\\Q" + delimiter + "\\E") if delimiter else F.array(mailbox)
    return F.array_join(F.filter(F.transform(levels, sanitize_segment), lambda s: s != ""), "/")


def group_key(source: Column, relpath: Column, strict: bool = False) -> Column:
    """Stem and digest by which all outputs of one source file are known."""
    base = basename(relpath)
    stem_of = F.when(base.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_replace(base, r"(?s)\.[^.]*$", "")).otherwise(base)
    stem = strict_stem(stem_of) if strict else sanitize_filename(stem_of)
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(F.concat(source, F.lit("\x01"), relpath), 256), 1, DIGEST_DIGITS))


def destination_name(source: Column, relpath: Column, extension: str, strict: bool = False) -> Column:
    return F.concat(group_key(source, relpath, strict), F.lit(f".{extension}"))


def two_digits(n: Column) -> Column:
    """At least two digits; more where the number has more."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(2), F.length(text)), F.lit("0"))


def sheet_name(group: Column, index: Column, total: Column, name: Column, extension: str) -> Column:
    return F.concat(group, F.lit("-"), two_digits(index), F.lit("of"), two_digits(total), F.lit("-"), sheet_slug(name), F.lit(f".{extension}"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use refers to it, also in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def candidate_groups(stem: Column) -> Column:
    """All beginnings of a stem that end in "-" and 16 hex digits, at the stem's end or before another "-", with the rest."""
    # a digest holds no "-", so one split finds them all; each is as long as the others
    mark = f"-[0-9a-f]{{{DIGEST_DIGITS}}}(?=-|$)"

    def groups(x: Column) -> Column:
        pieces, length = x["pieces"], F.length(x["stem"])
        one = F.length(F.get(pieces, F.lit(0))) + DIGEST_DIGITS + 1
        ends = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda _, k: F.aggregate(F.slice(pieces, F.lit(1), k + 1), F.lit(0), lambda n, p: n + F.length(p) + DIGEST_DIGITS + 1))
        cut = lambda e: F.struct(F.substr(x["stem"], F.lit(1), e).alias("grp"), F.substr(x["stem"], e + 1, length).alias("rest"))
        # nearly all names have one
        return F.when(F.size(pieces) == 2, F.array(cut(one))).otherwise(F.transform(ends, cut))

    return bound(F.struct(stem.alias("stem"), F.split(stem, mark, -1).alias("pieces")), groups)


def sheet_marker(rest: Column) -> Column:
    """(index, total) of a "-NNofMM-" marker, null unless 1 <= index <= total."""
    return marker_numbers(marker_text(rest))


def marker_text(rest: Column) -> Column:
    """NNofMM of a "-NNofMM-" marker."""
    return F.regexp_extract(rest, "^-([0-9]+of[0-9]+)-", 1)


def marker_numbers(mark: Column) -> Column:
    index = F.substring_index(mark, "of", 1).try_cast("bigint")
    total = F.substring_index(mark, "of", -1).try_cast("bigint")
    return F.when((index >= 1) & (index <= total), F.struct(index.alias("index"), total.alias("total")))


def path_prefixes(key: Column) -> Column:
    """a, a/b, a/b/c for a/b/c."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def local_fold(key: Column) -> Column:
    """What two keys share on a file system that is blind to case and Unicode form: NFC, lower-cased.

    Spark has no normal forms; keys that are ASCII, most of them, never leave the JVM.
    """
    @F.pandas_udf("string")
    def fold(keys: pd.Series) -> pd.Series:
        return keys.str.normalize("NFC").str.lower()

    return F.when(key.rlike(r"^\p{ASCII}*$"), F.lower(key)).otherwise(fold(F.when(~key.rlike(r"^\p{ASCII}*$"), key)))


def member_key(zip_key: Column, member: Column) -> Column:
    return F.concat_ws("!", zip_key, member)


def remote_target(text: Column) -> Column:
    """(alias, prefix) of "alias[:prefix]": the prefix without outer slashes and with one at its end, null if empty."""
    prefix = F.regexp_replace(F.substr(text, F.length(F.substring_index(text, ":", 1)) + 2, F.length(text)), "^/+|/+$", "")
    safe = F.when(F.array_contains(F.split(prefix, "/"), ".."), F.raise_error(F.concat(F.lit("prefix leaves its bucket: "), prefix))).otherwise(F.concat(prefix, F.lit("/")))
    return F.struct(F.substring_index(text, ":", 1).alias("alias"), F.when(F.contains(text, F.lit(":")) & (prefix != ""), safe).alias("prefix"))


def flat_log_name(key: Column) -> Column:
    return F.translate(key, "/\\:", "---")


def secret_variable(alias: Column) -> Column:
    return F.upper(F.regexp_replace(alias, "[^A-Za-z0-9]", "_"))


def message_key(identity: Column, mailbox: Column, uid: Column) -> Column:
    return F.concat(identity, F.lit("/"), mailbox, F.lit("/"), uid.cast("string"), F.lit(".eml"))


def attachment_key(identity: Column, mailbox: Column, uid: Column, name: Column) -> Column:
    return F.concat(identity, F.lit("/"), mailbox, F.lit("/"), uid.cast("string"), F.lit("/attachments/"), name)
