"""Attachments counted from the structures that servers give of messages, without their contents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r'\s*(?:(?P<mark>[()])|"(?P<quoted>(?:[^"\\]|\\.)*)"|\{(?P<size>[0-9]+)\}\r?\n|(?P<atom>[^\s()"{]+))', re.S)
#: Where a part's disposition stands by its kind, and how many fields the kind has at least.
PLACES = {"text": (9, 8), "message/rfc822": (11, 10), "": (8, 7)}


def tree(text: str) -> list:
    """The nested lists of a structure: strings, None for NIL; an error if it is not one whole list."""
    stack: list[list] = [[]]
    at, text = 0, text.rstrip()
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise ValueError(f"no structure at {at}")
        at = found.end()
        if found["mark"] == "(":
            stack.append([])
        elif found["mark"]:
            done = stack.pop()
            if not stack:
                raise ValueError("closes what was not opened")
            stack[-1].append(done)
        elif found["size"]:
            stack[-1].append(text[at : at + int(found["size"])])
            at += int(found["size"])
        elif found["quoted"] is not None:
            stack[-1].append(re.sub(r"\\(.)", r"\1", found["quoted"], flags=re.S))
        else:
            stack[-1].append(None if found["atom"].upper() == "NIL" else found["atom"])
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise ValueError("is not one list")
    return stack[0][0]


def attached(leaf: list) -> bool:
    """Is a part attached by its disposition, or does its type have a name?"""
    kind = str(leaf[0]).lower()
    subtype = leaf[1] if len(leaf) > 1 else None
    place, least = PLACES.get(kind) or PLACES.get(f"{kind}/{str(subtype).lower()}") or PLACES[""]
    if len(leaf) < least:
        raise ValueError("a part lacks fields")
    disposition = leaf[place] if len(leaf) > place else None
    names = leaf[2][0::2] if isinstance(leaf[2], list) else []
    return (isinstance(disposition, list) and str(disposition[0]).lower() == "attachment") or any(str(n).lower() == "name" for n in names)


def count_attachments(text: str) -> int:
    """Attached parts of a message; parts in parts count, a message that is a part counts as itself only."""
    total, work = 0, [tree(text)]
    while work:
        node = work.pop()
        if not node:
            raise ValueError("a part without fields")
        if isinstance(node[0], list):
            inner = next((k for k, x in enumerate(node) if not isinstance(x, list)), len(node))
            work += node[:inner]
        else:
            total += attached(node)
    return total


@F.pandas_udf(T.LongType())
def counted(structures: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return 0
        try:
            return count_attachments(text)
        except ValueError:
            return None

    return pd.Series([one(t) for t in structures], dtype="Int64")


def attachments(structure: Column) -> Column:
    """Attachments of a message, 0 where the server gave no structure, null where it cannot be parsed."""
    return counted(structure)


def by_mailbox(structures: DataFrame) -> DataFrame:
    """(mailbox, messages, attachments, unparsed) of (mailbox, structure): a message that cannot be parsed counts as
    one without attachments and takes no other message's count with it."""
    seen = structures.withColumn("a", attachments(F.col("structure")))
    return seen.groupBy("mailbox").agg(F.count("*").alias("messages"), F.coalesce(F.sum("a"), F.lit(0)).alias("attachments"), F.count_if(F.col("a").isNull()).alias("unparsed"))
