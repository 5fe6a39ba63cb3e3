"""Names, keys and small formats that rows carry, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix of a child chunk, and of a chunk of a file.
CHILD = "_c[0-9]+$"
PAGE = "^(.*)_[0-9]+$"


def _some(text: Column) -> Column:
    return F.when(text != "", text)


def parent_id(chunk_id: Column, parent: Column | None = None) -> Column:
    """The parent a chunk names or, without one, its id before _cN; null for a chunk that is no child."""
    told = _some(F.regexp_extract(F.coalesce(chunk_id, F.lit("")), f"(?s)^(.*){CHILD}", 1))
    return told if parent is None else F.coalesce(_some(parent), told)


def document_key(chunk_id: Column, content: Column, chars: int = 60) -> Column:
    """What chunks of one document share: the id without _cN or, without an id, the first characters of the content,
    white space left out."""
    return F.coalesce(_some(F.regexp_replace(chunk_id, CHILD, "")), F.substring(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", ""), 1, chars))


def file_of(chunk_id: Column) -> Column:
    """A chunk id without its number: that of the file. Ids that end otherwise stay."""
    return F.regexp_replace(chunk_id, f"(?s){PAGE}", "$1")


def triple_id(head: Column, relation: Column, tail: Column) -> Column:
    """First 12 hex digits of the md5 of head|relation|tail; null is empty."""
    whole = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (head, relation, tail)])
    return F.substring(F.md5(whole.cast("binary")), 1, 12)


def lenient_json(text: Column) -> Column:
    """The first JSON value of a model's reply, as JSON text: code fences and words around it are left out, and what
    follows it. The whole reply is tried first, then what begins at each bracket; null without any."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^```(?:json)?\s*", "")), r"\s*```$", "")
    value = lambda x: F.to_json(F.try_parse_json(x))
    tails = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(bare), F.lit(1))), lambda i: F.substr(bare, i, F.lit(1)).isin("[", "{")), lambda i: F.substr(bare, i))
    first = F.aggregate(tails, F.lit(None).cast("string"), lambda a, x: F.when(a.isNotNull(), a).otherwise(value(x)))
    return F.coalesce(value(bare), first)


def ctime(text: Column) -> Column:
    """The time that C's ctime writes ('Thu Sep 18 23:53:00 2026', days of one digit padded by a space); null otherwise."""
    tidy = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.when(F.rlike(tidy, F.lit("^[A-Z][a-z]{2} [A-Z][a-z]{2} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4}$")), F.try_to_timestamp(F.substr(tidy, F.lit(5)), F.lit("MMM d HH:mm:ss yyyy"))).cast("timestamp_ntz")


def next_id(ids: Column, prefix: str, digits: int = 3) -> Column:
    """An aggregate: the prefix and the number after the largest of ids that are the prefix and digits, padded."""
    number = _some(F.regexp_extract(ids, f"^{prefix}([0-9]+)$", 1)).try_cast("bigint")
    n = (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(n) < digits, F.lpad(n, digits, "0")).otherwise(n))
