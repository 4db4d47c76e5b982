"""Column expressions over lines, messages and ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and limits that define the results.
RULE_CHARS = r"^[/*\-=#~_ ]+$"
WORD_CHARS = r"[^\s/*\-=#~_]"
MERGE_MESSAGE = r"^Merge (pull request|branch|remote-tracking)"
PR_URL = r"(?i)github\.com/([^/\s]+)/([^/\s#]+)/pull/(\d+)"
PR_SHORT = r"^\s*([^/\s]+)/([^/\s#]+)#(\d+)\s*$"
IMPORT_SUFFIX = r"""(\bfrom\s*|\bimport\s*\(\s*)(["'])(\.[^"']*?)\.tsx?\2"""
SOURCE_LINE_CHARS = 160
CONTEXT_LINE_CHARS = 200
MINUS = "−"

_EDGE_SPACE = r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$"
_END_SPACE = r"[\s\p{Z}﻿]+$"


def trim_all(c: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def insignificant(text: Column) -> Column:
    """A blank line or a rule of slashes, dashes and the like."""
    t = trim_all(text)
    return (t == "") | t.rlike(RULE_CHARS)


def wordless(comment: Column) -> Column:
    """A comment with no word in it: a banner, not documentation."""
    return ~comment.rlike(WORD_CHARS)


def is_merge_message(message: Column) -> Column:
    return message.rlike(MERGE_MESSAGE)


def line_key(kind: Column, old: Column, new: Column) -> Column:
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(kind, F.lit("|"), s(old), F.lit("|"), s(new))


def delta_label(add: Column, dele: Column) -> Column:
    return F.concat(F.lit("+"), add.cast("string"), F.lit(f" {MINUS}"), dele.cast("string"))


def pr_ref(text: Column) -> Column:
    """Struct (owner, repo, number) of a change-request reference; fields null if none."""
    full = text.rlike(PR_URL)
    short = text.rlike(PR_SHORT)
    pick = lambda i: F.when(full, F.regexp_extract(text, PR_URL, i)).when(short, F.regexp_extract(text, PR_SHORT, i))
    return F.struct(pick(1).alias("owner"), F.regexp_replace(pick(2), r"\.git$", "").alias("repo"),
                    pick(3).alias("number"))


def normalize_for_hash(text: Column) -> Column:
    """Drop .ts/.tsx from relative import specifiers, so generated mirrors compare equal."""
    return F.regexp_replace(text, IMPORT_SUFFIX, "$1$2$3$2")


def content_hash(text: Column) -> Column:
    return F.sha1(normalize_for_hash(text).cast("binary"))


def node_file(entry_id: Column) -> Column:
    """File part of an id ``file#name#kind#i``; empty when the id has another form."""
    return F.regexp_extract(entry_id, r"^(?s)(.*)#[^#]*#[^#]*#[^#]*$", 1)


def source_line(text: Column) -> Column:
    return F.left(trim_all(F.coalesce(text, F.lit(""))), F.lit(SOURCE_LINE_CHARS))


def context_line(text: Column) -> Column:
    return F.left(F.regexp_replace(text, _END_SPACE, ""), F.lit(CONTEXT_LINE_CHARS))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def anchor_line(anchor: Column) -> Column:
    """Line number at the end of ``path:line``, null if the anchor has none."""
    digits = F.regexp_extract(anchor, r":(\d+)\s*$", 1)
    return F.when(digits != "", digits.cast("long"))


def anchor_path(anchor: Column) -> Column:
    return F.regexp_replace(anchor, r":\d+\s*$", "")
