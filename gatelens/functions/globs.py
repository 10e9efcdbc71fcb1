"""Glob patterns as regular expressions, so that matching stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_action(action: Column) -> Column:
    return F.lower(F.trim(action))


def glob_regex(pattern: Column) -> Column:
    """A whole-string regex: ``*`` any run, ``?`` one character, ``[..]`` and ``[!..]`` sets; ``[`` alone is itself."""
    p = F.regexp_replace(pattern, r"([\\.^$+(){}|])", r"\\$1")
    p = F.regexp_replace(p, r"(?s)\[(?!!?.[^\]]*\])", r"\\[")
    p = F.regexp_replace(F.regexp_replace(p, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(p, r"\[!", "[^"), F.lit(r"\z"))


def matches_glob(value: Column, pattern: Column) -> Column:
    return (pattern == "*") | F.rlike(value, glob_regex(pattern))


def action_matches(action: Column, pattern: Column) -> Column:
    """Both trimmed and lower-cased."""
    return matches_glob(normal_action(action), normal_action(pattern))


def resource_matches(resource: Column, pattern: Column) -> Column:
    """Both trimmed; case counts."""
    return matches_glob(F.trim(resource), F.trim(pattern))


def any_action(action: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: action_matches(action, p))


def any_resource(resource: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: resource_matches(resource, p))
