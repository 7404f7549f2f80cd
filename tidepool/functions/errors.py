"""Normalised error signatures, severities, prompt gating, path globs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def signature(text: Column) -> Column:
    """An error text without what differs from case to case: quoted parts, numbers, paths, spare blanks."""
    out = F.lower(text)
    for pattern, by in ((r"\"[^\"]*\"", "<str>"), (r"0x[0-9a-f]+", "<hex>"), (r"(/[\w.-]+)+", "<path>"), (r"\d+", "<n>"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def severity(occurrences: Column) -> Column:
    return F.when(occurrences >= 50, "critical").when(occurrences >= 20, "high").when(occurrences >= 5, "medium").otherwise("low")


def recall_intent(prompt: Column) -> Column:
    """The first rule that a prompt meets: what kind of recall it asks for, or 'none'."""
    p = F.lower(prompt)
    rules = [("failure", r"error|fail|crash|bug"), ("history", r"before|previous|last time|remember"), ("decision", r"why|decid|reason"), ("procedure", r"how (do|to|can)|steps")]
    out = None
    for name, pattern in rules:
        out = F.when(p.rlike(pattern), name) if out is None else out.when(p.rlike(pattern), name)
    return out.otherwise("none")


def backoff_seconds(retries: Column) -> Column:
    """1, 2, 4 ... seconds, 300 at most."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.greatest(retries - 1, F.lit(0))))


def glob_to_regex(glob: str) -> str:
    """A path glob as a regular expression: ** any path, * within a part, ? one character, {a,b} choices, commas between globs. Without a slash the base name is matched."""
    out = []
    for one in _split(glob):
        body, i = "", 0
        while i < len(one):
            c = one[i]
            if one[i : i + 3] == "**/":
                body, i = body + "(.*/)?", i + 3
                continue
            if one[i : i + 2] == "**":
                body, i = body + ".*", i + 2
                continue
            body += {"*": "[^/]*", "?": "[^/]", "{": "(", "}": ")", ",": "|"}.get(c, "\\" + c if c in ".+()|^$[]\\" else c)
            i += 1
        out.append(("" if "/" in one else "(.*/)?") + body)
    return "^(" + "|".join(out) + ")$"


def _split(glob: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for c in glob:
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [*parts, now.strip()]
