"""Glob patterns as Java regular expressions.

Three dialects are kept apart:

* path globs - ``*`` and ``?`` stop at ``/`` (ignore rules of pack v1);
* rule globs - ``*`` crosses ``/``, ``{a,b}`` alternates (coding standards);
* gitignore lines - see :func:`gitignore_regex` (pack v2 and the working set).

Each dialect comes twice: a plain function for patterns known while the plan is
built (the regex becomes a literal that Spark compiles once), and a column function
for tables of patterns, so that no pattern row passes through Python.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import as_column, let

# Characters that a Java or Python regex would not take literally.
_SPECIAL = r"([\\.\[\]{}()*+\-?^$|#&~ /!<>=:,\"'%@`;\t\n])"
_NEVER = "(?!)"

# One member of a class, and one member or range.
_MEMBER = r"(?:\\.|[^\\\]\-])"
_RANGE = rf"{_MEMBER}(?:-{_MEMBER})?"
_CLASS = rf"\[\^?+(?:{_RANGE})+\]"
_PATH_GLOB_TOKEN = rf"(?s)\\.|{_CLASS}|."
_PATH_GLOB_VALID = rf"(?s)\A(?:\\.|{_CLASS}|[^\\\[])*\z"

# Rule globs: a class is one range or a list, negated by "!".
_RULE_CLASS = r"\[!?+(?:[^\]]-[^\]]|(?:\\.|[^\\\]])+)\]"
_RULE_GLOB_TOKEN = rf"(?s)\\.|{_RULE_CLASS}|."
_GITIGNORE_TOKEN = r"(?s)/\*\*/|\*\*/|/\*\*|\\.|\[\^?+[^\]]+\]|."


# --- Patterns known while the plan is built ------------------------------------------

def quote(text: str) -> str:
    return re.sub(_SPECIAL, r"\\\1", text)


def _class_regex(members: str, negated: bool) -> str:
    ranges = []
    for found in re.findall(rf"(?s){_RANGE}", members):
        lo, hi = re.fullmatch(rf"(?s)({_MEMBER})(?:-({_MEMBER}))?", found).groups()
        lo, hi = lo[-1], (hi or lo)[-1]
        if lo <= hi:
            ranges.append(f"{quote(lo)}-{quote(hi)}")
    if not ranges:
        return r"(?s:.)" if negated else _NEVER
    return f"[{'^' if negated else ''}{''.join(ranges)}]"


def path_glob_regex(pattern: str) -> str | None:
    """Body of the regex for a path glob, or None for a malformed one (it never matches)."""
    if not re.fullmatch(_PATH_GLOB_VALID.replace(r"\A", "").replace(r"\z", ""), pattern):
        return None
    fixed = {"*": "[^/]*", "?": "[^/]"}
    out = []
    for token in re.findall(_PATH_GLOB_TOKEN, pattern):
        if token.startswith("[") and len(token) > 1:
            negated = token.startswith("[^")
            out.append(_class_regex(token[2 if negated else 1 : -1], negated))
        elif token.startswith("\\"):
            out.append(quote(token[1:]))
        else:
            out.append(fixed.get(token) or quote(token))
    return "".join(out)


def path_rule_regex(rule: str, compat: str = "reference") -> tuple[str, bool]:
    """(regex body over the whole path, keep flag) of one pack v1 ignore rule.

    A ``!`` rule looks at the full path. ``d/`` is anchored at the root, and a leading
    ``**/`` in it is literal; under ``intended`` it matches at any level. Any other
    rule may match the path or any of its tails.
    """
    keep = rule.startswith("!")
    pattern = rule[1:] if keep else rule
    if not keep and pattern.endswith("/"):
        name = pattern[:-1]
        if compat == "intended":
            return "(?:.*/)?" + quote(name.removeprefix("**/")) + "(?:/.*)?", False
        return quote(name) + "(?:/.*)?", False
    ways = [quote(pattern)]
    glob = path_glob_regex(pattern)
    if glob is not None:
        ways.append(glob)
    if pattern.endswith("/**"):
        ways.append(quote(pattern[:-3]) + "(?:/.*)?")
    elif pattern.startswith("**/*."):
        ways.append(".*" + quote(pattern[4:]))
    elif keep and "/" not in pattern:
        ways.append("(?:.*/)?" + quote(pattern))  # the tails of a drop rule cover this
    body = "(?:" + "|".join(ways) + ")"
    return (body if keep else "(?:.*/)?" + body), keep


def gitignore_regex(line: str) -> tuple[str, bool] | None:
    """(regex body, keep flag) of one gitignore line; None for blanks and comments.

    Directories are matched with a trailing ``/``. A line is tied to the root by a
    leading ``/``, or by a ``/`` that comes before a later ``*.``. ``?`` and the other
    special characters stand for themselves.
    """
    line = line.rstrip("\r")
    if line.startswith("#") or not line.strip(" "):
        return None
    line = line.strip(" ")
    keep = line.startswith("!")
    line = re.sub(r"\A\\(?=[#!])", "", line[1:] if keep else line)
    rooted = line.startswith("/") or re.search(r"[^/+]/.*\*\.", line) is not None
    line = line[1:] if line.startswith("/**/") else line
    rooted = rooted and not line.startswith("**/")
    fixed = {"/**/": "(?:/|/.+/)", "**/": "(?:.*/)?", "/**": "(?:/.*)?", "*": "[^/]*"}
    out = []
    for token in re.findall(_GITIGNORE_TOKEN, line.removeprefix("/") if rooted else line):
        if token in fixed:
            out.append(fixed[token])
        elif len(token) > 1 and token.startswith("["):
            negated = token.startswith("[^")
            out.append(_class_regex(token[2 if negated else 1 : -1], negated))
        elif len(token) > 1:
            out.append(quote(token[1:]))
        else:
            out.append(quote(token))
    tail = ".*" if line.endswith("/") else "(?:/.*)?"
    return ("" if rooted else "(?:.*/)?") + "".join(out) + tail, keep


def rule_glob_regex(pattern: str) -> str | None:
    """Anchored regex for a rule glob, or None for a malformed one (it is skipped)."""
    out, depth = [], 0
    for token in re.findall(_RULE_GLOB_TOKEN, pattern):
        if len(token) > 1 and token.startswith("["):
            negated = token.startswith("[!")
            members = token[2 if negated else 1 : -1]
            if re.fullmatch(r"(?s).-.", members):
                lo, hi = members[0], members[2]
                if lo > hi:
                    return None
                body = f"{quote(lo)}-{quote(hi)}"
            else:
                body = "".join(quote(c) for c in re.sub(r"(?s)\\(.)", r"\1", members))
            out.append(f"[{'^' if negated else ''}{body}]")
        elif len(token) > 1:
            out.append(quote(token[1:]))
        elif token in "[\\":
            return None
        elif token == "{":
            depth += 1
            out.append("(?:")
        elif token == "}" and depth:
            depth -= 1
            out.append(")")
        elif token == "," and depth:
            out.append("|")
        else:
            out.append({"*": ".*", "?": "."}.get(token) or quote(token))
    return None if depth else r"(?s)\A" + "".join(out) + r"\z"


_EDGE = "\0"  # never part of a path
_PLAIN = r"[^*?\[\\/]+"


def _literal_needles(start: str, literal: str, *ends: str) -> list[str] | None:
    return [start + literal + end for end in ends] if literal and _EDGE not in literal else None


def path_rule_needles(rule: str, compat: str = "reference") -> list[str] | None:
    """What a path must have one of (see :func:`marked`) to match a pack v1 rule, None if only a regex can tell."""
    keep = rule.startswith("!")
    pattern = rule[1:] if keep else rule
    below, plain = ("/", _EDGE), lambda text: re.fullmatch(_PLAIN, text)
    if not keep and pattern.endswith("/"):
        if compat == "intended":
            return _literal_needles("/", pattern[:-1].removeprefix("**/"), *below)
        return _literal_needles(_EDGE + "/", pattern[:-1], *below)
    if plain(pattern):
        return _literal_needles("/", pattern, _EDGE)
    if not keep and pattern.startswith("*") and plain(pattern[1:]):
        return _literal_needles("", pattern[1:], _EDGE)
    if pattern.endswith("/**") and plain(pattern[:-3]):
        return _literal_needles(_EDGE + "/" if keep else "/", pattern[:-3], *below)
    if pattern.startswith("**/*.") and plain(pattern[5:]):
        return _literal_needles("", pattern[4:], _EDGE)
    return None


def gitignore_needles(line: str) -> list[str] | None:
    """The same for a gitignore line."""
    pattern = line.rstrip("\r").strip(" ").removeprefix("!")
    name = pattern.removesuffix("/")
    if re.fullmatch(_PLAIN, name):
        return _literal_needles("/", name, "/") if name != pattern else _literal_needles("/", name, "/", _EDGE)
    if pattern.startswith("*") and re.fullmatch(_PLAIN, pattern[1:]):
        return _literal_needles("", pattern[1:], "/", _EDGE)
    return None


def rule_runs(rules: list[str], dialect: str, compat: str = "reference") -> list[tuple[list[str], str | None, bool]]:
    """(needles, regex, keep) for every run of neighbouring rules that decide the same way.

    Within a run the order does not matter, so a path matches it if it has one of the
    needles or the regex, which Spark compiles once (None if all rules have needles).
    """
    compiled = []
    for rule in rules:
        body = path_rule_regex(rule, compat) if dialect == "path" else gitignore_regex(rule)
        if body is not None:
            compiled.append((path_rule_needles(rule, compat) if dialect == "path" else gitignore_needles(rule), *body))
    runs = []
    for keep, group in itertools.groupby(compiled, key=lambda rule: rule[2]):
        group = list(group)
        needles = dict.fromkeys(n for found, _, _ in group for n in found or [])
        others = [body for found, body, _ in group if found is None]
        runs.append((list(needles), rf"(?s)\A(?:{'|'.join(others)})\z" if others else None, keep))
    return runs


# --- Tables of patterns ---------------------------------------------------------------

def _quote(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"\\$1")


def _class_column(members: Column, negated: Column) -> Column:
    def ends(found: Column) -> Column:
        chars = F.regexp_extract_all(found, F.lit(rf"(?s){_MEMBER}"), F.lit(0))
        return F.transform(
            F.array(F.get(chars, 0), F.element_at(chars, -1)), lambda c: F.substring(c, -1, 1)
        )

    def one(pair: Column) -> Column:
        lo, hi = F.get(pair, 0), F.get(pair, 1)
        return F.when(lo <= hi, F.concat(_quote(lo), F.lit("-"), _quote(hi))).otherwise("")

    found = F.regexp_extract_all(members, F.lit(f"(?s){_RANGE}"), F.lit(0))
    return let(
        F.array_join(F.transform(F.transform(found, ends), one), ""),
        lambda body: F.when((body == "") & negated, F.lit("(?s:.)"))
        .when(body == "", F.lit(_NEVER))
        .otherwise(
            F.concat(F.lit("["), F.when(negated, F.lit("^")).otherwise(""), body, F.lit("]"))
        ),
    )


def _between(text: Column, start, drop_end) -> Column:
    return F.substring(text, start, F.char_length(text) - (start - 1) - drop_end)


def _rest(text: Column, start: int) -> Column:
    return F.substring(text, start, 2**31 - 1)


def _class_token(token: Column, negation: str) -> Column:
    negated = token.startswith("[" + negation)
    start = F.when(negated, F.lit(3)).otherwise(F.lit(2))
    return _class_column(_between(token, start, F.lit(1)), negated)


def path_glob_regex_column(pattern) -> Column:
    """Column form of :func:`path_glob_regex`; null for a malformed pattern."""
    pattern = as_column(pattern)

    def one(token: Column) -> Column:
        return (
            F.when(token == "*", F.lit("[^/]*"))
            .when(token == "?", F.lit("[^/]"))
            .when(token.startswith("[") & (F.char_length(token) > 1), _class_token(token, "^"))
            .when(token.startswith("\\"), _quote(F.substring(token, 2, 1)))
            .otherwise(_quote(token))
        )

    tokens = F.regexp_extract_all(pattern, F.lit(_PATH_GLOB_TOKEN), F.lit(0))
    return F.when(
        pattern.rlike(_PATH_GLOB_VALID), F.array_join(F.transform(tokens, one), "")
    )


def marked(path) -> Column:
    """A path in which the needles of rules are looked for: with a mark at both ends.

    Most rules are about a literal at the start, at the end or between slashes. Of such a
    rule a path has one of its needles; finding one takes no regex, which Spark would
    have to compile for each row of a table of rules.
    """
    return F.concat(F.lit(_EDGE + "/"), as_column(path), F.lit(_EDGE))


def _needles(*found: tuple[Column, str, Column, tuple[str, ...]]) -> Column:
    """The needles of the first kind (condition, start, literal, ends) that a rule is of; null for none."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for condition, start, literal, ends in found:
        clean = condition & ~F.contains(literal, F.lit(_EDGE)) & (literal != "")
        out = out.when(clean, F.array(*[F.concat(F.lit(start), literal, F.lit(end)) for end in ends]))
    return out


def _path_needles(keep: Column, pattern: Column, folder: Column, compat: str) -> Column:
    below = ("/", _EDGE)
    every = F.regexp_replace(pattern, r"/\*\*\z", "")
    in_folder = pattern.endswith("/**") & every.rlike(rf"\A{_PLAIN}\z")
    extension = pattern.rlike(rf"\A\*\*/\*\.{_PLAIN}\z")
    return _needles(
        (~keep & pattern.endswith("/"), "/" if compat == "intended" else _EDGE + "/", folder, below),
        (pattern.rlike(rf"\A{_PLAIN}\z"), "/", pattern, (_EDGE,)),
        (~keep & pattern.rlike(rf"\A\*{_PLAIN}\z"), "", _rest(pattern, 2), (_EDGE,)),
        (keep & in_folder, _EDGE + "/", every, below),
        (~keep & in_folder, "/", every, below),
        (extension, "", _rest(pattern, 5), (_EDGE,)),
    )


def _gitignore_needles(pattern: Column) -> Column:
    name = F.regexp_replace(pattern, r"/\z", "")
    return _needles(
        (pattern.rlike(rf"\A{_PLAIN}/\z"), "/", name, ("/",)),
        (pattern.rlike(rf"\A{_PLAIN}\z"), "/", pattern, ("/", _EDGE)),
        (pattern.rlike(rf"\A\*{_PLAIN}\z"), "", _rest(pattern, 2), ("/", _EDGE)),
    )


def rule_runs_column(rules) -> Column:
    """Column form of :func:`rule_runs`: array<struct<keep, needles, regex>> from an array of rules.

    Neighbouring rules that decide the same way are one run, with all their needles and
    one regex of those rules that need theirs (null without any).
    """

    def one(run: Column) -> Column:
        plain = F.filter(run, lambda rule: rule["needles"].isNotNull())
        others = F.filter(run, lambda rule: rule["needles"].isNull())
        return F.struct(
            F.get(run, 0)["keep"].alias("keep"),
            F.array_distinct(F.flatten(F.transform(plain, lambda rule: rule["needles"]))).alias("needles"),
            F.when(F.size(others) > 0, F.array_join(F.transform(others, lambda rule: rule["regex"]), "|")).alias("regex"),
        )

    def split(rules: Column) -> Column:
        turns = F.filter(
            F.transform(rules, lambda rule, i: F.when((i == 0) | (F.get(rules, i - 1)["keep"] != rule["keep"]), i)),
            lambda i: i.isNotNull())
        return let(turns, lambda at: F.transform(at, lambda start, k: one(
            F.slice(rules, start + 1, F.coalesce(F.get(at, k + 1), F.size(rules)) - start))))

    return let(as_column(rules), split)


def run_matches(path: Column, mark: Column, run: Column) -> Column:
    """Whether a path (``mark`` is :func:`marked` of it) matches a run of :func:`rule_runs_column`."""
    literal = F.exists(run["needles"], lambda needle: F.contains(mark, needle))
    return literal | F.coalesce(F.rlike(path, run["regex"]), F.lit(False))


def path_rule_column(rule, compat: str = "reference") -> Column:
    """Column form of :func:`path_rule_regex`: struct<regex, keep, needles>, regex anchored.

    ``needles`` are null where the rule takes its regex, see :func:`marked`.
    """

    def whole(keep: Column, pattern: Column) -> Column:
        n = F.char_length(pattern)
        extra = (
            F.when(
                pattern.endswith("/**"),
                F.concat(
                    F.lit("|"), _quote(F.substring(pattern, F.lit(1), n - 3)), F.lit("(?:/.*)?")
                ),
            )
            .when(pattern.startswith("**/*."), F.concat(F.lit("|.*"), _quote(_rest(pattern, 5))))
            .when(
                keep & ~F.contains(pattern, F.lit("/")),
                F.concat(F.lit("|(?:.*/)?"), _quote(pattern)),
            )
            .otherwise("")
        )
        glob = F.coalesce(F.concat(F.lit("|"), path_glob_regex_column(pattern)), F.lit(""))
        folder = F.substring(pattern, F.lit(1), n - 1)
        if compat == "intended":
            folder = F.regexp_replace(folder, r"\A\*\*/", "")
        start = F.when(keep, F.lit("")).otherwise("(?:.*/)?")
        body = F.when(
            ~keep & pattern.endswith("/"),
            F.concat(
                F.lit("(?:.*/)?" if compat == "intended" else ""), _quote(folder), F.lit("(?:/.*)?")
            ),
        ).otherwise(F.concat(start, F.lit("(?:"), _quote(pattern), glob, extra, F.lit(")")))
        return F.struct(
            F.concat(F.lit(r"(?s)\A(?:"), body, F.lit(r")\z")).alias("regex"), keep.alias("keep"),
            _path_needles(keep, pattern, folder, compat).alias("needles"),
        )

    def split_off(text: Column) -> Column:
        keep = text.startswith("!")
        return F.struct(
            keep.alias("keep"), F.when(keep, _rest(text, 2)).otherwise(text).alias("pattern")
        )

    return let(split_off(as_column(rule)), lambda r: whole(r["keep"], r["pattern"]))


def gitignore_column(line) -> Column:
    """Column form of :func:`gitignore_regex`: struct<regex, keep, needles>, null for no rule."""

    def split_off(text: Column) -> Column:
        keep = text.startswith("!")
        pattern = F.when(keep, _rest(text, 2)).otherwise(text)
        return F.struct(
            keep.alias("keep"), F.regexp_replace(pattern, r"\A\\(?=[#!])", "").alias("pattern")
        )

    def one(token: Column) -> Column:
        return (
            F.when(token == "/**/", F.lit("(?:/|/.+/)"))
            .when(token == "**/", F.lit("(?:.*/)?"))
            .when(token == "/**", F.lit("(?:/.*)?"))
            .when(token == "*", F.lit("[^/]*"))
            .when(token.startswith("[") & (F.char_length(token) > 1), _class_token(token, "^"))
            .when(F.char_length(token) > 1, _quote(F.substring(token, 2, 1)))
            .otherwise(_quote(token))
        )

    def whole(keep: Column, pattern: Column) -> Column:
        rooted = (pattern.startswith("/") & ~pattern.startswith("/**/")) | (
            pattern.rlike(r"[^/+]/.*\*\.") & ~pattern.rlike(r"\A/?\*\*/")
        )
        body = F.regexp_replace(pattern, r"\A/", "")
        tokens = F.regexp_extract_all(body, F.lit(_GITIGNORE_TOKEN), F.lit(0))
        return F.struct(
            F.concat(
                F.lit(r"(?s)\A(?:"),
                F.when(rooted, F.lit("")).otherwise("(?:.*/)?"),
                F.array_join(F.transform(tokens, one), ""),
                F.when(pattern.endswith("/"), F.lit(".*")).otherwise("(?:/.*)?"),
                F.lit(r")\z"),
            ).alias("regex"),
            keep.alias("keep"),
            _gitignore_needles(pattern).alias("needles"),
        )

    return let(
        F.regexp_replace(as_column(line), r"\r+\z", ""),
        lambda text: F.when(
            ~text.startswith("#") & (F.trim(text) != ""),
            let(split_off(F.trim(text)), lambda r: whole(r["keep"], r["pattern"])),
        ),
    )


def rule_glob_regex_column(pattern) -> Column:
    """Column form of :func:`rule_glob_regex`; null for a malformed pattern."""
    tokens = F.regexp_extract_all(as_column(pattern), F.lit(_RULE_GLOB_TOKEN), F.lit(0))

    def class_regex(token: Column) -> Column:
        negated = token.startswith("[!")
        members = _between(token, F.when(negated, F.lit(3)).otherwise(F.lit(2)), F.lit(1))
        is_range = members.rlike(r"(?s)\A.-.\z")
        lo, hi = F.substring(members, 1, 1), F.substring(members, 3, 1)
        body = F.when(
            is_range, F.when(lo <= hi, F.concat(_quote(lo), F.lit("-"), _quote(hi)))
        ).otherwise(_quote(F.regexp_replace(members, r"(?s)\\(.)", "$1")))
        return F.concat(
            F.lit("["), F.when(negated, F.lit("^")).otherwise(""), body, F.lit("]")
        )

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"]
        single = F.char_length(token) == 1
        closing = (token == "}") & (depth > 0)
        text = (
            F.when(~single & token.startswith("["), class_regex(token))
            .when(~single, _quote(F.substring(token, 2, 1)))
            .when(token.isin("[", "\\"), F.lit(None))
            .when(token == "{", F.lit("(?:"))
            .when(closing, F.lit(")"))
            .when((token == ",") & (depth > 0), F.lit("|"))
            .when(token == "*", F.lit(".*"))
            .when(token == "?", F.lit("."))
            .otherwise(_quote(token))
        )
        return F.struct(
            F.concat(state["regex"], text).alias("regex"),
            (
                depth + F.when(token == "{", 1).when(closing, -1).otherwise(0)
            ).cast("int").alias("depth"),
        )

    start = F.struct(F.lit("").alias("regex"), F.lit(0).alias("depth"))
    return F.aggregate(
        tokens,
        start,
        step,
        lambda s: F.when(
            s["depth"] == 0, F.concat(F.lit(r"(?s)\A"), s["regex"], F.lit(r"\z"))
        ),
    )
