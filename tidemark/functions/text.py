"""Commit messages and other free text as columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PR_IN_PARENS = r"\(#(\d+)\)"
PR_SUFFIX = r"\(#(\d+)\)\s*$"
PR_SUFFIXES = r"(?:\s*\(#\d+\))+\s*$"
PR_REFERENCE = r"(?i)\bPR\s*#?\s*(\d+)|#(\d+)"
QUOTED_REVERT = r'(?i)^\s*revert\s*:?\s*"(.*)"(?:\s*\(#\d+\))*\s*$'
BARE_REVERT = r"(?i)^\s*revert\b\s*:?\s*(.*)$"
REVERTS_SHA = r"This reverts commit ([0-9a-f]{7,40})"
REVERTS_PR = r"(?i)\breverts?\s+(?:[\w.-]+/[\w.-]+)?#(\d+)"
BRACKET_TAGS = r"^\s*((?:\[[^\]\n]+\]\s*)+)"
COLON_TAG = r"^([A-Za-z0-9_./-]{1,40}):\s"
TRAILER = (
    r"(?i)^\s*(signed-off-by|co-authored-by|reviewed-by|acked-by|tested-by|reported-by|suggested-by|helped-by|cc)\s*:"
)
HTML_COMMENT = r"(?s)<!--.*?-->"
EMPTY_FENCE = r"(?m)^```[^\n]*\n```[ \t]*$\n?"
HEADING = r"^\s*(?:#{1,6}\s*|\*\*\s*-?\s*)([^#*\n]+?)\s*(?:\*\*)?\s*:?\s*$"
PULLED_LINE = r"^\s*\*?\s*(?=[0-9a-f]*\d)[0-9a-f]{7,40}\s+(?:-\s+)?\S"
PULLED_TAIL = r"\s+\([^()\n]*\bago\)\s+\[[^\]\n]*\]\s*$"
PATH_WORD = "[A-Za-z][A-Za-z0-9]+"
REVERT_TAG = r"^(?:\[.*?\]\s*)+"
# Section titles and the placeholders of redaction.
SECTION_TITLES = {
    "why i did it": "why",
    "what i did": "why",
    "what i did it": "why",
    "how i did it": "how",
    "how to verify it": "verify",
    "how to verify": "verify",
}
SECTIONS = ("why", "how", "verify")
EMAIL_PLACEHOLDER = "<email>"
NAME_PLACEHOLDER = "<name>"
SECTION_MAX_CHARS = 6_000
SINGLE_NAME_MIN_CHARS = 5
MULTI_NAME_MIN_CHARS = 5
# What a mention scan ignores in a body.
MENTION_TRAILER = r"(?m)^[A-Za-z][A-Za-z-]*-by:.*$"
MENTION_EMAIL = r"\S+@\S+"
MENTION_URL = r"https?://\S+"

LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def number(text: Column) -> Column:
    return F.when(text != "", text).try_cast("bigint")


def collapse(text: Column) -> Column:
    """All white space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Array of lines; a final line break does not open another line."""
    def trimmed(parts: Column) -> Column:
        last = F.when(F.try_element_at(parts, F.lit(-1)) == "", 1).otherwise(0)
        return F.slice(parts, F.lit(1), F.size(parts) - last)

    return let(F.split(text, LINE_BREAK), trimmed)


def split_message(message: Column) -> tuple[Column, Column]:
    """(subject, body): the first paragraph on one line, and what follows it."""
    text = F.regexp_replace(F.replace(message, F.lit("\r\n"), F.lit("\n")), "^\n+", "")
    head = F.regexp_extract(text, r"(?s)\A(.*?)(?:\n\n|\z)", 1)
    return collapse(head), F.regexp_extract(text, r"(?s)\A.*?\n\n(.*)\z", 1)


def pr_suffix(text: Column) -> Column:
    return number(F.regexp_extract(text, PR_SUFFIX, 1))


def pr_reference(text: Column) -> Column:
    return F.coalesce(number(F.regexp_extract(text, PR_REFERENCE, 1)), number(F.regexp_extract(text, PR_REFERENCE, 2)))


def last_pr(text: Column) -> Column:
    return number(F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(PR_IN_PARENS), 1), F.lit(-1)), F.lit("")))


def is_revert(subject: Column) -> Column:
    """Starts with Revert, after any leading [tag]s."""
    plain = F.trim(subject)
    return plain.startswith("Revert") | F.regexp_replace(plain, REVERT_TAG, "").startswith("Revert")


def is_headline_revert(subject: Column) -> Column:
    return F.trim(subject).startswith("Revert")


def unwrap_reverts(subject: Column) -> Column:
    """Struct of depth, innermost subject, subject one level in, and whether the revert is unquoted.

    Each quoted level takes at least eight characters, so the length of the subject bounds the levels.
    """
    start = F.struct(F.lit(0).alias("depth"), F.trim(subject).alias("innermost"), F.trim(subject).alias("first_inner"))

    def peel(state: Column, _level: Column) -> Column:
        inner = F.trim(F.regexp_extract(state["innermost"], QUOTED_REVERT, 1))
        return F.when(
            state["innermost"].rlike(QUOTED_REVERT),
            F.struct(
                (state["depth"] + 1).alias("depth"), inner.alias("innermost"),
                F.when(state["depth"] == 0, inner).otherwise(state["first_inner"]).alias("first_inner"),
            ),
        ).otherwise(state)

    levels = F.sequence(F.lit(1), F.floor(F.length(subject) / 8).cast("int") + 1)
    quoted = F.aggregate(levels, start, peel)
    bare = F.trim(F.regexp_replace(F.regexp_extract(F.trim(subject), BARE_REVERT, 1), PR_SUFFIXES, ""))
    unquoted = (quoted["depth"] == 0) & F.trim(subject).rlike(BARE_REVERT)
    return F.when(
        unquoted,
        F.struct(F.lit(1).alias("depth"), bare.alias("innermost"), bare.alias("first_inner"), F.lit(True).alias("bare")),
    ).otherwise(F.struct(
        quoted["depth"].alias("depth"), quoted["innermost"].alias("innermost"),
        quoted["first_inner"].alias("first_inner"), F.lit(False).alias("bare"),
    ))


def subject_tags(subject: Column) -> Column:
    """Leading [tag]s, else ``word:``, in lower case, once each, in order."""
    bracket = F.regexp_extract(subject, BRACKET_TAGS, 1)
    colon = F.regexp_extract(subject, COLON_TAG, 1)
    found = F.when(bracket != "", F.regexp_extract_all(bracket, F.lit(r"\[([^\]\n]+)\]"), 1)).otherwise(F.array(colon))
    tags = F.transform(found, lambda tag: F.lower(collapse(tag)))
    return F.array_distinct(F.filter(tags, lambda tag: tag != ""))


def without_comments(body: Column) -> Column:
    return F.regexp_replace(body, HTML_COMMENT, "")


def strip_trailers(body_lines: Column) -> Column:
    return F.filter(body_lines, lambda line: ~line.rlike(TRAILER))


def trailer_counts(body_lines: Column) -> Column:
    """Struct of signed_off_by, co_authored_by and other."""
    names = F.transform(
        F.filter(body_lines, lambda line: line.rlike(TRAILER)), lambda line: F.lower(F.regexp_extract(line, TRAILER, 1))
    )
    signed = F.size(F.filter(names, lambda name: name == "signed-off-by"))
    shared = F.size(F.filter(names, lambda name: name == "co-authored-by"))
    return F.struct(
        signed.alias("signed_off_by"), shared.alias("co_authored_by"), (F.size(names) - signed - shared).alias("other")
    )


def pulled_lines(kept_lines: Column) -> Column:
    """How many lines look like commits pulled in by a moved pointer."""
    cut = F.transform(kept_lines, lambda line: F.regexp_replace(line, PULLED_TAIL, ""))
    return F.size(F.filter(cut, lambda line: line.rlike(PULLED_LINE)))


def normalize_body(text: Column) -> Column:
    trimmed = F.array_join(F.transform(lines(text), lambda line: F.regexp_replace(line, r"\s+$", "")), "\n")
    bare = F.regexp_replace(F.regexp_replace(trimmed, EMPTY_FENCE, ""), "\n{3,}", "\n\n")
    return F.regexp_replace(bare, "^\n+|\n+$", "")


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, EMAIL_PLACEHOLDER)


def clean_body(message: Column) -> Column:
    """The stored body: no comments, trailers, pull tails or addresses, blank runs folded."""
    _subject, body = split_message(message)
    kept = strip_trailers(lines(without_comments(body)))
    cut = F.transform(kept, lambda line: F.regexp_replace(line, PULLED_TAIL, ""))
    return normalize_body(redact_emails(F.array_join(cut, "\n")))


def reverted_refs(body: Column, unwrapped: Column) -> tuple[Column, Column]:
    """(sha, PR number) a revert says it undoes; null unless it is one."""
    sha = F.regexp_extract(body, REVERTS_SHA, 1)
    own = F.when(unwrapped["bare"], pr_reference(unwrapped["first_inner"])).otherwise(pr_suffix(unwrapped["first_inner"]))
    named = number(F.regexp_extract(body, REVERTS_PR, 1))
    reverts = unwrapped["depth"] > 0
    return F.when(reverts & (sha != ""), sha), F.when(reverts, F.coalesce(own, named))


def sections(body: Column, limit: int | None = None) -> Column:
    """Struct of the texts under the why, how and verify headings; null where there is none.

    With a ``limit`` each text is cut to so many characters; the fields ``.._chars`` count all of them. Headings cut the lines into segments; a segment belongs to the title of its heading.
    """
    table = F.create_map(*[F.lit(item) for pair in SECTION_TITLES.items() for item in pair])

    def heading(line: Column) -> Column:
        return line.rlike(HEADING) & line.rlike(r"^\s*(#|\*\*)")

    def numbered(line: Column, at: Column) -> Column:
        return F.when(heading(line), at + 1)

    def cut(all_lines: Column, spots: Column) -> Column:
        def segment(at: Column, order: Column) -> Column:
            title = F.lower(collapse(F.regexp_extract(F.element_at(all_lines, at), HEADING, 1)))
            stop = F.coalesce(F.get(spots, order + 1), F.size(all_lines) + 1)
            return F.struct(
                F.try_element_at(table, F.regexp_replace(title, r"\?+$", "")).alias("name"),
                F.slice(all_lines, at + 1, stop - at - 1).alias("lines"),
            )

        return F.filter(F.transform(spots, segment), lambda part: part["name"].isNotNull())

    def text(segments: Column, name: str) -> Column:
        own = F.filter(segments, lambda part: part["name"] == name)
        joined = F.array_join(F.flatten(F.transform(own, lambda part: part["lines"])), "\n")
        return F.nullif(F.regexp_replace(joined, r"^\s+|\s+$", ""), F.lit(""))

    def cut_to(whole: Column) -> Column:
        return whole if limit is None else F.left(whole, F.lit(limit))

    segments = let(
        lines(body), lambda rows: let(F.array_compact(F.transform(rows, numbered)), lambda spots: cut(rows, spots))
    )
    return let(segments, lambda parts: F.struct(
        *[cut_to(text(parts, name)).alias(name) for name in SECTIONS], *[F.length(text(parts, name)).alias(f"{name}_chars") for name in SECTIONS]))


def name_redactor(names: Iterable[str], stoplist: Iterable[str] = (), single_min: int = SINGLE_NAME_MIN_CHARS):
    """A vectorised function that replaces known names by a placeholder.

    Names of several words match in any case with only spaces, tabs, dots or brackets between the
    words; single names match exactly and must be long enough. At each word the longest name
    wins, matches do not overlap, and a possessive 's stays. The list of names is shipped with the
    function, so it should be a bounded roster; larger ones are split into rounds by the caller.
    """
    import regex

    word = regex.compile(r"\w+(?:[-'.]\w+)*")
    stop = {item.lower() for item in stoplist}
    singles, many = set(), []
    for name in (" ".join(item.split()) for item in names):
        words = word.findall(name)
        if not words or "@" in name or name.lower() in stop:
            continue
        if len(words) > 1 and sum(map(len, words)) >= MULTI_NAME_MIN_CHARS:
            many.append(tuple(item.lower() for item in words))
        elif len(words) == 1 and len(words[0]) >= single_min and words[0].lower() not in stop:
            singles.add(words[0])
    gap = r"[ \t.()\[\]]+"
    choices = [
        "(?i:" + gap.join(regex.escape(item) for item in words) + ")"
        for words in sorted(set(many), key=lambda words: (-len(words), words))
    ] + [regex.escape(item) for item in sorted(singles)]
    # A name is a whole word: nothing that continues a word may touch it, save a possessive.
    edge = r"(?<!\w)(?<!\w[-'.])"
    tail = r"(?:(?=(?i:'s)(?!\w|[-'.]\w))|(?!\w|[-'.]\w))"
    pattern = regex.compile(f"{edge}(?:{'|'.join(choices)}){tail}") if choices else None

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        if pattern is None:
            return texts
        return texts.map(lambda text: text if text is None else _replace_names(pattern, text))

    return redact


def _replace_names(pattern, text: str) -> str:
    out, last = [], 0
    for match in pattern.finditer(text):
        if match.start() < last:
            continue
        out += [text[last:match.start()], NAME_PLACEHOLDER]
        last, inside = match.end(), match.group()
        opened = sum(inside.count(char) for char in "([") - sum(inside.count(char) for char in ")]")
        while opened > 0 and last < len(text) and text[last] in ")]":
            last, opened = last + 1, opened - 1
    return "".join(out) + text[last:]


def pseudonym(email: Column, salt: str) -> Column:
    """The first 16 hex digits of a salted SHA-256 of the normalised address."""
    return F.left(F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), F.lower(F.trim(email))), 256), F.lit(16))


def is_bot(name: Column, email: Column, bots: Sequence[str]) -> Column:
    local = F.substring_index(F.lower(email), "@", 1)
    found = F.lit(False)
    for bot in bots:
        found = found | F.lower(name).contains(bot) | local.contains(bot)
    return found


def mention_text(body: Column) -> Column:
    """A body without the trailers, addresses and links that name things by accident."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), MENTION_TRAILER, "")
    return F.regexp_replace(F.regexp_replace(text, MENTION_EMAIL, ""), MENTION_URL, "")


def safe_url(url: Column) -> Column:
    """No credentials, query or fragment; ``host:path`` of the scp form; null for files and local paths."""
    web = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#]*)([^?#]*)"
    scp = r"^(?:[\w.-]+@)?([\w.-]+):([^/].*)$"
    scheme = F.lower(F.regexp_extract(url, web, 1))
    return (
        F.when(url.contains("://"), F.when(scheme != "file", F.concat(
            scheme, F.lit("://"), F.regexp_extract(url, web, 2), F.regexp_extract(url, web, 3))))
        .when(url.rlike(scp), F.concat(F.regexp_extract(url, scp, 1), F.lit(":"), F.regexp_extract(url, scp, 2)))
    )


def path_words(path: Column) -> Column:
    return F.array_join(F.regexp_extract_all(path, F.lit(PATH_WORD), 0), " ")


def utc_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_epoch(text: Column) -> Column:
    return F.unix_seconds(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssX"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("bigint") + 1


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.regexp_replace(F.left(text, F.lit(limit - 3)), r"\s+$", ""), F.lit("..."))
    )
