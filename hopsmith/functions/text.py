"""Text functions on columns. All but the few marked as UDFs are JVM expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# ASCII punctuation, articles, white space with Unicode classes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?U)\b(a|an|the)\b"
SPACE = r"(?U)\s+"
SEPARATOR = "\n #||# "


def stripped(c: Column) -> Column:
    """Without white space at both ends (Unicode classes, as ``str.strip``)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def collapsed(c: Column) -> Column:
    return F.array_join(words(c), " ")


def without_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def normalize_answer(c: Column) -> Column:
    """Lower case, no punctuation, then no articles, single spaces."""
    return collapsed(F.regexp_replace(without_punctuation(F.lower(c)), ARTICLES, " "))


def normalize_articles_first(c: Column) -> Column:
    """As ``normalize_answer`` with articles gone before punctuation: ``a-b`` is ``b``."""
    return collapsed(without_punctuation(F.regexp_replace(F.lower(c), ARTICLES, " ")))


def normalize_plain(c: Column) -> Column:
    """Case and outer white space only."""
    return F.lower(stripped(c))


def _after_last(c: Column, label: str) -> Column:
    """What follows the last ``label`` (any case), or null."""
    found = F.regexp_extract(c, f"(?is)^.*{re.escape(label)}(.*)$", 1)
    return F.when(F.contains(F.lower(c), F.lit(label)), found)


def strip_answer_label(c: Column) -> Column:
    """After the last ``final answer:``, else the last ``answer:``, else everything."""
    return stripped(F.coalesce(_after_last(c, "final answer:"), _after_last(c, "answer:"), c))


def without_final_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def strip_leading_label(c: Column) -> Column:
    """Only a ``final answer:`` at the start, then dots at the end."""
    return without_final_dots(stripped(F.regexp_replace(stripped(c), "(?i)^final answer:", "")))


def final_answer(c: Column) -> Column:
    """After the last ``final answer:``; dots at the end go."""
    return without_final_dots(stripped(F.coalesce(_after_last(c, "final answer:"), c)))


def after_final_answer_marker(c: Column) -> Column:
    """Case-sensitive: what follows the last ``Final answer:``."""
    return stripped(F.substring_index(c, "Final answer:", -1))


def after_thinking_final_answer(c: Column) -> Column:
    """After the last ``</think>``, then after the last ``final answer:`` of any case."""
    told = F.substring_index(c, "</think>", -1)
    return stripped(F.coalesce(_after_last(told, "final answer:"), told))


def strip_thinking(c: Column) -> Column:
    """No ``<think>`` blocks, nor an unclosed one at the end."""
    return stripped(F.regexp_replace(F.regexp_replace(c, "(?s)<think>.*?</think>", ""), "(?s)<think>.*$", ""))


def discard_reasoning(c: Column) -> Column:
    """After the last ``</think>``; ``[incomplete reasoning]`` if one is left open."""
    left_open = F.contains(c, F.lit("<think>")) & ~F.contains(c, F.lit("</think>"))
    return F.when(left_open, "[incomplete reasoning]").otherwise(stripped(F.substring_index(c, "</think>", -1)))


def yes_no(c: Column) -> Column:
    """1, 0 or null: by the first word's letters, else by a ``YES`` or ``NO`` anywhere."""
    text = F.upper(stripped(c))
    first = F.regexp_replace(F.substring_index(F.regexp_replace(text, SPACE, " "), " ", 1), "[^A-Z]", "")
    anywhere = F.when(F.contains(text, F.lit("YES")), 1).when(F.contains(text, F.lit("NO")), 0)
    return F.when(first == "YES", 1).when(first == "NO", 0).otherwise(anywhere).cast("int")


def numbered_items(c: Column) -> Column:
    """Items of a numbered list, one a line."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^\s*\d+[.)]\s*(.+?)\s*$"), 1)


def fitted(items: Column, n: int, filler: Column | str = "") -> Column:
    """Exactly ``n`` items: cut, or filled up."""
    filler = F.lit(filler) if isinstance(filler, str) else filler
    return F.slice(F.concat(items, F.array_repeat(filler, n)), 1, n) if n else F.array().cast("array<string>")


def last_search(c: Column) -> Column:
    """The last ``<search>`` query, null if there is none."""
    return stripped(F.try_element_at(F.regexp_extract_all(c, F.lit("(?s)<search>(.*?)</search>"), 1), F.lit(-1)))


def tagged_answer(c: Column) -> Column:
    """The first ``<answer>``, else the last line that isn't blank, else the empty text."""
    tagged = F.try_element_at(F.regexp_extract_all(c, F.lit("(?s)<answer>(.*?)</answer>"), 1), F.lit(1))
    lines = F.filter(F.transform(F.split(c, "\n"), stripped), lambda x: x != "")
    return F.coalesce(stripped(tagged), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def section(c: Column, start: str | None, end: str) -> Column:
    """The last text from one token (None: the very start) to another or to the end, or null."""
    begin = r"\A" if start is None else re.escape(start)
    return stripped(F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?s){begin}(.*?)(?:{re.escape(end)}|\z)"), 1), F.lit(-1)))


def gsm_answer(c: Column) -> Column:
    """The number after the first ``####``, commas removed; else the empty text."""
    return F.replace(F.regexp_extract(c, "#### (-?[0-9.,]+)", 1), F.lit(","), F.lit(""))


def two_step_answer(c: Column, needs_both: bool = False) -> Column:
    """After ``</think>`` and ``Final Answer:``, without dots and commas. With ``needs_both``
    these are only removed where both markers stand."""
    both = F.contains(c, F.lit("</think>")) & F.contains(c, F.lit("Final Answer:"))
    answer = stripped(F.substring_index(F.substring_index(c, "</think>", -1), "Final Answer:", -1))
    clean = F.translate(answer, ".,", "")
    return F.when(both, clean).otherwise(answer) if needs_both else clean


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def state_text(question: Column, chunks: Column, selected: Column, separator: str = " [SEP] ", by_index: bool = True) -> Column:
    """Question and selected chunks in one text."""
    order = F.array_sort(selected) if by_index else selected
    return F.array_join(F.concat(F.array(question), F.transform(order, lambda i: F.get(chunks, i))), separator)


def letters(items: Column) -> Column:
    """``\\nA) …`` per item, in one text."""
    return F.array_join(F.transform(items, lambda e, i: F.concat(F.lit("\n"), F.char(i + 65), F.lit(") "), e)), "")


def clean_examples(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<example>"), F.lit("Example:")), F.lit("</example>"), F.lit(""))


def base_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "/+$", ""), "/v1$", "")


def pack_chunks(c: Column, size: int) -> Column:
    """Sentences packed greedily into chunks of at most ``size`` characters.

    A sentence longer than that stays whole; if it is the first, an empty chunk
    stands before it. One pass; the accumulator's array is copied at each sentence, so
    very long texts should take ``pack_chunks_udf``.
    """
    pieces = F.filter(F.split(c, r"(?<=[.!?])\s+|(?<=\n\n)"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(True).alias("fresh"))

    def step(acc, s):
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        fits = F.length(joined) <= size
        return F.struct(F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))).alias("out"), F.when(fits, joined).otherwise(s).alias("cur"), F.lit(False).alias("fresh"))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))


@pandas_udf(ArrayType(StringType()))
def pack_chunks_udf(texts: pd.Series, size: pd.Series) -> pd.Series:
    """``pack_chunks`` in linear time."""

    def packed(text, limit):
        if text is None:
            return None
        out, current = [], ""
        for piece in filter(None, re.split(r"(?<=[.!?])\s+|(?<=\n\n)", text)):
            joined = f"{current} {piece}" if current else piece
            if len(joined) <= limit:
                current = joined
            else:
                out.append(current)
                current = piece
        return [*out, current] if current else out

    return pd.Series([packed(t, n) for t, n in zip(texts, size)])


# --- sentences -------------------------------------------------------------

#: One character each for a dot that ends nothing and for a sentence end.
KEPT, END = "\ue000", "\ue001"

# What keeps or ends a sentence, in the order in which it applies.
URL = r"(https?://|www\.)[^\s]+"
TITLES = "Mr|St|Mrs|Ms|Dr"
DOMAINS = "com|net|org|io|gov|edu|me|uk|ca|au|de|fr|jp|cn|info|biz|app|dev|ai|tech"
COMPANY = "Inc|Ltd|Jr|Sr|Co"
OPENERS = r"Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever"

#: (pattern, what is done to the dots of the match: "keep" them, or "end" the sentence at
#: the place of the group ``cut``).
_RULES = [(re.compile(p), what) for p, what in (
    (rf"(?:{TITLES})[.]", "keep"),
    (rf"[.](?:{DOMAINS})", "keep"),
    (r"\d+\.\d+(?:\.\d+)?(?:\.\d+)?", "keep"),
    (r"\.{2,}", "run"),
    (r"Ph\.D\.", "keep"),
    (r"\s[A-Za-z][.] ", "keep spaced"),
    (rf"[A-Z][.][A-Z][.](?:[A-Z][.])?(?P<cut>) (?:{OPENERS})", "end"),
    (r"[A-Za-z][.][A-Za-z][.][A-Za-z][.]", "keep"),
    (r"[A-Za-z][.][A-Za-z][.]", "keep"),
    (rf" (?:{COMPANY})(?P<cut>[.]) (?:{OPENERS})", "end"),
    (rf" (?:{COMPANY})[.]", "keep"),
    (r" [A-Za-z][.]", "keep"),
)]


def _apply(rule: re.Pattern, what: str, text: str) -> str:
    def mark(m: re.Match) -> str:
        found = m.group()
        if what == "run":
            return KEPT * (len(found) - 1) + END
        if what == "end":
            a, b = (x - m.start() for x in m.span("cut"))
            return found[:a] + END + found[b:]
        kept = found.replace(".", KEPT)
        return " " + kept[1:] if what == "keep spaced" else kept

    return rule.sub(mark, text)


def split_sentences(text: str) -> list[str]:
    """Sentences of a text; URLs, abbreviations, acronyms and numbers keep their dots."""
    urls: list[str] = []

    def hide(m: re.Match) -> str:
        urls.append(m.group())
        return f"\ue002{len(urls) - 1}\ue003"

    text = " " + re.sub(URL, hide, text) + "  "
    text = text.replace("\n", END)
    for rule, what in _RULES:
        text = _apply(rule, what, text)
    # a closing quote belongs before the mark that ends its sentence
    for mark, quote in ((".", "\u201d"), (".", '"'), ("!", '"'), ("?", '"')):
        text = text.replace(mark + quote, quote + mark)
    text = re.sub("[.?!]", lambda m: m.group() + END, text).replace(KEPT, ".")
    text = re.sub("\ue002(\\d+)\ue003", lambda m: urls[int(m.group(1))], text)
    parts = [p.strip() for p in text.split(END)]
    return parts if parts[-1] else parts[:-1]


@pandas_udf(ArrayType(StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else split_sentences(t))


# --- LaTeX answers ---------------------------------------------------------


def _balanced(text: str, at: int) -> int:
    """Place after the brace group that opens at ``at``, or -1."""
    depth = 0
    for i in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return i + 1
    return -1


def boxed(text: str) -> str:
    """Content of the last ``\\boxed``: a brace group, or one character."""
    _, found, rest = text.rpartition("\\boxed")
    rest = rest.lstrip()
    if not found or not rest:
        return ""
    if rest[0] != "{":
        return rest[0]
    end = _balanced(rest, 0)
    return rest[1 : end - 1] if end > 0 else ""


_FRACTION = re.compile(r"\\[dt]?frac(?![a-zA-Z])")
_ARGUMENT = re.compile(r"\s*(?:(?P<group>\{)|(?P<command>\\[^\W\d_]*)|(?P<one>\S))")


def simplify_latex(text: str) -> str:
    """One spelling of roots and fractions, without spaces, \\left, \\right and \\text."""

    def fractions(s: str) -> str:
        m = _FRACTION.search(s)
        if not m:
            return s
        at, parts = m.end(), []
        for _ in range(2):
            arg = _ARGUMENT.match(s, at)
            if not arg:
                return s[: m.end()] + fractions(s[m.end() :])
            if arg["group"]:
                end = _balanced(s, arg.start("group"))
                end = len(s) if end < 0 else end
                inner = fractions(s[arg.start("group") + 1 : end - 1])
                parts.append(inner if len(inner) == 1 and inner.isdigit() else "{" + inner + "}")
                at = end
            else:
                parts.append(arg["command"] or arg["one"])
                at = arg.end()
        return s[: m.start()] + "\\frac" + "".join(parts) + fractions(s[at:])

    s = fractions(re.sub(r"\\sqrt\{(\d)\}", r"\\sqrt\1", text))
    for drop in (" ", "\\left", "\\right"):
        s = s.replace(drop, "")
    return re.sub(r"\\text\{([^}]*)\}", r"\1", s)


@pandas_udf(StringType())
def boxed_answer(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else boxed(t))


@pandas_udf(StringType())
def simple_latex(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else simplify_latex(t))


@pandas_udf(StringType())
def boxed_for_comparison(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else simplify_latex(boxed(t)))


# --- two-fact stories ------------------------------------------------------

# Verbs after which an item stays where it is.
DROPPING = ["down", "dropped", "discarded", "left"]


def story_references(facts: Column, question: Column, places: Column) -> Column:
    """(mention, location): the last fact that mentions the asked item, and the last
    fact that places its carrier; before the mention if the item is dropped there."""
    item = F.element_at(words(F.regexp_replace(stripped(question), r"\?$", "")), -1)
    at = F.array_max(F.transform(facts, lambda f, i: F.when(F.contains(f, item), i)))
    mention = F.get(facts, at)
    who = F.get(words(mention), F.lit(0))
    dropped = F.exists(F.array(*map(F.lit, DROPPING)), lambda verb: F.contains(mention, verb))
    placed = F.array_max(F.transform(facts, lambda f, i: F.when(F.contains(f, who) & F.exists(places, lambda p: F.contains(f, p)) & (~dropped | (i < at)), i)))
    return F.array(at, placed)
